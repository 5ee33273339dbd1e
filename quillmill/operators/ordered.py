"""Order-dependent operators (W): context windows, greedy chunks, runs, breakers and caps.

What a window of a few rows can express stays one. Whatever runs over a whole key (running totals, numbers, runs,
chunks) goes in two steps, so that a key that holds a large part of all rows is no single task: rows are cut into
slices of about equal size along the order of keys (`sliced`), each slice is folded alone, and what the slices before
contribute comes from a table with a row for each key of each slice.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W, functions as F

from quillmill.runtime import cut_lineage


def sliced(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows with `_slice`: slices follow one another in the order of (keys, order); written once, so the bounds hold."""
    n = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cut_lineage(df.repartitionByRange(n, *keys, *order).withColumn("_slice", F.spark_partition_id()))


def _with_slice(rows: DataFrame, per_slice: DataFrame, keys: list[str]) -> DataFrame:
    """Rows with what holds for their key in their slice; null keys are a key of their own."""
    other = per_slice.select(F.col("_slice").alias("_slice2"), *[F.col(k).alias(f"_key_{k}") for k in keys], *[c for c in per_slice.columns if c not in ("_slice", *keys)])
    same = F.col("_slice") == F.col("_slice2")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_key_{k}"))
    return rows.join(other, same).drop("_slice2", *[f"_key_{k}" for k in keys])


def running(cut: DataFrame, keys: list[str], order: list[str], totals: dict[str, tuple[str, Column]], inclusive: bool = True) -> DataFrame:
    """Running aggregates over sliced rows: totals maps a name to (`sum`, `max` or `last`, expression), in the order of each key.

    Not inclusive, a row sees only those before it. Sums over nothing are null. `last` takes the value of the row before
    (or of the row itself), nulls included.
    """
    slices = cut
    for name, (_, value) in totals.items():
        slices = slices.withColumn(f"_v_{name}", value)
    within = W.partitionBy("_slice", *keys).orderBy(*order).rowsBetween(W.unboundedPreceding, 0 if inclusive else -1)
    fold = {"sum": F.sum, "max": F.max}
    per = slices.groupBy("_slice", *keys).agg(*[
        (F.max_by(F.struct(f"_v_{n}"), F.struct(*order)) if how == "last" else fold[how](f"_v_{n}")).alias(f"_s_{n}") for n, (how, _) in totals.items()])
    earlier = W.partitionBy(*keys).orderBy("_slice").rowsBetween(W.unboundedPreceding, -1)
    before = per.select("_slice", *keys, *[
        (F.lag(f"_s_{n}").over(W.partitionBy(*keys).orderBy("_slice")) if how == "last" else fold[how](f"_s_{n}").over(earlier)).alias(f"_b_{n}") for n, (how, _) in totals.items()])
    out = slices
    for n, (how, _) in totals.items():
        out = out.withColumn(f"_w_{n}", (F.last(F.struct(f"_v_{n}")) if how == "last" else fold[how](f"_v_{n}")).over(within))
    out = _with_slice(out, before, keys)

    def both(n: str, how: str) -> Column:
        a, w = F.col(f"_b_{n}"), F.col(f"_w_{n}")
        if how == "last":
            return F.coalesce(w, a)[f"_v_{n}"]
        return F.greatest(a, w) if how == "max" else F.coalesce(a + w, w, a)

    return out.select(*cut.columns, *[both(n, how).alias(n) for n, (how, _) in totals.items()])


def preceding_context(segments: DataFrame, most_segments: int, most_chars: int) -> DataFrame:
    """Per segment, the preceding segments of its chapter that serve as context.

    Newest first: one longer than the cap is skipped, the first that overflows the running total ends the scan.
    """
    frame = W.partitionBy("chapter_id").orderBy("idx", "id").rowsBetween(-most_segments, -1)
    back = F.reverse(F.collect_list(F.struct(F.col("idx").alias("i"), F.length("source_text").alias("n"))).over(frame))
    start = F.struct(F.lit(0).alias("total"), F.lit(False).alias("stopped"), F.array().cast("array<int>").alias("kept"))

    def step(a: Column, x: Column) -> Column:
        if most_chars <= 0:
            return F.struct((a["total"] + x["n"]).alias("total"), F.lit(False).alias("stopped"), F.array_append(a["kept"], x["i"]).alias("kept"))
        return (
            F.when(a["stopped"] | (x["n"] > most_chars), a)
            .when(a["total"] + x["n"] > most_chars, F.struct(a["total"].alias("total"), F.lit(True).alias("stopped"), a["kept"].alias("kept")))
            .otherwise(F.struct((a["total"] + x["n"]).alias("total"), F.lit(False).alias("stopped"), F.array_append(a["kept"], x["i"]).alias("kept")))
        )

    folded = segments.withColumn("_f", F.aggregate(back, start, step))
    return folded.select("id", "chapter_id", "idx", F.reverse("_f.kept").alias("context"), F.col("_f.total").alias("context_chars"))


class _Fold:
    """The greedy fold over the sizes of one slice: a row opens a new chunk where it would pass the cap."""

    def __init__(self, sizes: list[int], cap: int, joiner: int):
        self.sizes, self.cap, self.joiner = sizes, cap, joiner
        self.known: dict[int, tuple[int, int]] = {}

    def opens(self, at: int, total: int) -> tuple[int, int]:
        """(row that opens the next chunk, or the number of rows; total there) from row `at` with `total` in the chunk."""
        for k in range(at, len(self.sizes)):
            if total and total + self.joiner + self.sizes[k] > self.cap:
                return k, total
            total += self.sizes[k] + (self.joiner if total else 0)
        return len(self.sizes), total

    def rest(self, row: int) -> tuple[int, int]:
        """(chunks opened, total at the end) where `row` opens a chunk; ways that meet are followed once."""
        way = []
        while row not in self.known:
            nxt, total = self.opens(row + 1, self.sizes[row])
            if nxt == len(self.sizes):
                self.known[row] = (1, total)
                break
            way.append((row, nxt))
            row = nxt
        for row, nxt in reversed(way):
            self.known[row] = (1 + self.known[nxt][0], self.known[nxt][1])
        return self.known[row if not way else way[0][0]]

    def exits(self) -> list[tuple[int, int, int, bool]]:
        """(least total at entry, chunks opened, total at exit, whether the entry total adds to it), falling by entry total.

        All totals at entry that open their first chunk at one row leave alike; 0 is an empty chunk, which takes any row.
        """
        out, grown = [], 0
        for k, n in enumerate(self.sizes):
            grown += n + self.joiner
            least = max(1, self.cap - grown + 1)
            if not out or least < out[-1][0]:
                out.append((least, *self.rest(k), False))
            if least == 1:
                break
        if not out or out[-1][0] > 1:
            out.append((1, 0, grown, True))
        row, total = self.opens(0, 0)
        out.append((0, 0, total, False) if row == len(self.sizes) else (0, *self.rest(row), False))
        return out


def greedy_chunks(rows: DataFrame, group: str, order: list[str], size: Column, cap: int, joiner: int = 0) -> DataFrame:
    """Number the chunks of each group: a row opens a new chunk where it would pass the cap.

    Each slice of a group is folded to what it makes of the total that enters it, these few lines are composed along the
    group, and each slice is then numbered from its own entry: no group is folded by one task. Only keys and sizes travel.
    """
    cut = sliced(rows.withColumn("_size", F.coalesce(size.cast("long"), F.lit(0).cast("long"))), [group], order)
    kind = cut.schema[group].dataType.simpleString()

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        sizes = pdf.sort_values(order, na_position="first")["_size"].astype(int).tolist()
        out = pd.DataFrame(_Fold(sizes, cap, joiner).exits(), columns=["least", "opened", "total", "adds"])
        return out.assign(**{group: pdf[group].iloc[0], "_slice": pdf["_slice"].iloc[0]})[[group, "_slice", "least", "opened", "total", "adds"]]

    def compose(pdf: pd.DataFrame) -> pd.DataFrame:
        entries, total, chunk = [], 0, 0
        for at, lines in pdf.sort_values(["_slice", "least"], ascending=[True, False]).groupby("_slice", sort=True):
            entries.append((pdf[group].iloc[0], at, total, chunk))
            line = next(x for x in lines.itertuples(index=False) if x.least <= total)
            total, chunk = int(line.total) + (total if line.adds else 0), chunk + int(line.opened)
        return pd.DataFrame(entries, columns=[group, "_slice", "_total", "_chunk"])

    fields = [f"`{f.name}` {f.dataType.simpleString()}" for f in cut.schema]

    def number(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(order, na_position="first")
        total, chunk, out = int(pdf["_total"].iloc[0]), int(pdf["_chunk"].iloc[0]), []
        for n in pdf["_size"].astype(int):
            if total and total + joiner + n > cap:
                chunk, total = chunk + 1, n
            else:
                total += n + (joiner if total else 0)
            out.append(chunk)
        return pdf.drop(columns=["_total", "_chunk"]).assign(chunk=out)

    lines = cut.select(group, "_slice", *order, "_size").groupBy(group, "_slice").applyInPandas(fold, f"`{group}` {kind}, _slice int, least long, opened long, total long, adds boolean")
    entries = lines.groupBy(group).applyInPandas(compose, f"`{group}` {kind}, _slice int, _total long, _chunk long")  # a few rows a slice
    return _with_slice(cut, entries, [group]).groupBy(group, "_slice").applyInPandas(number, f"{', '.join(fields)}, chunk int").drop("_size", "_slice")


def runs(df: DataFrame, keys: list[str], order: list[str], eligible: Column, most: int) -> DataFrame:
    """Consecutive eligible rows in groups of at most `most`; each ineligible row stands alone."""
    w = W.partitionBy(*keys).orderBy(*order)
    e = df.withColumn("_e", eligible)
    b = e.withColumn("_b", F.when(~F.col("_e") | F.lag("_e").over(w).isNull() | ~F.lag("_e").over(w), 1).otherwise(0))
    i = b.withColumn("island", F.sum("_b").over(w))
    n = i.withColumn("_n", F.row_number().over(W.partitionBy(*keys, "island").orderBy(*order)))
    return n.withColumn("part", F.floor((F.col("_n") - 1) / most)).drop("_e", "_b", "_n")


def run_lengths(df: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Runs of equal values in order: (keys, run, value, first, rows)."""
    seen = running(sliced(df.select(*keys, *order, value), keys, order), keys, order, {"_p": ("last", F.struct(F.col(value).alias("v")))}, inclusive=False)
    changed = F.when(F.col("_p").isNotNull() & F.col("_p.v").eqNullSafe(F.col(value)), 0).otherwise(1)
    marked = running(seen, keys, order, {"run": ("sum", changed)})
    return marked.groupBy(*keys, "run", value).agg(F.min(order[0]).alias("first"), F.count("*").alias("rows"))


def breaker(df: DataFrame, key: str, order: str, failed: Column, streak: int) -> DataFrame:
    """Where each key first reaches `streak` failures in a row; 0 disables it."""
    if streak <= 0:
        return df.select(key, F.col(order).alias("tripped_at")).where(F.lit(False))
    placed = running(sliced(df.select(key, order, failed.alias("_f")), [key], [order]), [key], [order], {"_at": ("sum", F.lit(1))})
    # the failures in a row are the rows since the last one that did not fail
    whole = running(placed, [key], [order], {"_whole": ("max", F.when(~F.coalesce("_f", F.lit(False)), F.col("_at")))})
    return whole.where(F.col("_f") & (F.col("_at") - F.coalesce("_whole", F.lit(0)) >= int(streak))).groupBy(key).agg(F.min(order).alias("tripped_at"))


def running_cut(df: DataFrame, key: str, order: list[str], amount: Column, cap: Column) -> DataFrame:
    """The first row of each key at which the running total is strictly above its cap."""
    summed = running(sliced(df, [key], order), [key], order, {"_t": ("sum", amount)})
    return summed.where(F.col("_t") > cap).groupBy(key).agg(F.min(F.struct(*order, F.col("_t").alias("total"))).alias("m")).select(key, "m.*")


def spread_sample(df: DataFrame, key: str, position: str, head: int, middle: int, tail: int) -> DataFrame:
    """The first, some evenly spaced middle and the last rows of each key; all rows where there are no more.

    `position` counts the rows of a key from 1; the size of a key is an aggregate, so no key is sorted.
    """
    sizes = df.groupBy(key).agg(F.count("*").alias("_n"))
    n = df.withColumn("_k", F.col(position) - 1).drop(position).join(sizes, key)
    zone = F.col("_n") - head - tail
    step = F.greatest(F.lit(1), F.floor(zone / (middle + 1)))
    at = F.col("_k") - head
    inside = (at >= step) & (at < zone) & (at % step == 0) & (at / step <= middle)
    return n.where((F.col("_n") <= head + middle + tail) | (F.col("_k") < head) | (F.col("_k") >= F.col("_n") - tail) | inside).drop("_n").withColumnRenamed("_k", "position")


def proportional(df: DataFrame, group: str, total: Column, weight: Column) -> DataFrame:
    """A total of each group split by weight, rounded down."""
    return df.withColumn("_w", weight).withColumn("share", F.floor(total * F.col("_w") / F.sum("_w").over(W.partitionBy(group)))).drop("_w")
