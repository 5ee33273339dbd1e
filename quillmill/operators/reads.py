"""Point reads, worklists and joins over the corpus tables (F and J operators).

Every function takes and returns DataFrames; nothing is collected. Orders end in a unique key.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def book_order(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Segments with the spine position of their chapter (J01); chapters are the smaller side and AQE may send them whole."""
    spine = chapters.select(F.col("id").alias("chapter_id"), "spine_idx")
    return segments.join(spine, "chapter_id")


def by_status(segments: DataFrame, chapters: DataFrame, status: str, chapter_ids: list[str] | None = None) -> DataFrame:
    """segments of one status; an empty list of chapters gives no row."""
    out = segments.where(F.col("status") == status)
    if chapter_ids is not None:
        out = out.where(F.col("chapter_id").isin(chapter_ids)) if chapter_ids else out.where(F.lit(False))
    return book_order(out, chapters)


def with_aliases(entries: DataFrame, aliases: DataFrame) -> DataFrame:
    """Entries with sorted arrays of their aliases on both sides; entries without any get empty arrays."""
    lists = aliases.groupBy("entry_id").agg(
        F.array_sort(F.collect_list(F.when(F.col("side") == "source", F.col("text")))).alias("source_aliases"),
        F.array_sort(F.collect_list(F.when(F.col("side") == "target", F.col("text")))).alias("target_aliases"),
    )
    none = F.array().cast("array<string>")
    return (
        entries.join(lists, entries.id == lists.entry_id, "left").drop("entry_id")
        .withColumn("source_aliases", F.coalesce("source_aliases", none)).withColumn("target_aliases", F.coalesce("target_aliases", none))
    )


def first_per(df: DataFrame, keys: list[str], *order: Column) -> DataFrame:
    """The first row per key in a total ascending order, nulls first.

    An aggregate, not a window: rows of a hot key are combined before they are shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    picked = df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r"))
    return picked.select(*keys, "_r.*").select(*df.columns)


def book_positions(segments: DataFrame, chapters: DataFrame) -> DataFrame:
    """Segments with `spine_idx` and their place in the book, from 1.

    The place is the number of segments in the chapters before plus the place within the chapter, so a book
    that holds a large part of all rows is numbered by as many tasks as it has chapters.
    """
    inside = segments.withColumn("_in", F.row_number().over(W.partitionBy("chapter_id").orderBy("idx", "id")))
    sizes = segments.groupBy("chapter_id").agg(F.count("*").alias("_size"))
    c = chapters.select(F.col("id").alias("chapter_id"), F.col("project_id").alias("_book"), "spine_idx").join(sizes, "chapter_id")
    before = W.partitionBy("_book").orderBy("spine_idx", "chapter_id").rowsBetween(W.unboundedPreceding, -1)
    offsets = c.select("chapter_id", "spine_idx", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return inside.join(offsets, "chapter_id").withColumn("position", (F.col("_before") + F.col("_in")).cast("int")).drop("_before", "_in")


def chapter_range(chapters: DataFrame, expression: str) -> DataFrame:
    """chapters named by `*`, `N` or `A-B`, counted from 1 in spine order; anything else names none."""
    import re

    numbered = chapters.withColumn("position", F.row_number().over(W.partitionBy("project_id").orderBy("spine_idx", "id")))
    text = expression.strip()
    if text == "*":
        return numbered
    m = re.fullmatch(r"(\d+)(?:\s*-\s*(\d+))?", text)
    if not m:
        return numbered.where(F.lit(False))
    a, b = int(m.group(1)), int(m.group(2) or m.group(1))
    return numbered.where(F.col("position").between(a, b))


def overrides(json_text: Column) -> Column:
    """a JSON object as a map of strings; anything else as an empty map."""
    empty = F.create_map().cast("map<string,string>")
    return F.coalesce(F.when(F.ltrim(json_text).startswith("{"), F.from_json(json_text, "map<string,string>")), empty)


def log_filter(events: DataFrame, now: int, window: str | None = None, needle: str | None = None) -> DataFrame:
    """events of the last 24 hours or of today (UTC), whose kind or payload holds the needle in any case."""
    out = events
    if window == "24h":
        out = out.where(F.col("ts") >= now - 86_400)
    elif window == "today":
        out = out.where(F.col("ts") >= now - now % 86_400)
    if needle:
        out = out.where(F.lower(F.concat_ws(" ", "kind", "payload")).contains(needle.lower()))
    return out


# Log levels, the lowest first.
LOG_LEVELS = ("DEBUG", "INFO", "WARNING", "ERROR", "CRITICAL")


def log_records(records: DataFrame, min_level: str | None = None, prefix: str | None = None, needle: str | None = None) -> DataFrame:
    """records(level, logger, message) of at least a level, of loggers that open with a prefix, whose message holds the needle in any case."""
    out = records
    if min_level:
        out = out.where(F.col("level").isin(*LOG_LEVELS[LOG_LEVELS.index(min_level) :]))
    if prefix:
        out = out.where(F.col("logger").startswith(prefix))
    return out.where(F.lower("message").contains(needle.lower())) if needle else out


def rehost_by_hash(fresh: DataFrame, stored: DataFrame) -> DataFrame:
    """Fresh segments with the id of the first stored one of equal hash, or null."""
    first = first_per(stored, ["source_hash"], F.col("idx"), F.col("id")).select("source_hash", F.col("id").alias("stored_id"))
    return fresh.join(first, "source_hash", "left")


def backfill(target: DataFrame, source: DataFrame, key: str, column: str) -> DataFrame:
    """Fill null values of a column from another table by key; values that are there stay."""
    other = first_per(source.where(F.col(column).isNotNull()), [key], F.col(column)).select(key, F.col(column).alias("_new"))
    return target.join(other, key, "left").withColumn(column, F.coalesce(column, "_new")).drop("_new")


def conflicts(incoming: DataFrame, existing: DataFrame, keys: list[str], payload: list[str]) -> DataFrame:
    """Each incoming row as new, same or conflict against the existing row of its key (null-safe compare)."""
    held = existing.select(*keys, F.lit(True).alias("_held"), *[F.col(c).alias(f"existing_{c}") for c in payload])
    same = F.lit(True)
    for c in payload:
        same = same & F.col(c).eqNullSafe(F.col(f"existing_{c}"))
    action = F.when(F.col("_held").isNull(), "new").when(same, "same").otherwise("conflict")
    return incoming.join(held, keys, "left").withColumn("action", action).drop("_held")
