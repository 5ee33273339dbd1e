"""Near-duplicate glossary entries (E01-E07): canonical buckets, fuzzy edges, components, merge.

The fuzzy join is exact. Keys within two edits must share their first letters (all letters of a shorter key), so these
are part of the join key. A key of length m is cut behind them into three parts, and a key within two edits of it
holds one of the parts nearly at its place: keys meet by equi-join on (project, first letters, length, part, text of
the part), and the edit distance is then tested in the JVM. Keys of a few letters have no three parts that say
anything; they meet by what is left of them with up to two letters left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillmill.functions import terms
from quillmill.operators.graph import components
from quillmill.operators.reads import first_per
from quillmill.runtime import cut_lineage

DISTANCE, PREFIX = 2, 3


def canonical_keys(entries: DataFrame) -> DataFrame:
    """Entries with their canonical key; those without one are left out."""
    return entries.withColumn("key", terms.canonical_form(terms.key_side(F.col("source_term"), F.col("target_term")))).where("key <> ''")


def parts(length: int) -> list[tuple[int, int]]:
    """(start, size) of the DISTANCE + 1 parts of a key of this length."""
    n = DISTANCE + 1
    base, extra = divmod(length, n)
    out, at = [], 0
    for k in range(n):
        size = base + (k >= n - extra)
        out.append((at, size))
        at += size
    return out


#: Behind the first letters, keys of at least so many letters are cut into parts; shorter ones are met by letters left out.
WHOLE_PARTS = 6


def left_out(text: str, most: int = DISTANCE) -> set[str]:
    """The text with up to `most` letters left out: two texts within `most` edits share one of these."""
    out, last = {text}, {text}
    for _ in range(most):
        last = {t[:k] + t[k + 1 :] for t in last for k in range(len(t))}
        out |= last
    return out


def _asked(tail: str) -> set[tuple[int, int, str]]:
    """(length, part, text) under which a tail looks for stored ones that are not longer.

    Of two tails within DISTANCE edits some part i stands whole, with at most i edits before it and DISTANCE - i behind: it
    is moved by no more than i, and counted from the end by no more than DISTANCE - i.
    """
    n = len(tail)
    out = set()
    for m in range(max(WHOLE_PARTS, n - DISTANCE), n + 1):
        for i, (a, size) in enumerate(parts(m)):
            low, high = max(0, a - i, a + n - m - (DISTANCE - i)), min(n - size, a + i, a + n - m + DISTANCE - i)
            out.update((m, i, tail[p : p + size]) for p in range(low, high + 1))
    return out


def _signatures(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows: list[tuple] = []
        for scope, key in zip(pdf["scope"], pdf["key"]):
            head, tail = key[:PREFIX], key[PREFIX:]
            n = len(tail)
            # a key of one or two letters opens the other, which has up to two more
            if len(key) < PREFIX:
                rows.append((scope, key, key, 0, -1, "", False, True))
            rows += [(scope, key, key[:k], 0, -1, "", True, False) for k in range(max(1, len(key) - DISTANCE), min(PREFIX, len(key)))]
            if len(key) < PREFIX:
                continue
            # the letters are alike up to here, so the edits lie in the tails
            if n < WHOLE_PARTS + DISTANCE:
                rows += [(scope, key, head, 0, -2, t, True, True) for t in left_out(tail)]
            if n >= WHOLE_PARTS:
                rows += [(scope, key, head, n, i, tail[a : a + size], True, False) for i, (a, size) in enumerate(parts(n))]
                rows += [(scope, key, head, m, i, piece, False, True) for m, i, piece in _asked(tail)]
        yield pd.DataFrame(rows, columns=["scope", "key", "head", "len", "part", "piece", "stored", "asks"])


def fuzzy_edges(keys: DataFrame) -> DataFrame:
    """keys(scope, key) distinct -> (scope, a, b): keys of one scope within two edits that share their first letters."""
    sig = cut_lineage(keys.mapInPandas(_signatures, "scope string, key string, head string, len int, part int, piece string, stored boolean, asks boolean"))
    on = ["scope", "head", "len", "part", "piece"]
    left = sig.where("stored").select(*on, F.col("key").alias("a"))
    right = sig.where("asks").select(*on, F.col("key").alias("b"))
    met = left.join(right, on).where("a <> b").select("scope", F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    shared = F.least(F.lit(PREFIX), F.length("a"), F.length("b"))
    return met.where((F.substring(F.col("a"), F.lit(1), shared) == F.substring(F.col("b"), F.lit(1), shared)) & (F.levenshtein("a", "b", DISTANCE) >= 0))


def winner_rank() -> Column:
    """Status, specific type, id."""
    s = F.col("status")
    return F.struct(F.when(s == "locked", 0).when(s == "confirmed", 1).when(s == "proposed", 2).otherwise(99), F.when(F.col("type") == "term", 1).otherwise(0), F.col("id"))


def near_duplicates(entries: DataFrame) -> DataFrame:
    """(project_id, root, id, winner) of every entry whose group has more than one."""
    keyed = cut_lineage(canonical_keys(entries).select("project_id", "id", "status", "type", "key"))
    keys = keyed.select(F.col("project_id").alias("scope"), "key").distinct()
    node = lambda s, k: F.concat_ws("\u0001", s, k)
    edges = fuzzy_edges(keys).select(node("scope", "a").alias("a"), node("scope", "b").alias("b"))
    roots = components(keys.select(node("scope", "key").alias("id")), edges).withColumnRenamed("id", "node")
    labelled = keyed.withColumn("node", node("project_id", "key")).join(roots, "node").withColumn("root", F.element_at(F.split("root", "\u0001", 2), 2))
    labelled = cut_lineage(labelled.select("project_id", "root", "id", "status", "type"))
    groups = labelled.groupBy("project_id", "root").agg(F.min_by("id", winner_rank()).alias("winner"), F.count("*").alias("n")).where("n > 1")
    return labelled.select("project_id", "root", "id").join(groups, ["project_id", "root"]).select("project_id", "root", "id", "winner")


def merge(entries: DataFrame, aliases: DataFrame, groups: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entries left, aliases left): losers go, their spellings and aliases move to the winner, less its own terms."""
    moved = groups.where("id <> winner").select(F.col("id").alias("entry_id"), "winner")
    left = entries.join(moved.select(F.col("entry_id").alias("id")), "id", "left_anti")
    spelled = entries.select(F.col("id").alias("entry_id"), F.explode(F.array(
        F.struct(F.lit("source").alias("side"), F.col("source_term").alias("text")), F.struct(F.lit("target").alias("side"), F.col("target_term").alias("text")))).alias("x")).select("entry_id", "x.*")
    more = spelled.join(moved, "entry_id").select(F.col("winner").alias("entry_id"), "side", "text")
    kept = aliases.join(moved, "entry_id", "left").select(F.coalesce("winner", "entry_id").alias("entry_id"), "side", "text")
    own = spelled.join(moved.select("entry_id"), "entry_id", "left_anti")
    return left, more.unionByName(kept).where("text IS NOT NULL AND text <> ''").distinct().join(own, ["entry_id", "side", "text"], "left_anti")


def canonical_lookup(proposed: DataFrame, entries: DataFrame) -> DataFrame:
    """For each proposal the entry of its project with the same canonical key, first by (source_term, id), or null."""
    held = first_per(canonical_keys(entries).select("project_id", "key", "source_term", "id"), ["project_id", "key"], F.col("source_term"), F.col("id"))
    return canonical_keys(proposed).select("project_id", "id", "key").join(held.select("project_id", "key", F.col("id").alias("held_id")), ["project_id", "key"], "left")
