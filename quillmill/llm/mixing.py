"""Problem 8: mix sources to target shares of the total size, repeating each document a capped number of times.

Method: Efraimidis-Spirakis sampling. A document's key is -ln(u) / weight, with u from a hash of its id and
a seed and the weight from the quality of its text; within a source, documents go in the order of their keys
and are taken until the prefix sum of tokens reaches the token budget of the source. Whole epochs come first:
a source whose budget exceeds its size gives every document floor(budget / size) times, and only the rest is
chosen by key.

The total is the largest that every source can serve: min over sources of max_repeats * size / share (or a
given total, if smaller). Prefix sums are taken in two steps - over BINS ranges of the key per source, then
inside the one range that the budget ends in - so no source is sorted in one task.

Defined results: sources without a target, null sources and null ids are left out; texts that are null or
empty have no tokens and come along in whole epochs only; repeated ids count once; a source with a share of
0 or fewer gives nothing; a source that is in the targets without tokens is reported with a share of 0, and
the others keep the proportions of their targets; each source is given once in the targets.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillmill.llm.encoding import TOKENIZER_DIR, token_counts
from quillmill.runtime import cut_lineage

BINS = 4096
SEED = 20
#: Targets of at most so many sources are broadcast (a short row a source); beyond, rows are joined under salts.
BROADCAST_SOURCES = 10_000
SALTS = 64


def quality_weight(text=None):
    """Weight of a document in (0, 1], from three signs of running text.

    The share of letters, blanks and common marks (mark-up and control characters lower it); the variety of its words
    against what a text of that length has (distinct words grow about as the 0.7th power; repeated boilerplate has
    fewer); and the share of words of usual length (long runs without blanks lower it; script without blanks is exempt).
    """
    text = F.coalesce(F.col("text") if text is None else text, F.lit(""))
    size = F.length(text)
    plain = F.length(F.regexp_replace(text, r"[^\p{L}\p{N}\s.,;:!?'\"()-]", "")) / size
    words = F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), 1)
    n = F.size(words)
    variety = F.least(F.lit(1.0), F.size(F.array_distinct(F.transform(words, F.lower))) / F.pow(n, F.lit(0.7)))
    unspaced = F.length(F.regexp_replace(text, r"[^\u3041-\u30ff\u4e00-\u9fff]", "")) / size
    usual = F.size(F.filter(words, lambda w: F.length(w) <= 25)) / n
    shape = F.when(unspaced > 0.2, F.lit(1.0)).when(n > 0, variety * usual).otherwise(F.lit(0.05))
    return F.when(size == 0, F.lit(0.05)).otherwise(F.greatest(F.lit(0.05), plain * shape))


def _with_source(rows: DataFrame, per_source: DataFrame, few: bool) -> DataFrame:
    """rows joined with a row per source; no source is gathered in one task."""
    if few:
        return rows.join(F.broadcast(per_source), "source")
    salted = per_source.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    return rows.withColumn("_salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int")).join(salted, ["source", "_salt"]).drop("_salt")


def sized_documents(documents: DataFrame, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, weight, tokens) of each document with an id and a source, once."""
    docs = documents.where("doc_id IS NOT NULL AND source IS NOT NULL").select("doc_id", "source", "text", quality_weight().alias("weight"))
    counted = token_counts(docs, ["doc_id", "source", "weight"], folder=folder)
    return counted.groupBy("doc_id").agg(F.min(F.struct("source", "weight", "tokens")).alias("r")).select("doc_id", "r.*")


def mix(documents: DataFrame, targets: DataFrame, total: int | None = None, seed: int = SEED, folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, source, tokens, copies): how often each document goes into the mix, for those that do."""
    wanted = targets.where("source IS NOT NULL AND target_share > 0 AND max_repeats >= 1").select("source", "target_share", "max_repeats")
    few = wanted.count() <= BROADCAST_SOURCES
    sized = cut_lineage(sized_documents(_with_source(documents.select("doc_id", "source", "text"), wanted.select("source").distinct(), few), folder))
    sizes = sized.groupBy("source").agg(F.sum("tokens").alias("size"))
    plan = wanted.join(sizes.where("size > 0"), "source")
    most = plan.agg(F.min(F.col("max_repeats") * F.col("size") / F.col("target_share")).alias("t")).first()["t"] or 0.0
    goal = min(most, total) if total is not None else most
    plan = plan.select(
        "source", "max_repeats",
        F.least(F.floor(F.col("target_share") * F.lit(goal) / F.col("size") + F.lit(1e-12)), F.col("max_repeats")).cast("int").alias("epochs"),
        (F.col("target_share") * F.lit(goal)).alias("budget"), "size",
    ).withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("size")).otherwise(0.0))
    unit = (F.pmod(F.xxhash64("doc_id", F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    # the order of -ln(u)/w is that of 1 - u^(1/w), which lies in (0, 1) and so falls into bins
    keyed = _with_source(sized, plan, few).withColumn("key", 1 - F.pow(unit, 1 / F.col("weight"))).withColumn("bin", F.floor(F.col("key") * BINS).cast("int"))
    bins = keyed.groupBy("source", "bin").agg(F.sum("tokens").alias("held"))
    bins = bins.withColumn("before", F.sum("held").over(W.partitionBy("source").orderBy("bin")) - F.col("held"))
    placed = keyed.join(bins, ["source", "bin"])
    whole = placed.where("before + held <= rest").withColumn("chosen", F.lit(True))
    edge = placed.where("before < rest AND before + held > rest").withColumn("upto", F.col("before") + F.sum("tokens").over(W.partitionBy("source", "bin").orderBy("key", "doc_id")))
    # the document that crosses the budget is taken if that ends nearer to it
    edge = edge.withColumn("chosen", F.col("upto") - F.col("rest") <= F.col("tokens") / 2).drop("upto")
    beyond = placed.where("before >= rest").withColumn("chosen", F.lit(False))
    copies = F.col("epochs") + F.when(F.col("chosen") & (F.col("tokens") > 0), 1).otherwise(0)
    return whole.unionByName(edge).unionByName(beyond).select("doc_id", "source", "tokens", copies.cast("int").alias("copies")).where("copies > 0")


def shares(mixed: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, documents, most_copies, tokens, actual_share) of each target."""
    got = mixed.groupBy("source").agg(
        F.count("*").alias("documents"), F.max("copies").alias("most_copies"), F.sum(F.col("tokens") * F.col("copies")).alias("tokens"),
    )
    out = targets.select("source", "target_share", "max_repeats").join(got, "source", "left").select(
        "source", "target_share", "max_repeats", F.coalesce("documents", F.lit(0)).alias("documents"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"), F.coalesce("tokens", F.lit(0)).alias("tokens"),
    )
    # the targets are few: one row each
    every = F.sum("tokens").over(W.partitionBy(F.lit(0)))
    return out.withColumn("actual_share", F.round(F.coalesce(F.col("tokens") / F.nullif(every, F.lit(0)), F.lit(0.0)), 6))
