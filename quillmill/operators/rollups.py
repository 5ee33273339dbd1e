"""Aggregates of the call ledger, of segments and of glossaries (A operators)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F


def zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def ratio(part: Column, whole: Column) -> Column:
    """0 where there is nothing to divide by."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.round(part / whole, 6))


def money(c: Column, digits: int = 4) -> Column:
    """A sum of money, added as decimals so that the order of rows cannot show; 0 over nothing."""
    return F.round(F.coalesce(F.sum(c.cast("decimal(18,8)")), F.lit(0).cast("decimal(28,8)")), digits).cast("double")


LEDGER = lambda: [
    F.count("*").alias("calls"), zero(F.sum("prompt_tokens")).alias("prompt_tokens"), zero(F.sum("completion_tokens")).alias("completion_tokens"),
    money(F.col("cost_usd")).alias("cost_usd"), F.count_if("cache_hit").alias("cache_hits"),
]


def ledger_by(calls: DataFrame, *keys: str) -> DataFrame:
    """Tokens, cost, calls and hits per key; sums over nothing are 0."""
    return calls.groupBy(*[F.coalesce(k, F.lit("(unknown)")).alias(k) for k in keys]).agg(*LEDGER())


def activity(calls: DataFrame) -> DataFrame:
    """By model, by purpose and in total, in one pass over the ledger; the total is there without any call."""
    named = calls.withColumn("model", F.coalesce("model", F.lit("(unknown)"))).withColumn("purpose", F.coalesce("purpose", F.lit("(unknown)")))
    out = named.groupingSets([["model"], ["purpose"], []], "model", "purpose").agg(F.grouping_id().alias("_g"), *LEDGER())
    kind = F.when(F.col("_g") == 1, "model").when(F.col("_g") == 2, "purpose").otherwise("total")
    sums = ["calls", "prompt_tokens", "completion_tokens", "cost_usd", "cache_hits"]
    rows = out.select(kind.alias("kind"), F.coalesce("model", "purpose", F.lit("all")).alias("key"), *sums)
    # grouping sets over no rows give no total, so a row of zeros stands by
    zeros = calls.sparkSession.range(1).select(F.lit("total").alias("kind"), F.lit("all").alias("key"), *[F.lit(0).cast(out.schema[c].dataType).alias(c) for c in sums])
    rows = rows.unionByName(zeros).groupBy("kind", "key").agg(*[F.sum(c).alias(c) for c in sums])
    return rows.withColumn("hit_rate", ratio(F.col("cache_hits"), F.col("calls")))


def spend_shares(calls: DataFrame, key: str) -> DataFrame:
    """Share of all spend per key; the window runs over the few rows of the rollup."""
    by = calls.groupBy(key).agg(money(F.col("cost_usd")).alias("cost"))
    return by.select(key, F.col("cost").alias("cost_usd"), F.round(F.when(F.sum("cost").over(W.partitionBy()) == 0, 0.0).otherwise(100 * F.col("cost") / F.sum("cost").over(W.partitionBy())), 3).alias("percent"))


def project_stats(projects: DataFrame, segments: DataFrame, calls: DataFrame, chapters: DataFrame) -> DataFrame:
    """One row of counts and ratios per project."""
    s = segments.groupBy("project_id").agg(
        F.count("*").alias("segments"), F.count_if(F.col("status") != "pending").alias("translated"),
        F.count_if(F.col("status") == "approved").alias("approved"), F.count_if(F.col("status") == "flagged").alias("flagged"),
    )
    c = ledger_by(calls, "project_id")
    n = chapters.groupBy("project_id").agg(F.count("*").alias("chapters"))
    j = projects.select(F.col("id").alias("project_id"), "budget_usd").join(s, "project_id", "left").join(c, "project_id", "left").join(n, "project_id", "left")
    z = lambda x: zero(F.col(x))
    return j.select(
        "project_id", z("chapters").alias("chapters"), z("segments").alias("segments"), z("translated").alias("translated"), z("approved").alias("approved"), z("flagged").alias("flagged"),
        (z("prompt_tokens") + z("completion_tokens")).alias("tokens"), F.coalesce("cost_usd", F.lit(0.0)).alias("spend"),
        ratio(z("translated"), z("segments")).alias("progress"), ratio(z("cache_hits"), z("calls")).alias("hit_rate"), ratio(z("flagged"), z("translated")).alias("failure_rate"),
    )


def chapter_shapes(chapters: DataFrame, segments: DataFrame, translatable: Column) -> DataFrame:
    """Segments of each chapter by what can be and has been translated; chapters without any stay."""
    live = segments.withColumn("_t", translatable)
    by = live.groupBy("chapter_id").agg(
        F.count("*").alias("segment_count"), F.count_if("_t").alias("translatable"), F.count_if(F.col("_t") & (F.col("status") == "approved")).alias("approved"),
        F.count_if(F.col("_t") & F.col("status").isin("translated", "approved")).alias("translated"),
    )
    j = chapters.select(F.col("id").alias("chapter_id"), "project_id", "spine_idx").join(by, "chapter_id", "left")
    z = lambda x: zero(F.col(x))
    return j.select(
        "chapter_id", "project_id", "spine_idx", z("segment_count").alias("segment_count"), z("translatable").alias("translatable"), z("approved").alias("approved"),
        z("translated").alias("translated"), (z("translatable") - z("translated")).alias("pending"), ratio(z("translated"), z("translatable")).alias("share"),
    )


def shape_summary(shapes: DataFrame) -> DataFrame:
    """A10: per project, over chapters with something to translate: counts, longest, shortest, mean and exact median."""
    some = shapes.where("translatable > 0")
    first = lambda agg, sign: agg("chapter_id", F.struct(F.col("translatable") * sign, -F.col("spine_idx") if agg is F.max_by else F.col("spine_idx")))
    return some.groupBy("project_id").agg(
        F.greatest(F.count("*"), F.max("spine_idx") + 1).alias("chapters"), F.count("*").alias("live_chapters"), F.sum("translatable").alias("translatable"),
        first(F.max_by, 1).alias("longest"), first(F.min_by, 1).alias("shortest"), F.round(F.avg("translatable"), 4).alias("mean"), F.median("translatable").alias("median"),
    )


def duplicate_groups(entries: DataFrame) -> DataFrame:
    """Entries whose source term a project holds more than once, with the winner by status, type and age.

    The winner is a minimum, combined before the shuffle; no group is gathered.
    """
    rank = F.struct(
        F.when(F.col("status") == "locked", 0).when(F.col("status") == "confirmed", 1).when(F.col("status") == "proposed", 2).otherwise(99).alias("s"),
        F.when(F.col("type") == "term", 1).otherwise(0).alias("t"), F.col("created_at").alias("c"), F.col("id").alias("id"),
    )
    known = entries.where("source_term IS NOT NULL")
    by = known.groupBy("project_id", "source_term").agg(F.min(rank).alias("m"), F.count("*").alias("members")).where("members > 1")
    return known.select("project_id", "source_term", "id").join(by, ["project_id", "source_term"]).select("project_id", "source_term", "id", F.col("m.id").alias("winner"), "members")


def first_non_empty(df: DataFrame, key: str, order: str, *values: str) -> DataFrame:
    """Per key, the first value that is neither null nor blank, in order."""
    pick = lambda v: F.min_by(F.when(F.trim(v) != "", F.col(v)), F.when(F.trim(v) != "", F.col(order))).alias(v)
    return df.groupBy(key).agg(*[pick(v) for v in values])


def batch_fold(outcomes: DataFrame, failed: Column) -> DataFrame:
    """outcomes(project_id, flagged, cache_hit, tokens and cost of a call) -> counts by the first that holds of failed, flagged, cached, translated."""
    o = outcomes.withColumn("_x", failed).withColumn("_f", F.coalesce("flagged", F.lit(False)))
    ok = ~F.col("_x")
    return o.groupBy("project_id").agg(
        F.count_if("_x").alias("failed"), F.count_if(ok & F.col("_f")).alias("flagged"), F.count_if(ok & ~F.col("_f") & F.col("cache_hit")).alias("cached"), F.count_if(ok & ~F.col("_f") & ~F.col("cache_hit")).alias("translated"),
        zero(F.sum(F.when(ok, F.coalesce("prompt_tokens", F.lit(0)) + F.coalesce("completion_tokens", F.lit(0))))).alias("tokens"), money(F.when(ok, F.col("cost_usd"))).alias("cost"))


def dashboard(entries: DataFrame, most: int = 5) -> DataFrame:
    """(section, key, entries): by status, without a source term, and the types that most entries have."""
    by = lambda section, c: entries.groupBy(F.lit(section).alias("section"), F.col(c).alias("key")).agg(F.count("*").alias("entries"))
    only = entries.where("source_term IS NULL").groupBy(F.lit("target only").alias("section"), F.lit("all").alias("key")).agg(F.count("*").alias("entries"))
    return by("status", "status").unionByName(only).unionByName(by("type", "type").orderBy(F.desc("entries"), "key").limit(most))


def series(links: DataFrame, segments: DataFrame, calls: DataFrame) -> DataFrame:
    """Per attached book, the projects that hold it: how many may write, their segments, spend and progress."""
    s = segments.groupBy("project_id").agg(F.count("*").alias("segments"), F.count_if(F.col("status") != "pending").alias("translated"), F.count_if(F.col("status") == "approved").alias("approved"))
    c = calls.groupBy("project_id").agg(F.sum(F.col("cost_usd").cast("decimal(18,8)")).alias("cost"))
    j = links.join(s, "project_id", "left").join(c, "project_id", "left")
    total = lambda x: F.coalesce(F.sum(x), F.lit(0))
    return j.groupBy("lore_id").agg(
        F.count("*").alias("projects"), F.count_if(F.col("mode") == "writable").alias("writable"), total("segments").alias("segments"), total("translated").alias("translated"), total("approved").alias("approved"),
        money(F.col("cost")).alias("spend"), F.round(F.when(total("segments") == 0, 0.0).otherwise(100.0 * F.sum("translated") / F.sum("segments")), 4).alias("percent"))


def next_numbers(held: DataFrame, fresh: DataFrame, key: str, number: str, *order: Column) -> DataFrame:
    """Numbers for new rows after the largest held one of their key (from 0 where there is none)."""
    top = held.groupBy(key).agg(F.max(number).alias("_top"))
    place = F.row_number().over(W.partitionBy(key).orderBy(*order))
    return fresh.join(top, key, "left").withColumn(f"new_{number}", (F.coalesce("_top", F.lit(-1)) + place).cast("int")).drop("_top")
