"""Set operations over heterogeneous rows (U operators) and recents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from quillmill.operators.reads import first_per


def inbox(segments: DataFrame, entries: DataFrame, alerts: DataFrame) -> DataFrame:
    """Flagged segments, proposed entries and alerts as (kind, id, project_id)."""
    row = lambda df, kind: df.select(F.lit(kind).alias("kind"), F.col("id").cast("string").alias("id"), "project_id")
    return row(segments.where("status = 'flagged'"), "flagged").unionByName(row(entries.where("status = 'proposed'"), "proposed")).unionByName(row(alerts, "alert"))


def attached_view(own: DataFrame, attached: DataFrame, *priority: Column) -> DataFrame:
    """All own rows, and of each (source, target, type) not among them the attached row of first priority."""
    triple = ["_s", "target_term", "type"]
    mark = lambda df: df.withColumn("_s", F.coalesce("source_term", F.lit("")))
    fresh = mark(attached).join(mark(own).select(*triple).distinct(), triple, "left_anti")
    once = first_per(fresh, triple, *priority)
    return own.withColumn("origin", F.lit("own")).unionByName(once.drop("_s").withColumn("origin", F.lit("attached")), allowMissingColumns=True)


def first_seen(df: DataFrame, key: str, value: str, order: str) -> DataFrame:
    """Distinct values per key in the order of their first appearance; pre-aggregated, so arrays hold distinct values only."""
    firsts = df.groupBy(key, value).agg(F.min(order).alias("_first"))
    return firsts.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("_first", F.col(value).alias("_v")))), lambda x: x["_v"]).alias("values"))


def newest(df: DataFrame, key: str, order: str, cap: int) -> DataFrame:
    """The newest row per key, newest first, at most `cap`."""
    rest = [c for c in df.columns if c != key]
    once = df.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(order)).alias("_r")).select(key, "_r.*").select(*df.columns)
    return once.orderBy(F.desc(order), key).limit(cap)
