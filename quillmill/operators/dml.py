"""State changes as next versions of tables (Z): every operator returns snapshots, nothing is updated in place."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F



def event(df: DataFrame, project: Column, ts: Column | int, kind: Column | str, payload: Column) -> DataFrame:
    """Event rows with a JSON payload."""
    col = lambda x: x if isinstance(x, Column) else F.lit(x)
    return df.select(project.alias("project_id"), col(ts).cast("long").alias("ts"), col(kind).alias("kind"), F.to_json(payload).alias("payload"))


def update_entries(entries: DataFrame, changes: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """changes(id, target_term?, status?, notes?) -> (entries, revisions); null means unchanged.

    A revision is written where target or status really changed.
    """
    c = changes.select("id", *[F.col(x).alias(f"_{x}") for x in ("target_term", "status", "notes")])
    j = entries.join(c, "id", "left")
    new = {x: F.coalesce(f"_{x}", x) for x in ("target_term", "status", "notes")}
    changed = ~new["target_term"].eqNullSafe(F.col("target_term")) | ~new["status"].eqNullSafe(F.col("status"))
    touched = changed | ~new["notes"].eqNullSafe(F.col("notes"))
    out = j.select(*[(new[x] if x in new else F.when(touched, F.lit(now)).otherwise(F.col(x)) if x == "updated_at" else F.col(x)).alias(x) for x in entries.columns])
    revisions = j.where(changed).select(F.col("id").alias("entry_id"), F.col("target_term").alias("prev_target_term"), new["target_term"].alias("new_target_term"), F.lit(now).cast("long").alias("created_at"))
    return out, revisions


def delete_entries(entries: DataFrame, gone: DataFrame, *dependants: DataFrame) -> list[DataFrame]:
    """Entries without the deleted, and each dependant table (by entry_id) without their rows."""
    ids = gone.select("id").distinct()
    return [entries.join(ids, "id", "left_anti"), *[d.join(ids.withColumnRenamed("id", "entry_id"), "entry_id", "left_anti") for d in dependants]]


def replace_by(held: DataFrame, fresh: DataFrame, keys: list[str], distinct: list[str]) -> DataFrame:
    """Rows of the keys that come anew replace the held ones; repeats go."""
    return held.join(fresh.select(*keys).distinct(), keys, "left_anti").unionByName(fresh.dropDuplicates(distinct))


def import_entries(held: DataFrame, incoming: DataFrame, overwrite: bool) -> DataFrame:
    """Each incoming entry as created, updated or skipped by (project, source term, type); null sources always create."""
    keys = held.where("source_term IS NOT NULL").select("project_id", "source_term", "type").distinct().withColumn("_held", F.lit(True))
    j = incoming.join(keys, ["project_id", "source_term", "type"], "left")
    return j.withColumn("action", F.when(F.col("_held").isNull(), "created").when(F.lit(overwrite), "updated").otherwise("skipped")).drop("_held")


def cascade(segments: DataFrame, affected: DataFrame, now: int) -> tuple[DataFrame, DataFrame]:
    """Affected segments go back to pending without a target; one event each and one per project."""
    ids = affected.select(F.col("segment_id").alias("id")).distinct().withColumn("_hit", F.lit(True))
    j = segments.join(ids, "id", "left")
    out = j.select(*[(F.when(F.col("_hit").isNull(), F.col(x)) if x == "target_text" else F.when(F.col("_hit"), F.lit("pending")).otherwise(F.col(x)) if x == "status" else F.col(x)).alias(x) for x in segments.columns])
    hit = j.where("_hit")
    each = event(hit, F.col("project_id"), now, "segment.reset", F.struct(F.col("id").alias("segment_id")))
    total = event(hit.groupBy("project_id").agg(F.count("*").alias("n")), F.col("project_id"), now, "glossary.cascaded", F.struct("n"))
    return out, each.unionByName(total)


def repair(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Fresh segments keep the stored segment of equal hash; the others are appended after the last index of their chapter."""
    from quillmill.operators.reads import rehost_by_hash
    from quillmill.operators.rollups import next_numbers

    met = rehost_by_hash(fresh, stored)
    new = next_numbers(stored, met.where("stored_id IS NULL"), "chapter_id", "idx", F.col("idx"), F.col("id"))
    return met.where("stored_id IS NOT NULL").withColumn("new_idx", F.lit(None).cast("int")).unionByName(new)


def fold_target_only(held: DataFrame, incoming: DataFrame) -> DataFrame:
    """Target-only proposals that no entry with the same (target term, type) of the project holds yet."""
    return incoming.join(held.select("project_id", "target_term", "type").distinct(), ["project_id", "target_term", "type"], "left_anti")
