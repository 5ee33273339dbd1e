"""Glossary files (S11-S16): JSON of versions 1 and 2, with a reject channel instead of exceptions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Fixed values of the format.
TYPES = "character place organization event item date_or_time phrase term other".split()
STATUSES = "proposed confirmed locked".split()
GENDERS = "feminine masculine neuter common unspecified".split()
VERSIONS = (1, 2)
ENTRY = (
    "struct<source_term:string,target_term:string,type:string,status:string,gender:string,notes:string,"
    "source_known:boolean,source_aliases:array<string>,target_aliases:array<string>>"
)
PAYLOAD = f"version int, project_id string, entries array<{ENTRY}>"


def read(spark: SparkSession, path: str) -> DataFrame:
    """One row per entry of every file, with its position; files of another version give one rejected row."""
    raw = spark.read.schema(PAYLOAD).option("multiLine", True).json(path).withColumn("file", F.input_file_name())
    return explode_payload(raw)


def explode_payload(raw: DataFrame) -> DataFrame:
    ok = F.col("version").isin(*VERSIONS) & F.col("entries").isNotNull()
    good = raw.where(ok).select("project_id", F.posexplode("entries").alias("position", "e")).select("project_id", "position", "e.*", F.lit(None).cast("string").alias("file_error"))
    bad = raw.where(~F.coalesce(ok, F.lit(False))).select("project_id", F.lit("unsupported version or no entries").alias("file_error"))
    return good.unionByName(bad, allowMissingColumns=True)


def fault(source: Column, target: Column, known: Column, type_: Column, status: Column, gender: Column) -> Column:
    """The first reason to reject an entry, or null."""
    blank = lambda c: F.trim(c) == ""
    known = F.coalesce(known, F.lit(True))
    return (
        F.when(target.isNull() | blank(target), "no target term").when(source.isNull() & known, "no source term").when(blank(source), "blank source term")
        .when(~F.coalesce(type_, F.lit("term")).isin(TYPES), "type").when(~F.coalesce(status, F.lit("proposed")).isin(STATUSES), "status")
        .when(~gender.isin(GENDERS), "gender")
    )


def normalise(entries: DataFrame) -> DataFrame:
    """Entries with defaults filled in, blank aliases dropped, and `fault` where one is to be rejected."""
    lists = lambda c: F.filter(F.coalesce(c, F.array().cast("array<string>")), lambda x: F.trim(x) != "").alias(c)
    return entries.select(
        *[c for c in entries.columns if c not in ("type", "status", "source_known", "source_aliases", "target_aliases")],
        F.coalesce("type", F.lit("term")).alias("type"), F.coalesce("status", F.lit("proposed")).alias("status"), F.coalesce("source_known", F.lit(True)).alias("source_known"),
        *[lists(c) for c in ("source_aliases", "target_aliases") if c in entries.columns],
        fault(F.col("source_term"), F.col("target_term"), F.col("source_known"), F.col("type"), F.col("status"), F.col("gender")).alias("fault"),
    )


def export_entries(entries: DataFrame) -> DataFrame:
    """One JSON object per entry, keys in fixed order, with its place in the stable order of its project."""
    from quillmill.operators.ordered import running, sliced

    keys = ["source_term", "target_term", "type", "status", "gender", "notes", "source_known"]
    rows = entries.select("project_id", "source_term", "id", F.to_json(F.struct(*keys), {"ignoreNullFields": "false"}).alias("entry"))
    order = ["source_term", "id"]
    placed = running(sliced(rows, ["project_id"], order), ["project_id"], order, {"position": ("sum", F.lit(1))})
    return placed.select("project_id", "id", F.col("position").cast("int").alias("position"), "entry")


def write(entries: DataFrame, path: str) -> None:
    """JSON lines partitioned by project; Spark's committer renames finished files only."""
    export_entries(entries).repartition("project_id").sortWithinPartitions("project_id", "position").write.mode("overwrite").partitionBy("project_id").json(path)
