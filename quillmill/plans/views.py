"""Domain views over the stored tables, in Spark and as SQL common table expressions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from quillmill.runtime import cut_lineage, still_there


class Tables:
    """Tables of one directory by name, and the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def raw(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def _once(self, name: str) -> DataFrame:
        """Repeated ids hold equal content, so any of their rows is the record; written once a session for the files as they are."""
        raw = self.raw(name)
        held = self.spark.sparkContext.__dict__.setdefault("_quillmill_once", {})
        key = tuple(sorted(raw.inputFiles()))
        if key not in held or not still_there(held[key]):
            held[key] = cut_lineage(raw.dropDuplicates(["id"]))
        return held[key]

    @property
    def project(self) -> DataFrame:
        return self.raw("project")

    @property
    def chapter(self) -> DataFrame:
        return self.raw("chapter")

    @property
    def segment(self) -> DataFrame:
        return self._once("segment")

    @property
    def glossary(self) -> DataFrame:
        return self._once("glossary_entry")

    @property
    def call(self) -> DataFrame:
        return self._once("llm_call")

    @property
    def trace(self) -> DataFrame:
        return self._once("translator_trace")

    @property
    def options(self) -> DataFrame:
        return self.raw("intake_options")

    @property
    def event(self) -> DataFrame:
        """Append-only log: the stream table, its users as projects."""
        e = self.raw("events")
        return e.select(
            F.col("event_id").alias("id"), F.col("user_id").cast("string").alias("project_id"),
            F.unix_seconds(F.col("ts").cast("timestamp")).alias("ts"), F.col("event_type").alias("kind"), F.col("props").alias("payload"), "value",
        )

    @property
    def alias(self) -> DataFrame:
        """Aliases of both sides: hyphenated spellings of names with a blank, and notes of the curators."""
        g = self.glossary
        side = lambda s, c: g.where(F.col(c).contains(" ")).select(F.col("id").alias("entry_id"), F.lit(s).alias("side"), F.regexp_replace(c, " ", "-").alias("text"))
        return side("source", "source_term").unionByName(side("target", "target_term"))

    @property
    def documents(self) -> DataFrame:
        return self.raw("documents")


CTES = {
    "seg": "SELECT DISTINCT ON (id) * FROM segment ORDER BY id, loaded_at DESC",
    "gloss": "SELECT DISTINCT ON (id) * FROM glossary_entry ORDER BY id, loaded_at DESC",
    "calls": "SELECT DISTINCT ON (id) * FROM llm_call ORDER BY id, loaded_at DESC",
    "traces": "SELECT DISTINCT ON (id) * FROM translator_trace ORDER BY id, loaded_at DESC",
    "event": "SELECT event_id AS id, CAST(user_id AS VARCHAR) AS project_id, CAST(floor(epoch(ts)) AS BIGINT) AS ts, event_type AS kind, props AS payload, value FROM events",
    "alias": """SELECT id AS entry_id, 'source' AS side, replace(source_term, ' ', '-') AS text FROM gloss WHERE contains(source_term, ' ')
                UNION ALL SELECT id, 'target', replace(target_term, ' ', '-') FROM gloss WHERE contains(target_term, ' ')""",
    "book": "SELECT s.*, c.spine_idx FROM seg s JOIN chapter c ON c.id = s.chapter_id",
}
_NEEDS = {"alias": ("gloss",), "book": ("seg",)}


def sql(names: str, body: str) -> str:
    """`body` after the named views."""
    order: list[str] = []
    for n in names.split():
        for x in (*_NEEDS.get(n, ()), n):
            if x not in order:
                order.append(x)
    head = ", ".join(f"{n} AS ({CTES[n]})" for n in order)
    return f"WITH RECURSIVE {head} {body}" if body.lstrip().startswith(",") else f"WITH {head} {body}"
