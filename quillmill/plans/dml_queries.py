"""Queries for state changes (Z)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.operators import dml, matching
from quillmill.plans.match_queries import _CHANGED, changed
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql
from quillmill.sources import xhtml

NOW = 1_740_000_000


def _changes(t: Tables) -> DataFrame:
    g = t.glossary.where("status = 'proposed'")
    return g.select("id", F.when(F.col("gender") == "feminine", F.concat("target_term", F.lit(" (f)"))).alias("target_term"), F.lit("confirmed").alias("status"), F.lit(None).cast("string").alias("notes"))


_NEW = "CASE WHEN status = 'proposed' AND gender = 'feminine' THEN target_term || ' (f)' ELSE target_term END"


@query("z02_updated_entries", sql("gloss", f"SELECT id, {_NEW} AS target_term, CASE WHEN status = 'proposed' THEN 'confirmed' ELSE status END AS status, CASE WHEN status = 'proposed' THEN {NOW} ELSE updated_at END AS updated_at FROM gloss"))
def z02(t: Tables) -> DataFrame:
    return dml.update_entries(t.glossary, _changes(t), NOW)[0].select("id", "target_term", "status", "updated_at")


@query("z02_f12_revisions", sql("gloss", f"SELECT id AS entry_id, target_term AS prev_target_term, {_NEW} AS new_target_term, CAST({NOW} AS BIGINT) AS created_at FROM gloss WHERE status = 'proposed'"))
def z02r(t: Tables) -> DataFrame:
    return dml.update_entries(t.glossary, _changes(t), NOW)[1]


@query("z03_deleted_aliases", sql("alias", "SELECT a.* FROM alias a JOIN gloss g ON g.id = a.entry_id WHERE g.type <> 'term'"))
def z03(t: Tables) -> DataFrame:
    return dml.delete_entries(t.glossary, t.glossary.where("type = 'term'"), t.alias)[1]


@query("z04_z05_replaced_aliases", sql("alias", """
    , fresh AS (SELECT DISTINCT id AS entry_id, 'source' AS side, upper(type) AS text FROM gloss WHERE status = 'locked')
    SELECT entry_id, side, text FROM alias WHERE (entry_id, side) NOT IN (SELECT entry_id, side FROM fresh) UNION ALL SELECT * FROM fresh"""))
def z04(t: Tables) -> DataFrame:
    fresh = t.glossary.where("status = 'locked'").select(F.col("id").alias("entry_id"), F.lit("source").alias("side"), F.upper("type").alias("text"))
    return dml.replace_by(t.alias, fresh, ["entry_id", "side"], ["entry_id", "side", "text"])


@query("z07_target_only", sql("gloss", """
    SELECT p.id, p.project_id, p.target_term, p.type FROM gloss p WHERE p.source_term IS NULL AND NOT EXISTS (SELECT 1 FROM gloss g WHERE g.source_term IS NOT NULL AND g.project_id = p.project_id AND g.target_term = p.target_term AND g.type = p.type)"""))
def z07(t: Tables) -> DataFrame:
    g = t.glossary
    return dml.fold_target_only(g.where("source_term IS NOT NULL"), g.where("source_term IS NULL")).select("id", "project_id", "target_term", "type")


@query("z08_z09_a23_import_summary", sql("gloss", """
    , held AS (SELECT DISTINCT project_id, source_term, type FROM gloss WHERE status <> 'proposed' AND source_term IS NOT NULL)
    SELECT CASE WHEN h.project_id IS NULL THEN 'created' ELSE 'updated' END AS action, count(*) AS entries FROM gloss g LEFT JOIN held h ON h.project_id = g.project_id AND h.source_term = g.source_term AND h.type = g.type WHERE g.status = 'proposed' GROUP BY 1"""))
def z08(t: Tables) -> DataFrame:
    g = t.glossary
    return dml.import_entries(g.where("status <> 'proposed'"), g.where("status = 'proposed'"), overwrite=True).groupBy("action").agg(F.count("*").alias("entries"))


@query("z12_cascade_apply", sql("seg gloss", _CHANGED + """
    SELECT s.id, CASE WHEN h.segment_id IS NULL THEN s.target_text END AS target_text, CASE WHEN h.segment_id IS NULL THEN s.status ELSE 'pending' END AS status
    FROM seg s LEFT JOIN (SELECT DISTINCT segment_id FROM aff) h ON h.segment_id = s.id"""))
def z12(t: Tables) -> DataFrame:
    return dml.cascade(t.segment, matching.affected(t.segment, changed(t)), NOW)[0].select("id", "target_text", "status")


@query("z12_cascade_events", sql("seg gloss", _CHANGED + f"""
    , h AS (SELECT DISTINCT s.id, s.project_id FROM aff JOIN seg s ON s.id = aff.segment_id)
    SELECT project_id, CAST({NOW} AS BIGINT) AS ts, 'segment.reset' AS kind, '{{"segment_id":"' || id || '"}}' AS payload FROM h
    UNION ALL SELECT project_id, {NOW}, 'glossary.cascaded', '{{"n":' || count(*) || '}}' FROM h GROUP BY project_id"""))
def z12e(t: Tables) -> DataFrame:
    return dml.cascade(t.segment, matching.affected(t.segment, changed(t)), NOW)[1]


@query("z13_repair", sql("seg", """
    , st AS (SELECT * FROM seg WHERE status <> 'pending'), fr AS (SELECT * FROM seg WHERE status = 'pending'),
    f AS (SELECT DISTINCT ON (source_hash) source_hash, id AS stored_id FROM st ORDER BY source_hash, idx, id),
    m AS (SELECT fr.*, f.stored_id FROM fr LEFT JOIN f USING (source_hash)), top AS (SELECT chapter_id, max(idx) AS top FROM st GROUP BY 1)
    SELECT m.id, m.stored_id, CASE WHEN stored_id IS NULL THEN CAST(coalesce(top, -1) + row_number() OVER (PARTITION BY m.chapter_id, stored_id IS NULL ORDER BY idx, id) AS INTEGER) END AS new_idx FROM m LEFT JOIN top ON top.chapter_id = m.chapter_id"""))
def z13(t: Tables) -> DataFrame:
    s = t.segment.select("id", "chapter_id", "idx", "source_hash", "status")
    return dml.repair(s.where("status <> 'pending'"), s.where("status = 'pending'")).select("id", "stored_id", "new_idx")


@query("z14_t09_expand_entities")
def z14(t: Tables) -> DataFrame:
    """Entity tokens of segments as text; their numbers close up."""
    from collections.abc import Iterator

    import pandas as pd

    from quillmill.sources import skeleton

    rows = t.segment.select("id", "source_text", "target_text", skeleton.decode(F.col("inline_skeleton"))["tokens"].alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = []
            for i, s, u, toks in zip(pdf["id"], pdf["source_text"], pdf["target_text"], pdf["tokens"]):
                a, b, left, did = xhtml.expand_entity_tokens(s, u, list(toks))
                out.append((i, a, b, len(left), did))
            yield pd.DataFrame(out, columns=["id", "source_text", "target_text", "tokens", "changed"])

    return rows.mapInPandas(run, "id string, source_text string, target_text string, tokens int, changed boolean")


@query("z20_approvable", sql("seg", "SELECT id, project_id FROM seg WHERE status = 'translated' AND target_text <> ''"))
def z20(t: Tables) -> DataFrame:
    """what an approval of all chapters would touch."""
    return t.segment.where("status = 'translated' AND target_text <> ''").select("id", "project_id")


@query("s21_s22_appended_events", sql("event seg", f"""
    SELECT project_id, ts, kind, payload FROM event UNION ALL
    SELECT project_id, CAST({NOW} AS BIGINT), 'segment.flagged', '{{"segment_id":"' || id || '","idx":' || idx || '}}' FROM seg WHERE status = 'flagged'"""))
def s21(t: Tables) -> DataFrame:
    flagged = t.segment.where("status = 'flagged'")
    return t.event.select("project_id", "ts", "kind", "payload").unionByName(dml.event(flagged, F.col("project_id"), NOW, "segment.flagged", F.struct(F.col("id").alias("segment_id"), "idx")))
