"""Queries for aggregates (A, S06)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.functions import text
from quillmill.operators import rollups
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql
from quillmill.sources import reports

_LEDGER = """count(*) AS calls, CAST(coalesce(sum(prompt_tokens), 0) AS BIGINT) AS prompt_tokens, CAST(coalesce(sum(completion_tokens), 0) AS BIGINT) AS completion_tokens,
    CAST(round(coalesce(sum(CAST(cost_usd AS DECIMAL(18,8))), 0), 4) AS DOUBLE) AS cost_usd, count_if(cache_hit) AS cache_hits"""
_RATIO = lambda a, b: f"CASE WHEN {b} = 0 THEN 0.0::DOUBLE ELSE round({a}::DOUBLE / {b}, 6) END"


@query("a05_spend_by_purpose", sql("calls", f"SELECT coalesce(purpose, '(unknown)') AS purpose, {_LEDGER} FROM calls GROUP BY 1"))
def a05p(t: Tables) -> DataFrame:
    return rollups.ledger_by(t.call, "purpose")


@query("a01_ledger_by_model", sql("calls", f"SELECT coalesce(model, '(unknown)') AS model, {_LEDGER} FROM calls GROUP BY 1"))
def a01(t: Tables) -> DataFrame:
    return rollups.ledger_by(t.call, "model")


@query("a02_status_histogram", sql("book", "SELECT project_id, status, count(*) AS segments FROM book GROUP BY 1, 2"))
def a02(t: Tables) -> DataFrame:
    from quillmill.operators import reads

    return reads.book_order(t.segment.select("id", "project_id", "chapter_id", "status"), t.chapter).groupBy("project_id", "status").agg(F.count("*").alias("segments"))


@query("a03_chapter_counts", "SELECT project_id, count(*) AS chapters FROM chapter GROUP BY 1")
def a03(t: Tables) -> DataFrame:
    return t.chapter.groupBy("project_id").agg(F.count("*").alias("chapters"))


@query("a04_a08_project_stats", sql("seg calls", f"""
    , s AS (SELECT project_id, count(*) AS segments, count_if(status <> 'pending') AS translated, count_if(status = 'approved') AS approved, count_if(status = 'flagged') AS flagged FROM seg GROUP BY 1),
    c AS (SELECT project_id, {_LEDGER} FROM calls GROUP BY 1), n AS (SELECT project_id, count(*) AS chapters FROM chapter GROUP BY 1),
    j AS (SELECT p.id AS project_id, coalesce(chapters, 0) AS chapters, coalesce(segments, 0) AS segments, coalesce(translated, 0) AS translated, coalesce(approved, 0) AS approved,
          coalesce(flagged, 0) AS flagged, coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) AS tokens, coalesce(cost_usd, 0) AS spend, coalesce(cache_hits, 0) AS hits, coalesce(calls, 0) AS calls
          FROM project p LEFT JOIN s ON s.project_id = p.id LEFT JOIN c ON c.project_id = p.id LEFT JOIN n ON n.project_id = p.id)
    SELECT project_id, chapters, segments, translated, approved, flagged, tokens, spend, {_RATIO('translated', 'segments')} AS progress, {_RATIO('hits', 'calls')} AS hit_rate, {_RATIO('flagged', 'translated')} AS failure_rate FROM j"""))
def a04(t: Tables) -> DataFrame:
    return rollups.project_stats(t.project, t.segment, t.call, t.chapter)


@query("a05_a06_activity", sql("calls", f"""
    , r AS (SELECT 'model' AS kind, coalesce(model, '(unknown)') AS key, {_LEDGER} FROM calls GROUP BY ALL UNION ALL SELECT 'purpose', coalesce(purpose, '(unknown)'), {_LEDGER} FROM calls GROUP BY ALL UNION ALL SELECT 'total', 'all', {_LEDGER} FROM calls)
    SELECT *, {_RATIO('cache_hits', 'calls')} AS hit_rate FROM r"""))
def a05(t: Tables) -> DataFrame:
    return rollups.activity(t.call)


@query("a07_w19_spend_shares", sql("calls", """
    , r AS (SELECT model, CAST(round(coalesce(sum(CAST(cost_usd AS DECIMAL(18,8))), 0), 4) AS DOUBLE) AS cost FROM calls GROUP BY 1)
    SELECT model, cost AS cost_usd, round(CASE WHEN sum(cost) OVER () = 0 THEN 0 ELSE 100 * cost / sum(cost) OVER () END, 3) AS percent FROM r"""))
def a07(t: Tables) -> DataFrame:
    return rollups.spend_shares(t.call, "model")


_SHAPES = rf"""
    , live AS (SELECT *, coalesce(regexp_matches(regexp_replace(source_text, '\[\[/?T\d+\]\]', '', 'g'), '[^\s\x{{0b}}\x{{1c}}-\x{{1f}}\x{{85}}\p{{Z}}]'), false) AS t FROM seg),
    b AS (SELECT chapter_id, count(*) AS segment_count, count_if(t) AS translatable, count_if(t AND status = 'approved') AS approved, count_if(t AND status IN ('translated', 'approved')) AS translated FROM live GROUP BY 1),
    shapes AS (SELECT c.id AS chapter_id, c.project_id, c.spine_idx, coalesce(segment_count, 0) AS segment_count, coalesce(translatable, 0) AS translatable, coalesce(approved, 0) AS approved, coalesce(translated, 0) AS translated,
          coalesce(translatable, 0) - coalesce(translated, 0) AS pending FROM chapter c LEFT JOIN b ON b.chapter_id = c.id)
"""


def _shapes(t: Tables) -> DataFrame:
    return rollups.chapter_shapes(t.chapter, t.segment, text.has_translatable_text(F.col("source_text")))


@query("a09_a26_a27_chapter_shapes", sql("seg", _SHAPES + f"SELECT *, {_RATIO('translated', 'translatable')} AS share FROM shapes"))
def a09(t: Tables) -> DataFrame:
    return _shapes(t)


@query("a10_shape_summary", sql("seg", _SHAPES + """
    SELECT project_id, greatest(count(*), CAST(max(spine_idx) + 1 AS BIGINT)) AS chapters, count(*) AS live_chapters, CAST(sum(translatable) AS BIGINT) AS translatable,
        first(chapter_id ORDER BY translatable DESC, spine_idx) AS longest, first(chapter_id ORDER BY translatable, spine_idx) AS shortest, round(avg(translatable), 4) AS mean, CAST(median(translatable) AS DOUBLE) AS median
    FROM shapes WHERE translatable > 0 GROUP BY 1"""))
def a10(t: Tables) -> DataFrame:
    return rollups.shape_summary(_shapes(t))


@query("a12_glossary_status", sql("gloss", "SELECT project_id, count_if(status = 'locked') AS locked, count_if(status = 'confirmed') AS confirmed, count_if(status = 'proposed') AS proposed, count_if(NOT source_known) AS target_only, count(*) AS total FROM gloss GROUP BY 1"))
def a12(t: Tables) -> DataFrame:
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    return t.glossary.groupBy("project_id").agg(n("locked"), n("confirmed"), n("proposed"), F.count_if(~F.col("source_known")).alias("target_only"), F.count("*").alias("total"))


@query("a15_event_kinds", sql("event", "SELECT kind, count(*) AS events, min(ts) AS first_ts, max(ts) AS last_ts FROM event GROUP BY 1"))
def a15(t: Tables) -> DataFrame:
    return t.event.groupBy("kind").agg(F.count("*").alias("events"), F.min("ts").alias("first_ts"), F.max("ts").alias("last_ts"))


@query("a16_batch_fold", sql("seg calls", """
    , o AS (SELECT c.*, prompt_tokens IS NULL AS failed, coalesce(s.status = 'flagged', false) AS flag FROM calls c LEFT JOIN seg s ON s.id = c.segment_id)
    SELECT project_id, count_if(failed) AS failed, count_if(NOT failed AND flag) AS flagged, count_if(NOT failed AND NOT flag AND cache_hit) AS cached, count_if(NOT failed AND NOT flag AND NOT cache_hit) AS translated,
           CAST(coalesce(sum(prompt_tokens + coalesce(completion_tokens, 0)) FILTER (NOT failed), 0) AS BIGINT) AS tokens, CAST(round(coalesce(sum(CAST(cost_usd AS DECIMAL(18,8))) FILTER (NOT failed), 0), 4) AS DOUBLE) AS cost FROM o GROUP BY 1"""))
def a16(t: Tables) -> DataFrame:
    """Failed before flagged before cached before translated; failed calls count no tokens and no cost."""
    return rollups.batch_fold(t.call.join(t.segment.select(F.col("id").alias("segment_id"), (F.col("status") == "flagged").alias("flagged")), "segment_id", "left"), F.col("prompt_tokens").isNull())


@query("a17_a18_first_non_empty", sql("gloss", """
    SELECT project_id, first(gender ORDER BY o) FILTER (trim(gender) <> '') AS gender, first(notes ORDER BY o) FILTER (trim(notes) <> '') AS notes FROM (SELECT *, CAST(created_at AS VARCHAR) || id AS o FROM gloss) GROUP BY 1"""))
def a17(t: Tables) -> DataFrame:
    return rollups.first_non_empty(t.glossary.withColumn("o", F.concat(F.col("created_at").cast("string"), "id")), "project_id", "o", "gender", "notes")


@query("a19_e05_duplicate_terms", sql("gloss", """
    , r AS (SELECT project_id, source_term, id, first_value(id) OVER (PARTITION BY project_id, source_term ORDER BY CASE status WHEN 'locked' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'proposed' THEN 2 ELSE 99 END, type = 'term', created_at, id) AS winner,
          count(*) OVER (PARTITION BY project_id, source_term) AS members FROM gloss WHERE source_term IS NOT NULL)
    SELECT * FROM r WHERE members > 1"""))
def a19(t: Tables) -> DataFrame:
    return rollups.duplicate_groups(t.glossary)


@query("s06_a24_sequence_offsets", "SELECT id, project_id, CAST(max(spine_idx) OVER (PARTITION BY project_id) + row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, id) AS INTEGER) AS new_spine_idx FROM chapter")
def s06(t: Tables) -> DataFrame:
    c = t.chapter
    return rollups.next_numbers(c, c.select("id", "project_id", "spine_idx"), "project_id", "spine_idx", F.col("spine_idx"), F.col("id")).select("id", "project_id", "new_spine_idx")


_REPORT = """
    WITH lines AS (SELECT project_id, CASE spine_idx % 5 WHEN 0 THEN 'ERROR' WHEN 1 THEN 'warning' WHEN 2 THEN 'USAGE' WHEN 3 THEN 'odd' ELSE 'FATAL' END || '(RSC-00' || (spine_idx % 9) || '): ' || href || '(' || (spine_idx + 1) || ',7): ' || coalesce(title, 'no title') AS line FROM chapter),
    p AS (SELECT project_id, regexp_extract(line, '^([A-Za-z]+)\\(([^)]*)\\): (.*?)\\((-?[0-9]+),(-?[0-9]+)\\): (.*)$', ['level', 'code', 'path', 'row', 'col', 'message']) AS x FROM lines),
    m AS (SELECT project_id, CASE WHEN upper(x.level) IN ('FATAL', 'ERROR', 'WARNING', 'USAGE', 'INFO') THEN upper(x.level) ELSE 'INFO' END AS level, x.code AS code, x.path AS path, CAST(x.row AS INTEGER) AS line, x.message AS message FROM p)
"""


def _report_lines(t: Tables) -> DataFrame:
    k = F.col("spine_idx") % 5
    level = F.when(k == 0, "ERROR").when(k == 1, "warning").when(k == 2, "USAGE").when(k == 3, "odd").otherwise("FATAL")
    n = lambda c: c.cast("string")
    return t.chapter.select("project_id", F.concat(level, F.lit("(RSC-00"), n(F.col("spine_idx") % 9), F.lit("): "), "href", F.lit("("), n(F.col("spine_idx") + 1), F.lit(",7): "), F.coalesce("title", F.lit("no title"))).alias("line"))


@query("s24_report_messages", _REPORT + "SELECT * FROM m")
def s24(t: Tables) -> DataFrame:
    return reports.messages(_report_lines(t), "project_id")


@query("a21_s24_report_levels", _REPORT + "SELECT project_id, count_if(level IN ('FATAL', 'ERROR')) AS errors, count_if(level = 'WARNING') AS warnings, CASE WHEN bool_or(level IN ('FATAL', 'ERROR', 'WARNING')) THEN 'failed' ELSE 'passed' END AS status FROM m GROUP BY 1")
def a21(t: Tables) -> DataFrame:
    return reports.summary(reports.messages(_report_lines(t), "project_id"), "project_id")
