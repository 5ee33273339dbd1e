"""Queries for reads, joins, sorts and set operations (F, J, O, U)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from quillmill.operators import reads, rollups, setops
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql

NOW = 1_706_000_000  # a fixed "now" inside the log


@query("f01_projects_newest_first", "SELECT id, name, kind, created_at FROM project WHERE kind = 'book' ORDER BY created_at DESC, id")
def f01(t: Tables) -> DataFrame:
    books = t.project.where("kind = 'book'")
    return books.select("id", "name", "kind", "created_at").orderBy(F.desc("created_at"), "id")


@query("f02_chapters_in_spine_order", "SELECT id, project_id, spine_idx, href, title, CAST(row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, id) AS INTEGER) AS position FROM chapter")
def f02(t: Tables) -> DataFrame:
    return reads.chapter_range(t.chapter, "*").select("id", "project_id", "spine_idx", "href", "title", "position")


@query("f03_segments_of_chapter", sql("seg", "SELECT id, chapter_id, idx, source_hash, status FROM seg"))
def f03(t: Tables) -> DataFrame:
    return t.segment.select("id", "chapter_id", "idx", "source_hash", "status").orderBy("chapter_id", "idx", "id")


@query("f04_segment_by_id", sql("seg", "SELECT id, project_id, idx, source_text, target_text, status FROM seg WHERE id = (SELECT min(id) FROM segment)"))
def f04(t: Tables) -> DataFrame:
    first = t.raw("segment").agg(F.min("id").alias("id"))
    return t.segment.join(first, "id", "left_semi").select("id", "project_id", "idx", "source_text", "target_text", "status")


@query("f05_segments_by_status", sql("book", "SELECT id, project_id, chapter_id, spine_idx, idx FROM book WHERE status = 'approved'"))
def f05(t: Tables) -> DataFrame:
    return reads.by_status(t.segment, t.chapter, "approved").select("id", "project_id", "chapter_id", "spine_idx", "idx").orderBy("project_id", "spine_idx", "idx", "id")


@query("f06_o01_book_order", sql("book", "SELECT id, project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, idx, id) AS INTEGER) AS position FROM book"))
def f06(t: Tables) -> DataFrame:
    return reads.book_positions(t.segment.select("id", "project_id", "chapter_id", "idx"), t.chapter).select("id", "project_id", "position")


@query("f07_worklists", sql("book", "SELECT status, id, project_id, spine_idx, idx FROM book WHERE status IN ('pending', 'flagged')"))
def f07(t: Tables) -> DataFrame:
    return reads.by_status(t.segment, t.chapter, "pending").unionByName(reads.by_status(t.segment, t.chapter, "flagged")).select("status", "id", "project_id", "spine_idx", "idx")


_ALIASES = """
    SELECT g.id, g.project_id, g.source_term, g.target_term, g.status,
           coalesce(list_sort(list(a.text) FILTER (a.side = 'source')), []) AS source_aliases,
           coalesce(list_sort(list(a.text) FILTER (a.side = 'target')), []) AS target_aliases
    FROM gloss g LEFT JOIN alias a ON a.entry_id = g.id {where} GROUP BY ALL
"""


@query("f08_j04_entries_with_aliases", sql("gloss alias", _ALIASES.format(where="")))
def f08(t: Tables) -> DataFrame:
    return reads.with_aliases(t.glossary, t.alias).select("id", "project_id", "source_term", "target_term", "status", "source_aliases", "target_aliases")


@query("f09_entry_by_id", sql("gloss alias", _ALIASES.format(where="WHERE g.id = (SELECT max(id) FROM glossary_entry)")))
def f09(t: Tables) -> DataFrame:
    one = t.raw("glossary_entry").agg(F.max("id").alias("id"))
    return reads.with_aliases(t.glossary.join(one, "id", "left_semi"), t.alias).select("id", "project_id", "source_term", "target_term", "status", "source_aliases", "target_aliases")


@query("f10_first_entry_by_term", sql("gloss", "SELECT DISTINCT ON (project_id, source_term, type) project_id, source_term, type, id FROM gloss WHERE source_term IS NOT NULL ORDER BY project_id, source_term, type, created_at, id"))
def f10(t: Tables) -> DataFrame:
    known = t.glossary.where("source_term IS NOT NULL")
    return reads.first_per(known, ["project_id", "source_term", "type"], F.col("created_at"), F.col("id")).select("project_id", "source_term", "type", "id")


@query("f11_aliases_in_order", sql("alias", "SELECT entry_id, side, text, CAST(row_number() OVER (PARTITION BY entry_id ORDER BY side, text) AS INTEGER) AS position FROM alias"))
def f11(t: Tables) -> DataFrame:
    return t.alias.withColumn("position", F.row_number().over(W.partitionBy("entry_id").orderBy("side", "text")))


@query("f14_q01_events_decoded", sql("event", "SELECT id, project_id, ts, kind, CAST(json_extract_string(payload, '$.k') AS INTEGER) AS k FROM event"))
def f14(t: Tables) -> DataFrame:
    return t.event.select("id", "project_id", "ts", "kind", F.from_json("payload", "k int")["k"].alias("k"))


@query("f15_o04_recent_calls", sql("calls", "SELECT id, project_id, model, created_at FROM calls ORDER BY created_at DESC, id DESC LIMIT 50"))
def f15(t: Tables) -> DataFrame:
    return t.call.select("id", "project_id", "model", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(50)


@query("f20_overrides", sql("event", "SELECT id, coalesce(json_extract_string(payload, '$.k'), '') AS k FROM event"))
def f20(t: Tables) -> DataFrame:
    return t.event.select("id", F.coalesce(reads.overrides(F.col("payload"))["k"], F.lit("")).alias("k"))


@query("f21_locked_entries", sql("gloss", "SELECT id, project_id, source_term, target_term FROM gloss WHERE status = 'locked'"))
def f21(t: Tables) -> DataFrame:
    return t.glossary.where("status = 'locked'").select("id", "project_id", "source_term", "target_term")


@query("f23_log_filter", sql("event", f"SELECT id, kind, ts FROM event WHERE ts >= {NOW} - 86400 AND contains(lower(concat_ws(' ', kind, payload)), 'cl')"))
def f23(t: Tables) -> DataFrame:
    return reads.log_filter(t.event, NOW, "24h", "CL").select("id", "kind", "ts")


@query("f24_log_today", sql("event", f"SELECT id, kind, ts FROM event WHERE ts >= {NOW} - {NOW} % 86400 AND starts_with(kind, 'p')"))
def f24(t: Tables) -> DataFrame:
    return reads.log_filter(t.event, NOW, "today").where(F.col("kind").startswith("p")).select("id", "kind", "ts")


LOGS_SQL = "log AS (SELECT id, project_id, created_at AS ts, CASE WHEN prompt_tokens IS NULL THEN 'ERROR' WHEN cache_hit THEN 'DEBUG' ELSE 'INFO' END AS level, 'llm.' || model AS logger, upper(purpose) || ' of ' || coalesce(segment_id, 'none') AS message FROM calls)"


def _logs(t: Tables) -> DataFrame:
    """The ledger as log records of the model clients."""
    level = F.when(F.col("prompt_tokens").isNull(), "ERROR").when(F.col("cache_hit"), "DEBUG").otherwise("INFO")
    return t.call.select("id", "project_id", F.col("created_at").alias("ts"), level.alias("level"), F.concat(F.lit("llm."), "model").alias("logger"), F.concat(F.upper("purpose"), F.lit(" of "), F.coalesce("segment_id", F.lit("none"))).alias("message"))


@query("f24_log_records", sql("calls", f", {LOGS_SQL} SELECT id, level, logger FROM log WHERE level IN ('INFO', 'ERROR') AND starts_with(logger, 'llm.a') AND contains(lower(message), 'translate of')"))
def f24r(t: Tables) -> DataFrame:
    return reads.log_records(_logs(t), "INFO", "llm.a", "Translate OF").select("id", "level", "logger")


@query("f25_chapter_range", "SELECT id, position FROM (SELECT id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, id) AS INTEGER) AS position FROM chapter) WHERE position BETWEEN 2 AND 4")
def f25(t: Tables) -> DataFrame:
    return reads.chapter_range(t.chapter, "2-4").select("id", "position")


@query("f31_navigation_queue", sql("seg", r"""
    , live AS (SELECT id, chapter_id FROM seg WHERE regexp_matches(regexp_replace(source_text, '\[\[/?T\d+\]\]', '', 'g'), '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]'))
    SELECT c.id AS chapter_id, c.project_id, count(l.id) AS segments FROM chapter c JOIN live l ON l.chapter_id = c.id GROUP BY ALL"""))
def f31(t: Tables) -> DataFrame:
    from quillmill.functions import text

    live = t.segment.where(text.has_translatable_text(F.col("source_text"))).groupBy("chapter_id").agg(F.count("*").alias("segments"))
    return t.chapter.select(F.col("id").alias("chapter_id"), "project_id").join(live, "chapter_id")


@query("j01_segments_per_project", sql("seg", "SELECT c.project_id, count(*) AS segments FROM seg s JOIN chapter c ON c.id = s.chapter_id GROUP BY 1"))
def j01(t: Tables) -> DataFrame:
    return reads.book_order(t.segment.select("id", "chapter_id"), t.chapter).join(t.chapter.select(F.col("id").alias("chapter_id"), "project_id"), "chapter_id").groupBy("project_id").agg(F.count("*").alias("segments"))


@query("j09_rehost_by_hash", sql("seg", """
    , first AS (SELECT DISTINCT ON (source_hash) source_hash, id AS stored_id FROM seg WHERE status <> 'pending' ORDER BY source_hash, idx, id)
    SELECT s.id, s.source_hash, f.stored_id FROM seg s LEFT JOIN first f USING (source_hash) WHERE s.status = 'pending'"""))
def j09(t: Tables) -> DataFrame:
    s = t.segment.select("id", "idx", "source_hash", "status")
    return reads.rehost_by_hash(s.where("status = 'pending'"), s.where("status <> 'pending'")).select("id", "source_hash", "stored_id")


@query("j10_title_backfill", """
    WITH t AS (SELECT href, min(title) AS new_title FROM chapter WHERE title IS NOT NULL GROUP BY href)
    SELECT c.id, c.href, coalesce(c.title, t.new_title) AS title FROM chapter c LEFT JOIN t USING (href)""")
def j10(t: Tables) -> DataFrame:
    return reads.backfill(t.chapter, t.chapter, "href", "title").select("id", "href", "title")


_PAIR = """
    , a AS (SELECT source_term, type, min(target_term) AS target_term, min(gender) AS gender FROM gloss WHERE source_term IS NOT NULL AND status = 'proposed' GROUP BY 1, 2),
    b AS (SELECT source_term, type, min(target_term) AS target_term, min(gender) AS gender FROM gloss WHERE source_term IS NOT NULL AND status <> 'proposed' GROUP BY 1, 2)
"""


@query("j12_import_conflicts", sql("gloss", _PAIR + """
    SELECT a.source_term, a.type, a.target_term, b.target_term AS existing_target_term,
           CASE WHEN b.source_term IS NULL THEN 'new' WHEN a.target_term IS NOT DISTINCT FROM b.target_term AND a.gender IS NOT DISTINCT FROM b.gender THEN 'same' ELSE 'conflict' END AS action
    FROM a LEFT JOIN b ON a.source_term = b.source_term AND a.type = b.type"""))
def j12(t: Tables) -> DataFrame:
    g = t.glossary.where("source_term IS NOT NULL")
    side = lambda df: df.groupBy("source_term", "type").agg(F.min("target_term").alias("target_term"), F.min("gender").alias("gender"))
    out = reads.conflicts(side(g.where("status = 'proposed'")), side(g.where("status <> 'proposed'")), ["source_term", "type"], ["target_term", "gender"])
    return out.select("source_term", "type", "target_term", "existing_target_term", "action")


@query("j14_w13_latest_cached_call", sql("calls", """
    , latest AS (SELECT DISTINCT ON (project_id, cache_key) project_id, cache_key, id AS cached_id, created_at AS cached_at FROM calls WHERE cache_key IS NOT NULL AND NOT cache_hit ORDER BY project_id, cache_key, created_at DESC, id DESC)
    SELECT c.id, c.project_id, l.cached_id, l.cached_at FROM calls c LEFT JOIN latest l ON l.project_id = c.project_id AND l.cache_key = c.cache_key"""))
def j14(t: Tables) -> DataFrame:
    calls = t.call.select("id", "project_id", "cache_key", "cache_hit", "created_at")
    # a max over a struct keeps a map-side combine, where a window would sort every row
    latest = (
        calls.where("cache_key IS NOT NULL AND NOT cache_hit").groupBy("project_id", "cache_key")
        .agg(F.max(F.struct("created_at", "id")).alias("m")).select("project_id", "cache_key", F.col("m.id").alias("cached_id"), F.col("m.created_at").alias("cached_at"))
    )
    return calls.join(latest, ["project_id", "cache_key"], "left").select("id", "project_id", "cached_id", "cached_at")


@query("o03_recent_alerts", sql("event", "SELECT id, kind, ts FROM event WHERE kind IN ('error', 'purchase') ORDER BY id DESC LIMIT 20"))
def o03(t: Tables) -> DataFrame:
    return t.event.where(F.col("kind").isin("error", "purchase")).select("id", "kind", "ts").orderBy(F.desc("id")).limit(20)


@query("o05_first_segments", sql("book", """
    SELECT id, project_id, position FROM (SELECT id, project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, idx, id) AS INTEGER) AS position FROM book) WHERE position <= 30"""))
def o05(t: Tables) -> DataFrame:
    return reads.book_positions(t.segment.select("id", "project_id", "chapter_id", "idx"), t.chapter).where("position <= 30").select("id", "project_id", "position")


@query("o06_o07_g13_constraints", sql("gloss", """
    SELECT project_id, id, source_known AND source_term IS NOT NULL AS with_source,
           CAST(row_number() OVER (PARTITION BY project_id, source_known AND source_term IS NOT NULL ORDER BY CASE WHEN status = 'locked' THEN 0 ELSE 1 END, source_term NULLS FIRST, target_term, id) AS INTEGER) AS position
    FROM gloss WHERE status <> 'proposed'"""))
def o06(t: Tables) -> DataFrame:
    known = F.col("source_known") & F.col("source_term").isNotNull()
    order = W.partitionBy("project_id", "with_source").orderBy(F.when(F.col("status") == "locked", 0).otherwise(1), F.col("source_term").asc_nulls_first(), "target_term", "id")
    return t.glossary.where("status <> 'proposed'").withColumn("with_source", known).select("project_id", "id", "with_source", F.row_number().over(order).alias("position"))


@query("o10_s20_recents", "SELECT id, name, created_at FROM project ORDER BY created_at DESC, id LIMIT 25")
def o10(t: Tables) -> DataFrame:
    return setops.newest(t.project, "id", "created_at", 25).select("id", "name", "created_at")


@query("o11_a13_dashboard", sql("gloss", """
    SELECT 'status' AS section, status AS key, count(*) AS entries FROM gloss GROUP BY ALL UNION ALL SELECT 'target only', 'all', count(*) FROM gloss WHERE source_term IS NULL HAVING count(*) > 0
    UNION ALL SELECT * FROM (SELECT 'type', type, count(*) AS n FROM gloss GROUP BY ALL ORDER BY n DESC, type LIMIT 5)"""))
def o11(t: Tables) -> DataFrame:
    return rollups.dashboard(t.glossary)


@query("o12_series_order", "SELECT id, name, created_at FROM project ORDER BY created_at DESC, lower(name), id")
def o12(t: Tables) -> DataFrame:
    return t.project.select("id", "name", "created_at").orderBy(F.desc("created_at"), F.lower("name"), "id")


@query("u01_inbox", sql("seg gloss event", """
    SELECT 'flagged' AS kind, id, project_id FROM seg WHERE status = 'flagged'
    UNION ALL SELECT 'proposed', id, project_id FROM gloss WHERE status = 'proposed'
    UNION ALL SELECT 'alert', CAST(id AS VARCHAR), project_id FROM event WHERE kind IN ('error', 'purchase')"""))
def u01(t: Tables) -> DataFrame:
    return setops.inbox(t.segment, t.glossary, t.event.where(F.col("kind").isin("error", "purchase")))


@query("u02_o13_timeline", sql("event calls", f"""
    , c AS (SELECT id, project_id, created_at FROM calls ORDER BY created_at DESC, id DESC LIMIT 500), {LOGS_SQL}
    SELECT 'event' AS origin, CAST(id AS VARCHAR) AS id, project_id, ts FROM event UNION ALL SELECT 'call', id, project_id, created_at FROM c UNION ALL SELECT 'log', id, project_id, ts FROM log WHERE level = 'ERROR'"""))
def u02(t: Tables) -> DataFrame:
    """Events, warnings of the log, and the last 500 calls in one line of time."""
    calls = t.call.select("id", "project_id", "created_at").orderBy(F.desc("created_at"), F.desc("id")).limit(500)
    logs = reads.log_records(_logs(t), "WARNING")
    return t.event.select(F.lit("event").alias("origin"), F.col("id").cast("string").alias("id"), "project_id", "ts").unionByName(
        calls.select(F.lit("call").alias("origin"), "id", "project_id", F.col("created_at").alias("ts"))).unionByName(logs.select(F.lit("log").alias("origin"), "id", "project_id", "ts"))


@query("u03_attached_view", sql("gloss", """
    , own AS (SELECT * FROM gloss WHERE project_id = (SELECT min(id) FROM project)),
    att AS (SELECT g.*, p.created_at AS priority FROM gloss g JOIN project p ON p.id = g.project_id WHERE g.project_id <> (SELECT min(id) FROM project)),
    fresh AS (SELECT a.* FROM att a WHERE NOT EXISTS (SELECT 1 FROM own o WHERE coalesce(o.source_term, '') = coalesce(a.source_term, '') AND o.target_term = a.target_term AND o.type = a.type)),
    once AS (SELECT DISTINCT ON (coalesce(source_term, ''), target_term, type) * FROM fresh ORDER BY coalesce(source_term, ''), target_term, type, priority, project_id, id)
    SELECT id, 'own' AS origin FROM own UNION ALL SELECT id, 'attached' FROM once"""))
def u03(t: Tables) -> DataFrame:
    first = t.project.agg(F.min("id").alias("project_id"))
    g = t.glossary
    attached = g.join(first, "project_id", "left_anti").join(t.project.select(F.col("id").alias("project_id"), F.col("created_at").alias("priority")), "project_id")
    return setops.attached_view(g.join(first, "project_id", "left_semi"), attached, F.col("priority"), F.col("project_id"), F.col("id")).select("id", "origin")


@query("u05_first_seen_models", sql("calls", "SELECT project_id, list(model ORDER BY first, model) AS models FROM (SELECT project_id, model, min(created_at) AS first FROM calls GROUP BY 1, 2) GROUP BY 1"))
def u05(t: Tables) -> DataFrame:
    return setops.first_seen(t.call, "project_id", "model", "created_at").withColumnRenamed("values", "models")


@query("u06_new_links", sql("traces", """
    SELECT DISTINCT u.project_id, u.model, u.e AS entry_id FROM (SELECT project_id, model, unnest(used_entries) AS e FROM traces WHERE model = 'aurora-small') u
    WHERE NOT EXISTS (SELECT 1 FROM traces x WHERE x.model = 'aurora-large' AND x.project_id = u.project_id AND list_contains(x.used_entries, u.e))"""))
def u06(t: Tables) -> DataFrame:
    links = t.trace.select("project_id", "model", F.explode("used_entries").alias("entry_id")).distinct()
    held = links.where("model = 'aurora-large'").select("project_id", "entry_id")
    return links.where("model = 'aurora-small'").join(held, ["project_id", "entry_id"], "left_anti").select("project_id", "model", "entry_id")


@query("u07_u08_alias_sets", sql("alias", """
    , s AS (SELECT entry_id, list_sort(list(text) FILTER (side = 'source')) AS a, list_sort(list(text) FILTER (side = 'target')) AS b FROM alias GROUP BY 1)
    SELECT entry_id, list_sort(list_distinct(list_concat(coalesce(a, []), coalesce(b, [])))) AS both_sides, coalesce(a, []) = coalesce(b, []) AS equal FROM s"""))
def u07(t: Tables) -> DataFrame:
    pick = lambda s: F.array_sort(F.collect_list(F.when(F.col("side") == s, F.col("text"))))
    s = t.alias.groupBy("entry_id").agg(pick("source").alias("a"), pick("target").alias("b"))
    return s.select("entry_id", F.array_sort(F.array_union("a", "b")).alias("both_sides"), (F.array_sort("a") == F.array_sort("b")).alias("equal"))
