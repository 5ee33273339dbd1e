"""Queries for the call pipeline (L, G17)."""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, functions as F

from quillmill.functions import text
from quillmill.operators import calls, pipeline
from quillmill.plans.dml_queries import NOW
from quillmill.plans.match_queries import _TERMS, _hit
from quillmill.plans.registry import query
from quillmill.plans.scalar_queries import _FLAT, _PH, _SP, _STRIP
from quillmill.plans.views import Tables, sql

_LIVE = r"""status = 'pending' AND regexp_matches(regexp_replace(regexp_replace(source_text, '\[\[/?T\d+\]\]', '', 'g'), '[\x{200b}\x{200c}\x{200d}\x{2060}\x{feff}]', '', 'g'), '[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]')"""
_KEY = "substring(sha256('m:' || sha256(project_id) || ':' || sha256(source_text) || ':' || repeat('0', 32)), 1, 32)"


@query("l05_worklist", sql("seg", f"SELECT id, project_id, {_KEY} AS cache_key FROM seg WHERE {_LIVE}"))
def l05(t: Tables) -> DataFrame:
    return calls.worklist(t.segment, "m", F.lit("0" * 32)).select("id", "project_id", "cache_key")


@query("l06_cache_misses", sql("seg", f"SELECT DISTINCT project_id, {_KEY} AS cache_key FROM seg WHERE {_LIVE} AND ({_KEY}) NOT IN (SELECT {_KEY} FROM seg WHERE status <> 'pending')"))
def l06(t: Tables) -> DataFrame:
    from quillmill.functions import terms

    held = t.segment.where("status <> 'pending'").select("project_id", terms.call_key(F.lit("m"), F.col("project_id"), F.col("source_text"), F.lit("0" * 32)).alias("cache_key"))
    return calls.misses(calls.worklist(t.segment, "m", F.lit("0" * 32)), held).select("project_id", "cache_key")


class ScriptedGroup:
    """A group of a multiple of five items fails, and items whose length is a multiple of seven stay without an answer."""

    def __call__(self, prompt: str) -> str:
        items = json.loads(prompt)["items"]
        if len(items) % 5 == 0:
            raise RuntimeError("no answer")
        return json.dumps({"items": [{"id": x["id"], "target": f"<{x['text']}>"} for x in items if len(x["text"]) % 7]}, ensure_ascii=False)


class ScriptedSingle:
    """A text whose length is a multiple of eleven fails; one of a multiple of thirteen loses its marks."""

    def __call__(self, prompt: str) -> str:
        said = json.loads(prompt)["user"]
        if len(said) % 11 == 0:
            raise RuntimeError("no answer")
        if len(said) % 13 == 0:
            said = re.sub(_PH, "", said)
        return json.dumps({"target": f"<{said}>"}, ensure_ascii=False)


_RUN = _TERMS + rf"""
    , live AS (SELECT s.*, p.target_lang, len(regexp_extract_all(source_text, '{_PH}')) AS marks FROM seg s JOIN project p ON p.id = s.project_id WHERE {_LIVE}),
    rep AS (SELECT DISTINCT ON (project_id, source_text) id, project_id, chapter_id, idx, source_text, marks FROM live WHERE left(sha256(source_text), 1) >= '8' ORDER BY project_id, source_text, chapter_id, idx, id),
    pos AS (SELECT *, (row_number() OVER (PARTITION BY chapter_id ORDER BY idx, id) - 1) // 50 AS grp FROM rep WHERE length(source_text) <= 240 AND marks <= 8),
    grouped AS (SELECT project_id, source_text FROM (SELECT *, count(*) OVER (PARTITION BY chapter_id, grp) AS n FROM pos) WHERE n % 5 <> 0 AND length(source_text) % 7 <> 0),
    way AS (SELECT l.*, CASE WHEN left(sha256(l.source_text), 1) < '8' THEN 'cached' WHEN g.source_text IS NOT NULL THEN 'grouped' WHEN length(l.source_text) % 11 = 0 THEN 'failed' ELSE 'single' END AS path
            FROM live l LEFT JOIN grouped g ON g.project_id = l.project_id AND g.source_text = l.source_text),
    raw AS (SELECT *, CASE path WHEN 'cached' THEN '«' || source_text || '»' WHEN 'grouped' THEN '<' || source_text || '>'
            WHEN 'single' THEN '<' || CASE WHEN length(source_text) % 13 = 0 THEN regexp_replace(source_text, '{_PH}', '', 'g') ELSE source_text END || '>' END AS said FROM way),
    tgt AS (SELECT *, CASE WHEN target_lang IN ({', '.join(repr(x) for x in text.NO_LEADING_APOSTROPHE)}) THEN regexp_replace(said, '(^|{_SP})[''‘’ʼ]+(\p{{L}})', '\1\2', 'g') ELSE said END AS target FROM raw),
    bound AS (SELECT * FROM gloss WHERE status <> 'proposed' AND source_term <> ''),
    hit AS (SELECT sh.segment_id, b.id AS entry_id, b.status = 'locked' AND b.source_known AS hard FROM sh JOIN bound b ON b.id = sh.entry_id JOIN live l ON l.id = sh.segment_id),
    used AS (SELECT DISTINCT hit.segment_id, hit.entry_id FROM hit JOIN tgt ON tgt.id = hit.segment_id JOIN tt ON tt.entry_id = hit.entry_id WHERE {_hit('tgt.target', 'tt.term')}),
    lost AS (SELECT hit.segment_id, count(*) AS missed, bool_or(hard) AS hard FROM hit ANTI JOIN used ON used.segment_id = hit.segment_id AND used.entry_id = hit.entry_id GROUP BY 1),
    outcome AS (SELECT t.id, t.project_id, path, target, CASE WHEN target IS NULL THEN 'pending' WHEN coalesce(hard, false) OR path = 'single' AND length(t.source_text) % 13 = 0 AND marks > 0 THEN 'flagged' ELSE 'translated' END AS status,
                CASE WHEN target IS NULL THEN 0 ELSE coalesce(missed, 0) END AS missed FROM tgt t LEFT JOIN lost ON lost.segment_id = t.id
                UNION ALL SELECT id, project_id, 'trivial', source_text, 'translated', 0 FROM seg WHERE status = 'pending' AND id NOT IN (SELECT id FROM live))
"""


def _run(t: Tables) -> pipeline.Translated:
    """All pending segments against a ledger that holds the keys of half of the texts."""
    live = t.segment.where("status = 'pending'")
    heeded = pipeline.constraints(live, t.glossary, t.alias)
    known = pipeline.prompts(live, heeded, t.glossary, t.project, "m").where(F.substring(F.sha2("source_text", 256), 1, 1) < "8")
    ledger = known.select("project_id", "cache_key", F.concat(F.lit("«"), "source_text", F.lit("»")).alias("target"))
    return pipeline.translate(t.segment, t.glossary, t.alias, t.project, ledger, "m", ScriptedSingle(), ScriptedGroup(), NOW)


@query("l05_l06_translate", sql("seg gloss alias", _RUN + " SELECT * FROM outcome"))
def l0506(t: Tables) -> DataFrame:
    return _run(t).outcomes.select("id", "project_id", "path", "target", "status", "missed")


@query("l05_translated_segments", sql("seg gloss alias", _RUN + f"""
    SELECT s.id, coalesce(o.target, s.target_text) AS target_text, coalesce(CASE WHEN o.target IS NOT NULL THEN o.status END, s.status) AS status, CASE WHEN o.target IS NOT NULL THEN {NOW} ELSE s.updated_at END AS updated_at
    FROM seg s LEFT JOIN outcome o ON o.id = s.id"""))
def l05s(t: Tables) -> DataFrame:
    return _run(t).segments.select("id", "target_text", "status", "updated_at")


@query("l05_translation_events", sql("seg gloss alias", _RUN + """
    SELECT project_id, CASE WHEN target IS NULL THEN 'segment.failed' WHEN status = 'flagged' THEN 'segment.flagged' ELSE 'segment.translated' END AS kind, count(*) AS events FROM outcome WHERE path <> 'trivial' GROUP BY 1, 2"""))
def l05e(t: Tables) -> DataFrame:
    return _run(t).events.groupBy("project_id", "kind").agg(F.count("*").alias("events"))


@query("l12_constraint_prompts", sql("seg gloss alias", _TERMS + f"""
    , r AS (SELECT DISTINCT sh.segment_id AS id, CASE WHEN g.status = 'locked' THEN 0 ELSE 1 END AS rank, g.source_term, g.target_term FROM sh JOIN gloss g ON g.id = sh.entry_id WHERE g.status <> 'proposed' AND g.source_term <> ''),
    l AS (SELECT id, string_agg(CASE rank WHEN 0 THEN 'must: ' ELSE 'use: ' END || source_term || ' = ' || target_term, chr(10) ORDER BY rank, source_term, target_term) AS rules FROM r GROUP BY 1)
    SELECT s.id, 'Translate from ' || p.source_lang || ' to ' || p.target_lang || '. Keep marks such as [[T0]] as they are. Answer as JSON: {{"target": "..."}}' || coalesce(chr(10) || l.rules, '') AS system
    FROM seg s JOIN project p ON p.id = s.project_id LEFT JOIN l ON l.id = s.id WHERE {_LIVE}"""))
def l12p(t: Tables) -> DataFrame:
    live = t.segment.where("status = 'pending'").where(~text.is_trivially_empty(F.col("source_text")))
    return pipeline.prompts(live, pipeline.constraints(live, t.glossary, t.alias), t.glossary, t.project, "m").select("id", "system")


@query("g17_glossary_hash", sql("gloss", """
    , h AS (SELECT project_id, sha256(CAST(to_json({s: coalesce(source_term, ''), t: target_term, y: type, u: status, g: coalesce(gender, ''), source_known: source_known}) AS VARCHAR)) AS h FROM gloss),
    g AS (SELECT project_id, left(h, 4) || sha256(string_agg(h, '' ORDER BY h)) AS h FROM h GROUP BY project_id, left(h, 4))
    SELECT project_id, left(sha256(string_agg(h, '' ORDER BY h)), 32) AS glossary_hash FROM g GROUP BY 1"""))
def g17(t: Tables) -> DataFrame:
    return calls.glossary_hash(t.glossary)


@query("l08_l12_chunk_prompts", sql("book", """
    , s AS (SELECT project_id, id, spine_idx, idx, source_text, greatest(1, length(source_text) // 4) AS n, row_number() OVER (PARTITION BY project_id ORDER BY spine_idx, idx, id) AS r FROM book WHERE length(source_text) > 0),
    f AS (SELECT project_id, r, n AS total, 0 AS chunk FROM s WHERE r = 1
          UNION ALL SELECT s.project_id, s.r, CASE WHEN f.total + s.n > 1500 THEN s.n ELSE f.total + s.n END, CASE WHEN f.total + s.n > 1500 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN s ON s.project_id = f.project_id AND s.r = f.r + 1)
    SELECT s.project_id, CAST(chunk AS INTEGER) AS chunk, count(*) AS paragraphs, sha256(string_agg(source_text, chr(10) || chr(10) ORDER BY s.r)) AS prompt_hash FROM s JOIN f ON f.project_id = s.project_id AND f.r = s.r GROUP BY 1, 2"""))
def l12(t: Tables) -> DataFrame:
    """W03 chunks of every book as prompts."""
    from quillmill.operators import ordered, reads

    texts = t.segment.where("length(source_text) > 0")
    # only ids and sizes go through the sequential fold; texts join their chunk afterwards
    rows = reads.book_order(texts.select("id", "project_id", "chapter_id", "idx", F.greatest(F.lit(1), F.floor(F.length("source_text") / 4)).alias("n")), t.chapter)
    cut = ordered.greedy_chunks(rows, "project_id", ["spine_idx", "idx", "id"], F.col("n"), 1500)
    joined = cut.select("id", "project_id", "chunk", F.struct("spine_idx", "idx", "id").alias("position")).join(texts.select("id", F.col("source_text").alias("text")), "id")
    return calls.chunk_prompts(joined).select("project_id", "chunk", "paragraphs", F.sha2("prompt", 256).alias("prompt_hash"))


@query("l13_proposals_from_answers", sql("traces", rf"""
    , e AS (SELECT project_id, unnest(used_entries) AS x FROM traces),
    t AS (SELECT project_id, {_STRIP('x')} AS t FROM e)
    SELECT project_id, t AS source_term, 'term' AS type, upper(t) AS target_term, count(*) AS seen FROM t
    WHERE t <> '' AND length(t) <= 100 AND len(string_split({_FLAT('t')}, ' ')) <= 10 AND NOT regexp_matches(t, '[.!?]\s+\S') AND NOT regexp_matches(t, '[!?](\s|$)')
      AND length(replace(t, '(', '')) = length(replace(t, ')', '')) AND length(replace(t, '[', '')) = length(replace(t, ']', '')) AND NOT regexp_full_match(t, '\d{{1,4}}s?') GROUP BY ALL"""))
def l13(t: Tables) -> DataFrame:
    """Answers that propose the terms they used, each with a target in capitals; what holds up is counted."""
    new = F.transform("used_entries", lambda x: F.struct(x.alias("source"), F.upper(F.regexp_replace(x, f"^{text.SPACE}+|{text.SPACE}+$", "")).alias("target"), F.lit("TERM ").alias("type")))
    answers = t.trace.select("project_id", F.concat(F.lit("Here: "), F.to_json(F.struct(new.alias("new_terms")))).alias("response"))
    return pipeline.proposals(answers)
