"""Queries for what is left of the inventory: integrity, listings, identifiers, rendering, sniffing, scheduling."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from quillmill.operators import calls, matching, ordered, reads
from quillmill.functions import terms
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql
from quillmill.sources import epub_sink, skeleton, xhtml

# Names of the languages of the projects.
LANGUAGES = {"en": "English", "fr": "French", "es": "Spanish", "pt": "Portuguese", "de": "German", "ja": "Japanese"}


@query("s01_s23_key_violations", sql("seg", """
    SELECT 'segment' AS table_name, chapter_id AS key, CAST(idx AS BIGINT) AS number, count(*) AS rows FROM seg GROUP BY ALL HAVING count(*) > 1
    UNION ALL SELECT 'chapter', project_id, CAST(spine_idx AS BIGINT), count(*) FROM chapter GROUP BY ALL HAVING count(*) > 1"""))
def s23(t: Tables) -> DataFrame:
    """Keys that a write would have refused: (chapter, idx) of segments and (project, spine place) of chapters."""
    dup = lambda df, name, key, n: df.groupBy(F.lit(name).alias("table_name"), F.col(key).alias("key"), F.col(n).cast("long").alias("number")).agg(F.count("*").alias("rows")).where("rows > 1")
    return dup(t.segment, "segment", "chapter_id", "idx").unionByName(dup(t.chapter, "chapter", "project_id", "spine_idx"))


@query("s19_library_scan", r"SELECT regexp_extract(source_path, '^(.*)/[^/]+$', 1) AS folder, count(*) AS books, count(*) = 1 AS single FROM project GROUP BY 1")
def s19(t: Tables) -> DataFrame:
    folder = F.regexp_extract("source_path", r"^(.*)/[^/]+$", 1)
    return t.project.groupBy(folder.alias("folder")).agg(F.count("*").alias("books"), (F.count("*") == 1).alias("single"))


@query("f19_sources_newest_first", "SELECT source, CAST(floor(epoch(max(added_at))) AS BIGINT) AS added, count(*) AS documents FROM documents WHERE source IS NOT NULL GROUP BY 1 ORDER BY added DESC, source")
def f19(t: Tables) -> DataFrame:
    by = t.documents.where("source IS NOT NULL").groupBy("source").agg(F.unix_seconds(F.max("added_at").cast("timestamp")).alias("added"), F.count("*").alias("documents"))
    return by.orderBy(F.desc("added"), "source")


@query("f32_recents_alive", sql("seg", "SELECT count_if(n > 0) AS alive, count_if(n = 0) AS missing FROM (SELECT p.id, count(s.id) AS n FROM project p LEFT JOIN seg s ON s.project_id = p.id GROUP BY 1)"))
def f32(t: Tables) -> DataFrame:
    held = t.segment.groupBy(F.col("project_id").alias("id")).agg(F.count("*").alias("n"))
    j = t.project.select("id").join(held, "id", "left")
    return j.agg(F.count_if(F.col("n").isNotNull()).alias("alive"), F.count_if(F.col("n").isNull()).alias("missing"))


@query("h04_h05_natural_ids", sql("seg", "SELECT id, substring(sha256(project_id || ':' || chapter_id || ':' || idx), 1, 32) AS natural_id, repeat('0', 32) AS empty_glossary FROM seg"))
def h05(t: Tables) -> DataFrame:
    return t.segment.select("id", F.substring(F.sha2(F.concat_ws(":", "project_id", "chapter_id", F.col("idx").cast("string")), 256), 1, 32).alias("natural_id"), F.lit("0" * 32).alias("empty_glossary"))


@query("g24_g26_language_labels", "SELECT id, CASE split_part(lower(source_lang), '-', 1) " + " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in LANGUAGES.items()) + " ELSE source_lang END AS label FROM project")
def g26(t: Tables) -> DataFrame:
    """Labels by the full tag, else by the primary subtag, else the tag itself."""
    names = F.create_map(*[F.lit(x) for kv in LANGUAGES.items() for x in kv])
    tag = F.lower("source_lang")
    return t.project.select("id", F.coalesce(F.try_element_at(names, tag), F.try_element_at(names, F.split(tag, "[-_]")[0]), F.col("source_lang")).alias("label"))


@query("o09_w15_match_order")
def o09(t: Tables) -> DataFrame:
    """Mentions of each segment numbered by (start, end, entry)."""
    return matching.placed_mentions(matching.source_texts(t.segment), matching.entry_terms(t.glossary, t.alias, "source"))


@query("t06_render_previews")
def t06(t: Tables) -> DataFrame:
    """Segments with their placeholders shown as the tags they stand for."""
    rows = t.segment.where("inline_skeleton IS NOT NULL").select("id", "source_text", skeleton.decode(F.col("inline_skeleton"))["tokens"].alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"id": pdf["id"], "preview": [xhtml.preview(s, list(k)) for s, k in zip(pdf["source_text"], pdf["tokens"])]})

    return rows.mapInPandas(run, "id string, preview string")


@query("t07_t10_t16_round_trip")
def t07(t: Tables) -> DataFrame:
    """Markup rebuilt from each segment, parsed and cut again: whether text and tokens come back."""
    rows = t.segment.select("id", "source_text", "host_path", skeleton.decode(F.col("inline_skeleton"))["tokens"].alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            same = []
            for s, p, toks in zip(pdf["source_text"], pdf["host_path"], pdf["tokens"]):
                toks = [{"tag": k["tag"], "kind": k["kind"], "attrs": dict(k["attrs"] or {})} for k in toks]
                host = xhtml.hosts(xhtml.parse(epub_sink.host_markup(p, s, toks)))
                same.append(len(host) == 1 and xhtml.placeholderize(host[0]) == (s, toks))
            yield pd.DataFrame({"id": pdf["id"], "same": same})

    return rows.mapInPandas(run, "id string, same boolean")


@query("l11_tone_sniff")
def l11(t: Tables) -> DataFrame:
    """A spread sample of each book, put to the model as one prompt; the sample has a fixed number of blocks."""
    rows = reads.book_positions(t.segment.select("id", "project_id", "chapter_id", "idx", "source_text"), t.chapter)
    s = ordered.spread_sample(rows, "project_id", "position", 5, 4, 5)
    prompts = s.groupBy("project_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", F.substring("source_text", 1, 1500).alias("x")))), lambda v: v["x"]), "\n\n").alias("prompt"))
    answers = calls.parse(calls.call(prompts.withColumn("cache_key", F.sha2("prompt", 256)), calls.echo_model))
    return answers.select("project_id", "cache_key", "notes", "fault")


@query("l14_w08_schedule", sql("calls", """
    , r AS (SELECT id, project_id, coalesce(sum(CAST(coalesce(cost_usd, 0) AS DECIMAL(18,6))) OVER (PARTITION BY project_id ORDER BY created_at, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM calls)
    SELECT id, project_id, CAST(spent AS DOUBLE) AS spent, spent <= 0.05 AS submitted FROM r"""))
def l14(t: Tables) -> DataFrame:
    cost = F.coalesce("cost_usd", F.lit(0.0)).cast("decimal(18,6)")
    out = calls.schedule(t.call.select("id", "project_id", "created_at", "cost_usd"), "project_id", ["created_at", "id"], cost, F.lit(0.05).cast("decimal(18,6)"))
    return out.select("id", "project_id", F.col("spent").cast("double").alias("spent"), "submitted")


@query("l09_l10_target_chunks", sql("seg", r"""
    , t AS (SELECT chapter_id, id, idx, trim(regexp_replace(regexp_replace(target_text, '\[\[/?T\d+\]\]', '', 'g'), '[ \t]+', ' ', 'g'), ' ') AS text FROM seg WHERE length(target_text) > 0),
    s AS (SELECT *, length(text) AS n, row_number() OVER (PARTITION BY chapter_id ORDER BY idx, id) AS r FROM t),
    f AS (SELECT chapter_id, r, n AS total, 0 AS chunk FROM s WHERE r = 1
          UNION ALL SELECT s.chapter_id, s.r, CASE WHEN f.total > 0 AND f.total + 2 + s.n > 6000 THEN s.n ELSE f.total + s.n + CASE WHEN f.total > 0 THEN 2 ELSE 0 END END,
                 CASE WHEN f.total > 0 AND f.total + 2 + s.n > 6000 THEN f.chunk + 1 ELSE f.chunk END FROM f JOIN s ON s.chapter_id = f.chapter_id AND s.r = f.r + 1)
    SELECT s.chapter_id, CAST(chunk AS INTEGER) AS chunk, count(*) AS paragraphs, CAST(length(string_agg(text, chr(10) || chr(10) ORDER BY s.r)) AS INTEGER) AS chars FROM s JOIN f ON f.chapter_id = s.chapter_id AND f.r = s.r GROUP BY 1, 2"""))
def l10(t: Tables) -> DataFrame:
    """Prompts over the target editions: paragraphs without marks, in chunks of at most 6,000 characters per chapter."""
    from quillmill.functions import text

    rows = t.segment.where("length(target_text) > 0").select("id", "project_id", "chapter_id", "idx", F.trim(text.strip_placeholders(F.col("target_text"))).alias("text"))
    cut = ordered.greedy_chunks(rows.select("id", "chapter_id", "idx", F.length("text").alias("n")), "chapter_id", ["idx", "id"], F.col("n"), 6000, 2)
    j = cut.select("id", "chunk").join(rows, "id").select(F.col("chapter_id").alias("project_id"), "chunk", F.struct("idx", "id").alias("position"), "text")
    return calls.chunk_prompts(j).select(F.col("project_id").alias("chapter_id"), "chunk", "paragraphs", F.length("prompt").alias("chars"))


@query("g24_style_guides", """
    SELECT id, coalesce(nullif(trim(CASE WHEN context_max_segments > 0 THEN '  ' || name || ' ' WHEN context_max_chars > 0 THEN ' ' END), ''), CASE target_lang WHEN 'de' THEN 'Sie, not du.' WHEN 'fr' THEN 'Vous, not tu.' END) AS style FROM project""")
def g24(t: Tables) -> DataFrame:
    """Own text before the preset named, before none."""
    custom = F.when(F.col("context_max_segments") > 0, F.concat(F.lit("  "), "name", F.lit(" "))).when(F.col("context_max_chars") > 0, F.lit(" "))
    return t.project.select("id", terms.style_guide(custom, F.col("target_lang"), {"de": "Sie, not du.", "fr": "Vous, not tu."}).alias("style"))
