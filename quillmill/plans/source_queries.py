"""Queries for sources and sinks (S)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql
from quillmill.sources import glossary_json, skeleton, xhtml


@query("s25_skeletons", sql("seg", """
    SELECT id, CAST(CASE WHEN inline_skeleton IS NULL THEN 0 WHEN starts_with(ltrim(inline_skeleton), '[') THEN json_array_length(inline_skeleton) ELSE coalesce(json_array_length(inline_skeleton, '$.skeleton'), 0) END AS INTEGER) AS tokens,
           coalesce(CASE WHEN starts_with(ltrim(inline_skeleton), '{') THEN json_extract_string(inline_skeleton, '$.host_path') END, '') AS host_path,
           coalesce(CASE WHEN starts_with(ltrim(inline_skeleton), '{') THEN CAST(json_extract_string(inline_skeleton, '$.host_total_parts') AS INTEGER) END, 1) AS parts FROM seg"""))
def s25(t: Tables) -> DataFrame:
    e = skeleton.decode(F.col("inline_skeleton"))
    return t.segment.select("id", e.alias("e")).select("id", F.size("e.tokens").alias("tokens"), "e.host_path", F.col("e.host_total_parts").alias("parts"))


@query("s26_token_rows", sql("seg", """
    , e AS (SELECT id, CASE WHEN starts_with(ltrim(inline_skeleton), '[') THEN inline_skeleton::JSON ELSE json_extract(inline_skeleton, '$.skeleton') END AS a FROM seg WHERE inline_skeleton IS NOT NULL)
    SELECT id, CAST(k AS INTEGER) AS position, json_extract_string(a, '$[' || k || '].tag') AS tag, json_extract_string(a, '$[' || k || '].kind') AS kind FROM e, LATERAL (SELECT unnest(range(CAST(json_array_length(a) AS BIGINT))) AS k)"""))
def s26(t: Tables) -> DataFrame:
    e = skeleton.decode(F.col("inline_skeleton"))["tokens"]
    return t.segment.where("inline_skeleton IS NOT NULL").select("id", F.posexplode(e).alias("position", "t")).select("id", "position", "t.tag", "t.kind")


@query("s18_reassembled_hosts", sql("seg", """
    SELECT chapter_id, host_path, string_agg(coalesce(target_text, source_text), '' ORDER BY host_part, idx, id) AS text, count(*) AS parts FROM seg GROUP BY 1, 2"""))
def s18(t: Tables) -> DataFrame:
    part = F.struct("host_part", "idx", "id", F.coalesce("target_text", "source_text").alias("x"))
    return t.segment.groupBy("chapter_id", "host_path").agg(F.array_join(F.transform(F.array_sort(F.collect_list(part)), lambda p: p["x"]), "").alias("text"), F.count("*").alias("parts"))


@query("s15_glossary_export", sql("gloss", """
    SELECT project_id, id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY source_term NULLS FIRST, id) AS INTEGER) AS position,
           CAST(to_json({source_term: source_term, target_term: target_term, type: type, status: status, gender: gender, notes: notes, source_known: source_known}) AS VARCHAR) AS entry FROM gloss"""))
def s15(t: Tables) -> DataFrame:
    return glossary_json.export_entries(t.glossary)


@query("s11_s13_s14_read_payloads", sql("gloss", """
    SELECT project_id, source_term, target_term, coalesce(type, 'term') AS type, CASE WHEN target_term IS NULL OR trim(target_term) = '' THEN 'no target term' WHEN source_term IS NULL AND source_known THEN 'no source term' WHEN trim(source_term) = '' THEN 'blank source term' END AS fault FROM gloss"""))
def s11(t: Tables) -> DataFrame:
    """Payload files of all projects, packed and read back; a project's entries go in blocks of one payload each."""
    e = glossary_json.export_entries(t.glossary)
    files = e.groupBy("project_id", F.floor((F.col("position") - 1) / 1000).alias("block")).agg(F.concat_ws(",", F.transform(F.array_sort(F.collect_list(F.struct("position", "entry"))), lambda x: x["entry"])).alias("body"))
    text = F.concat(F.lit('{"version":2,"project_id":"'), "project_id", F.lit('","entries":['), "body", F.lit("]}"))
    raw = files.select(F.from_json(text, glossary_json.PAYLOAD).alias("p")).select("p.*")
    return glossary_json.normalise(glossary_json.explode_payload(raw)).select("project_id", "source_term", "target_term", "type", "fault")


def _pages(t: Tables) -> DataFrame:
    """Whole documents as pages: a heading and a paragraph per line."""
    esc = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&#60;")), F.lit(">"), F.lit("&#62;"))
    body = F.concat(F.lit("<p>"), F.replace(esc(F.col("text")), F.lit("\n"), F.lit("</p><p>")), F.lit("</p>"))
    head = F.coalesce(F.concat(F.lit("<h1>"), esc(F.col("title")), F.lit("</h1>")), F.lit(""))
    return t.documents.where("text IS NOT NULL").select("doc_id", F.concat(F.lit("<html><body>"), head, body, F.lit("</body></html>")).alias("page"))


@query("s03_s04_s07_segmented_pages")
def s04(t: Tables) -> DataFrame:
    return xhtml.segment_pages(_pages(t), "doc_id", "page").select("doc", "title", "idx", F.sha2("source_text", 256).alias("hash"), "host_path")


@query("t12_w12_sentence_parts")
def t12(t: Tables) -> DataFrame:
    """Segments in parts of at most 60 estimated tokens, cut between sentences outside pairs."""
    from collections.abc import Iterator

    import pandas as pd

    rows = t.segment.select("id", "source_text", skeleton.decode(F.col("inline_skeleton"))["tokens"].alias("tokens"))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [(i, k, len(p), x) for i, s, toks in zip(pdf["id"], pdf["source_text"], pdf["tokens"]) for p in [xhtml.split_sentences(s, list(toks), 60)] for k, (x, _) in enumerate(p)]
            yield pd.DataFrame(out, columns=["id", "part", "parts", "text"])

    return rows.mapInPandas(run, "id string, part int, parts int, text string")
