"""Queries for scalar functions over the stored texts (T, G, H, M, Q, D)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.functions import terms, text
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql

_PH = r"\[\[/?T\d+\]\]"
_SP = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_NSP = r"[^\s\x{0b}\x{1c}-\x{1f}\x{85}\p{Z}]"
_STRIP = lambda x: f"regexp_replace({x}, '^{_SP}+|{_SP}+$', '', 'g')"
_FLAT = lambda x: f"trim(regexp_replace({x}, '{_SP}+', ' ', 'g'))"


@query("t01_placeholders", sql("seg", rf"SELECT id, regexp_extract_all(source_text, '{_PH}') AS tokens FROM seg"))
def t01(t: Tables) -> DataFrame:
    return t.segment.select("id", text.placeholders(F.col("source_text")).alias("tokens"))


@query("t02_strip_placeholders", sql("seg", rf"SELECT id, regexp_replace(regexp_replace(source_text, '{_PH}', '', 'g'), '[ \t]+', ' ', 'g') AS text FROM seg"))
def t02(t: Tables) -> DataFrame:
    return t.segment.select("id", text.strip_placeholders(F.col("source_text")).alias("text"))


@query("t03_t04_emptiness", sql("seg", rf"""
    SELECT id, coalesce(NOT regexp_matches(regexp_replace(regexp_replace(source_text, '{_PH}', '', 'g'), '[\x{{200b}}\x{{200c}}\x{{200d}}\x{{2060}}\x{{feff}}]', '', 'g'), '{_NSP}'), true) AS trivially_empty,
           coalesce(regexp_matches(regexp_replace(source_text, '{_PH}', '', 'g'), '{_NSP}'), false) AS translatable FROM seg"""))
def t03(t: Tables) -> DataFrame:
    s = F.col("source_text")
    return t.segment.select("id", text.is_trivially_empty(s).alias("trivially_empty"), text.has_translatable_text(s).alias("translatable"))


_PREVIEW = _FLAT(f"regexp_replace(source_text, '{_PH}', '', 'g')")


@query("t05_preview", sql("seg", f"SELECT id, CASE WHEN length({_PREVIEW}) > 60 THEN rtrim(substring({_PREVIEW}, 1, 59)) || '…' ELSE {_PREVIEW} END AS preview FROM seg"))
def t05(t: Tables) -> DataFrame:
    return t.segment.select("id", text.compact_preview(F.col("source_text")).alias("preview"))


def _expand_sql() -> str:
    out = "replace(text, '&', '&')"
    for name, ch in text.ENTITIES.items():
        out = f"replace({out}, '&{name};', chr({ord(ch)}))"
    return f"SELECT doc_id, sha256({out}) AS expanded FROM documents WHERE text IS NOT NULL"


@query("t08_expand_entities", _expand_sql())
def t08(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2(text.expand_entities(F.col("text")), 256).alias("expanded"))


@query("t11_placeholder_validation")
def t11(t: Tables) -> DataFrame:
    """Faults of each answered segment against its skeleton."""
    from quillmill.sources import skeleton

    tok = skeleton.decode(F.col("inline_skeleton"))["tokens"]
    kinds = F.transform(F.coalesce(tok, F.array().cast("array<struct<tag:string,kind:string,attrs:map<string,string>>>")), lambda x: x["kind"])
    return t.segment.where("target_text IS NOT NULL").select("id", text.placeholder_faults(F.coalesce("target_text", "source_text"), kinds).alias("faults"))


_BLANK = "(source_text = '' OR target_text = '')"


@query("t13_outer_whitespace", sql("seg", f"""
    SELECT id, CASE WHEN {_BLANK} THEN target_text ELSE
        CASE WHEN regexp_matches(target_text, '^{_SP}') THEN '' ELSE regexp_extract(source_text, '^({_SP}*)', 1) END || target_text ||
        CASE WHEN regexp_matches(target_text, '{_SP}$') THEN '' ELSE regexp_extract(source_text, '({_SP}*)$', 1) END END AS target FROM seg WHERE target_text IS NOT NULL"""))
def t13(t: Tables) -> DataFrame:
    return t.segment.where("target_text IS NOT NULL").select("id", text.restore_outer_whitespace(F.col("source_text"), F.col("target_text")).alias("target"))


@query("t14_normalize_whitespace", f"SELECT doc_id, sha256({_FLAT('text')}) AS flat FROM documents WHERE text IS NOT NULL")
def t14(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", F.sha2(text.normalize_whitespace(F.col("text")), 256).alias("flat"))


_D = _FLAT("text")


@query("t19_short_description", f"""
    WITH f AS (SELECT doc_id, {_D} AS flat FROM documents WHERE text IS NOT NULL),
    w AS (SELECT *, substring(flat, 1, 400) AS win FROM f), s AS (SELECT *, CAST(length(win) - strpos(reverse(win), '.') + 1 AS BIGINT) AS stop FROM w)
    SELECT doc_id, CASE WHEN length(flat) <= 320 THEN flat WHEN strpos(win, '.') > 0 AND stop >= 240 THEN substring(win, 1, stop) ELSE rtrim(substring(flat, 1, 320)) || '…' END AS description FROM s""")
def t19(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", text.short_description(F.col("text")).alias("description"))


@query("t20_short_error", "SELECT doc_id, CASE WHEN length(text) > 240 THEN substring(text, 1, 240) || '…' ELSE text END AS message FROM documents WHERE text IS NOT NULL")
def t20(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select("doc_id", text.short_error(F.col("text")).alias("message"))


@query("a20_word_count", f"SELECT doc_id, CAST(nullif(len(list_filter(regexp_split_to_array(coalesce(text, ''), '{_SP}+'), lambda x: regexp_matches(x, '[\\p{{L}}\\p{{N}}]'))), 0) AS INTEGER) AS words FROM documents")
def a20(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", text.word_count(F.col("text")).alias("words"))


@query("m04_a25_token_estimates", sql("seg", """
    SELECT project_id, CAST(sum(greatest(1, length(source_text) // 4)) AS BIGINT) AS source_tokens,
           CAST(sum(CASE WHEN coalesce(length(target_text), 0) = 0 THEN 0 ELSE greatest(1, length(target_text) // 4) END) AS BIGINT) AS target_tokens FROM seg GROUP BY 1"""))
def m04(t: Tables) -> DataFrame:
    return t.segment.groupBy("project_id").agg(F.sum(text.token_estimate(F.col("source_text"))).alias("source_tokens"), F.sum(text.token_estimate(F.col("target_text"), 0)).alias("target_tokens"))


@query("m05_backoff", "SELECT CAST(a AS BIGINT) AS attempt, least(8.0::DOUBLE, 0.5::DOUBLE * pow(2.0, a - 1)) AS seconds FROM range(1, 7) r(a)")
def m05(t: Tables) -> DataFrame:
    return t.spark.range(1, 7).select(F.col("id").alias("attempt"), terms.backoff_seconds(F.col("id")).alias("seconds"))


@query("m07_d02_formats", sql("calls", """
    SELECT id, CASE WHEN coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0) = 0 THEN '—' ELSE printf('%.1f%%', 100.0 * coalesce(completion_tokens, 0) / (coalesce(prompt_tokens, 0) + coalesce(completion_tokens, 0))) END AS share,
           strftime(make_timestamp(created_at * 1000000), '%Y-%m-%d %H:%M') AS called FROM calls"""))
def m07(t: Tables) -> DataFrame:
    p, c = F.coalesce("prompt_tokens", F.lit(0)), F.coalesce("completion_tokens", F.lit(0))
    return t.call.select("id", terms.share_text(c, p + c).alias("share"), F.date_format(F.timestamp_seconds("created_at"), "yyyy-MM-dd HH:mm").alias("called"))


@query("m09_safe_numbers", "SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS INTEGER) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def m09(t: Tables) -> DataFrame:
    return t.raw("events").select("event_id", F.get_json_object("props", "$.k").try_cast("int").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("h01_source_hash", sql("seg", "SELECT id, sha256(source_text) AS hash, sha256(source_text) = source_hash AS stored FROM seg"))
def h01(t: Tables) -> DataFrame:
    return t.segment.select("id", F.sha2("source_text", 256).alias("hash"), (F.sha2("source_text", 256) == F.col("source_hash")).alias("stored"))


@query("h02_h03_call_keys", sql("seg", """
    SELECT id, substring(sha256('m:' || sha256(project_id) || ':' || sha256(source_text) || ':' || repeat('0', 32)), 1, 32) AS key,
           sha256('be brief' || chr(1) || project_id) AS system_hash, sha256('user' || chr(0) || source_text || chr(1) || 'assistant' || chr(0) || coalesce(target_text, '')) AS rest_hash FROM seg"""))
def h03(t: Tables) -> DataFrame:
    roles = F.array(F.lit("system"), F.lit("user"), F.lit("system"), F.lit("assistant"))
    h = terms.message_hashes(roles, F.array(F.lit("be brief"), F.col("source_text"), F.col("project_id"), F.coalesce("target_text", F.lit(""))))
    return t.segment.select("id", terms.call_key(F.lit("m"), F.col("project_id"), F.col("source_text"), F.lit("0" * 32)).alias("key"), h["system"].alias("system_hash"), h["rest"].alias("rest_hash"))


def _particles_sql(lang: str) -> str:
    out = "CASE"
    for code, w in terms.PARTICLES.items():
        out += f" WHEN {lang} = '{code}' THEN [{', '.join(repr(x) for x in w.split())}]"
    return out + f" ELSE [{', '.join(repr(x) for x in terms.PARTICLES['en'].split())}] END"


def _lead_sql(term: str, lang: str) -> str:
    flat = _FLAT(term)
    head = f"regexp_replace(lower(split_part({flat}, ' ', 1)), '^[^\\p{{L}}\\p{{N}}]+|[^\\p{{L}}\\p{{N}}]+$', '', 'g')"
    return f"CASE WHEN contains({flat}, ' ') AND list_contains({_particles_sql(lang)}, {head}) THEN {head} END"


_GP = "gloss g JOIN project p ON p.id = g.project_id"


@query("g08_g11_particles", sql("gloss", f"""
    SELECT id, source_particle, target_particle, lemma, source_term IS NULL OR ((source_particle IS NULL) = (target_particle IS NULL)) AS symmetric
    FROM (SELECT g.id, g.source_term, {_lead_sql('g.source_term', 'p.source_lang')} AS source_particle, {_lead_sql('g.target_term', 'p.target_lang')} AS target_particle,
          CASE WHEN {_lead_sql('g.target_term', 'p.target_lang')} IS NOT NULL THEN regexp_replace({_FLAT('g.target_term')}, '^[^ ]+ ', '') ELSE {_FLAT('g.target_term')} END AS lemma FROM {_GP})"""))
def g08(t: Tables) -> DataFrame:
    g = t.glossary.join(t.project.select(F.col("id").alias("project_id"), "source_lang", "target_lang"), "project_id")
    s, u, a, b = F.col("source_term"), F.col("target_term"), F.col("source_lang"), F.col("target_lang")
    return g.select("id", terms.leading_particle(s, a).alias("source_particle"), terms.leading_particle(u, b).alias("target_particle"), terms.normalize_term(u, b).alias("lemma"), terms.symmetric_pair(s, u, a, b).alias("symmetric"))


@query("g12_g16_w16_doubled_particles", sql("seg", rf"""
    , w AS (SELECT s.id, p.target_lang, list_transform(regexp_extract_all(s.target_text, '[\p{{L}}]+(?:''[\p{{L}}]+)?'), lambda x: lower(x)) AS w FROM seg s JOIN project p ON p.id = s.project_id WHERE target_text IS NOT NULL),
    u AS (SELECT id, target_lang, unnest(w) AS word, generate_subscripts(w, 1) AS k FROM w),
    n AS (SELECT *, lead(word) OVER (PARTITION BY id ORDER BY k) AS next FROM u)
    SELECT id, list(word ORDER BY k) AS doubled FROM n WHERE word = next AND list_contains({_particles_sql('target_lang')}, word) GROUP BY id"""))
def g12(t: Tables) -> DataFrame:
    s = t.segment.where("target_text IS NOT NULL").join(t.project.select(F.col("id").alias("project_id"), "target_lang"), "project_id")
    return s.select("id", terms.doubled_particles(F.col("target_text"), F.col("target_lang")).alias("doubled")).where("size(doubled) > 0")


@query("g04_all_terms", sql("gloss alias", """
    SELECT g.id, list_distinct_ordered AS terms FROM (
      SELECT id, list(text ORDER BY pos, text) AS list_distinct_ordered FROM (
        SELECT id, text, min(pos) AS pos FROM (SELECT id, target_term AS text, 0 AS pos FROM gloss WHERE target_term <> '' UNION ALL SELECT entry_id, text, 1 FROM alias WHERE side = 'target' AND text <> '') GROUP BY 1, 2) GROUP BY 1) g"""))
def g04(t: Tables) -> DataFrame:
    from quillmill.operators import reads

    return reads.with_aliases(t.glossary, t.alias).select("id", terms.all_terms(F.col("target_term"), F.col("target_aliases")).alias("terms"))


@query("g18_f28_year_like", r"""
    WITH c AS (SELECT id, title AS term FROM chapter WHERE title IS NOT NULL UNION ALL SELECT id || '-y', CAST(1000 + spine_idx AS VARCHAR) || CASE spine_idx % 4 WHEN 0 THEN 's' WHEN 1 THEN '-' || CAST(1100 + spine_idx AS VARCHAR) WHEN 2 THEN '.' ELSE ' AD' END FROM chapter)
    SELECT id, term, regexp_full_match(regexp_replace(regexp_replace(trim(term), '( AD)$', ''), '[.,;:!?]+$', ''), '\d{1,4}(\s*[-–—]\s*\d{1,4})?s?') AS year_like FROM c""")
def g18(t: Tables) -> DataFrame:
    c = t.chapter
    n = F.col("spine_idx")
    made = F.concat((n + 1000).cast("string"), F.when(n % 4 == 0, "s").when(n % 4 == 1, F.concat(F.lit("-"), (n + 1100).cast("string"))).when(n % 4 == 2, ".").otherwise(" AD"))
    rows = c.where("title IS NOT NULL").select("id", F.col("title").alias("term")).unionByName(c.select(F.concat("id", F.lit("-y")).alias("id"), made.alias("term")))
    return rows.select("id", "term", terms.is_year_like(F.col("term")).alias("year_like"))


@query("g19_g20_candidate_faults", sql("gloss", rf"""
    , s AS (SELECT id, {_STRIP('source_term')} AS t FROM gloss)
    SELECT id, CASE WHEN t IS NULL OR t = '' THEN 'empty' WHEN length(t) > 100 THEN 'long' WHEN len(string_split({_FLAT('t')}, ' ')) > 10 THEN 'wordy'
        WHEN regexp_matches(t, '[.!?]\s+\S') OR regexp_matches(t, '[!?](\s|$)') THEN 'sentence'
        WHEN length(t) - length(replace(t, '(', '')) <> length(t) - length(replace(t, ')', '')) THEN 'brackets'
        WHEN regexp_full_match(t, '\d{{1,4}}s?') THEN 'year' END AS fault FROM s"""))
def g19(t: Tables) -> DataFrame:
    return t.glossary.select("id", terms.candidate_fault(F.col("source_term")).alias("fault"))


@query("g22_z15_apostrophes", sql("seg", rf"""
    SELECT s.id, CASE WHEN p.target_lang IN ({', '.join(repr(x) for x in text.NO_LEADING_APOSTROPHE)}) THEN regexp_replace(s.target_text, '(^|{_SP})[''‘’ʼ]+(\p{{L}})', '\1\2', 'g') ELSE s.target_text END AS target
    FROM seg s JOIN project p ON p.id = s.project_id WHERE s.target_text IS NOT NULL"""))
def g22(t: Tables) -> DataFrame:
    s = t.segment.where("target_text IS NOT NULL").join(t.project.select(F.col("id").alias("project_id"), "target_lang"), "project_id")
    return s.select("id", text.strip_orphan_apostrophes(F.col("target_text"), F.col("target_lang")).alias("target"))


@query("q02_recover_json", """
    WITH r AS (SELECT event_id, CASE event_id % 3 WHEN 0 THEN props WHEN 1 THEN 'Here: ' || props || ' done' ELSE 'no json' END AS reply FROM events)
    SELECT event_id, CASE WHEN json_valid(reply) AND starts_with(ltrim(reply), '{') THEN reply WHEN json_valid(regexp_extract(reply, '(?s)(\\{.*\\})', 1)) THEN regexp_extract(reply, '(?s)(\\{.*\\})', 1) END AS object FROM r""".replace("\\\\", "\\"))
def q02(t: Tables) -> DataFrame:
    e = t.raw("events")
    n = F.col("event_id") % 3
    reply = F.when(n == 0, F.col("props")).when(n == 1, F.concat(F.lit("Here: "), "props", F.lit(" done"))).otherwise("no json")
    return e.select("event_id", terms.recover_json(reply).alias("object"))


@query("q03_optional_strings", sql("gloss", f"SELECT id, nullif({_STRIP('notes')}, '') AS notes FROM gloss"))
def q03(t: Tables) -> DataFrame:
    return t.glossary.select("id", terms.optional_string(F.col("notes")).alias("notes"))


@query("q05_event_summaries", sql("event", """
    SELECT id, CASE kind WHEN 'purchase' THEN 'bought item ' || coalesce(json_extract_string(payload, '$.k'), '?') WHEN 'error' THEN 'error ' || coalesce(json_extract_string(payload, '$.k'), '?') ELSE kind || ' by ' || project_id END AS summary FROM event"""))
def q05(t: Tables) -> DataFrame:
    k = F.coalesce(F.get_json_object("payload", "$.k"), F.lit("?"))
    return t.event.select("id", F.when(F.col("kind") == "purchase", F.concat(F.lit("bought item "), k)).when(F.col("kind") == "error", F.concat(F.lit("error "), k)).otherwise(F.concat("kind", F.lit(" by "), "project_id")).alias("summary"))


@query("q06_slugs", r"SELECT id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(name), '[\s_-]+', '-', 'g'), '[^\p{L}\p{N}-]', '', 'g'), '-+', '-', 'g'), '^-|-$', '', 'g') AS slug FROM project")
def q06(t: Tables) -> DataFrame:
    return t.project.select("id", text.slug(F.col("name")).alias("slug"))


@query("d01_day_windows", sql("event", "SELECT ts - ts % 86400 AS day, count(*) AS events FROM event GROUP BY 1"))
def d01(t: Tables) -> DataFrame:
    day = F.unix_seconds(F.date_trunc("day", F.timestamp_seconds("ts")))
    return t.event.groupBy(day.alias("day")).agg(F.count("*").alias("events"))
