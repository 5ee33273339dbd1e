"""Queries for matching, validation and entity resolution (J06, G, A11, E)."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from quillmill.functions import terms
from quillmill.operators import matching, reads, resolution
from quillmill.plans.registry import query
from quillmill.plans.views import Tables, sql

_EDGE = r"[^\p{L}\p{N}_]"


def _hit(text: str, term: str) -> str:
    return f"contains({text}, {term}) AND regexp_matches({text}, '(^|{_EDGE})' || regexp_escape({term}) || '($|{_EDGE})')"


_TERMS = """
    , st AS (SELECT project_id, id AS entry_id, source_term AS term FROM gloss WHERE source_term <> '' UNION SELECT g.project_id, a.entry_id, a.text FROM alias a JOIN gloss g ON g.id = a.entry_id WHERE a.side = 'source'),
    tt AS (SELECT project_id, id AS entry_id, target_term AS term FROM gloss WHERE target_term <> '' UNION SELECT g.project_id, a.entry_id, a.text FROM alias a JOIN gloss g ON g.id = a.entry_id WHERE a.side = 'target'),
    sh AS (SELECT DISTINCT s.id AS segment_id, st.entry_id FROM seg s JOIN st ON st.project_id = s.project_id WHERE """ + _hit("s.source_text", "st.term") + """),
    th AS (SELECT DISTINCT s.id AS segment_id, tt.entry_id FROM seg s JOIN tt ON tt.project_id = s.project_id WHERE """ + _hit("s.target_text", "tt.term") + ")"


def _mentions(t: Tables) -> DataFrame:
    return matching.mentions(matching.source_texts(t.segment), matching.entry_terms(t.glossary, t.alias, "source"))


@query("j06_g02_mentions")
def j06(t: Tables) -> DataFrame:
    return _mentions(t)


@query("j06_f13_mentioned_entries", sql("seg gloss alias", _TERMS + " SELECT segment_id, entry_id FROM sh"))
def j06b(t: Tables) -> DataFrame:
    return matching.pairs(matching.source_texts(t.segment), matching.entry_terms(t.glossary, t.alias, "source"))


# DuckDB has no look-around: every sign between words is doubled, so that neighbouring hits do not share one.
_COUNTED = _TERMS + r"""
    , f AS (SELECT DISTINCT sh.segment_id, sh.entry_id, st.term FROM sh JOIN st ON st.entry_id = sh.entry_id JOIN seg s ON s.id = sh.segment_id WHERE contains(s.source_text, st.term)),
    a AS (SELECT segment_id, entry_id, string_agg(regexp_escape(regexp_replace(term, '([^\p{L}\p{N}_])', '\1\1', 'g')), '|' ORDER BY length(term) DESC, term) AS forms FROM f GROUP BY 1, 2),
    c AS (SELECT a.entry_id, a.segment_id, len(regexp_extract_all(regexp_replace(s.source_text, '([^\p{L}\p{N}_])', '\1\1', 'g'), '(?:^|[^\p{L}\p{N}_])(?:' || forms || ')(?:$|[^\p{L}\p{N}_])')) AS n FROM a JOIN seg s ON s.id = a.segment_id)
    SELECT entry_id, CAST(sum(n) AS BIGINT) AS mentions, count(*) AS segments FROM c GROUP BY 1
"""


@query("a11_a30_j02_mention_counts", sql("seg gloss alias", _COUNTED))
def a11(t: Tables) -> DataFrame:
    return matching.counted_mentions(matching.source_texts(t.segment), matching.entry_terms(t.glossary, t.alias, "source"))


@query("j03_o02_occurrences")
def j03(t: Tables) -> DataFrame:
    texts = reads.book_order(t.segment, t.chapter).select(F.col("id").alias("segment_id"), "project_id", F.col("source_text").alias("text"), "chapter_id", "idx", "spine_idx")
    m = matching.carried_mentions(texts, matching.entry_terms(t.glossary, t.alias, "source"), "chapter_id", "idx", "spine_idx")
    return m.select("chapter_id", *m.columns[:5], "idx", "spine_idx").orderBy("entry_id", "spine_idx", "idx", F.col("span_start").asc_nulls_last())


@query("j08_unmentioned_entries", sql("seg gloss alias", _TERMS + " SELECT id, project_id FROM gloss WHERE id NOT IN (SELECT entry_id FROM sh)"))
def j08(t: Tables) -> DataFrame:
    found = matching.segment_counts(matching.source_texts(t.segment), matching.entry_terms(t.glossary, t.alias, "source")).select(F.col("entry_id").alias("id"))
    return t.glossary.join(found, "id", "left_anti").select("id", "project_id")


@query("g03_target_uses", sql("seg gloss alias", _TERMS + " SELECT segment_id, entry_id FROM th"))
def g03(t: Tables) -> DataFrame:
    return matching.pairs(matching.target_texts(t.segment), matching.entry_terms(t.glossary, t.alias, "target"))


_LOST = _TERMS + """
    , lost AS (SELECT sh.segment_id, sh.entry_id, CASE WHEN g.status = 'locked' AND g.source_known THEN 'error' ELSE 'warning' END AS severity
    FROM sh JOIN gloss g ON g.id = sh.entry_id JOIN seg s ON s.id = sh.segment_id WHERE g.status <> 'proposed' AND s.target_text IS NOT NULL AND NOT EXISTS (SELECT 1 FROM th WHERE th.segment_id = sh.segment_id AND th.entry_id = sh.entry_id))
"""


@query("g14_j07_missing_targets", sql("seg gloss alias", _LOST + " SELECT * FROM lost"))
def g14(t: Tables) -> DataFrame:
    return matching.missing_targets(t.segment, t.glossary, t.alias)


@query("g15_flagging_segments", sql("seg gloss alias", _LOST + " SELECT segment_id, bool_or(severity = 'error') AS locked_violation, count(*) AS violations FROM lost GROUP BY 1"))
def g15(t: Tables) -> DataFrame:
    return matching.flagged(t.segment, t.glossary, t.alias)


@query("f26_f27_relevant_entries", sql("seg gloss alias", _TERMS + " SELECT s.id AS segment_id, list_sort(list(sh.entry_id)) AS entries FROM seg s JOIN sh ON sh.segment_id = s.id WHERE s.status = 'pending' GROUP BY 1"))
def f26(t: Tables) -> DataFrame:
    pending = matching.source_texts(t.segment.where("status = 'pending'"))
    found = matching.mentions(pending, matching.entry_terms(t.glossary, t.alias, "source")).select("segment_id", "entry_id").distinct()
    return found.groupBy("segment_id").agg(F.array_sort(F.collect_list("entry_id")).alias("entries"))


_CHANGED = """
    , ch AS (SELECT id, project_id, source_term, target_term AS previous_target FROM gloss WHERE status = 'locked' AND source_term <> ''),
    live AS (SELECT * FROM seg WHERE status <> 'pending'),
    a AS (SELECT s.id AS segment_id, c.id AS entry_id FROM live s JOIN ch c ON c.project_id = s.project_id WHERE """ + _hit("s.source_text", "c.source_term") + """),
    b AS (SELECT s.id AS segment_id, c.id AS entry_id FROM live s JOIN ch c ON c.project_id = s.project_id WHERE """ + _hit("s.target_text", "c.previous_target") + """),
    aff AS (SELECT coalesce(a.segment_id, b.segment_id) AS segment_id, coalesce(a.entry_id, b.entry_id) AS entry_id,
        CASE WHEN a.segment_id IS NOT NULL AND b.segment_id IS NOT NULL THEN 'source+target match' WHEN a.segment_id IS NOT NULL THEN 'source match' ELSE 'previous target match' END AS reason
        FROM a FULL JOIN b ON a.segment_id = b.segment_id AND a.entry_id = b.entry_id)
"""


def changed(t: Tables) -> DataFrame:
    return t.glossary.where("status = 'locked' AND source_term <> ''").select("id", "project_id", "source_term", F.col("target_term").alias("previous_target"))


@query("z11_cascade_preview", sql("seg gloss", _CHANGED + " SELECT * FROM aff"))
def z11(t: Tables) -> DataFrame:
    return matching.affected(t.segment, changed(t))


_NOUN = f" (?:{'|'.join(terms.TRAILING_NOUNS)})$"
_BLANK = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def _compatible_sql(c: str) -> str:
    """NFKC for what the tables hold: wide forms, blanks, ligatures, small numerals and three single letters, then composition."""
    u = "unicode(x)"
    one = f"""CASE WHEN {u} BETWEEN 65281 AND 65374 THEN chr({u} - 65248) WHEN {u} IN (160, 8239, 8287, 12288) OR {u} BETWEEN 8192 AND 8202 THEN ' '
        WHEN {u} BETWEEN 64256 AND 64262 THEN ['ff', 'fi', 'fl', 'ffi', 'ffl', 'st', 'st'][{u} - 64255]
        WHEN {u} BETWEEN 8560 AND 8575 THEN ['i', 'ii', 'iii', 'iv', 'v', 'vi', 'vii', 'viii', 'ix', 'x', 'xi', 'xii', 'l', 'c', 'd', 'm'][{u} - 8559]
        WHEN {u} = 1010 THEN 'ς' WHEN {u} = 8490 THEN 'K' WHEN {u} = 8209 THEN '‐' ELSE x END"""
    return f"nfc_normalize(array_to_string(list_transform(string_split({c}, ''), lambda x: {one}), ''))"


def _canon_sql(c: str) -> str:
    marks = r"[.,;:!?·\-…—–]+$"
    trim = lambda x: f"regexp_replace({x}, '^{_BLANK}+|{_BLANK}+$', '', 'g')"
    out = trim(f"regexp_replace(lower({trim(_compatible_sql(c))}), '{marks}', '')")
    out = f"regexp_replace({out}, '{_BLANK}+', ' ', 'g')"
    for _ in range(4):
        out = trim(f"regexp_replace({out}, '{_NOUN}', '')")
        out = trim(f"regexp_replace({out}, '\\s*\\([^()]*\\)\\s*$|\\s*\\([^()]*$', '')")
    return trim(f"regexp_replace({out}, '{marks}', '')")


def _edits_sql(a: str, b: str) -> str:
    """Edits between characters: both texts are spelled in the ASCII signs of their own alphabet first, as DuckDB counts bytes."""
    alphabet = f"list_distinct(string_split({a} || {b}, ''))"
    coded = lambda c: f"array_to_string(list_transform(string_split({c}, ''), lambda x: chr(33 + list_position({alphabet}, x)::INT)), '')"
    return f"levenshtein({coded(a)}, {coded(b)})"


_KEYED = f"""
    , k0 AS MATERIALIZED (SELECT id, project_id, status, type, source_term, {_canon_sql("coalesce(nullif(source_term, ''), target_term)")} AS key FROM gloss), keyed AS (SELECT * FROM k0 WHERE key <> '')
"""


@query("e01_g05_g07_canonical_keys", sql("gloss", _KEYED + " SELECT id, key FROM keyed"))
def e01(t: Tables) -> DataFrame:
    return resolution.canonical_keys(t.glossary).select("id", "key")


_EDGES = _KEYED + f"""
    , d AS (SELECT DISTINCT project_id, key FROM keyed),
    e AS (SELECT x.project_id AS scope, x.key AS a, y.key AS b FROM d x JOIN d y ON x.project_id = y.project_id AND x.key < y.key AND abs(length(x.key) - length(y.key)) <= 2
          WHERE left(x.key, least(3, length(x.key), length(y.key))) = left(y.key, least(3, length(x.key), length(y.key))) AND {_edits_sql('x.key', 'y.key')} <= 2)
"""


@query("e02_g06_j13_fuzzy_edges", sql("gloss", _EDGES + " SELECT * FROM e"))
def e02(t: Tables) -> DataFrame:
    keys = resolution.canonical_keys(t.glossary).select(F.col("project_id").alias("scope"), "key").distinct()
    return resolution.fuzzy_edges(keys)


_GROUPS = """
    , bidi AS (SELECT scope, a, b FROM e UNION SELECT scope, b, a FROM e),
    reach AS (SELECT project_id AS scope, key AS a, key AS b FROM d UNION SELECT r.scope, r.a, x.b FROM reach r JOIN bidi x ON x.scope = r.scope AND x.a = r.b),
    root AS (SELECT scope, a AS key, min(b) AS root FROM reach GROUP BY 1, 2),
    l AS (SELECT k.*, r.root, count(*) OVER (PARTITION BY k.project_id, r.root) AS n FROM keyed k JOIN root r ON r.scope = k.project_id AND r.key = k.key),
    grp AS (SELECT project_id, root, id, first_value(id) OVER (PARTITION BY project_id, root ORDER BY CASE status WHEN 'locked' THEN 0 WHEN 'confirmed' THEN 1 WHEN 'proposed' THEN 2 ELSE 99 END, type = 'term', id) AS winner FROM l WHERE n > 1)
"""


@query("e03_e04_o08_near_duplicates", sql("gloss", _EDGES + _GROUPS + " SELECT * FROM grp"))
def e03(t: Tables) -> DataFrame:
    return resolution.near_duplicates(t.glossary)


@query("e07_canonical_lookup", sql("gloss", _KEYED + """
    , held AS (SELECT DISTINCT ON (project_id, key) project_id, key, id AS held_id FROM keyed WHERE status <> 'proposed' ORDER BY project_id, key, source_term NULLS FIRST, id)
    SELECT k.project_id, k.key, k.id, h.held_id FROM keyed k LEFT JOIN held h ON h.project_id = k.project_id AND h.key = k.key WHERE k.status = 'proposed'"""))
def e07(t: Tables) -> DataFrame:
    g = t.glossary
    return resolution.canonical_lookup(g.where("status = 'proposed'"), g.where("status <> 'proposed'")).select("project_id", "key", "id", "held_id")
