"""Entity resolution on entries of every script, against brute force."""

from __future__ import annotations

import itertools
import random
import re
import unicodedata

from pyspark.sql import functions as F

from quillmill.functions import terms
from quillmill.operators import resolution, writes
from quillmill.plans import registry
from tests.test_operators import lev

registry.load()
Q = registry.QUERIES
MARKS = ".,;:!?·-…—–"
NOUN = re.compile(rf"\s+(?:{'|'.join(terms.TRAILING_NOUNS)})$", re.IGNORECASE)
PAREN = re.compile(r"\s*\([^()]*\)\s*$|\s*\([^()]*$")

TERMS = [
    "Bohemia", "Bohémia", "bohémia.", "Bohémias", "Élise", "ÉLISE (a)", "Elise", "Ёлкино", "ёлкина", "Ёлка", "Ωμέγα", "ωμεγα", "Ὀδυσσεύς", "東京", "東京都", "京", "京都", "東", "鍵の国", "鍵の園", "𠮷野", "𠮷野家",
    "Zürich council", "zürich", "Zur​ich", "naïve—", "naive", "Curaçao", "Curacao", "Señor", "Senor", "São (x) company", "—", "", None,
]


def canonical(term):
    text = re.sub(r"\s+", " ", unicodedata.normalize("NFKC", term or "").strip().lower().rstrip(MARKS).strip())
    for _ in range(4):
        text = PAREN.sub("", NOUN.sub("", text).strip()).strip()
    return text.rstrip(MARKS).strip()


def glossary(spark, folder, words):
    """The terms in two projects, the last of each as target-only entries; statuses in turn."""
    rows = []
    for p in "pq":
        for k, w in enumerate(words[: len(words) if p == "p" else len(words) // 2]):
            rows.append((f"{p}{k:02d}", p, "term" if k % 3 else "place", None if k % 5 == 4 else w, w if k % 5 == 4 else f"t{k}", ("locked", "confirmed", "proposed")[k % 3]))
    spark.createDataFrame(rows, "id string, project_id string, type string, source_term string, target_term string, status string").write.parquet(f"{folder}/glossary_entry.parquet")
    return [(*r, canonical(r[3] or r[4])) for r in rows]


def brute_edges(rows):
    out = set()
    for (p, a), (q, b) in itertools.combinations(sorted({(r[1], r[6]) for r in rows if r[6]}), 2):
        n = min(3, len(a), len(b))
        if p == q and a[:n] == b[:n] and lev(a, b) <= 2:
            out.add((p, a, b))
    return out


def brute_groups(rows):
    root = {(r[1], r[6]): r[6] for r in rows if r[6]}
    edges = brute_edges(rows)
    for _ in root:
        for p, a, b in edges:
            root[p, a] = root[p, b] = min(root[p, a], root[p, b])
    groups = {}
    for r in rows:
        if r[6]:
            groups.setdefault((r[1], root[r[1], r[6]]), []).append(r)
    rank = lambda r: (("locked", "confirmed", "proposed").index(r[5]), r[2] == "term", r[0])
    return {(p, k, r[0], min(g, key=rank)[0]) for (p, k), g in groups.items() if len(g) > 1 for r in g}


def brute_lookup(rows):
    held = {}
    for r in sorted((r for r in rows if r[6] and r[5] != "proposed"), key=lambda r: (r[3] is not None, (r[3] or "").encode(), r[0])):
        held.setdefault((r[1], r[6]), r[0])
    return {(r[1], r[6], r[0], held.get((r[1], r[6]))) for r in rows if r[6] and r[5] == "proposed"}


def check(spark, folder, rows):
    got = lambda name, *cols: {tuple(r[c] for c in cols) for r in Q[name](spark, str(folder)).collect()}
    assert got("e01_g05_g07_canonical_keys", "id", "key") == {(r[0], r[6]) for r in rows if r[6]}
    assert got("e02_g06_j13_fuzzy_edges", "scope", "a", "b") == brute_edges(rows)
    assert got("e03_e04_o08_near_duplicates", "project_id", "root", "id", "winner") == brute_groups(rows)
    assert got("e07_canonical_lookup", "project_id", "key", "id", "held_id") == brute_lookup(rows)


def test_queries_take_every_script(spark, tmp_path):
    rows = glossary(spark, tmp_path, TERMS + [w + "s" for w in TERMS if w])
    assert sum(not r[6].isascii() for r in rows) > 30
    check(spark, tmp_path, rows)


SPELLINGS = [
    "FIFA", "ＦＩＦＡ", "\ufb01fa", "Bohémia", "Bohe\u0301mia", "House Stark", "House\u00a0Stark", "Ｈｏｕｓｅ\u3000Stark．", "パリ", "ﾊﾟﾘ", "Acme", "Acme Ｃｏｍｐａｎｙ", "Foo\uff08Bar\uff09", "foo", "Ⅳ", "iv", "\u3000",
]


def test_queries_join_compatible_spellings(spark, tmp_path):
    rows = glossary(spark, tmp_path, SPELLINGS)
    check(spark, tmp_path, rows)
    keys = {r[3] or r[4]: r[6] for r in rows if r[1] == "p"}
    assert keys["FIFA"] == keys["ＦＩＦＡ"] == keys["\ufb01fa"] == "fifa" and keys["House Stark"] == keys["Ｈｏｕｓｅ\u3000Stark．"]


def test_merges_and_upserts_join_compatible_spellings(spark):
    e = spark.createDataFrame([("a", "p", "place", "FIFA", "f", "locked"), ("b", "p", "term", "ＦＩＦＡ", "g", "proposed"), ("c", "p", "term", "\ufb01fa", "h", "proposed")], "id string, project_id string, type string, source_term string, target_term string, status string")
    none = spark.createDataFrame([], "entry_id string, side string, text string")
    left, aliases = resolution.merge(e, none, resolution.near_duplicates(e))
    assert [r["id"] for r in left.collect()] == ["a"]
    assert {(r["entry_id"], r["text"]) for r in aliases.where("side = 'source'").collect()} == {("a", "ＦＩＦＡ"), ("a", "\ufb01fa")}
    p = spark.createDataFrame([("p", "ＦＩＦＡ", "term", "x", None, None), ("p", "Ｎｅｗ", "term", "x", None, None), ("p", "New", "term", "x", None, None)], "project_id string, source_term string, type string, target_term string, source_lang string, target_lang string")
    held = e.where("id = 'a'").withColumn("created_at", F.lit(1)).withColumn("updated_at", F.lit(1).cast("long"))
    up = writes.upsert(held, none, p, 9)
    assert {r["source_term"]: r["action"] for r in up.outcomes.collect()} == {"ＦＩＦＡ": "folded", "New": "created", "Ｎｅｗ": "folded"}
    assert {(r["entry_id"] == "a", r["text"]) for r in up.aliases.collect()} == {(True, "ＦＩＦＡ"), (False, "Ｎｅｗ")}


def test_fuzzy_edges_of_every_length(spark):
    """Keys of one letter to a dozen, many of them near each other, against brute force."""
    rng = random.Random(8)
    words = set()
    while len(words) < 900:
        w = "".join(rng.choices("ab京", k=rng.randint(1, 12)))
        words |= {w, w[: rng.randint(1, len(w))], w + rng.choice("ab"), w[:-1] + "b" if len(w) > 1 else w}
    keys = spark.createDataFrame([(p, w) for w in words for p in "pq"[: 1 + (len(w) % 2)]], "scope string, key string")
    got = [tuple(r) for r in resolution.fuzzy_edges(keys).collect()]
    want = {(p, a, b) for a, b in itertools.combinations(sorted(words), 2) for p in "pq" if p == "p" or len(a) % 2 and len(b) % 2
            if abs(len(a) - len(b)) <= 2 and a[: min(3, len(a), len(b))] == b[: min(3, len(a), len(b))] and lev(a, b) <= 2}
    assert set(got) == want and len(got) == len(want)


def test_short_keys_do_not_all_meet(spark):
    """Names of two to four letters that share nothing are never joined."""
    keys = [chr(0x4E00 + 7 * k) + chr(0x4E00 + 11 * k + 1) + ("" if k % 3 else "港") for k in range(80)]
    sig = spark.createDataFrame([("p", k) for k in keys], "scope string, key string").mapInPandas(resolution._signatures, "scope string, key string, head string, len int, part int, piece string, stored boolean, asks boolean")
    on = ["scope", "head", "len", "part", "piece"]
    assert sig.where("stored").join(sig.where("asks").withColumnRenamed("key", "other"), on).where("key <> other").count() < 20
