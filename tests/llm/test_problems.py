"""The nine operators on small fixtures: brute force, edge cases, repeated rows, clashing columns, empty tables."""

from __future__ import annotations

import itertools
import random

import pytest
from hypothesis import given, settings, strategies as st

from quillmill.llm import encoding, harmonise, mixing, names, packing, queries, reading, responses, splitting, textnorm

SEGMENT = "id string, chapter_id string, project_id string, idx int, source_text string, target_text string, status string, loaded_at timestamp, text string, owner string"
PROJECT = "id string, source_lang string, target_lang string, name string"
TRACE = "id string, segment_id string, project_id string, model string, target string, source string"


def seg(id, text, target=None, status="translated", project="p", chapter="c", idx=0):
    return (id, chapter, project, idx, text, target, status, None, "clash", "clash")


# ---------------------------------------------------------------- 1


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, "table_name string, id string, raw string, form string")
    return sorted(map(tuple, harmonise.look_alike_pairs(harmonise.harmonise(df)).collect()))


def t(id, raw, table="segment"):
    return (table, id, raw, "a column in the way")


def test_p1_finds_each_kind_of_disguise(spark):
    base = "The café stored Ωρίων. Анна left"
    rows = [
        t("a", base), t("b", "Ｔhe café stored Ωρίων. Анна left"), t("c", "The café stored Ωρίων. Анна left"),
        t("d", "The café stored Ωρίων. Анна left"), t("e", "The ca​fé sto­red Ωρίων. Анна left"),
        t("f", "Thе cаfé stоrеd Ωρίων. Анна left"), t("g", "The café ﬆored Ωρίων. Анна left"), t("h", "The café stored Ωρίων. Aннa left"),
        t("x", "The cafe stored Ωρίων. Анна left"), t("y", "the café stored Ωρίων. Анна left"), t("z", "The café stored Ωρίων, Анна left"),
    ]
    expected = [("segment", a, b) for a, b in itertools.combinations("abcdefgh", 2)]
    assert pairs_of(spark, rows) == expected


def test_p1_edges(spark):
    rows = [
        t("n", None), t(None, "word"), t("e1", ""), t("e2", " "), t("e3", "﻿​"), t("m1", "[[T0]][[/T0]]"), t("m2", "[[T0]]​[[/T0]]"),
        t("q", "same text"), t("q", "same text"), t("r", "same text"), t("s", "same text"), t("s", "same text", "glossary_entry"),
        t("long1", "word " * 20000), t("long2", "word " * 20000),
    ]
    assert pairs_of(spark, rows) == [("segment", "long1", "long2"), ("segment", "q", "s"), ("segment", "r", "s")]
    assert pairs_of(spark, []) == []


def test_p1_two_damaged_spellings_meet(spark):
    # the undamaged name occurs nowhere
    assert pairs_of(spark, [t("a", "Νelrοda"), t("b", "Nelroԁа")]) == [("segment", "a", "b")]
    # a token that another script can show alone stays where the corpus knows no Latin word for it
    forms = harmonise.harmonise(spark.createDataFrame([t("a", "сор"), t("b", "Анна")], "table_name string, id string, raw string, form string")).collect()
    assert {r["id"]: r["form"] for r in forms} == {"a": "сор", "b": "Анна"}


def forms_of(spark, texts):
    rows = [("segment", f"{k}", x) for k, x in enumerate(texts)]
    got = {r["id"]: r["form"] for r in harmonise.harmonise(spark.createDataFrame(rows, "table_name string, id string, raw string")).collect()}
    return [got[f"{k}"] for k in range(len(texts))]


def test_p1_russian_stays_beside_latin(spark):
    russian = ["а сор и с вами", "сор", "Он у окна, а сор там", "а", "с"]
    assert forms_of(spark, ["a c y cop", *russian])[1:] == russian
    # in a Latin sentence the same letters are look-alikes, and a mixed token is weighed by its own script first
    assert forms_of(spark, ["a good cop left", "a gооd сор left", "Анна там", "Аннa там"]) == ["a good cop left", "a good cop left", "Анна там", "Анна там"]


def test_p1_letters_beyond_latin_1(spark):
    assert forms_of(spark, ["Wąsowo nad rzeką", "Wąsоwо nad rzeką", "cœur ça", "сœur ça", "Ꮪoul and ոight", "Soul and night"]) == [
        "Wąsowo nad rzeką", "Wąsowo nad rzeką", "cœur ça", "cœur ça", "Soul and night", "Soul and night"]


def test_p1_classes(spark):
    rows = [t("a", "the good cat"), t("b", "the gооd cat"), t("c", "the good cat"), t("d", "the good  cat"), t("d", "the good  cat"), t("e", "other"), t("f", "other")]
    df = spark.createDataFrame(rows, "table_name string, id string, raw string, form string")
    got = sorted(tuple(r) for r in harmonise.look_alike_classes(harmonise.harmonise(df)).collect())
    assert got == [("segment", "a", "a", 4, 3, 2), ("segment", "b", "a", 4, 3, 3), ("segment", "c", "a", 4, 3, 2), ("segment", "d", "a", 4, 3, 3)]
    assert sum(x[5] for x in got) == 2 * len(pairs_of(spark, rows))


def test_p1_hot_class_is_blocked(spark):
    rows = [t(f"{k:05d}", "a b" if k % 2 else "a b") for k in range(300)]
    old, harmonise.BLOCK_ROWS = harmonise.BLOCK_ROWS, 20
    try:
        got = pairs_of(spark, rows)
    finally:
        harmonise.BLOCK_ROWS = old
    assert len(got) == 150 * 150 and len(set(got)) == len(got)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=60))
def test_p1_repair_is_idempotent(s):
    once = textnorm.repair_characters(s)
    assert textnorm.repair_characters(once) == once


# ---------------------------------------------------------------- 2

ENTRY = "id string, project_id string, type string, source_term string, target_term string, loaded_at timestamp, kind string, form string"
NICK = "given_name string, nickname string, id string"


def linked(spark, entries, nick=(("Robert", "Bob", "x"),)):
    """Linked pairs of entries (id, project, type, source, target)."""
    e = spark.createDataFrame([(i, p, k, s, u, None, "clash", "clash") for i, p, k, s, u in entries], ENTRY)
    out = names.entity_pairs(names.link_entries(e, spark.createDataFrame(list(nick), NICK)))
    return sorted(map(tuple, out.collect()))


def test_p2_rewritings(spark):
    same = [
        ("a", "p", "character", "Captain Robert Halvorsen", "Capitán Robert Halvorsen"), ("b", "p", "character", "Halvorsen, Robert", "Robert Halvorsen"),
        ("c", "p", "character", "Bob Halvorsen", "Bob Halvorsen"), ("d", "p", "character", "R. Halvorsen", "R. Halvorsen"),
        ("e", "p", "term", "Robert Halvrosen", "Robert Halvorsen"), ("f", "p", "character", None, "ROBERT HALVORSEN"), ("g", "p", "character", "Rоbert Hаlvorsen", "Robert Hálvörsen"),
    ]
    other = [
        ("o", "q", "character", "Robert Halvorsen", "Robert Halvorsen"), ("r", "p", "character", "Dorothea Halvorsen", "Dorothea Halvorsen"),
        ("s", "p", "organization", "Halvorsen Brotherhood", "Hermandad de Halvorsen"), ("u", "p", "item", "Robert Halvorsen", "Robert Halvorsen"),
        ("v", "p", "term", "the door", "la puerta"), ("w", "p", "term", "the door", "la puerta"),
    ]
    assert linked(spark, same + other) == list(itertools.combinations("abcdefg", 2))


def test_p2_namesakes_stay_apart(spark):
    rows = [
        ("a", "p", "organization", "First Morwen Academy", "Primera Academia de Morwen"), ("b", "p", "organization", "Second Morwen Academy", "Segunda Academia de Morwen"),
        ("c", "p", "organization", "The First Morwen Acad.", "Primera Academia Morwen"), ("d", "p", "character", "Robert Morwen the Elder", "Robert Morwen el Viejo"),
        ("e", "p", "character", "Robert Morwen the Younger", "Robert Morwen el Mozo"), ("f", "p", "place", "Morwen Castle", "Castillo de Morwen"),
        ("h", "p", "character", "R. Tarsolven", "R. Tarsolven"), ("i", "p", "character", "Robert Tarsolven", "Robert Tarsolven"), ("j", "p", "character", "Rosalind Tarsolven", "Rosalind Tarsolven"),
    ]
    assert linked(spark, rows) == [("a", "c")]


def test_p2_near_namesakes_and_double_slips(spark):
    rows = [
        ("a", "p", "place", "Pakasaro Island", "Isla de Pakasaro"), ("b", "p", "place", "Papasaro Island", "Isla de Papasaro"),  # two places
        ("c", "p", "place", "Pakasaor Island", "Isla de Pakasaro"), ("d", "p", "place", "Isle of Papaasro", "Isla de Papasaro"),
        ("e", "p", "organization", "Quonorvingil Academy", "Academia de Quonorvingil"), ("f", "p", "organization", "Quononvingil Academy", "Academia de Quonorinil"),
        ("g", "p", "character", "Kpt. Yolanda Wendohalsel", "Captain Y. Wendohalsel"), ("h", "p", "character", "Kapitän Yolanda Wendohalsel", "Captain Yolanda Wendohalsel"),
        ("i", "p", "organization", None, "Rasakelro商会"), ("j", "p", "organization", "Rasakelro Trading Company", "Rasakelro商会"),
    ]
    assert linked(spark, rows) == [("a", "c"), ("b", "d"), ("e", "f"), ("g", "h"), ("i", "j")]


def test_p2_different_entities_stay_apart(spark):
    two = lambda i, t, *names: [(f"{i}{k}", i, t, n, n) for k, n in enumerate(names)]
    rows = (
        two("a", "place", "North Carolina", "South Carolina") + two("b", "organization", "Bank of England", "Church of England") + two("c", "organization", "Acme Limited", "Nova Limited")
        + two("d", "character", "George H. W. Bush", "George W. Bush") + two("e", "character", "Captain Ana Moreno", "Doctor Ana Moreno", "Ana Moreno")
        + two("f", "organization", "Acme GmbH", "Acme Ltd") + two("g", "place", "Lake Olmen", "Olmen River")
    )
    assert linked(spark, rows) == []


def test_p2_ordinary_variants_are_linked(spark):
    two = lambda i, t, *names: [(f"{i}{k}", i, t, n, n) for k, n in enumerate(names)]
    rows = (
        two("a", "organization", "Acme Ltd", "Acme Limited", "Acme Ltd.", "Acme") + two("b", "character", "Ana Perez", "Ana Peres") + two("c", "place", "the Hague", "The Hague")
        + [("d0", "d", "character", "Ana Olem", "Ana Olem"), ("d1", "d", "character", "Ana Oelm", "Ana Olem")] + two("e", "organization", "Nova S.A.", "Nova SA")
        + two("f", "character", "Captain Ana Moreno", "Ana Moreno") + two("g", "place", "Carolina, North", "North Carolina")
    )
    assert linked(spark, rows) == sorted(
        [*itertools.combinations(["a0", "a1", "a2", "a3"], 2), ("b0", "b1"), ("c0", "c1"), ("d0", "d1"), ("e0", "e1"), ("f0", "f1"), ("g0", "g1")])


def test_p2_rarity_decides(spark):
    rows = [("a", "p", "character", "Robert Morwen", "Robert Morwen"), ("b", "p", "character", "Dorothea Morwen", "Dorothea Morwen"), ("c", "p", "character", "Morwen", "Morwen"), ("d", "p", "character", "R. Morwen", "R. Morwen")]
    e = spark.createDataFrame([(i, p, k, s, u, None, "clash", "clash") for i, p, k, s, u in rows], ENTRY)
    got = {(r["id"], r["form"], r["rarity"], r["linked"]) for r in names.scored_links(e, spark.createDataFrame([], NICK)).collect()}
    assert ("c", "weak", 0.5, False) in got and ("d", "weak", 1.0, True) in got
    assert linked(spark, rows, []) == [("a", "d")]


def test_p2_edges(spark):
    rows = [("a", "p", "character", "", ""), ("b", "p", "character", None, "..."), ("c", None, "character", "Ann Orlandsen", "Ann Orlandsen"), ("d", "p", None, "x", "y"),
            ("e", "p", "character", "Ann Orlandsen", "Ann Orlandsen"), ("e", "p", "character", "Ann Orlandsen", "Ann Orlandsen"), ("f", "p", "character", "Ann " + "Orlandsen" * 200, "Ann Orlandsen")]
    assert linked(spark, rows) == [("e", "f")]
    assert linked(spark, []) == []
    assert linked(spark, [("a", "p", "place", "Port Olm", "Port Olm")], []) == []


# ---------------------------------------------------------------- 3 and 5


def corpus(n=60):
    """Enough clean segments for the words of two languages to be known."""
    subj, verb, obj = ["the road", "the boat", "the wolf"], ["found", "left", "took"], ["the letter", "the garden", "the bell"]
    tr = {"the road": "el camino", "the boat": "el barco", "the wolf": "el lobo", "found": "encontró", "left": "dejó", "took": "tomó", "the letter": "la carta", "the garden": "el jardín", "the bell": "la campana"}
    rows = []
    for k in range(n):
        s, v, o = subj[k % 3], verb[k // 3 % 3], obj[k // 9 % 3]
        en, es = f"{s} {v} {o} with great care.", f"{tr[s]} {tr[v]} {tr[o]} con mucho cuidado."
        rows.append(seg(f"ok{k:03d}", en.capitalize() + f" Number {k}.", es.capitalize() + f" Número {k}.", idx=k))
        rows.append(seg(f"back{k:03d}", es.capitalize(), en.capitalize(), project="q", idx=k))
    return rows


def frames(spark, segments, traces=()):
    return (
        spark.createDataFrame(segments, SEGMENT), spark.createDataFrame(list(traces), TRACE),
        spark.createDataFrame([("p", "en", "es", "x"), ("q", "es", "en", "y")], PROJECT),
    )


BAD = [
    ("e1", "The road left the garden.", None, "empty"), ("e2", "The road left the garden.", " ﻿[[T0]][[/T0]]", "empty"),
    ("r1", "The road left the garden.", "Lo siento, pero no puedo traducir este fragmento.", "refusal"), ("r2", "The wolf found the bell.", "[I can't translate this passage. Please try another one.]", "refusal"),
    ("c1", "The boat took the letter with great care.", "The boat took the letter with great care.", "copy"), ("c2", "The boat took the letter with great care.", "Translation: THE BOAT took the letter with great care", "copy"),
    ("w1", "The boat took the letter with great care. The road left the bell.", "O wolf found the garden with care. The road took the bell with great care and left.", "wrong_language"),
    ("t1", "The boat took the letter with great care. The road left the bell.", "El barco tomó la carta con mucho cuidado. El cam", "truncated"),
    ("t2", "The boat took the letter with great care.", "El barco tomó la carta...", "truncated"), ("t3", "[[T0]]The boat[[/T0]] took the letter.", "[[T0]]El barco[[/T0]", "truncated"),
]
GOOD = [
    ("g1", "1764", "1764"), ("g2", "AB-12 7", "AB-12 7"), ("g3", "Halvor Tarsolven", "Halvor Tarsolven"), ("g4", "the garden, the bell", "el jardín, la campana"),
    ("g5", '"I can\'t translate this passage," said Olm.', '"No puedo traducir este pasaje", dijo Olm.'), ("g6", "​", None), ("g7", "The road left—", "El camino dejó—"),
    ("g8", "Chapter 3: The bell", "Capítulo 3: La campana"), ("g9", "The wolf took the bell...", "El lobo tomó la campana..."),
]


def test_p3_and_p5(spark):
    rows = corpus() + [seg(i, s, u) for i, s, u, _ in BAD] + [seg(i, s, u) for i, s, u in GOOD] + [seg("pend", "The road left.", None, "pending"), seg("c1", *BAD[4][1:3])]
    traces = [(f"t-{i}", i, "p", "m", u, "clash") for i, _, u, _ in BAD] + [("orphan", "nowhere", "p", "m", "x", "c"), (None, "c1", "p", "m", "", "c"), ("t-c1", "c1", "p", "m", BAD[4][2], "clash")]
    args = frames(spark, rows, traces)
    got = sorted(map(tuple, responses.defects(*args).collect()))
    assert got == sorted([("segment", i, d) for i, _, _, d in BAD] + [("translator_trace", f"t-{i}", d) for i, _, _, d in BAD])
    lost = {(r["table_name"], r["record_id"]) for r in responses.truncated(*args).collect()}
    assert lost == {(a, b) for a, b, d in got if d == "truncated"}
    rates = {(r["table_name"], r["owner"]): (r["records"], r["truncated"]) for r in responses.truncation_rates(*args).collect()}
    assert rates["segment", "p"] == (60 + len(BAD) + len(GOOD), 3) and rates["translator_trace", "m"] == (len(BAD) + 1, 3)


def test_p3_empty_tables(spark):
    assert responses.defects(*frames(spark, [])).count() == 0
    assert responses.truncated(*frames(spark, [])).count() == 0
    assert responses.truncation_rates(*frames(spark, [])).count() == 0


def test_p3_shortened_neighbour(spark):
    """A whole-looking answer is cut where a longer answer of the segment goes on from it."""
    src = "The boat took the letter with great care. The road left the bell with great care. The wolf found the garden."
    full = "El barco tomó la carta con mucho cuidado. El camino dejó la campana con mucho cuidado. El lobo encontró el jardín."
    args = frames(spark, corpus() + [seg("s", src, full)], [("short", "s", "p", "m", "El barco tomó la carta con mucho cuidado.", "c"), ("full", "s", "p", "m", full, "c")])
    assert [tuple(r) for r in responses.defects(*args).collect()] == [("translator_trace", "short", "truncated")]


def test_p3_short_answers_meet_longer_ones(spark):
    """An answer of a few letters, whole-looking, beside the one that goes on."""
    src = "The boat took the letter. The road left the bell with great care."
    args = frames(spark, corpus() + [seg("s", src, "Sí. El camino dejó la campana con mucho cuidado.")], [("short", "s", "p", "m", "Sí.", "c"), ("other", "s", "p", "m", "El barco tomó la carta. El camino dejó la campana con mucho cuidado.", "c")])
    assert [tuple(r) for r in responses.defects(*args).collect()] == [("translator_trace", "short", "truncated")]
    assert [(r["record_id"], r["shortened"]) for r in responses.truncated(*args).collect()] == [("short", True)]


def test_p3_arithmetic_and_broken_marks(spark):
    rows = corpus() + [seg("sum", "3 x 52 = 5", "3 x 52 = 5"), seg("mark", "[[T0]]The boat[[/T0]] [[T1]] & the road.", "[[T0]]…[[/T0]][[T1]&am")]
    assert {tuple(r) for r in responses.defects(*frames(spark, rows)).collect()} == {("segment", "mark", "truncated")}


def test_p3_longer_versions_against_brute_force(spark):
    rng = random.Random(11)
    rows = {("hot" if rng.random() < 0.6 else f"s{rng.randint(0, 9)}", "".join(rng.choices("ab ", k=rng.randint(0, 9)))) for _ in range(600)} | {("s1", "x"), ("s2", "xy"), (None, "x")}
    got = {tuple(r) for r in responses.longer_versions(spark.createDataFrame(list(rows), "segment_id string, text string")).collect()}
    assert got == {(s, t) for s, t in rows if s is not None and t and any(s == s2 and u != t and u.startswith(t) for s2, u in rows)}


def judged_lengths(spark, rows):
    """rows(table, owner, id, length, open) as judged records without another defect."""
    return spark.createDataFrame([(*r[:4], r[3], None, r[4]) for r in rows], "table_name string, owner string, record_id string, length int, bytes int, defect string, open boolean")


def significant(spark, rows):
    h = responses.length_hazards(responses.ends_by_length(judged_lengths(spark, rows)))
    return {(r["owner"], r["cause"], r["length"]) for r in h.where("significant AND unit = 'chars'").collect()}


def test_p5_hazards_find_a_field_limit(spark):
    rng = random.Random(5)
    rows = [("segment", "p", f"p{k}", min(100, rng.randint(20, 160)), False) for k in range(400)] + [("segment", "q", f"q{k}", rng.randint(20, 160), False) for k in range(400)]
    assert significant(spark, rows) == {("p", "any", 100), (None, "any", 100)}


def test_p5_hazards_of_incomplete_ends(spark):
    """Few cut values among many whole ones: the hazard of incomplete ends shows them, and a limit shared by many small sources shows over the table."""
    rng = random.Random(6)
    rows = [("segment", "p", f"w{k}", rng.randint(20, 160), False) for k in range(3000)] + [("segment", "p", f"c{k}", 120, True) for k in range(6)] + [("segment", "p", f"o{k}", rng.randint(20, 160), True) for k in range(20)]
    assert ("p", "incomplete", 120) in significant(spark, rows) and ("p", "any", 120) not in significant(spark, rows)
    many = [("translator_trace", f"m{k % 50}", f"w{k}", rng.randint(20, 160), False) for k in range(3000)] + [("translator_trace", f"m{k}", f"c{k}", 120, True) for k in range(12)]
    assert {(o, c, n) for o, c, n in significant(spark, many) if c == "incomplete"} == {(None, "incomplete", 120)}


# ---------------------------------------------------------------- 4


@settings(max_examples=300, deadline=None)
@given(st.lists(st.sampled_from(["word ", "a", "[[T0]]", "[[/T12]]", ". ", "、", "\n\n", ", ", "x" * 30, "。", "é "]), max_size=120), st.integers(12, 80), st.integers(-5, 60))
def test_p4_pieces_hold(parts, limit, overlap):
    text = "".join(parts)
    cuts = splitting.split(text, limit, overlap)
    assert all(b - a <= limit for a, b in cuts) and cuts[0][0] == 0 and cuts[-1][1] == len(text)
    for (a, b), (c, d) in zip(cuts, cuts[1:]):
        assert a < c <= b < d and b - c <= max(0, overlap)
    inside = {k for m in textnorm.MARK.finditer(text) for k in range(m.start() + 1, m.end())}
    assert not inside & ({a for a, _ in cuts} | {b for _, b in cuts})


def test_p4_wide_overlaps_and_marks_beyond_the_limit():
    import time

    text = "one two three four five. " * 40
    cuts = splitting.split(text, 50, 40)
    shared = [b - c for (_, b), (c, _) in zip(cuts, cuts[1:])]
    assert all(b - a <= 50 for a, b in cuts) and max(shared) <= 40 and sorted(shared)[len(shared) // 2] >= 34
    assert all(b - a <= 10 for a, b in splitting.split("abcdefghij" * 5, 10, 99))
    t0 = time.perf_counter()
    cuts = splitting.split("[[T123456789]]" * 3000, 10, 3)
    assert cuts[-1][1] == 42000 and all(b - a <= 10 for a, b in cuts) and time.perf_counter() - t0 < 5


def test_p4_edges(spark):
    s = spark.createDataFrame([seg("a", "x" * 50), seg("b", "one two. " * 30), seg("b", "one two. " * 30), seg("c", None), seg("d", ""), seg("e", "y" * 51, project="none"), seg("f", "[[T0]]" + "z" * 60), (None, *seg("g", "w" * 99)[1:])], SEGMENT)
    policy = spark.createDataFrame([("p", 50, None, "clash"), ("q", None, 3, "clash")], "project_id string, max_chars int, overlap_chars int, text string")
    out = splitting.oversized_pieces(s, policy)
    assert {r["segment_id"] for r in out.collect()} == {"b", "f"}
    b = sorted(out.where("segment_id = 'b'").collect(), key=lambda r: r["host_part"])
    assert "".join(r["text"] for r in b) == "one two. " * 30 and {r["host_total_parts"] for r in b} == {len(b)} and all(r["text"].endswith(". ") for r in b)
    assert splitting.oversized_pieces(s.limit(0), policy).count() == 0


# ---------------------------------------------------------------- 6


def test_p6_every_segment_once_and_within_capacity(spark):
    rng = random.Random(3)
    rows = [seg(f"s{k:04d}", "x" * rng.choice([0, 3, 40, 200, 399, 400, 1700]), chapter=f"c{k % 7}") for k in range(900)] + [seg("s0000", "x"), seg("null", None), seg("lost", "x", project="none")]
    rows[0] = seg("s0000", "x")
    opts = spark.createDataFrame([("p", 100, 1), ("zero", 0, 1)], "project_id string, chunk_max_tokens int, size int")
    old, packing.SHARD_ITEMS, packing.FAN_IN = (packing.SHARD_ITEMS, packing.FAN_IN), 50, 4
    try:
        calls = packing.helper_calls(spark.createDataFrame(rows, SEGMENT), opts).collect()
    finally:
        packing.SHARD_ITEMS, packing.FAN_IN = old
    size = {r[0]: max(1, len(r[4] or "") // 4) for r in rows if r[2] == "p"}
    got: dict = {}
    load: dict = {}
    for c in calls:
        got.setdefault(c["segment_id"], []).append(c["tokens"])
        load[c["call_id"]] = load.get(c["call_id"], 0) + c["tokens"]
    assert {k: sum(v) for k, v in got.items()} == size
    assert all(len(v) == -(-size[k] // 100) for k, v in got.items())
    assert max(load.values()) <= 100 and len(load) <= 1.02 * -(-sum(size.values()) // 100) + 1


def test_p6_empty(spark):
    opts = spark.createDataFrame([], "project_id string, chunk_max_tokens int")
    assert packing.helper_calls(spark.createDataFrame([], SEGMENT), opts).count() == 0


def test_p6_mixture_follows_shares():
    items = [(q, f"{q}{k}", 0, 5) for q, n in (("a", 300), ("b", 100)) for k in range(n)]
    done, rest, _ = packing.pack(items, 100, {"a": 0.75, "b": 0.25}, {})
    assert not rest and len(done) == 20
    for w in done[:-2]:
        assert 13 <= sum(x[0] == "a" for x in w) <= 17
    # wanted proportions other than what waits hold while both sources last, and deficits are carried without a cap
    done, _, _ = packing.pack(items, 100, {"a": 0.5, "b": 0.5}, {})
    assert [sum(x[0] == "a" for x in w) for w in done[:9]] == [10] * 9
    done, _, _ = packing.pack(items, 100, {"a": 0.75, "b": 0.25}, {"b": 1000.0})
    assert sum(x[0] == "b" for w in done[:5] for x in w) == 100


def test_p6_big_items_stay_bounded(spark):
    """Items of over half a capacity never share a window; still no level hands a task more than a shard's worth."""
    for rng in (random.Random(1), random.Random(2)):
        items = [("a", f"i{k}", 0, rng.randint(51, 90)) for k in range(4000)]
        done, rest, _ = packing.pack(items, 100, {"a": 1.0}, {}, packing.SHARD_ITEMS // packing.FAN_IN)
        assert len(rest) <= packing.SHARD_ITEMS // packing.FAN_IN and len(done) + len(rest) == 4000
    s = spark.createDataFrame([seg(f"s{k:05d}", "x" * 240, chapter=f"c{k % 3}") for k in range(3000)], SEGMENT)
    opts = spark.createDataFrame([("p", 100)], "project_id string, chunk_max_tokens int")
    old, packing.SHARD_ITEMS, packing.FAN_IN = (packing.SHARD_ITEMS, packing.FAN_IN), 40, 4
    try:
        calls = packing.helper_calls(s, opts).collect()
    finally:
        packing.SHARD_ITEMS, packing.FAN_IN = old
    assert len(calls) == 3000 == len({c["call_id"] for c in calls}) == len({c["segment_id"] for c in calls})


def test_p6_salted_join_deals_alike(spark):
    rows = [seg(f"s{k:04d}", "x" * (k % 90), project=f"p{k % 5}") for k in range(500)]
    opts = spark.createDataFrame([(f"p{k}", 50) for k in range(5)], "project_id string, chunk_max_tokens int")
    calls = lambda: sorted(map(tuple, packing.helper_calls(spark.createDataFrame(rows, SEGMENT), opts).collect()))
    first, old, packing.BROADCAST_PROJECTS = calls(), packing.BROADCAST_PROJECTS, 1
    try:
        assert calls() == first and len(first) == 500
    finally:
        packing.BROADCAST_PROJECTS = old


def test_p6_given_shares(spark):
    rows = [seg(f"s{k:04d}", "x" * 40, chapter="ab"[k % 4 == 0]) for k in range(400)]
    opts = spark.createDataFrame([("p", 100)], "project_id string, chunk_max_tokens int")
    wanted = spark.createDataFrame([("p", "a", 0.5), ("p", "b", 0.5), ("p", "c", None), ("p", None, 3.0)], "project_id string, chapter_id string, share double")
    got = packing.call_shares(packing.helper_calls(spark.createDataFrame(rows, SEGMENT), opts, wanted)).where("chapter_id = 'b'").collect()
    assert len(got) == 20 and all(r["share"] == 0.5 == r["target_share"] and r["fill"] == 1 for r in got)


# ---------------------------------------------------------------- 7


@pytest.fixture(scope="module")
def enc():
    return encoding.encoder().encode_ordinary


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.text(max_size=200), st.lists(st.sampled_from(["the cat ", "  ", "\n", "é", "日本", "1234", "'s", "don't ", "😀", "x" * 50, "<|endoftext|>"]), max_size=40).map("".join)), st.sampled_from([1, 3, 8, 32]))
def test_p7_tree_equals_plain_encoding(text, leaf):
    e = encoding.encoder().encode_ordinary
    ids = encoding.encode(text, e, leaf)
    assert ids == e(text) and encoding.decode(ids) == text


def test_p7_edges(spark, enc):
    big = 2**60 + 1
    long = "A sentence of words, 123. " * 4000
    df = spark.createDataFrame([(1, None, "x"), (2, "", "x"), (None, "cat", "x"), (big, "<|endoftext|>", "x"), (5, long, "x"), (5, long, "x")], "doc_id long, text string, ids string")
    got = [(r["doc_id"], r["ids"]) for r in encoding.token_ids(df).collect()]
    assert (1, []) in got and (2, []) in got and (None, enc("cat")) in got and (big, enc("<|endoftext|>")) in got and got.count((5, enc(long))) == 2
    assert encoding.token_ids(df.limit(0)).count() == 0


# ---------------------------------------------------------------- 8

DOC = "doc_id long, source string, text string, tokens string, weight string"
TARGET = "source string, target_share double, max_repeats int, tokens string"


def test_p8_shares_and_repeats(spark):
    rng = random.Random(2)
    docs = [(k, "big", "word " * rng.randint(5, 60), "c", "c") for k in range(400)] + [(1000 + k, "small", "word " * rng.randint(5, 60), "c", "c") for k in range(60)] + [(1, "big", "word " * 5, "c", "c")]
    docs[1] = (1, "big", "word " * 5, "c", "c")
    docs += [(5000, None, "x", "c", "c"), (None, "big", "x", "c", "c"), (5001, "small", None, "c", "c"), (5002, "small", "", "c", "c"), (5003, "unlisted", "x", "c", "c")]
    targets = spark.createDataFrame([("big", 0.6, 1, "c"), ("small", 0.38, 5, "c"), ("absent", 0.02, 9, "c"), (None, 0.1, 1, "c")], TARGET)
    d = spark.createDataFrame(docs, DOC)
    m = mixing.mix(d, targets).cache()
    by = {r["source"]: r for r in mixing.shares(m, targets.where("source IS NOT NULL")).collect()}
    assert m.groupBy("doc_id").count().where("count > 1").count() == 0
    assert by["big"]["most_copies"] <= 1 and by["small"]["most_copies"] <= 5 and by["absent"]["tokens"] == 0
    assert abs(by["big"]["actual_share"] - 0.6 / 0.98) < 0.01 and abs(by["small"]["actual_share"] - 0.38 / 0.98) < 0.01
    # whole epochs before a fraction: copies of one source differ by one at most, but for texts without tokens
    some = [r["copies"] for r in m.where("source = 'small' AND tokens > 0").collect()]
    assert max(some) - min(some) <= 1 and len(some) == 60
    assert mixing.mix(d, targets).exceptAll(m).count() == 0
    assert mixing.mix(d.limit(0), targets).count() == 0 and mixing.mix(d, targets.limit(0)).count() == 0


def test_p8_salted_joins_mix_alike(spark):
    rng = random.Random(4)
    docs = [(k, f"s{k % 3}", " ".join(rng.choices(["cat", "dog", "house", "tree", "road"], k=rng.randint(3, 40))), "c", "c") for k in range(300)]
    targets = spark.createDataFrame([("s0", 0.5, 2, "c"), ("s1", 0.3, 2, "c"), ("s2", 0.2, 1, "c")], TARGET)
    d = spark.createDataFrame(docs, DOC)
    few, old, mixing.BROADCAST_SOURCES = sorted(map(tuple, mixing.mix(d, targets).collect())), mixing.BROADCAST_SOURCES, 1
    try:
        assert sorted(map(tuple, mixing.mix(d, targets).collect())) == few and few
    finally:
        mixing.BROADCAST_SOURCES = old


def test_p8_quality_weights(spark):
    texts = {"prose": "The road left the garden and the boat took a letter to the old harbour.", "repeated": "buy now " * 60, "markup": "<div><p>{[|]}</p></div>" * 5, "run": "x" * 400, "ja": "彼は本を読んだ。そして港へ行った。", "none": None, "empty": ""}
    d = spark.createDataFrame([(k, v) for k, v in texts.items()], "k string, text string")
    w = {r["k"]: r["w"] for r in d.select("k", mixing.quality_weight().alias("w")).collect()}
    assert w["prose"] > 0.9 and w["ja"] > 0.8 and w["repeated"] < 0.2 and w["run"] <= 0.06 and w["markup"] < w["prose"] / 2 and w["none"] == w["empty"] == 0.05


# ---------------------------------------------------------------- 9


def test_p9_levels(spark):
    rng = random.Random(1)
    easy, hard = "the cat saw a dog and ran home to the red house".split(), "the epistemological legitimation of hermeneutic indeterminacy presupposes a canonical taxonomy".split()
    make = lambda words: " ".join(rng.choices(words, k=40))
    docs = [(k, make(easy if k % 2 else hard), "c") for k in range(200)] + [(900, None, "c"), (901, "", "c"), (902, " \n", "c"), (903, make(easy) * 500, "c")]
    labels = [(k, f"r{j}", 1 if k % 2 else 5, None) for k in range(100) for j in range(2)] + [(0, "r0", 5, None), (3, "r9", None, None), (5, "r9", 17, None), (None, "r1", 2, None)]
    d = spark.createDataFrame(docs, "doc_id long, text string, level string")
    lab = spark.createDataFrame(labels, "doc_id long, rater string, reading_level int, text string")
    got = {r["doc_id"]: r["level"] for r in reading.reading_levels(d, lab).collect()}
    assert len(got) == len(docs) and got[900] is None and got[901] is None and got[902] is None and got[903] == 1
    assert all(got[k] == (1 if k % 2 else 5) for k in range(100, 200))
    assert {r["level"] for r in reading.reading_levels(d, lab.limit(0)).collect()} == {None}
    assert reading.reading_levels(d.limit(0), lab).count() == 0


# ---------------------------------------------------------------- all queries, on the smallest tables


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_queries_run(spark, name):
    from tests.oracle import compare

    sf = "/root/testdata/sf0.001"
    if name in queries.ORACLES:
        assert compare(spark, sf, queries.QUERIES[name], queries.ORACLES[name]) == ""
    else:
        df = queries.QUERIES[name](spark, sf)
        assert len(df.columns) == len(set(df.columns)) and df.count() >= 0


