"""Operators against brute force and known cases, with nulls, ties and empty tables."""

from __future__ import annotations

import io
import itertools
import random
import re
import zipfile

import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from quillmill.operators import calls, dml, graph, matching, ordered, reads, resolution, rollups, setops, term_scan, writes
from quillmill.plans import extra_queries, match_queries, registry, views
from quillmill.sources import epub, glossary_json, skeleton, xhtml
from quillmill.streaming import events


def test_matching_equals_regular_expressions(spark):
    rng = random.Random(4)
    words = ["élan", "old oak", "oak", "Élise", "Rosalind", "iron-key", "the old oak", "a", "O'Brien", "鍵"]
    texts = [" ".join(rng.choices(words + ["élans", "oaks", "Rosalindは", "xoak", "oak.", "(oak)"], k=rng.randint(0, 12))) for _ in range(120)]
    s = spark.createDataFrame([(f"s{k}", "p", t) for k, t in enumerate(texts)] + [("null", "p", None), ("other", "q", "old oak")], "segment_id string, project_id string, text string")
    t = spark.createDataFrame([("p", f"e{k}", w) for k, w in enumerate(words)] + [("p", "e1", "oak"), ("p", "blank", ""), ("p", "mark", "—")], "project_id string, entry_id string, term string")
    got = sorted(tuple(r) for r in matching.mentions(s, t.where("term <> ''")).collect())
    want = []
    for k, text in enumerate(texts):
        for e in range(len(words)):
            forms = sorted({words[e], *(["oak"] if e == 1 else [])}, key=lambda x: (-len(x), x))
            p = re.compile(rf"(?<!\w)(?:{'|'.join(map(re.escape, forms))})(?!\w)")
            want += [(f"s{k}", f"e{e}", m.group(), m.start(), m.end()) for m in p.finditer(text)]
    assert got == sorted(want)


def test_terms_of_many_entries_are_shuffled_once(spark):
    """J06 grows with the tables: 60 entries of one form in 300 texts are 18,000 hits, of which none is shuffled."""
    texts = spark.createDataFrame([(f"s{k:03d}", "p", f"the bridge {k}") for k in range(300)], "segment_id string, project_id string, text string")
    terms = spark.createDataFrame([("p", f"e{k:02d}", "the bridge") for k in range(60)], "project_id string, entry_id string, term string")
    found = matching.mentions(texts, terms)
    assert found.count() == found.distinct().count() == 18_000
    plan = found._jdf.queryExecution().optimizedPlan()
    assert plan.nodeName() == "MapInArrow" and "Aggregate [segment_id" not in plan.toString()


def test_spans_without_patterns_equal_the_pattern():
    rng = random.Random(8)
    signs = ["a", "b", "é", "—", " ", ".", "_", "1", "鍵", "²", "́"]
    for _ in range(20_000):
        text = "".join(rng.choices(signs, k=rng.randint(0, 14)))
        forms = tuple(sorted({"".join(rng.choices(signs, k=rng.randint(1, 4))) for _ in range(rng.randint(1, 4))}, key=lambda t: (-len(t), t)))
        assert term_scan.spans(text, forms) == [(a, b) for _, a, b in matching.find_all(text, list(forms))]


def test_a_project_of_many_texts_is_cut_into_slices(spark, monkeypatch):
    monkeypatch.setattr(term_scan, "SLICE_TEXTS", 7)
    monkeypatch.setattr(term_scan, "BATCH_ROWS", 5)
    texts = spark.createDataFrame([(f"s{k}", p, "an oak, the old oak") for p, n in (("p", 100), ("q", 3), (None, 5)) for k in range(n)], "segment_id string, project_id string, text string")
    terms = spark.createDataFrame([(p, f"{p}{k}", t) for p in ("p", "q", "r") for k, t in enumerate(["oak", "old oak", "oak", "elm"])], "project_id string, entry_id string, term string")
    spots = {0: ("oak", [(3, 6), (16, 19)]), 1: ("old oak", [(12, 19)]), 2: ("oak", [(3, 6), (16, 19)])}
    want = sorted((f"s{k}", f"{p}{e}", t, a, b) for p, n in (("p", 100), ("q", 3)) for k in range(n) for e, (t, ab) in spots.items() for a, b in ab)
    assert sorted(map(tuple, matching.mentions(texts, terms).collect())) == want


def plan_of(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_new_entry_mentions_equal_the_joins_and_shuffle_no_pair(spark):
    rows = [("s1", "p", "the oak and the elm"), ("s2", "p", "elm"), ("s3", "p", None), ("s4", "q", "the oak"), ("s5", "p", "nothing")]
    texts = spark.createDataFrame(rows, "segment_id string, project_id string, text string")
    schema = "id string, project_id string, source_term string, status string, first_seen_segment_id string"
    entries = spark.createDataFrame([
        ("a", "p", "oak", "proposed", "s1"), ("b", "p", "oak", "proposed", "s2"), ("c", "p", "oak", "locked", "s2"), ("d", "p", "elm", "proposed", None), ("e", "p", None, "proposed", "s1"),
        ("f", "p", "elm", "proposed", "s3"), ("g", "p", "oak", "proposed", "s4"), ("h", "p", "fir", "proposed", "gone"), ("i", "r", "oak", "proposed", "s1"), ("j", "p", "the fir", "proposed", "s2"), ("k", "p", "", None, "s1")], schema)
    aliases = spark.createDataFrame([("j", "source", "the elm"), ("j", "target", "elm")], "entry_id string, side string, text string")
    found = matching.with_first_seen(matching.mentions(texts, matching.entry_terms(entries, aliases, "source")), entries)
    want = found.groupBy("segment_id", "entry_id", "origin").agg(F.bool_or(F.col("span_start").isNotNull()).alias("has_span"))
    got = matching.new_entry_mentions(texts, entries, aliases)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.where("not has_span").count() == 7
    assert "Aggregate [segment_id" not in plan_of(got)


def oaks(spark):
    """Texts and terms: `a` and `b` read alike, `c` has two forms, `d` stands nowhere."""
    texts = spark.createDataFrame([("s1", "p", "the oak, an oak"), ("s2", "p", "elm and fir"), ("s3", "p", "the fir"), ("s4", "q", "oak"), ("s5", "p", None)], "segment_id string, project_id string, text string")
    terms = spark.createDataFrame([("p", "a", "oak"), ("p", "b", "oak"), ("p", "c", "elm"), ("p", "c", "fir"), ("p", "d", "ash")], "project_id string, entry_id string, term string")
    return texts, terms


def test_segments_of_merged_entries_are_counted_without_their_pairs(spark):
    texts, terms = oaks(spark)
    groups = spark.createDataFrame([("a", "a"), ("c", "a")], "id string, winner string")
    moved = writes.pointed(terms, groups).distinct()
    found = writes.pointed(matching.mentions(texts, terms).select("segment_id", "entry_id"), groups)
    want = found.groupBy("entry_id").agg(F.countDistinct("segment_id").alias("segments"))
    got = matching.segment_counts(texts, moved)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) == [("a", 3), ("b", 1)]
    assert "segment_id" not in plan_of(got).split("MapInArrow")[0]


def test_pairs_are_distinct_without_a_shuffle(spark):
    texts, terms = oaks(spark)
    got = matching.pairs(texts, terms)
    assert sorted(map(tuple, got.collect())) == [("s1", "a"), ("s1", "b"), ("s2", "c"), ("s3", "c")]
    assert plan_of(got).startswith("MapInArrow")
    tables = views.Tables(spark, "/root/testdata/sf0.001")
    assert plan_of(match_queries.g03(tables)).startswith("MapInArrow")


def test_missing_targets_shuffle_no_pair(spark):
    """Both sides of a segment meet both sides of an entry in one place; only what is missing is written."""
    seg = spark.createDataFrame([("a", "p", "oak elm", "roble", "x"), ("b", "p", "oak", "x the-elm", "x"), ("c", "p", "oak", None, "x"), ("d", "q", "oak", "", "x")], "id string, project_id string, source_text string, target_text string, status string")
    ent = spark.createDataFrame([("o", "p", "oak", "roble", "locked", True), ("o2", "p", "oak", "roble", "locked", True), ("u", "p", "oak", "olmo", "locked", False), ("e", "p", "elm", None, "confirmed", True), ("q", "q", "oak", "oak", "locked", None)], "id string, project_id string, source_term string, target_term string, status string, source_known boolean")
    alias = spark.createDataFrame([("u", "target", "the-elm")], "entry_id string, side string, text string")
    got = matching.missing_targets(seg, ent, alias)
    assert sorted(map(tuple, got.collect())) == [("a", "e", "warning"), ("a", "u", "warning"), ("b", "o", "error"), ("b", "o2", "error"), ("d", "q", "warning")]
    assert plan_of(got).startswith("MapInArrow")


def test_occurrences_are_shuffled_only_to_be_sorted(spark):
    """Places in the book come with the texts; nothing but the order of the result moves a hit."""
    found = match_queries.j03(views.Tables(spark, "/root/testdata/sf0.001"))
    above = plan_of(found).split("MapInArrow")[0]
    assert "Sort" in above and "Join" not in above
    rows = found.collect()
    assert rows == sorted(rows, key=lambda r: (r["entry_id"], r["spine_idx"], r["idx"], r["span_start"])) and len(rows) == registry.QUERIES["j06_g02_mentions"](spark, "/root/testdata/sf0.001").count()


def test_unmentioned_entries_shuffle_no_segment(spark):
    found = match_queries.j08(views.Tables(spark, "/root/testdata/sf0.001"))
    assert found.count() > 0 and not re.search(r"\bsegment_id#", plan_of(found).split("MapInArrow")[0])


def test_places_are_given_without_a_window(spark, monkeypatch):
    texts, terms = oaks(spark)
    for most in (1, term_scan.BATCH_ROWS):
        monkeypatch.setattr(term_scan, "BATCH_ROWS", most)
        got = matching.placed_mentions(texts.withColumn("text", F.concat("text", F.lit(" fir"))), terms)
        assert sorted((r["segment_id"], r["place"], r["entry_id"], r["span_start"]) for r in got.collect()) == [
            ("s1", 1, "a", 4), ("s1", 2, "b", 4), ("s1", 3, "a", 12), ("s1", 4, "b", 12), ("s1", 5, "c", 16), ("s2", 1, "c", 0), ("s2", 2, "c", 8), ("s2", 3, "c", 12), ("s3", 1, "c", 4), ("s3", 2, "c", 8)]
    assert plan_of(extra_queries.o09(views.Tables(spark, "/root/testdata/sf0.001"))).startswith("MapInArrow")


def test_mentions_are_counted_without_their_rows(spark, monkeypatch):
    monkeypatch.setattr(term_scan, "SLICE_TEXTS", 2)
    texts, terms = oaks(spark)
    got = matching.counted_mentions(texts, terms)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, matching.mention_counts(matching.mentions(texts, terms)).collect())) == [("a", 2, 1), ("b", 2, 1), ("c", 3, 2)]
    assert "segment_id" not in plan_of(match_queries.a11(views.Tables(spark, "/root/testdata/sf0.001"))).split("MapInArrow")[0]


def test_flagging_segments_shuffle_no_pair(spark):
    t = views.Tables(spark, "/root/testdata/sf0.01")
    lost = matching.missing_targets(t.segment, t.glossary, t.alias)
    want = lost.groupBy("segment_id").agg(F.bool_or(F.col("severity") == "error").alias("locked_violation"), F.count("*").alias("violations"))
    got = match_queries.g15(t)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 0
    assert plan_of(got).startswith("MapInArrow")


def test_mentioned_entries_are_distinct_without_a_shuffle(spark):
    found = match_queries.j06b(views.Tables(spark, "/root/testdata/sf0.001"))
    assert plan_of(found).startswith("MapInArrow") and found.count() == found.distinct().count() > 0


def test_missing_targets_and_cascade(spark):
    seg = spark.createDataFrame([("a", "p", "Olm saw Rask.", "Olm vio a Rask.", "translated"), ("b", "p", "Olm left.", "Se fue.", "approved"), ("c", "p", "Olm.", None, "pending"), ("d", "p", "Nothing.", "Olmo nada.", "translated")], "id string, project_id string, source_text string, target_text string, status string")
    ent = spark.createDataFrame([("o", "p", "Olm", "Olm", "locked", True), ("r", "p", "Rask", "Raske", "confirmed", True), ("n", "p", "Nothing", "Nada", "proposed", True)], "id string, project_id string, source_term string, target_term string, status string, source_known boolean")
    none = spark.createDataFrame([], "entry_id string, side string, text string")
    assert sorted(map(tuple, matching.missing_targets(seg, ent, none).collect())) == [("a", "r", "warning"), ("b", "o", "error")]
    ch = spark.createDataFrame([("o", "p", "Olm", "Olmo")], "id string, project_id string, source_term string, previous_target string")
    hit = matching.affected(seg, ch)
    assert sorted(map(tuple, hit.collect())) == [("a", "o", "source match"), ("b", "o", "source match"), ("d", "o", "previous target match")]
    after, log = dml.cascade(seg, hit, 7)
    assert {r["id"]: (r["status"], r["target_text"]) for r in after.collect()} == {"a": ("pending", None), "b": ("pending", None), "c": ("pending", None), "d": ("pending", None)}
    assert log.count() == 4


def lev(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        row, last = [i], row
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_fuzzy_edges_are_exact(spark):
    rng = random.Random(9)
    keys = sorted({"".join(rng.choices("abc é", k=rng.randint(1, 9))).strip() or "a" for _ in range(150)})
    df = spark.createDataFrame([("p", k) for k in keys], "scope string, key string")
    got = {(r["a"], r["b"]) for r in resolution.fuzzy_edges(df).collect()}
    want = {(a, b) for a, b in itertools.combinations(keys, 2) if lev(a, b) <= 2 and a[: min(3, len(a), len(b))] == b[: min(3, len(a), len(b))]}
    assert got == want


def test_components_equal_union_find(spark):
    rng = random.Random(2)
    edges = [(f"n{rng.randint(0, 80):02d}", f"n{rng.randint(0, 80):02d}") for _ in range(60)] + [(f"z{k:02d}", f"z{k + 1:02d}") for k in range(40)]
    parent = {x: x for e in edges for x in e} | {"alone": "alone"}
    find = lambda x: x if parent[x] == x else find(parent[x])
    for a, b in edges:
        a, b = find(a), find(b)
        parent[max(a, b)] = min(a, b)
    nodes = spark.createDataFrame([(x,) for x in parent], "id string")
    got = {r["id"]: r["root"] for r in graph.components(nodes, spark.createDataFrame(edges, "a string, b string")).collect()}
    assert got == {x: find(x) for x in parent}
    assert graph.components(nodes, spark.createDataFrame([], "a string, b string")).where("id <> root").count() == 0


def test_near_duplicates_and_merge(spark):
    rows = [("a", "p", "character", "House Stark", "Casa Stark", "proposed"), ("b", "p", "term", "house stark.", "Stark", "locked"), ("c", "p", "place", "House Starx", "Starx", "proposed"), ("d", "p", "place", "Winterfell", "W", "locked"), ("e", "q", "place", "House Stark", "x", "locked"), ("f", "p", "place", None, "", "locked")]
    e = spark.createDataFrame(rows, "id string, project_id string, type string, source_term string, target_term string, status string")
    g = resolution.near_duplicates(e)
    assert sorted((r["id"], r["winner"]) for r in g.collect()) == [("a", "b"), ("b", "b"), ("c", "b")]
    al = spark.createDataFrame([("a", "source", "Starks"), ("b", "source", "House Stark")], "entry_id string, side string, text string")
    left, aliases = resolution.merge(e, al, g)
    assert {r["id"] for r in left.collect()} == {"b", "d", "e", "f"}
    assert sorted(map(tuple, aliases.collect())) == [("b", "source", "House Stark"), ("b", "source", "House Starx"), ("b", "source", "Starks"), ("b", "target", "Casa Stark"), ("b", "target", "Starx")]


def test_context_rules(spark):
    rows = [(f"s{k}", "c", k, "x" * n) for k, n in enumerate([50, 500, 100, 250, 10])]
    s = spark.createDataFrame(rows, "id string, chapter_id string, idx int, source_text string")
    got = {r["idx"]: (r["context"], r["context_chars"]) for r in ordered.preceding_context(s, 4, 300).collect()}
    # the long one is skipped and the scan goes on; the first overflow ends it
    assert got == {0: ([], 0), 1: ([0], 50), 2: ([0], 50), 3: ([0, 2], 150), 4: ([3], 250)}
    assert ordered.preceding_context(s.limit(0), 4, 300).count() == 0


def test_chunks_runs_breaker_and_sample(spark):
    s = spark.createDataFrame([("p", k, n) for k, n in enumerate([5, 5, 3, 20, 1, 9])], "g string, k int, n int")
    assert [r["chunk"] for r in sorted(ordered.greedy_chunks(s, "g", ["k"], F.col("n"), 10).collect(), key=lambda r: r["k"])] == [0, 0, 1, 2, 3, 3]
    e = spark.createDataFrame([("p", k, x) for k, x in enumerate([True, True, True, False, True])], "g string, k int, e boolean")
    assert [(r["island"], r["part"]) for r in sorted(ordered.runs(e, ["g"], ["k"], F.col("e"), 2).collect(), key=lambda r: r["k"])] == [(1, 0), (1, 0), (1, 1), (2, 0), (3, 0)]
    f = spark.createDataFrame([("p", k, x) for k, x in enumerate("FFxFFFF")], "g string, k int, x string")
    assert ordered.breaker(f, "g", "k", F.col("x") == "F", 3).collect()[0]["tripped_at"] == 5 and ordered.breaker(f, "g", "k", F.col("x") == "F", 0).count() == 0
    n = spark.createDataFrame([("p", k, k + 1) for k in range(20)], "g string, k int, at int")
    assert sorted(r["k"] for r in ordered.spread_sample(n, "g", "at", 2, 3, 2).collect()) == [0, 1, 6, 10, 14, 18, 19]
    assert ordered.spread_sample(n.where("at <= 5"), "g", "at", 2, 3, 2).count() == 5
    cut = ordered.running_cut(spark.createDataFrame([("p", 0, 5), ("p", 1, 5), ("p", 2, 1)], "g string, k int, n int"), "g", ["k"], F.col("n"), F.lit(10))
    assert [(r["k"], r["total"]) for r in cut.collect()] == [(2, 11)]


def test_terms_without_a_word_are_found(spark):
    texts = spark.createDataFrame([("s", "p", "a — b …x… — c"), ("t", "p", "a—b"), ("u", "q", "—")], "segment_id string, project_id string, text string")
    terms = spark.createDataFrame([("p", "e", "—"), ("p", "f", "…"), ("p", "g", " — "), ("p", "h", "b"), ("p", "i", "")], "project_id string, entry_id string, term string")
    got = {(r["segment_id"], r["entry_id"], r["span_start"], r["span_end"]) for r in matching.mentions(texts, terms).collect()}
    assert got == {("s", "e", 2, 3), ("s", "e", 10, 11), ("s", "h", 4, 5), ("t", "h", 2, 3)} | {("s", "g", a, b) for _, a, b in matching.find_all("a — b …x… — c", [" — "])}


def test_ordered_folds_across_slices_equal_plain_loops(spark):
    """Keys that span many slices: chunks, totals, numbers, runs and breakers against loops over the rows in order."""
    rng = random.Random(21)
    rows = [("hot" if rng.random() < 0.7 else rng.choice(["a", "b", None]), rng.randint(0, 300), f"i{k:04d}", rng.choice([0, 1, 3, 9, 40, 120]), rng.choice("xxy") if rng.random() < 0.9 else None) for k in range(1500)]
    df = spark.createDataFrame(rows, "g string, k int, id string, n int, v string").repartition(7)
    by = {}
    for r in sorted(rows, key=lambda r: (r[1], r[2])):
        by.setdefault(r[0], []).append(r)
    for cap, joiner in ((100, 0), (130, 2), (5, 1)):
        want = {}
        for rs in by.values():
            total = chunk = 0
            for r in rs:
                if total and total + joiner + r[3] > cap:
                    chunk, total = chunk + 1, r[3]
                else:
                    total += r[3] + (joiner if total else 0)
                want[r[2]] = chunk
        assert {r["id"]: r["chunk"] for r in ordered.greedy_chunks(df, "g", ["k", "id"], F.col("n"), cap, joiner).collect()} == want
    cut = ordered.sliced(df, ["g"], ["k", "id"])
    assert cut.select("_slice").distinct().count() == 8
    got = {r["id"]: (r["s"], r["m"], r["p"]) for r in ordered.running(cut, ["g"], ["k", "id"], {"s": ("sum", F.col("n")), "m": ("max", F.col("n")), "p": ("last", F.col("v"))}, inclusive=False).collect()}
    assert got == {r[2]: (sum(x[3] for x in rs[:i]) if i else None, max((x[3] for x in rs[:i]), default=None), rs[i - 1][4] if i else None) for rs in by.values() for i, r in enumerate(rs)}
    runs = {(r["g"], r["run"], r["v"], r["rows"]) for r in ordered.run_lengths(df, ["g"], ["k", "id"], "v").collect()}
    assert runs == {(g, i + 1, v, len(list(x))) for g, rs in by.items() for i, (v, x) in enumerate(itertools.groupby(rs, key=lambda r: r[4]))}
    trip = {r["g"]: r["tripped_at"] for r in ordered.breaker(df.where("g IS NOT NULL"), "g", "id", F.col("n") >= 9, 4).collect()}
    want = {}
    for g in by:
        streak = 0
        for r in sorted(by[g], key=lambda r: r[2]):
            streak = streak + 1 if r[3] >= 9 else 0
            if streak >= 4 and g is not None:
                want.setdefault(g, r[2])
    assert trip == want


def test_updates_and_imports(spark):
    e = spark.createDataFrame([("a", "p", "character", "X", "x", "proposed", None, 1, 1), ("b", "p", "term", "Y", "Y", "proposed", None, 1, 1)], "id string, project_id string, type string, source_term string, target_term string, status string, notes string, created_at long, updated_at long")
    ch = spark.createDataFrame([("a", None, None, None), ("b", "why", "locked", None)], "id string, target_term string, status string, notes string")
    after, rev = dml.update_entries(e, ch, 9)
    assert {r["id"]: (r["target_term"], r["status"], r["updated_at"]) for r in after.collect()} == {"a": ("x", "proposed", 1), "b": ("why", "locked", 9)}
    assert [(r["entry_id"], r["prev_target_term"], r["new_target_term"]) for r in rev.collect()] == [("b", "Y", "why")]


def test_rollups_on_nothing(spark):
    c = spark.createDataFrame([], "id string, model string, purpose string, project_id string, prompt_tokens int, completion_tokens int, cost_usd double, cache_hit boolean")
    assert rollups.ledger_by(c, "model").count() == 0 and rollups.spend_shares(c, "model").count() == 0
    total = rollups.activity(c).where("kind = 'total'").collect()
    assert len(total) == 1 and total[0]["calls"] == 0 and total[0]["hit_rate"] == 0.0
    assert reads.chapter_range(spark.createDataFrame([("a", "p", 0)], "id string, project_id string, spine_idx int"), "x-2").count() == 0


def test_attached_view_keeps_own_duplicates(spark):
    s = "id string, project_id string, source_term string, target_term string, type string, priority int"
    own = spark.createDataFrame([("a", "p", "X", "x", "t", None), ("b", "p", "X", "x", "t", None)], s)
    att = spark.createDataFrame([("c", "q", "X", "x", "t", 0), ("d", "q", None, "y", "t", 2), ("e", "r", None, "y", "t", 1)], s)
    assert sorted((r["id"], r["origin"]) for r in setops.attached_view(own, att, F.col("priority"), F.col("id")).collect()) == [("a", "own"), ("b", "own"), ("e", "attached")]


INLINE = st.recursive(
    st.one_of(st.text(alphabet="ab <>&é\n", min_size=1, max_size=6), st.sampled_from(["<br/>", "<img src=\"x\"/>", "&copy;"])).map(lambda s: s if s.startswith(("<b", "<i", "&c")) else s.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;")),
    lambda inner: st.tuples(st.sampled_from(["em", "strong", "a"]), st.lists(inner, max_size=4)).map(lambda x: f"<{x[0]}>{''.join(x[1])}</{x[0]}>"), max_leaves=8)


@settings(max_examples=200, deadline=None)
@given(st.lists(INLINE, max_size=4))
def test_placeholders_round_trip(parts):
    root = xhtml.parse(f"<p>{''.join(parts)}</p>")
    host = xhtml.hosts(root)[0]
    text, tokens = xhtml.placeholderize(host)
    again = xhtml.hosts(xhtml.parse(f"<p>{xhtml.rebuild(text, tokens)}</p>"))[0]
    assert xhtml.placeholderize(again) == (text, tokens)
    opened = [m.group(2) for m in xhtml.MARK.finditer(text) if not m.group(1) and tokens[int(m.group(2))]["kind"] == "pair"]
    assert opened.sort() == [m.group(2) for m in xhtml.MARK.finditer(text) if m.group(1)].sort()


def test_segmentation_cases():
    doc = "<html><head><title>T</title></head><body><h1> One  two </h1><div>orphan <em>run</em><p>inner</p> tail</div><ul><li>a<li>b</ul><pre>code</pre><p lang='es'>hola</p><p> ​ </p></body></html>"
    got = [(t, p) for _, t, p, _ in xhtml.segment_document(doc, "es-MX")]
    assert [t for t, _ in got] == ["One  two", "orphan [[T0]]run[[/T0]]", "inner", "tail", "a", "b"]
    assert len({p for _, p in got}) == len(got)
    root = xhtml.parse(doc)
    assert xhtml.chapter_title(root) == "One two" and xhtml.wrap_orphans(root) == 2 and xhtml.wrap_orphans(root) == 0
    styled = "<body><div><span class='bold1'>II</span></div><div><span class='x boldy'>The Rules</span></div></body>"
    assert xhtml.chapter_title(xhtml.parse(styled)) == "II — The Rules"
    with pytest.raises(xhtml.BrokenMarks):
        xhtml.rebuild("[[T0]]x", [{"tag": "em", "kind": "pair", "attrs": {}}])
    tokens = [{"tag": "&rsquo;", "kind": "entity", "attrs": {}}, {"tag": "br", "kind": "void", "attrs": {}}]
    assert xhtml.expand_entity_tokens("j[[T0]]ai[[T1]]", None, tokens) == ("j’ai[[T0]]", None, tokens[1:], True)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["One two. ", "[[T0]]", "[[/T0]]", "Three! ", "four ", "[[T1]]"]), max_size=20))
def test_sentence_parts_rebuild_the_text(parts):
    text = "".join(parts)
    tokens = [{"tag": "em", "kind": "pair", "attrs": {}}, {"tag": "br", "kind": "void", "attrs": {}}]
    out = xhtml.split_sentences(text, tokens, 5)
    bare = lambda s: xhtml.MARK.sub("", s)
    assert "".join(bare(t) for t, _ in out) == bare(text)
    assert all({int(m.group(2)) for m in xhtml.MARK.finditer(t)} == set(range(len(k))) for t, k in out if len(out) > 1)


def make_epub() -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("META-INF/container.xml", '<container xmlns="urn:oasis:names:tc:opendocument:xmlns:container"><rootfiles><rootfile full-path="OEBPS/b.opf"/></rootfiles></container>')
        z.writestr("OEBPS/b.opf", '<package xmlns="http://www.idpf.org/2007/opf" xmlns:dc="http://purl.org/dc/elements/1.1/"><metadata><dc:title>Book</dc:title><dc:language>en</dc:language><dc:creator>A</dc:creator></metadata><manifest>'
                   '<item id="n" href="t.ncx" media-type="application/x-dtbncx+xml"/><item id="c1" href="x/1.xhtml" media-type="application/xhtml+xml"/><item id="c2" href="x/2.xhtml" media-type="application/xhtml+xml"/><item id="cover" href="c.png" media-type="image/png"/></manifest><spine><itemref idref="c1"/><itemref idref="c2"/></spine></package>')
        z.writestr("OEBPS/t.ncx", '<ncx xmlns="http://www.daisy.org/z3986/2005/ncx/"><navMap><navPoint><navLabel><text>Second</text></navLabel><content src="x/2.xhtml#a"/></navPoint></navMap></ncx>')
        z.writestr("OEBPS/x/1.xhtml", "<html><body><h1>First</h1><p>One <em>two</em>.</p></body></html>")
        z.writestr("OEBPS/x/2.xhtml", "<html><body><p>Three.</p></body></html>")
        z.writestr("OEBPS/c.png", b"12345")
    return out.getvalue()


def test_epub_source(spark, tmp_path):
    (tmp_path / "a.epub").write_bytes(make_epub())
    (tmp_path / "bad.epub").write_bytes(b"no archive")
    files = epub.read(spark, str(tmp_path))
    ch = {(r["path"][-5:], r["spine_idx"]): (r["title"], r["error"] is None) for r in epub.chapters(files).collect()}
    assert ch["a.epub"[-5:], 0] == ("First", True) and ch["a.epub"[-5:], 1] == ("Second", True) and any(not ok for _, ok in ch.values())
    meta = {r["path"][-6:]: r for r in epub.metadata(files).collect()}
    assert meta["a.epub"]["title"] == "Book" and meta["a.epub"]["authors"] == ["A"] and meta["a.epub"]["cover_bytes"] == 5
    assert sorted(r["source_text"] for r in epub.segments(files).collect()) == ["First", "One [[T0]]two[[/T0]].", "Three."]


def test_glossary_files(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"version": 2, "project_id": "p", "entries": [{"source_term": "X", "target_term": "x", "source_aliases": ["", "XX"]}, {"source_term": null, "target_term": "y", "source_known": false, "status": "locked"}, {"source_term": null, "target_term": "z"}, {"source_term": "q", "target_term": " "}, {"source_term": "g", "target_term": "g", "gender": "odd"}]}')
    (tmp_path / "b.json").write_text('{"version": 7, "project_id": "q", "entries": []}')
    rows = glossary_json.normalise(glossary_json.read(spark, str(tmp_path))).collect()
    by = {r["target_term"]: r for r in rows if r["file_error"] is None}
    assert by["x"]["source_aliases"] == ["XX"] and by["x"]["type"] == "term" and by["x"]["fault"] is None and by["y"]["fault"] is None
    assert by["z"]["fault"] == "no source term" and by[" "]["fault"] == "no target term" and by["g"]["fault"] == "gender" and sum(r["file_error"] is not None for r in rows) == 1
    out = str(tmp_path / "out")
    glossary_json.write(spark.createDataFrame([("a", "p", "X", "x", "term", "locked", None, None, True)], "id string, project_id string, source_term string, target_term string, type string, status string, gender string, notes string, source_known boolean"), out)
    assert spark.read.json(out).count() == 1


def test_skeleton_shapes(spark):
    rows = [('[{"tag":"em","kind":"pair","attrs":{"a":"b"}}]',), ('{"skeleton":[{"tag":"br","kind":"void","attrs":{}}],"host_path":"/p","host_part":1,"host_total_parts":3}',), (None,), ("",), ("broken",)]
    d = spark.createDataFrame(rows, "j string").select(skeleton.decode(F.col("j")).alias("e")).select("e.*").collect()
    assert [len(r["tokens"]) for r in d] == [1, 1, 0, 0, 0] and (d[1]["host_path"], d[1]["host_part"], d[1]["host_total_parts"]) == ("/p", 1, 3) and d[4]["host_total_parts"] == 1


def test_calls_share_and_replay(spark):
    s = spark.createDataFrame([("a", "p", "pending", "Hello"), ("b", "p", "pending", "Hello"), ("c", "p", "pending", "​"), ("d", "p", "done", "x"), ("e", "p", "pending", "boom")], "id string, project_id string, status string, source_text string")

    def model(prompt):
        if prompt == "boom":
            raise RuntimeError
        return calls.echo_model(prompt)

    ledger = spark.createDataFrame([], "project_id string, cache_key string, target string")
    work = calls.worklist(s, "m", F.lit("g"))
    assert work.count() == 3 and calls.misses(work, ledger).count() == 2
    answers = {r["cache_key"]: (r["target"], r["fault"]) for r in calls.parse(calls.call(calls.misses(work, ledger), model)).collect()}
    got = {r["id"]: answers[r["cache_key"]] for r in work.collect()}
    assert got == {"a": ("<Hello>", None), "b": ("<Hello>", None), "e": (None, "failed")}


def test_streams_equal_their_batch_twins(spark, tmp_path):
    src = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    src.repartition(3).write.parquet(str(tmp_path / "in"))
    read = lambda: events.read_stream(spark, str(tmp_path / "in"), 1, "*.parquet")
    events.run_once(events.tumbling(read(), "1 hour"), str(tmp_path / "w"), str(tmp_path / "cw"), "append")
    # windows that the watermark has not passed yet stay open; all that came out are right
    got = {(r["start"], r["event_type"]): r["events"] for r in spark.read.parquet(str(tmp_path / "w")).collect()}
    want = {(r["start"], r["event_type"]): r["events"] for r in events.tumbling(src).collect()}
    assert got and all(want[k] >= v for k, v in got.items())
    once = str(tmp_path / "one")
    src.coalesce(1).write.parquet(once)
    events.run_once(events.running_spend(events.read_stream(spark, once, 1, "*.parquet"), 500.0), str(tmp_path / "r"), str(tmp_path / "cr"))
    trips = {r["user_id"]: r["event_id"] for r in spark.read.parquet(str(tmp_path / "r")).collect()}
    totals: dict = {}
    expect: dict = {}
    for r in src.orderBy("event_id").collect():
        totals[r["user_id"]] = totals.get(r["user_id"], 0.0) + (r["value"] or 0.0)
        if totals[r["user_id"]] > 500.0:
            expect.setdefault(r["user_id"], r["event_id"])
    assert trips == expect


def test_epub_sink_round_trip(spark):
    from quillmill.sources import epub_sink

    p = spark.createDataFrame([("p", "A & B", "pt")], "id string, name string, target_lang string")
    c = spark.createDataFrame([("c1", "p", 3, "t/1.xhtml", "One"), ("c2", "p", 7, "t/2.xhtml", None), ("c3", "p", 9, "t/3.xhtml", None)], "id string, project_id string, spine_idx int, href string, title string")
    skel = '[{"tag":"em","kind":"pair","attrs":{"class":"x\\"y"}},{"tag":"br","kind":"void","attrs":{}}]'
    s = spark.createDataFrame([("b", "c1", 1, "Two < 3", None, None, "/html/body/p[2]"), ("a", "c1", 0, "src", "[[T0]]Um[[/T0]][[T1]] & dois", skel, "/html/body/h2"), ("d", "c2", 0, "broken [[T5]] mark", None, None, None)],
                              "id string, chapter_id string, idx int, source_text string, target_text string, inline_skeleton string, host_path string")
    old, epub_sink.VOLUME_CHAPTERS = epub_sink.VOLUME_CHAPTERS, 2
    try:
        files = epub_sink.volumes(p, c, s).cache()
        assert sorted(r["path"] for r in files.collect()) == ["p-0.epub", "p-1.epub"]
    finally:
        epub_sink.VOLUME_CHAPTERS = old
    got = sorted((r["doc"], r["idx"], r["source_text"]) for r in epub.segments(files).collect())
    assert got == [("p-0.epub#0", 0, "[[T0]]Um[[/T0]][[T1]] & dois"), ("p-0.epub#0", 1, "Two < 3"), ("p-0.epub#1", 0, "broken  mark")]
    assert {r["title"] for r in epub.metadata(files).collect()} == {"A & B"}


def test_book_positions(spark):
    rng = random.Random(8)
    ch = [(f"c{k}", "p" if k < 6 else "q", rng.randint(0, 99)) for k in range(10)]
    seg = [(f"s{k:03d}", rng.choice(ch)[0], rng.randint(0, 20)) for k in range(200)]
    spine = {c: (p, n) for c, p, n in ch}
    want: dict = {}
    for book in "pq":
        rows = sorted((spine[c][1], c, i, s) for s, c, i in seg if spine[c][0] == book)
        want |= {r[3]: k for k, r in enumerate(rows, 1)}
    got = reads.book_positions(spark.createDataFrame(seg, "id string, chapter_id string, idx int"), spark.createDataFrame(ch, "id string, project_id string, spine_idx int"))
    assert {r["id"]: r["position"] for r in got.collect()} == want


def test_scripted_model():
    m = calls.ScriptedModel(["a"], None, lambda p: p.upper())
    assert [m("x"), m("x")] == ["a", "X"] and m.calls == 2 and calls.ScriptedModel(fixed="f")("x") == "f"
