"""Writes over sets and the translation pipeline, on small fixtures."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from quillmill.operators import pipeline, writes

ENTRY = "id string, project_id string, type string, source_term string, target_term string, status string, gender string, source_known boolean, created_at long, updated_at long"
PROPOSAL = "project_id string, source_term string, type string, target_term string, source_lang string, target_lang string"
ALIAS = "entry_id string, side string, text string"


def entry(i, source, target, status="locked", type="term", project="p", at=1):
    return (i, project, type, source, target, status, None, True, at, at)


def test_upsert(spark):
    e = spark.createDataFrame([entry("a", "X", "x", "proposed", "character"), entry("b", "Y", "Y", "proposed"), entry("c", "Locked", "Locked"), entry("d", "House Stark", "Casa Stark", at=2), entry("o", None, "only")], ENTRY)
    al = spark.createDataFrame([("d", "source", "HOUSE  Stark")], ALIAS)
    p = spark.createDataFrame([
        ("p", "Y", "place", "ipsilon", None, None), ("p", "y.", None, None, None, None), ("p", "New", None, None, None, None), ("p", "X", "place", "z", None, None), ("p", "Locked", "place", "t", None, None),
        ("p", "house stark", "term", "q", None, None), ("p", "House Stark (", "term", "q", None, None), ("p", "HOUSE  Stark", "term", None, None, None),
        ("p", "the Wall", "place", "o Muro", "en", "pt"), ("p", "Wall", "term", "Wall", "en", "pt"), ("p", "wall council", "term", None, "en", "pt"), ("p", " ", "term", "x", "en", "pt"), ("p", None, "term", "x", "en", "pt"),
    ], PROPOSAL)
    up = writes.upsert(e, al, p, 9)
    got = {r["source_term"]: (r["action"], r["entry_id"]) for r in up.outcomes.collect()}
    new = {r["source_term"]: r for r in up.entries.where("created_at = 9").collect()}
    assert set(new) == {"New", "Wall"} and (new["Wall"]["type"], new["Wall"]["target_term"], new["New"]["target_term"]) == ("place", "Muro", "New")
    assert got == {"Y": ("matched", "b"), "y.": ("folded", "b"), "X": ("matched", "a"), "Locked": ("matched", "c"), "house stark": ("folded", "d"), "House Stark (": ("folded", "d"), "HOUSE  Stark": ("folded", "d"),
                   "New": ("created", new["New"]["id"]), "Wall": ("created", new["Wall"]["id"]), "wall council": ("folded", new["Wall"]["id"])}
    held = {r["id"]: (r["type"], r["target_term"], r["updated_at"]) for r in up.entries.where("created_at < 9").collect()}
    assert held == {"a": ("character", "x", 1), "b": ("place", "ipsilon", 9), "c": ("term", "Locked", 1), "d": ("term", "Casa Stark", 2), "o": ("term", "only", 1)}
    assert {(r["entry_id"], r["text"]) for r in up.aliases.collect()} == {("d", "HOUSE  Stark"), ("b", "y."), ("d", "House Stark ("), (new["Wall"]["id"], "wall council")}
    assert [tuple(r) for r in up.revisions.collect()] == [("b", "Y", "ipsilon", "type and target", 9)]
    again = writes.upsert(up.entries, up.aliases, p, 10)
    assert again.outcomes.where("action = 'created'").count() == 0 and again.aliases.count() == up.aliases.count() and again.revisions.count() == 0
    assert writes.upsert(e, al, p.limit(0), 9).entries.count() == 5


def test_merge_moves_mentions_and_leaves_a_revision(spark):
    e = spark.createDataFrame([entry("a", "FIFA", "f"), entry("b", "Fifa", "g", "proposed"), entry("c", "Other", "o")], ENTRY)
    m = spark.createDataFrame([("s1", "b"), ("s1", "a"), ("s2", "c")], "segment_id string, entry_id string")
    out = writes.merge(e, spark.createDataFrame([("b", "target", "f")], ALIAS), m, spark.createDataFrame([("a", "a"), ("b", "a")], "id string, winner string"), 9)
    assert {(r["id"], r["updated_at"]) for r in out.entries.collect()} == {("a", 9), ("c", 1)}
    assert {tuple(r) for r in out.aliases.collect()} == {("a", "source", "Fifa"), ("a", "target", "g")}
    assert sorted(tuple(r) for r in out.mentions.collect()) == [("s1", "a"), ("s1", "a"), ("s2", "c")]
    assert [tuple(r) for r in out.revisions.collect()] == [("a", "f", "f", "merge", 9)]


def test_attach_is_idempotent(spark):
    req = "project_id string, lore_id string, mode string, priority int, place int"
    links = spark.createDataFrame([("p", "l1", "read_only", 4)], "project_id string, lore_id string, mode string, priority int")
    asked = spark.createDataFrame([("p", "l1", "writable", None, 1), ("p", "l2", "read_only", None, 2), ("p", "l2", "writable", 7, 3), ("p", "l3", "read_only", None, 4), ("p", "l4", "bad", None, 5), ("q", "l1", "read_only", None, 6), ("q", None, "read_only", None, 7)], req)
    after, events = writes.attach(links, asked, 9)
    want = {("p", "l1", "writable", 4), ("p", "l2", "read_only", 5), ("p", "l3", "read_only", 6), ("q", "l1", "read_only", 0)}
    assert {tuple(r) for r in after.collect()} == want and events.count() == 3
    again, none = writes.attach(after, asked, 9)
    assert {tuple(r) for r in again.collect()} == want and none.count() == 0
    left, gone = writes.detach(after, spark.createDataFrame([("p", "l1"), ("p", "zz")], "project_id string, lore_id string"), 9)
    assert left.count() == 3 and gone.count() == 1


def test_projects_and_runs(spark):
    p = spark.createDataFrame([("a", "A", 5.0, "en", "pt", "f", "book", 1), ("b", "B", None, "en", "pt", "g", "book", 1)], "id string, name string, budget_usd double, source_lang string, target_lang string, source_path string, kind string, created_at long")
    ch = spark.createDataFrame([("a", "A", 6.0), ("b", " ", 1.0), ("b", "B2", -1.0)], "id string, name string, budget_usd double")
    after, events, bad = writes.update_projects(p, ch, 9)
    assert {(r["id"], r["name"], r["budget_usd"]) for r in after.collect()} == {("a", "A", 6.0), ("b", "B", None)} and bad.count() == 2
    assert [json.loads(r["payload"]) for r in events.collect()] == [{"changed": ["budget_usd"]}]
    made, told = writes.create_projects(p, spark.createDataFrame([("C", "lore", "pt", "en", "f"), ("C", "lore", "pt", "en", "f")], "name string, kind string, source_lang string, target_lang string, source_path string"), 9)
    assert made.count() == 3 and told.count() == 1
    runs, links = spark.createDataFrame([], "id string, project_id string, kind string, status string, started_at long"), spark.createDataFrame([], "run_id string, entry_id string")
    inc = spark.createDataFrame([("a", "book_intake", "completed", 5, ["x", "y", "x"]), ("a", "book_intake", "completed", 5, ["x"]), ("a", "other", "completed", 5, []), ("a", None, "completed", 5, None)], "project_id string, kind string, status string, started_at long, entries array<string>")
    r, l, no = writes.record_runs(runs, links, inc)
    assert r.count() == 1 and no.count() == 2 and 1 <= l.count() <= 2
    assert writes.record_runs(r, l, inc)[0].count() == 1


def group_model(prompt):
    items = json.loads(prompt)["items"]
    if any("boom" in x["text"] for x in items):
        raise RuntimeError
    return json.dumps({"items": [{"id": x["id"], "target": "" if "blank" in x["text"] else x["text"].replace("[[T0]]", "") if "drop" in x["text"] else f"<{x['text']}>"} for x in items if "skip" not in x["text"]] + ["junk"][:0]})


def single_model(prompt):
    said = json.loads(prompt)["user"]
    if "boom" in said:
        raise RuntimeError
    return json.dumps({"target": f"({said})"})


SEGMENT = "id string, project_id string, chapter_id string, idx int, status string, source_text string, target_text string, updated_at long"


def run(spark, texts, ledger=(), group=group_model, entries=(), chapter="c"):
    s = spark.createDataFrame([(i, "p", chapter, k, st, x, None, 1) for k, (i, x, st) in enumerate(texts)], SEGMENT)
    p = spark.createDataFrame([("p", "en", "pt", "Be brief.")], "id string, source_lang string, target_lang string, style string")
    led = spark.createDataFrame(list(ledger), "project_id string, cache_key string, target string")
    return pipeline.translate(s, spark.createDataFrame(list(entries), ENTRY), spark.createDataFrame([], ALIAS), p, led, "m", single_model, group, 9)


def test_grouped_translation(spark):
    texts = [("a", "one", "pending"), ("b", "one", "pending"), ("c", "skip me", "pending"), ("d", "[[T0]]drop", "pending"), ("e", "x" * 300, "pending"), ("f", "[[T0]]" * 9 + "y", "pending"), ("g", "[[T0]]", "pending"), ("h", "done", "translated"), ("i", "blank", "pending"), ("j", None, "pending")]
    out = run(spark, texts)
    got = {r["id"]: (r["path"], r["target"], r["status"]) for r in out.outcomes.collect()}
    assert got == {"a": ("grouped", "<one>", "translated"), "b": ("grouped", "<one>", "translated"), "c": ("single", "(skip me)", "translated"), "d": ("single", "([[T0]]drop)", "translated"),
                   "e": ("single", "(" + "x" * 300 + ")", "translated"), "f": ("single", "(" + "[[T0]]" * 9 + "y)", "translated"), "g": ("trivial", "[[T0]]", "translated"), "i": ("single", "(blank)", "translated")}
    after = {r["id"]: (r["target_text"], r["status"], r["updated_at"]) for r in out.segments.collect()}
    assert after["a"] == ("<one>", "translated", 9) and after["h"] == (None, "translated", 1) and after["j"] == (None, "pending", 1) and len(after) == 10
    # the second run finds every answer in the ledger, and calls nothing
    def dead(prompt):
        raise AssertionError("called")
    held = [tuple(r) for r in out.ledger.collect()]
    again = run(spark, texts, held, dead)
    assert {r["path"] for r in again.outcomes.where("id <> 'g'").collect()} == {"cached"} and again.ledger.count() == 0


def test_a_failing_group_costs_only_its_own_items(spark):
    texts = [("a", "one", "pending"), ("b", "boom", "pending"), ("c", "two", "pending")]
    got = {r["id"]: (r["path"], r["target"], r["status"]) for r in run(spark, texts).outcomes.collect()}
    assert got == {"a": ("single", "(one)", "translated"), "b": ("failed", None, "pending"), "c": ("single", "(two)", "translated")}
    many = [(f"s{k:03d}", f"text {k}" if k != 120 else "boom", "pending") for k in range(130)]
    out = run(spark, many)
    assert {r["path"]: r["n"] for r in out.outcomes.groupBy("path").agg(F.count("*").alias("n")).collect()} == {"grouped": 100, "single": 29, "failed": 1}
    assert {r["kind"]: r["n"] for r in out.events.groupBy("kind").agg(F.count("*").alias("n")).collect()} == {"segment.translated": 129, "segment.failed": 1}
    assert run(spark, many, group=None).outcomes.where("path = 'single'").count() == 129


def test_locked_terms_flag_and_shape_the_prompt(spark):
    e = [entry("l", "wall", "muro"), entry("w", "tower", "torre", "confirmed"), entry("z", "sea", "mar", "proposed")]
    texts = [("a", "the wall", "pending"), ("b", "the tower", "pending"), ("c", "the sea", "pending"), ("d", "wall muro", "pending")]
    got = {r["id"]: (r["status"], r["missed"]) for r in run(spark, texts, entries=e).outcomes.collect()}
    assert got == {"a": ("flagged", 1), "b": ("translated", 1), "c": ("translated", 0), "d": ("translated", 0)}
    s = spark.createDataFrame([("a", "p", "c", 0, "pending", "the wall and tower", None, 1)], SEGMENT)
    p = spark.createDataFrame([("p", "en", "pt", " Be brief. ")], "id string, source_lang string, target_lang string, style string")
    entries = spark.createDataFrame(e, ENTRY)
    prompt = pipeline.prompts(s, pipeline.constraints(s, entries, spark.createDataFrame([], ALIAS)), entries, p, "m").first()["system"]
    assert prompt.splitlines()[1:] == ["Be brief.", "must: wall = muro", "use: tower = torre"]
    assert run(spark, []).outcomes.count() == 0


def test_proposals_from_answers(spark):
    said = json.dumps({"new_terms": [{"source": " Wall ", "target": " ", "type": "PLACE"}, {"source": "1990", "target": "x", "type": "term"}, {"source": "A b. C d", "target": "x"}, {"source": "Olm", "target": "Olmo", "type": "beast"}]})
    a = spark.createDataFrame([("p", "Sure: " + said), ("p", said), ("p", "no JSON"), ("p", None)], "project_id string, response string")
    assert {tuple(r) for r in pipeline.proposals(a).collect()} == {("p", "Wall", "place", None, 2), ("p", "Olm", "term", "Olmo", 2)}
