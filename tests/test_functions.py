"""Scalar functions: cases with known answers."""

import pytest
from pyspark.sql import functions as F

from quillmill.functions import terms, text


def one(spark, column, **values):
    cols = [F.lit(v).alias(k) for k, v in values.items()]
    return spark.range(1).select(*cols).select(column.alias("x")).first()["x"]


@pytest.mark.parametrize("raw, out", [
    ("Heavily Indebted Poor Country (HIPC) initiative", "heavily indebted poor country"), ("HIPC.", "hipc"), ("Foo (BAR", "foo"), ("  House   Stark ", "house stark"),
    ("(foo) initiative", ""), ("", ""), ("Acme Company, ", "acme"), ("Elise…", "elise"), ("Foo (a) (b)", "foo"),
])
def test_canonical_form(spark, raw, out):
    assert one(spark, terms.canonical_form(F.col("t")), t=raw) == out


@pytest.mark.parametrize("raw, out", [
    ("ＦＩＦＡ", "fifa"), ("\ufb01fa", "fifa"), ("Bohe\u0301mia", "bohémia"), ("House\u00a0Stark", "house stark"), ("Elise\u2026", "elise"), ("Foo\uff08BAR\uff09", "foo"),
    ("Acme Ｃｏｍｐａｎｙ．", "acme"), ("ﾊﾟﾘ", "パリ"), ("\u3000", ""), ("A\u2460", "a1"), (None, ""),
])
def test_canonical_form_of_compatibility_characters(spark, raw, out):
    assert one(spark, terms.canonical_form(F.col("t").cast("string")), t=raw) == out


@pytest.mark.parametrize("raw, out", [
    ("1066", True), ("1939-1945", True), ("1939–1945", True), ("1990s", True), ("1066 AD", True), ("c. 1066", True), ("(1066)", True), ("World War 1939", False),
    ("Apollo 11", False), ("12345", False), ("", False), ("circa 1905.", True),
])
def test_year_like(spark, raw, out):
    assert one(spark, terms.is_year_like(F.col("t")), t=raw) is out


@pytest.mark.parametrize("raw, out", [
    ("", "empty"), ("x" * 101, "long"), ("a b c d e f g h i j k", "wordy"), ("He left. Then she ran", "sentence"), ("Stop!", "sentence"), ("Foo (bar", "brackets"), ("1999", "year"), ("Martin Luther King Jr.", None),
])
def test_candidate_fault(spark, raw, out):
    assert one(spark, terms.candidate_fault(F.col("t")), t=raw) == out


@pytest.mark.parametrize("term, lang, particle, lemma", [
    ("the Sea", "en", "the", "Sea"), ("na Europa", "pt", "na", "Europa"), ("Europa", "pt", None, "Europa"), ("The", "en", None, "The"), ("la mer", "fr-CA", "la", "mer"), ("der Wald", "xx", None, "der Wald"), ("an  old  oak", None, "an", "old oak"),
])
def test_particles(spark, term, lang, particle, lemma):
    t, code = F.col("t"), F.col("l").cast("string")
    assert one(spark, terms.leading_particle(t, code), t=term, l=lang) == particle
    assert one(spark, terms.normalize_term(t, code), t=term, l=lang) == lemma


def test_doubled_particles(spark):
    got = one(spark, terms.doubled_particles(F.col("t"), F.lit("pt")), t="Foi na na Europa. Em em de casa casa")
    assert got == ["na", "em"]
    assert one(spark, terms.doubled_particles(F.col("t"), F.lit("pt")), t="") == []


@pytest.mark.parametrize("raw, lang, out", [
    ("'Tenho 'medo", "pt-BR", "Tenho medo"), ("l'eau 'medo", "fr", "l'eau 'medo"), ("O'Higgins '90s", "es", "O'Higgins '90s"), ("’Olá", "pt", "Olá"), ("'x", None, "'x"),
])
def test_orphan_apostrophes(spark, raw, lang, out):
    assert one(spark, text.strip_orphan_apostrophes(F.col("t"), F.col("l").cast("string")), t=raw, l=lang) == out


@pytest.mark.parametrize("raw, trivial, live", [("", True, False), ("  ", True, False), ("​", True, True), ("[[T0]] [[/T0]]", True, False), ("[[T0]]é[[/T0]]", False, True), ("\x1c", True, False)])
def test_emptiness(spark, raw, trivial, live):
    assert one(spark, text.is_trivially_empty(F.col("t")), t=raw) is trivial
    assert one(spark, text.has_translatable_text(F.col("t")), t=raw) is live


def test_preview_and_entities(spark):
    assert one(spark, text.compact_preview(F.col("t"), 10), t="[[T0]]one  two[[/T0]] three four") == "one two t…"
    assert one(spark, text.expand_entities(F.col("t")), t="j&rsquo;ai &lt; &amp;rsquo; &Prime;") == "j’ai &lt; &rsquo; ″"


@pytest.mark.parametrize("source, target, out", [(" a ", "b", " b "), (" a", " b", " b"), ("a", "b", "b"), ("  ", "b", "  b  "), ("", "b", "b"), ("a\n", "b", "b\n")])
def test_outer_whitespace(spark, source, target, out):
    assert one(spark, text.restore_outer_whitespace(F.col("s"), F.col("t")), s=source, t=target) == out


@pytest.mark.parametrize("raw, kinds, faults", [
    ("[[T0]]x[[/T0]][[T1]]", ["pair", "void"], []), ("[[T0]]x", ["pair"], ["closer 0"]), ("x", ["pair"], ["opener 0"]), ("[[T0]][[T0]]", ["void"], ["single 0"]),
    ("[[/T0]][[T0]]", ["void"], ["stray closer 0"]), ("[[T3]]", [], ["range 3"]), ("[[/T0]]x[[T0]]", ["pair"], []),
])
def test_placeholder_faults(spark, raw, kinds, faults):
    k = F.array(*[F.lit(x) for x in kinds]).cast("array<string>")
    assert one(spark, text.placeholder_faults(F.col("t"), k), t=raw) == faults


def test_recover_json(spark):
    f = terms.recover_json(F.col("t"))
    assert one(spark, f, t='{"a": 1}') == '{"a": 1}' and one(spark, f, t='Sure! {"a": 1} done') == '{"a": 1}' and one(spark, f, t="none") is None and one(spark, f, t="[1]") is None
