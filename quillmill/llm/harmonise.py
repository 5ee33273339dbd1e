"""Problem 1: bring text that looks the same to one form.

Method: script-aware repair. Characters are repaired first (width, composition, invisible ones, spaces). Then the
dominant script of every token is determined, by the letters that no other script shows. In a token that mixes
scripts the look-alikes are rewritten to the dominant script if the result is a word of the corpus; if it is none,
to the script whose rendering is the most frequent word. A token whose letters tell no script takes that of its
text, and a text without any such letter that of most texts, so equal-looking texts always decide alike.

Two additions that the required result asks for. A token wholly in look-alikes of another script than its text
(`сор` in a Latin sentence) mixes nothing by itself; it is rewritten if texts of that script hold the word in their
own letters. So Russian text stays as it is beside Latin `a`, `c` and `y`. And where two different damaged spellings
lead to one form of the dominant script that no text holds undamaged, they are both rewritten to it: else
two records would stay apart because both are damaged.

Plain rows (no character that could need repair, and a letter that is surely Latin wherever there are Latin letters)
are handled by the JVM alone; only the rest goes through Arrow. Vocabulary counts cover every row and are aggregated
before they are shuffled.

Defined results: null text gives a null form; empty, blank and invisible texts give an empty form; repeated
ids count once; ties between scripts go by the order Latin, Greek, Cyrillic, Armenian, Cherokee.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from quillmill.llm import textnorm
from quillmill.runtime import cut_lineage

#: Rows of one class of equal-looking texts that are joined in one block.
BLOCK_ROWS = 2000
#: At most so many candidate words are broadcast; beyond, words are counted first and joined by a shuffle.
BROADCAST_WORDS = 200_000


REPAIRED = "table_name string, id string, raw string, form string, context string, most string, odd array<string>"


def _odd(form: str, context: str | None) -> list[str]:
    """Tokens that may need another script: those with foreign letters, and in a text that is not surely Latin all in look-alikes."""
    shared = textnorm.SHARED["latin"]
    return sorted({t for t in textnorm.TOKEN.findall(form) if textnorm.FOREIGN.search(t) or context != "latin" and shared.issuperset(t)})


def _repair(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        form = [None if t is None else textnorm.repair_characters(t) for t in pdf["raw"]]
        foreign = [f is not None and textnorm.FOREIGN.search(f) is not None for f in form]
        context = [None if f is None else textnorm.dominant(f) for f in form]
        most = [None if f is None else c or textnorm.majority(f) for f, c in zip(form, context)]
        odd = [_odd(f, c) if f is not None and (x or c != "latin") else [] for f, c, x in zip(form, context, foreign)]
        yield pd.DataFrame({"table_name": pdf["table_name"], "id": pdf["id"], "raw": pdf["raw"], "form": form, "context": context, "most": most, "odd": odd})


def _candidates(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(t, x, k, c, len(textnorm.scripts_of(t)) > 1) for t, x in zip(pdf["token"], pdf["context"]) for k, c in textnorm.renderings(t, x)]
        yield pd.DataFrame(rows, columns=["token", "context", "rank", "candidate", "mixed"])


def _apply(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        pdf["form"] = [textnorm.substitute(f, dict(p) if p is not None else {}) for f, p in zip(pdf["form"], pdf["pairs"])]
        yield pdf[["table_name", "id", "raw", "form"]]


def _is_plain(text: Column) -> Column:
    blanks = text.contains("  ") | text.startswith(" ") | text.endswith(" ")
    return ~blanks & ~text.rlike(textnorm.JAVA_UNPLAIN) & (text.rlike(textnorm.JAVA_SURELY_LATIN) | ~text.rlike(textnorm.JAVA_LATIN))


def _usual_script(rows: DataFrame, rest: DataFrame) -> str:
    """The script of most texts, for texts whose letters tell none: by surely written texts, else by all. A few rows reach the driver."""
    counts = rest.groupBy("context", "most").count().collect()
    surely = F.col("raw").rlike(textnorm.JAVA_SURELY_LATIN)
    sure = {"latin": rows.where(surely).count() - rest.where(surely).count()}  # the plain rows are all others
    any_ = {}
    for r in counts:
        if r["context"]:
            sure[r["context"]] = sure.get(r["context"], 0) + r["count"]
        elif r["most"]:
            any_[r["most"]] = any_.get(r["most"], 0) + r["count"]
    seen = sure if any(sure.values()) else any_
    return max(textnorm.SCRIPTS, key=lambda s: seen.get(s, 0))


def _decided(odd: DataFrame, words: DataFrame) -> DataFrame:
    """(token, context, repaired) of the odd tokens that are rewritten; words(word, context) are all tokens of the corpus."""
    tokens = odd.select("context", F.explode("odd").alias("token")).distinct()
    candidates = cut_lineage(tokens.mapInPandas(_candidates, "token string, context string, rank int, candidate string, mixed boolean"))
    wanted = candidates.select(F.col("candidate").alias("word")).distinct()
    if wanted.count() <= BROADCAST_WORDS:
        counts = words.join(F.broadcast(wanted), "word", "left_semi").groupBy("word", "context").agg(F.count("*").alias("n"))
    else:
        counts = words.groupBy("word", "context").agg(F.count("*").alias("n")).join(wanted, "word", "left_semi")
    vocabulary = cut_lineage(counts.select(F.col("word").alias("candidate"), F.col("context").alias("seen_in"), "n"))
    everywhere = vocabulary.groupBy("candidate").agg(F.sum("n").alias("n"))
    here = vocabulary.select("candidate", F.col("seen_in").alias("context"), F.col("n").alias("n_here"))
    support = candidates.where("mixed AND rank = 0").groupBy("candidate").agg(F.countDistinct("token").alias("spellings"))
    met = candidates.join(everywhere, "candidate", "left").join(here, ["candidate", "context"], "left").join(support, "candidate", "left")
    # a mixed token: its dominant script if that is a word, else the most frequent word, else what two damaged spellings agree on
    mixed = (
        met.where("mixed AND (n IS NOT NULL OR rank = 0 AND spellings > 1)").groupBy("token", "context")
        .agg(F.min_by("candidate", F.struct(F.col("n").isNull(), F.col("rank") != 0, -F.coalesce("n", F.lit(0)), "rank")).alias("repaired"))
    )
    # a token in one script, all of look-alikes: the script of its text, if texts of that script hold the word
    pure = met.where("NOT mixed AND rank = 0 AND n_here IS NOT NULL").select("token", "context", F.col("candidate").alias("repaired"))
    return mixed.unionByName(pure).where("token <> repaired")


def harmonise(rows: DataFrame) -> DataFrame:
    """rows(table_name, id, raw) -> (table_name, id, raw, form); given rows that are equal may come out once."""
    rows = rows.select(F.col("table_name").cast("string"), F.col("id").cast("string"), F.col("raw").cast("string"))
    plain = rows.where(_is_plain(F.col("raw"))).withColumn("form", F.col("raw"))
    rest = cut_lineage(rows.where(F.coalesce(~_is_plain(F.col("raw")), F.lit(True))).mapInPandas(_repair, REPAIRED))
    usual = _usual_script(rows, rest)
    rest = rest.withColumn("context", F.coalesce("context", F.lit(usual))).drop("most")
    odd = rest.where(F.size("odd") > 0)
    split = F.explode(F.regexp_extract_all("form", F.lit(textnorm.JAVA_TOKEN), 1)).alias("word")
    words = plain.select(split, F.lit("latin").alias("context")).unionByName(rest.select(split, "context"))
    per_row = (
        odd.select("table_name", "id", "raw", "form", "context", F.explode("odd").alias("token"))
        .join(_decided(odd, words), ["token", "context"], "left")
        .groupBy("table_name", "id", "raw", "form")
        .agg(F.map_from_entries(F.collect_set(F.when(F.col("repaired").isNotNull(), F.struct("token", "repaired")))).alias("pairs"))
    )
    repaired = per_row.mapInPandas(_apply, "table_name string, id string, raw string, form string")
    return plain.unionByName(rest.where(F.size("odd") <= 0).drop("odd", "context")).unionByName(repaired)


def _keyed(forms: DataFrame) -> DataFrame:
    letters = F.regexp_replace("form", r"\[\[/?T\d+\]\]", "").rlike(r"[\p{L}\p{N}]")
    return (
        forms.where(F.col("form").isNotNull() & F.col("id").isNotNull() & letters)
        .select("table_name", "id", F.unhex(F.md5("form")).alias("k"), F.unhex(F.md5("raw")).alias("r"))
        .distinct()
    )


def look_alike_classes(forms: DataFrame) -> DataFrame:
    """(table_name, id, class_id, members, spellings, differing) of every record with another that looks the same.

    `class_id` is the smallest id of those that look alike, `spellings` the number of their different texts and
    `differing` the number of members written otherwise than this one: its links, without a row for each.
    """
    keyed = cut_lineage(_keyed(forms))
    spelled = keyed.groupBy("table_name", "k", "r").agg(F.count("*").alias("copies"), F.min("id").alias("first"))
    classes = spelled.groupBy("table_name", "k").agg(F.sum("copies").alias("members"), F.count("*").alias("spellings"), F.min("first").alias("class_id")).where("spellings > 1")
    rows = spelled.join(classes, ["table_name", "k"]).select("table_name", "k", "r", "class_id", "members", "spellings", (F.col("members") - F.col("copies")).alias("differing"))
    return keyed.join(rows, ["table_name", "k", "r"]).select("table_name", "id", "class_id", "members", "spellings", "differing")


def look_alike_pairs(forms: DataFrame) -> DataFrame:
    """Pairs of records of one table with equal form and different characters: (table_name, left_id, right_id).

    Only hashes of 128 bits travel. Classes are joined in salted blocks, so that a form that a large part of
    all rows share spreads over many tasks.
    """
    keyed = _keyed(forms)
    classes = (
        keyed.groupBy("table_name", "k")
        .agg(F.min("r").alias("lo"), F.max("r").alias("hi"), F.count("*").alias("n"))
        .where("lo <> hi")
        .select("table_name", "k", F.greatest(F.lit(1), F.ceil(F.col("n") / BLOCK_ROWS)).cast("int").alias("blocks"))
    )
    members = cut_lineage(keyed.join(classes, ["table_name", "k"]))
    left = members.select("table_name", "k", F.col("id").alias("left_id"), F.col("r").alias("lr"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    right = members.select("table_name", "k", F.col("id").alias("right_id"), F.col("r").alias("rr"), F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int").alias("block"))
    return left.join(right, ["table_name", "k", "block"]).where("lr <> rr AND left_id < right_id").select("table_name", "left_id", "right_id").distinct()
