"""Problem 9: how demanding each document is to read, on the scale of its readers (1 to 5).

Method: smoothed unigram language models per level. The models are fitted on labelled documents - at most
SAMPLE_DOCS of them, chosen by hash, a bounded sample of labelled rows, with all words of it - separately for each language, so that the mix of languages at a level says nothing about a text of one
language. A document gets the level whose model gives its words the highest posterior likelihood.

Words that a single labelled document holds (names, above all) count as one unknown word. Marks that
shape sentences are words too. The language of a text is found from its own function words and script, as
the column is not reliable.

Defined results: null, empty and blank texts, and texts without any word, get a null level; labels that are
null or outside 1 to 5 are left out; repeated labels count once, differing raters each with one vote;
repeated documents get one row each; ties go to the lower level. Without any label every level is null.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from quillmill.llm import textnorm

SAMPLE_DOCS = 20_000
LEVELS = 5
SMOOTHING = 0.5

# Commonest function words of the languages.
_FUNCTION = {
    "en": "the and of to in for with by at a is that from",
    "fr": "le la les et de des un une dans du au que pour",
    "es": "el la los las y de en un una del que por con",
    "pt": "o a os as e de da do em um uma na no que com",
    "de": "der die das und den dem von zu in mit ein eine auf",
}
_BY_WORD: dict[str, list[str]] = {}
for _lang, _words in _FUNCTION.items():
    for _w in _words.split():
        _BY_WORD.setdefault(_w, []).append(_lang)
_TOKEN = re.compile(r"[ぁ-ヿ]+|[㐀-鿿々]|[^\W\d_ぁ-ヿ㐀-鿿々]+|[;:,()]")
_CJK = re.compile(r"[ぁ-ヿ㐀-鿿々]")


def tokens(text: str) -> list[str]:
    text = textnorm.repair_characters(text)
    if textnorm.FOREIGN.search(text):
        text = textnorm.TOKEN.sub(lambda m: textnorm.render(m.group(), "latin") or m.group(), text)
    return _TOKEN.findall(text.lower())


def language(toks: list[str]) -> str:
    votes: Counter = Counter()
    for t in toks:
        for lang in _BY_WORD.get(t, ()):
            votes[lang] += 1.0 / len(_BY_WORD[t])
        if _CJK.match(t):
            votes["ja"] += 1
    return min(votes, key=lambda k: (-votes[k], k)) if votes else "?"


class Model:
    """Log likelihoods per language, word and level; `fit` takes (language, level, word, count, documents of the word)."""

    def __init__(self, table: dict[str, dict[str, list[float]]], unknown: dict[str, list[float]], prior: list[float]):
        self.table, self.unknown, self.prior = table, unknown, prior

    @classmethod
    def fit(cls, rows, votes: dict[int, float]) -> "Model":
        counts: dict[str, dict[str, list[float]]] = {}
        for lang, level, word, n in rows:
            counts.setdefault(lang, {}).setdefault(word, [0.0] * LEVELS)[level - 1] += n
        table, unknown = {}, {}
        for lang, words in counts.items():
            size = len(words) + 1
            totals = [sum(v[k] for v in words.values()) for k in range(LEVELS)]
            base = [t + SMOOTHING * size for t in totals]
            table[lang] = {w: [math.log((v[k] + SMOOTHING) / base[k]) for k in range(LEVELS)] for w, v in words.items()}
            # an unknown word tells nothing about the level
            unknown[lang] = [0.0] * LEVELS
        every = sum(votes.values()) or 1.0
        prior = [math.log((votes.get(k + 1, 0.0) + 1.0) / (every + LEVELS)) for k in range(LEVELS)]
        return cls(table, unknown, prior)

    def level(self, toks: list[str]) -> tuple[int | None, float]:
        """(level, its posterior probability)"""
        if not toks or not self.table:
            return None, 0.0
        table = self.table.get(language(toks))
        score = list(self.prior)
        if table is not None:
            for w, n in Counter(toks).items():
                v = table.get(w)
                if v is not None:
                    for k in range(LEVELS):
                        score[k] += n * v[k]
        best = max(range(LEVELS), key=lambda k: (score[k], -k))
        return best + 1, 1.0 / sum(math.exp(max(-700.0, s - score[best])) for s in score)


def _labels(reading_label: DataFrame) -> DataFrame:
    votes = reading_label.where(f"reading_level BETWEEN 1 AND {LEVELS} AND doc_id IS NOT NULL").select("doc_id", "rater", "reading_level").distinct()
    return votes.groupBy("doc_id").agg(F.collect_list("reading_level").alias("levels"))


def fit(documents: DataFrame, reading_label: DataFrame) -> Model:
    labels = _labels(reading_label)
    size = labels.count()
    if size > SAMPLE_DOCS:
        labels = labels.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_003)) <= int(1_000_003 * SAMPLE_DOCS / size))
    # SAMPLE_DOCS bounds the labels, so they go to the documents and no text moves but those that are labelled
    texts = documents.where("text IS NOT NULL").select("doc_id", "text").join(F.broadcast(labels), "doc_id").dropDuplicates(["doc_id"])

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows: Counter = Counter()
            seen: Counter = Counter()
            votes: Counter = Counter()
            for text, levels in zip(pdf["text"], pdf["levels"]):
                toks = tokens(text)
                if not toks:
                    continue
                lang, each = language(toks), 1.0 / len(levels)
                for level in levels:
                    votes[level] += each
                    for w, n in Counter(toks).items():
                        rows[lang, int(level), w] += n * each
                for w in set(toks):
                    seen[lang, w] += 1
            out = [(lang, level, w, n, seen[lang, w]) for (lang, level, w), n in rows.items()]
            out += [("", int(level), "", n, 0) for level, n in votes.items()]
            yield pd.DataFrame(out, columns=["lang", "level", "word", "n", "docs"])

    counted = texts.mapInPandas(count, "lang string, level int, word string, n double, docs long")
    by = counted.groupBy("lang", "word", "level").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    words = by.groupBy("lang", "word").agg(F.collect_list(F.struct("level", "n")).alias("by"), F.max("docs").alias("docs"))
    top = words.where("word = '' OR docs > 1").collect()  # no more words than the sample holds
    votes = {x["level"]: x["n"] for r in top if r["word"] == "" for x in r["by"]}
    return Model.fit(((r["lang"], x["level"], r["word"], x["n"]) for r in top if r["word"] for x in r["by"]), votes)


def reading_levels(documents: DataFrame, reading_label: DataFrame) -> DataFrame:
    """(doc_id, level, posterior), a row for each document; a narrow pass with the fitted model."""
    shared = documents.sparkSession.sparkContext.broadcast(fit(documents, reading_label))

    kind = documents.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            texts = (t.as_py() for t in batch.column(1))
            got = [model.level(tokens(t)) if t is not None else (None, 0.0) for t in texts]
            out = [batch.column(0), pa.array([g[0] for g in got], pa.int32()), pa.array([g[1] for g in got], pa.float64())]
            yield pa.RecordBatch.from_arrays(out, names=["doc_id", "level", "posterior"])

    return documents.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, level int, posterior double")
