"""One pass of texts past the terms of their project.

A project's terms and texts meet in one stream: the terms first, then the texts in Arrow batches. A project with many
texts is cut into slices and its terms go to each. Entries whose terms read alike are sought once and written out only
as rows of the result, so what is shuffled grows with the tables and not with the pairs that match. A slice holds the
terms of one project in memory, never its texts.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Texts of a slice: at least so many, and so many that all projects together make about SLICES slices beyond one each.
SLICE_TEXTS, SLICES = 20_000, 400
#: A batch of the result ends with the text that brings it to so many rows.
BATCH_ROWS = 50_000
_WORDS = re.compile(r"\w+").findall


def _is_word(sign: str) -> bool:
    return sign.isalnum() or sign == "_"


def _stands(text: str, form: str, at: int = 0) -> int:
    """Where `form` next stands as whole words from `at` on, or -1."""
    n = len(text)
    while (at := text.find(form, at)) >= 0:
        end = at + len(form)
        if not (at and _is_word(text[at - 1])) and not (end < n and _is_word(text[end])):
            return at
        at += 1
    return -1


def spans(text: str, forms: tuple[str, ...]) -> list[tuple[int, int]]:
    """Leftmost, longest, non-overlapping hits of an entry; the longest form comes first. The same as the pattern of G01."""
    out, at = [], 0
    ahead = [(_stands(text, f), f) for f in forms]
    while ahead := [(p, f) for p, f in ((p if p < 0 or p >= at else _stands(text, f, at), f) for p, f in ahead) if p >= 0]:
        p, f = min(ahead, key=lambda x: x[0])  # of equal places the first, which is the longest
        at = p + len(f)
        out.append((p, at))
    return out


class Glossary:
    """The terms of one project. Entries with the same forms on both sides and the same tag are one group."""

    def __init__(self, batches: list[pa.RecordBatch]):
        forms: dict = defaultdict(lambda: (set(), set()))
        info: dict = {}
        for b in batches:
            for side, entry, term, tag, first in zip(*(b.column(c).to_pylist() for c in ("kind", "id", "text", "tag", "other"))):
                if term:
                    forms[entry][side].add(term)
                else:
                    forms[entry]
                info[entry] = (tag, first)
        ids = sorted(forms, key=lambda x: (x is not None, x))
        groups: dict = {}
        members: list[list[int]] = []
        self.first: dict[str, list[int]] = defaultdict(list)
        self.group_of = np.zeros(len(ids), np.int64)
        for k, entry in enumerate(ids):
            tag, first = info[entry]
            a, b = (tuple(sorted(s, key=lambda t: (-len(t), t))) for s in forms[entry])
            at = groups.setdefault((a, b, tag), len(groups))
            if at == len(members):
                members.append([])
            members[at].append(k)
            self.group_of[k] = at
            if first is not None:
                self.first[first].append(k)
        self.ids = pa.array(ids, pa.string())
        self.forms = [[g[side] for g in groups] for side in (0, 1)]
        self.tags = [g[2] for g in groups]
        self.sizes = np.array([len(m) for m in members], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.members = np.array([k for m in members for k in m], np.int64)
        self.index = [self._index(side) for side in (0, 1)]

    def _index(self, side: int) -> dict:
        """By the word of a form that fewest forms have, else by None: the forms, each with its groups."""
        owners: dict[str, list[int]] = defaultdict(list)
        for at, forms in enumerate(self.forms[side]):
            for f in forms:
                owners[f].append(at)
        words = {f: set(_WORDS(f)) for f in owners}
        often = Counter(w for ws in words.values() for w in ws)
        out: dict = defaultdict(list)
        for f, ws in words.items():
            out[min(ws, key=lambda w: (often[w], -len(w), w)) if ws else None].append((f, owners[f]))
        return dict(out)

    def found(self, text: str | None, side: int = 0) -> set[int]:
        """The groups of which a form stands in the text."""
        out: set[int] = set()
        index = self.index[side]
        if text and index:
            for word in [w for w in set(_WORDS(text)) if w in index] + [None]:
                for form, groups in index.get(word, ()):
                    if _stands(text, form) >= 0:
                        out.update(groups)
        return out

    def expand(self, groups: list[int]) -> tuple[np.ndarray, np.ndarray]:
        """For each group all its entries: the place in the list, and the entry."""
        at = np.array(groups, np.int64)
        n = self.sizes[at]
        within = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        return np.repeat(np.arange(len(at)), n), self.members[np.repeat(self.starts[at], n) + within]


def _column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def _cut(g: Glossary, texts: pa.RecordBatch, find: Callable) -> Iterator[list[tuple]]:
    """find(text, other, row) -> tuples that begin with (row, group); in lists of whole texts with some BATCH_ROWS rows."""
    rows: list[tuple] = []
    size = 0
    for k, (text, other) in enumerate(zip(_column(texts, "text").to_pylist(), _column(texts, "other").to_pylist())):
        for x in find(text, other, k):
            rows.append(x)
            size += g.sizes[x[1]]
        if size >= BATCH_ROWS:
            yield rows
            rows, size = [], 0
    if rows:
        yield rows


class Mentions:
    """All hits with their spans; `placed` numbers those of a text by (start, end, entry), `carry` adds the carried columns."""

    def __init__(self, placed: bool = False, carry: bool = False):
        self.placed, self.carry = placed, carry

    def texts(self, g: Glossary, texts: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for rows in _cut(g, texts, lambda text, _, k: ((k, at, text[a:b], a, b) for at in g.found(text) for a, b in spans(text, g.forms[0][at]))):
            k, at, term, a, b = zip(*rows)
            nth, entry = g.expand(at)
            k, a, b, more = np.array(k)[nth], np.array(a, np.int32)[nth], np.array(b, np.int32)[nth], []
            if self.placed:
                order = np.lexsort((entry, b, a, k))
                nth, entry, k, a, b = nth[order], entry[order], k[order], a[order], b[order]
                begins = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
                more = [pa.array((np.arange(len(k)) - np.repeat(begins, np.diff(np.r_[begins, len(k)])) + 1).astype(np.int32))]
            if self.carry:
                more += [c.take(pa.array(k)) for c in _column(texts, "carry").flatten()]
            yield [_column(texts, "id").take(pa.array(k)), g.ids.take(pa.array(entry)), pa.array(term, pa.string()).take(pa.array(nth)), pa.array(a), pa.array(b), *more]

    def end(self, g: Glossary) -> Iterator[list[pa.Array]]:
        return iter(())


class Pairs(Mentions):
    """(segment_id, entry_id) of each entry that a text mentions, and the tag of the entry where `tagged`."""

    def __init__(self, tagged: bool = False):
        super().__init__()
        self.tagged = tagged

    def find(self, g: Glossary, text: str | None, other: str | None) -> set[int]:
        return g.found(text)

    def texts(self, g: Glossary, texts: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for rows in _cut(g, texts, lambda text, other, k: ((k, at) for at in self.find(g, text, other))):
            k, at = zip(*rows)
            nth, entry = g.expand(at)
            tags = [pa.array([g.tags[x] for x in at], pa.string()).take(pa.array(nth))] if self.tagged else []
            yield [_column(texts, "id").take(pa.array(np.array(k)[nth])), g.ids.take(pa.array(entry)), *tags]


class Lost(Pairs):
    """Pairs whose entry stands in the text and with no form of its other side in the other text."""

    def find(self, g: Glossary, text: str | None, other: str | None) -> set[int]:
        hit = g.found(text)
        return hit - g.found(other, 1) if hit else hit


class LostByText(Lost):
    """Of each text with lost entries whether one is tagged `error`, and their number."""

    def texts(self, g: Glossary, texts: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        by: dict[int, list[int]] = defaultdict(list)
        for rows in _cut(g, texts, lambda text, other, k: ((k, at) for at in self.find(g, text, other))):
            for k, at in rows:
                by[k].append(at)
        yield [_column(texts, "id").take(pa.array(list(by), pa.int64())), pa.array([any(g.tags[x] == "error" for x in ats) for ats in by.values()], pa.bool_()), pa.array([int(g.sizes[ats].sum()) for ats in by.values()], pa.int64())]


class FirstSeen(Pairs):
    """Tagged pairs with `true`; and with `false` those entries that name the text as their first one and do not stand in it."""

    def texts(self, g: Glossary, texts: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        for segment, entry, tag in Pairs(True).texts(g, texts):
            yield [segment, entry, tag, pa.array(np.ones(len(tag), bool))]
        bare = [(s, e) for s, text in zip(_column(texts, "id").to_pylist(), _column(texts, "text").to_pylist()) if s in g.first for hit in [g.found(text)] for e in g.first[s] if g.group_of[e] not in hit]
        yield [pa.array([s for s, _ in bare], pa.string()), g.ids.take(pa.array([e for _, e in bare], pa.int64())), pa.array([g.tags[g.group_of[e]] for _, e in bare], pa.string()), pa.array(np.zeros(len(bare), bool))]


class Counts(Mentions):
    """(entry_id, mentions, segments) of one slice; mentions only where `spanned`, else 0."""

    def __init__(self, spanned: bool):
        super().__init__()
        self.spanned = spanned

    def texts(self, g: Glossary, texts: pa.RecordBatch) -> Iterator[list[pa.Array]]:
        n = g.__dict__.setdefault("counted", np.zeros((2, len(g.sizes)), np.int64))
        for text in _column(texts, "text").to_pylist():
            for at in g.found(text):
                n[1, at] += 1
                if self.spanned:
                    n[0, at] += len(spans(text, g.forms[0][at]))
        return iter(())

    def end(self, g: Glossary) -> Iterator[list[pa.Array]]:
        n = g.__dict__.get("counted")
        if n is not None and n.any():
            at = np.flatnonzero(n[1])
            nth, entry = g.expand(at)
            yield [g.ids.take(pa.array(entry)), pa.array(n[0][at][nth]), pa.array(n[1][at][nth])]


def _runs(batch: pa.RecordBatch) -> Iterator[tuple[tuple, bool, pa.RecordBatch]]:
    """Parts of a batch with one project, slice and kind (terms or texts)."""
    project, part = _column(batch, "project_id").dictionary_encode(), _column(batch, "slice").to_numpy()
    text = _column(batch, "kind").to_numpy() == 2
    code = project.indices.to_numpy()
    cuts = np.flatnonzero((code[1:] != code[:-1]) | (part[1:] != part[:-1]) | (text[1:] != text[:-1])) + 1
    for a, b in zip([0, *cuts], [*cuts, batch.num_rows]):
        yield (project.dictionary[int(code[a])].as_py(), int(part[a])), bool(text[a]), batch.slice(a, b - a)


def scan(texts: DataFrame, terms: DataFrame, kernel: Mentions, schema: str, carry: tuple[str, ...] = ()) -> DataFrame:
    """texts(segment_id, project_id, text, other or none, carried columns), terms(project_id, entry_id, term, side of 0 or 1, tag and first or none) -> rows of the kernel.

    A text is one row; its entries all meet it in one place.
    """
    has = lambda df, c, kind="string": F.col(c) if c in df.columns else F.lit(None).cast(kind)
    said = texts.where("project_id IS NOT NULL AND segment_id IS NOT NULL")
    sizes = said.groupBy("project_id").agg(F.count("*").alias("n"))
    part = F.greatest(F.lit(SLICE_TEXTS), F.ceil(F.col("total") / SLICES))
    # fewer than SLICES projects are larger than such a part of all texts
    large = F.broadcast(sizes.crossJoin(sizes.agg(F.sum("n").alias("total"))).where(F.col("n") > part).select("project_id", F.ceil(F.col("n") / part).cast("int").alias("slices")))
    carried = [F.struct(*carry).alias("carry")] if carry else []
    s = said.join(large, "project_id", "left").select(
        "project_id", F.coalesce(F.pmod(F.xxhash64("segment_id"), "slices").cast("int"), F.lit(0)).alias("slice"), F.lit(2).alias("kind"), F.col("segment_id").alias("id"), "text", has(texts, "other").alias("other"), F.lit(None).cast("string").alias("tag"), *carried)
    t = terms.where("project_id IS NOT NULL").join(large, "project_id", "left").select(
        "project_id", F.explode(F.sequence(F.lit(0), F.coalesce("slices", F.lit(1)) - 1)).alias("slice"), (F.col("side") if "side" in terms.columns else F.lit(0)).alias("kind"), F.col("entry_id").alias("id"), F.col("term").alias("text"), has(terms, "first").alias("other"), has(terms, "tag").alias("tag"),
        *([F.lit(None).cast(s.schema["carry"].dataType).alias("carry")] if carry else []))
    stream = t.unionByName(s).repartition("project_id", "slice").sortWithinPartitions("project_id", "slice", "kind")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, g = None, [], None

        def made(rows: Iterator[list[pa.Array]]) -> Iterator[pa.RecordBatch]:
            for columns in rows:
                yield pa.RecordBatch.from_arrays(columns, names)

        for batch in batches:
            if not batch.num_rows:
                continue
            for at, is_text, rows in _runs(batch):
                if at != key:
                    if g is not None:
                        yield from made(kernel.end(g))
                    key, held, g = at, [], None
                if not is_text:
                    held.append(rows)
                elif held:
                    if g is None:
                        g, held = Glossary(held), [None]
                    yield from made(kernel.texts(g, rows))
        if g is not None:
            yield from made(kernel.end(g))

    names = [x.split()[0] for x in schema.split(", ")]
    return stream.mapInArrow(run, schema)
