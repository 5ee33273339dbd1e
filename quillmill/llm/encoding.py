"""Problem 7: token ids of every text by a public tokenizer.

Method: monoid tree reduction. A text longer than LEAF characters is cut into halves, recursively; the leaves
are encoded and neighbours joined pairwise up the tree. At a join, a window around the border is encoded
anew. It grows on both sides until its edges are provable: a place between a letter or digit and a blank
that a letter or digit follows ends a match of the tokenizer's pattern and starts the next one whatever
stands around it, so tokens outside the window keep their ids in any context. Where no such place exists,
the window grows to the whole. Decoding concatenates up the tree, as ids decode to bytes one by one.

Defined results: null and empty texts give an empty list; strings of special tokens are ordinary text; lone
surrogates cannot occur in Parquet strings; a null id keeps its row; a repeated row gives a row each time.
"""

from __future__ import annotations

import base64
import os
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

TOKENIZER_DIR = "/opt/tokenizers"
LEAF = 1024
# Fixed value: the pattern of the byte-level vocabularies of 50,256 ranks.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

_held: dict = {}


def encoder(name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR):
    """The encoder, loaded once per Python worker."""
    import tiktoken

    key = (folder, name)
    if key not in _held:
        with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        _held[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _held[key]


def _word(c: str) -> bool:
    return c.isalpha() or c.isdecimal()


def _provable(text: str, k: int) -> bool:
    """A token border at `k` in any context: a word character, then one blank, then a word character."""
    return 0 < k < len(text) - 1 and text[k] == " " and _word(text[k - 1]) and _word(text[k + 1])


def _edge(text: str, start: int, step: int, stop: int) -> int:
    k = start
    while k != stop:
        if _provable(text, k):
            return k
        k += step
    return stop


class _Span:
    """Ids of text[lo:hi], as pieces between provable borders, so that a join replaces only pieces at its border."""

    __slots__ = ("cuts", "ids")

    def __init__(self, cuts: list[int], ids: list[list[int]]):
        self.cuts, self.ids = cuts, ids


def _encode_span(text: str, lo: int, hi: int, enc, leaf: int) -> _Span:
    if hi - lo <= leaf:
        # keep the first and last provable borders of the leaf as places where a join may stop
        a, b = _edge(text, lo + 1, 1, hi), _edge(text, hi - 1, -1, lo)
        cuts = [lo, a, b, hi] if lo < a < b < hi else [lo, hi]
        return _Span(cuts, [enc(text[x:y]) for x, y in zip(cuts, cuts[1:])])
    mid = (lo + hi) // 2
    return _join(text, _encode_span(text, lo, mid, enc, leaf), _encode_span(text, mid, hi, enc, leaf), enc)


def _join(text: str, left: _Span, right: _Span, enc) -> _Span:
    # outer edges of a span are provable or not; all inner cuts are. Grow the window to the next inner cut.
    i = len(left.cuts) - 2
    j = 1
    a, b = left.cuts[i], right.cuts[j]
    ids = enc(text[a:b])
    return _Span(left.cuts[:i] + [a, b] + right.cuts[j + 1 :], left.ids[:i] + [ids] + right.ids[j:])


def encode(text: str | None, enc, leaf: int = LEAF) -> list[int]:
    """Ids of a text; `enc` encodes a str without special tokens."""
    if not text:
        return []
    if len(text) <= leaf:
        return enc(text)
    span = _encode_span(text, 0, len(text), enc, leaf)
    return [i for ids in span.ids for i in ids]


def decode(ids, name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> str:
    return encoder(name, folder).decode_bytes(list(ids)).decode("utf-8")


def _ids_of(texts: pa.Array, enc) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of a column of texts, flat, so that no list objects pile up."""
    offsets, flat = [0], []
    for t in texts:
        flat.append(np.asarray(encode(t.as_py(), enc), dtype=np.int32))
        offsets.append(offsets[-1] + len(flat[-1]))
    return np.asarray(offsets, dtype=np.int32), np.concatenate(flat) if flat else np.empty(0, dtype=np.int32)


def token_ids(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """(doc_id, ids), a row for each row; a narrow pass, so no row moves. Ids of documents pass through as they are."""
    kind = documents.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder).encode_ordinary
        for batch in batches:
            offsets, ids = _ids_of(batch.column(1), enc)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[id_col, "ids"])

    return documents.select(id_col, text_col).mapInArrow(run, f"`{id_col}` {kind}, ids array<int>")


def token_counts(documents: DataFrame, keep: list[str], text_col: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZER_DIR) -> DataFrame:
    """The kept columns and `tokens`; the ids themselves never leave the worker."""
    fields = ", ".join(f"`{c}` {documents.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(name, folder).encode_ordinary
        for batch in batches:
            counts = pa.array([len(encode(t.as_py(), enc)) for t in batch.column(len(keep))], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], counts], names=[*keep, "tokens"])

    return documents.select(*keep, F.col(text_col).alias("_text")).mapInArrow(run, f"{fields}, tokens long")
