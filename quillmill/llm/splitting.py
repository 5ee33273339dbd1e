"""Problem 4: cut texts larger than a limit into pieces at natural boundaries, with an overlap.

Method: balanced targets. The least number of pieces that can work is computed, equal-length targets are
placed, and each target is snapped to the strongest boundary near it (paragraph, sentence, clause, space,
else any place outside an inline mark); where a piece would exceed the limit, more pieces are tried, in steps
that double until a number works, and the least number that works is then found by bisection.

A piece runs from its start to its cut; the next one starts up to `overlap` characters before that cut, at
the first word start (or, in text without spaces, any place outside a mark) of that stretch.

Defined results: texts within the limit, null and empty texts give no piece; a limit that is null or below 1
splits nothing; a negative or null overlap counts as 0, one not smaller than the limit is one less than it; a mark longer than the limit is the one thing cut inside; repeated ids count once.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from quillmill.llm import textnorm

_PARAGRAPH = re.compile(r"\n\s*")
_SENTENCE = re.compile(r"[.!?…]+[\"'”’»)\]]*\s+|[。！？]+[」』）]*")
_CLAUSE = re.compile(r"[;:,]\s+|\s[|—–]\s|[、；：，]")
_SPACE = re.compile(r"\s+")
#: How far from its target a cut may move for each strength, as a share of the mean piece.
_RANGE = (0.5, 0.5, 0.3, 0.3)


def _boundaries(text: str) -> list[list[int]]:
    """Places where a piece may end, strongest kind first; none lies inside a mark."""
    marks = [(m.start(), m.end()) for m in textnorm.MARK.finditer(text)]
    starts = [a for a, _ in marks]

    def free(k: int) -> bool:
        at = bisect_left(starts, k) - 1
        return at < 0 or k >= marks[at][1]

    return [sorted({m.end() for m in rx.finditer(text) if 0 < m.end() < len(text) and free(m.end())}) for rx in (_PARAGRAPH, _SENTENCE, _CLAUSE, _SPACE)]


def _outside(k: int, marks: list[tuple[int, int]], starts: list[int], low: int, high: int) -> int:
    """`k`, or where the mark that holds it starts, if that lies after `low`, or ends, if that is not beyond `high`."""
    at = bisect_left(starts, k) - 1
    if at >= 0 and marks[at][0] < k < marks[at][1]:
        a, b = marks[at]
        return a if a > low else b if b <= high else k
    return k


def _plain_cuts(n: int, limit: int, marks: list[tuple[int, int]], starts: list[int]) -> list[tuple[int, int]]:
    """Full pieces one after the other, outside marks: what always works."""
    out, start = [], 0
    while start < n:
        cut = min(n, start + limit)
        if cut < n:
            cut = _outside(cut, marks, starts, start, start + limit)
        out.append((start, cut))
        start = cut
    return out


def split(text: str, limit: int, overlap: int = 0) -> list[tuple[int, int]]:
    """(start, end) of each piece of a text longer than `limit`; the pieces cover the text."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    overlap = max(0, min(overlap, limit - 1))
    marks = [(m.start(), m.end()) for m in textnorm.MARK.finditer(text)]
    starts = [a for a, _ in marks]
    kinds = _boundaries(text)
    lay = lambda count: _layout(text, limit, overlap, count, marks, starts, kinds)
    count = max(2, -(-(n - overlap) // (limit - overlap)))
    pieces, failed, step = lay(count), count, 1
    while pieces is None and failed + step < n:
        count = failed + step
        pieces = lay(count)
        if pieces is None:
            failed, step = count, 2 * step
    if pieces is None:
        return _plain_cuts(n, limit, marks, starts)
    while count - failed > 1:
        mid = (failed + count) // 2
        tried = lay(mid)
        if tried is None:
            failed = mid
        else:
            count, pieces = mid, tried
    return pieces


def _layout(text: str, limit: int, overlap: int, count: int, marks: list, starts: list, kinds: list) -> list[tuple[int, int]] | None:
    """`count` pieces of about equal length, or None where one of them exceeds the limit."""
    n = len(text)
    pieces, start, cut_before = [], 0, 0
    for k in range(1, count):
        left = count - k + 1
        mean = (n - cut_before) / left
        target = cut_before + mean
        # a cut must keep this piece within the limit and leave no more than the rest can hold
        high = start + limit
        at = bisect_left(starts, cut_before)
        if at < len(starts) and starts[at] == cut_before and marks[at][1] > high:
            start, high = cut_before, cut_before + limit  # the overlap would leave no room for the next mark
        low = max(cut_before + 1, n - (left - 1) * (limit - overlap))
        low = min(low, high)
        cut = None
        for reach, places in zip(_RANGE, kinds):
            a, b = max(low, int(target - reach * mean)), min(high, int(target + reach * mean))
            i, j = bisect_left(places, a), bisect_right(places, b)
            if i < j:
                near = bisect_left(places, target, i, j)
                cut = min((places[x] for x in (near - 1, near) if i <= x < j), key=lambda p: (abs(p - target), p))
                break
        if cut is None:
            cut = _outside(int(min(high, max(low, target))), marks, starts, cut_before, high)
        if cut - start > limit:
            return None
        pieces.append((start, cut))
        cut_before = cut
        start = _restart(text, pieces[-1][0], cut, overlap, kinds, marks, starts)
        if cut >= n:
            break
    if cut_before < n:
        if n - start > limit:
            return None
        pieces.append((start, n))
    return pieces


def _restart(text: str, start: int, cut: int, overlap: int, kinds: list[list[int]], marks: list, starts: list) -> int:
    if not overlap:
        return cut
    low = max(start + 1, cut - overlap)
    for places in (kinds[3], kinds[2]):
        i = bisect_left(places, low)
        if i < len(places) and places[i] <= cut:
            return places[i]
    at = bisect_left(starts, low) - 1
    if at >= 0 and marks[at][0] < low < marks[at][1]:
        low = min(cut, marks[at][1])
    return low


PIECES = "segment_id string, host_part int, host_total_parts int, start int, end int, text string"


def oversized_pieces(segments: DataFrame, policy: DataFrame) -> DataFrame:
    """Pieces of every segment whose source text has more code points than its project allows.

    The length is tested in the JVM before anything moves; only oversized texts reach Python, each alone.
    """
    rules = policy.where("max_chars >= 1").select("project_id", "max_chars", F.coalesce("overlap_chars", F.lit(0)).alias("overlap_chars"))
    over = (
        segments.where("id IS NOT NULL").select("id", "project_id", "source_text").join(rules, "project_id")
        .where(F.length("source_text") > F.col("max_chars"))
        .dropDuplicates(["id"]).select("id", "source_text", "max_chars", "overlap_chars")
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for i, text, limit, overlap in pdf.itertuples(index=False):
                cuts = split(text, int(limit), int(overlap))
                rows += [(i, k, len(cuts), a, b, text[a:b]) for k, (a, b) in enumerate(cuts)]
            yield pd.DataFrame(rows, columns=["segment_id", "host_part", "host_total_parts", "start", "end", "text"])

    return over.mapInPandas(run, PIECES)
