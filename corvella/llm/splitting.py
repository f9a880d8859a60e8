"""Cutting oversized texts into overlapping pieces at natural boundaries.

Every possible cut has a strength (blank line, line end, sentence end, clause end, space, nothing).
A sparse table answers "strongest cut in this window of lengths" in constant time; equal strengths go to the
rightmost cut, so that pieces are as long as their boundary allows.  The next piece starts ``overlap`` characters
before the cut.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

DEFAULT_LIMIT, DEFAULT_OVERLAP = 800, 200
_SENTENCE_ENDS = ".!?؟。！？…"
_CLAUSE_ENDS = ",;:،؛"
_PAGE = 1 << 16


def cut_strengths(codes: np.ndarray) -> np.ndarray:
    """Strength of a cut before each character: 5 blank line, 4 line end, 3 sentence, 2 clause, 1 space, 0 none."""
    n = len(codes)
    out = np.zeros(n + 1, np.int64)
    if n < 2:
        return out
    newline = codes == 10
    space = newline | (codes == 32) | (codes == 9) | (codes == 13) | (codes == 0xA0)
    before = np.concatenate([[0], codes[:-1]])
    # the last character that is not white space, for texts with several spaces after a full stop
    marks = np.where(space, 0, np.arange(n) + 1)
    last = np.maximum.accumulate(marks)
    lead = np.where(last > 0, codes[np.maximum(last - 1, 0)], 0)
    strength = np.where(space, 1, 0)
    strength[space & np.isin(lead, [ord(c) for c in _CLAUSE_ENDS])] = 2
    strength[space & np.isin(lead, [ord(c) for c in _SENTENCE_ENDS])] = 3
    strength[newline] = 4
    real = ~((codes == 13) | (codes == 32) | (codes == 9))  # blank lines may hold spaces
    seen = np.maximum.accumulate(np.where(real, np.arange(n), -1))
    earlier = np.concatenate([[-1], seen[:-1]])
    blank = newline & (earlier >= 0) & (codes[np.maximum(earlier, 0)] == 10)
    strength[blank] = 5
    out[1:] = strength
    # a cut between CR and LF, or inside a run of white space, is weaker than the cut at its end
    inner = np.zeros(n + 1, bool)
    inner[1:n] = space[1:] & (before[1:] == 13) & newline[1:]
    out[inner] = 0
    out[0] = 0
    return out


class StrongestCut:
    """Range-maximum index over one page of a text's cuts; ties go to the right."""

    def __init__(self, strengths: np.ndarray, first: int, widest: int) -> None:
        self.first = first
        level = (strengths << 40) | np.arange(first, first + len(strengths))
        self.levels = [level]
        step = 1
        while 2 * step <= min(widest, len(level)):
            level = np.maximum(level[:-step], level[step:])
            self.levels.append(level)
            step *= 2

    def query(self, lo: int, hi: int) -> int:
        """The strongest cut from ``lo`` to ``hi``, both included."""
        k = (hi - lo + 1).bit_length() - 1
        row = self.levels[k]
        a, b = row[lo - self.first], row[hi - self.first - (1 << k) + 1]
        return int(max(a, b)) & ((1 << 40) - 1)


def piece_spans(text: str, limit: int, overlap: int) -> list[tuple[int, int]]:
    """Start and end of each piece of ``text``.

    A text of at most ``limit`` characters is one piece, the empty text none.  ``limit`` below 1 counts as 1.
    A negative overlap counts as 0; one that leaves no room to advance (``overlap >= limit``) as half the limit.
    """
    limit = max(1, limit)
    overlap = max(0, overlap)
    if overlap >= limit:
        overlap = limit // 2
    n = len(text)
    if n == 0:
        return []
    if n <= limit:
        return [(0, n)]
    strengths = cut_strengths(np.frombuffer(text.encode("utf-32-le"), np.uint32))
    page = max(_PAGE, 4 * limit)
    spans, start, index, upto = [], 0, None, -1
    while start + limit < n:
        lo, hi = start + max(overlap + 1, (limit + 1) // 2), start + limit
        if index is None or hi > upto:
            upto = min(n, start + page)
            index = StrongestCut(strengths[start : upto + 1], start, limit + 1)
        cut = index.query(lo, hi)
        spans.append((start, cut))
        start = cut - overlap
    spans.append((start, n))
    return spans


def split_oversized(df: DataFrame, text: str, limit: str, overlap: str, keep: list[str]) -> DataFrame:
    """One row per piece of each text: the ``keep`` columns, piece_no (from 1), start_at, end_at, piece.

    Null and empty texts give no rows.  A null or non-positive limit is 800, a null overlap 200.
    Repeated rows are cut each on their own; columns not in ``keep`` are dropped.
    """
    named = [F.col(f"`{k}`").alias(f"_k{i}") for i, k in enumerate(keep)]
    source = df.select(
        *named,
        F.col(f"`{text}`").alias("_text"),
        F.when(F.col(f"`{limit}`") > 0, F.col(f"`{limit}`")).otherwise(DEFAULT_LIMIT).cast("long").alias("_limit"),
        F.coalesce(F.col(f"`{overlap}`"), F.lit(DEFAULT_OVERLAP)).cast("long").alias("_overlap"),
    ).where(F.length("_text") > 0)
    keys = [f for f in source.schema.fields if f.name.startswith("_k")]
    schema = T.StructType([*keys, T.StructField("piece_no", T.IntegerType()), T.StructField("start_at", T.IntegerType()), T.StructField("end_at", T.IntegerType()), T.StructField("piece", T.StringType())])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows, no, begins, ends, texts = [], [], [], [], []
            for r, (t, size, lap) in enumerate(zip(pdf["_text"], pdf["_limit"], pdf["_overlap"])):
                for k, (a, b) in enumerate(piece_spans(t, int(size), int(lap)), 1):
                    rows.append(r), no.append(k), begins.append(a), ends.append(b), texts.append(t[a:b])
            if not rows:
                continue
            out = pdf[[f.name for f in keys]].iloc[rows].reset_index(drop=True)
            yield out.assign(piece_no=np.array(no, "int32"), start_at=np.array(begins, "int32"), end_at=np.array(ends, "int32"), piece=texts)

    cut = source.mapInPandas(run, schema)
    return cut.select(*[F.col(f"_k{i}").alias(k) for i, k in enumerate(keep)], "piece_no", "start_at", "end_at", "piece")
