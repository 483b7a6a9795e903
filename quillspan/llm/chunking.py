"""Splitting oversized texts at natural boundaries by content-defined chunking.

A rolling hash over a small window of bytes gives every position a strength that depends on nothing but the bytes before it. Between the least
and the greatest size of a piece the strongest position is its landmark, and the piece ends at the natural boundary nearest to it. Two cuttings of nearly the
same text mostly see the same landmark from different starts, so after an edit the cuts fall into step again and only neighbouring pieces change.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Window of the rolling hash in bytes; the least size of a piece's new content as a part of the greatest; the part of the sizes between, to either side of
#: a landmark, in which a better kind of boundary is taken before a nearer one.
WINDOW, LEAST, AROUND = 32, 0.5, 8
#: Bytes of text after which the pieces found are handed on.
BATCH_BYTES = 16 << 20
_TABLE = np.random.default_rng(20_011).integers(0, 2**63, 256, dtype=np.uint64)
_FACTOR = 0x9E3779B97F4A7C15


#: Ends of natural units, best first: paragraphs, lines, sentences (also of scripts without blanks), clauses, words.
_UNITS = [
    regex.compile(rb"(?:\r?\n[ \t]*){2,}"), regex.compile(rb"\r?\n|\r"),
    regex.compile(rb"[.!?](?:[\"')\]]|\xe2\x80[\x99\x9d])*[ \t\n\r]+|(?:\xe3\x80\x82|\xef\xbc\x81|\xef\xbc\x9f)(?:\xe3\x80\x8d|\xe3\x80\x8f)?"),
    regex.compile(rb"[,;:][ \t\n\r]+|(?:\xe3\x80\x81|\xef\xbc\x8c|\xef\xbc\x9b)"), regex.compile(rb"[ \t\n\r]+|\xe3\x80\x80"),
]


@functools.lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up = lambda f: np.cumprod(np.r_[np.uint64(1), np.full(n - 1, f, np.uint64)], dtype=np.uint64)
    return up(_FACTOR), up(pow(_FACTOR, -1, 2**64))


def strengths(data: np.ndarray) -> np.ndarray:
    """Strength of the offsets from WINDOW to the end, each from the WINDOW bytes before it: a rolling polynomial hash (by differences of one running sum), mixed."""
    if len(data) < WINDOW:
        return np.empty(0, np.uint64)
    up, down = _powers(1 << max(6, (len(data) - 1).bit_length()))
    total = np.r_[np.uint64(0), np.cumsum(_TABLE[data] * up[: len(data)], dtype=np.uint64)]
    h = (total[WINDOW:] - total[:-WINDOW]) * down[: len(data) - WINDOW + 1]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def landmark(data: bytes, lo: int, hi: int) -> int:
    """The strongest offset from ``lo`` to ``hi`` (``hi`` if the text before is shorter than the window)."""
    s = strengths(np.frombuffer(data, np.uint8, count=hi - max(0, lo - WINDOW), offset=max(0, lo - WINDOW)))
    return max(lo, WINDOW) + int(s.argmax()) if len(s) else hi


def boundaries(data: bytes) -> list[np.ndarray]:
    """Offsets after the units of each kind, best kind first."""
    return [np.fromiter((m.end() for m in u.finditer(data)), np.int64) for u in _UNITS]


def _char_start(data: bytes, at: int, back: bool) -> int:
    while 0 < at < len(data) and data[at] & 0xC0 == 0x80:
        at += -1 if back else 1
    return at


def cut_points(data: bytes, limit: int, overlap: int) -> list[tuple[int, int, int]]:
    """(start, new content's start, end) of the pieces: start <= new content's start, equal for the first piece."""
    if len(data) <= limit:
        return [(0, 0, len(data))]
    most = limit - overlap - 3  # an overlap starts at a character, up to three bytes early
    least = max(1, int(most * LEAST))
    around = (most - least) // AROUND
    units = boundaries(data)

    def within(first: int, last: int) -> Iterator[np.ndarray]:
        for u in units:
            i, j = np.searchsorted(u, [first, last + 1])
            if i < j:
                yield u[i:j]

    out, a = [], 0
    while True:
        start = _char_start(data, max(0, a - overlap), True) if a else 0
        if len(data) - a <= most:
            out.append((start, a, len(data)))
            return out
        lo, hi = a + least, a + most
        mark = landmark(data, lo, hi)
        # the best kind of boundary close to the landmark, else the best kind within the sizes, else the last one before them
        near = next(within(max(lo, mark - around), min(hi, mark + around)), None)
        near = next(within(lo, hi), None) if near is None else near
        if near is not None:
            end = int(near[np.argmin(np.abs(near - mark))])
        else:
            end = max((int(u[-1]) for u in within(a + 1, lo - 1)), default=0)
        if not end:  # no boundary at all: at the landmark, between characters
            end = _char_start(data, mark, True)
            end = end if end > a else hi
        out.append((start, a, end))
        a = end


def split_oversized(df: DataFrame, doc: str, text: str, limit: int, overlap: int) -> DataFrame:
    """doc, piece (from 1), start_token, end_token, overlap_tokens, n_tokens, text: the pieces of each text larger than ``limit``.

    Sizes are bytes of UTF-8. No piece exceeds ``limit``; each but the first repeats the last ``overlap`` tokens of the one before (up to three more
    where that would cut a character, fewer only if the one before holds fewer), and the pieces without their overlaps are the whole text. Pieces
    end after a paragraph, line, sentence, clause or word: the best of these close to the landmark, else the best anywhere between LEAST and all of the
    greatest size. Only where nothing ends there a piece is shorter and ends at the last boundary before; a stretch without any is cut at its
    landmark, between characters. Texts within the limit, null or empty give no rows; repeated ids are each split; other columns are ignored.
    """
    if not 0 <= overlap < limit - 8:
        raise ValueError("the overlap must leave room for new text")
    src = df.select(F.col(doc).alias("d"), F.col(text).cast("string").alias("t")).where(F.octet_length("t") > limit)
    id_type = src.schema["d"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            take, rows, texts, held = [], [], [], 0
            for k, t in enumerate(b.column(1)):
                data = t.as_py().encode()
                for p, (s, a, e) in enumerate(cut_points(data, limit, overlap)):
                    take.append(k), rows.append((p + 1, s, e, a - s, e - s)), texts.append(data[s:e].decode("utf-8", "replace"))
                held += len(data)
                if held > BATCH_BYTES:
                    yield _batch(b, take, rows, texts)
                    take, rows, texts, held = [], [], [], 0
            yield _batch(b, take, rows, texts)

    def _batch(b, take, rows, texts):
        cols = np.array(rows, dtype=np.int64).reshape(-1, 5)
        return pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(take, pa.int64())), pa.array(cols[:, 0].astype(np.int32)), *[pa.array(cols[:, k]) for k in range(1, 5)], pa.array(texts, pa.string())],
            [doc, "piece", "start_token", "end_token", "overlap_tokens", "n_tokens", "text"],
        )

    return src.mapInArrow(run, f"`{doc}` {id_type}, piece int, start_token bigint, end_token bigint, overlap_tokens bigint, n_tokens bigint, text string")
