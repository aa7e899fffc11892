"""Cutting oversized passages at natural boundaries.

Agglomerative merging: a text falls into atomic segments at its boundaries,
adjacent segments stand in a heap by the strength of the boundary between
them, and the weakest boundaries are merged first while the combined size and
the overlap fit the limit.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BOUNDARY = re.compile(r"\n|(?<=[.!?;:])\s")
BLANK = re.compile(r"\s+")


def atoms(text: str, limit: int, part: int) -> list[tuple[int, int, int]]:
    """(start, end, strength of the boundary at its end) of each segment.

    A stretch of at most ``limit`` characters is one segment; only a longer one
    is cut, into parts of at most ``part``. Strengths: 4 paragraph, 3 line, 2
    sentence, 1 clause, 0 forced.
    """
    out, at = [], 0
    ends = [(m.start(), m.end()) for m in BOUNDARY.finditer(text)] + [(len(text), len(text))]
    for stop, end in ends:
        if end == at:
            continue
        if stop - at > limit:
            while end - at > part:
                # keep a blank inside the forced part where there is one
                cut = max(text.rfind(" ", at + part // 2, at + part), text.rfind("\t", at + part // 2, at + part)) + 1 or at + part
                out.append((at, cut, 0))
                at = cut
        if end > at:
            if stop < end and text[stop] == "\n":
                strength = 4 if text[max(0, stop - 1) : stop] == "\n" or text[end : end + 1] == "\n" else 3
            else:
                strength = 2 if text[max(0, stop - 1) : stop] in (".", "!", "?") else 1
            if end - at > limit:
                # the stretch fits, but not with its boundary, which opens the next segment
                out.append((at, stop, strength))
                at = stop
            out.append((at, end, strength))
            at = end
    return out


def lead_in(text: str, lo: int, start: int) -> int:
    """Where between ``lo`` and ``start`` an overlap opens: after the first boundary there, else at the first word, else at ``lo``."""
    if lo >= start or lo == 0:
        return lo
    found = BOUNDARY.search(text, lo - 1, start) or BLANK.search(text, lo - 1, start)
    return found.end() if found and found.end() < start else lo


def split_text(text: str, limit: int, overlap: int) -> tuple[list[tuple[int, int, int]], bool]:
    """(overlap start, start, end) of each piece, and whether a stretch was forced."""
    segs = atoms(text, limit, limit - overlap)
    forced = any(b - a > limit for a, b in stretches(text))
    n = len(segs)
    start = [s for s, _, _ in segs]
    end = [e for _, e, _ in segs]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))
    alive = [True] * n
    strength = [s for _, _, s in segs]
    heap = [(strength[i], end[i + 1] - start[i], i, end[i + 1]) for i in range(n - 1)]
    heapq.heapify(heap)
    while heap:
        _, _, i, e = heapq.heappop(heap)
        j = after[i] if alive[i] else n
        if j >= n or end[j] != e:
            continue
        room = limit - (overlap if start[i] > 0 else 0)
        if e - start[i] > room:
            continue
        alive[j] = False
        end[i], strength[i] = e, strength[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
            heapq.heappush(heap, (strength[i], end[after[i]] - start[i], i, end[after[i]]))
        h = before[i]
        if h >= 0:
            heapq.heappush(heap, (strength[h], e - start[h], h, e))
    pieces, i = [], 0
    while i < n:
        # the overlap comes from the piece before and shrinks where this one leaves it less room
        room = min(overlap, limit - (end[i] - start[i]), start[i] - pieces[-1][0]) if pieces else 0
        pieces.append((lead_in(text, start[i] - room, start[i]), start[i], end[i]))
        i = after[i]
    return pieces, forced


def stretches(text: str) -> Iterator[tuple[int, int]]:
    at = 0
    for m in BOUNDARY.finditer(text):
        yield at, m.start()
        at = m.end()
    yield at, len(text)


SCHEMA = "chunk_id bigint, piece_no int, start int, overlap int, text string, section string, page_start int, page_end int, cut string"


def split_passages(chunks: DataFrame, *, limit: int = 1200, overlap: int = 200, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """The pieces of each passage longer than ``limit`` characters, in ``SCHEMA``.

    Every piece has at most ``limit`` characters, and later ones open with up to
    ``overlap`` characters that closed the one before, from a boundary or word
    on where there is one; a stretch of more than ``limit - overlap`` and up to
    ``limit`` characters stays whole and leaves its overlap less room. The parts
    without overlap join to the whole text. ``cut`` is ``forced`` if a stretch without boundary is longer
    than ``limit``, else ``natural``. Null, empty and shorter texts give no
    rows; repeated rows are cut each; other columns are not read.
    """
    if not 0 <= overlap < limit:
        raise ValueError("overlap must be at least 0 and less than limit")
    long = chunks.where(F.length(text_col) > limit).select(
        F.col(id_col).cast("bigint").alias("chunk_id"), F.col(text_col).alias("text"), "section", "page_start", "page_end"
    )
    fields = ["chunk_id", "piece_no", "start", "overlap", "text", "section", "page_start", "page_end", "cut"]
    kinds = [pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string()]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            for cid, text, section, p0, p1 in zip(*(c.to_pylist() for c in batch.columns)):
                pieces, forced = split_text(text, limit, overlap)
                for k, (o, s, e) in enumerate(pieces):
                    rows.append((cid, k, s, s - o, text[o:e], section, p0, p1, "forced" if forced else "natural"))
            cols = list(zip(*rows)) if rows else [()] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], fields)

    return long.mapInArrow(cut, SCHEMA)
