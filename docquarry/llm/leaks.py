"""Held-out passages inside a training corpus (multi-pattern word search).

Wu-Manber over words: every run of ``run_words`` consecutive words of an item
is a pattern, and all patterns have that length. A *block* is three words. The
shift table holds for each block how far the search window may move when the
window ends with it; a block in no pattern moves the window by
``run_words - 2`` words, so most words of a text are never looked up. A block
with shift 0 leads to its bucket of (item, position) entries, and each entry
is confirmed by direct comparison of the whole window.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.words import words

BLOCK = 3


def build_tables(items: list[tuple[int, str | None]], run_words: int) -> tuple[dict, dict, list]:
    """Shift table, suffix buckets and the words of each item.

    Items with fewer than ``run_words`` words hold no pattern and are skipped.
    """
    shift: dict[tuple, int] = {}
    bucket: dict[tuple, list[tuple[int, int]]] = defaultdict(list)  # places in texts
    texts: list[tuple[int, list[str]]] = []
    for item_id, text in items:
        w = words(text or "")
        if len(w) < run_words:
            continue
        texts.append((item_id, w))
        for end in range(BLOCK - 1, len(w)):
            block = tuple(w[end - BLOCK + 1 : end + 1])
            move = max(0, run_words - 1 - end)
            if move < shift.get(block, run_words):
                shift[block] = move
            if end >= run_words - 1:
                bucket[block].append((len(texts) - 1, end))
    return shift, dict(bucket), texts


def search(w: list[str], tables: tuple[dict, dict, list], run_words: int) -> set[int]:
    """Ids of the items of which ``w`` holds a run of ``run_words`` words."""
    shift, bucket, texts = tables
    found: set[int] = set()
    far = run_words - BLOCK + 1
    get = shift.get
    i, n = run_words - 1, len(w)
    while i < n:
        move = get((w[i - 2], w[i - 1], w[i]), far)
        if move:
            i += move
            continue
        window = None
        for at, end in bucket[(w[i - 2], w[i - 1], w[i])]:
            item_id, item = texts[at]
            if item_id in found:
                continue
            if window is None:
                window = w[i - run_words + 1 : i + 1]
            if item[end - run_words + 1 : end + 1] == window:
                found.add(item_id)
        i += 1
    return found


def find_leaks(
    documents: DataFrame,
    items: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_id_col: str = "item_id",
    item_text_col: str = "text",
    run_words: int = 12,
    block_chars: int = 2_000_000,
    part_words: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id) of each document with ``run_words`` words of an item.

    The items are searched in blocks of about ``block_chars`` characters, one
    pass over the documents per block; the tables of a block take about 50
    bytes a character (100 MB), so what is broadcast has a bound at any number
    of items. Items of more than ``part_words`` words are cut into parts that
    overlap by ``run_words - 1`` words, so no run is lost. Counting the items
    is the one job that runs while the plan is built. Documents never shuffle.

    Null, empty and short texts (documents or items) match nothing; repeated
    documents and items each give their own rows, and one row per pair of ids
    comes out. Other columns, whatever their names, are not read.
    """
    if run_words < BLOCK:
        raise ValueError(f"run_words must be at least {BLOCK}")
    spark = documents.sparkSession
    docs = documents.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).alias("text"))
    held = items.select(F.col(item_id_col).cast("bigint").alias("item_id"), F.col(item_text_col).alias("text"))
    held = held.where("text is not null and item_id is not null")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                w = words(text)
                parts = [" ".join(w[at : at + part_words + run_words - 1]) for at in range(0, max(1, len(w) - run_words + 1), part_words)]
                for no, part in enumerate(parts):
                    yield pa.RecordBatch.from_arrays([pa.array([item_id], pa.int64()), pa.array([no], pa.int32()), pa.array([part], pa.string())], ["item_id", "part", "text"])

    held = held.mapInArrow(cut, "item_id bigint, part int, text string")
    size = held.agg(F.coalesce(F.sum(F.length("text")), F.lit(0)).alias("chars"), F.max("part").alias("last")).first()
    blocks = 1 + size.chars // block_chars
    result = None
    for b in range(blocks):
        part = held if blocks == 1 else held.where(F.pmod(F.xxhash64("item_id", "part"), F.lit(blocks)) == b)
        rows = [(r.item_id, r.text) for r in part.toLocalIterator()]
        tables = spark.sparkContext.broadcast(build_tables(rows, run_words))

        def scan(batches: Iterator[pa.RecordBatch], tables=tables) -> Iterator[pa.RecordBatch]:
            t = tables.value
            for batch in batches:
                ids, hits = [], []
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if text:
                        for item_id in search(words(text), t, run_words):
                            ids.append(doc_id)
                            hits.append(item_id)
                yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(hits, pa.int64())], ["doc_id", "item_id"])

        found = docs.mapInArrow(scan, "doc_id bigint, item_id bigint")
        result = found if result is None else result.unionByName(found)
    return result.distinct() if size.last else result
