"""Lines that recur across the documents of one source.

A passage's normalised text is cut by content, as one run of characters in
which a line feed is a character like any other: a rolling hash over a window
sets the cuts, so a piece is the same wherever it stands. Documents are counted
per piece and source, which leaves the pieces repeated excessively. A line is a
candidate if a piece inside it is such, or if no piece lies inside it, and
candidates are confirmed by an exact count of documents per line and source.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.materialize import materialize
from docquarry.llm.nearpairs import marked

BLANKS = re.compile(r"[^\S\n]+")
ODD_BLANKS = re.compile(r"[^\S\n ]|  ")
EDGES = re.compile(r" ?\n ?")
DIGITS = re.compile(r"\d+")
#: Characters of the rolling window, a cut in so many places on average, and the least length of a piece that is counted.
WINDOW, EVERY, LEAST = 8, 32, 8
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def normal_text(text: str) -> str:
    """Every line trimmed, each run of white space one blank, lower case, each run of digits alike; line feeds stay."""
    if ODD_BLANKS.search(text):
        text = BLANKS.sub(" ", text)
    return DIGITS.sub("0", EDGES.sub("\n", text).strip(" ")).lower()


def cut_places(codes: np.ndarray) -> np.ndarray:
    """Places before which a run of code points is cut: where the hash of the ``WINDOW`` before has its low bits clear."""
    if len(codes) < WINDOW:
        return np.zeros(0, np.int64)
    h = np.zeros(len(codes) - WINDOW + 1, np.uint64)
    for k in range(WINDOW):
        h = h * BASE + codes[k : len(h) + k]
    h ^= h >> np.uint64(29)
    return np.flatnonzero(h * INVERSE >> np.uint64(40) & np.uint64(EVERY - 1) == 0) + WINDOW


def cut_texts(texts: list[str]) -> dict[str, np.ndarray]:
    """Pieces of normalised texts: ``text`` (its place in the list), ``hash``, and ``line``, the place among all lines of that which holds the piece and its window, or -1.

    Lines have ``line_text`` and ``line_no`` from 1.
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    n = len(codes)
    feeds = np.flatnonzero(codes == 10)
    line_start = np.sort(np.concatenate([starts[sizes > 0], feeds + 1]))
    # a feed that ends a text opens an empty line of that text, not of the next
    cuts = cut_places(codes)
    owner = np.searchsorted(starts, cuts, side="right") - 1 if len(cuts) else cuts
    cuts = cuts[cuts - WINDOW >= starts[owner]] if len(cuts) else cuts
    bounds = np.unique(np.concatenate([cuts, starts, [n]]))
    a, b = bounds[:-1], bounds[1:]
    keep = b - a >= LEAST
    a, b = a[keep], b[keep]
    power = np.full(n + 1, BASE)
    power[0] = 1
    power = np.multiply.accumulate(power)
    back = np.full(n + 1, INVERSE)
    back[0] = 1
    back = np.multiply.accumulate(back)
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum((codes + np.uint64(1)) * power[:n], dtype=np.uint64)])
    h = (total[b] - total[a]) * back[a]
    h ^= h >> np.uint64(31)
    h = h * BASE + (b - a).astype(np.uint64)
    h ^= h >> np.uint64(29)
    text = np.searchsorted(starts, a, side="right") - 1
    # the piece, with the window that set its first cut, inside one line
    at = np.searchsorted(line_start, a, side="right") - 1
    line_end = np.append(line_start[1:], n + 1) - 1
    at_start = np.isin(a, starts)
    at_end = np.isin(b, np.append(starts, n))
    inside = ~at_start & ~at_end & (a - WINDOW >= line_start[at]) & (b <= line_end[at]) if len(a) else np.zeros(0, bool)
    return {"text": text, "hash": h.view(np.int64), "line": np.where(inside, at, -1) if len(a) else at, "line_start": line_start}


def document_pieces(chunks: DataFrame, text_col: str) -> DataFrame:
    """(document_id, piece): the distinct pieces of every passage."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                found = cut_texts([normal_text(t) for t in part.column(1).to_pylist()])
                docs = part.column(0).to_numpy()[found["text"]]
                order = np.lexsort((found["hash"], docs))
                d, h = docs[order], found["hash"][order]
                first = np.r_[True, (d[1:] != d[:-1]) | (h[1:] != h[:-1])][: len(d)]
                yield pa.RecordBatch.from_arrays([pa.array(d[first]), pa.array(h[first])], ["document_id", "piece"])

    rows = chunks.select(F.col("document_id").cast("bigint"), F.col(text_col).alias("text")).where("text is not null and document_id is not null")
    return rows.mapInArrow(cut, "document_id bigint, piece bigint")


def lines_of(chunks: DataFrame, text_col: str) -> DataFrame:
    """(chunk_id, document_id, line_no, line, id): the hash of each line that is not empty, and as ``id`` one piece inside it, or null."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lo in range(0, batch.num_rows, 500):
                part = batch.slice(lo, 500)
                texts = [normal_text(t) for t in part.column(2).to_pylist()]
                found = cut_texts(texts)
                # of the pieces inside a line the one with the least hash
                inside = found["line"] >= 0
                order = np.lexsort((found["hash"][inside], found["line"][inside]))
                at, h = found["line"][inside][order], found["hash"][inside][order]
                first = np.r_[True, at[1:] != at[:-1]][: len(at)]
                piece_of = dict(zip(at[first].tolist(), h[first].tolist()))
                cols: list[list] = [[], [], [], [], []]
                k = 0
                for cid, doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), texts):
                    if not text:
                        continue
                    for no, line in enumerate(text.split("\n"), 1):
                        if line:
                            row = (cid, doc, no, xxhash.xxh3_64_intdigest(line.encode("utf-8", "surrogatepass")) - 2**63, piece_of.get(k))
                            for c, v in zip(cols, row):
                                c.append(v)
                        k += 1
                kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds)], ["chunk_id", "document_id", "line_no", "line", "id"])

    rows = chunks.select(F.col("chunk_id").cast("bigint"), F.col("document_id").cast("bigint"), F.col(text_col).alias("text")).where("text is not null and document_id is not null")
    return rows.mapInArrow(cut, "chunk_id bigint, document_id bigint, line_no int, line bigint, id bigint")


def sources_of(chunks: DataFrame, documents: DataFrame, least_docs: int, least_share: float) -> tuple[DataFrame, DataFrame]:
    """(document_id, src) of documents with a source, and (src, need): in how many of a source's documents with chunks something is excessive."""
    docs = documents.select(F.col("doc_id").cast("bigint").alias("document_id"), F.xxhash64("source").alias("src"), "source").where("source is not null")
    docs = docs.select("document_id", "src").dropDuplicates(["document_id"])
    owned = chunks.select(F.col("document_id").cast("bigint").alias("document_id")).distinct().join(docs, "document_id")
    need = owned.groupBy("src").agg(F.greatest(F.lit(least_docs), F.ceil(F.count("*") * F.lit(least_share) - F.lit(1e-9))).alias("need"))
    return docs, need


def excessive(rows: DataFrame, key: str, need: DataFrame, least_docs: int) -> DataFrame:
    """(src, key) in enough of a source's documents, from (src, key, document_id); counts combine before they shuffle."""
    per_doc = rows.select("src", key, "document_id").distinct()
    return per_doc.groupBy("src", key).agg(F.count("*").alias("n")).where(F.col("n") >= least_docs).join(need, "src").where("n >= need").select("src", key)


def excessive_pieces(chunks: DataFrame, documents: DataFrame, *, text_col: str = "text", least_docs: int = 5, least_share: float = 0.10) -> DataFrame:
    """(src, piece): content-defined pieces repeated excessively within a source; ``src`` is the hash of its name."""
    docs, need = sources_of(chunks, documents, least_docs, least_share)
    pieces = document_pieces(chunks, text_col).join(docs, "document_id")
    return excessive(pieces, "piece", need, least_docs)


def repeated_lines(chunks: DataFrame, documents: DataFrame, *, text_col: str = "text", least_docs: int = 5, least_share: float = 0.10) -> DataFrame:
    """(chunk_id, line_no) of every line to be removed.

    A line is excessive in a source if it occurs in at least ``least_docs`` of
    its documents and at least ``least_share`` of those that have chunks.
    Chunks of no document, and documents with a null source, have no source
    and keep all lines; null and empty texts have none. Passages stored twice
    count once per document and lose their lines each. Documents are counted
    by two-stage aggregation, so a hot source or line never sits in one task.
    A line in enough documents has all its pieces in them too, so no such line
    is missed; the passages are read twice, for pieces and for lines, and of the
    lines only candidates shuffle.
    """
    docs, need = sources_of(chunks, documents, least_docs, least_share)
    need = materialize(need, "need")  # one row a source
    pieces = materialize(excessive(document_pieces(chunks, text_col).join(docs, "document_id"), "piece", need, least_docs).withColumnRenamed("piece", "id"), "pieces")
    lines, _ = marked(lines_of(chunks, text_col), pieces.select("id").distinct())
    likely = materialize(lines.where("maybe or id is null").drop("maybe").join(docs, "document_id"), "likely")
    held = likely.where("id is not null").join(pieces, ["src", "id"], "left_semi").unionByName(likely.where("id is null").select("src", "id", *[c for c in likely.columns if c not in ("src", "id")]))
    confirmed = materialize(excessive(held, "line", need, least_docs), "excessive")
    return held.join(confirmed, ["src", "line"], "left_semi").select("chunk_id", "line_no")


def remove_lines(chunks: DataFrame, found: DataFrame, *, text_col: str = "text") -> DataFrame:
    """``chunks`` with the found lines cut out of ``text_col``; passages without any stay as they are."""
    cut = found.groupBy("chunk_id").agg(F.collect_set("line_no").alias("cut_lines"))  # at most the lines of one passage
    kept = F.filter(F.transform(F.split(text_col, "\n", -1), lambda x, i: F.struct(x.alias("x"), (i + 1).alias("no"))), lambda s: ~F.array_contains("cut_lines", s["no"]))
    clean = F.array_join(F.transform(kept, lambda s: s["x"]), "\n")
    return chunks.join(cut, "chunk_id", "left").withColumn(text_col, F.when(F.col("cut_lines").isNull(), F.col(text_col)).otherwise(clean)).drop("cut_lines")
