"""Groups of passages that differ by small edits.

A signature holds one minimum hash of the passage's word runs per coordinate.
Passages are posted under each (coordinate, value) pair; two passages whose
run sets have the wanted similarity agree in at least ``least`` coordinates
but for a chance of about 1 in 2000. Prefix merging: if postings stand in one
order, roughly by how common they are, two passages that agree in ``least`` of
``coordinates`` postings must agree within the first ``coordinates - least +
1`` of each, so only those are posted. Skip merging: a list of one member is
passed over, and in a list a member is compared only with those after it.
Postings of a long list are salted into tiles, so that every two of its
members still meet in one. A posting carries five bits of every coordinate,
which two different values share once in 32 cases and equal ones always, so
agreements are counted where postings meet, and the count misses none. Pairs
above the match threshold are confirmed on the exact sets of word runs.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docquarry.llm.materialize import discard, materialize
from docquarry.llm.words import words


def runs(text: str, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``size`` consecutive words."""
    w = words(text)
    if len(w) < size:
        return np.zeros(0, np.uint64)
    h = xxhash.xxh3_64_intdigest
    return np.array(sorted({h(" ".join(w[i : i + size])) for i in range(len(w) - size + 1)}), np.uint64)


def multipliers(n: int) -> np.ndarray:
    """Odd constants of ``n`` hash functions, from a fixed seed."""
    return np.random.default_rng(20240229).integers(0, 2**63, n, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def signature(run_hashes: np.ndarray, mult: np.ndarray) -> np.ndarray:
    """Minimum per coordinate, as 32-bit integers."""
    out = np.empty(len(mult), np.uint32)
    for lo in range(0, len(run_hashes), 20_000):
        x = run_hashes[lo : lo + 20_000, None] * mult[None, :]
        x ^= x >> np.uint64(29)
        part = ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)).astype(np.uint32).min(axis=0)
        out = part if lo == 0 else np.minimum(out, part)
    return out


WIDTH, FIELDS = 5, 12  # bits of a code, and codes in a 64-bit word
TOPS = np.uint64(sum(1 << (WIDTH * i + WIDTH - 1) for i in range(FIELDS)))
RESTS = np.uint64(sum(((1 << (WIDTH - 1)) - 1) << (WIDTH * i) for i in range(FIELDS)))


def packed(sigs: np.ndarray) -> np.ndarray:
    """The low bits of each coordinate, as rows of 64-bit words."""
    words_of_row = -(-sigs.shape[1] // FIELDS)
    codes = np.zeros((len(sigs), words_of_row * FIELDS), np.uint64)
    codes[:, : sigs.shape[1]] = sigs & np.uint32((1 << WIDTH) - 1)
    return np.bitwise_or.reduce(codes.reshape(len(sigs), words_of_row, FIELDS) << (np.arange(FIELDS, dtype=np.uint64) * np.uint64(WIDTH)), axis=2)


def met_pairs(post: np.ndarray, ids: np.ndarray, codes: np.ndarray, unequal_most: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs a < b under one posting with at most ``unequal_most`` unequal codes; ``post`` is sorted."""
    found = [np.zeros((0, 2), np.int64)]
    at, step = np.arange(len(post) - 1), 1
    while len(at):
        at = at[post[at] == post[at + step]]
        unequal = np.zeros(len(at), np.uint8)
        for w in codes.T:
            x = w[at] ^ w[at + step]
            unequal += np.bitwise_count((((x & RESTS) + RESTS) | x) & TOPS)
        hit = at[unequal <= unequal_most]
        found.append(np.stack([ids[hit], ids[hit + step]], axis=1))
        step += 1
        at = at[at + step < len(post)]
    pairs = np.unique(np.sort(np.concatenate(found), axis=1), axis=0)
    pairs = pairs[pairs[:, 0] < pairs[:, 1]]
    return pairs[:, 0], pairs[:, 1]


def marked(rows: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``rows`` with a column ``maybe``, true for every ``id`` in ``ids`` and few others, and the table this rests on.

    Hashed ids set bits of one bitmap of 16 to 32 bits an id, kept in blocks of
    4 KB; beyond 2 ** 26 ids it stays at 2 ** 30 bits, so at most 128 MB are
    broadcast. An exact join follows wherever this is used; it only spares it
    most rows.
    """
    n = ids.count()
    bits = 1 << min(30, max(15, (16 * n).bit_length()))
    place = F.pmod(F.xxhash64("id"), F.lit(bits)) + 1
    held = ids.select(place.alias("p")).groupBy(F.bitmap_bucket_number("p").alias("block"))
    blocks = materialize(held.agg(F.bitmap_construct_agg(F.bitmap_bit_position("p")).alias("bitmap")), "bitmap")
    at = F.bitmap_bit_position("p").cast("int")
    byte = F.ascii(F.decode(F.substring(F.col("bitmap"), F.shiftright(at, 3) + 1, F.lit(1)), "ISO-8859-1"))
    one_is_set = F.coalesce(F.getbit(byte, at.bitwiseAND(7)) == 1, F.lit(False))
    tried = rows.withColumn("p", place).withColumn("block", F.bitmap_bucket_number("p"))
    return tried.join(F.broadcast(blocks), "block", "left").select(*rows.columns, one_is_set.alias("maybe")), blocks


def near_pairs(
    passages: DataFrame,
    *,
    id_col: str = "chunk_id",
    text_col: str = "text",
    run_words: int = 3,
    similarity: float = 0.5,
    coordinates: int = 42,
    least: int = 11,
    counters_log2: int = 18,
    list_rows: int = 2000,
    expand: int = 64,
) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: passages with the given similarity of their sets of word runs.

    Passages with the same set of word runs form a class, and classes are
    compared by their smallest id. Members of a class come out in all their
    pairs and in all pairs with its neighbours. The one exception are more than
    ``expand`` exact copies of one text: each is paired with their smallest id,
    which alone stands for the text in pairs with other texts, so output grows
    with the rows. Null texts and texts under ``run_words`` words give no pair.
    Texts are read whole. Other columns are not read; an empty table gives no
    rows. ``counters_log2`` sets the size of the table of posting counts, and
    ``list_rows`` the length from which lists are salted; both change the work,
    never the pairs. Only this table and bitmaps of a fixed size are broadcast.
    """
    prefix = coordinates - least + 1
    # bytes of the codes, without those of the last word that hold none
    code_bytes = (coordinates // FIELDS) * 8 + -(-(coordinates % FIELDS) * WIDTH // 8)
    rows = passages.select(F.col(id_col).cast("bigint").alias("id"), F.col(text_col).alias("text")).where("text is not null and id is not null")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mult = multipliers(coordinates)
        for batch in batches:
            ids, keys, texts, sigs = [], [], [], []
            for i, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                r = runs(text, run_words)
                if len(r):
                    ids.append(i)
                    # the set of runs decides, so texts with one set are one class
                    keys.append(xxhash.xxh3_128_digest(r.tobytes()))
                    texts.append(xxhash.xxh3_128_digest(text.encode("utf-8", "surrogatepass")))
                    sigs.append(signature(r, mult).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), *(pa.array(c, pa.binary()) for c in (keys, texts, sigs))], ["id", "key", "text_key", "sig"])

    signed = materialize(rows.mapInArrow(sign, "id bigint, key binary, text_key binary, sig binary"), "signatures")
    # counts combine before they shuffle, so copies of one text never gather in a task
    by_runs = signed.groupBy("key").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").drop("n")
    alike = materialize(signed.select("id", "key", "text_key").join(by_runs, "key"), "classes")
    by_text = alike.groupBy("key", "text_key").agg(F.min("id").alias("first"), F.count("*").alias("copies"))
    multi = materialize(alike.join(by_text, ["key", "text_key"]).select("id", "rep", "first", "copies"), "copies")
    others = multi.where("id <> rep").select("id")
    sigs, rep_blocks = marked(signed.select("id", "sig"), others)
    reps = sigs.where("not maybe").drop("maybe").unionByName(sigs.where("maybe").drop("maybe").join(others, "id", "left_anti"))

    mask = np.uint64((1 << counters_log2) - 1)

    def slots_of(sigs: pa.Array) -> np.ndarray:
        v = np.frombuffer(b"".join(sigs.to_pylist()), np.uint32).reshape(-1, coordinates).astype(np.uint64)
        x = (v + (np.arange(coordinates, dtype=np.uint64) << np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))

    def tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(int(mask) + 1, np.int64)
        for batch in batches:
            np.add.at(total, (slots_of(batch.column(0)) & mask).ravel().astype(np.int64), 1)
        at = np.flatnonzero(total)
        for lo in range(0, len(at), 100_000):
            part = at[lo : lo + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(part, pa.int32()), pa.array(total[part], pa.int64())], ["slot", "n"])

    counts = reps.select("sig").mapInArrow(tally, "slot int, n bigint").groupBy("slot").agg(F.least(F.sum("n"), F.lit(2**31 - 1)).cast("int").alias("n")).where("n > 1")
    table = np.zeros(int(mask) + 1, np.int32)
    counted = counts.toArrow()  # at most 2 ** counters_log2 rows
    table[counted.column("slot").to_numpy()] = counted.column("n").to_numpy()
    usual = 2 * int(table.mean())  # postings that share a slot by chance
    shared = passages.sparkSession.sparkContext.broadcast(table)

    def post(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        common = shared.value
        for batch in batches:
            for lo in range(0, batch.num_rows, 1000):
                part = batch.slice(lo, 1000)
                s = slots_of(part.column(1))
                n = common[(s & mask).astype(np.int64)]
                order = np.lexsort((s, n), axis=1)[:, :prefix]
                s, n = np.take_along_axis(s, order, 1), np.take_along_axis(n, order, 1)
                row, col = np.nonzero(n > 1)  # a slot counted once is a list of one
                s, n, ids = s[row, col], n[row, col].astype(np.int64), part.column(0).to_numpy()[row]
                # a list of k * list_rows postings is k groups; a posting goes to the tiles of its group with each
                k = np.maximum(1, -(-(n - usual) // list_rows))
                own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % k
                each = np.repeat(np.arange(len(k)), k)
                other = np.arange(len(each)) - np.repeat(np.cumsum(k) - k, k)
                tile = np.minimum(own[each], other) * k[each] + np.maximum(own[each], other)
                key = s[each] ^ (tile.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9))
                # 32 bits do: lists that share a key are only compared in vain
                key = (key ^ (key >> np.uint64(29))).astype(np.uint32).view(np.int32)
                sig = np.frombuffer(b"".join(part.column(1).to_pylist()), np.uint32).reshape(-1, coordinates)
                codes = packed(sig).view(np.uint8).reshape(len(sig), -1)[:, :code_bytes]
                codes = pa.FixedSizeBinaryArray.from_buffers(pa.binary(code_bytes), len(each), [None, pa.py_buffer(np.ascontiguousarray(codes[row[each]]))]).cast(pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(ids[each]), codes], ["post", "id", "codes"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs_of(kept: list) -> pa.RecordBatch:
            posts, ids, codes = (np.concatenate(c) for c in zip(*kept))
            return pa.RecordBatch.from_arrays([pa.array(c) for c in met_pairs(posts, ids, codes.view(np.uint64), coordinates - least)], ["a", "b"])

        kept, held = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            codes = np.zeros((batch.num_rows, -(-code_bytes // 8) * 8), np.uint8)
            codes[:, :code_bytes] = np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, code_bytes)
            new = (batch.column(0).to_numpy(), batch.column(1).to_numpy(), codes)
            if held >= 100_000 and (cut := int(np.searchsorted(new[0], new[0][-1]))):
                # all lists but the last have ended
                yield pairs_of([*kept, tuple(c[:cut] for c in new)])
                kept, held, new = [], 0, tuple(c[cut:] for c in new)
            kept.append(new)
            held += len(new[0])
        if kept:
            yield pairs_of(kept)

    posted = reps.mapInArrow(post, "post int, id bigint, codes binary").repartition("post").sortWithinPartitions("post")
    matched = materialize(posted.mapInArrow(meet, "a bigint, b bigint").distinct(), "matched")

    def similar(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, np.ndarray] = {}

        def runs_of(text: str) -> np.ndarray:
            if text not in known:
                if len(known) >= 2000:
                    known.clear()
                known[text] = runs(text, run_words)
            return known[text]

        for batch in batches:
            keep = []
            for s, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                u, v = runs_of(s), runs_of(t)
                both = len(np.intersect1d(u, v, assume_unique=True))
                keep.append(both >= similarity * (len(u) + len(v) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])

    needed = materialize(matched.select(F.col("a").alias("id")).union(matched.select("b")).distinct(), "needed")
    likely, blocks = marked(rows, needed)
    # an inner join, as a semi join would be moved before the bitmap; ids are unique in needed
    texts = materialize(likely.where("maybe").drop("maybe").join(needed, "id"), "texts")
    text_a, text_b = texts.select(F.col("id").alias("a"), F.col("text").alias("ta")), texts.select(F.col("id").alias("b"), F.col("text").alias("tb"))
    linked = matched.join(text_a, "a").join(text_b, "b").select("a", "b", "ta", "tb").mapInArrow(similar, "a bigint, b bigint")
    linked = materialize(linked, "linked")
    discard(signed, alike, matched, needed, rep_blocks, blocks, texts)

    members = multi.where((F.col("copies") <= expand) | (F.col("id") == F.col("first")))
    member_a = members.select(F.col("rep").alias("a"), F.col("id").alias("ia"))
    member_b = members.select(F.col("rep").alias("b"), F.col("id").alias("ib"))
    across = linked.join(member_a, "a", "left").join(member_b, "b", "left").select(F.coalesce("ia", "a").alias("x"), F.coalesce("ib", "b").alias("y"))
    within = member_a.join(member_b, F.col("a") == F.col("b")).where("ia < ib").select(F.col("ia").alias("x"), F.col("ib").alias("y"))
    star = multi.where((F.col("copies") > expand) & (F.col("id") != F.col("first"))).select(F.col("first").alias("x"), F.col("id").alias("y"))
    every = across.unionByName(within).unionByName(star)
    return every.select(F.least("x", "y").alias("chunk_id_a"), F.greatest("x", "y").alias("chunk_id_b"))


def exact_copies(passages: DataFrame, *, id_col: str = "chunk_id", text_col: str = "text") -> DataFrame:
    """(chunk_id, copy_of) of every passage stored more than once: its id and the lowest id of its copies.

    The membership that ``near_pairs`` leaves out for more than ``expand``
    copies. Copies are counted before they join; null texts have none.
    """
    keyed = passages.where(F.col(text_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("chunk_id"), F.sha2(text_col, 256).alias("text_key"))
    firsts = keyed.groupBy("text_key").agg(F.min("chunk_id").alias("copy_of"), F.count("*").alias("n")).where("n > 1")
    return keyed.join(firsts, "text_key").select("chunk_id", "copy_of")
