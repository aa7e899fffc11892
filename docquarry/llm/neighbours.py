"""The most similar vectors of every vector.

NN-descent on codes: a vector is coded by the sides of random hyperplanes it
lies on, and two codes differ in more places the wider the angle. A graph holds
of every vector the nearest codes found so far. It starts from passes over the
codes in order of some of their bits, in which each is compared with those near
it in a block. Each round then compares the neighbours that a vector's list
holds with one another, as neighbours of a neighbour are likely neighbours,
adds one pass in another order, and keeps the best, until a round adds few
edges. Edges whose codes are close enough are scored by their exact cosine.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from docquarry.llm.materialize import discard, materialize
from docquarry.llm.nearpairs import marked

BITS = 192  # of a code


def usable(vectors: DataFrame, id_col: str, vector_col: str, dim_col: str) -> DataFrame:
    """(id, dim, v): unit vectors as bytes of float32, of the rows that can be compared."""

    def unit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, dims, out = [], [], []
            lists = batch.column(2)
            flat = lists.flatten().to_numpy(zero_copy_only=False)
            at = 0
            for i, d, size in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), lists.value_lengths().to_pylist()):
                v = flat[at : at + size].astype(np.float64)
                at += size
                top = np.abs(v).max() if size else 0
                if size == d and np.isfinite(v).all() and top > 0:
                    v = v / top
                    ids.append(i)
                    dims.append(d)
                    out.append((v / np.sqrt(v @ v)).astype(np.float32).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(dims, pa.int32()), pa.array(out, pa.binary())], ["id", "dim", "v"])

    rows = vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(dim_col).cast("int").alias("dim"), F.col(vector_col).cast("array<float>").alias("e"))
    return rows.where("id is not null and e is not null and dim is not null and size(e) = dim").mapInArrow(unit, "id bigint, dim int, v binary")


def coded(units: DataFrame, seed: int) -> DataFrame:
    """(id, dim, code): which side of ``BITS`` random hyperplanes each unit vector lies on."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        planes: dict[int, np.ndarray] = {}
        for batch in batches:
            dims = batch.column(1).to_numpy()
            raw = batch.column(2).to_pylist()
            out: list[bytes] = [b""] * len(raw)
            for d in np.unique(dims).tolist():
                if d not in planes:
                    planes[d] = np.random.default_rng([seed, d]).normal(size=(d, BITS)).astype(np.float32)
                at = np.flatnonzero(dims == d)
                m = np.frombuffer(b"".join(raw[i] for i in at), np.float32).reshape(-1, d)
                packed = np.packbits(m @ planes[d] > 0, axis=1)
                for i, row in zip(at.tolist(), packed):
                    out[i] = row.tobytes()
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(out, pa.binary())], ["id", "dim", "code"])

    return units.mapInArrow(code, "id bigint, dim int, code binary")


def words64(codes: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(codes.to_pylist()), np.uint64).reshape(-1, BITS // 64)


def closest(dist: np.ndarray, most: int) -> np.ndarray:
    """Per row of the last axis the places of its ``most`` smallest values."""
    most = min(most, dist.shape[-1])
    return np.argpartition(dist, most - 1, axis=-1)[..., :most]


def one_pass(codes: DataFrame, number: int, k: int, block: int) -> DataFrame:
    """Candidates (a, b, d) found by comparing codes near each other in one order, those that are nearer than ``a``'s ``worst``.

    The order is that of 63 bits of the code from another place in each pass.
    Blocks overlap by a quarter and never mix dims; a block of equal codes is
    as long as any other.
    """

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bits = np.unpackbits(np.frombuffer(b"".join(batch.column(2).to_pylist()), np.uint8).reshape(-1, BITS // 8), axis=1)
            first = np.roll(bits, -37 * number, axis=1)[:, :63]
            keys = np.packbits(np.concatenate([np.zeros((len(bits), 1), np.uint8), first], axis=1), axis=1).view(">i8")[:, 0].astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(keys)], ["id", "dim", "code", "worst", "key"])

    cols = "id bigint, dim int, code binary, worst int"
    ordered = codes.select("id", "dim", "code", "worst").mapInArrow(key, f"{cols}, key bigint").repartitionByRange("dim", "key", "id").sortWithinPartitions("dim", "key", "id")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros((0, BITS // 64), np.uint64), np.zeros(0, np.int32)]

        def edges(ids: np.ndarray, code: np.ndarray, worst: np.ndarray) -> pa.RecordBatch:
            dist = np.bitwise_count(code[:, None] ^ code[None]).sum(axis=2, dtype=np.int16)
            np.fill_diagonal(dist, BITS + 1)
            best = closest(dist, k)
            d = np.take_along_axis(dist, best, axis=1)
            row, col = np.nonzero(d < np.minimum(worst, BITS + 1)[:, None])
            return pa.RecordBatch.from_arrays([pa.array(ids[row]), pa.array(ids[best[row, col]]), pa.array(d[row, col].astype(np.int16))], ["a", "b", "d"])

        def cut(final: bool) -> Iterator[pa.RecordBatch]:
            nonlocal held
            while len(held[0]) and (final or len(held[0]) >= 2 * block):
                same = int(np.searchsorted(held[1], held[1][0], side="right"))  # rows of the first dim
                if same < block and not final and same == len(held[0]):
                    return
                n = min(block, same)
                if n > 1:
                    yield edges(held[0][:n], held[2][:n], held[3][:n])
                go_on = n if n == same else n - block // 4
                held = [x[go_on:] for x in held]

        for batch in batches:
            if batch.num_rows:
                new = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), words64(batch.column(2)), batch.column(3).to_numpy()]
                held = [np.concatenate(x) for x in zip(held, new)]
                yield from cut(False)
        yield from cut(True)

    return ordered.select("id", "dim", "code", "worst").mapInArrow(compare, "a bigint, b bigint, d smallint")


def local_join(graph: DataFrame, codes: DataFrame, number: int, k: int, share: float) -> DataFrame:
    """Candidates (a, b, d): members of one list compared with one another, of which one is new, those that are nearer than ``a``'s ``worst``.

    Only lists of a ``share`` of all vectors, others in each round, are joined.
    A list has at most ``k`` members, so no group grows with the data.
    """
    chosen = F.pmod(F.xxhash64("a", F.lit(number)), F.lit(1000)) < int(1000 * share)
    lists = graph.where(chosen).select(F.col("a").alias("v"), F.explode("nb").alias("n")).select("v", F.col("n.b").alias("id"), (F.col("n.r") >= number - 1).alias("new"))
    entries = lists.join(codes.select("id", "code", "worst"), "id").repartition("v").sortWithinPartitions("v").select("v", "id", "new", "code", "worst")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def pairs(v, ids, new, code, worst) -> Iterator[pa.RecordBatch]:
            starts = np.flatnonzero(np.r_[True, v[1:] != v[:-1]])
            group = np.cumsum(np.r_[False, v[1:] != v[:-1]])
            place = np.full((len(starts), k), -1)
            place[group, np.arange(len(v)) - starts[group]] = np.arange(len(v))
            for lo in range(0, len(place), 4000):
                at = place[lo : lo + 4000]
                dist = np.bitwise_count(code[at][:, :, None] ^ code[at][:, None]).sum(axis=3, dtype=np.int16)
                none = at < 0
                dist[none[:, :, None] | none[:, None, :] | ~(new[at][:, :, None] | new[at][:, None, :])] = BITS + 1
                dist[:, np.arange(k), np.arange(k)] = BITS + 1
                best = closest(dist, 2)
                d = np.take_along_axis(dist, best, axis=2)
                g, i, j = np.nonzero(d < np.minimum(worst[at], BITS + 1)[:, :, None])
                yield pa.RecordBatch.from_arrays([pa.array(ids[at[g, i]]), pa.array(ids[at[g, best[g, i, j]]]), pa.array(d[g, i, j])], ["a", "b", "d"])

        held: list[np.ndarray] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            cols = [batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False).astype(bool), words64(batch.column(3)), batch.column(4).to_numpy()]
            held = [np.concatenate(x) for x in zip(held, cols)] if held else cols
            end = int(np.searchsorted(held[0], held[0][-1]))  # the last list may go on
            if end:
                yield from pairs(*(x[:end] for x in held))
                held = [x[end:] for x in held]
        if held:
            yield from pairs(*held)

    return entries.mapInArrow(meet, "a bigint, b bigint, d smallint")


def nearest(edges: DataFrame, k: int) -> DataFrame:
    """(a, nb): of edges (a, b, d, r) the ``k`` nearest of each vector, ties to the lower id; an edge found again keeps its first round."""
    one = edges.repartition("a").groupBy("a", "b").agg(F.min("d").alias("d"), F.min("r").alias("r"))
    return one.groupBy("a").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "b", "r"))), 1, k).alias("nb"))


def scored(pairs: DataFrame, units: DataFrame) -> DataFrame:
    """Pairs (a, b) with their cosine."""

    def dot(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = batch.column(2).to_pylist(), batch.column(3).to_pylist()
            sim = np.array([np.frombuffer(u, np.float32) @ np.frombuffer(v, np.float32) if len(u) == len(v) else -2 for u, v in zip(x, y)], np.float32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sim)], ["a", "b", "sim"])

    ua, ub = units.select(F.col("id").alias("a"), F.col("v").alias("va")), units.select(F.col("id").alias("b"), F.col("v").alias("vb"))
    return pairs.join(ua, "a").join(ub, "b").select("a", "b", "va", "vb").mapInArrow(dot, "a bigint, b bigint, sim float")


def exact(pairs: DataFrame, vectors: DataFrame) -> DataFrame:
    """(a, b, sim): pairs of ids of (id, e, dim) with their cosine; only the vectors they need are moved."""
    wanted = materialize(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct(), "wanted")
    likely, blocks = marked(vectors, wanted)
    held = likely.where("maybe").drop("maybe").join(wanted, "id")
    units = materialize(usable(held, "id", "e", "dim"), "units")
    sims = materialize(scored(pairs, units).where("sim >= -1").groupBy("a", "b").agg(F.max("sim").alias("sim")), "sims")
    discard(wanted, blocks, units)
    return sims


def descend(
    vectors: DataFrame, *, id_col: str = "chunk_id", vector_col: str = "embedding", dim_col: str = "dim",
    k: int = 8, passes: int = 2, block: int = 256, share: float = 0.5, core: int = BITS, settled: float = 0.02, rounds: int | None = None, seed: int = 7,
) -> tuple[DataFrame, DataFrame]:
    """(id, dim, code) of all vectors that can be compared, and (a, nb) with the ``k`` nearest codes found of each; see ``neighbour_graph``."""
    codes = coded(usable(vectors, id_col, vector_col, dim_col), seed)
    codes = materialize(codes.groupBy("id").agg(F.min(F.struct("dim", "code")).alias("c")).select("id", "c.dim", "c.code"), "codes")
    fresh = F.lit(BITS + 1)
    start = codes.withColumn("worst", fresh)
    edges = one_pass(start, 0, k, block)
    for p in range(1, passes):
        edges = edges.unionByName(one_pass(start, p, k, block))
    graph = materialize(nearest(edges.withColumn("r", F.lit(0)), k), "graph")

    def close(r: int) -> tuple[int, int]:
        held = graph.select(F.explode("nb").alias("n")).where(F.col("n.d") <= core)
        n = held.agg(F.count("*").alias("all"), F.count_if(F.col("n.r") == r).alias("new")).first()
        return n["all"], n["new"]

    r = 0
    while rounds is None or r < rounds:
        r += 1
        worst = graph.select(F.col("a").alias("id"), F.when(F.size("nb") < k, fresh).otherwise(F.get("nb", F.lit(k - 1))["d"]).cast("int").alias("worst"))
        known = materialize(codes.join(worst, "id", "left").fillna(BITS + 1, ["worst"]), "known")
        found = local_join(graph, known, r, k, share).unionByName(one_pass(known, passes + r - 1, k, block))
        old = graph.select("a", F.explode("nb").alias("n")).select("a", "n.b", "n.d", "n.r")
        newer = materialize(nearest(old.unionByName(found.withColumn("r", F.lit(r))), k), "graph")
        discard(graph, known)
        graph = newer
        every, new = close(r)
        if rounds is None and new <= settled * every:
            break
    return codes, graph


def neighbour_graph(vectors: DataFrame, *, id_col: str = "chunk_id", vector_col: str = "embedding", dim_col: str = "dim", near: int = BITS, **settings) -> DataFrame:
    """Edges (a, b, sim) of an approximate ``k``-nearest-neighbour graph, both ways, with their exact cosine.

    Rounds go on until one adds less than the share ``settled`` of all edges
    whose codes differ in at most ``core`` places (a number of ``rounds`` may be
    given instead, for measuring); edges come out whose codes differ in at most
    ``near`` places. Codes of two vectors at an angle of x degrees differ in
    ``BITS`` * x / 180 places on average. Null, empty, zero and non-finite vectors and those of another
    length than their ``dim`` are no part of it, only vectors of equal ``dim``
    are compared, and equal vectors are neighbours with cosine 1. Rows of one id
    count as one, and of its vectors the one with the least code is compared.
    """
    codes, graph = descend(vectors, id_col=id_col, vector_col=vector_col, dim_col=dim_col, **settings)
    discard(codes)
    # a last join of near neighbours of near neighbours, scored exactly; at most k * k pairs a vector
    lists = graph.select("a", F.filter("nb", lambda n: n["d"] <= near)["b"].alias("nb")).where(F.size("nb") > 0)
    first, second = lists.select("a", F.explode("nb").alias("b")), lists.select("nb", F.explode("nb").alias("a"))
    through = second.select("a", F.explode("nb").alias("b"))
    pairs = first.unionByName(through).where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    pairs = materialize(pairs, "pairs")
    sims = exact(pairs, vectors.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("e"), F.col(dim_col).alias("dim")))
    discard(graph, pairs)
    return sims.unionByName(sims.select(F.col("b").alias("a"), F.col("a").alias("b"), "sim"))


def as_words(codes: DataFrame, name: str) -> DataFrame:
    """(name, dim, w): codes as arrays of 64-bit integers, which Spark compares by itself."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat = words64(batch.column(2)).view(np.int64).ravel()
            ends = np.arange(0, len(flat) + 1, BITS // 64, dtype=np.int32)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], [name, "dim", "w"])

    return codes.select("id", "dim", "code").mapInArrow(split, f"{name} bigint, dim int, w array<bigint>")


def graph_search(
    queries: DataFrame, vectors: DataFrame, *, id_col: str = "chunk_id", vector_col: str = "embedding", dim_col: str = "dim",
    k: int = 5, least: float = -1.0, beam: int = 48, width: int = 8, starts: int = 3, settled: float = 0.01, **settings,
) -> DataFrame:
    """(qid, pid, sim, rank): of each query vector the ``k`` most similar found by greedy search in the neighbour graph, never its own id.

    All queries search at once. Each holds the ``beam`` nearest codes met so
    far, at first those near it in ``starts`` orders of all codes; a step looks at
    the graph neighbours, either way, of the ``width`` nearest that it has not
    looked at yet, until a step betters less than the share ``settled`` of all
    ``k`` nearest. The best 2 ``k`` are scored by their exact cosine, and those
    of at least ``least`` come out. Queries that cannot be compared have no rows.
    """
    codes, graph = descend(vectors, id_col=id_col, vector_col=vector_col, dim_col=dim_col, **settings)
    out = graph.select("a", F.explode("nb").alias("n")).select("a", "n.b", "n.d")
    back = Window.partitionBy("b").orderBy("d", "a")
    both = out.select("a", "b").unionByName(out.withColumn("place", F.row_number().over(back)).where("place <= 8").select(F.col("b").alias("a"), F.col("a").alias("b")))
    links = materialize(both.distinct().groupBy("a").agg(F.collect_list("b").alias("nb")), "links")  # at most k + 8 a vector
    nodes = materialize(as_words(codes, "node"), "nodes")
    asked = usable(queries, id_col, vector_col, dim_col).groupBy("id").agg(F.min(F.struct("dim", "v")).alias("u")).select("id", "u.dim", "u.v")
    own = materialize(coded(asked, settings.get("seed", 7)), "own")
    asked = materialize(as_words(own, "q").withColumnRenamed("w", "qw"), "asked")
    distance = F.aggregate(F.zip_with("w", "qw", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, n: s + n)
    best = Window.partitionBy("q").orderBy("d", "node")

    def nearest_of(rows: DataFrame, most: int) -> DataFrame:
        return rows.withColumn("place", F.row_number().over(best)).where(F.col("place") <= most)

    # queries stand among all codes; only they keep what is near them
    among = codes.withColumn("worst", F.lit(0)).unionByName(own.withColumn("worst", F.lit(BITS + 1)))
    found = one_pass(among, 0, beam, settings.get("block", 256))
    for p in range(1, starts):
        found = found.unionByName(one_pass(among, p, beam, settings.get("block", 256)))
    near_by = found.select(F.col("a").alias("q"), F.col("b").alias("node"), F.col("d").cast("int").alias("d")).where("node <> q").distinct()
    met = near_by.join(nodes.select("node"), "node", "left_semi").select("q", "node", "d")
    held = materialize(nearest_of(met, beam).select("q", "node", "d", F.lit(False).alias("seen"), F.lit(0).alias("step")), "held")
    n, step = asked.count(), 0
    while n:
        step += 1
        look = materialize(nearest_of(held.where("not seen"), width).select("q", "node"), "look")
        beside = look.join(links, F.col("node") == F.col("a")).select("q", F.explode("nb").alias("node")).where("node <> q").distinct()
        fresh = beside.join(held.select("q", "node"), ["q", "node"], "left_anti").join(nodes.drop("dim"), "node").join(asked.drop("dim"), "q")
        seen = held.join(look.withColumn("now", F.lit(True)), ["q", "node"], "left").select("q", "node", "d", (F.col("seen") | F.col("now").isNotNull()).alias("seen"), "step")
        every = seen.unionByName(fresh.select("q", "node", distance.alias("d"), F.lit(False).alias("seen"), F.lit(step).alias("step")))
        newer = materialize(nearest_of(every, beam).select("q", "node", "d", "seen", "step"), "held")
        discard(held, look)
        held = newer
        better = nearest_of(held, k).where(F.col("step") == step).count()
        left = held.where("not seen").limit(1).count()
        if not left or step > 2 and better <= settled * k * n:
            break
    pairs = materialize(nearest_of(held, 2 * k).select(F.col("q").alias("a"), F.col("node").alias("b")), "pairs")
    every = [x.select(F.col(id_col).cast("bigint").alias("id"), F.col(vector_col).alias("e"), F.col(dim_col).alias("dim")) for x in (vectors, queries)]
    sims = exact(pairs, every[0].unionByName(every[1].join(every[0].select("id"), "id", "left_anti")))
    discard(codes, graph, links, nodes, own, asked, held, pairs)
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    return sims.where(F.col("sim") >= least - 1e-6).withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select(F.col("a").alias("qid"), F.col("b").alias("pid"), F.round("sim", 4).alias("sim"), "rank")


def similar_vectors(vectors: DataFrame, *, k: int = 5, least: float = 0.90, list_size: int = 8, **settings) -> DataFrame:
    """(chunk_id_a, chunk_id_b), a < b: one is among the other's ``k`` most similar and the cosine is at least ``least``.

    Edges are scored whose codes differ in no more places than those of two
    vectors of cosine ``least`` do but for a chance of about 1 in 160.
    """
    angle = float(np.arccos(least) / np.pi)
    near = int(np.ceil(BITS * angle + 2.5 * np.sqrt(BITS * angle * (1 - angle))))
    graph = neighbour_graph(vectors, **({"k": max(k, list_size), "near": near, "core": int(BITS * angle)} | settings))
    w = Window.partitionBy("a").orderBy(F.desc("sim"), "b")
    top = graph.where(F.col("sim") >= F.lit(least - 1e-6)).withColumn("place", F.row_number().over(w)).where(F.col("place") <= k)
    return top.select(F.least("a", "b").alias("chunk_id_a"), F.greatest("a", "b").alias("chunk_id_b")).distinct()
