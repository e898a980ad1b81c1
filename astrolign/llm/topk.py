"""Exact top-k search by inner product with a pivot-distance index.

Vectors become integers, floor(scale * x). One more coordinate, sqrt(M**2 - |x|**2) with M the largest norm, gives all of them the norm M, so that the largest inner product is the
smallest distance. The index keys each vector by its nearest pivot and the ring (annulus) of its distance from it. A query visits the
annuli in the order of the least distance that the triangle inequality allows, first until enough vectors are seen for a threshold, then all that the threshold
does not rule out. Pivots are fitted on a bounded sample; every vector is indexed, and the result is exact whatever the pivots are.

The index holds the vectors of the commonest length whose components leave 64-bit products exact. All others (finite components of any size, other lengths) go an exact way of their own:
the queries are held against them, and they as queries against all vectors, in blocks, by whole numbers without a bound. An inner product needs two vectors of one length, so a
vector is a candidate only for queries of its length, and a vector without components has the score 0 with its like. A score that doesn't fit in 64 bits ranks by its true value and is given as null.

Vectors that are null or hold null or non-finite components take no part, nor do rows without an id. Rows that repeat an id count as candidates on their own, and never for their own
id's query; the query of an id that has unlike vectors is the one that comes first in the order of arrays. An empty table gives no rows.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolign.llm.common import staged


def taking_part(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id, x: array of doubles) of the rows that take part."""
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("x")).where("vec_id IS NOT NULL AND x IS NOT NULL")
    finite = F.forall("x", lambda c: F.coalesce((F.abs(c) < float("inf")) & ~F.isnan(c), F.lit(False)))
    return rows.where(finite)


def commonest_length(rows: DataFrame) -> int:
    """The least among the commonest ones; 0 without rows."""
    most = rows.where("size(x) > 0").groupBy(F.size("x").alias("n")).count().orderBy(F.desc("count"), "n").first()
    return most.n if most else 0


def indexed(dim: int, scale: int = 1024):
    """Column: whether a vector x can go into an index of vectors with dim components: products of such integers fit in 62 bits."""
    bound = min(2.0**30, (2.0**62 / max(dim, 1)) ** 0.5)
    return (F.size("x") == dim) & (F.size("x") > 0) & F.forall("x", lambda c: F.abs(c) * scale < bound)


def integer_vectors(rows: DataFrame, dim: int, scale: int = 1024) -> DataFrame:
    """(vec_id, v: binary of little-endian 32-bit integers) of rows (vec_id, x) that indexed() allows."""
    out = pa.schema([("vec_id", pa.int64()), ("v", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.floor(scale * batch.column(1).flatten().to_numpy(zero_copy_only=False)).astype("<i4").reshape(-1, dim)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([r.tobytes() for r in x], pa.binary())], schema=out)

    return rows.mapInArrow(run, "vec_id long, v binary")


def whole_numbers(x: list[float], scale: int = 1024) -> list[int]:
    """floor(scale * c) of each component, however large. Beyond 2 ** 53 doubles are whole numbers."""
    return [math.floor(scale * c) if abs(c) < 2.0**53 else int(c) * scale for c in x]


def _dealt(parts):
    """Column: one of `parts` blocks for each row, whatever rows have in common."""
    return F.pmod(F.xxhash64(F.monotonically_increasing_id()), parts if not isinstance(parts, int) else F.lit(parts))


def exact_scores(queries: DataFrame, candidates: DataFrame, k: int, block: int = 512) -> DataFrame:
    """query_id, vec_id, wide (the score in decimal digits) of the k best candidates (vec_id, x) for each query (query_id, x) within each pair of blocks:
    by whole numbers of any size, only between vectors of one length, never for the query's own id."""
    size = F.size("x").alias("size")
    parts = lambda df: max(1, -(-df.count() // block))
    asked = queries.select("query_id", "x", size, _dealt(parts(queries)).alias("q")).groupBy("size", "q").agg(F.collect_list(F.struct("query_id", "x")).alias("queries"))
    held = candidates.select("vec_id", "x", size, _dealt(parts(candidates)).alias("c")).groupBy("size", "c").agg(F.collect_list(F.struct("vec_id", "x")).alias("vectors"))
    out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("wide", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for asked_, held_ in zip(batch.column(0), batch.column(1), strict=True):
                vectors = [(r["vec_id"], whole_numbers(r["x"])) for r in held_.as_py()]
                rows = []
                for query in asked_.as_py():
                    q = whole_numbers(query["x"])
                    scores = sorted((-sum(a * b for a, b in zip(q, x, strict=True)), i) for i, x in vectors if i != query["query_id"])[:k]
                    rows += [(query["query_id"], i, str(-s)) for s, i in scores]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), out, strict=True)], schema=out)

    return asked.join(held, "size").select("queries", "vectors").mapInArrow(run, "query_id long, vec_id long, wide string")


def _matrix(column, dim: int) -> np.ndarray:
    parts = column if isinstance(column, list) else column.to_pylist()
    return np.frombuffer(b"".join(parts), "<i4").reshape(-1, dim).astype(np.int64)


def fit_pivots(sample: np.ndarray, n: int, rounds: int = 8, seed: int = 5) -> np.ndarray:
    """At most n pivots: k-means of the sample, begun with points far apart."""
    rng = np.random.default_rng(seed)
    sample = np.unique(sample, axis=0).astype(float)
    if len(sample) <= n:
        return sample
    chosen = [int(rng.integers(len(sample)))]
    least = ((sample - sample[chosen[0]]) ** 2).sum(1)
    for _ in range(n - 1):
        chosen.append(int(least.argmax()))
        least = np.minimum(least, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    pivots = sample[chosen]
    for _ in range(rounds):
        near = _distances(sample, pivots).argmin(1)
        pivots = np.stack([sample[near == k].mean(0) if (near == k).any() else pivots[k] for k in range(n)])
    return pivots


def _distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    return np.sqrt(np.maximum((x * x).sum(1)[:, None] + (y * y).sum(1)[None] - 2 * x @ y.T, 0))


def _bounds(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """What the true distances can't be below and above. A sum of n rounded products, the last coordinate's root included, is off by less than (n + 8) * 2 ** -52 of
    (|x| + |y|) ** 2, whatever the order of summation; four times that is taken."""
    n = x.shape[1]
    xx, yy = (x * x).sum(1)[:, None], (y * y).sum(1)[None]
    square, off = xx + yy - 2 * x @ y.T, 4 * (n + 8) * 2.0**-52 * (np.sqrt(xx) + np.sqrt(yy)) ** 2
    return np.sqrt(np.maximum(square - off, 0)), np.sqrt(np.maximum(square + off, 0))


def _lifted(v: np.ndarray, top: float) -> np.ndarray:
    return np.concatenate([v, np.sqrt(np.maximum(top - (v.astype(float) ** 2).sum(1), 0))[:, None]], axis=1)


class PivotIndex:
    """rows: (vec_id, v, pivot, ring, block) of every vector, written to the shared folder; rings: at most pivots * most_rings of them, on the driver.
    pivots: unless given, the root of the number of vectors over 8, from 16 to most_pivots, so that annuli stay thin as the table grows."""

    def __init__(self, vectors: DataFrame, dim: int, pivots: int | None = None, sample: int = 4096, most_rings: int = 16, block: int = 1024, most_pivots: int = 256):
        vectors = staged(vectors, "vectors")
        self.dim = dim
        pivots = pivots or int(min(most_pivots, max(16, math.isqrt(vectors.count()) // 8)))
        taken = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
        norms = pa.schema([("top", pa.int64())])

        def largest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if batch.num_rows:
                    yield pa.RecordBatch.from_arrays([pa.array([int((_matrix(batch.column(0), dim) ** 2).sum(1).max())], pa.int64())], schema=norms)

        self.top = top = float(vectors.select("v").mapInArrow(largest, "top long").agg(F.max("top")).first()[0] or 0)
        some = _lifted(_matrix([bytes(r.v) for r in taken], dim), top) if taken else np.zeros((1, dim + 1))
        self.pivots = own = fit_pivots(some, pivots)
        reach = np.sort(_distances(some, own).min(1))
        low, width = float(reach[0]), max(1e-9, float(reach[-1] - reach[0]) / (most_rings - 2))
        out = pa.schema([("vec_id", pa.int64()), ("v", pa.binary()), ("pivot", pa.int32()), ("ring", pa.int32()), ("least", pa.float64()), ("most", pa.float64())])

        def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                least, most = _bounds(_lifted(_matrix(batch.column(1), dim), top), own)
                near = most.argmin(1)
                least, most = least[np.arange(len(near)), near], most[np.arange(len(near)), near]
                ring = np.clip(np.floor((most - low) / width) + 1, 0, most_rings - 1)
                yield pa.RecordBatch.from_arrays([*batch.columns, *[pa.array(c, f.type) for c, f in zip((near, ring.astype(np.int32), least, most), list(out)[2:], strict=True)]], schema=out)

        keyed = vectors.mapInArrow(key, "vec_id long, v binary, pivot int, ring int, least double, most double")
        self.rings = keyed.groupBy("pivot", "ring").agg(F.count("*").alias("n"), F.min("least").alias("d0"), F.max("most").alias("d1")).orderBy("pivot", "ring").toPandas()
        sizes = {int(r.pivot) * most_rings + int(r.ring): -(-int(r.n) // block) for r in self.rings.itertuples()}
        blocks = F.lit(1)
        if len(sizes):
            blocks = F.element_at(F.create_map(*[F.lit(x) for kv in sizes.items() for x in kv]), F.col("pivot") * most_rings + F.col("ring"))
        self.sizes, self.most_rings = sizes, most_rings
        packed = keyed.withColumn("block", _dealt(blocks)).groupBy("pivot", "ring", "block")
        self.blocks = staged(packed.agg(F.collect_list(F.struct("vec_id", "v")).alias("vectors")), "blocks")

    def search(self, queries: DataFrame, k: int = 10, chunk: int = 512) -> DataFrame:
        """query_id, vec_id, score of the k largest inner products of each query (query_id, v), ties to the smaller vec_id."""
        queries = staged(queries, "queries")
        chunks = max(1, -(-queries.count() // chunk))
        first = self._visit(queries.withColumn("threshold", F.lit(None).cast("long")).withColumn("seeds", F.lit(True)), k, chunks)
        first = staged(first, "seeds")
        ranked = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
        reached = first.withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") == k).select("query_id", F.col("score").alias("threshold"))
        second = self._visit(queries.join(reached, "query_id", "left").withColumn("seeds", F.lit(False)), k, chunks)
        return first.union(second).withColumn("rank", F.row_number().over(ranked)).where(F.col("rank") <= k).select("query_id", "vec_id", "score")

    def _visit(self, queries: DataFrame, k: int, chunks: int) -> DataFrame:
        """query_id, vec_id, score: the best k of each visited block. Seeds: the nearest annuli that hold k vectors besides the query; else all others that can reach the threshold."""
        dim, top, pivots, rings, sizes, most = self.dim, self.top, self.pivots, self.rings, self.sizes, self.most_rings
        at, n, d0, d1 = (rings[c].to_numpy() for c in ("pivot", "n", "d0", "d1"))
        ring = rings["ring"].to_numpy()
        plan = pa.schema([("pivot", pa.int32()), ("ring", pa.int32()), ("block", pa.int64()), ("query_id", pa.int64()), ("v", pa.binary()), ("threshold", pa.int64())])

        def expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows or not len(at):
                    continue
                v = _matrix(batch.column(1), dim)
                square = (v.astype(float) ** 2).sum(1)
                low, high = (d[:, at] for d in _bounds(np.concatenate([v, np.zeros((len(v), 1))], axis=1).astype(float), pivots))
                least = np.maximum(np.maximum(low - d1, d0 - high), 0)
                # Of the largest product that an annulus can hold; its few roundings, and that of a threshold to a double, stay within 2 ** -48 of the squares.
                best = (square[:, None] + top - least**2) / 2 + 2.0**-48 * (square[:, None] + top)
                order = np.argsort(least, axis=1, kind="stable")
                before = np.take_along_axis(np.broadcast_to(n, least.shape), order, 1).cumsum(1) - np.take_along_axis(np.broadcast_to(n, least.shape), order, 1)
                seed = np.zeros(least.shape, bool)
                np.put_along_axis(seed, order, before < k + 1, 1)
                seeds, thresholds = batch.column(3)[0].as_py(), batch.column(2).to_pylist()
                reach = best >= np.array([-np.inf if t is None else t for t in thresholds])[:, None]
                visit = seed if seeds else reach & ~seed
                rows = [(int(at[g]), int(ring[g]), b, i, x, t) for i, x, t, own in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), thresholds, visit, strict=True) for g in np.flatnonzero(own) for b in range(sizes[int(at[g]) * most + int(ring[g])])]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), plan, strict=True)], schema=plan)

        asked = queries.select("query_id", "v", "threshold", "seeds").mapInArrow(expand, "pivot int, ring int, block long, query_id long, v binary, threshold long")
        asked = asked.withColumn("chunk", F.pmod(F.xxhash64("query_id"), F.lit(chunks))).groupBy("pivot", "ring", "block", "chunk").agg(F.collect_list(F.struct("query_id", "v", "threshold")).alias("queries"))
        out = pa.schema([("query_id", pa.int64()), ("vec_id", pa.int64()), ("score", pa.int64())])

        def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for asked_, held in zip(batch.column(0), batch.column(1), strict=True):
                    q, x = asked_.as_py(), held.as_py()
                    ids = np.array([r["vec_id"] for r in x])
                    by_id = np.argsort(ids, kind="stable")
                    ids = ids[by_id]
                    candidates, own = _matrix([r["v"] for r in x], dim)[by_id], _matrix([r["v"] for r in q], dim)
                    small = float(np.abs(candidates).max()) * float(np.abs(own).max()) * dim < 2.0**52  # then doubles are exact, and faster
                    scores = (own.astype(float) @ candidates.T.astype(float)).astype(np.int64) if small else own @ candidates.T
                    rows = []
                    for r, s in zip(q, scores, strict=True):
                        fit = np.flatnonzero((ids != r["query_id"]) & (s >= (np.iinfo(np.int64).min if r["threshold"] is None else r["threshold"])))
                        fit = fit[np.argsort(-s[fit], kind="stable")[:k]]
                        rows += [(r["query_id"], int(i), int(c)) for i, c in zip(ids[fit], s[fit], strict=True)]
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)], schema=out)

        return asked.join(self.blocks, ["pivot", "ring", "block"]).select("queries", "vectors").mapInArrow(compare, "query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: str = "vec_id % 100 = 0", k: int = 10, vec_id: str = "vec_id", embedding: str = "embedding", **options) -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k largest inner products of each vector whose vec_id fulfils `queries` (SQL) with all vectors, ties to the smaller vec_id."""
    rows = taking_part(vectors, vec_id, embedding)
    dim = commonest_length(rows) or 1
    fits = indexed(dim)
    asked = staged(rows.where(queries).groupBy(F.col("vec_id").alias("query_id")).agg(F.min("x").alias("x")), "queries")
    index = PivotIndex(integer_vectors(rows.where(fits), dim), dim, **options)
    found = index.search(integer_vectors(asked.where(fits).withColumnRenamed("query_id", "vec_id"), dim).withColumnRenamed("vec_id", "query_id"), k)
    ranked = Window.partitionBy("query_id")
    odd = rows.where(~fits)
    if not odd.isEmpty():
        odd = staged(odd, "odd-vectors")
        more = exact_scores(asked.where(fits), odd, k).union(exact_scores(asked.where(~fits), rows, k))
        digits = lambda c: F.ltrim(F.translate(c, "-", ""))
        found = found.withColumn("wide", F.col("score").cast("string")).select("query_id", "vec_id", "wide").union(more)
        below = F.col("wide").startswith("-")
        # Whole numbers in digits: by sign, then by length, then digit by digit; of negative ones the shorter is the larger.
        length, text = F.length(digits(F.col("wide"))), digits(F.col("wide"))
        order = (below.cast("int"), F.when(below, length).otherwise(-length), F.when(below, text), F.desc_nulls_last(F.when(~below, text)), "vec_id")
        found = found.withColumn("rank", F.row_number().over(ranked.orderBy(*order))).withColumn("score", F.expr("try_cast(wide AS bigint)"))
    else:
        found = found.withColumn("rank", F.row_number().over(ranked.orderBy(F.desc("score"), "vec_id")))
    return found.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS x FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
q AS (SELECT vec_id, min(x) AS x FROM v WHERE vec_id % 100 = 0 GROUP BY vec_id),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_dot_product(q.x, c.x)::BIGINT AS score FROM q JOIN v c ON len(q.x) = len(c.x) AND c.vec_id <> q.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10"""
