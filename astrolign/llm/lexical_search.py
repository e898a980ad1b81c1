"""Ranked lexical search over bit-sliced Bloom signatures.

The index holds documents in blocks of like size. A block has one row of bits (a slice) for each position of its Bloom filters, one bit for each document: a term's documents are those whose bits are set in all of its slices,
and perhaps a few more. A term sets bits for each of the CLASSES that its frequency reaches (1, 2, 4, 8, 16), so the slices bound frequencies from above as well. The sum of a query's weights over the slices of its terms is
an upper bound of each document's score; documents are scored exactly, from their words, in the order of their bounds, until no bound reaches the score of the last place held. Every other document is provably behind.

Each task keeps the best of its own documents for each query; the best of all tasks' are ranked at the end, so what is shuffled is a few rows for each query and task.

A term is a maximal run of digits, letters and characters beyond ASCII, A-Z lower-cased. Null and empty texts, of documents and of queries, have no terms: such documents aren't counted, such queries have no results. Rows that repeat a
doc_id are documents of their own; a null doc_id comes last among equal scores. Queries that share an id are ranked each for itself. Very long texts count whole. Empty tables give no rows; other columns can have any name.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolign.llm import common
from astrolign.llm.lexical import Hashes, id_and_bytes, word_lists, words

#: Frequencies from which a term sets further bits.
CLASSES = (1, 2, 4, 8, 16)
HASHES = 4
BITS = 8  # of a slice column for each term and class
FLUSH = 8_000_000  # bytes of text that a task gathers before it makes blocks
CELLS = 2_000_000  # bounds that a task holds at once
BLOCK = 200_000  # words of queries that are searched for at once
#: A row of the index is a block of up to 512 documents: a few of them make a batch for Python.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxBytesPerBatch": "8m", "spark__sql__execution__arrow__maxRecordsPerBatch": "1000"}
_INDEX = pa.schema([("ids", pa.list_(pa.int64())), ("sizes", pa.list_(pa.int64())), ("width", pa.int64()), ("slices", pa.binary()), ("texts", pa.list_(pa.binary()))])
_INDEX_SQL = "ids array<long>, sizes array<long>, width long, slices binary, texts array<binary>"


def positions(hashes: np.ndarray, reached: int, width: int) -> np.ndarray:
    """HASHES x terms: the slices of terms for one class."""
    x = hashes + np.uint64(reached * 0x9E3779B97F4A7C15 % (1 << 64))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    a, b = x >> np.uint64(32), (x & np.uint64(0xFFFFFFFF)) | np.uint64(1)
    return np.stack([(a + b * np.uint64(k)) % np.uint64(width) for k in range(HASHES)]).astype(np.int64)


def index(docs: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Blocks of documents that have a term: their ids, numbers of terms, slices, and texts (compressed, as words with blanks between them). Lazy: stage it before it is searched."""

    def block(held: list[tuple]) -> tuple:
        width = max(64, -(-BITS * held[-1][0] // 64) * 64)
        bits = np.zeros((width, len(held)), bool)
        for reached in CLASSES:
            chosen = [h[3] if reached == 1 else h[3][h[4] >= reached] for h in held]
            doc = np.repeat(np.arange(len(held)), [len(c) for c in chosen])
            for at in positions(np.concatenate(chosen), reached, width):
                bits[at, doc] = True
        compress = zstandard.ZstdCompressor(level=1).compress
        return [h[1] for h in held], [h[2] for h in held], width, compress(np.packbits(bits, axis=1).tobytes()), [h[5] for h in held]

    def blocks(held: list[tuple]) -> Iterator[pa.RecordBatch]:
        held.sort(key=lambda h: h[0])
        part: list[tuple] = []
        for h in [*held, None]:
            if part and (h is None or h[0] > 2 * part[0][0] or len(part) == 512 or BITS * h[0] * len(part) > 16_000_000):
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(block(part), _INDEX, strict=True)], schema=_INDEX)
                part = []
            part.append(h)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, held, size, compress = Hashes(), [], 0, zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    counts: Counter = Counter()
                    for own in word_lists(text):
                        counts.update(own)
                    if not counts:
                        continue
                    h, tf = np.fromiter(map(hashes.__getitem__, counts), np.uint64, len(counts)), np.fromiter(counts.values(), np.int64, len(counts))
                    pairs = sum(int((tf >= c).sum()) for c in CLASSES)
                    held.append((pairs, i, int(tf.sum()), h, tf, compress(text)))
                    size += len(text)
                    if size >= FLUSH:
                        yield from blocks(held)
                        held, size = [], 0
        if held:
            yield from blocks(held)

    return id_and_bytes(docs, id_col, "long").mapInArrow(run, _INDEX_SQL)


class Queries:
    """Terms of a block of queries, numbered; for each query its terms."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]]):
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        self.terms = [np.array(sorted({self.vocabulary.setdefault(w, len(self.vocabulary)) for w in own}), np.int64) for _, own in rows]
        self.hashes = np.fromiter(map(Hashes().__getitem__, self.vocabulary), np.uint64, len(self.vocabulary))
        self.weights = np.zeros(len(self.vocabulary), np.int64)
        self.n, self.total = 0, 0

    def weigh(self, frequencies: dict[int, int], n: int, total: int) -> None:
        self.n, self.total = n, total
        self.weights[:] = [math.floor(1000 * math.log((2 * n + 2) / (2 * frequencies.get(k, 0) + 1))) for k in range(len(self.weights))]


def blocks(queries: DataFrame, id_col: str) -> Iterator[Queries]:
    rows, held = [], 0
    for row in id_and_bytes(queries, id_col, "string").toLocalIterator():
        if own := words(bytes(row.text) if row.text is not None else None):
            rows.append((row.id, own))
            held += len(own)
        if held >= BLOCK:
            yield Queries(rows)
            rows, held = [], 0
    if rows:
        yield Queries(rows)


def document_frequencies(indexed: DataFrame, queries: Queries) -> dict[int, int]:
    """Exact numbers of documents that hold each of the queries' terms, by the term's number: as many as the block of queries has terms at most."""
    shared = indexed.sparkSession.sparkContext.broadcast(queries)
    out = pa.schema([("term", pa.int32()), ("df", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counts, decompress = shared.value.vocabulary, Counter(), zstandard.ZstdDecompressor().decompress
        asked = set(known)
        for batch in batches:
            for texts in batch.column(0).to_pylist():
                for text in texts:
                    found: set[bytes] = set()
                    for own in word_lists(decompress(text)):
                        found |= asked.intersection(own)
                    counts.update(found)
        yield pa.RecordBatch.from_arrays([pa.array([known[w] for w in counts], pa.int32()), pa.array(counts.values(), pa.int64())], schema=out)

    rows = indexed.select("texts").mapInArrow(run, "term int, df long").groupBy("term").agg(F.sum("df").alias("df"))
    return {r.term: r.df for r in rows.collect()}


def contribution(tf: np.ndarray, m: np.ndarray) -> np.ndarray:
    return (1_000_000_000 * tf) // (1000 * tf + 8 * m)


class Ranking:
    """The best documents of one task for each query of a block."""

    def __init__(self, queries: Queries, k: int):
        self.queries, self.k = queries, k
        self.best: list[list[tuple]] = [[] for _ in queries.ids]  # (-score, no id, id), best first
        self.weights = [queries.weights[t].astype(np.float64) for t in queries.terms]
        self.scored = 0

    def lengths(self, sizes: np.ndarray) -> np.ndarray:
        q = self.queries
        if 90 * int(sizes.max()) * q.n < 1 << 63:
            return 10 + (90 * sizes * q.n) // q.total
        return np.array([10 + 90 * n * q.n // q.total for n in sizes.tolist()], np.int64)

    def bounds(self, sizes: np.ndarray, width: int, slices: bytes) -> np.ndarray:
        """Queries x documents: no score is above. Sums of whole numbers below 2^53, so exact in doubles (beyond, a part in 10^12 is added)."""
        q, n = self.queries, len(sizes)
        bits = np.frombuffer(zstandard.ZstdDecompressor().decompress(slices), np.uint8).reshape(width, -1)
        m = self.lengths(sizes)
        most, held, before = np.zeros((len(q.hashes), n)), None, np.zeros(n, np.int64)
        for k, reached in enumerate(CLASSES):
            own = np.bitwise_and.reduce(bits[positions(q.hashes, reached, width)], axis=0)
            held = own if held is None else held & own
            alive = np.flatnonzero(held.any(axis=1))
            if not len(alive):
                break
            top = contribution(np.minimum(CLASSES[k + 1] - 1, sizes) if k + 1 < len(CLASSES) else sizes, m)
            most[alive] += np.unpackbits(held[alive], axis=1, count=n) * (top - before).astype(np.float64)
            before = top
        return np.stack([w @ most[t] for w, t in zip(self.weights, q.terms, strict=True)]) * (1 + 1e-12)

    def add(self, ids: list[int | None], sizes: np.ndarray, texts: list[bytes], bounds: np.ndarray) -> None:
        """Scores documents exactly, best bounds first, as long as a bound reaches the last place."""
        known, decompress = self.queries.vocabulary, zstandard.ZstdDecompressor().decompress
        m, seen = self.lengths(sizes).tolist(), {}
        for query, (terms, own) in enumerate(zip(self.queries.terms, bounds, strict=True)):
            best, weights, names = self.best[query], self.queries.weights[terms].tolist(), terms.tolist()
            least = -best[-1][0] if len(best) == self.k else 1
            hopeful = np.flatnonzero(own >= least)
            for doc in hopeful[np.argsort(-own[hopeful], kind="stable")].tolist():
                if own[doc] < (-best[-1][0] if len(best) == self.k else 1):
                    break
                if (tf := seen.get(doc)) is None:
                    tf = seen[doc] = Counter()
                    for part in word_lists(decompress(texts[doc])):
                        tf.update(map(known.get, part, repeat(-1)))  # -1: a word that no query has
                    self.scored += 1
                score = 0
                for t, w in zip(names, weights, strict=True):
                    if n := tf.get(t):
                        score += w * ((1_000_000_000 * n) // (1000 * n + 8 * m[doc]))
                row = (-score, ids[doc] is None, ids[doc])
                if score > 0 and (len(best) < self.k or row[:2] + (row[2] or 0,) < best[-1][:2] + (best[-1][2] or 0,)):
                    best.append(row)
                    best.sort(key=lambda x: (x[0], x[1], x[2] or 0))
                    del best[self.k :]


def search(indexed: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "item_id") -> DataFrame:
    """item_id, rank (from 1), doc_id, score: the k best documents of a staged index for each query, with scores above 0; ties by doc_id."""
    spark = indexed.sparkSession
    schema = "query int, item_id string, doc_id long, score long"
    out = pa.schema([("query", pa.int32()), ("item_id", pa.string()), ("doc_id", pa.int64()), ("score", pa.int64())])
    sums = indexed.select(F.size("ids").alias("n"), F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x).alias("total")).agg(F.sum("n"), F.sum("total")).first()
    found = spark.createDataFrame([], schema)
    first = 0

    def ranked(block: Queries, first: int) -> DataFrame:
        shared = spark.sparkContext.broadcast(block)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = Ranking(shared.value, k)
            held, cells, size = ([], [], [], []), 0, 0

            def flush() -> None:
                own.add([i for x in held[0] for i in x], np.concatenate(held[1]), [t for x in held[2] for t in x], np.concatenate(held[3], axis=1))
                for x in held:
                    x.clear()

            for batch in batches:
                for at in range(batch.num_rows):
                    ids, sizes, width, slices, texts = (c[at].as_py() for c in batch.columns)
                    sizes = np.array(sizes, np.int64)
                    for x, value in zip(held, (ids, sizes, texts, own.bounds(sizes, width, slices)), strict=True):
                        x.append(value)
                    cells, size = cells + held[3][-1].size, size + sum(map(len, texts))
                    if cells >= CELLS or size >= 4 * FLUSH:
                        flush()
                        cells = size = 0
            if held[0]:
                flush()
            rows = [(first + q, own.queries.ids[q], i, -s) for q, best in enumerate(own.best) for s, _, i in best]
            yield pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], f.type) for c, f in enumerate(out)], schema=out)

        return indexed.mapInArrow(run, schema)

    if sums[0]:
        for block in blocks(queries, id_col):
            block.weigh(document_frequencies(indexed, block), sums[0], sums[1])
            found, first = found.union(ranked(block, first)), first + len(block.ids)
    place = F.row_number().over(Window.partitionBy("query").orderBy(F.col("score").desc(), F.col("doc_id").asc_nulls_last()))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", "rank", "doc_id", "score")


def ranked(docs: DataFrame, queries: DataFrame, k: int = 10, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """Indexes docs, searches for the queries, and returns the written result; the index is removed."""
    spark = docs.sparkSession
    path = common.new_path(spark, "ranked")
    with common.settings(spark, **SMALL_BATCHES), common.scratch(spark):
        result = search(common.staged(index(docs, id_col), "lexical-index"), queries, k, item_col)
        result.write.parquet(path)
    return spark.read.schema(result.schema).parquet(path)
