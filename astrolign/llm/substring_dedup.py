"""Substring dedup by super-k-mer partitioning.

A window is `size` consecutive words. Its minimiser is the smallest hash among its runs of `mer` words; consecutive windows that share a minimiser form a
super-k-mer and travel as one string to the bucket of that minimiser, so equal windows meet there. A bucket sorts its windows by hash, compares
neighbours word by word, and so knows the smallest doc_id of each window exactly.

A batch first looks at its own documents: where it holds a super-k-mer more than once, only the occurrences in the smallest doc_id travel; the words of all others are covered by that
document whatever lies elsewhere, and their runs go straight to the result. So a passage that a third of all documents share reaches its bucket once for each batch of FLUSH characters.

Words are runs without ASCII white space. Null texts have none. Rows that repeat a doc_id and its text lose the same words; if their texts differ, an error says so. Rows without a doc_id neither remove
words elsewhere nor lose any. Very long texts count whole; other columns can have any name; an empty table gives an empty one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.llm.common import id_and_text, partitions, refuse_unlike_rows

FLUSH = 8_000_000
#: Without words: runs that are settled, with their lengths in place of super-k-mers.
_BLOB = pa.schema([("bucket", pa.int32()), ("words", pa.binary()), ("kmers", pa.binary()), ("docs", pa.binary()), ("starts", pa.binary())])
_BLOB_SQL = "bucket int, words binary, kmers binary, docs binary, starts binary"


def _packed(numbers: np.ndarray, compress) -> bytes:
    """int64 numbers as compressed byte planes of their differences."""
    steps = np.diff(numbers, prepend=0).astype("<i8")
    return compress(np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8).T).tobytes())


def _unpacked(data: bytes, decompress) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(np.frombuffer(decompress(data), np.uint8).reshape(8, -1).T).view("<i8").reshape(-1))


class _Hashes(dict):
    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value


def super_kmers(words: list[list[bytes]], size: int, mer: int, hashes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of documents that have `size` words at least: document, first window, number of windows and minimiser of each super-k-mer."""
    lengths = np.array([len(w) for w in words])
    h = np.fromiter((x for w in words for x in map(hashes.__getitem__, w)), np.uint64, int(lengths.sum()))
    odd = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)
    grams = np.zeros(len(h) - mer + 1, np.uint64)
    for j in range(mer):
        grams ^= (h[j : len(grams) + j] ^ (h[j : len(grams) + j] >> np.uint64(29))) * odd[j % 5] + np.uint64(j)
    grams = (grams ^ (grams >> np.uint64(32))) * odd[3]
    least = grams[: len(h) - size + 1].copy()
    for j in range(1, size - mer + 1):
        np.minimum(least, grams[j : j + len(least)], out=least)
    ends = np.cumsum(lengths)
    counts = lengths - size + 1
    doc = np.repeat(np.arange(len(words)), counts)
    inside = np.arange(int(counts.sum())) - np.repeat(np.cumsum(counts) - counts, counts)
    minimiser = least[inside + np.repeat(ends - lengths, counts)]
    new = np.ones(len(doc), bool)
    new[1:] = (minimiser[1:] != minimiser[:-1]) | (doc[1:] != doc[:-1])
    first = np.flatnonzero(new)
    return doc[first], inside[first], np.diff(np.append(first, len(doc))), minimiser[first]


def blobs(docs: DataFrame, size: int, mer: int, buckets: int) -> DataFrame:
    """Rows for each batch and bucket: distinct super-k-mers, and where they occur in the batch's smallest doc_id that has them; and a row for each batch's settled runs."""

    def pack(ids: list[int], words: list[list[bytes]], hashes) -> pa.RecordBatch:
        compress = zstandard.ZstdCompressor(level=3).compress
        doc, first, count, minimiser = super_kmers(words, size, mer, hashes)
        joined = [b" ".join(w) for w in words]
        offsets = [np.concatenate([[0], np.cumsum([len(x) + 1 for x in w])]) for w in words]
        base = np.concatenate([[0], np.cumsum([len(o) for o in offsets])])[doc]
        flat = np.concatenate(offsets)
        start, end = flat[base + first].tolist(), (flat[base + first + count + size - 1] - 1).tolist()
        bucket = (minimiser % np.uint64(buckets)).astype(np.int64)
        order = np.argsort(bucket, kind="stable")
        cuts = np.flatnonzero(np.diff(bucket[order], prepend=-1, append=buckets))
        own, docs_, columns, settled = np.array(ids, np.int64)[doc], doc.tolist(), ([], [], [], [], []), []

        def put(*row) -> None:
            for column, value in zip(columns, row, strict=True):
                column.append(value)

        for a, b in zip(cuts[:-1], cuts[1:], strict=True):
            at = order[a:b]
            seen: dict[bytes, int] = {}
            kmers = np.array([seen.setdefault(joined[docs_[k]][start[k] : end[k]], len(seen)) for k in at.tolist()])
            if len(seen) < len(at):
                least = np.full(len(seen), np.iinfo(np.int64).max)
                np.minimum.at(least, kmers, own[at])
                covered = own[at] > least[kmers]
                settled.append(at[covered])
                at, kmers = at[~covered], kmers[~covered]
            put(int(bucket[at[0]]), compress(b"\n".join(seen)), _packed(kmers, compress), _packed(own[at], compress), _packed(first[at], compress))
        if settled and len(at := np.sort(np.concatenate(settled))):  # in the order of the texts: runs that touch become one
            new = np.ones(len(at), bool)
            new[1:] = (doc[at][1:] != doc[at][:-1]) | (first[at][1:] != (first + count)[at][:-1])
            heads = np.flatnonzero(new)
            last = at[np.append(heads[1:], len(at)) - 1]
            put(int(own[at[0]] % buckets), None, _packed((first + count)[last] + size - 1 - first[at[heads]], compress), _packed(own[at[heads]], compress), _packed(first[at[heads]], compress))
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _BLOB, strict=True)], schema=_BLOB)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, words, held, hashes = [], [], 0, _Hashes()
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    own = (text or "").encode().split()
                    if len(own) >= size:
                        ids.append(i)
                        words.append(own)
                        held += len(text)
                    if held >= FLUSH:
                        yield pack(ids, words, hashes)
                        ids, words, held = [], [], 0
        if ids:
            yield pack(ids, words, hashes)

    return docs.where("doc_id IS NOT NULL").mapInArrow(run, _BLOB_SQL)


def repeated_runs(rows: list[tuple], size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of one bucket's blobs: doc_id, first and end word of each run that windows of smaller doc_ids cover."""
    decompress = zstandard.ZstdDecompressor().decompress
    seen: dict[bytes, int] = {}
    kmers, docs, starts = [], [], []
    for words, own, ids, firsts in rows:
        to = np.array([seen.setdefault(s, len(seen)) for s in decompress(words).split(b"\n")], np.int64)
        kmers.append(to[_unpacked(own, decompress)])
        docs.append(_unpacked(ids, decompress))
        starts.append(_unpacked(firsts, decompress))
    kmers, docs, starts = np.concatenate(kmers), np.concatenate(docs), np.concatenate(starts)
    first_doc = np.full(len(seen), np.iinfo(np.int64).max)
    np.minimum.at(first_doc, kmers, docs)
    vocabulary: dict[bytes, int] = {}
    lengths = np.array([s.count(b" ") + 1 for s in seen])
    ids = np.fromiter((vocabulary.setdefault(w, len(vocabulary)) for s in seen for w in s.split()), np.int64, int(lengths.sum()))
    counts = lengths - size + 1
    kmer = np.repeat(np.arange(len(seen)), counts)
    heads = np.cumsum(counts) - counts
    at = np.arange(len(kmer)) - np.repeat(heads - (np.cumsum(lengths) - lengths), counts)
    mixed = ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    mixed = (mixed ^ (mixed >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    total = np.zeros(len(at), np.uint64)
    for j in range(size):
        total = (total ^ (total >> np.uint64(27))) * np.uint64(0xBF58476D1CE4E5B9) + mixed[at + j]
    order = np.argsort(total, kind="stable")
    differs = total[order][1:] != total[order][:-1]
    same = np.flatnonzero(~differs)
    one, two = at[order[same]], at[order[same + 1]]
    if any((ids[one + j] != ids[two + j]).any() for j in range(size)):  # two windows with one hash: sort by the words themselves
        columns = [ids[at + j] for j in range(size)]
        order = np.lexsort(columns)
        differs = np.any([c[order][1:] != c[order][:-1] for c in columns], axis=0)
    group = np.concatenate([[0], np.cumsum(differs)])
    least = np.minimum.reduceat(first_doc[kmer][order], np.concatenate([[0], np.flatnonzero(differs) + 1]))
    window_doc = np.empty(len(at), np.int64)
    window_doc[order] = least[group]
    hit = np.minimum.reduceat(window_doc, heads)[kmers] < docs
    kmers, docs, starts = kmers[hit], docs[hit], starts[hit]
    n = counts[kmers]
    inside = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    covered = window_doc[np.repeat(heads[kmers], n) + inside] < np.repeat(docs, n)
    before = np.concatenate([[False], covered[:-1]]) & (inside > 0)
    after = np.concatenate([covered[1:], [False]]) & np.concatenate([inside[1:] > 0, [False]])
    begin, end = covered & ~before, covered & ~after
    word = np.repeat(starts, n) + inside
    return np.repeat(docs, n)[begin], word[begin], word[end] + size


def repeats(docs: DataFrame, size: int = 13, mer: int = 3, buckets: int | None = None) -> DataFrame:
    """doc_id, start, end: runs of words (end exclusive) that windows of documents with smaller ids cover. Runs of a document can overlap.
    buckets: as many that one bucket's windows fit a task's memory; 8 for each shuffle partition unless given. They go to two tasks for each shuffle partition, to each as many."""
    spark = docs.sparkSession
    n = 2 * partitions(spark)
    # Spark deals rows out by a hash of the key: for each task a key that goes there.
    numbers = spark.range(0, 40 * n, 1, 1).select(F.col("id").cast("int").alias("key"))
    keys = {r.task: r.key for r in numbers.groupBy(F.pmod(F.hash("key"), F.lit(n)).alias("task")).agg(F.min("key").alias("key")).collect()}
    keys = F.array(*[F.lit(keys.get(k, -k)) for k in range(n)])
    made = blobs(id_and_text(docs), size, mer, buckets or 4 * n).withColumn("key", F.get(keys, F.pmod("bucket", F.lit(n))))
    dealt = made.repartition(n, "key").sortWithinPartitions("bucket").drop("key")
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int32()), ("end", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(repeated_runs(rows, size), out, strict=True)], schema=out)

        bucket, rows, decompress = None, [], zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for own, *row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if own != bucket and rows:
                    yield done()
                    rows = []
                bucket = own
                if row[0] is None:
                    lengths, docs_, starts = (_unpacked(x, decompress) for x in row[1:])
                    yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip((docs_, starts, starts + lengths), out, strict=True)], schema=out)
                else:
                    rows.append(row)
        if rows:
            yield done()

    return dealt.mapInArrow(run, "doc_id long, start int, end int")


def deduplicate(docs: DataFrame, size: int = 13, **options) -> DataFrame:
    """doc_id, n_words, n_removed, kept (text: the words left, joined by one space) of every row."""
    texts = id_and_text(docs)
    refuse_unlike_rows(texts.select("doc_id", F.xxhash64("text").alias("digest")), "digest")
    cuts = repeats(docs, size, **options).groupBy("doc_id").agg(F.collect_list(F.struct("start", "end")).alias("cuts"))
    packed = pa.schema([("doc_id", pa.int64()), ("packed", pa.binary())])
    out = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.binary())])

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([compress((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())], schema=packed)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), ([], [], [])
                for text, own in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    words = decompress(text).split()
                    total = len(words)
                    if own:
                        gone = np.zeros(total + 1, np.int64)
                        np.add.at(gone, [x["start"] for x in own], 1)
                        np.add.at(gone, [x["end"] for x in own], -1)
                        words = [w for w, g in zip(words, np.cumsum(gone)[:-1].tolist(), strict=True) if not g]
                    for column, value in zip(rows, (total, total - len(words), b" ".join(words)), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(rows, list(out)[1:], strict=True)]], schema=out)

    # The texts travel compressed to meet their runs.
    joined = texts.mapInArrow(pack, "doc_id long, packed binary").join(cuts, "doc_id", "left").select("doc_id", "packed", "cuts")
    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, kept binary").withColumn("kept", F.col("kept").cast("string"))
