"""MinHash near-duplicates by circulant MinHash, banding and exact Jaccard verification.

Two permutations of a hashed coordinate space make the whole signature: the first one scatters a document's shingles, the second one, shifted
circularly by 1, 2, ..., gives one minimum for each shift. Bands of the signature find candidates, full sets confirm them.
Words are runs without ASCII white space with A-Z lowered, a document's set holds its distinct shingles of n words; a shorter text's whole sequence counts
as one shingle. A text without words, or null, has an empty set and links with nothing. Rows that repeat a doc_id give one row; if their texts differ in their sets, an error says so.
Rows without a doc_id take no part and give none. Very long texts count whole; columns other than the id and the text can have any name; an empty table gives an empty one.

What is counted for each key is written before it is joined to the key's rows: both sides of such a join are then plain shuffles, and Spark splits a bucket that holds a large share of all rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.llm.common import id_and_text, refuse_unlike_rows, staged

_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
#: The coordinate space of the permutations: a prime, far more coordinates than a document has shingles.
SPACE = (1 << 31) - 1


def words_of(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").translate(_LOWER).split()


def shingles(words: list[bytes], n: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles: two differ with all but 2 ** -64 probability."""
    if not words:
        return np.zeros(0, np.uint64)
    grams = map(b" ".join, zip(*[words[i:] for i in range(n)])) if len(words) >= n else [b" ".join(words)]
    return np.unique(np.fromiter(map(xxhash.xxh3_64_intdigest, grams), np.uint64))


def mixed(x: np.ndarray, seed: int) -> np.ndarray:
    """A bijection of 64-bit numbers."""
    x = x ^ np.uint64(seed)
    for k in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(k)
    return x ^ (x >> np.uint64(31))


def signature(hashes: np.ndarray, size: int) -> np.ndarray:
    """Circulant MinHash. The first permutation places a shingle at a coordinate; shift k gives the second one's value k places on:
    coordinate (place + k) of a table that a bijection fills, so that one pass of shifts yields all signature values."""
    place = mixed(hashes, 0x9E3779B97F4A7C15) % np.uint64(SPACE)
    out = np.empty(size, np.uint64)
    for at in range(0, size, 64):
        shifts = np.arange(at + 1, min(size, at + 64) + 1, dtype=np.uint64)
        out[at : at + len(shifts)] = mixed((place[None, :] + shifts[:, None]) % np.uint64(SPACE), 0xD1B54A32D192ED03).min(1)
    return out


def signatures(docs: DataFrame, n: int, bands: int, rows: int) -> DataFrame:
    """doc_id, n_shingles, digest (of the set), keys (one for each band), words (lower-cased, compressed) of each document."""
    out = pa.schema([("doc_id", pa.int64()), ("n_shingles", pa.int64()), ("digest", pa.binary()), ("keys", pa.list_(pa.int64())), ("words", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=3).compress
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, columns = batch.slice(at, 500), ([], [], [], [])
                for text in part.column(1).to_pylist():
                    words = words_of(text)
                    hashes = shingles(words, n)
                    keys = None
                    if len(hashes):
                        values = signature(hashes, bands * rows).reshape(bands, rows)
                        keys = [xxhash.xxh3_64_intdigest(v.tobytes(), b) - (1 << 63) for b, v in enumerate(values)]
                    for column, value in zip(columns, (len(hashes), xxhash.xxh3_128_digest(hashes.tobytes()), keys, pack(b" ".join(words))), strict=True):
                        column.append(value)
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(columns, list(out)[1:], strict=True)]], schema=out)

    return id_and_text(docs).where("doc_id IS NOT NULL").mapInArrow(run, "doc_id long, n_shingles long, digest binary, keys array<long>, words binary")


def verified(pairs: DataFrame, sets: DataFrame, n: int, percent: int) -> DataFrame:
    """Those of the distinct pairs (a, b) whose full sets have 100 * intersection >= percent * union."""
    # Merge joins at every size: pairs have no bound that would let them be broadcast.
    own = sets.select("rep", "words").hint("merge")
    sides = pairs.join(own.withColumnsRenamed({"rep": "a", "words": "words_a"}), "a").join(own.withColumnsRenamed({"rep": "b", "words": "words_b"}), "b")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unpack = zstandard.ZstdDecompressor().decompress
        last: tuple = (None, None)
        for batch in batches:
            keep = []
            for a, wa, wb in zip(batch.column(0).to_pylist(), batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                if last[0] != a:
                    last = a, shingles(unpack(wa).split(), n)
                sa, sb = last[1], shingles(unpack(wb).split(), n)
                both = len(np.intersect1d(sa, sb, assume_unique=True))
                keep.append(100 * both >= percent * (len(sa) + len(sb) - both))
            part = batch.filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(1)], schema=out)

    return sides.select("a", "b", "words_a", "words_b").mapInArrow(run, "a long, b long")


def components(links: DataFrame, most_rounds: int = 60) -> DataFrame:
    """node, root (the smallest node that it reaches) of every node in links (a, b), by large-star and small-star rounds on written tables."""
    edges = staged(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    for _ in range(most_rounds):
        both = edges.union(edges.select("v", "u"))
        low = staged(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")), "low")
        large = staged(both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct(), "large")
        low = staged(large.groupBy("u").agg(F.min("v").alias("m")), "low")
        small = large.join(low, "u").select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*")
        new = staged(small.where("u <> v").distinct(), "edges")
        n, agreed = new.count(), new.join(edges, ["u", "v"], "left_semi").count()
        same = n == agreed == edges.count()
        edges = new
        if same:
            break
    else:
        raise RuntimeError(f"components did not settle in {most_rounds} rounds")
    return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))


def linked_in_blocks(members: DataFrame, n: int, percent: int, block: int = 512) -> DataFrame:
    """Links (a, b) between rows (key, n: rows of the key, rep, root, words) of one key and different roots. A key's rows are dealt into blocks of about `block`, and each
    pair of blocks is one group, where one row after the other is held against all others; only links come out."""
    dealt = members.withColumn("blocks", F.ceil(F.col("n") / block)).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "rep", "root", "words")
    out = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(table: pa.Table) -> pa.Table:
        unpack = zstandard.ZstdDecompressor().decompress
        reps, roots = table["rep"].to_numpy(), table["root"].to_numpy()
        sets = [shingles(unpack(w).split(), n) for w in table["words"].to_pylist()]
        sizes = np.array([len(s) for s in sets])
        order = np.argsort(sizes, kind="stable")
        values, codes = np.unique(np.concatenate([sets[k] for k in order]), return_inverse=True)
        owner = np.repeat(np.arange(len(order)), sizes[order])  # by size, so those that can reach `percent` stand side by side
        by_code = np.argsort(codes, kind="stable")
        bounds = np.searchsorted(codes[by_code], np.arange(len(values) + 1))
        owners, ends, links = owner[by_code], np.cumsum(sizes[order]), []
        for x in range(len(order)):
            own = codes[ends[x] - sizes[order[x]] : ends[x]]
            common = np.bincount(np.concatenate([owners[bounds[c] : bounds[c + 1]] for c in own]), minlength=len(order))
            union = sizes[order[x]] + sizes[order] - common
            hit = np.flatnonzero((100 * common >= percent * union) & (roots[order] != roots[order[x]]))
            links += [(int(reps[order[x]]), int(reps[order[y]])) for y in hit if y > x]
        return pa.Table.from_arrays([pa.array([a for a, _ in links], pa.int64()), pa.array([b for _, b in links], pa.int64())], schema=out)

    return dealt.groupBy("key", "i", "j").applyInArrow(run, "a long, b long")


def near_duplicates(docs: DataFrame, n: int = 5, percent: int = 80, bands: int = 32, rows: int = 4, small: int = 48) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of every document.

    A pair at the threshold of 0.8 shares no band with probability (1 - 0.8 ** 4) ** 32 = 5e-8. Equal sets meet by their digest and count once from there on.
    Each band's bucket first compares all members with the one that shares most buckets, which links groups of copies without their pairs. Buckets whose
    other members still fall into several components then compare all pairs of different components: as pairs in buckets of up to `small`, in blocks
    beyond. So no pair that shares a bucket is left out, but those that are linked anyhow."""
    every = staged(signatures(docs, n, bands, rows), "signatures")
    refuse_unlike_rows(every, "digest")
    full = every.where("n_shingles > 0")
    sets = staged(full.groupBy("digest").agg(F.min("doc_id").alias("rep"), F.first("keys").alias("keys"), F.first("words").alias("words")), "sets")
    keyed = sets.select("rep", F.explode("keys").alias("key"))
    shared = staged(keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "shared")
    buckets = staged(keyed.join(shared, "key"), "buckets")
    degree = buckets.groupBy("rep").agg(F.sum("n").alias("degree"))
    leaders = staged(buckets.join(degree, "rep").groupBy("key").agg(F.max_by("rep", F.struct("degree", -F.col("rep"))).alias("leader")), "leaders")
    buckets = staged(buckets.join(leaders, "key").where("rep <> leader"), "members")
    tested = staged(buckets.select(F.least("leader", "rep").alias("a"), F.greatest("leader", "rep").alias("b")).distinct(), "pairs")
    # Words travel once to the documents that are in pairs at all; what follows reads only these.
    paired = tested.select(F.explode(F.array("a", "b")).alias("rep")).distinct()
    words = staged(sets.select("rep", "words").hint("merge").join(paired, "rep", "left_semi"), "words")
    links = staged(verified(tested, words, n, percent), "links")
    roots = components(links)
    left = staged(buckets.join(roots.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", F.coalesce("root", "rep").alias("root")), "rooted")
    open_keys = staged(left.groupBy("key").agg(F.min("root").alias("r0"), F.max("root").alias("r1"), F.count("*").alias("n")).where("r0 < r1").select("key", "n"), "open")
    left = staged(left.join(open_keys, "key"), "left")
    few = left.where(F.col("n") <= small)
    pairs = few.alias("x").join(few.alias("y"), F.expr("x.key = y.key AND x.rep < y.rep AND x.root <> y.root")).select(F.col("x.rep").alias("a"), F.col("y.rep").alias("b")).distinct()
    more = staged(verified(pairs.join(tested, ["a", "b"], "left_anti"), words, n, percent), "links")
    many = left.where(F.col("n") > small).join(words, "rep")
    blocks = staged(linked_in_blocks(many.select("key", "n", "rep", "root", "words"), n, percent), "links")
    roots = components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).union(more).union(blocks))
    members = full.select("doc_id", "digest").distinct().join(sets.select("digest", "rep"), "digest").select("doc_id", "rep")
    members = members.groupBy("doc_id").agg(F.min("rep").alias("rep"))
    out = every.groupBy("doc_id").agg(F.max("n_shingles").alias("n_shingles")).join(members, "doc_id", "left").join(roots.withColumnRenamed("node", "rep"), "rep", "left")
    component = F.coalesce("root", "rep", "doc_id")
    return out.select("doc_id", "n_shingles", component.alias("component_id"), (F.col("doc_id") == component).alias("kept"))
