"""Benchmark decontamination by suffix arrays of the training texts.

A task gathers documents to shards of about SHARD words and sorts the suffixes of a shard by words: first by as many words as fit a 64-bit key, then by ranks of prefixes that grow threefold each round, until
no longer prefix could tell test suffixes apart. Only suffixes that begin with a word of the benchmark are in the array, and only groups that some test suffix enters are sorted further: no other can be met.
Every suffix of every test item is then looked up in the shard by binary search, key by key, which gives the range of suffixes that begin with its window and the longest verbatim match with its places.

The items travel to the tasks in blocks of about BLOCK words, one after the other, so what is broadcast at once has a bound that the benchmark's size doesn't move.

A window is `size` consecutive words of an item; an item of fewer words, but not none, is one window. Null texts, of either table, have no words. Rows that repeat an id: documents give a row each; items with one id count
as one item that has the windows of all of them. Items without an id make words hit but are not listed. Documents without a doc_id are looked up like all others. Very long texts are taken whole, in overlapping
segments. Empty tables give no rows, or rows without hits. Other columns can have any name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolign.llm.lexical import id_and_bytes, word_lists, words

SHARD = 1_000_000
BLOCK = 1_000_000
_RUNS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_RUNS_SQL = "array<struct<start:long,end:long>>"


class Items:
    """A block of test items: their words as numbers from 1 on (0 for all other words), each item followed by zeros, and what is known of each suffix."""

    def __init__(self, rows: list[tuple[str | None, list[bytes]]], size: int):
        rows = [(i, w) for i, w in rows if w]
        self.ids = [i for i, _ in rows]
        self.vocabulary: dict[bytes, int] = {}
        for _, own in rows:
            for w in own:
                self.vocabulary.setdefault(w, len(self.vocabulary) + 1)
        self.bits = max(1, len(self.vocabulary).bit_length())
        self.per_key = 63 // self.bits
        lengths = np.array([len(w) for _, w in rows], np.int64)
        self.longest = int(lengths.max(initial=0))
        starts = np.cumsum(lengths + self.per_key) - lengths - self.per_key
        flat = np.zeros(int((lengths + self.per_key).sum()), np.int64)
        self.item = np.repeat(np.arange(len(rows)), lengths)
        self.place = np.arange(len(self.item)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.at = np.repeat(starts, lengths) + self.place
        flat[self.at] = np.fromiter((self.vocabulary[w] for _, own in rows for w in own), np.int64, len(self.at))
        self.keys = packed(flat, self.bits, self.per_key)
        self.left = np.repeat(lengths, lengths) - self.place  # words of the suffix
        self.window = np.minimum(size, np.repeat(lengths, lengths))
        self.window[self.left < self.window] = 0

    def numbers(self, text: bytes | None) -> np.ndarray:
        get = self.vocabulary.get
        parts = [np.fromiter(map(get, own, repeat(0)), np.int32, len(own)) for own in word_lists(text)]
        return parts[0] if len(parts) == 1 else np.concatenate(parts)


def packed(numbers: np.ndarray, bits: int, per_key: int) -> np.ndarray:
    """The numbers from each place on, per_key of them side by side in one number; zeros behind the last."""
    padded = np.concatenate([numbers, np.zeros(per_key, numbers.dtype)]).astype(np.int64)
    out = padded[: len(numbers)].copy()
    for k in range(1, per_key):
        out <<= bits
        out |= padded[k : k + len(numbers)]
    return out


class Shard:
    """The suffix array of a sequence of words, as far as the items' suffixes can tell."""

    def __init__(self, numbers: np.ndarray, items: Items):
        self.items = items
        keys = packed(numbers, items.bits, items.per_key)
        self.keys = np.append(keys, 0)
        self.order = np.flatnonzero(numbers)
        first = keys[self.order]
        by = np.argsort(first, kind="stable")
        self.order, first = self.order[by], first[by]
        depth = items.per_key
        if depth < items.longest and len(first):
            new = np.append(True, first[1:] != first[:-1])
            entered = np.isin(first, np.unique(items.keys[items.at]))  # what no test suffix enters stays as it is
            rank = np.zeros(len(numbers) + 1, np.int64)
            heads = np.flatnonzero(new)
            rank[self.order] = np.repeat(heads, np.diff(np.append(heads, len(new)))) + 1
            self.refine(rank, new, entered, depth)

    def refine(self, rank: np.ndarray, new: np.ndarray, entered: np.ndarray, depth: int) -> None:
        """Sorts groups of suffixes that are equal in `depth` words by the ranks of what follows, until the order holds for the longest item. A rank is one more than the first place of its group, 0 behind the end."""
        bits = int(len(rank)).bit_length()
        more = 63 // bits - 1
        while depth < self.items.longest:
            alone = new & np.append(new[1:], True)
            open_ = np.flatnonzero(entered & ~alone)
            if not len(open_):
                return
            at = self.order[open_]
            key = rank[at]
            for k in range(1, more + 1):
                key = (key << bits) | rank[np.minimum(at + k * depth, len(rank) - 1)]
            by = np.argsort(key, kind="stable")
            key = key[by]
            self.order[open_] = at[by]  # the groups keep their places: the first part of the key is their rank
            split = np.append(True, key[1:] != key[:-1])
            new[open_] = split
            heads = np.flatnonzero(split)
            rank[self.order[open_]] = np.repeat(open_[heads], np.diff(np.append(heads, len(open_)))) + 1
            depth *= more + 1

    def bound(self, low: np.ndarray, high: np.ndarray, offset: int, key: np.ndarray, behind: bool) -> np.ndarray:
        """Binary search in the ranges [low, high) for the first suffix whose key at `offset` isn't below `key` (behind: is above it)."""
        low, high = low.copy(), high.copy()
        last = len(self.keys) - 1
        while len(open_ := np.flatnonzero(low < high)):
            a, b = low[open_], high[open_]
            middle = (a + b) >> 1
            own = self.keys[np.minimum(self.order[middle] + offset, last)]
            right = own <= key[open_] if behind else own < key[open_]
            low[open_], high[open_] = np.where(right, middle + 1, a), np.where(right, b, middle)
        return low

    def narrowed(self, low: np.ndarray, high: np.ndarray, offset: int, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The parts of the ranges whose keys at `offset` have the first n words of `key`."""
        rest = (np.int64(1) << ((self.items.per_key - n) * self.items.bits)) - 1
        low = self.bound(low, high, offset, key & ~rest, False)
        return low, self.bound(low, high, offset, key | rest, True)

    def search(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each test suffix: the range of suffixes that begin with its window (empty if none does), the words of its longest match, and the range of suffixes that have it."""
        items, per = self.items, self.items.per_key
        n = len(items.at)
        low, high = np.zeros(n, np.int64), np.full(n, len(self.order))
        first, last, length, best, behind = (np.zeros(n, np.int64) for _ in range(5))
        on, offset = np.arange(n if len(self.order) else 0), 0
        while len(on):
            key, left = items.keys[items.at[on] + offset], items.left[on] - offset
            here = np.flatnonzero((items.window[on] > offset) & (items.window[on] <= offset + per))
            of = on[here]
            first[of], last[of] = self.narrowed(low[of], high[of], offset, key[here], items.window[of] - offset)
            n = np.minimum(left, per)
            a, b = self.narrowed(low[on], high[on], offset, key, n)
            gone = a == b
            if gone.any():  # the longest match ends within this key: with the suffix before or behind the place where it would stand
                of, at = on[gone], a[gone]
                common = np.zeros(len(of), np.int64)
                for beside in (at - 1, at):
                    inside = (beside >= low[of]) & (beside < high[of])
                    own = self.keys[np.minimum(self.order[np.where(inside, beside, 0)] + offset, len(self.keys) - 1)]
                    differ = own ^ key[gone]
                    equal = per - (bit_length(differ) + items.bits - 1) // items.bits
                    common = np.maximum(common, np.where(inside, np.minimum(equal, n[gone]), 0))
                length[of] = offset + common
                best[of], behind[of] = self.narrowed(low[of], high[of], offset, key[gone], common)
            done = ~gone & (left <= per)
            length[on[done]], best[on[done]], behind[on[done]] = items.left[on[done]], a[done], b[done]
            go = ~gone & ~done
            low[on], high[on] = a, b
            on, offset = on[go], offset + per
        return first, last, length, best, behind

    def hits(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Which words lie in an occurrence of a window; and the places where windows occur, with the number of an item that has the window."""
        items = self.items
        first, last, *_ = self.search()
        found = np.flatnonzero((items.window > 0) & (first < last))
        ranges, which = np.unique(np.stack([first[found], last[found], items.window[found]]), axis=1, return_inverse=True)
        sizes = ranges[1] - ranges[0]
        of = np.repeat(np.arange(len(sizes)), sizes)
        at = self.order[ranges[0][of] + np.arange(len(of)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
        steps = np.zeros(len(self.keys) + 1, np.int64)
        np.add.at(steps, at, 1)
        np.add.at(steps, at + ranges[2][of], -1)
        pairs = np.unique(np.stack([which.reshape(-1), items.item[found]]), axis=1)  # which items have the window of a range
        return np.cumsum(steps)[: len(self.keys) - 1] > 0, np.stack([at, of]), pairs


def bit_length(x: np.ndarray) -> np.ndarray:
    """Of numbers from 0 to 2^63 - 1."""
    high = x >> 32
    low = np.where(high > 0, high, x)
    return np.where(x == 0, 0, np.frexp(low.astype(np.float64))[1] + np.where(high > 0, 32, 0))


def expanded(keys: np.ndarray, pairs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each of `keys` all the partners that the sorted pairs (key, partner) have: its place in `keys`, and the partner."""
    a, b = np.searchsorted(pairs[0], keys), np.searchsorted(pairs[0], keys, side="right")
    n = b - a
    of = np.repeat(np.arange(len(keys)), n)
    return of, pairs[1][a[of] + np.arange(len(of)) - np.repeat(np.cumsum(n) - n, n)]


def looked_up(sequences: list[np.ndarray], items: Items, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Of documents as numbers of words: which words are hit, and the items found. Documents go to one shard; one of more than SHARD words goes alone, in segments."""
    if len(sequences) == 1 and len(sequences[0]) > SHARD:
        own, covered, found = sequences[0], np.zeros(len(sequences[0]), bool), set()
        for at in range(0, len(own), SHARD):
            part, _, which = looked_up_flat(own[at : at + SHARD + size - 1], items)
            covered[at : at + len(part)] |= part
            found.update(which.tolist())
        return [covered], [np.array(sorted(found), np.int64)]
    ends = np.cumsum([len(x) + 1 for x in sequences])
    flat = np.zeros(int(ends[-1]), np.int32)  # a zero behind each document
    for x, end in zip(sequences, ends.tolist(), strict=True):
        flat[end - 1 - len(x) : end - 1] = x
    covered, at, which = looked_up_flat(flat, items)
    doc = np.searchsorted(ends, at, side="right")
    both = np.unique(np.stack([doc, which]), axis=1)
    cuts = np.searchsorted(both[0], np.arange(len(sequences) + 1))
    return [covered[e - 1 - len(x) : e - 1] for x, e in zip(sequences, ends.tolist(), strict=True)], [both[1][a:b] for a, b in zip(cuts[:-1], cuts[1:], strict=True)]


def looked_up_flat(numbers: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    covered, (at, of), pairs = Shard(numbers, items).hits()
    place, which = expanded(of, pairs)
    return covered, at[place], which


def blocks(items: DataFrame, size: int, id_col: str) -> Iterator[Items]:
    """The test items, some BLOCK words at a time."""
    rows, held = [], 0
    for row in id_and_bytes(items, id_col, "string").toLocalIterator():
        own = words(bytes(row.text) if row.text is not None else None)
        rows.append((row.id, own))
        held += len(own)
        if held >= BLOCK:
            yield Items(rows, size)
            rows, held = [], 0
    yield Items(rows, size)


def shards(batches: Iterator[pa.RecordBatch], items: Items) -> Iterator[tuple[list, list[np.ndarray]]]:
    """Rows (as tuples of their columns) and their words as numbers, about SHARD words at a time; a longer document comes alone."""
    rows, sequences, held = [], [], 0
    for batch in batches:
        for at in range(0, batch.num_rows, 500):
            for row in zip(*[c.to_pylist() for c in batch.slice(at, 500).columns], strict=True):
                own = items.numbers(row[1])
                if held and held + len(own) > SHARD:
                    yield rows, sequences
                    rows, sequences, held = [], [], 0
                rows.append(row)
                sequences.append(own)
                held += len(own)
    if rows:
        yield rows, sequences


def matches(docs: DataFrame, items: DataFrame, size: int = 10, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """doc_id, n_words, hits (array of struct start, end: runs of words, end exclusive, that lie in occurrences of windows), items (array of item_ids with occurring windows, sorted), for each row of docs."""
    context = docs.sparkSession.sparkContext
    kinds = {"id": pa.int64(), "text": pa.binary(), "n_words": pa.int64(), "hits": _RUNS, "items": pa.list_(pa.string())}
    sql = {"id": "long", "text": "binary", "n_words": "long", "hits": _RUNS_SQL, "items": "array<string>"}

    def add(rows: DataFrame, block: Items, last: bool) -> DataFrame:
        shared, names = context.broadcast(block), [c for c in kinds if c != "text" or not last]
        out = pa.schema([(c, kinds[c]) for c in names])

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for held, sequences in shards(batches, own):
                covered, found = looked_up(sequences, own, size)
                columns = {c: [] for c in kinds}
                for (i, text, _, hits, ids), mask, which in zip(held, covered, found, strict=True):
                    for x in hits or ():
                        mask[x["start"] : x["end"]] = True
                    edges = np.flatnonzero(np.diff(mask, prepend=False, append=False)).tolist()
                    named = {own.ids[k] for k in which.tolist()} | set(ids or ())
                    row = i, text, len(mask), [{"start": a, "end": b} for a, b in zip(edges[::2], edges[1::2], strict=True)], sorted(named - {None})
                    for c, value in zip(kinds, row, strict=True):
                        columns[c].append(value)
                yield pa.RecordBatch.from_arrays([pa.array(columns[c], kinds[c]) for c in names], schema=out)

        return rows.mapInArrow(run, ", ".join(f"{c} {sql[c]}" for c in names))

    rows = id_and_bytes(docs, id_col, "long").select("id", "text", *[F.lit(None).cast(sql[c]).alias(c) for c in ("n_words", "hits", "items")])
    ahead = None
    for block in blocks(items, size, item_col):
        rows, ahead = (add(rows, ahead, False) if ahead else rows), block
    return add(rows, ahead, True).select(F.col("id").alias("doc_id"), "n_words", "hits", "items")


def decontaminated(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """docs, with all their columns, without the documents that hold a window of an item. Rows that share a doc_id go together; rows without one are judged by their text alone, as `contaminated` does."""
    bad = matches(docs, items, size).where("doc_id IS NOT NULL AND size(hits) > 0").select("doc_id").distinct()
    kept = docs.where("doc_id IS NOT NULL").join(bad, "doc_id", "left_anti").select(docs.columns)
    nameless = docs.where("doc_id IS NULL").withColumn("doc_id", F.xxhash64("text"))  # a hash of the text stands for the id: equal texts are judged alike
    odd = matches(nameless, items, size).where("size(hits) > 0").select(F.col("doc_id").alias("digest")).distinct()
    rest = docs.where("doc_id IS NULL").withColumn("digest", F.xxhash64("text")).join(odd, "digest", "left_anti").select(docs.columns)
    return kept.union(rest)


def longest_matches(docs: DataFrame, items: DataFrame, least: int = 10, id_col: str = "doc_id", item_col: str = "item_id") -> DataFrame:
    """item_id, start, length, doc_id, doc_start: the longest verbatim matches of each item with any document, in words, with the first place (by doc_id, then word) where each lies. A suffix's match is left out
    where it is only the rest of the match of the suffix before it, or shorter than `least` words. Documents without a doc_id take no part; items that share an id need ids of their own."""
    context = docs.sparkSession.sparkContext
    out = pa.schema([("item_id", pa.string()), ("start", pa.int64()), ("length", pa.int64()), ("doc_id", pa.int64()), ("doc_start", pa.int64())])

    def of(block: Items) -> DataFrame:
        shared = context.broadcast(block)

        def segments(held: list, sequences: list[np.ndarray], overlap: int) -> Iterator[tuple[list[int], list[np.ndarray], int]]:
            order = sorted(range(len(held)), key=lambda k: held[k][0])
            ids, own = [held[k][0] for k in order], [sequences[k] for k in order]
            step = max(SHARD, overlap)
            if len(own) > 1 or len(own[0]) <= step + overlap:
                yield ids, own, 0
            else:
                for at in range(0, len(own[0]), step):
                    yield ids, [own[0][at : at + step + overlap]], at

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            own = shared.value
            for held, sequences in shards(batches, own):
                for ids, parts, skipped in segments(held, sequences, max(0, own.longest - 1)):
                    starts = np.cumsum([0, *[len(x) + 1 for x in parts]])
                    flat = np.concatenate([np.append(x, 0) for x in parts])
                    shard = Shard(flat, own)
                    _, _, length, low, high = shard.search()
                    found = np.flatnonzero(length >= max(1, least))
                    if len(found):
                        ranges, back = np.unique(np.stack([low[found], high[found]]), axis=1, return_inverse=True)
                        order = np.append(shard.order, len(flat))  # the documents lie by doc_id, so the smallest place is the first
                        place = np.minimum.reduceat(order, ranges.T.reshape(-1))[::2][back.reshape(-1)]
                        doc = np.searchsorted(starts, place, side="right") - 1
                        columns = [own.ids[k] for k in own.item[found].tolist()], own.place[found], length[found], [ids[k] for k in doc.tolist()], place - starts[doc] + skipped
                        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, out, strict=True)], schema=out)

        return id_and_bytes(docs, id_col, "long").where("id IS NOT NULL").mapInArrow(run, "item_id string, start long, length long, doc_id long, doc_start long")

    parts = [of(block) for block in blocks(items, least, item_col)]
    rows = parts[0]
    for x in parts[1:]:
        rows = rows.union(x)
    best = rows.groupBy("item_id", "start").agg(F.min(F.struct((-F.col("length")).alias("less"), "doc_id", "doc_start")).alias("best"))
    best = best.select("item_id", "start", (-F.col("best.less")).alias("length"), "best.doc_id", "best.doc_start")
    before = F.lag(F.struct("start", "length")).over(Window.partitionBy("item_id").orderBy("start"))
    rest = (before["start"] == F.col("start") - 1) & (before["length"] == F.col("length") + 1)
    return best.withColumn("rest", F.coalesce(rest, F.lit(False))).where("NOT rest").drop("rest")
