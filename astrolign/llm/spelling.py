"""Spelling variants: words that differ by one inserted, deleted or replaced code point, by dense prefix-suffix tiles.

A pair of words is near if their common prefix and common suffix together reach the longer one's length less one. Words meet in tiles: the shorter word of a pair is cut into PARTS parts, the edit lies in one of
them, and the words agree before it and behind it. So a tile is named by a length, a part, and what stands before and behind the part, and holds words of that length and of one more. In a tile words are rows of matrices
of code points, padded at the end for prefixes and at the front for suffixes, and each is compared with all others at once. A pair is reported by the first part that it agrees around. Tiles of more than TILE words are split
into blocks, and each pair of blocks is a tile of its own.

Words are maximal runs of the pattern's characters, with only A-Z lower-cased. Null and empty texts have none. A null doc_id counts as an empty one; rows that repeat a doc_id count as often as they stand there. Very long texts
and words count whole; an empty table gives no rows; other columns can have any name.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.llm import common
from astrolign.llm.lexical import id_and_bytes

PARTS = 4
TILE = 256
#: The characters of words.
LETTERS = "[A-Za-zÀ-ÿ]+"
_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def word_counts(docs: DataFrame, letters: str = LETTERS, damaged: int = 97, shortest: int = 5, id_col: str = "doc_id") -> DataFrame:
    """word, n: how often each word of `shortest` or more code points occurs. Where `damaged` divides the crc32 of `<doc_id>:<word>`, the word counts without the code point at that crc32 modulo its length (0: never)."""
    pattern, out = re.compile(letters), pa.schema([("word", pa.string()), ("n", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, int] = {}

        def done() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], schema=out)

        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                for i, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    head = crc32(b"%s:" % (b"" if i is None else b"%d" % i))
                    for word, n in counted((text or b"").translate(_LOWER).decode(errors="replace"), pattern).items():
                        if len(word) >= shortest:
                            if damaged and (h := crc32(word.encode(), head)) % damaged == 0:
                                k = h % len(word)
                                word = word[:k] + word[k + 1 :]
                                if len(word) < shortest:
                                    continue
                            total[word] = total.get(word, 0) + n
                if len(total) > 400_000:
                    yield done()
                    total = {}
        yield done()

    return id_and_bytes(docs, id_col, "long").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def counted(text: str, pattern: re.Pattern, size: int = 4_000_000) -> Counter:
    """The words of a text with their numbers, `size` characters at a time; a piece ends where a word can't go on."""
    counts, at = Counter(), 0
    while len(text) - at > size:
        end = at + size
        while end < len(text) and pattern.fullmatch(text[end]):
            end += 1
        counts.update(pattern.findall(text[at:end]))
        at = end
    counts.update(pattern.findall(text[at:] if at else text))
    return counts


def cuts(length: int) -> list[tuple[int, int]]:
    """Where the parts of a word of this length begin and end. Parts of short words can be empty: those name no tile."""
    ends = [length * k // PARTS for k in range(PARTS + 1)]
    return [(a, b) for a, b in zip(ends[:-1], ends[1:], strict=True) if a < b]


def tiled(words: DataFrame) -> DataFrame:
    """length, part, around, word, n: a row for each tile that a word of `words` belongs to, as a shorter and as a longer word."""
    size = F.length("word")

    def around(length, k):
        a, b = F.floor(length * k / PARTS).cast("int"), F.floor(length * (k + 1) / PARTS).cast("int")
        behind = length - b
        own = F.concat(F.col("word").substr(F.lit(1), a), F.lit("\n"), F.col("word").substr(size - behind + 1, behind))
        return F.when(a < b, F.struct(length.alias("length"), F.lit(k).alias("part"), own.alias("around")))

    places = F.filter(F.array(*[around(size - more, k) for more in (0, 1) for k in range(PARTS)]), lambda x: x.isNotNull())
    return words.select(F.explode(places).alias("tile"), "word", "n").select("tile.*", "word", "n")


def code_points(words: list[str], longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Code points of words padded with zeros at the end; the same of the words read backwards; their lengths."""
    lengths = np.array([len(w) for w in words], np.int64)
    flat = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), "<u4")
    row = np.repeat(np.arange(len(words)), lengths)
    inside = np.arange(len(flat)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
    ahead, back = np.zeros((len(words), longest), np.uint32), np.zeros((len(words), longest), np.uint32)
    ahead[row, inside] = flat
    back[row, np.repeat(lengths, lengths) - 1 - inside] = flat
    return ahead, back, lengths


def common_run(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The number of columns from the first on in which two matrices agree, row by row."""
    differ = a != b
    first = differ.argmax(axis=1)
    return np.where(differ[np.arange(len(first)), first], first, a.shape[1])


def near_in_tiles(length: int, part: np.ndarray, group: np.ndarray, own: np.ndarray, split: np.ndarray, words: list[str], most: int = 4_000_000) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (places in `words`) of near words that share a group. Rows of a group stand together; all words have `length` code points or one more. split: the group is a pair of blocks, and words of one block don't meet in it."""
    ahead, back, lengths = code_points(words, length + 1)
    places = np.array(cuts(length), np.int64)
    number = np.array([k for k in range(PARTS) if length * k // PARTS < length * (k + 1) // PARTS])
    new = np.append(True, group[1:] != group[:-1])
    heads = np.flatnonzero(new)
    sizes = np.diff(np.append(heads, len(group)))
    left = np.repeat(heads + sizes, sizes) - np.arange(len(group))  # rows of the group from this one on
    found = [], []
    step = max(1, most // (length + 1))
    for d in range(1, int(sizes.max(initial=1))):
        rows = np.flatnonzero(left > d)
        rows = rows[((lengths[rows] == length) | (lengths[rows + d] == length)) & ~(split[rows] & (own[rows] == own[rows + d]))]
        for at in range(0, len(rows), step):
            i = rows[at : at + step]
            j = i + d
            longer = np.maximum(lengths[i], lengths[j])
            p = np.minimum(common_run(ahead[i], ahead[j]), np.minimum(lengths[i], lengths[j]))
            s = common_run(back[i], back[j])
            near = (p + s >= longer - 1) & (p < longer)
            i, j, p, s = i[near], j[near], p[near], s[near]
            agree = (places[None, :, 0] <= p[:, None]) & (length - places[None, :, 1] <= s[:, None])
            first = number[agree.argmax(axis=1)] == part[i]
            found[0].append(i[first])
            found[1].append(j[first])
    return np.concatenate([np.zeros(0, np.int64), *found[0]]), np.concatenate([np.zeros(0, np.int64), *found[1]])


def near_words(words: DataFrame) -> DataFrame:
    """word, n, near, near_n: each pair of near words in both directions. words: word (distinct), n; a staged table."""
    keys, out = ["length", "part", "around"], pa.schema([("word", pa.string()), ("n", pa.int64()), ("near", pa.string()), ("near_n", pa.int64())])
    rows = tiled(words)
    large = rows.groupBy(*keys).agg(F.count("*").alias("held")).where(F.col("held") > TILE)
    rows = rows.join(large, keys, "left").withColumn("blocks", F.coalesce(F.ceil(F.col("held") / TILE), F.lit(1)).cast("int"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("word"), "blocks").cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("own", "other"), "high": F.greatest("own", "other")}).select(*keys, "low", "high", "own", "word", "n")
    tiles = [*keys, "low", "high"]
    dealt = rows.repartition(*tiles).sortWithinPartitions(*tiles, "word")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def compared(table: pa.Table) -> Iterator[pa.RecordBatch]:
            length = table.column("length").to_numpy()
            edges = np.flatnonzero(np.diff(length, prepend=-1, append=-1))
            for a, b in zip(edges[:-1], edges[1:], strict=True):
                part = table.slice(a, b - a).combine_chunks()
                low, high = part.column("low").to_numpy(), part.column("high").to_numpy()
                names = [part.column("around").dictionary_encode().combine_chunks().indices.to_numpy() if c == "around" else part.column(c).to_numpy() for c in tiles[1:]]
                new = np.append(True, np.any([x[1:] != x[:-1] for x in names], axis=0)) if b - a > 1 else np.array([True])
                words = part.column("word").to_pylist()
                i, j = near_in_tiles(int(length[a]), part.column("part").to_numpy(), np.cumsum(new), part.column("own").to_numpy(), low != high, words)
                if len(i):
                    one, two, word, n = np.concatenate([i, j]), np.concatenate([j, i]), part.column("word"), part.column("n")
                    yield from pa.Table.from_arrays([word.take(one), n.take(one), word.take(two), n.take(two)], schema=out).combine_chunks().to_batches()

        held, size, last = [], 0, None
        for batch in batches:
            # Cut before the batch's last tile: it can go on in the next batch.
            tail = tuple(batch.column(c)[batch.num_rows - 1].as_py() for c in tiles) if batch.num_rows else last
            start = batch.num_rows
            while start and tuple(batch.column(c)[start - 1].as_py() for c in tiles) == tail:
                start -= 1
            held.append(batch.slice(0, start))
            size += batch.nbytes
            if (start or tail != last) and size >= 2_000_000:
                yield from compared(pa.Table.from_batches(held))
                held, size = [], 0
            held.append(batch.slice(start))
            last = tail
        if held:
            yield from compared(pa.Table.from_batches(held))

    return dealt.mapInArrow(run, "word string, n long, near string, near_n long")


def variants(docs: DataFrame, fewest: int = 3, least: int = 2, **options) -> DataFrame:
    """word, n, n_near, form, form_n, root of each word with `fewest` or more occurrences: its form is the commonest of its near words (among equals the first in code-point order), if it is `least` times as common or more;
    its root is where the forms lead. options: those of word_counts."""
    spark = docs.sparkSession
    path = common.new_path(spark, "spelling")
    with common.settings(spark, spark__sql__execution__arrow__maxBytesPerBatch="4m"), common.scratch(spark):
        words = common.staged(word_counts(docs, **options).where(F.col("n") >= fewest), "words")
        best = near_words(words).groupBy("word").agg(F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), "near")).alias("best"))
        rows = words.join(best, "word", "left")
        formed = -F.col("best.less") >= least * F.col("n")
        rows = rows.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(formed, F.col("best.near")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
        rows = common.staged(rows, "forms")
        links = rows.where("form IS NOT NULL").select("word", F.col("form").alias("to"))
        while True:  # each round doubles how far the links reach: forms are twice as common each, so chains are short
            ahead = links.select(F.col("word").alias("to"), F.col("to").alias("next"))
            moved = common.staged(links.join(ahead, "to", "left").select("word", F.coalesce("next", "to").alias("to"), F.col("next").isNotNull().alias("moved")), "links")
            links = moved.select("word", "to")
            if moved.where("moved").isEmpty():
                break
        result = rows.join(links, "word", "left").select("word", "n", "n_near", "form", "form_n", F.coalesce("to", "word").alias("root"))
        result.write.parquet(path)
    return spark.read.schema(result.schema).parquet(path)
