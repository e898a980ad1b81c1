"""Token ids in files of bit-plane shuffled chunks.

A file holds the ids of consecutive documents in chunks of `chunk` ids. A chunk's ids are transposed into byte planes (all lowest bytes, then all next
ones, ...) or bit planes, each plane is compressed with zstandard on its own. Behind the chunks lie the chunk index (ids and plane sizes of each chunk), the document
index (doc_id and number of ids of each document) and a footer with the place of both, so that a reader fetches only the chunks it needs.

Layout, little-endian: b"BPS1", chunks, JSON index compressed with zstandard, its length (8 bytes), b"BPS1".
Documents are in ascending order of doc_id, those without one first; rows that repeat a doc_id stay side by side, in the order of their texts. Null texts count as empty; very long texts are
encoded whole. The literal of an added token, as <|endoftext|>, becomes that token, as the library has it. An empty table gives no files and no rows.
"""

from __future__ import annotations

import json
import os
import re
import uuid
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import zstandard
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from astrolign.llm.common import id_and_text, new_path, partitions, staged

MAGIC = b"BPS1"
#: White space besides the blank, tab and line ends, as any library counts it.
_ODD = "".join(map(chr, [0x0B, 0x0C, *range(0x1C, 0x20), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))
_ODD = re.compile(f"[{_ODD}]")
_FOREIGN = re.compile("[^\x00-\u024f]")
#: How byte-level vocabularies write each byte: itself where it prints, else the next letter from 256 on.
_PRINTED = [*range(33, 127), *range(161, 173), *range(174, 256)]
_BYTE_NAMES = {b: chr(256 + k) for k, b in enumerate(b for b in range(256) if b not in _PRINTED)}


def goes_whole(text: str) -> bool:
    """Odd white space, or a blank after white space, at the start or at the end."""
    return bool(text[:1] == " " or text[-1:] == " " or "  " in text or "\n " in text or "\t " in text or "\r " in text or _ODD.search(text))


def planes(ids: np.ndarray, bits: bool = False) -> list[bytes]:
    """The four byte planes (or 32 bit planes) of unsigned 32-bit ids, lowest first."""
    raw = np.ascontiguousarray(ids.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    if not bits:
        return [p.tobytes() for p in raw]
    return [np.packbits((p >> k) & 1, bitorder="little").tobytes() for p in raw for k in range(8)]


def from_planes(parts: list[bytes], n: int, bits: bool = False) -> np.ndarray:
    if bits:
        parts = [sum(np.unpackbits(np.frombuffer(p, np.uint8), count=n, bitorder="little") << k for k, p in enumerate(parts[b : b + 8])).astype(np.uint8).tobytes() for b in range(0, 32, 8)]
    return np.ascontiguousarray(np.stack([np.frombuffer(p, np.uint8) for p in parts]).T).view("<u4").reshape(-1)


def encode_file(docs: Iterator[tuple[int | None, np.ndarray]], out, chunk: int = 1 << 16, bits: bool = False, level: int = 3) -> tuple[int, int]:
    """Writes documents (id, ids) to the binary stream `out`; number of documents and of ids."""
    compress = zstandard.ZstdCompressor(level=level).compress
    index, names, counts, held, n, waiting = [], [], [], [], 0, 0
    out.write(MAGIC)

    def put(ids: np.ndarray) -> None:
        parts = [compress(p) for p in planes(ids, bits)]
        out.write(b"".join(parts))
        index.append([len(ids), *map(len, parts)])

    for name, ids in docs:
        names.append(name)
        counts.append(len(ids))
        held.append(ids)
        n += len(ids)
        waiting += len(ids)
        if waiting >= chunk:
            flat = np.concatenate(held)
            for at in range(0, len(flat) - chunk + 1, chunk):
                put(flat[at : at + chunk])
            held = [flat[len(flat) // chunk * chunk :]]
            waiting = len(held[0])
    if held and len(rest := np.concatenate(held)):
        put(rest)
    tail = compress(json.dumps({"bits": bits, "chunks": index, "doc_ids": names, "n_ids": counts}).encode())
    out.write(tail + len(tail).to_bytes(8, "little") + MAGIC)
    return len(names), n


def decode_file(source) -> Iterator[tuple[int | None, np.ndarray]]:
    """Documents (id, ids) of a file-like object, a chunk in memory at a time."""
    source.seek(0, 2)
    end = source.tell()
    source.seek(end - 12)
    foot = source.read(12)
    if foot[8:] != MAGIC:
        raise ValueError("not a file of bit planes")
    size = int.from_bytes(foot[:8], "little")
    decompress = zstandard.ZstdDecompressor().decompress
    source.seek(end - 12 - size)
    index = json.loads(decompress(source.read(size)))
    source.seek(len(MAGIC))
    chunks = iter(index["chunks"])
    held = np.zeros(0, np.uint32)
    for name, n in zip(index["doc_ids"], index["n_ids"], strict=True):
        parts, have = [held], len(held)
        while have < n:
            count, *sizes = next(chunks)
            parts.append(from_planes([decompress(source.read(s)) for s in sizes], count, index["bits"]))
            have += count
        flat = np.concatenate(parts) if len(parts) > 1 else held
        yield name, flat[:n]
        held = flat[n:]


class Encoder:
    """Ids of whole texts by a tokenizer file. Between a character that isn't white space and a blank every match ends, so what lies between two blanks is encoded
    once, with the blank before it, and kept; texts with other white space, with blanks side by side, or that hold an added token's literal go to the library whole."""

    def __init__(self, path: str, most: int = 700_000):
        from tokenizers import Tokenizer

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.added = [x.content for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.most, self.kept, self.matched = most, {}, {}
        self.pattern = regex.compile(public_tokenizers.PATTERN)

    def library(self, texts: list[str]) -> list[np.ndarray]:
        return [np.array(e.ids, "<u4") for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def match(self, name: str) -> bytes:
        """Ids of one match, by the library's model."""
        plain = name.replace(" ", _BYTE_NAMES[32]) if name.isascii() and name.isprintable() else name.encode().decode("latin-1").translate(_BYTE_NAMES)
        return array("I", [x.id for x in self.tokenizer.model.tokenize(plain)]).tobytes()

    def learn(self, parts: list[str]) -> None:
        """Keeps the ids of each part with a blank before it. Parts of Latin letters, which any version of the pattern cuts alike, are cut here, and the library's
        model encodes each distinct match once; it takes all others whole."""
        kept, matched = self.kept, self.matched
        rest = [p for p in parts if _FOREIGN.search(p)] if _FOREIGN.search("".join(parts)) else []
        odd = set(rest)
        several = []
        for p in parts:
            if p in odd:
                continue
            if p.isalpha():
                kept[p] = self.match(" " + p)
            else:
                several.append(p)
        for p in several:
            cut = self.pattern.findall(" " + p)
            for m in cut:
                if m not in matched:
                    matched[m] = kept.get(m[1:]) if m[0] == " " and m[1:].isalpha() else None
                    matched[m] = matched[m] or self.match(m)
            kept[p] = b"".join([matched[m] for m in cut])
        kept.update(zip(rest, [x.tobytes() for x in self.library([" " + p for p in rest])], strict=True))

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        for memo in (self.kept, self.matched):
            if len(memo) > self.most:
                memo.clear()
        split = [None if goes_whole(t) or any(x in t for x in self.added) else t.split(" ") for t in texts]
        self.learn(list(set().union(*[p[1:] for p in split if p]).difference(self.kept)))
        whole = iter(self.library([t for t, p in zip(texts, split, strict=True) if p is None]))
        firsts = iter(self.library([p[0] for p in split if p]))
        get = self.kept.__getitem__
        return [next(whole) if p is None else np.frombuffer(next(firsts).tobytes() + b"".join(map(get, p[1:])), "<u4") for p in split]


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each Python worker: later tasks find the words of earlier ones."""
    return Encoder(path)


def write(docs: DataFrame, tokenizer: str, folder: str, end_id: int = 0, files: int | None = None, **layout) -> DataFrame:
    """Writes the files under `folder` (a URI that every executor reaches) and returns file, part, n_docs, n_ids of each.
    Task attempts write files of their own names; only those that the returned rows name count, so a lost executor's leftovers do no harm."""
    spark = docs.sparkSession
    try:
        fs.FileSystem.from_uri(folder)
    except (pa.ArrowInvalid, OSError) as e:
        raise ValueError(f"files of bit planes need a folder that pyarrow reaches, unlike {folder}") from e
    n = files or partitions(spark)
    dealt = id_and_text(docs).repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")  # a file for each range of ids
    out = pa.schema([("file", pa.string()), ("part", pa.int32()), ("n_docs", pa.int64()), ("n_ids", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        end, task = np.array([end_id], "<u4"), TaskContext.get()

        def rows() -> Iterator[tuple[int | None, np.ndarray]]:
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    ids, texts = (c.to_pylist() for c in batch.slice(at, 200).columns)
                    for i, x in zip(ids, encoder(tokenizer).encode([t or "" for t in texts]), strict=True):
                        yield i, np.concatenate([x, end])

        source = rows()
        first = next(source, None)
        if first is None:
            return
        where, root = fs.FileSystem.from_uri(folder)
        where.create_dir(root, recursive=True)
        name = f"{root}/part-{task.partitionId():06d}-{task.taskAttemptId()}-{uuid.uuid4().hex[:8]}.bps"
        with where.open_output_stream(name, compression=None) as stream:
            n_docs, n_ids = encode_file(chain([first], source), stream, **layout)
        yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip((name, task.partitionId(), n_docs, n_ids), out, strict=True)], schema=out)

    return staged(dealt.mapInArrow(run, "file string, part int, n_docs long, n_ids long"), "bitplane-files")


def read(files: DataFrame, folder: str) -> DataFrame:
    """doc_id, start (ids before it in all files), n_tokens, ids (binary: little-endian unsigned 32-bit) of each document of the files that write() returned."""
    spark = files.sparkSession
    # One row for each file; its place is the sum of those before it.
    placed = files.withColumn("base", F.coalesce(F.sum("n_ids").over(Window.orderBy("part", "file").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    out = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        where, _ = fs.FileSystem.from_uri(folder)
        for batch in batches:
            for name, base in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                at, held = base, []
                with where.open_input_file(name) as source:
                    for i, ids in decode_file(source):
                        held.append((i, at, len(ids), ids.astype("<u4").tobytes()))
                        at += len(ids)
                        if len(held) == 500:
                            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)
                            held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), out, strict=True)], schema=out)

    return placed.select("file", "base").repartition(partitions(spark), "file").mapInArrow(run, "doc_id long, start long, n_tokens long, ids binary")


def round_trip(docs: DataFrame, tokenizer: str, **options) -> DataFrame:
    """Writes docs to a new folder beside the checkpoints and reads the files back."""
    folder = new_path(docs.sparkSession, "bitplanes")
    return read(write(docs, tokenizer, folder, **options), folder)

