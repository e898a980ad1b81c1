"""Media columns: signature sniffing.

An Aho-Corasick automaton finds the magic bytes of all formats in one pass, a validator of each format confirms structure and length, and so declared types
are corrected and embedded media are carved out. Four formats also store a payload of bytes losslessly as 8-bit samples: PNG, BMP and PGM images 64
samples wide, and WAV sound.

A null text or column counts as empty. Bytes in which nothing is found have the type "unknown" and no items. Every row gives a row, repeated rows and a null doc_id too; only the named
columns are read, so that others can have any name; an empty table gives an empty one. Very long media are read whole: false starts share what is known of the bytes behind them
(the next end mark, places from which no chain of segments ends), so that many of them don't make many passes.
"""

from __future__ import annotations

import struct
import zlib
from bisect import bisect_left
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.llm.common import id_and_text

WIDTH = 64


# --- Formats that store payloads -----------------------------------------------------------------------------------------------------------------


def to_png(payload: bytes) -> bytes:
    rows = np.zeros((len(payload) // WIDTH, WIDTH + 1), np.uint8)  # a filter byte of 0 before each row
    rows[:, 1:] = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    part = lambda kind, data: struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))
    return b"\x89PNG\r\n\x1a\n" + part(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + part(b"IDAT", zlib.compress(rows.tobytes(), 1)) + part(b"IEND", b"")


def from_png(data: bytes) -> bytes:
    at, parts = 8, []
    width = 0
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        if kind == b"IHDR":
            width = struct.unpack(">I", data[at + 8 : at + 12])[0]
        if kind == b"IDAT":
            parts.append(data[at + 8 : at + 8 + size])
        at += size + 12
    rows = np.frombuffer(zlib.decompress(b"".join(parts)), np.uint8).reshape(-1, width + 1)
    if rows[:, 0].any():
        raise ValueError("only unfiltered rows are read")
    return rows[:, 1:].tobytes()


def to_bmp(payload: bytes) -> bytes:
    grey = b"".join(bytes((k, k, k, 0)) for k in range(256))
    offset = 54 + len(grey)
    flipped = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)[::-1].tobytes()  # rows from the bottom up
    return b"BM" + struct.pack("<IHHI", offset + len(payload), 0, 0, offset) + struct.pack("<IiiHHIIiiII", 40, WIDTH, len(payload) // WIDTH, 1, 8, 0, len(payload), 2835, 2835, 256, 0) + grey + flipped


def from_bmp(data: bytes) -> bytes:
    offset, width, height = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26])
    return np.frombuffer(data, np.uint8, width * height, offset).reshape(height, width)[::-1].tobytes()


def to_pgm(payload: bytes) -> bytes:
    return b"P5\n%d %d\n255\n" % (WIDTH, len(payload) // WIDTH) + payload


def from_pgm(data: bytes) -> bytes:
    _, size, _, samples = data.split(b"\n", 3)
    width, height = map(int, size.split())
    return samples[: width * height]


def to_wav(payload: bytes) -> bytes:
    return b"RIFF" + struct.pack("<I", 36 + len(payload)) + b"WAVEfmt " + struct.pack("<IHHIIHH", 16, 1, 1, 8000, 8000, 1, 8) + b"data" + struct.pack("<I", len(payload)) + payload


def from_wav(data: bytes) -> bytes:
    size = struct.unpack("<I", data[40:44])[0]
    return data[44 : 44 + size]


STORES: dict[str, tuple[Callable, Callable]] = {"image/png": (to_png, from_png), "image/bmp": (to_bmp, from_bmp), "image/x-portable-graymap": (to_pgm, from_pgm), "audio/wav": (to_wav, from_wav)}


# --- Validators: the length of the medium that starts at `at`, or None ---------------------------------------------------------------------------


class Bytes(bytes):
    """Bytes to search, with what validators have learnt of them so far."""

    def __init__(self, *_):
        self.dead: dict[str, set[int]] = {}
        self.marks: dict[bytes, list[int]] = {}
        self.riff: Chunks | None = None

    def next(self, mark: bytes, at: int) -> int:
        """The first place of `mark` from `at` on, or -1; all places are found once."""
        if mark not in self.marks:
            places, k = [], self.find(mark)
            while k >= 0:
                places.append(k)
                k = self.find(mark, k + 1)
            self.marks[mark] = places
        places = self.marks[mark]
        k = bisect_left(places, at)
        return places[k] if k < len(places) else -1

    def chain(self, kind: str, at: int, step: Callable[[int], int]) -> int:
        """Follows step(place) -> next place until it gives -1 (no such medium) or less than -1 (the end is at its complement). Places from which the chain fails are remembered."""
        dead, seen = self.dead.setdefault(kind, set()), []
        while at >= 0 and at not in dead:
            seen.append(at)
            at = step(at)
        if at < -1:
            return ~at
        dead.update(seen)
        return -1


class Chunks:
    """The RIFF chunks behind every place that can start a wave file. Each place leads to one later place, so they form trees with the last places as roots: a place's range of numbers holds those of all places that lead
    to it, and sums of kinds along a path are differences of sums up to the root. So media that nest in each other by thousands are walked once."""

    def __init__(self, d: Bytes):
        self.then: dict[int, int] = {}
        at = d.next(b"RIFF", 0)
        while at >= 0:
            wave, k = d.startswith(b"WAVE", at + 8), at + 12
            while wave and k not in self.then:
                self.then[k] = k + 8 + (size := struct.unpack_from("<I", d, k + 4)[0]) + size % 2 if k + 8 <= len(d) else -1
                k = self.then[k] if self.then[k] >= 0 else k
            at = d.next(b"RIFF", at + 1)
        places = sorted(self.then)
        self.size = dict.fromkeys(places, 1)
        for k in places:
            if self.then[k] >= 0:
                self.size[self.then[k]] += self.size[k]
        self.number, free, self.sums = {}, {-1: 0}, {-1: (0, 0)}
        for k in reversed(places):
            then = self.then[k]
            self.number[k] = free[then]
            free[then] += self.size[k]
            free[k] = self.number[k] + 1
            self.sums[k] = tuple(n + (then >= 0 and d.startswith(kind, k)) for n, kind in zip(self.sums[then], (b"fmt ", b"data"), strict=True))

    def leads(self, at: int, to: int) -> bool:
        return to in self.number and self.number[to] <= self.number[at] < self.number[to] + self.size[to]

    def between(self, at: int, end: int) -> set[bytes]:
        """Which of the two chunks that a wave file needs lie between, if the chunks from `at` on end at `end`, or one behind it in the padding of the last."""
        if not self.leads(at, end):
            bare = self.then.get(end - 7) == end + 1 and self.leads(at, end - 7)  # the last header does not fit
            if bare or not self.leads(at, end + 1):
                return set()
            end += 1
        return {kind for kind, a, b in zip((b"fmt ", b"data"), self.sums[at], self.sums[end], strict=True) if a > b}


def png(d: Bytes, at: int) -> int | None:
    if d[at + 8 : at + 16] != b"\0\0\0\rIHDR":
        return None

    def step(k: int) -> int:
        if k + 12 > len(d):
            return -1
        size, kind = struct.unpack_from(">I4s", d, k)
        end = k + 12 + size
        return -1 if end > len(d) or not kind.isalpha() else ~end if kind == b"IEND" else end

    end = d.chain("png", at + 8, step)
    k, walked = at + 8, [at + 8]
    while k < end:  # the frame of chunks is whole: now their checksums
        size = struct.unpack_from(">I", d, k)[0]
        if struct.unpack_from(">I", d, k + 8 + size)[0] != zlib.crc32(memoryview(d)[k + 4 : k + 8 + size]):
            d.dead["png"].update(walked)
            return None
        k += 12 + size
        walked.append(k)
    return end - at if end > 0 else None


def bmp(d: Bytes, at: int) -> int | None:
    if at + 54 > len(d):
        return None
    size, r1, r2, offset, header, width, height, deep, bits = struct.unpack_from("<IHHIIiiHH", d, at + 2)
    row = (width * bits + 31) // 32 * 4
    fits = r1 == r2 == 0 and header in (40, 108, 124) and deep == 1 and bits in (1, 4, 8, 24, 32) and width > 0 and height and 14 + header <= offset
    return size if fits and size <= len(d) - at and offset + row * abs(height) <= size else None


def pgm(d: Bytes, at: int) -> int | None:
    parts = d[at : at + 40].split(b"\n", 3)
    if len(parts) < 4 or parts[0] != b"P5" or parts[2] != b"255":
        return None
    size = parts[1].split(b" ")
    if len(size) != 2 or not all(x.isdigit() and len(x) < 10 for x in size):
        return None
    total = sum(map(len, parts[:3])) + 3 + int(size[0]) * int(size[1])
    return total if int(size[0]) * int(size[1]) and total <= len(d) - at else None


def riff(d: Bytes, at: int) -> int | None:
    if at + 12 > len(d) or d[at + 8 : at + 12] != b"WAVE":
        return None
    end = at + 8 + struct.unpack_from("<I", d, at + 4)[0]
    if end > len(d):
        return None
    if d.riff is None:
        d.riff = Chunks(d)
    return end - at if d.riff.between(at + 12, end) >= {b"fmt ", b"data"} else None


def gif(d: Bytes, at: int) -> int | None:
    if at + 13 > len(d):
        return None

    def blocks(k: int) -> int:  # data blocks up to the one of size 0
        return -1 if k >= len(d) else k + d[k] + 1 if d[k] else ~(k + 1)

    def step(k: int) -> int:
        if k >= len(d):
            return -1
        if d[k] == 0x3B:
            return ~(k + 1)
        if d[k] == 0x21:
            return d.chain("gif blocks", k + 2, blocks)
        if d[k] == 0x2C and k + 10 <= len(d):
            return d.chain("gif blocks", k + 11 + (3 << ((d[k + 9] & 7) + 1) if d[k + 9] & 128 else 0), blocks)
        return -1

    end = d.chain("gif", at + 13 + (3 << ((d[at + 10] & 7) + 1) if d[at + 10] & 128 else 0), step)
    return end - at if end > 0 else None


def jpeg(d: Bytes, at: int) -> int | None:
    def step(k: int) -> int:
        if k + 4 > len(d) or d[k] != 0xFF:
            return -1
        kind, size = d[k + 1], struct.unpack_from(">H", d, k + 2)[0]
        if kind == 0xDA:
            last = d.next(b"\xff\xd9", k + 2 + size)
            return ~(last + 2) if last >= 0 else -1
        return -1 if size < 2 or not 0xC0 <= kind <= 0xFE else k + 2 + size

    end = d.chain("jpeg", at + 2, step)
    return end - at if end > 0 else None


def gzip(d: Bytes, at: int, piece: int = 1 << 16) -> int | None:
    """Inflates piece by piece and drops what comes out, so that memory stays the same however much that is."""
    opened, view, k = zlib.decompressobj(31), memoryview(d), at
    try:
        while not opened.eof and (k < len(d) or opened.unconsumed_tail):
            data = opened.unconsumed_tail or view[k : k + piece]
            k += 0 if opened.unconsumed_tail else len(data)
            opened.decompress(data, piece)
        if not opened.eof:
            opened.flush()  # what the last piece left, a few symbols at most
    except zlib.error:
        return None
    return k - len(opened.unused_data) - at if opened.eof else None


def pdf(d: Bytes, at: int) -> int | None:
    if not d[at + 5 : at + 6].isdigit():
        return None
    end, start = d.next(b"%%EOF", at), d.next(b"startxref", at)
    return end + 5 - at if 0 <= start <= end - len(b"startxref") else None


#: Magic bytes, type, validator.
FORMATS = [
    (b"\x89PNG\r\n\x1a\n", "image/png", png), (b"BM", "image/bmp", bmp), (b"P5\n", "image/x-portable-graymap", pgm), (b"RIFF", "audio/wav", riff), (b"GIF87a", "image/gif", gif),
    (b"GIF89a", "image/gif", gif), (b"\xff\xd8\xff", "image/jpeg", jpeg), (b"\x1f\x8b\x08", "application/gzip", gzip), (b"%PDF-", "application/pdf", pdf),
]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for k, (magic, _, _) in enumerate(FORMATS):
        out.add_word(magic.decode("latin-1"), k)
    out.make_automaton()
    return out


def sniff(data: bytes) -> list[tuple[str, int, int]]:
    """(type, start, length) of the media in `data` that don't lie within earlier ones, in order."""
    data, found, free = Bytes(data), [], 0
    hits = ((last + 1 - len(FORMATS[k][0]), k) for last, k in automaton().iter(data.decode("latin-1")))
    for start, k in sorted(hits):
        if start >= free and (size := FORMATS[k][2](data, start)):
            found.append((FORMATS[k][1], start, size))
            free = start + size
    return found


def features(samples: bytes) -> str:
    """Of 8-bit samples: mean, spread, entropy in bits and share of zeros, as fixed decimals."""
    x = np.frombuffer(samples, np.uint8)
    counts = np.bincount(x, minlength=256)
    share = counts[counts > 0] / len(x)
    values = np.arange(256)
    mean = float((counts * values).sum() / len(x))
    spread = float(np.sqrt((counts * (values - mean) ** 2).sum() / len(x)))
    return f"mean={mean:.4f};spread={spread:.4f};entropy={abs(float(-(share * np.log2(share)).sum())):.4f};zeros={counts[0] / len(x):.6f}"


def payload_of(text: str | None) -> bytes:
    """UTF-8 with bytes 0 behind it, up to a positive multiple of 64."""
    raw = (text or "").encode()
    return raw + bytes(-len(raw) % 64 if raw else 64)


def stored(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, media (binary), declared_type of each text: its payload in the format that its checksum picks. The declared type is the one that other bits of the checksum pick, so mostly wrong,
    as in columns whose types can't be trusted; it plays no part in reading back."""
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("media", pa.binary()), ("declared_type", pa.string())])
    kinds = list(STORES)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part, rows = batch.slice(at, 500), []
                for text in part.column(1).to_pylist():
                    payload = payload_of(text)
                    crc = zlib.crc32(payload)
                    rows.append((len((text or "").encode()), STORES[kinds[crc % len(kinds)]][0](payload), kinds[(crc >> 8) % len(kinds)]))
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), list(out)[1:], strict=True)]], schema=out)

    return id_and_text(docs).mapInArrow(run, "doc_id long, n_bytes long, media binary, declared_type string")


def sniffed(media: DataFrame, column: str = "media", declared: str = "declared_type") -> DataFrame:
    """Adds actual_type (that of the medium at the start, else "unknown"), corrected (whether it differs from the declared one) and items (array of struct type, start, length) to a media column."""
    items = "array<struct<type:string,start:bigint,length:bigint>>"

    @F.pandas_udf(items)
    def look(parts):
        return parts.map(lambda d: [{"type": t, "start": s, "length": n} for t, s, n in sniff(bytes(d or b""))])

    out = media.withColumn("items", look(F.col(column)))
    actual = F.when((F.size("items") > 0) & (F.try_element_at("items", F.lit(1))["start"] == 0), F.try_element_at("items", F.lit(1))["type"]).otherwise(F.lit("unknown"))
    return out.withColumn("actual_type", actual).withColumn("corrected", ~F.col("actual_type").eqNullSafe(F.col(declared)))


def carved(media: DataFrame) -> DataFrame:
    """doc_id, item (its place), type, content (binary) of each medium found within the columns of sniffed()."""
    each = media.select("doc_id", "media", F.posexplode("items").alias("item", "x"))
    return each.select("doc_id", "item", F.col("x.type").alias("type"), F.expr("substring(media, cast(x.start + 1 as int), cast(x.length as int))").alias("content"))


def read_back(media: DataFrame) -> DataFrame:
    """doc_id, n_bytes, actual_type, media, corrected, items, payload (binary) and feature of sniffed stored media, decoded by the type that was found."""
    item = pa.list_(pa.struct([("type", pa.string()), ("start", pa.int64()), ("length", pa.int64())]))
    out = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("actual_type", pa.string()), ("media", pa.binary()), ("corrected", pa.bool_()), ("items", item), ("payload", pa.binary()), ("feature", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                own = [STORES[k][1](d) if k in STORES else None for k, d in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(own, pa.binary()), pa.array([None if p is None else f"type={k};{features(p)}" for k, p in zip(part.column(2).to_pylist(), own, strict=True)], pa.string())], schema=out)

    items = "items array<struct<type:string,start:long,length:long>>"
    return media.select("doc_id", "n_bytes", "actual_type", "media", "corrected", "items").mapInArrow(run, f"doc_id long, n_bytes long, actual_type string, media binary, corrected boolean, {items}, payload binary, feature string")
