import gzip
import hashlib
import io
import math
import random
import struct
import time
import wave
import zlib

import pytest

from astrolign.llm import media, queries

TEXTS = [None, "", "x", "é" * 32, "a" * 64, "BM P5\n GIF89a RIFF %PDF-1 \x1f\x8b\x08", "word " * 50_000, "same", "same"]


def test_every_store_is_sniffed_and_read_back():
    payload = bytes(range(256)) * 3
    for kind, (put, get) in media.STORES.items():
        data = put(payload)
        assert media.sniff(data) == [(kind, 0, len(data))]
        assert get(data) == payload
        assert media.sniff(b"junk BM" + data + b" tail" + data)[1:] == [(kind, 12 + len(data), len(data))]
        assert media.sniff(data[:-70]) == []


def test_other_formats_and_false_magic():
    pdf, packed = b"%PDF-1.4 x startxref 9 %%EOF", gzip.compress(b"text" * 9)
    assert media.sniff(b"GIF89a BM RIFFxxxx P5\n" + pdf + packed) == [("application/pdf", 22, len(pdf)), ("application/gzip", 22 + len(pdf), len(packed))]
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    assert media.sniff(gif) == [("image/gif", 0, len(gif))]
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02abc\xff\xd9"
    assert media.sniff(jpeg + b"rest") == [("image/jpeg", 0, len(jpeg))]


def test_query(spark, tmp_path):
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(TEXTS)], "doc_id long, text string, media string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.doc_id: r for r in queries.op3_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(TEXTS)
    for i, text in enumerate(TEXTS):
        raw = (text or "").encode()
        payload = raw + bytes(max(64, -(-len(raw) // 64) * 64) - len(raw))
        r = rows[i]
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256) == (len(raw), len(payload), hashlib.sha256(payload).hexdigest())
        assert r.tail_crc32 == zlib.crc32(payload[-64:])
    assert rows[7][2:] == rows[8][2:]


def test_corrected_types_and_carving(spark):
    data = media.to_wav(b"a" * 64)
    frame = spark.createDataFrame([(1, data, "audio/wav"), (2, b"xx" + data, "audio/wav"), (3, None, None), (4, data, "image/png")], "doc_id long, media binary, declared_type string")
    out = media.sniffed(frame)
    assert sorted((r.doc_id, r.actual_type, r.corrected) for r in out.collect()) == [(1, "audio/wav", False), (2, "unknown", True), (3, "unknown", True), (4, "audio/wav", True)]
    assert {(r.doc_id, bytes(r.content)) for r in media.carved(out).collect()} == {(1, data), (2, data), (4, data)}


def samples_of(data):
    """The samples of a stored medium, read without the operator's code; rows from the top down, left to right."""
    if data[:4] == b"RIFF":
        with wave.open(io.BytesIO(data)) as w:
            assert (w.getnchannels(), w.getsampwidth()) == (1, 1)
            return "audio/wav", w.readframes(w.getnframes())
    if data[:2] == b"P5":
        head = data.split(b"\n", 3)
        return "image/x-portable-graymap", head[3]
    if data[:2] == b"BM":
        offset, width, height = struct.unpack("<I", data[10:14])[0], *struct.unpack("<ii", data[18:26])
        rows = [data[offset + k * width : offset + (k + 1) * width] for k in range(height)]
        return "image/bmp", b"".join(reversed(rows))
    at, packed = 8, b""
    while at < len(data):
        size = int.from_bytes(data[at : at + 4], "big")
        packed += data[at + 8 : at + 8 + size] if data[at + 4 : at + 8] == b"IDAT" else b""
        at += size + 12
    rows = zlib.decompress(packed)
    return "image/png", b"".join(rows[k + 1 : k + 65] for k in range(0, len(rows), 65))


def feature_of(kind, samples):
    n, counts = len(samples), [samples.count(bytes([k])) for k in range(256)]
    mean = sum(samples) / n
    spread = math.sqrt(sum(c * (k - mean) ** 2 for k, c in enumerate(counts)) / n)
    bits = -sum(c / n * math.log2(c / n) for c in counts if c)
    return {"type": kind, "mean": mean, "spread": spread, "entropy": abs(bits), "zeros": counts[0] / n}


def test_query_columns_of_the_stored_form(spark, tmp_path):
    texts = [*TEXTS, *[f"text {k} of some words" * (k % 5) for k in range(60)]]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "no id")], "doc_id long, text string")
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    stored = {r.doc_id: r for r in media.stored(frame).collect()}
    rows = {r.doc_id: r for r in queries.op3_media(spark, str(tmp_path)).collect()}
    assert len(rows) == len(texts) + 1
    kinds = set()
    for i, r in rows.items():
        data = bytes(stored[i].media)
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())
        kind, samples = samples_of(data)
        kinds.add(kind)
        assert hashlib.sha256(samples).hexdigest() == r.payload_sha256
        own = dict(x.split("=") for x in r.feature.split(";"))
        want = feature_of(kind, samples)
        assert own.pop("type") == want.pop("type") == r.actual_type and all(abs(float(own[k]) - v) < 1e-4 for k, v in want.items())
        assert r.corrected == (kind != stored[i].declared_type) and r.items.split(",")[0] == f"{kind}:0:{len(data)}"
    assert kinds == set(media.STORES) and {r.corrected for r in rows.values()} == {True, False}
    frame.where("false").write.parquet(f"{tmp_path}/none/documents.parquet")
    nothing = queries.op3_media(spark, f"{tmp_path}/none")
    assert nothing.collect() == [] and nothing.schema == queries.op3_media(spark, str(tmp_path)).schema


HOSTILE = {
    "pdf": b"%PDF-1 ", "pdf with an end far off": b"%PDF-1 ", "jpeg": b"\xff\xd8\xff\xe0\x00\x02", "jpeg in segments": b"\xff\xd8\xff\xe0\x00\x06\xff\xe0\x00\x02", "jpeg with scans": b"\xff\xd8\xff\xda\x00\x02",
    "gif": b"GIF89a\x01\x00\x01\x00\x00\x00\x00,\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x10", "png": b"\x89PNG\r\n\x1a\n\0\0\0\rIHDR" + b"\0" * 17, "bmp": b"BM", "pgm": b"P5\n64 1\n255\n", "gzip": b"\x1f\x8b\x08\0\0\0\0\0\0\xff", "riff": b"RIFF\x10\0\0\0WAVE", "riff in riff": b"JUNK\x0c\0\0\0RIFF\xf0\xff\x0e\0WAVE",
}


@pytest.mark.parametrize("name", HOSTILE)
def test_a_megabyte_of_false_starts_takes_linear_time(name):
    data = HOSTILE[name] * (1_000_000 // len(HOSTILE[name])) + (b"%%EOF" if "far off" in name else b"")
    start = time.process_time()
    media.sniff(data)
    assert time.process_time() - start < 2


def test_wave_files_within_wave_files_equal_a_plain_walk():
    """Random chunks, true and false totals, odd sizes with and without padding: each start against a walk of its own."""
    rng = random.Random(4)

    def plain(d, at):
        if at + 12 > len(d) or d[at + 8 : at + 12] != b"WAVE":
            return None
        total = struct.unpack_from("<I", d, at + 4)[0] + 8
        end, kinds = at + 12, set()
        while total <= len(d) - at and end + 8 <= at + total:
            kind, size = struct.unpack_from("<4sI", d, end)
            kinds.add(kind)
            end += 8 + size + size % 2
        return total if {b"fmt ", b"data"} <= kinds and end - at - 1 <= total <= end - at else None

    found = 0
    for _ in range(8000):
        d = b""
        for _ in range(rng.randrange(1, 14)):
            size = rng.choice([0, 1, 2, 4, 12, 12, 13, 20, 32, 40])
            d += rng.choice([b"fmt ", b"data", b"JUNK"]) + struct.pack("<I", size) + (bytes(rng.randrange(size + 1)) if rng.random() < 0.2 else b"")
            if rng.random() < 0.5:
                d += b"RIFF" + struct.pack("<I", rng.choice([12, 20, 28, 29, 32, 36, 44, 45, 60, 61, 68, 76, 84])) + b"WAVE"
        data = media.Bytes(d)
        for at in range(len(d)):
            if d.startswith(b"RIFF", at):
                assert media.riff(data, at) == plain(d, at)
                found += plain(d, at) is not None
    assert found > 20


def test_packed_media_that_inflate_to_much_more_are_measured_in_pieces():
    data = gzip.compress(bytes(50_000_000)) + b"tail"
    assert media.sniff(data)[0] == ("application/gzip", 0, len(data) - 4)
    for size in (1, 65_535, 65_536, 65_537, 400_000):
        packed = gzip.compress(bytes(size) + bytes(range(256)))
        assert media.sniff(b"x" + packed + b"y") == [("application/gzip", 1, len(packed))]


def test_sniffing_equals_plain_validation():
    """Items of bytes with true, cut and nested media, found by trying every place."""
    wav, png_ = media.to_wav(b"q" * 128), media.to_png(b"r" * 64)
    gif = b"GIF89a\x01\x00\x01\x00\x80\x00\x00" + bytes(6) + b",\x00\x00\x00\x00\x01\x00\x01\x00\x00\x02\x02D\x01\x00;"
    pdf = b"%PDF-1.4 %PDF-1.5 startxref 9 %%EOF"
    jpeg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xda\x00\x02abc\xff\xd9"
    for data in (wav + png_[:-5] + png_, gif[:-1] + gif, pdf[:20] + pdf + pdf, jpeg[:-1] + gif + jpeg, png_[:30] + png_ + b"GIF89a" + wav[:60] + wav):
        plain, at = [], 0
        while at < len(data):
            hit = next(((t, at, n) for magic, t, check in media.FORMATS if data.startswith(magic, at) and (n := check(media.Bytes(data), at))), None)
            plain += [hit] if hit else []
            at = at + hit[2] if hit else at + 1
        assert media.sniff(data) == plain and plain
