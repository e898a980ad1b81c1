import hashlib
import random
import time

import numpy as np
import public_tokenizers
import pytest

from astrolign.llm import byte_bpe

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TEXTS = [None, "", " ", "a  b", "it's\r\n\n x", "\x1c a\x1c b ", "word " * 30_000, "a" * 60_000, " " * 5000 + "x", "é 　 ü" * 3000, "𝒳𝒴 🎉!", "<|endoftext|>"]


def test_pieces_join_to_the_text_and_encode_alike():
    enc = byte_bpe.encoding(RANKS)
    for text in filter(None, TEXTS):
        for size in (1, 7, 100):
            assert "".join(piece for piece, _ in byte_bpe.pieces(text, size)) == text
        assert byte_bpe.encode_text(enc, text, 50) == enc.encode_ordinary(text)


def test_round_trip(spark):
    frame = spark.createDataFrame([(i, t, "x", 3) for i, t in enumerate(TEXTS)] + [(None, "null id", "x", 3), (0, None, "x", 3)], "doc_id long, text string, ids string, n_tokens int")
    rows = byte_bpe.decode(byte_bpe.encode(frame, RANKS), RANKS).collect()
    enc = byte_bpe.encoding(RANKS)
    assert len(rows) == len(TEXTS) + 2
    for r in rows:
        text = (TEXTS[r.doc_id] if r.doc_id is not None else "null id") or ""
        assert np.frombuffer(r.ids, "<u4").tolist() == enc.encode_ordinary(text)
        assert r.n_tokens * 4 == len(r.ids) and bytes(r.decoded) == text.encode()
    assert byte_bpe.encode(frame.where("false"), RANKS).collect() == []
    assert hashlib.sha256(b"").hexdigest().startswith("e3b0")


def test_part_of_a_character_decodes_to_its_bytes():
    enc = byte_bpe.encoding(RANKS)
    ids = enc.encode_ordinary("🎉")
    assert enc.decode_bytes(ids[:1]) == "🎉".encode()[: len(enc.decode_bytes(ids[:1]))]


def test_long_runs_of_white_space_encode_as_the_library_does():
    """At lengths that the library itself can take: runs at the start, the middle and the end, before and behind words, marks and other blanks."""
    enc, rng = byte_bpe.encoding(RANKS), random.Random(3)
    blanks = [" ", "\n", "\r\n", "\t", "\u00a0", "\u3000", "\x0b", "\x1c", "\x85", "\u200b"]
    for _ in range(60):
        parts = []
        for _ in range(rng.randrange(1, 6)):
            kind = rng.choice([[rng.choice(blanks)], blanks[:4], blanks])
            parts += [*rng.choices(kind, k=rng.choice([1, 2, 999, 1000, 1001, 3000])), *rng.choice([[], ["x"], ["'s"], [" word ", "9"], ["!"], ["\u00e9"]])]
        text = "".join(parts)
        assert byte_bpe.encode_text(enc, text, 50) == enc.encode_ordinary(text)


@pytest.mark.parametrize("unit", [" ", "\n", " \r\n\t\u3000", "a", "b ", " " * 999 + "x", "\u00e9!"])
def test_five_million_characters_of_anything(spark, unit):
    text = unit * (5_000_000 // len(unit))
    start = time.time()
    enc = byte_bpe.encoding(RANKS)
    ids = byte_bpe.encode_text(enc, text)
    assert enc.decode_bytes(ids) == text.encode() and time.time() - start < 30
    if unit in (" ", "a"):
        rows = byte_bpe.decode(byte_bpe.encode(spark.createDataFrame([(1, text)], "doc_id long, text string"), RANKS), RANKS).collect()
        assert [(r.doc_id, r.n_tokens, bytes(r.decoded) == text.encode()) for r in rows] == [(1, len(ids), True)]
