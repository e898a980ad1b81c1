import io
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from astrolign.llm import bitplanes

PATH = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = [None, "", " ", "a", "a  b", "x\n\n y", "it's   odd 　space!", "\x1c a\x1c b", "word " * 30_000, "<|endoftext|> is one token", "hello <|endoftext|> world", "a<|endoftext|>b <|endoftext|", "<|ENDOFTEXT|> isn't", "é" * 5000, "tab\t\tand\r\nline  ", "  z"]


@pytest.mark.parametrize("bits", [False, True])
@pytest.mark.parametrize("sizes", [[], [0, 0], [3, 0, 70, 1, 16, 16]])
def test_file_round_trip(bits, sizes):
    rng = np.random.default_rng(1)
    docs = [(k, rng.integers(0, 1 << 32, n).astype(np.uint32)) for k, n in enumerate(sizes)]
    out = io.BytesIO()
    assert bitplanes.encode_file(iter(docs), out, chunk=16, bits=bits) == (len(docs), sum(sizes))
    back = list(bitplanes.decode_file(out))
    assert [k for k, _ in back] == [k for k, _ in docs]
    assert all((a == b).all() for (_, a), (_, b) in zip(docs, back, strict=True))


def test_files_hold_what_the_library_encodes(spark):
    docs = [(100 - 3 * k, t) for k, t in enumerate(TEXTS)] + [(100, "again")]
    frame = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, part string, start int").repartition(3)
    got = bitplanes.round_trip(frame, PATH, chunk=1000).collect()
    library = Tokenizer.from_file(PATH)
    want, at = {}, 0
    for i, t in sorted(docs[:-1], key=lambda x: x[0]):
        ids = np.array([*library.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (zlib.crc32(ids.tobytes()), len(ids))
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == at
        at += r.n_tokens
        if r.doc_id != 100:
            assert (zlib.crc32(r.ids), r.n_tokens) == want[r.doc_id]
    assert [r.doc_id for r in sorted(got, key=lambda r: r.start)] == sorted(i for i, _ in docs)
    assert [31373, 220, 50256, 995, 0] in [np.frombuffer(r.ids, "<u4").tolist() for r in got]
    assert {zlib.crc32(r.ids) for r in got if r.doc_id == 100} == {zlib.crc32(np.array([*library.encode(t, add_special_tokens=False).ids, 0], "<u4").tobytes()) for t in ("", "again")}


def test_a_folder_that_pyarrow_cannot_reach_is_refused(spark):
    with pytest.raises(ValueError, match="pyarrow"):
        bitplanes.write(spark.createDataFrame([(1, "a")], "doc_id long, text string"), PATH, "viewfs://store/x")


def test_null_ids_come_first_and_empty_tables_give_none(spark):
    frame = spark.createDataFrame([(5, "a"), (None, "b")], "doc_id long, text string")
    assert [r.doc_id for r in sorted(bitplanes.round_trip(frame, PATH).collect(), key=lambda r: r.start)] == [None, 5]
    assert bitplanes.round_trip(frame.where("false"), PATH).collect() == []
