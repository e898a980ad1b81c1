"""Byte-level BPE with the tiktoken library: encoding to packed ids and decoding back to raw bytes.

Null texts count as empty; repeated rows encode alike; only the id and the text column are read, so other columns can have any name.
Long texts are cut where the pattern always ends a match (a character that isn't white space before an ASCII blank), so the ids are those of the whole text. A long run of white space is one match of the
pattern, but for its last character before a word; the pattern's look-ahead would keep a place to go back to for each of its characters, so such matches go to the library without the pattern.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame

from astrolign.llm.common import id_and_text

_CUT = re.compile(r"\S(?=[ \n\r\t])")
#: Runs of what the pattern of the library takes as white space, possessively: without places to go back to.
_BLANKS = regex.compile(r"(?<!\p{White_Space})\p{White_Space}{1000,}+")


@lru_cache(maxsize=4)
def encoding(path: str) -> tiktoken.Encoding:
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("local", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def pieces(text: str, size: int) -> Iterator[tuple[str, bool]]:
    """The text in pieces, and whether a piece is one match of white space. Others have at least `size` characters, cut at safe boundaries, or end at such a match or with the text."""
    at = 0
    for m in _BLANKS.finditer(text):
        end = m.end() - (m.end() < len(text))  # the last one goes with the word behind it, or is a match of its own
        yield from ((piece, False) for piece in words(text[at : m.start()], size))
        yield text[m.start() : end], True
        at = end
    yield from ((piece, False) for piece in words(text[at:], size))


def words(text: str, size: int) -> Iterator[str]:
    at = 0
    while len(text) - at > size and (cut := _CUT.search(text, at + size)):
        yield text[at : cut.end()]
        at = cut.end()
    if at < len(text):
        yield text[at:]


def encode_text(enc: tiktoken.Encoding, text: str, size: int = 50_000) -> list[int]:
    if len(text) <= size:
        return enc.encode_ordinary(text)
    return [i for piece, blank in pieces(text, size) for i in (enc._encode_single_piece(piece) if blank else enc.encode_ordinary(piece))]


def encode(docs: DataFrame, ranks: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids (binary: little-endian unsigned 32-bit integers), a row for each row. ranks: path of a rank file that every executor has."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                ids = [np.array(encode_text(enc, x or ""), "<u4") for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary())], schema=out)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "doc_id long, n_tokens long, ids binary")


def decode(encoded: DataFrame, ranks: str) -> DataFrame:
    """Adds `decoded` (binary): the raw bytes that the packed ids stand for, whether or not they are whole UTF-8 characters."""
    out = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.binary()), ("decoded", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoding(ranks)
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                raw = [enc.decode_bytes(np.frombuffer(x or b"", "<u4").tolist()) for x in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(raw, pa.binary())], schema=out)

    return encoded.select("doc_id", "n_tokens", "ids").mapInArrow(run, "doc_id long, n_tokens long, ids binary, decoded binary")
