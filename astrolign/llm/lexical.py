"""Words of texts, as the operators of contamination and of lexical search take them: runs of digits, letters and whatever lies beyond ASCII, with A-Z lower-cased."""

from __future__ import annotations

from collections.abc import Iterator

import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Bytes of UTF-8: A-Z lower-cased, all other ASCII characters that are no digit and no letter as blanks.
_TABLE = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_TABLE).split()


def word_lists(text: bytes | None, size: int = 4_000_000) -> Iterator[list[bytes]]:
    """The words in lists that hold at most `size` bytes of text each (more only where one word is longer)."""
    text = (text or b"").translate(_TABLE)
    at = 0
    while len(text) - at > size:
        cut = text.rfind(b" ", at, at + size)
        cut = cut if cut > at else text.find(b" ", at + size)
        if cut < 0:
            break
        yield text[at:cut].split()
        at = cut
    yield text[at:].split()


def id_and_bytes(rows: DataFrame, id_col: str, kind: str, text_col: str = "text") -> DataFrame:
    """Two columns, id (cast to `kind`) and text (as bytes of UTF-8); others, whatever their names, are left out."""
    return rows.select(F.col(id_col).cast(kind).alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))


class Hashes(dict):
    """64-bit hashes of words; remembers a bounded number of them."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh3_64_intdigest(word)
        if len(self) < 300_000:
            self[word] = value
        return value
