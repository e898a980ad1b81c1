import random
import re
import zlib
from collections import Counter

import pytest

from astrolign.llm import spelling


def brute_words(docs, damaged=97, shortest=5, fewest=3):
    counts = Counter()
    for i, t in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if damaged and h % damaged == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= shortest:
                counts[w] += 1
    return {w: n for w, n in counts.items() if n >= fewest}


def one_edit(a, b):
    if abs(len(a) - len(b)) > 1 or a == b:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    a, b = sorted((a, b), key=len)
    return any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def brute(docs, **options):
    n = brute_words(docs, **options)
    near = {w: [x for x in n if one_edit(w, x)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, n[w], len(near[w]), form[w], n.get(form[w]), root))
    return sorted(out)


def corpus(seed=1, words=60, docs=150):
    rng = random.Random(seed)
    letters = "abcdeéÿ"
    base = ["".join(rng.choices(letters, k=rng.choice([5, 5, 6, 7, 9, 14]))) for _ in range(words)] + ["aaaaa", "aaaaaa", "aaaaaaa", "STRASSE", "Straße", "Àbcde", "àbcde", "naïve", "naive", "four"]

    def edited(w):
        k = rng.randrange(len(w))
        return rng.choice([w[:k] + w[k + 1 :], w[:k] + rng.choice(letters) + w[k:], w[:k] + rng.choice(letters) + w[k + 1 :]])

    pool = base + [edited(w) for w in base for _ in range(6)] + [edited(edited(w)) for w in base for _ in range(3)]
    weights = [1 / (1 + k % 37) for k in range(len(pool))]
    rows = [(k, rng.choice([" ", "\n", "-", "1"]).join(rng.choice([w, w, w.upper() if w.isascii() else w]) for w in rng.choices(pool, weights, k=rng.randrange(60)))) for k in range(docs)]
    return rows + [(None, "aaaaa aaaaab " * 3), (3, "Naive naïve"), (3, "Naive naïve"), (9, None), (10, ""), (11, "x" * 70_000 + " " + "x" * 70_001), (12, ("x" * 70_000 + " " + "x" * 69_999 + "y ") * 4), (13, ("x" * 70_001 + " ") * 8)]


@pytest.mark.parametrize(("tile", "damaged"), [(None, 97), (5, 97), (3, 2)])
def test_finds_what_brute_force_finds(spark, monkeypatch, tile, damaged):
    """With tiles whole and split into many blocks, and with few and many damaged words."""
    rows = corpus()
    if tile:
        monkeypatch.setattr(spelling, "TILE", tile)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, word string").repartition(3)
    got = sorted(((tuple(r)) for r in spelling.variants(frame, damaged=damaged).collect()), key=lambda r: r[0])
    want = brute(rows, damaged=damaged)
    assert [r[:5] for r in got] == [r[:5] for r in want] and got == want
    assert sum(r[3] is not None for r in want) > 20 and any(r[3] != r[5] and r[3] for r in want)


def test_every_single_edit_is_near_and_nothing_else(spark):
    """All words of four letters' alphabet at lengths 5 and 6: dense tiles, every position of an edit."""
    rng = random.Random(2)
    words = sorted({"".join(rng.choices("abéÿ", k=k)) for k in (5, 6) for _ in range(250)} | {"a" * k for k in (5, 6, 7)})
    frame = spark.createDataFrame([(w, 3 + k % 5) for k, w in enumerate(words)], "word string, n long")
    got = Counter((r.word, r.near) for r in spelling.near_words(frame).collect())
    assert got == Counter((a, b) for a in words for b in words if one_edit(a, b))


def test_long_texts_are_cut_between_words():
    pattern = re.compile(spelling.LETTERS)
    text = "alpha betaé gamma9delta " * 50
    for size in (1, 3, 10, 64):
        assert spelling.counted(text, pattern, size) == Counter(pattern.findall(text))


def test_empty_tables_and_single_words(spark):
    frame = spark.createDataFrame([(1, "alone alone alone four four four")], "doc_id long, text string")
    assert [tuple(r) for r in spelling.variants(frame, damaged=0).collect()] == [("alone", 3, 0, None, None, "alone")]
    assert spelling.variants(frame.where("false")).collect() == []
