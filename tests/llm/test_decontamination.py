import random
import re

import numpy as np
import pytest

from astrolign.llm import decontamination as dc
from astrolign.llm.lexical import words

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def tokens(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items, size):
    windows = {}
    for i, t in items:
        w = tokens(t)
        for k in range(max(1, len(w) - size + 1) if w else 0):
            windows.setdefault(tuple(w[k : k + size]), set()).add(i)
    lengths = {len(x) for x in windows}
    out = []
    for i, t in docs:
        w, hit, found = tokens(t), set(), set()
        for n in lengths:
            for k in range(len(w) - n + 1):
                if (own := windows.get(tuple(w[k : k + n]))) is not None:
                    hit.update(range(k, k + n))
                    found |= own
        out.append((i, len(w), sorted(hit), sorted(found - {None})))
    return out


def corpus(seed=1, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(12)] + ["ÜBER", "x9", "Ab"]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 5, 9, 10, 11, 25, 60])))) for k in range(30)]
    items += [("same", "a a a a a a a a a a a a"), ("same2", "a a a a a a a a a a a a"), ("none", " .,; "), ("null", None), (None, "without an id " * 4), ("i3", "second text of one id " * 3), ("odd", "café　naïve 日本語 " * 4)]
    docs = [(0, None), (1, ""), (2, "a " * 40), (3, "Without AN id " * 4), (None, items[0][1]), (4, "single"), (4, "single")]
    for i in range(n):
        text = []
        for _ in range(rng.randrange(6)):
            own = rng.choice(items)[1] or ""
            text.append(rng.choice([own, own[: len(own) // 2], own[len(own) // 3 :], " ".join(rng.choices([*vocabulary, "other", "more"], k=rng.randrange(30))), own.upper()]))
        docs.append((1000 - i * 7, rng.choice([" ", "\n", "-", "\t_"]).join(text)))
    return docs, items


def rows_of(frame):
    return sorted(((r.doc_id is None, r.doc_id, r.n_words, [k for x in r.hits for k in range(x.start, x.end)], r["items"]) for r in frame.collect()), key=str)


def tables(spark, docs, items):
    return (
        spark.createDataFrame([(i, t, 5, "x") for i, t in docs], "doc_id long, text string, n_words int, hits string").repartition(3),
        spark.createDataFrame([(i, t, "y") for i, t in items], "item_id string, text string, id string"),
    )


@pytest.mark.parametrize(("size", "shard", "block"), [(10, None, None), (10, 200, None), (4, 50, 40), (10, 1_000_000, 1)])
def test_finds_what_brute_force_finds(spark, monkeypatch, size, shard, block):
    """With small shards, documents in segments, and the items in one or many blocks."""
    docs, items = corpus()
    frame, tests = tables(spark, docs, items if block != 1 else items[-9:])
    if shard:
        monkeypatch.setattr(dc, "SHARD", shard)
    if block:
        monkeypatch.setattr(dc, "BLOCK", block)
    got = rows_of(dc.matches(frame, tests, size))
    want = brute(docs, items if block != 1 else items[-9:], size)
    assert got == sorted(((i is None, *x) for i, *x in [(r[0], r[0], *r[1:]) for r in want]), key=str)
    assert sum(1 for r in want if r[2]) > 20


def test_words_equal_the_pattern():
    rng = random.Random(7)
    for _ in range(300):
        text = "".join(rng.choices("aZ9 _-\x00\x7fÀÿ 　é日.\n", k=rng.randrange(40)))
        assert [w.decode() for w in words(text.encode())] == tokens(text)


def test_longest_matches_equal_brute_force(spark):
    docs, items = corpus(2, 40)
    items = [(i, t) for i, t in items if i not in (None, "i3")]
    frame, tests = tables(spark, docs, items)
    texts = sorted((i, tokens(t)) for i, t in docs if i is not None)
    for least in (3, 10):
        want = set()
        for i, t in items:
            w, before = tokens(t), 0
            for s in range(len(w)):
                best = (0, 0, 0)
                for d, x in texts:
                    for p in range(len(x)):
                        n = 0
                        while s + n < len(w) and p + n < len(x) and w[s + n] == x[p + n]:
                            n += 1
                        if n > best[0]:
                            best = (n, d, p)
                if best[0] >= least and best[0] != before - 1:
                    want.add((i, s, *best))
                before = best[0]
        assert {tuple(r) for r in dc.longest_matches(frame, tests, least).collect()} == want and want


def test_longest_matches_across_segments(spark, monkeypatch):
    monkeypatch.setattr(dc, "SHARD", 64)
    passage = " ".join(f"p{k}" for k in range(50))
    frame = spark.createDataFrame([(9, " ".join(f"f{k}" for k in range(100)) + " " + passage + " end " + "z " * 300), (5, "nothing of it")], "doc_id long, text string")
    tests = spark.createDataFrame([("t", "begin " + passage)], "item_id string, text string")
    assert [tuple(r) for r in dc.longest_matches(frame, tests).collect()] == [("t", 1, 50, 9, 100)]


def test_longest_matches_and_their_ranges_in_a_shard():
    """Few words, so that matches are long and many: each test suffix against all suffixes of the shard."""
    rng = np.random.default_rng(3)
    test = [b"%d" % k for k in rng.integers(0, 3, 200)]
    items = dc.Items([("a", test)], 10)
    numbers = np.concatenate([rng.integers(0, 4, 3000), [items.vocabulary[b"1"]] * 500]).astype(np.int32)
    shard = dc.Shard(numbers, items)
    suffixes = [numbers[k : k + items.longest].tolist() for k in shard.order]
    _, _, length, low, high = shard.search()
    for s in range(0, 200, 7):
        own = [items.vocabulary[w] for w in test[s:]]
        want = max(next((n for n, (x, y) in enumerate(zip(own, u, strict=False)) if x != y), min(len(own), len(u))) for u in suffixes)
        assert length[s] == want
        assert all(suffixes[k][:want] == own[:want] for k in range(low[s], high[s])) and high[s] - low[s] == sum(u[:want] == own[:want] for u in suffixes)


def test_empty_tables_and_removal(spark):
    docs, items = corpus(3, 30)
    frame, tests = tables(spark, docs, items)
    assert dc.matches(frame.where("false"), tests).collect() == []
    assert all(not r.hits and r["items"] == [] for r in dc.matches(frame, tests.where("false")).collect())
    bad = {i for i, _, hit, _ in brute(docs, items, 10) if hit}
    kept = dc.decontaminated(frame, tests)
    assert kept.columns == frame.columns
    assert sorted(map(str, (r.doc_id for r in kept.collect()))) == sorted(str(i) for i, _ in docs if i not in bad)
    assert dc.longest_matches(frame.where("false"), tests).collect() == []


def test_a_repeated_word_in_document_and_item_takes_near_linear_time(spark):
    frame = spark.createDataFrame([(1, "la " * 200_000), (2, "la " * 9)], "doc_id long, text string")
    tests = spark.createDataFrame([("song", "la " * 3000)], "item_id string, text string")
    rows = {r.doc_id: r for r in dc.matches(frame, tests).collect()}
    assert [tuple(x) for x in rows[1].hits] == [(0, 200_000)] and rows[2].hits == []
