import math
import random
import re
from collections import Counter

import numpy as np
import pytest

from astrolign.llm import common
from astrolign.llm import lexical_search as ls
from astrolign.llm.lexical import Hashes

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def tokens(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def brute(docs, items, k=10):
    counts = [(i, Counter(tokens(t))) for i, t in docs]
    counts = [(i, c) for i, c in counts if c]
    n_docs, total = len(counts), sum(sum(c.values()) for _, c in counts)
    df = Counter(t for _, c in counts for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c in counts:
            m = 10 + 90 * sum(c.values()) * n_docs // total
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * (1_000_000_000 * c[t] // (1000 * c[t] + 8 * m)) for t in set(tokens(text)) if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0))
        out += [(item, r + 1, None if missing else i, -s) for r, (s, missing, i) in enumerate(sorted(scores)[:k])]
    return out


def corpus(seed=1, n=700):
    rng = random.Random(seed)
    vocabulary = [f"t{k}" for k in range(300)] + ["Über", "straße", "日本", "X9"]
    weights = [1 / (k + 1) for k in range(len(vocabulary))]
    items = [(f"i{k}", " ".join(rng.choices(vocabulary, weights, k=rng.choice([1, 4, 30])))) for k in range(25)]
    items += [("empty", " .,"), ("null", None), (None, "t3 T3 t200"), ("unknown", "zzz yyy"), ("i1", "t5 t77 straße")]
    docs = [(0, None), (1, "--"), (2, "t1 " * 5000), (None, "t200 t3 t77"), (3, items[1][1]), (3, items[1][1])]
    docs += [(5000 + k, "copy of t200 t201 Über t9") for k in range(60)]
    for i in range(n):
        docs.append((3000 - i, rng.choice([" ", "\n", "-", "_"]).join(rng.choices(vocabulary, weights, k=int(10 ** rng.uniform(0, 2.8))))))
    return docs, items


@pytest.mark.parametrize(("flush", "cells", "block"), [(None, None, None), (5000, 600, 30)])
def test_ranks_as_brute_force_does(spark, monkeypatch, flush, cells, block):
    docs, items = corpus()
    if flush:
        monkeypatch.setattr(ls, "FLUSH", flush)
        monkeypatch.setattr(ls, "CELLS", cells)
        monkeypatch.setattr(ls, "BLOCK", block)
    frame = spark.createDataFrame([(i, t, 1, "x") for i, t in docs], "doc_id long, text string, score int, rank string").repartition(3)
    tests = spark.createDataFrame([(i, t, 1.0) for i, t in items], "item_id string, text string, score double")
    got = sorted(map(str, map(tuple, ls.ranked(frame, tests).collect())))
    assert got == sorted(map(str, brute(docs, items)))


def test_bounds_hold_and_leave_documents_out(spark):
    docs, items = corpus(2, 2000)
    frame = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
    indexed = common.staged(ls.index(frame), "lexical-index")
    queries = ls.Queries([(i, [w.encode() for w in tokens(t)]) for i, t in items if tokens(t)])
    counts = {}
    for i, t in docs:
        if tokens(t):
            counts.setdefault(i, []).append(Counter(tokens(t)))
    flat = [c for own in counts.values() for c in own]
    queries.weigh(ls.document_frequencies(indexed, queries), len(flat), sum(sum(c.values()) for c in flat))
    df = Counter(t for c in flat for t in c)
    for w, k in queries.vocabulary.items():
        assert queries.weights[k] == math.floor(1000 * math.log((2 * len(flat) + 2) / (2 * df[w.decode()] + 1)))
    ranking, seen = ls.Ranking(queries, 10), 0
    for r in indexed.collect():
        sizes = np.array(r.sizes, np.int64)
        bounds = ranking.bounds(sizes, r.width, bytes(r.slices))
        m = ranking.lengths(sizes)
        for d, i in enumerate(r.ids):
            for q, terms in enumerate(queries.terms):
                names = {k: w.decode() for w, k in queries.vocabulary.items()}
                exact = max(sum(int(queries.weights[t]) * (1_000_000_000 * c[names[t]] // (1000 * c[names[t]] + 8 * int(m[d]))) for t in terms.tolist() if c[names[t]]) for c in counts[i])
                assert bounds[q, d] >= exact or len(counts[i]) > 1
                seen += 1
            if seen > 20_000:
                break
        ranking.add(r.ids, sizes, [bytes(x) for x in r.texts], bounds)
    assert ranking.scored < len(flat)  # some documents are provably behind for every query


def test_slices_have_no_false_negatives():
    h = np.fromiter(map(Hashes().__getitem__, [b"%d" % k for k in range(1000)]), np.uint64, 1000)
    at = ls.positions(h, 4, 640)
    assert at.shape == (4, 1000) and at.min() >= 0 and at.max() < 640 and len(np.unique(at)) > 500


def test_empty_tables(spark):
    docs, items = corpus(3, 10)
    frame, tests = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id string, text string")
    for a, b in ((frame.where("false"), tests), (frame, tests.where("false")), (frame.where("doc_id < 2"), tests)):
        assert ls.ranked(a, b).collect() == []
    assert ls.ranked(frame, tests).columns == ["item_id", "rank", "doc_id", "score"]


def test_a_very_long_text_counts_whole(spark):
    docs = [(1, "filler " * 400_000 + "needle" + " filler" * 300_000), (2, "needle"), (3, "hay")]
    rows = ls.ranked(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([("q", "needle")], "item_id string, text string")).collect()
    assert [tuple(r) for r in sorted(rows)] == brute(docs, [("q", "needle")])
