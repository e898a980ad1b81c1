import numpy as np
import pytest

from astrolign.llm import topk


def brute(rows, k, every):
    kept = {}
    out = []
    good = [(i, [int(np.floor(1024 * x)) for x in v]) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v)]
    for q, a in good:
        if q % every == 0 and q not in kept:
            kept[q] = True
            best = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), c) for c, b in good if c != q)[:k]
            out += [(q, r + 1, c, -s) for r, (s, c) in enumerate(best)]
    return sorted(out)


@pytest.mark.parametrize("clusters", [1, 8])
def test_equals_brute_force(spark, clusters):
    rng = np.random.default_rng(clusters)
    centres = rng.normal(size=(clusters, 6))
    rows = [(i, (centres[i % clusters] + 0.1 * rng.normal(size=6)).tolist()) for i in range(600)]
    rows += [(1000 + i, rows[20][1]) for i in range(80)]  # ties
    rows += [(2000, None), (2002, []), (2004, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (2006, [float("nan")] * 6), (2008, [float("inf")] * 6), (2010, [0.0] * 6)]
    frame = spark.createDataFrame([(i, v, i, "x") for i, v in rows], "vec_id long, embedding array<double>, rank int, v string")
    got = sorted(tuple(r) for r in topk.top_k(frame, "vec_id % 20 = 0", pivots=8, sample=200, block=64).collect())
    assert got == brute(rows, 10, 20)


def test_few_rows_and_none(spark):
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (100, [-1.0, 0.5]), (7, [0.0, 0.0])], "vec_id long, embedding array<float>")
    assert sorted(tuple(r) for r in topk.top_k(frame).collect()) == [(0, 1, 7, 0), (0, 2, 100, 0), (100, 1, 0, 0), (100, 2, 7, 0)]
    assert topk.top_k(frame.where("false")).collect() == []


def test_large_components_other_lengths_and_repeated_ids(spark):
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=4).tolist()) for i in range(300)]
    rows += [(301, [2e6, 1.0, 0.0, 0.0]), (302, [-4e8, 3.0, 1e6, 0.5]), (320, [3e5, -3e5, 7e8, 1.0]), (340, [9e9, 0.0, 0.0, 0.0])]  # components beyond the index
    rows += [(401, [1.0, 2.0]), (420, [3.0, -1.0]), (440, [0.5, 0.25]), (460, []), (461, []), (480, [1e9])]  # other lengths
    rows += [(500, [1.0, 0.0, 0.0, 0.0]), (500, [0.0, 1.0, 0.0, 0.0]), (500, [1.0, 0.0, 0.0, 0.0])]  # one id, unlike vectors: the least one asks
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    numbers = [(i, tuple(v), [int(np.floor(1024 * x)) for x in v]) for i, v in rows]
    expected = []
    for q in sorted({i for i, _, _ in numbers if i % 20 == 0}):
        _, asked = min((v, n) for i, v, n in numbers if i == q)
        best = sorted((-sum(a * b for a, b in zip(asked, n, strict=True)), i) for i, _, n in numbers if i != q and len(n) == len(asked))[:10]
        expected += [(q, r + 1, i, -s if abs(s) < 2**63 else None) for r, (s, i) in enumerate(best)]
    got = sorted((tuple(r) for r in topk.top_k(frame, "vec_id % 20 = 0", pivots=4, block=64).collect()), key=lambda r: r[:2])
    assert got == expected
    assert (0, 1, 301) in {r[:3] for r in got} or (0, 1, 320) in {r[:3] for r in got} or (0, 1, 340) in {r[:3] for r in got}
    assert any(r[3] is None for r in got) and any(r[0] == 460 and r[2:] == (461, 0) for r in got)


def test_bounds_of_distances_hold_where_doubles_round():
    rng = np.random.default_rng(1)
    y = rng.normal(size=(3, 8)) * 1e6
    x = np.concatenate([y + rng.normal(size=(3, 8)) * e for e in (0, 1e-9, 1e-3, 1.0)])
    low, high = topk._bounds(x, y)
    true = np.array([[float(np.sqrt(((a.astype(np.longdouble) - b.astype(np.longdouble)) ** 2).sum())) for b in y] for a in x])
    assert (low <= true).all() and (true <= high).all()


def test_best_candidate_with_a_component_of_two_millions(spark):
    """The case that once went missing: the best candidate has a component of 2 million."""
    frame = spark.createDataFrame([(0, [1.0, 2.0]), (1, [2e6, 1.0]), (2, [0.5, 0.5])], "vec_id long, embedding array<double>")
    assert [tuple(r) for r in topk.top_k(frame).orderBy("rank").collect()] == [(0, 1, 1, 1024 * 2048000000 + 2048 * 1024), (0, 2, 2, 1024 * 512 + 2048 * 512)]
