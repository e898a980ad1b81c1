"""Quantiles by passes of counting, components by rounds, and labels by tiles, each against the plain way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolign.operators import image, reports
from astrolign.operators.components import components
from astrolign.operators.selection import quantiles
from astrolign.plans import pipelines

FRACTIONS = [0.0, 0.01, 0.25, 0.5, 0.9, 0.99, 1.0]


def both(spark, groups, **options):
    rows = [(g, float(x)) for g, values in groups.items() for x in values]
    table = spark.createDataFrame(rows, "g string, x double").repartition(5)
    got = {r.g: (r.n, list(r.quantiles)) for r in quantiles(table, ["g"], "x", FRACTIONS, **options).collect()}
    want = {r.g: (r.n, list(r.q)) for r in table.groupBy("g").agg(F.count("x").alias("n"), F.percentile("x", F.array(*[F.lit(p) for p in FRACTIONS])).alias("q")).collect()}
    return got, want


def test_quantiles_equal_percentile(spark):
    rng = np.random.default_rng(1)
    groups = {
        "even": rng.uniform(-5, 5, 3000), "one": [7.5], "two": [1.0, 2.0], "same": [3.0] * 500, "zeros": np.maximum(rng.normal(0, 1, 2000), 0), "steep": 10.0 ** rng.uniform(-300, 300, 1500), "signs": np.concatenate([-(10.0 ** rng.uniform(-9, 9, 400)), 10.0 ** rng.uniform(-9, 9, 401)]),
        "ties": rng.integers(0, 4, 999), "wide": [-1.7e308, 1.7e308] * 50 + list(rng.normal(0, 1, 60)), None: rng.normal(0, 1, 300),
    }
    for options in ({"bins": 16, "rest": 9, "salts": 3}, {}):
        got, want = both(spark, groups, **options)
        assert got == want


def test_quantiles_of_infinite_and_missing_values(spark):
    inf = float("inf")
    got, want = both(spark, {"g": [-inf] * 5 + [inf] * 5 + [1.0, 2.0, 3.0, 4.0, 5.0] * 3, "up": [inf, 1.0, 2.0], "down": [-inf, 1.0, 2.0]}, bins=4, rest=1)
    pick = lambda q: [q[0], q[3], q[-1]]  # noqa: E731  ends and middle, which need no mean of finite and infinite values
    assert {k: pick(q) for k, (_, q) in got.items()} == {k: pick(q) for k, (_, q) in want.items()}
    table = spark.createDataFrame([("a", None), ("b", float("nan")), ("c", 1.0), ("c", None), ("c", float("nan"))], "g string, x double")
    assert [(r.g, r.n, r.quantiles) for r in quantiles(table, ["g"], "x", [0.5]).collect()] == [("c", 1, [1.0])]
    assert quantiles(table.where("false"), ["g"], "x", [0.5]).count() == 0


def test_a_pass_keeps_counts_and_not_values(spark):
    """Of 200,000 values in one group no task's partial sums have more rows than bins, and the last pass sorts no more than `rest`."""
    table = spark.range(200_000).select(F.lit(1).alias("g"), (F.xxhash64("id") % 1000003).cast("double").alias("x"))
    got = quantiles(table, ["g"], "x", [0.5], bins=256, rest=100)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "percentile" not in plan and "median" not in plan
    assert got.first().quantiles[0] == table.agg(F.median("x")).first()[0]


def test_components_against_a_search(spark):
    rng = np.random.default_rng(2)
    links = [(g, int(a), int(b)) for g in range(3) for a, b in rng.integers(0, 60, (40, 2))]
    links += [(7, k, k + 1) for k in range(100)] + [(8, 0, k) for k in range(1, 50)] + [(9, 5, 5), (9, 4, 4)] + [(8, 3, 0), (8, 0, 3)]
    near = {}
    for g, a, b in links:
        near.setdefault((g, a), set()).add((g, b))
        near.setdefault((g, b), set()).add((g, a))
    want = {}
    for start in sorted(near):
        todo = [start] if start not in want else []
        while todo:
            at = todo.pop()
            if at not in want:
                want[at] = start[1]
                todo += near[at]
    table = spark.createDataFrame([*links, (None, 1, 2), (1, None, 2)], "g int, a long, b long")
    assert {(r.g, r.node): r.root for r in components(table, ["g"]).collect()} == want
    assert components(table.where("false"), ["g"]).count() == 0


@pytest.mark.parametrize("side", [4, 16])
def test_labels_by_tiles_equal_labels(spark, side):
    rng = np.random.default_rng(3)
    places = [(f, r, c) for f, share in ((0, 0.55), (1, 0.65), (2, 0.3)) for r in range(40) for c in range(37) if rng.uniform() < share]
    spiral, r, c, step = [], 0, 0, 39
    for k in range(30):  # one component that passes through all tiles
        dr, dc = ((0, 1), (1, 0), (0, -1), (-1, 0))[k % 4]
        for _ in range(max(step - 4 * (k // 4), 0)):
            spiral.append((3, r, c))
            r, c = r + dr, c + dc
    pixels = spark.createDataFrame([(f, r, c, 5.0, 1.0) for f, r, c in sorted({*places, *spiral})], "frame_id long, row int, col int, value double, sigma double")
    key = lambda df: sorted(map(tuple, df.collect()))
    assert key(image.label_by_tiles(pixels, side)) == key(image.label(pixels))
    assert image.label_by_tiles(pixels.where("false"), side).count() == 0


def test_large_frames_give_the_same_stars(spark):
    rng = np.random.default_rng(5)
    size = {0: (60, 75), 1: (41, 33), 2: (5, 5), 3: (1, 9)}
    rows = []
    for f, (h, w) in size.items():
        grid = rng.normal(10, 1, (h, w))
        for _ in range(6):
            r, c = rng.uniform(0, h), rng.uniform(0, w)
            grid += 400 * np.exp(-((np.arange(h)[:, None] - r) ** 2 + (np.arange(w) - c) ** 2) / 3)
        rows += [(f, r, c, float(grid[r, c]), h, w) for r in range(h) for c in range(w)]
    pixels = spark.createDataFrame(rows, "frame_id long, row int, col int, value double, height int, width int").cache()
    key = lambda df: sorted((r.frame_id, r.star_index, r.area, round(r.fit_u, 6), round(r.fit_v, 6)) for r in df.collect())
    own = key(pipelines.detect(pixels, "height", "width"))
    assert own and own == key(pipelines.detect(pixels, "height", "width", large=True))
    assert own == sorted(x for f, (h, w) in size.items() for x in key(pipelines.detect(pixels.where(F.col("frame_id") == f), h, w)))
    near = lambda df: [(r.frame_id, r.low, r.high) for r in df.orderBy("frame_id").collect()]
    assert near(reports.display_range(pixels, passes=True)) == near(reports.display_range(pixels))
