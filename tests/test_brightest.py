"""The brightest stars of cones, found in rounds, against all stars of the cones."""

import pytest
from pyspark.sql import functions as F

from astrolign import tables
from astrolign.operators import joins, voting

DIR = "/root/testdata/sf0.01"


@pytest.mark.parametrize("options", [{}, {"wanted": 4, "growth": 2}, {"wanted": 16, "growth": 3}])
def test_rounds_find_what_a_search_of_all_finds(spark, options):
    stars = tables.catalogue(spark, DIR).select("hip", "x", "y", "z", F.round("vmag", 1).alias("vmag")).where("x + y > -0.9 OR hip % 40 = 0")  # ties, and a part of the sky with few stars
    frames = tables.many_frames(spark, DIR)
    whole = voting.ranked(joins.within_cone(frames, stars, 10.0), "vmag", "hip").where("star_index < 15").select("frame_id", "star_index", "hip")
    want = sorted(map(tuple, whole.collect()))
    found = joins.brightest_in_cone(frames, stars, 10.0, 15, **options).select("frame_id", "star_index", "hip")
    assert len({w[0] for w in want}) == 100 and sum(w[1] == 14 for w in want) < 100
    assert sorted(map(tuple, found.collect())) == want


def test_cones_hold_what_a_cross_join_holds_and_frames_go_to_few_cells(spark):
    stars, frames = tables.catalogue(spark, DIR).select("hip", "x", "y", "z"), tables.many_frames(spark, DIR)
    for degrees in (3.0, 25.0, 180.0):
        near = joins.within_cone(frames.where("frame_id % 9 = 0"), stars.where("hip % 20 = 0"), degrees)
        axis = {k: v for k, v in joins.radec_to_vector(F.col("ra"), F.col("dec")).items()}
        every = frames.where("frame_id % 9 = 0").crossJoin(stars.where("hip % 20 = 0")).where(sum((axis[k] * F.col(k) for k in "yz"), axis["x"] * F.col("x")) >= F.cos(F.radians(F.lit(degrees))))
        assert sorted(map(tuple, near.select("frame_id", "hip").collect())) == sorted(map(tuple, every.select("frame_id", "hip").collect()))
    assert "Broadcast" not in joins.within_cone(frames, stars, 12.0)._jdf.queryExecution().executedPlan().toString()
