"""Plans whose tasks must not grow with the tables."""

import glob

from pyspark.sql import functions as F

from astrolign import tables
from astrolign.operators import reports


def test_light_of_all_frames_is_not_broadcast(spark):
    """The suppliers' file is tiny, the pixels that they light are not."""
    pixels = tables.pixels(spark, "/root/testdata/sf0.001")
    pixels.collect()
    assert "Broadcast" not in pixels._jdf.queryExecution().executedPlan().toString()


def test_long_reports_are_sorted_in_parts(spark, tmp_path):
    rows = spark.range(200_000).select(F.format_string("%07d", F.col("id") * 7919 % 200_000).alias("filename"), F.when(F.col("id") % 2 == 0, F.rand(1)).alias("error"))
    spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", "256k")
    reports.write_csv(rows, ["filename", "error"], f"{tmp_path}/long")
    spark.conf.unset("spark.sql.adaptive.advisoryPartitionSizeInBytes")
    files = sorted(glob.glob(f"{tmp_path}/long/part-*.csv"))
    lines = [open(f).read().splitlines() for f in files]
    assert len(files) > 1 and all(own[0] == "filename,error" for own in lines)
    assert [x.split(",")[0] for own in lines for x in own[1:]] == [f"{k:07d}" for k in range(200_000)]
    reports.write_csv(rows.limit(9), ["filename", "error"], f"{tmp_path}/short")
    assert len(glob.glob(f"{tmp_path}/short/part-*.csv")) == 1
