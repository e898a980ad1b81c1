"""Jobs that go on where an earlier run ended: summaries of streams, and folders of images."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolign.operators import image, reports
from astrolign.plans import pipelines
from astrolign.sources import catalogue, fits
from astrolign.streaming import summaries


def test_a_stopped_stream_with_files_delivered_twice_gives_the_batch_summary(spark, tmp_path):
    rng = np.random.default_rng(3)
    schema = "filename string, occlusion double, n_total_stars int, n_kept_stars int, triangle_success boolean, triangle_error_arcsec double, triangle_n_matched int"
    rows = [(f"f{k}", k % 3 / 10, 20, 15, bool(k % 4), float(rng.uniform(1, 90)) if k % 5 else float("nan"), k % 9) for k in range(60)]
    (tmp_path / "in").mkdir()
    for k, part in enumerate((rows[:20], rows[10:40])):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        stream = spark.readStream.schema(schema).parquet(f"{tmp_path}/in")
        job = summaries.running(stream, ["filename", "occlusion"], reports.occlusion_summary, f"{tmp_path}/out", f"{tmp_path}/check")
        job.processAllAvailable()
        job.stop()
        want = reports.occlusion_summary(spark.createDataFrame(rows[: 20 if k == 0 else 40], schema)).collect()
        got = spark.read.parquet(f"{tmp_path}/out").collect()
        assert sorted((r.occlusion, r.n, r.success_rate, r.median_error) for r in got) == sorted((r.occlusion, r.n, r.success_rate, r.median_error) for r in want)
        assert np.allclose(sorted(r.mean_error for r in got), sorted(r.mean_error for r in want))


def test_a_second_run_decodes_new_files_alone(spark, tmp_path):
    cat = catalogue.with_vectors(spark.createDataFrame([(k, 83.0 + k % 3, float(k % 4), 2.0) for k in range(9)], "hip long, ra_deg double, dec_deg double, vmag double"))
    lists = pipelines.build_lists(cat)
    (tmp_path / "in").mkdir()
    for name in ("a", "b"):
        (tmp_path / f"in/{name}.fits").write_bytes(fits.encode(np.zeros((32, 32)), {}))
    first = pipelines.solve_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/ledger", cat, lists)
    assert sorted(r.filename for r in first.collect()) == ["a.fits", "b.fits"]
    # The old files become unreadable: who decodes them again gives other records.
    (tmp_path / "in/a.fits").write_bytes(b"junk")
    (tmp_path / "in/b.fits").write_bytes(b"junk")
    (tmp_path / "in/c.fits").write_bytes(b"junk")
    before = {r.filename: r for r in first.collect()}
    again = {r.filename: r for r in pipelines.solve_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/ledger", cat, lists).collect()}
    assert sorted(again) == ["a.fits", "b.fits", "c.fits"] and all(again[k] == before[k] for k in before)
    assert pipelines.solve_new_files(spark, f"{tmp_path}/in", f"{tmp_path}/ledger", cat, lists).count() == 3


def test_a_dark_frame_of_another_shape_is_an_error(spark):
    pixels = spark.createDataFrame([(1, 0, 0, 5.0), (1, 0, 1, 5.0)], "frame_id long, row int, col int, value double")
    dark = spark.createDataFrame([(0, 0, 2.0)], "row int, col int, dark double")
    assert image.subtract_dark(pixels.where(F.col("col") == 0), dark).first().value == 3.0
    with pytest.raises(Exception, match="lacks pixels"):
        image.subtract_dark(pixels, dark).collect()
