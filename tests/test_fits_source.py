"""The FITS data source: what is read, how large images are cut, and what a failed write leaves."""

import os

import numpy as np
import pytest
from pyspark.sql import functions as F

from astrolign.sources import fits, fits_source


def files(folder, images):
    os.makedirs(folder, exist_ok=True)
    for name, content in images.items():
        with open(f"{folder}/{name}.fits", "wb") as f:
            f.write(content)


def raw(image, bitpix, extra=""):
    cards = [f"{'BITPIX':<8}= {bitpix:>20}", f"{'NAXIS':<8}= {2:>20}", f"{'NAXIS1':<8}= {image.shape[1]:>20}", f"{'NAXIS2':<8}= {image.shape[0]:>20}", *([extra] if extra else [])]
    head = f"{'SIMPLE':<8}= {'T':>20}".ljust(80) + "".join(c.ljust(80) for c in cards) + "END".ljust(80)
    body = image.astype(fits._KINDS[bitpix]).tobytes()
    return head.ljust(-(-len(head) // 2880) * 2880).encode() + body + bytes(-len(body) % 2880)


def test_bands_join_to_the_images_that_whole_files_give(spark, tmp_path):
    rng = np.random.default_rng(1)
    image = rng.normal(5, 10, (37, 50))
    odd = image.copy()
    odd[3, 4], odd[30, 7] = np.inf, np.nan  # in different bands
    only_inf = image.copy()
    only_inf[20, 20] = np.inf
    content = {
        "doubles": fits.encode(image, {"NOTE": "it's"}), "nan_far_off": fits.encode(odd, {}), "inf": fits.encode(only_inf, {}), "bytes": raw(np.abs(image), 8, f"{'BZERO':<8}= {-3:>20}"), "short": raw(image * 100, 16), "float": raw(image, -32),
        "late": fits.encode(np.zeros((1, 1)), {})[:2880].replace(b"NAXIS1  =                    1", b"NAXIS1  =                    0") + fits.encode(image, {"SECOND": 1}),
        "cut": fits.encode(image, {})[:9000], "none": b"", "junk": b"x" * 5000,
    }
    files(tmp_path, content)
    got = fits_source.scan(spark, str(tmp_path), bandBytes=3000, partitionBytes=600_000)
    assert got.rdd.getNumPartitions() > 3
    bands, errors = {}, {}
    for r in got.collect():
        name = os.path.basename(r.path)[:-5]
        if r.error:
            errors[name] = r.error
        elif name not in errors:
            assert r.bytes_read <= 2 * 2880 + 50 * 8 * 40 + 2880 * 2
            bands.setdefault(name, {})[r.first_row] = np.frombuffer(r.data, "<f8").reshape(-1, r.width)
    assert errors.keys() == {"cut", "none", "junk"}
    for name in set(content) - {"cut", "none", "junk"}:
        assert len(bands[name]) > 1
        whole = np.concatenate([bands[name][k] for k in sorted(bands[name])])
        assert np.array_equal(whole, fits.decode(content[name])[1]), name


def test_headers_alone_cost_their_blocks(spark, tmp_path):
    large = np.zeros((500, 1000))
    many = {f"KEY{k}": k for k in range(60)}
    files(tmp_path, {"a": fits.encode(large, {"FOV": 20.0}), "b": fits.encode(large, many)})
    rows = {os.path.basename(r.path): r for r in fits_source.scan(spark, str(tmp_path), "path", "width", "height", "header", "bytes_read").collect()}
    assert {k: r.bytes_read for k, r in rows.items()} == {"a.fits": 2880, "b.fits": 2 * 2880}
    assert rows["a.fits"].header["FOV"] == "20.0" and rows["b.fits"].header["KEY59"] == "59" and rows["b.fits"].width == 1000
    assert fits_source.scan(spark, str(tmp_path), "path").count() == 2
    with pytest.raises(Exception, match="no such columns"):
        spark.read.format("fits").schema("colour string").load(str(tmp_path)).count()


def test_a_failed_write_leaves_no_file_and_a_good_one_all(spark, tmp_path):
    folder = f"{tmp_path}/out"
    good = spark.range(20).select(F.format_string("f%02d", "id").alias("name"), F.lit(2).alias("width"), F.lit(np.arange(4.0).tobytes()).alias("data"), F.create_map(F.lit("ID"), F.col("id").cast("string")).alias("header")).repartition(4)
    bad = good.withColumn("data", F.when(F.col("name") == "f13", F.lit(b"odd")).otherwise(F.col("data")))
    with pytest.raises(Exception):  # noqa: B017, PT011  the task's error comes wrapped
        fits_source.save(bad, folder)
    assert not os.path.exists(folder) or os.listdir(folder) == []
    fits_source.save(good, folder)
    assert sorted(os.listdir(folder)) == [f"f{k:02d}.fits" for k in range(20)]
    with pytest.raises(Exception, match="same name"):
        fits_source.save(good.union(good), folder)
    assert len(os.listdir(folder)) == 20
    fits_source.save(good.where("name < 'f05'"), folder, overwrite=True)
    assert sorted(os.listdir(folder)) == [f"f{k:02d}.fits" for k in range(5)]
    rows = fits_source.scan(spark, folder).collect()
    assert all(np.array_equal(np.frombuffer(r.data, "<f8"), np.arange(4.0)) and r.header["ID"] == str(int(os.path.basename(r.path)[1:3])) for r in rows)
    with pytest.raises(Exception, match="lack"):
        good.select("name").write.format("fits").mode("append").save(folder)
