"""Numeric kernels, image files, reports and streams: what SQL can't express."""

import numpy as np
from pyspark.sql import functions as F

from astrolign.config import Camera
from astrolign.functions import accuracy, camera, geometry
from astrolign.operators import attitude, graph, image, joins, reports, voting
from astrolign.plans import pipelines
from astrolign.sources import catalogue, fits
from astrolign.streaming import frames


def test_attitude_is_exact_without_noise_and_leaves_outliers():
    rng = np.random.default_rng(2)
    q = rng.normal(size=4)
    q *= (1 if q[0] > 0 else -1) / np.linalg.norm(q)
    r = rng.normal(size=(12, 3))
    r /= np.linalg.norm(r, axis=1, keepdims=True)
    b = r @ attitude.matrix(q).T
    assert np.allclose(attitude.attitude(b, r, np.ones(12)), q)
    b[3], b[7] = b[7].copy(), b[3].copy()
    for seed in (42, None):
        found, keep = attitude.consensus(b, r, np.ones(12), seed=seed)
        assert np.allclose(found, q) and sorted(keep) == [k for k in range(12) if k not in (3, 7)]


def test_gaussian_fit():
    rows, cols = np.mgrid[:11, :11]
    cut = 3 + 50 * np.exp(-((cols - 5.3) ** 2) / (2 * 1.4**2) - (rows - 4.6) ** 2 / (2 * 1.1**2))
    assert np.allclose(image.gaussian_centroid(cut), (5.3, 4.6, 1.4, 1.1), atol=1e-6)
    assert image.gaussian_centroid(np.ones((2, 3))) is None
    assert image.gaussian_centroid(np.ones((5, 5))) is None


def test_projection_round_trip(spark):
    c = Camera()
    px = spark.createDataFrame([(float(u), float(v)) for u in range(0, 1024, 200) for v in range(0, 1024, 200)], "u double, v double").withColumn("b", camera.pixel_to_vector(c, F.col("u"), F.col("v")))
    back = px.withColumn("p", camera.vector_to_pixel(c, geometry.fields(F.col("b"))))
    assert all(abs(r.u - r.p.u) < 1e-6 and abs(r.v - r.p.v) < 1e-6 for r in back.collect())
    behind = spark.range(1).select(camera.vector_to_pixel(c, geometry.vector(F.lit(0.0), F.lit(0.0), F.lit(-1.0))).alias("p")).first()
    assert behind.p is None


def test_embeddings_have_length_one_and_do_not_depend_on_row_order():
    w, rng = graph.weights(), np.random.default_rng(1)
    x, src, dst = rng.random((5, 6)), np.array([0, 1, 2, 3, 4, 0]), np.array([1, 2, 3, 4, 0, 2])
    out = graph.forward(x, src, dst, w)
    assert np.allclose(np.linalg.norm(out, axis=1), 1)
    p = np.array([3, 1, 4, 0, 2])
    place = np.argsort(p)
    assert np.allclose(graph.forward(x[p], place[src], place[dst], w), out[p])


def test_fits_files(spark, tmp_path):
    data = np.arange(12, dtype=float).reshape(3, 4)
    rows = [("a", 4, data.astype("<f8").tobytes(), {"SYNTHIMG": "T", "NOTE": "it's"}), ("b", 4, (-data).astype("<f8").tobytes(), {"CD1_1": "-0.001"})]
    frame = spark.createDataFrame(rows, "name string, width int, data binary, header map<string,string>")
    assert fits.write(frame, f"file://{tmp_path}").count() == 2
    (tmp_path / "broken.fits").write_bytes(b"no header")
    (tmp_path / "other.txt").write_text("x")
    cube = fits.encode(data, {"NAXIS": 3, "NAXIS3": 1, "BITPIX": -64})
    (tmp_path / "cube.fits").write_bytes(cube)
    nan = data.copy()
    nan[0, 1], nan[0, 2] = np.nan, np.inf
    (tmp_path / "nan.fits").write_bytes(fits.encode(nan, {}))
    got = {r.path.rsplit("/", 1)[1]: r for r in fits.read(spark, str(tmp_path)).collect()}
    assert sorted(got) == ["a.fits", "b.fits", "broken.fits", "cube.fits", "nan.fits"]
    image_of = lambda k: np.frombuffer(got[k].data, "<f8").reshape(3, 4)
    assert (image_of("a.fits") == data).all() and (image_of("b.fits") == 0).all() and (image_of("cube.fits") == data).all()
    assert image_of("nan.fits")[0, 1] == image_of("nan.fits")[0, 2] == 0
    assert got["a.fits"].header["NOTE"] == "it's" and got["broken.fits"].data is None and "ValueError" in got["broken.fits"].error
    assert fits.pixels(fits.read(spark, str(tmp_path))).count() == 48


def test_catalogue_and_pair_files(spark, tmp_path):
    stars = spark.createDataFrame([(1, 10.0, 5.0, 2.0), (2, 11.0, 5.0, 1.0), (3, 200.0, -80.0, 3.0), (4, 10.0, 5.05, 9.0), (5, None, 1.0, 1.0)], "hip long, ra_deg double, dec_deg double, vmag double")
    catalogue.write(catalogue.with_vectors(catalogue.cleaned(stars)), f"{tmp_path}/c")
    back = catalogue.read(spark, f"{tmp_path}/c")
    assert sorted(r.hip for r in back.collect()) == [1, 2, 3]
    pairs = pipelines.build_pairs(back)
    catalogue.write_pairs(pairs, f"{tmp_path}/p")
    assert [(r.a, r.b) for r in catalogue.read_pairs(spark, f"{tmp_path}/p").collect()] == [(1, 2)]


def test_band_join_keeps_edges(spark):
    left = spark.createDataFrame([(0.0,), (1.0,), (2.5,)], "l double")
    right = spark.createDataFrame([(0.5,), (1.5,), (3.0,), (9.0,)], "r double")
    assert sorted(map(tuple, joins.band_join(left, right, "l", "r", 0.5).collect())) == [(0.0, 0.5), (1.0, 0.5), (1.0, 1.5), (2.5, 3.0)]


def test_end_to_end_from_rendered_images(spark):
    """Stars rendered on a frame, detected, turned into directions, and the attitude of the frame recovered."""
    cam = Camera(focal=600.0, cx=64.0, cy=64.0, width=128, height=128, k1=0.0, k2=0.0)
    rng = np.random.default_rng(4)
    stars = spark.createDataFrame([(i, float(83 + rng.uniform(-5, 5)), float(-1 + rng.uniform(-5, 5)), float(rng.uniform(1, 3))) for i in range(14)], "hip long, ra_deg double, dec_deg double, vmag double")
    cat = catalogue.with_vectors(stars).cache()
    frame = spark.createDataFrame([(0, 83.0, -1.0, 20.0)], "frame_id long, ra double, dec double, roll double")
    seen = pipelines.visible(frame, cat, cam).withColumn("flux", F.pow(F.lit(10.0), 5 - 0.4 * F.col("mag")))
    light = image.rendered(seen, 128, 128)
    grid = spark.range(128 * 128).select(F.lit(0).cast("long").alias("frame_id"), F.floor(F.col("id") / 128).cast("int").alias("row"), (F.col("id") % 128).cast("int").alias("col"))
    pixels = grid.join(light, image.PIXEL, "left").fillna(0.0, ["value"])
    found = pipelines.directions(pipelines.detect(pixels, 128, 128), cam).cache()
    solved = pipelines.solve(found, cat, pipelines.build_pairs(cat))
    record = pipelines.validate(frame, found, solved).first()
    assert record.success and record.n_matched >= 3 and record.angular_error_arcsec < 60


def test_report_file(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1, 0, "triangle_failed", False, None, None, None, None), ("a", 5, 4, "triangle", True, 1.0, 2.0, 3.0, 4.0)], ", ".join(f"{c} {t}" for c, t in zip(reports.VALIDATION, ["string", "int", "int", "string", "boolean"] + ["double"] * 4, strict=True)))
    reports.write_csv(rows, reports.VALIDATION, f"{tmp_path}/r")
    text = next((tmp_path / "r").glob("*.csv")).read_text().splitlines()
    assert text[0] == ",".join(reports.VALIDATION) and text[1].startswith("a,5,4") and text[2].endswith("NaN,NaN,NaN,NaN")


def test_stream_of_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/x.fits").write_bytes(fits.encode(np.ones((2, 2)), {}))
    job = frames.each_batch(frames.files(spark, str(tmp_path / "in")), lambda b: b.select("path", "length"), f"{tmp_path}/out", f"{tmp_path}/check")
    job.processAllAvailable()
    job.stop()
    assert spark.read.parquet(f"{tmp_path}/out").count() == 1


def sky(spark, n=400, seed=6):
    rng = np.random.default_rng(seed)
    v = rng.normal(size=(n, 3))
    v /= np.linalg.norm(v, axis=1, keepdims=True)
    rows = [(i, float(np.degrees(np.arctan2(y, x)) % 360), float(np.degrees(np.arcsin(z))), float(rng.uniform(1, 6))) for i, (x, y, z) in enumerate(v)]
    return catalogue.with_vectors(spark.createDataFrame(rows, "hip long, ra_deg double, dec_deg double, vmag double"))


def test_votes_from_lists_are_those_of_hits(spark):
    stars = sky(spark).cache()
    observed = spark.createDataFrame([(f, i, j, 0.5 + 0.031 * (7 * f + 3 * i + j), 0.01 + 0.3 * (f % 2)) for f in range(5) for i in range(6) for j in range(i + 1, 6)], "frame_id long, i int, j int, obs double, tolerance double")
    pairs = pipelines.build_pairs(stars).cache()
    exact = observed.union(pairs.orderBy("a", "b").limit(30).selectExpr("9L", "0", "1", "ang + 0.01", "0.01D"))  # on the edge of the tolerance
    for own in (exact, exact.drop("tolerance")):
        want = sorted(map(tuple, voting.votes(voting.hits(own, pairs)).collect()))
        for lists in (pipelines.build_lists(stars), joins.angle_lists(stars, 0.1, 20.0, block=7, budget=5)):
            assert sorted(map(tuple, voting.star_votes(own, lists).collect())) == want
        lists = pipelines.build_lists(stars)
        for options in ({}, {"chunk": 2}, {"few": 0, "chunk": 1}):
            some = voting.star_votes(own, lists, most=2, **options)
            assert sorted(map(tuple, voting.candidates(some).collect())) == sorted(map(tuple, voting.candidates(voting.votes(voting.hits(own, pairs))).collect()))


def test_counts_at_the_edges_of_tolerances():
    rng = np.random.default_rng(5)
    angles = np.sort(np.round(rng.uniform(0, 3, 500), 2))
    for n in (20, 2000):  # fewer and more ranges than angles
        at, tolerance = np.round(rng.uniform(-1, 4, n), 2), np.where(np.arange(n) % 3 == 0, 0.01, np.round(rng.uniform(0, 0.3, n), 2))
        assert (voting.Counter(*voting.edges(at, tolerance))(angles) == [(np.abs(x - angles) <= w).sum() for x, w in zip(at, tolerance, strict=True)]).all()


def test_no_nested_loops_in_joins_by_angle(spark):
    stars, frames = sky(spark), spark.createDataFrame([(1, 10.0, 20.0, 5.0), (2, 100.0, -89.9, 0.0)], "frame_id long, ra double, dec double, roll double")
    for df in (pipelines.visible(frames, stars), joins.cone_search(frames, stars, 12.0), pipelines.projected(frames, stars), joins.within_angle(stars, None, 15.0), graph.knn_edges(graph.patches(stars, graph.neighbourhoods(stars)))):
        df.collect()
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        assert not [line for line in plan.splitlines() if "Join" in line and "lambda" in line]
    rows, axis = stars.collect(), {r.frame_id: r for r in frames.collect()}
    found = {(r.frame_id, r.hip) for r in joins.cone_search(frames, stars, 12.0).collect()}
    at = {k: (np.cos(np.radians(r.dec)) * np.cos(np.radians(r.ra)), np.cos(np.radians(r.dec)) * np.sin(np.radians(r.ra)), np.sin(np.radians(r.dec))) for k, r in axis.items()}
    assert found == {(k, s.hip) for k, (x, y, z) in at.items() for s in rows if np.degrees(np.arccos(x * s.x + y * s.y + z * s.z)) <= 12}


def test_field_radius_holds_the_sensor():
    for c in (Camera(), Camera(600.0, 64.0, 64.0, 128, 128, 0.0, 0.0), Camera(300.0, 10.0, 500.0, 640, 480, 1e-7, 0.0)):
        u, v = np.meshgrid(np.linspace(0, c.width, 30), np.linspace(0, c.height, 30))
        x, y = u - c.cx, v - c.cy
        a, b = x.copy(), y.copy()
        for _ in range(50):
            r2 = a * a + b * b
            f = 1 + c.k1 * r2 + c.k2 * r2 * r2
            a, b = x / f, y / f
        assert np.degrees(np.arctan(np.hypot(a, b).max() / c.focal)) < camera.field_radius(c) <= 90


def test_patch_kernels_equal_plain_loops():
    rng = np.random.default_rng(3)
    px, py, mag = rng.integers(0, 9, 40).astype(float), rng.integers(0, 9, 40).astype(float), rng.uniform(1, 5, 40)
    d = np.sqrt((px[:, None] - px) ** 2 + (py[:, None] - py) ** 2)
    src, dst = graph.edges_of(px, py)
    near = [sorted((d[i, j], j) for j in range(40) if j != i) for i in range(40)]
    assert list(zip(src.tolist(), dst.tolist(), strict=True)) == [(i, j) for i in range(40) for _, j in near[i][:6]]
    want = np.array([[(mag[i] - mag.min()) / 3, *[x / 15 for x, _ in near[i][:5]]] for i in range(40)])
    assert np.allclose(graph.features_of(px, py, mag), want)
    assert graph.features_of(px[:3], py[:3], mag[:3])[:, 3:].min() == 1 and len(graph.edges_of(px[:1], py[:1])[0]) == 0


def test_second_identification_takes_over(spark, tmp_path):
    """Frames whose pairs are off fail pair voting; the graph network names their stars if its index holds them."""
    w = graph.weights(3)
    graph.save_weights(w, f"{tmp_path}/w.npz")
    back = graph.load_weights(spark, f"{tmp_path}/w.npz")
    assert all((back[k] == w[k]).all() for k in w)
    stars = sky(spark, 900).cache()
    frames = spark.createDataFrame([(1, 83.0, -1.0, 20.0), (2, 200.0, 40.0, 0.0)], "frame_id long, ra double, dec double, roll double")
    seen = pipelines.visible(frames, stars).withColumn("label", F.col("star")).withColumn("snr", F.lit(9.0))
    ranked = voting.ranked(seen).withColumn("x", F.when(F.col("frame_id") == 2, F.col("x") * 1.05).otherwise(F.col("x")))
    # The index holds what the network makes of the frames' own stars, so that each one's nearest embedding is its own.
    index = graph.star_embeddings(ranked, w).join(ranked.select("frame_id", "star_index", "star"), ["frame_id", "star_index"]).select(F.col("star").alias("hip"), F.col("q").alias("embedding"))
    index.write.parquet(f"{tmp_path}/index")
    index = spark.read.parquet(f"{tmp_path}/index")
    first = voting.identify(ranked, stars, pipelines.build_lists(stars))
    found = pipelines.matched(ranked, stars, pipelines.build_lists(stars), index=index, weights=back).collect()
    assert {(r.frame_id, r.method) for r in found} >= {(1, "triangle")}
    forced = pipelines.matched(ranked.where("frame_id = 1"), stars, pipelines.build_lists(stars), index=index, weights=back, force_gnn=True).collect()
    truth = {(r.frame_id, r.star_index): r.star for r in ranked.collect()}
    assert forced and all(r.method == "gnn" and truth[r.frame_id, r.star_index] == r.hip for r in forced)
    assert first.count() and all(r.confidence > 0 for r in forced)


def test_isolated_stars_have_zero_vectors(spark):
    stars = spark.createDataFrame([(1, 0, 0.0, 0.0, 1.0, 2.0), (1, 1, 0.5, 0.0, 0.9, 3.0), (2, 0, 0.0, 0.0, 1.0, 1.0), (2, 1, 0.01, 0.0, 1.0, 1.0), (2, 2, 0.0, 0.01, 1.0, 2.0), (2, 3, 0.01, 0.01, 1.0, 2.0)], "frame_id long, star_index int, x double, y double, z double, mag double")
    rows = graph.star_embeddings(stars, graph.weights()).collect()
    assert {(r.frame_id, any(r.q)) for r in rows} == {(1, False), (2, True)} and len(rows) == 6


def test_image_centre_of_a_gnomonic_header(spark):
    """Against a projection of the centre back to the plane."""
    rows = [{"NAXIS1": "512", "NAXIS2": "256", "CRPIX1": "10", "CRPIX2": "400.5", "CRVAL1": "359.9", "CRVAL2": "-62", "CD1_1": "-2e-3", "CD1_2": "5e-4", "CD2_1": "4e-4", "CD2_2": "2e-3"}, {"NAXIS1": "100", "NAXIS2": "100", "CRPIX1": "51", "CRPIX2": "51", "CRVAL1": "12", "CRVAL2": "80"}, {"CRVAL1": "7"}, {}]
    frame = spark.createDataFrame([(i, h) for i, h in enumerate(rows)], "i int, header map<string,string>").select("i", accuracy.truth(F.col("header")).alias("t"))
    got = {r.i: r.t for r in frame.collect()}
    assert got[2] is None and got[3] is None and np.allclose((got[1].ra, got[1].dec), (12, 80))
    ra, dec = np.radians(got[0].ra - 359.9), np.radians(got[0].dec)
    d0 = np.radians(-62)
    c = np.sin(d0) * np.sin(dec) + np.cos(d0) * np.cos(dec) * np.cos(ra)
    plane = np.degrees([np.cos(dec) * np.sin(ra) / c, (np.cos(d0) * np.sin(dec) - np.sin(d0) * np.cos(dec) * np.cos(ra)) / c])
    assert np.allclose(plane, np.array([[-2e-3, 5e-4], [4e-4, 2e-3]]) @ [257 - 10, 129 - 400.5], atol=1e-9)


def test_cameras_of_headers(spark):
    rows = [("a", 512, 256, b"x", {"CD1_1": "-0.002", "CRPIX1": "200", "CRPIX2": "100"}), ("b", 64, 64, b"x", {"SYNTHIMG": "T", "FOCAL_L": "300", "CX": "30"}), ("c", 10, 10, b"x", {}), ("d", 10, 10, None, {})]
    frame = spark.createDataFrame(rows, "path string, width int, height int, data binary, header map<string,string>")
    own = {r.frame_id: r for r in fits.cameras(frame).collect()}
    f = 1 / np.tan(np.radians(0.002))
    assert set(own) == {"a", "b", "c"} and np.isclose(own["a"].focal, f) and (own["a"].cx, own["a"].cy, own["a"].k1) == (256, 128, 0)
    assert np.isclose(own["a"].tolerance, max(2 * 2 * np.degrees(np.arctan(256 / f)) / 512, 0.003)) and own["b"].tolerance is None
    assert (own["b"].focal, own["b"].cx, own["b"].cy) == (300, 30, Camera().cy) and own["c"].focal == Camera().focal
    seen = {r.frame_id: r for r in fits.viewer_cameras(frame).collect()}
    assert np.isclose(seen["a"].focal, 256 / np.tan(np.radians(0.002 * 512 / 2))) and (seen["a"].cx, seen["a"].cy) == (200, 100)
    assert np.isclose(seen["a"].most_angle, 1.2 * 1.024) and np.isclose(seen["a"].least_angle, 0.004) and seen["c"].most_angle is None


def test_from_files_to_attitudes(spark, tmp_path):
    """Images of two sizes and headers, written as files: one with the truth in its header, one that can't be read, one without stars."""
    rng = np.random.default_rng(4)
    cam = Camera(focal=600.0, cx=64.0, cy=64.0, width=128, height=128)
    stars = spark.createDataFrame([(i, float(83 + rng.uniform(-5, 5)), float(-1 + rng.uniform(-5, 5)), float(rng.uniform(1, 3))) for i in range(14)], "hip long, ra_deg double, dec_deg double, vmag double")
    cat = catalogue.with_vectors(stars).cache()
    frame = spark.createDataFrame([(0, 83.0, -1.0, 20.0)], "frame_id long, ra double, dec double, roll double")
    seen = pipelines.visible(frame, cat, cam).withColumn("flux", F.pow(F.lit(10.0), 5 - 0.4 * F.col("mag")))
    picture = np.zeros((128, 128))
    for r in image.rendered(seen, 128, 128).collect():
        picture[r.row, r.col] = r.value
    header = {"SYNTHIMG": True, "FOCAL_L": 600.0, "CX": 64.0, "CY": 64.0, "TRUE_RA": 83.0, "TRUE_DEC": -1.0, "TRUE_ROL": 20.0}
    (tmp_path / "b.fits").write_bytes(fits.encode(picture, header))
    # The sky as files mostly have it: columns the other way round, a plate scale, no distortion; mirrored about the middle of column 64.
    plain = pipelines.visible(spark.createDataFrame([(0, 83.0, -1.0, 0.0)], "frame_id long, ra double, dec double, roll double"), cat, Camera(600.0, 64.0, 64.0, 128, 128, 0.0, 0.0)).withColumn("flux", F.pow(F.lit(10.0), 5 - 0.4 * F.col("mag")))
    turned = np.zeros((128, 128))
    for r in image.rendered(plain, 128, 128).collect():
        turned[r.row, (128 - r.col) % 128] = r.value
    scale = float(np.degrees(np.arctan(1 / 600.0)))
    (tmp_path / "d.fits").write_bytes(fits.encode(turned, {"CDELT1": -scale, "CDELT2": scale, "CRVAL1": 83.0, "CRVAL2": -1.0, "CRPIX1": 65.0, "CRPIX2": 65.0}))
    (tmp_path / "a.fits").write_bytes(b"nothing")
    (tmp_path / "c.fits").write_bytes(fits.encode(np.zeros((64, 96)), {"CD1_1": -0.01, "CRVAL1": 10.0, "CRVAL2": 5.0, "CRPIX1": 48.0, "CRPIX2": 32.0}))
    rows = {r.filename: r for r in pipelines.solve_files(spark, str(tmp_path), cat, pipelines.build_lists(cat)).collect()}
    assert sorted(rows) == ["a.fits", "b.fits", "c.fits", "d.fits"] and [rows[k].success for k in sorted(rows)] == [False, True, False, True]
    assert abs(rows["d.fits"].ra_error_arcsec) < 120 and abs(rows["d.fits"].dec_error_arcsec) < 120 and rows["d.fits"].residual_arcsec < 60
    good = rows["b.fits"]
    assert good.n_matched >= 3 and good.angular_error_arcsec < 60 and good.method == "triangle" and rows["a.fits"].n_detected == 0
