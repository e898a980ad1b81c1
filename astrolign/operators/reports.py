"""Validation and occlusion records, their summaries, and the tables that a viewer shows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolign.operators.selection import quantiles

#: Column names of the two reports: fixed values.
VALIDATION = ["filename", "n_detected", "n_matched", "method", "success", "angular_error_arcsec", "ra_error_arcsec", "dec_error_arcsec", "residual_arcsec"]
OCCLUSION = ["filename", "occlusion", "n_total_stars", "n_kept_stars", "triangle_success", "triangle_error_arcsec", "triangle_n_matched"]


def known(value: str) -> Column:
    """A number that is there: neither null nor NaN."""
    return F.col(value).isNotNull() & ~F.isnan(value)


def validation_summary(records: DataFrame) -> DataFrame:
    e = F.when(F.col("success") & known("angular_error_arcsec"), F.col("angular_error_arcsec"))
    return records.agg(
        F.count("*").alias("n_images"), F.count(F.when(F.col("success"), 1)).alias("n_success"), (100 * F.avg(F.when(F.col("success"), 1.0).otherwise(0.0))).alias("success_percent"), F.avg(e).alias("mean_error"), F.median(e).alias("median_error"),
        F.stddev_pop(e).alias("std_error"), F.min(e).alias("min_error"), F.max(e).alias("max_error"), F.count(F.when(e < 60, 1)).alias("under_60"), F.count(F.when(e < 10, 1)).alias("under_10"),
    )


def occlusion_summary(records: DataFrame) -> DataFrame:
    e = F.when(known("triangle_error_arcsec"), F.col("triangle_error_arcsec"))
    return records.groupBy("occlusion").agg(F.count("*").alias("n"), F.avg(F.when(F.col("triangle_success"), 1.0).otherwise(0.0)).alias("success_rate"), F.avg(e).alias("mean_error"), F.median(e).alias("median_error"))


def rejected(judged: DataFrame) -> DataFrame:
    """How many blobs each reason turned away."""
    return judged.where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n"))


def mean_confidence(matches: DataFrame) -> DataFrame:
    return matches.agg((100 * F.avg(F.when(F.col("confidence") > 0, F.col("confidence")))).alias("confidence_percent"))


def histogram(values: DataFrame, column: str, bins: int = 20) -> DataFrame:
    """bin (from 0), n: equal widths from the least to the largest value, which falls in the last bin."""
    bounds = values.agg(F.min(column).alias("low"), F.max(column).alias("high"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col(column) - F.col("low")) / F.nullif(F.col("high") - F.col("low"), F.lit(0.0)) * bins), F.lit(bins - 1))).otherwise(F.lit(bins // 2))
    return values.where(known(column)).crossJoin(F.broadcast(bounds)).groupBy(place.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def display_range(pixels: DataFrame, passes: bool = False) -> DataFrame:
    """low and high of each frame: its first and last percentile. passes: by selection.quantiles(), for frames whose pixels are too many for one task."""
    if passes:
        return quantiles(pixels, ["frame_id"], "value", [0.01, 0.99]).select("frame_id", F.col("quantiles")[0].alias("low"), F.col("quantiles")[1].alias("high"))
    return pixels.groupBy("frame_id").agg(F.percentile("value", F.lit(0.01)).alias("low"), F.percentile("value", F.lit(0.99)).alias("high"))


def image_stats(pixels: DataFrame) -> DataFrame:
    return pixels.groupBy("frame_id").agg(F.min("value").alias("least"), F.max("value").alias("most"), F.avg("value").alias("mean"), F.stddev_pop("value").alias("std"))


def occluded(stars: DataFrame, levels: list[float], seed: str = "occlusion") -> DataFrame:
    """For each level the stars that stay: of n in a frame, int(n * level) go, those last in a hashed order."""
    each = stars.withColumn("occlusion", F.explode(F.array(*[F.lit(float(x)) for x in levels])))
    key = Window.partitionBy("frame_id", "occlusion")
    order = F.md5(F.concat_ws(":", F.lit(seed), *[F.col(c).cast("string") for c in ("frame_id", "occlusion", "star")]).cast("binary"))
    placed = each.withColumn("n", F.count("*").over(key)).withColumn("place", F.row_number().over(key.orderBy(order, "star")))
    return placed.where(F.col("place") <= F.col("n") - F.floor(F.col("n") * F.col("occlusion"))).drop("place", "n")


def brightest_kept(stars: DataFrame, fraction: float, least: int = 4, bright: int = 3, seed: str = "viewer") -> DataFrame:
    """The viewer's choice: the brightest three and a hashed choice of others, `least` at least."""
    key = Window.partitionBy("frame_id")
    order = F.md5(F.concat_ws(":", F.lit(seed), F.col("frame_id").cast("string"), F.col("star").cast("string")).cast("binary"))
    placed = stars.withColumn("n", F.count("*").over(key)).withColumn("b", F.row_number().over(key.orderBy("mag", "star")))
    placed = placed.withColumn("place", F.row_number().over(key.orderBy(F.when(F.col("b") <= bright, 0).otherwise(1), order, "star")))
    return placed.where(F.col("place") <= F.greatest(F.lit(least), F.col("n") - F.floor(F.col("n") * fraction))).drop("n", "b", "place")


def match_table(matches: DataFrame, catalogue: DataFrame) -> DataFrame:
    """star_index, hip and rounded place, magnitude, confidence; halves to even."""
    return matches.join(catalogue.select("hip", "ra_deg", "dec_deg", "vmag"), "hip").select("frame_id", "star_index", "hip", F.bround("ra_deg", 3).alias("ra"), F.bround("dec_deg", 3).alias("dec"), F.bround("vmag", 2).alias("mag"), F.bround("confidence", 3).alias("confidence"))


def first_ids(stars: DataFrame, most: int = 100, chars: int = 68) -> DataFrame:
    """star_ids: the first hundred ids of each frame, comma-joined, cut at 68 characters even within an id."""
    first = stars.withColumn("__place", F.row_number().over(Window.partitionBy("frame_id").orderBy("star"))).where(F.col("__place") <= most)  # a limit that Spark applies before the shuffle
    ids = F.transform(F.array_sort(F.collect_list("star")), lambda x: x.cast("string"))
    return first.groupBy("frame_id").agg(F.substring(F.array_join(ids, ","), 1, chars).alias("star_ids"))


def with_fallback(first: DataFrame, second: DataFrame, least: int = 3) -> DataFrame:
    """Matches of `first`, and of `second` for frames in which `first` has fewer than `least`; method names where they come from."""
    good = first.groupBy("frame_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("frame_id")
    return first.join(good, "frame_id", "left_semi").withColumn("method", F.lit("triangle")).unionByName(second.join(good, "frame_id", "left_anti").withColumn("method", F.lit("gnn")))


def complete(frames: DataFrame, records: DataFrame) -> DataFrame:
    """Every frame gives one record; without one it is a failure."""
    return frames.join(records, "frame_id", "left").withColumns({"success": F.coalesce("success", F.lit(False)), "method": F.coalesce("method", F.lit("triangle_failed")), "n_matched": F.coalesce("n_matched", F.lit(0).cast("long"))})


def write_csv(records: DataFrame, columns: list[str], path: str) -> None:
    """A report as a folder of CSV files with headers, in order from file to file, NaN for what is missing. Ranges are sorted apart; Spark joins those of a short report into one file."""
    values = [F.when(F.col(c).isNull(), F.lit(float("nan"))).otherwise(F.col(c)).alias(c) if t == "double" else F.col(c) for c in columns for t in [dict(records.dtypes)[c]]]
    records.select(*values).orderBy(columns[0]).write.mode("overwrite").csv(path, header=True)
