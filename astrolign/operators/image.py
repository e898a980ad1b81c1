"""Image operators on pixels in long form: frame_id, row, col, value. Frames are independent, so every shuffle is by frame, tile, or pixel."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolign.config import Detection, Photometry
from astrolign.functions.photometry import instrumental_magnitude, quality, signal_to_noise
from astrolign.operators import components
from astrolign.operators.selection import quantiles
from astrolign.sources.shared import staged

PIXEL = ["frame_id", "row", "col"]


def subtract_dark(pixels: DataFrame, dark: DataFrame) -> DataFrame:
    """Less the dark frame (row, col, dark), 0 at least. A pixel that the dark frame lacks is an error: the two have different shapes."""
    known = F.coalesce("dark", F.raise_error(F.lit("the dark frame lacks pixels of the image")).cast("double"))
    return pixels.join(dark, ["row", "col"], "left").select(*PIXEL, F.greatest(F.col("value") - known, F.lit(0.0)).alias("value"))


def flatten(pixels: DataFrame, flat: DataFrame) -> DataFrame:
    """Divided by the flat field (row, col, flat) over its mean, 0.1 at least. The mean is of decimals, which sum up to the same number in any order."""
    mean = flat.agg((F.sum(F.col("flat").cast("decimal(28,12)")).cast("double") / F.count("flat")).alias("mean"))
    scaled = flat.crossJoin(F.broadcast(mean)).select("row", "col", F.greatest(F.col("flat") / F.col("mean"), F.lit(0.1)).alias("gain"))
    return pixels.join(scaled, ["row", "col"]).select(*PIXEL, (F.col("value") / F.col("gain")).alias("value"))


def _size(size: int | str) -> Column:
    return F.lit(size) if isinstance(size, int) else F.col(size)


def tile_medians(pixels: DataFrame, height: int | str, width: int | str, box: int = 5) -> DataFrame:
    """frame_id, tile_row, tile_col, median of whole tiles; rows and columns beyond the last whole tile take no part. Sizes are numbers, or names of columns of the pixels, which the tiles keep, for frames of unlike sizes."""
    whole = lambda size: F.floor(_size(size) / box) * box
    inside = pixels.where((F.col("row") < whole(height)) & (F.col("col") < whole(width)))
    sizes = [s for s in (height, width) if isinstance(s, str)]
    return inside.groupBy("frame_id", *sizes, F.floor(F.col("row") / box).alias("tile_row"), F.floor(F.col("col") / box).alias("tile_col")).agg(F.median("value").alias("median"))


def background(tiles: DataFrame, height: int | str, width: int | str, box: int = 5) -> DataFrame:
    """frame_id, row, col, background: tiles stretched to all pixels by linear interpolation between their ends. Each tile spreads its weight over the pixels that it
    touches, and pixels sum up: one shuffle, no join of tiles with tiles. Sizes as in tile_medians()."""

    def spread(tile: str, size: Column) -> Column:
        last = (size - 1).cast("int")
        step = F.nullif((F.floor(size / box) - 1) / F.nullif(last, F.lit(0)), F.lit(0.0))  # tiles a pixel; null for a single tile, which reaches every pixel
        first = F.when(step.isNull(), F.lit(0)).otherwise(F.greatest(F.ceil((F.col(tile) - 1) / step).cast("int"), F.lit(0)))
        end = F.when(step.isNull(), last).otherwise(F.least(F.floor((F.col(tile) + 1) / step).cast("int"), last))
        weight = lambda i: F.greatest(1 - F.abs(i * F.coalesce(step, F.lit(0.0)) - F.col(tile)), F.lit(0.0))
        return F.transform(F.sequence(first, end), lambda i: F.struct(i.alias("at"), weight(i).alias("weight")))

    each = tiles.withColumn("r", F.explode(spread("tile_row", _size(height)))).withColumn("c", F.explode(spread("tile_col", _size(width))))
    return each.groupBy("frame_id", F.col("r.at").alias("row"), F.col("c.at").alias("col")).agg(F.sum(F.col("median") * F.col("r.weight") * F.col("c.weight")).alias("background"))


def remove_background(pixels: DataFrame, estimate: DataFrame) -> DataFrame:
    return pixels.join(estimate, PIXEL).select(*PIXEL, F.greatest(F.col("value") - F.col("background"), F.lit(0.0)).alias("value"))


def noise(pixels: DataFrame, passes: bool = False) -> DataFrame:
    """frame_id, sigma: 1.4826 times the median deviation; where that is 0 the spread of pixels up to the ninth decile; then of those under the median of pixels over 0; then
    a tenth of the whole spread, 1 at least. passes: medians and deciles come from selection.quantiles(), for frames whose pixels are too many for one task; pixels are then read some ten times."""
    v = F.col("value")
    if passes:
        own = lambda df, column, *p: quantiles(df, ["frame_id"], column, list(p))
        parts = own(pixels, "value", 0.5, 0.9).select("frame_id", F.col("quantiles")[0].alias("middle"), F.col("quantiles")[1].alias("p90"))
        over = own(pixels.where(v > 0), "value", 0.5).select("frame_id", F.col("quantiles")[0].alias("middle_over"))
        one = staged(pixels.groupBy("frame_id").agg(F.stddev_pop("value").alias("spread")).join(parts, "frame_id").join(over, "frame_id", "left"), "middles")
        off = pixels.join(one, "frame_id").select("frame_id", F.abs(v - F.col("middle")).alias("off"))
        mad = own(off, "off", 0.5).select("frame_id", F.col("quantiles")[0].alias("mad"))
    else:
        one = pixels.groupBy("frame_id").agg(F.median("value").alias("middle"), F.percentile("value", F.lit(0.9)).alias("p90"), F.stddev_pop("value").alias("spread"), F.median(F.when(v > 0, v)).alias("middle_over"))
        mad = None
    two = pixels.join(one, "frame_id").groupBy("frame_id").agg(
        *([] if passes else [F.median(F.abs(v - F.col("middle"))).alias("mad")]),
        F.stddev_pop(F.when(v <= F.col("p90"), v)).alias("low"),
        F.count(F.when(v > 0, 1)).alias("n_over"),
        F.count(F.when((v > 0) & (v < F.col("middle_over")), 1)).alias("n_low_over"),
        F.stddev_pop(F.when((v > 0) & (v < F.col("middle_over")), v)).alias("low_over"),
        F.first("p90").alias("p90"), F.first("spread").alias("spread"),
    )
    two = two.join(mad, "frame_id") if passes else two
    tiny = 1e-10
    sigma = (
        F.when(1.4826 * F.col("mad") > tiny, 1.4826 * F.col("mad"))
        .when((F.col("p90") > 0) & (F.col("low") > tiny), F.col("low"))
        .when((F.col("n_over") > 100) & (F.col("n_low_over") > 10) & (F.col("low_over") > tiny), F.col("low_over"))
        .otherwise(F.greatest(F.col("spread") / 10, F.lit(1.0)))
    )
    return two.select("frame_id", sigma.alias("sigma"))


def mask(pixels: DataFrame, sigmas: DataFrame, d: Detection = Detection()) -> DataFrame:
    """Pixels over the threshold, with the frame's sigma."""
    return pixels.join(sigmas, "frame_id").where(F.col("value") > d.sigma * F.greatest("sigma", F.lit(1.0)))


_LABELLED = "frame_id long, row int, col int, value double, sigma double, label long"


def _labelled(pixels: pd.DataFrame) -> pd.DataFrame:
    """Pixels of one frame with the least row * 2**20 + col of those that they are connected with, among those given."""
    key = pixels["row"].to_numpy() * (1 << 20) + pixels["col"].to_numpy()
    order = np.argsort(key)
    pixels, key = pixels.iloc[order], key[order]
    root = np.arange(len(key))
    links = []
    for step in (1, 1 << 20):
        at = np.searchsorted(key, key + step)
        here = np.flatnonzero((at < len(key)) & (key[np.minimum(at, len(key) - 1)] == key + step))
        links.append((here, at[here]))
    a, b = (np.concatenate(x) for x in zip(*links, strict=True))
    while True:  # every round, linked pixels take the lower of their roots, and roots are followed to their own
        low = np.minimum(root[a], root[b])
        before = root.copy()
        np.minimum.at(root, root[a], low)
        np.minimum.at(root, root[b], low)
        root = root[root]
        if (root == before).all():
            break
    return pixels.assign(label=key[root])


def label(pixels: DataFrame) -> DataFrame:
    """frame_id, row, col, value, sigma, label: connected pixels (over their four sides) share a label, the least row * 2**20 + col among them. A frame's masked pixels
    form one group; label_by_tiles() is for sensors too large for that."""
    return pixels.select(*PIXEL, "value", "sigma").groupBy("frame_id").applyInPandas(_labelled, _LABELLED)


def label_by_tiles(pixels: DataFrame, side: int = 1024) -> DataFrame:
    """The rows of label(), with side * side pixels at most in a task, however large the frames: tiles are labelled by themselves, pixels on either side of a tile's border link their labels, and a label becomes the least
    of those that links connect it with. Links are between labels, not pixels; their components are found by joins."""
    tile = [F.floor(F.col(k) / side).cast("int").alias(f"tile_{k}") for k in ("row", "col")]
    own = lambda part: _labelled(part[[*PIXEL, "value", "sigma"]])
    local = staged(pixels.select(*PIXEL, "value", "sigma", *tile).groupBy("frame_id", "tile_row", "tile_col").applyInPandas(own, _LABELLED), "labels")
    links = None
    for k in ("row", "col"):
        last = local.where(F.col(k) % side == side - 1).withColumn(k, F.col(k) + 1).select(*PIXEL, F.col("label").alias("a"))
        first = local.where(F.col(k) % side == 0).select(*PIXEL, F.col("label").alias("b"))
        met = last.join(first, PIXEL).select("frame_id", "a", "b").distinct()
        links = met if links is None else links.unionByName(met)
    roots = components.components(staged(links, "borders"), ["frame_id"]).select("frame_id", F.col("node").alias("label"), "root")
    return local.join(roots, ["frame_id", "label"], "left").select(*PIXEL, "value", "sigma", F.coalesce("root", "label").alias("label"))


def blobs(labelled: DataFrame) -> DataFrame:
    """One row for each label: area, flux, peak, centre of mass (u: column, v: row) and eccentricity of its pixels' places."""
    r, c, v = F.col("row").cast("double"), F.col("col").cast("double"), F.col("value")
    out = labelled.groupBy("frame_id", "label").agg(
        F.count("*").alias("area"), F.sum(v).alias("flux"), F.max(v).alias("peak"), (F.sum(v * c) / F.sum(v)).alias("u"), (F.sum(v * r) / F.sum(v)).alias("v"),
        F.var_samp(r).alias("rr"), F.var_samp(c).alias("cc"), F.covar_samp(r, c).alias("rc"), F.first("sigma").alias("sigma"),
    )
    half, root = (F.col("rr") + F.col("cc")) / 2, F.sqrt(F.pow((F.col("rr") - F.col("cc")) / 2, 2) + F.col("rc") * F.col("rc"))
    # Rounding leaves a line's smaller eigenvalue a little off 0, which counts as 0.
    shape = F.when(F.col("area") < 4, 0.0).when(half - root > 1e-12 * half, F.sqrt(1 - (half - root) / (half + root))).otherwise(1.0)
    return out.withColumn("eccentricity", shape).drop("rr", "cc", "rc")


def verdicts(found: DataFrame, d: Detection = Detection()) -> DataFrame:
    """Adds reason: why a blob is no star; null for stars."""
    reason = F.when(F.col("area") < d.least_area, "too_small").when(F.col("area") > d.most_area, "too_large").when(F.col("eccentricity") > d.eccentricity, "elongated").when(F.col("flux") <= 0, "faint")
    return found.withColumn("reason", reason)


def detections(judged: DataFrame, d: Detection = Detection()) -> DataFrame:
    """frame_id, label, u, v, flux, mag, peak, area, quality, snr of the stars, and star_index by brightness."""
    snr = signal_to_noise(F.col("peak"), F.col("sigma"))
    stars = judged.where("reason IS NULL").select("frame_id", "label", "u", "v", "flux", instrumental_magnitude(F.col("flux")).alias("mag"), "peak", "area", quality(F.col("peak"), snr, d.sigma, d.saturation).alias("quality"), snr.alias("snr"))
    return stars.withColumn("star_index", F.row_number().over(Window.partitionBy("frame_id").orderBy("mag", "label")) - 1)


def rendered(stars: DataFrame, height: int, width: int, p: Photometry = Photometry()) -> DataFrame:
    """Pixels of stars (frame_id, star, u, v, flux): each spreads its flux over a window of four widths, scaled to sum up to it within the part that lies on the sensor."""
    half = math.ceil(4 * p.psf)
    row, col = F.col("v").cast("int"), F.col("u").cast("int")
    span = lambda at, size: F.sequence(F.greatest(at - half, F.lit(0)), F.least(at + half, F.lit(size - 1)))
    hits = (row + half >= 0) & (row - half < height) & (col + half >= 0) & (col - half < width)
    spread = stars.where(hits).withColumn("row", F.explode(span(row, height))).withColumn("col", F.explode(span(col, width)))
    spread = spread.withColumn("g", F.exp(-(F.pow(F.col("col") - F.col("u"), 2) + F.pow(F.col("row") - F.col("v"), 2)) / (2 * p.psf**2)))
    spread = spread.withColumn("value", F.col("g") * F.col("flux") / F.sum("g").over(Window.partitionBy("frame_id", "star")))
    return spread.groupBy(*PIXEL).agg(F.sum("value").alias("value"))


def with_noise(pixels: DataFrame, seed: int, p: Photometry = Photometry()) -> DataFrame:
    """Shot, dark and read noise. A pixel's draw depends on the seed and its place alone, so lost partitions come back the same."""

    @F.pandas_udf("double")
    def draw(value: pd.Series, key: pd.Series) -> pd.Series:
        out = np.empty(len(value))
        for k, (v, s) in enumerate(zip(value.to_numpy(), key.to_numpy(), strict=True)):
            rng = np.random.default_rng(abs(int(s)))
            out[k] = rng.poisson(max((v + p.sky) * p.gain, 0)) / p.gain + rng.poisson(p.dark * p.exposure) + rng.normal(0, p.read_noise)
        return pd.Series(np.clip(out, 0, p.most))

    return pixels.select(*PIXEL, draw(F.col("value"), F.xxhash64(F.lit(seed), *PIXEL)).alias("value"))


def gaussian_centroid(cut: np.ndarray, rounds: int = 60) -> tuple[float, float, float, float] | None:
    """Column, row and widths of a two-dimensional Gaussian over a level, fitted by damped least squares; None for fewer than nine pixels or without a fit."""
    if cut.size < 9:
        return None
    rows, cols = np.mgrid[: cut.shape[0], : cut.shape[1]]
    weight = np.maximum(cut - cut.min(), 0)
    if weight.sum() <= 0:
        return None
    x = np.array([np.ptp(cut), (weight * cols).sum() / weight.sum(), (weight * rows).sum() / weight.sum(), 1.5, 1.5, cut.min()], float)

    def model(x):
        a, c, r, sc, sr, level = x
        e = np.exp(-((cols - c) ** 2) / (2 * sc * sc) - (rows - r) ** 2 / (2 * sr * sr))
        slope = np.stack([e, a * e * (cols - c) / sc**2, a * e * (rows - r) / sr**2, a * e * (cols - c) ** 2 / sc**3, a * e * (rows - r) ** 2 / sr**3, np.ones_like(e)])
        return (a * e + level - cut).ravel(), slope.reshape(6, -1).T

    damping, (miss, slope) = 1e-3, model(x)
    for _ in range(rounds):
        normal = slope.T @ slope
        try:
            step = np.linalg.solve(normal + damping * np.diag(np.diag(normal) + 1e-12), -slope.T @ miss)
        except np.linalg.LinAlgError:
            return None
        new = x + step
        new[3:5] = np.clip(new[3:5], 0.3, 10)
        other = model(new)
        if (other[0] ** 2).sum() < (miss**2).sum():
            done = np.abs(step).max() < 1e-10
            x, (miss, slope), damping = new, other, damping / 3
            if done:
                break
        else:
            damping *= 4
            if damping > 1e12:
                break
    inside = -0.5 <= x[1] <= cut.shape[1] - 0.5 and -0.5 <= x[2] <= cut.shape[0] - 0.5
    return (float(x[1]), float(x[2]), float(abs(x[3])), float(abs(x[4]))) if inside and np.isfinite(x).all() else None


def centroids(pixels: DataFrame, stars: DataFrame, half: int = 5) -> DataFrame:
    """stars with fit_u and fit_v: a Gaussian fitted to the pixels around the centre of mass, which stays where there is no fit. Pixels meet stars by an equality of
    frame and row, so each star's window, not the frame, is a group; Python gets batches of windows."""
    near = stars.select("frame_id", "label", "u", "v", F.explode(F.sequence(F.round("v").cast("int") - half, F.round("v").cast("int") + half)).alias("row"))
    cut = near.join(pixels, ["frame_id", "row"]).where(F.abs(F.col("col") - F.round("u")) <= half)

    @F.pandas_udf("fit_u double, fit_v double")
    def fit(rows: pd.Series, cols: pd.Series, values: pd.Series, u: pd.Series, v: pd.Series) -> pd.DataFrame:
        out = np.column_stack([u, v]).astype(float)
        for k, (r, c, value) in enumerate(zip(rows, cols, values, strict=True)):
            grid = np.zeros((r.max() - r.min() + 1, c.max() - c.min() + 1))
            grid[r - r.min(), c - c.min()] = value
            found = gaussian_centroid(grid)
            if found:
                out[k] = found[0] + c.min(), found[1] + r.min()
        return pd.DataFrame(out, columns=["fit_u", "fit_v"])

    windows = cut.groupBy("frame_id", "label", "u", "v").agg(F.collect_list(F.struct("row", "col", "value")).alias("px"))  # (2 * half + 1)**2 pixels at most
    fitted = windows.withColumn("fit", fit("px.row", "px.col", "px.value", "u", "v")).select("frame_id", "label", "fit.fit_u", "fit.fit_v")
    return stars.join(fitted, ["frame_id", "label"], "left").withColumns({"fit_u": F.coalesce("fit_u", "u"), "fit_v": F.coalesce("fit_v", "v")})
