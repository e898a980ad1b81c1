"""Joins by distance: bands of numbers, pairs of directions, nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from astrolign.functions.geometry import dot, radec_to_vector
from astrolign.operators.nearest import nearest_vectors  # noqa: F401
from astrolign.operators.sky_tree import LISTS, angle_lists, within_angle  # noqa: F401  pairs by angle belong to the joins
from astrolign.sources.shared import staged


def vec(prefix: str) -> dict[str, Column]:
    return {k: F.col(f"{prefix}.{k}") for k in ("x", "y", "z")}


def _cells(v: dict[str, Column], side: float) -> list[Column]:
    return [F.floor((v[k] + 1) / side).cast("int").alias(f"c{k}") for k in "xyz"]


def _neighbours(df: DataFrame, reach: int = 1) -> DataFrame:
    """A row for the row's own cube cell (cx, cy, cz) and each cell at most `reach` away on each axis."""
    for k in "xyz":
        df = df.withColumn("shift", F.explode(F.sequence(F.lit(-reach), F.lit(reach)))).withColumn(f"c{k}", F.col(f"c{k}") + F.col("shift")).drop("shift")
    return df


def _side(degrees: float, least: float = 2 / 1000) -> float:
    """Width of cells such that directions within the angle lie in one cell or in neighbours."""
    return max(2 * math.sin(math.radians(min(degrees, 180.0)) / 2) * (1 + 1e-9), least)


def _cell_meets(side: float, degrees: float) -> Column:
    """Whether a cube cell (cx, cy, cz) reaches the unit sphere, and a point of it may lie within the angle of `axis`, with a margin for rounding."""
    low = {k: F.col(f"c{k}") * side - 1 for k in "xyz"}
    off = lambda v, k: F.greatest(low[k] - v, v - low[k] - side, F.lit(0.0))
    far = lambda k: F.greatest(F.abs(low[k]), F.abs(low[k] + side))
    square = lambda of: sum((of(k) * of(k) for k in "yz"), of("x") * of("x"))
    on_sphere = (square(lambda k: off(F.lit(0.0), k)) <= 1 + 1e-9) & (square(far) >= 1 - 1e-9)
    chord = 2 * math.sin(math.radians(min(degrees, 180.0)) / 2)
    return on_sphere & (square(lambda k: off(F.col(f"axis.{k}"), k)) <= chord**2 * (1 + 1e-9) + 1e-9)


def within_cone(frames: DataFrame, stars: DataFrame, degrees: float) -> DataFrame:
    """Columns of frames (frame_id, ra, dec, ...) and of stars (x, y, z, ...; no names in common) for each star within the angle of a frame's direction, and cosine: of the angle between them.
    Stars stay in their own cube cell, frames go to those around theirs that come within the angle of them: an equality join, whatever the sizes. It is a merge: Spark judges frames by their file and would broadcast them, but a
    frame has a row for some ten cells. Each star travels once."""
    axis = radec_to_vector(F.col("ra"), F.col("dec"))
    side = _side(degrees)
    asked = _neighbours(frames.select("*", F.struct(*[axis[k].alias(k) for k in "xyz"]).alias("axis"), *_cells(axis, side))).where(_cell_meets(side, degrees))
    held = stars.select("*", *_cells({k: F.col(k) for k in "xyz"}, side))
    product = dot({k: F.col(f"axis.{k}") for k in "xyz"}, {k: F.col(k) for k in "xyz"})
    joined = asked.join(held.hint("merge"), ["cx", "cy", "cz"]).withColumn("cosine", product).where(F.col("cosine") >= math.cos(math.radians(min(degrees, 180.0))))
    return joined.drop("cx", "cy", "cz", "axis")


def brightest_in_cone(frames: DataFrame, stars: DataFrame, degrees: float, top: int, mag: str = "vmag", tie: str = "hip", wanted: int = 60, growth: int = 8) -> DataFrame:
    """within_cone() with star_index, by `mag` and `tie`, of each frame's `top` first stars; where a cone holds fewer, all of them. The brightest stars of the sky are looked at first, as many as put `wanted` into a cone on average;
    frames that find `top` among them are done, since whatever is left is fainter, and the others look among `growth` times as many, and at last among all. So a frame costs what it returns, not what its cone holds. Rounds are jobs."""
    share = (1 - math.cos(math.radians(min(degrees, 180.0)))) / 2
    count = stars.count()
    limits, n = [], wanted / share
    while n < count / 2:
        limits.append(n / count)
        n *= growth
    limits = stars.approxQuantile(mag, limits, min(limits) / 4) if limits else []  # which values they are decides how much is looked at, not what is found
    asked, done = frames, None
    for limit in [*limits, None]:
        near = within_cone(asked, stars if limit is None else stars.where(F.col(mag) <= limit), degrees)
        place = F.row_number().over(Window.partitionBy("frame_id").orderBy(mag, tie)) - 1
        found = near.withColumn("star_index", place).where(F.col("star_index") < top)
        if limit is not None:
            found = staged(found, "brightest")
            full = found.where(F.col("star_index") == top - 1).select("frame_id")
            found, asked = found.join(full, "frame_id", "left_semi"), staged(asked.join(full, "frame_id", "left_anti"), "asked")
        done = found if done is None else done.unionByName(found)
        if limit is not None and asked.isEmpty():
            break
    return done


def cone_search(frames: DataFrame, stars: DataFrame, degrees: float) -> DataFrame:
    """frame_id, hip, sep (degrees) of the stars whose angle from a frame's direction is `degrees` at most. Cells and cosine leave a margin; the angle itself decides."""
    found = within_cone(frames, stars.select("hip", "x", "y", "z"), min(180.0, degrees * (1 + 1e-6) + 1e-6))
    return found.select("frame_id", "hip", F.degrees(F.acos(F.greatest(F.least("cosine", F.lit(1.0)), F.lit(-1.0)))).alias("sep")).where(F.col("sep") <= degrees)


def kept_behind(joined: DataFrame, condition: Column) -> DataFrame:
    """joined.where(condition), where the condition is costly: as a generator, which is not pushed into the join below it, and so runs for the join's rows and not for its candidates."""
    return joined.withColumn("__kept", F.explode(F.when(condition, F.array(F.lit(True))))).drop("__kept")


def with_bucket(pairs: DataFrame, tolerance: float, column: str = "ang") -> DataFrame:
    return pairs.withColumn("bucket", F.floor(F.col(column) / tolerance))


def band_join(left: DataFrame, right: DataFrame, left_key: str, right_key: str, tolerance: float, width: float | None = None, own: str | None = None) -> DataFrame:
    """left x right with |left_key - right_key| <= tolerance, as an equality of buckets: each left row looks in all buckets that its band touches. right may bring its `bucket` column, of width `width`
    (the tolerance unless given); a left column named by `own` holds tolerances of their own. Columns of both sides must differ in name, but for bucket."""
    width = width or tolerance
    keyed = right if "bucket" in right.columns else with_bucket(right, width, right_key)
    reach = F.col(own) if own else F.lit(tolerance)
    first, last = (F.floor(F.col(left_key) / width + sign * (reach / width + 1e-6)) for sign in (-1, 1))
    probes = left.withColumn("bucket", F.explode(F.sequence(first, last)))
    return probes.join(keyed, "bucket").where(F.abs(F.col(left_key) - F.col(right_key)) <= reach).drop("bucket")
