"""Attitude from matched directions: weighted sums in the plan, a 4 x 4 eigenproblem for each frame in numpy."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

RESULT = "frame_id long, q0 double, q1 double, q2 double, q3 double, residual double, residual_arcsec double, n_observations int, n_total int, mirrored boolean"
OBSERVED = ("bx", "by", "bz", "rx", "ry", "rz", "weight")


def observations(matches: DataFrame, stars: DataFrame, catalogue: DataFrame) -> DataFrame:
    """frame_id, star_index, body (b) and inertial (r) direction and weight (confidence times signal to noise) of each match."""
    s = stars.select("frame_id", "star_index", F.col("x").alias("bx"), F.col("y").alias("by"), F.col("z").alias("bz"), "snr")
    c = catalogue.select("hip", F.col("x").alias("rx"), F.col("y").alias("ry"), F.col("z").alias("rz"))
    return matches.join(s, ["frame_id", "star_index"]).join(c, "hip").withColumn("weight", F.col("confidence") * F.col("snr")).select("frame_id", "star_index", *OBSERVED)


def profile(observed: DataFrame) -> DataFrame:
    """The attitude profile of each frame: nine weighted sums of r times b, by normalised weight. One aggregate, combined before the shuffle."""
    total = F.sum("weight")
    return observed.groupBy("frame_id").agg(*[(F.sum(F.col("weight") * F.col(f"r{i}") * F.col(f"b{j}")) / total).alias(f"{i}{j}") for i in "xyz" for j in "xyz"])


def davenport(b: np.ndarray, r: np.ndarray, w: np.ndarray) -> np.ndarray:
    p = (r * (w / w.sum())[:, None]).T @ b
    k = np.empty((4, 4))
    k[0, 0] = np.trace(p)
    k[0, 1:] = k[1:, 0] = p[1, 2] - p[2, 1], p[2, 0] - p[0, 2], p[0, 1] - p[1, 0]
    k[1:, 1:] = p + p.T - np.trace(p) * np.eye(3)
    return k


def attitude(b: np.ndarray, r: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The quaternion whose rotation takes r to b best: the leading eigenvector of Davenport's matrix."""
    q = np.linalg.eigh(davenport(b, r, w))[1][:, -1]
    return q * (-1 if q[0] < 0 else 1)


#: What turns the directions of an image with reversed columns into those of the camera.
MIRROR = np.array([-1.0, 1.0, 1.0])


def losses(b: np.ndarray, r: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """How badly the best rotation fits, and the best rotation with a mirror, both from the same nine sums: Davenport's matrix changes its sign with the profile, so its least eigenvalue is to improper rotations what its
    greatest one is to proper ones. 0: an exact fit."""
    values = np.linalg.eigvalsh(davenport(b, r, w))
    return float(max(0.0, 1 - values[-1])), float(max(0.0, 1 + values[0]))


def either_hand(b: np.ndarray, r: np.ndarray, w: np.ndarray, **options) -> tuple[np.ndarray, np.ndarray, bool]:
    """consensus() of the observations as they are or mirrored, whichever more of them agree with; among equals the mirror must fit clearly better. With the third: whether it is mirrored."""
    (q, keep), (p, kept) = consensus(b, r, w, **options), consensus(b * MIRROR, r, w, **options)
    if len(keep) != len(kept):
        turned = len(kept) > len(keep)
    else:
        own, other = losses(b[keep], r[keep], w[keep])[0], losses(b[kept], r[kept], w[kept])[1]
        turned = own > 1e-11 and other < own / 4
    return (p, kept, True) if turned else (q, keep, False)


def matrix(q: np.ndarray) -> np.ndarray:
    w, v = q[0], q[1:]
    skew = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]])
    return np.eye(3) + 2 * w * skew + 2 * skew @ skew


def residuals(q: np.ndarray, b: np.ndarray, r: np.ndarray) -> np.ndarray:
    """Arcseconds between b and the turned r."""
    return np.degrees(np.arccos(np.clip((r @ matrix(q).T * b).sum(1), -1, 1))) * 3600


def consensus(b: np.ndarray, r: np.ndarray, w: np.ndarray, within: float = 60.0, trials: int = 100, seed: int | None = 42) -> tuple[np.ndarray, np.ndarray]:
    """Quaternion and indices of the observations that agree with it. Up to four observations are all used; beyond, triples are tried: drawn with `seed`, or all of
    them in order if it is None, and the first with most observations within `within` arcseconds wins."""
    n = len(b)
    keep = np.arange(n)
    if n > 4:
        rng = np.random.default_rng(seed)
        limit = max(10, min(trials, n * (n - 1) * (n - 2) // 6))
        tried = combinations(range(n), 3) if seed is None else (rng.choice(n, size=3, replace=False) for _ in range(limit))
        most = 0
        for triple in tried:
            at = np.array(triple)
            inside = np.flatnonzero(residuals(attitude(b[at], r[at], w[at]), b, r) < within)
            if len(inside) > most:
                most, keep = len(inside), inside
                if most == n:
                    break
    keep = keep if len(keep) >= 2 else np.arange(n)
    return attitude(b[keep], r[keep], w[keep]), keep


def solve(observed: DataFrame, mirrors: bool = False, **options) -> DataFrame:
    """A row of RESULT for each frame. A frame has as many rows as stars were selected, fifteen by default, so a group is small whatever the number of frames.
    mirrors: images with reversed columns, as the sky's orientation in files mostly is, are solved too; then `mirrored` is true and the attitude that of the image with its columns put right."""

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("star_index")
        b, r, w = frame[["bx", "by", "bz"]].to_numpy(), frame[["rx", "ry", "rz"]].to_numpy(), frame["weight"].to_numpy()
        q, keep, mirrored = either_hand(b, r, w, **options) if mirrors else (*consensus(b, r, w, **options), False)
        own = residuals(q, (b * MIRROR if mirrored else b)[keep], r[keep])
        return pd.DataFrame([(frame["frame_id"].iloc[0], *q, float(((own / 3600 / 57.2958) ** 2).sum()), float(np.sqrt((own**2).mean())), len(keep), len(frame), mirrored)])

    return observed.groupBy("frame_id").applyInPandas(one, RESULT)


def residual_summary(errors: DataFrame) -> DataFrame:
    """Root mean square and total (square radians) of residual_arcsec for each frame."""
    e = F.col("residual_arcsec")
    return errors.groupBy("frame_id").agg(F.sqrt(F.avg(e * e)).alias("rms_arcsec"), F.sum(F.pow(e / 3600 / 57.2958, 2)).alias("total"))

