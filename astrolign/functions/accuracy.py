"""Errors of estimated attitudes, and the attitude record."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from astrolign.functions.geometry import Q, clamp, dot, let, pointing_to_quaternion, quaternion_angle, quaternion_to_pointing, rotate, rotation, to_euler


def wrapped(degrees: Column) -> Column:
    """A difference of right ascensions, between -180 and 180."""
    return F.when(degrees > 180, degrees - 360).when(degrees < -180, degrees + 360).otherwise(degrees)


def pointing_error(estimate: Column, truth: Column, ra: Column, dec: Column) -> Column:
    """struct of arcseconds: whole rotation, right ascension on the sky, declination."""
    def of(own: Column) -> Column:
        return F.struct((wrapped(own["ra"] - ra) * 3600 * F.cos(F.radians(dec))).alias("ra_error_arcsec"), ((own["dec"] - dec) * 3600).alias("dec_error_arcsec"), own["angle"].alias("angular_error_arcsec"))

    angle = let(F.struct(estimate.alias("e"), truth.alias("t")), lambda p: quaternion_angle(p["e"], p["t"]) * 3600)
    at = let(quaternion_to_pointing(estimate), lambda p: F.struct(p["ra"].alias("ra"), p["dec"].alias("dec"), angle.alias("angle")))
    return let(at, of)


def residual_arcsec(q: Column, inertial: dict[str, Column], body: dict[str, Column]) -> Column:
    """Angle between an observed direction and the catalogue's, turned by the attitude."""
    return F.degrees(F.acos(clamp(let(rotation(q), lambda m: dot(rotate(m, inertial), body))))) * 3600


def axis_variance(residual: Column, stars: Column) -> Column:
    """Variance about each axis in square radians."""
    return F.when((stars > 0) & (residual > 0), residual / (2 * F.when(stars > 0, stars))).otherwise(F.lit(1e-6))


def roll_of_wcs(header: Column) -> Column:
    """Degrees: from the CD matrix, else PC, else CROTA2, else 0. header: map of strings."""
    value = lambda k: F.try_element_at(header, F.lit(k)).cast("double")
    turn = lambda k: F.when(value(f"{k}1_1").isNotNull(), F.degrees(F.atan2(F.coalesce(value(f"{k}1_2"), F.lit(0.0)), value(f"{k}1_1"))))
    return F.coalesce(turn("CD"), turn("PC"), value("CROTA2"), F.lit(0.0))


def tan_centre(header: Column) -> Column:
    """struct ra, dec (degrees) of the image's centre by a header's gnomonic projection (map of strings): CRPIX, CRVAL and the CD matrix, or CDELT with PC or CROTA2. Missing keys have the values that
    the format gives them; without the image's size the reference pixel stands for the centre. Null without CRVAL."""
    value = lambda k: F.try_element_at(header, F.lit(k)).cast("double")
    given = lambda k, other: F.coalesce(value(k), F.lit(float(other)))
    turn = F.radians(given("CROTA2", 0))
    has_cd = F.greatest(*[F.when(value(f"CD{i}_{j}").isNotNull(), 1).otherwise(0) for i in (1, 2) for j in (1, 2)]) == 1
    has_pc = F.greatest(*[F.when(value(f"PC{i}_{j}").isNotNull(), 1).otherwise(0) for i in (1, 2) for j in (1, 2)]) == 1
    turned = {(1, 1): F.cos(turn), (1, 2): -F.sin(turn) * given("CDELT2", 1) / given("CDELT1", 1), (2, 1): F.sin(turn) * given("CDELT1", 1) / given("CDELT2", 1), (2, 2): F.cos(turn)}
    matrix = {(i, j): F.when(has_cd, given(f"CD{i}_{j}", 0)).when(has_pc, given(f"CDELT{i}", 1) * given(f"PC{i}_{j}", i == j)).otherwise(given(f"CDELT{i}", 1) * turned[i, j]) for i in (1, 2) for j in (1, 2)}
    # Pixels count from 1, their centres are whole numbers.
    off = [F.coalesce(value(f"NAXIS{k}") / 2 + 1 - given(f"CRPIX{k}", 0), F.lit(0.0)) for k in (1, 2)]
    plane = F.struct(*[F.radians(matrix[i, 1] * off[0] + matrix[i, 2] * off[1]).alias(k) for i, k in ((1, "xi"), (2, "eta"))], F.radians(value("CRVAL1")).alias("a"), F.radians(value("CRVAL2")).alias("d"))

    def of(p: Column) -> Column:
        far = F.cos(p["d"]) - p["eta"] * F.sin(p["d"])
        ra = F.degrees(p["a"] + F.atan2(p["xi"], far))
        return F.struct((ra - 360 * F.floor(ra / 360)).alias("ra"), F.degrees(F.atan2(F.sin(p["d"]) + p["eta"] * F.cos(p["d"]), F.sqrt(p["xi"] * p["xi"] + far * far))).alias("dec"))

    return F.when(value("CRVAL1").isNotNull() & value("CRVAL2").isNotNull(), let(plane, of))


def truth(header: Column) -> Column:
    """struct source, ra, dec, roll, quaternion: of a synthetic header, else of the centre of its WCS, else null."""
    value = lambda k: F.try_element_at(header, F.lit(k))
    number = lambda k: value(k).cast("double")

    def record(source: str, at: Column, q: Column | None = None) -> Column:
        made = lambda p: pointing_to_quaternion(p["ra"], p["dec"], p["roll"])
        return let(at, lambda p: F.struct(F.lit(source).alias("source"), p["ra"].alias("ra"), p["dec"].alias("dec"), p["roll"].alias("roll"), (made(p) if q is None else F.coalesce(q, made(p))).alias("quaternion")))

    q = F.when(number("TRUE_Q0").isNotNull(), F.struct(*[number(f"TRUE_Q{k}").alias(f"q{k}") for k in range(4)]))
    synthetic = record("synthetic", F.struct(number("TRUE_RA").alias("ra"), number("TRUE_DEC").alias("dec"), F.coalesce(number("TRUE_ROL"), F.lit(0.0)).alias("roll")), q)
    wcs = record("wcs", let(tan_centre(header), lambda c: F.struct(c["ra"].alias("ra"), c["dec"].alias("dec"), roll_of_wcs(header).alias("roll"))))
    return F.when(F.upper(value("SYNTHIMG")).isin("T", "TRUE"), synthetic).when(number("CRVAL1").isNotNull() & number("CRVAL2").isNotNull(), wcs)


def attitude_record(q: Column, stars: Column, residual: Column, method: Column, error: Column) -> Column:
    """The nested attitude result."""
    roll, pitch, yaw = to_euler(q)
    variance = axis_variance(residual, stars)
    zero = F.lit(0.0)
    rows = [F.array(*[variance if i == j else zero for j in range(3)]) for i in range(3)]
    return F.struct(
        F.array(*[q[k] for k in Q]).alias("quaternion"), F.array(roll, pitch, yaw).alias("euler_deg"), let(quaternion_to_pointing(q), lambda p: F.struct(p["ra"].alias("ra_deg"), p["dec"].alias("dec_deg"))).alias("boresight"),
        F.array(zero, zero, zero).alias("angular_velocity"), F.array(*rows).alias("covariance"), (F.degrees(F.sqrt(variance)) * 3600).alias("uncertainty_arcsec"),
        stars.alias("n_stars_used"), residual.alias("residual"), method.alias("method"), error.alias("angular_error_arcsec"),
    )


def report(record: Column) -> Column:
    """One line of text for an attitude record."""
    return F.format_string(
        "ra=%.4f dec=%.4f roll=%.4f pitch=%.4f yaw=%.4f stars=%d method=%s uncertainty=%.2f arcsec", record["boresight"]["ra_deg"], record["boresight"]["dec_deg"], record["euler_deg"][0], record["euler_deg"][1], record["euler_deg"][2], record["n_stars_used"].cast("int"), record["method"], record["uncertainty_arcsec"]
    )


def log_tag(line: Column) -> Column:
    """How a line of the log is shown. The marks."""
    has = lambda *marks: F.coalesce(*[F.when(line.contains(m), F.lit(True)) for m in marks], F.lit(False))
    return F.when(has("✓", "SUCCESS"), "ok").when(has("✗", "Error", "FAILED"), "err").when(line.startswith("─") | line.startswith("="), "hdr").otherwise("")
