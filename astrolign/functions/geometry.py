"""Directions, rotations and quaternions as Column functions. A quaternion is a struct q0..q3, scalar first, inertial to body; a vector is a dict or
struct of x, y, z. All of it stays inside whole-stage code generation."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

XYZ = ("x", "y", "z")
Q = ("q0", "q1", "q2", "q3")


def clamp(value: Column) -> Column:
    """Into -1..1, so that acos and asin never see more."""
    return F.greatest(F.least(value, F.lit(1.0)), F.lit(-1.0))


def vector(x: Column, y: Column, z: Column) -> dict[str, Column]:
    return {"x": x, "y": y, "z": z}


def fields(struct: Column, names: tuple[str, ...] = XYZ) -> dict[str, Column]:
    return {k: struct[k] for k in names}


def as_struct(parts: dict[str, Column]) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def radec_to_vector(ra: Column, dec: Column) -> dict[str, Column]:
    """Unit vector of right ascension and declination in degrees."""
    a, d = F.radians(ra), F.radians(dec)
    return vector(F.cos(d) * F.cos(a), F.cos(d) * F.sin(a), F.sin(d))


def vector_to_radec(v: dict[str, Column]) -> tuple[Column, Column]:
    """Right ascension from 0 to 360 and declination, in degrees."""
    ra = F.degrees(F.atan2(v["y"], v["x"]))
    return F.when(ra < 0, ra + 360.0).otherwise(ra), F.degrees(F.asin(clamp(v["z"])))


def dot(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return reduce(lambda s, k: s + a[k] * b[k], XYZ[1:], a["x"] * b["x"])


def cross(a: dict[str, Column], b: dict[str, Column]) -> dict[str, Column]:
    return vector(a["y"] * b["z"] - a["z"] * b["y"], a["z"] * b["x"] - a["x"] * b["z"], a["x"] * b["y"] - a["y"] * b["x"])


def norm(a: dict[str, Column]) -> Column:
    return F.sqrt(dot(a, a))


def unit(a: dict[str, Column]) -> dict[str, Column]:
    n = norm(a)
    return {k: v / n for k, v in a.items()}


def separation_rad(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Angle between unit vectors by atan2 of cross and dot product: precise for small angles too."""
    return F.atan2(norm(cross(a, b)), dot(a, b))


def separation(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.degrees(separation_rad(a, b))


def separation_acos(a: dict[str, Column], b: dict[str, Column]) -> Column:
    return F.degrees(F.acos(clamp(dot(a, b))))


M = tuple(f"r{i}{j}" for i in range(3) for j in range(3))


def let(value: Column, f) -> Column:
    """f(value) with value computed once and named, so that the expression doesn't grow with each use."""
    return F.element_at(F.transform(F.array(value), f), 1)


def matrix(rows: list[list[Column]]) -> Column:
    """struct r00..r22. Put it in a column of its own before it is used more than once."""
    return F.struct(*[c.alias(k) for k, c in zip(M, (c for row in rows for c in row), strict=True)])


def rotation(q: Column) -> Column:
    """Rotation matrix of a quaternion of any length."""
    def of(u: Column) -> Column:
        w, x, y, z = (u[k] for k in Q)
        return matrix([
            [1 - 2 * (y * y + z * z), 2 * (x * y - w * z), 2 * (x * z + w * y)],
            [2 * (x * y + w * z), 1 - 2 * (x * x + z * z), 2 * (y * z - w * x)],
            [2 * (x * z - w * y), 2 * (y * z + w * x), 1 - 2 * (x * x + y * y)],
        ])

    return let(normalised(q, False), of)


def rotate(m: Column, v: dict[str, Column]) -> dict[str, Column]:
    return vector(*[m[f"r{i}0"] * v["x"] + m[f"r{i}1"] * v["y"] + m[f"r{i}2"] * v["z"] for i in range(3)])


def quaternion_of(m: Column) -> Column:
    """Unit quaternion (struct) of a rotation matrix with q0 >= 0: of the four expressions, the one with the safest divisor."""

    def of(m: Column) -> Column:
        r = [[m[f"r{i}{j}"] for j in range(3)] for i in range(3)]
        d = [r[k][k] for k in range(3)]
        trace = d[0] + d[1] + d[2]

        def case(k: int | None) -> Column:
            if k is None:
                s = 2 * F.sqrt(trace + 1)
                return as_struct({"q0": s / 4, "q1": (r[2][1] - r[1][2]) / s, "q2": (r[0][2] - r[2][0]) / s, "q3": (r[1][0] - r[0][1]) / s})
            i, j = (k + 1) % 3, (k + 2) % 3
            s = 2 * F.sqrt(1 + d[k] - d[i] - d[j])
            own = {"q0": (r[j][i] - r[i][j]) / s, Q[k + 1]: s / 4, Q[i + 1]: (r[k][i] + r[i][k]) / s, Q[j + 1]: (r[k][j] + r[j][k]) / s}
            return as_struct({q: own[q] for q in Q})

        return F.when(trace > 0, case(None)).when((d[0] > d[1]) & (d[0] > d[2]), case(0)).when(d[1] > d[2], case(1)).otherwise(case(2))

    return normalised(let(m, of))


def normalised(q: Column, turn: bool = True) -> Column:
    """To length 1 and, unless turn is False, q0 >= 0."""

    def of(q: Column) -> Column:
        n = F.sqrt(sum((q[k] * q[k] for k in Q[1:]), q["q0"] * q["q0"]))
        n = n * F.when(q["q0"] < 0, -1.0).otherwise(1.0) if turn else n
        return F.struct(*[(q[k] / n).alias(k) for k in Q])

    return let(q, of)


def multiply(a: Column, b: Column) -> Column:
    """Hamilton product: scalar part minus the dot product; vector parts scaled plus the cross product."""
    av, bv = vector(a["q1"], a["q2"], a["q3"]), vector(b["q1"], b["q2"], b["q3"])
    c = cross(av, bv)
    own = [a["q0"] * b["q0"] - dot(av, bv)] + [a["q0"] * bv[k] + b["q0"] * av[k] + c[k] for k in XYZ]
    return F.struct(*[v.alias(k) for k, v in zip(Q, own, strict=True)])


def conjugate(q: Column) -> Column:
    return F.struct(q["q0"].alias("q0"), *[(-q[k]).alias(k) for k in Q[1:]])


def quaternion_angle(a: Column, b: Column) -> Column:
    """Degrees between two attitudes; lengths are taken as they are."""
    scalar = a["q0"] * b["q0"] + a["q1"] * b["q1"] + a["q2"] * b["q2"] + a["q3"] * b["q3"]
    return F.degrees(2 * F.acos(clamp(F.abs(scalar))))


def to_euler(q: Column) -> tuple[Column, Column, Column]:
    """Roll, pitch, yaw in degrees (rotations about z, then y, then x)."""
    w, x, y, z = (q[k] for k in Q)
    roll = F.atan2(2 * (w * x + y * z), 1 - 2 * (x * x + y * y))
    pitch = F.asin(clamp(2 * (w * y - z * x)))
    yaw = F.atan2(2 * (w * z + x * y), 1 - 2 * (y * y + z * z))
    return F.degrees(roll), F.degrees(pitch), F.degrees(yaw)


def from_euler(roll: Column, pitch: Column, yaw: Column) -> Column:
    """The product of three half-angle quaternions about z, y and x."""
    half = lambda angle, at: F.struct(F.cos(F.radians(angle) / 2).alias("q0"), *[(F.sin(F.radians(angle) / 2) if k == at else F.lit(0.0)).alias(k) for k in Q[1:]])
    return normalised(let(multiply(half(yaw, "q3"), half(pitch, "q2")), lambda q: multiply(q, half(roll, "q1"))))


def pointing_matrix(ra: Column, dec: Column, roll: Column) -> Column:
    """Inertial-to-body matrix of a camera whose z axis looks at (ra, dec); x is level with the celestial equator, or with the y-z plane within 2.6 degrees of a pole."""

    def of(z: Column) -> Column:
        polar = F.abs(z["z"]) > 0.999
        up = vector(F.when(polar, 1.0).otherwise(0.0), F.lit(0.0), F.when(polar, 0.0).otherwise(1.0))
        level = let(as_struct(cross(up, fields(z))), lambda v: as_struct(unit(fields(v))))
        return let(level, lambda x: let(as_struct(cross(fields(z), fields(x))), lambda y: turned(x, y, z)))

    def turned(x: Column, y: Column, z: Column) -> Column:
        return matrix([[z["c"] * x[k] - z["s"] * y[k] for k in XYZ], [z["s"] * x[k] + z["c"] * y[k] for k in XYZ], [z[k] for k in XYZ]])

    axis = radec_to_vector(ra, dec)
    return let(as_struct({**axis, "c": F.cos(F.radians(roll)), "s": F.sin(F.radians(roll))}), of)


def pointing_to_quaternion(ra: Column, dec: Column, roll: Column) -> Column:
    return quaternion_of(pointing_matrix(ra, dec, roll))


def quaternion_to_pointing(q: Column) -> Column:
    """struct ra, dec: where the camera's z axis looks, the matrix's third row."""

    def of(m: Column) -> Column:
        ra, dec = vector_to_radec(vector(m["r20"], m["r21"], m["r22"]))
        return F.struct(ra.alias("ra"), dec.alias("dec"))

    return let(rotation(q), of)
