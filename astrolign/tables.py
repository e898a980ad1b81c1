"""Sky data that the registered queries derive from the driver's tables, in Spark and in DuckDB SQL alike.

orders: catalogue stars; customer: a tenth as many, for graphs of neighbourhoods; nation: camera directions whose stars are identified; supplier: camera directions that only look;
events and supplier: 64 x 64 pixel images with noise and stars; embeddings: star embeddings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolign.config import Matching
from astrolign.functions.geometry import pointing_matrix, rotate
from astrolign.operators import image, voting
from astrolign.operators.joins import brightest_in_cone, within_cone
from astrolign.sources import catalogue as sources
from astrolign.sources.catalogue import CATALOGUE_SQL, FRAMES_SQL, MANY_FRAMES_SQL, PATCH_SQL

SIDE = 64
#: Degrees around a frame's direction within which its stars count as detected.
FIELD = 10.0


def catalogue(spark: SparkSession, d: str) -> DataFrame:
    return sources.from_orders(spark, d)


def patch_stars(spark: SparkSession, d: str) -> DataFrame:
    return sources.from_customers(spark, d)


def frames(spark: SparkSession, d: str) -> DataFrame:
    return sources.frames_from_nations(spark, d)


def many_frames(spark: SparkSession, d: str) -> DataFrame:
    return sources.frames_from_suppliers(spark, d)


def sky_stars(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, star, star_index, x, y, z (body), mag, snr: the catalogue's stars around each frame's direction."""
    return seen_stars(frames(spark, d), spark, d)


def seen_stars(directions: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    return voting.ranked(_seen(within_cone(_turned(directions), catalogue(spark, d).select(*_STAR), FIELD)))


def brightest_stars(directions: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    """seen_stars() of which only each frame's brightest, as many as voting.selected() takes, are looked for: all the stars that many frames see grow with the square of the tables."""
    return _seen(brightest_in_cone(_turned(directions), catalogue(spark, d).select(*_STAR), FIELD, Matching().top), "star_index")


_STAR = ["hip", "x", "y", "z", "vmag"]


def _turned(directions: DataFrame) -> DataFrame:
    return directions.withColumn("m", pointing_matrix(F.col("ra"), F.col("dec"), F.col("roll")))


def _seen(near: DataFrame, *more: str) -> DataFrame:
    body = rotate(F.col("m"), {k: F.col(k) for k in "xyz"})
    return near.select("frame_id", F.col("hip").alias("star"), *[v.alias(k) for k, v in body.items()], F.col("vmag").alias("mag"), (20 - F.col("vmag")).alias("snr"), F.col("hip").alias("label"), *more)


def image_stars(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("s_suppkey")
    return spark.read.parquet(f"{d}/supplier.parquet").select(F.floor(k * 100 / SIDE**2).alias("frame_id"), k.alias("star"), (F.pmod(k * 7919, F.lit(6400)) / 100).alias("u"), (F.pmod(k * 104729, F.lit(6400)) / 100).alias("v"), (F.col("s_acctbal") + 1001).alias("flux"))


def pixels(spark: SparkSession, d: str) -> DataFrame:
    """frame_id, row, col, value: noise from events, stars from suppliers. Spark judges the light by the size of the suppliers, which a hundred times as many pixels come from, and would broadcast it: a merge is asked for."""
    n = F.col("event_id")
    noise = spark.read.parquet(f"{d}/events.parquet").select(F.floor(n / SIDE**2).alias("frame_id"), F.floor(n % SIDE**2 / SIDE).cast("int").alias("row"), (n % SIDE).cast("int").alias("col"), (F.col("value") / 10).alias("noise"))
    light = image.rendered(image_stars(spark, d), SIDE, SIDE)
    return noise.join(light.hint("merge"), image.PIXEL, "left").select(*image.PIXEL, (F.col("noise") + F.coalesce("value", F.lit(0.0))).alias("value"))


def field_frame(spark: SparkSession, d: str) -> DataFrame:
    """row, col, dark, flat of the sensor: one value for each pixel, from the events that fill a frame."""
    n = F.col("event_id") % SIDE**2
    place = spark.read.parquet(f"{d}/events.parquet").select(F.floor(n / SIDE).cast("int").alias("row"), (n % SIDE).cast("int").alias("col")).distinct()
    return place.withColumns({"dark": F.pmod(F.col("row") * 31 + F.col("col") * 17, F.lit(7)) / 10, "flat": 0.8 + F.pmod(F.col("row") * 13 + F.col("col") * 7, F.lit(41)) / 100})


def masked(spark: SparkSession, d: str) -> DataFrame:
    """Pixels over the threshold of 2 sigma, which the made noise needs for blobs of some size."""
    from astrolign.config import Detection

    p = pixels(spark, d)
    return image.mask(p, image.noise(p), Detection(sigma=2.0))


ROTATION_SQL = """axes AS (SELECT *, cos(radians(dec)) * cos(radians(ra)) AS zx, cos(radians(dec)) * sin(radians(ra)) AS zy, sin(radians(dec)) AS zz FROM frames),
ups AS (SELECT *, CASE WHEN abs(zz) > 0.999 THEN 0.0 ELSE -zy END AS ux, CASE WHEN abs(zz) > 0.999 THEN -zz ELSE zx END AS uy, CASE WHEN abs(zz) > 0.999 THEN zy ELSE 0.0 END AS uz FROM axes),
xs AS (SELECT *, ux / sqrt(ux*ux + uy*uy + uz*uz) AS xx, uy / sqrt(ux*ux + uy*uy + uz*uz) AS xy, uz / sqrt(ux*ux + uy*uy + uz*uz) AS xz FROM ups),
ys AS (SELECT *, zy*xz - zz*xy AS yx, zz*xx - zx*xz AS yy, zx*xy - zy*xx AS yz, cos(radians(roll)) AS co, sin(radians(roll)) AS si FROM xs),
rot AS (SELECT frame_id, ra, dec, roll, co*xx - si*yx AS r00, co*xy - si*yy AS r01, co*xz - si*yz AS r02, si*xx + co*yx AS r10, si*xy + co*yy AS r11, si*xz + co*yz AS r12, zx AS r20, zy AS r21, zz AS r22 FROM ys)"""

_NEAR_SQL = f"""seen AS (SELECT f.frame_id, c.hip AS star, r00*x + r01*y + r02*z AS bx, r10*x + r11*y + r12*z AS by_, r20*x + r21*y + r22*z AS bz, c.vmag AS mag, 20 - c.vmag AS snr
    FROM rot f JOIN cat c ON r20*x + r21*y + r22*z >= cos(radians({FIELD})))"""

SEEN_SQL = f"{CATALOGUE_SQL},\n{FRAMES_SQL},\n{ROTATION_SQL},\n{_NEAR_SQL}"

STARS_SQL = """stars AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY mag, star) - 1 AS star_index, count(*) OVER (PARTITION BY frame_id) AS n FROM seen),
used AS (SELECT * FROM stars WHERE n >= 4 AND star_index < 15)"""

SKY_SQL = f"{SEEN_SQL},\n{STARS_SQL}"

STARS_OF_FRAMES_SQL = f"{_NEAR_SQL},\n{STARS_SQL}"

MANY_SKY_SQL = f"{CATALOGUE_SQL},\n{MANY_FRAMES_SQL},\n{ROTATION_SQL},\n{_NEAR_SQL},\n{STARS_SQL}"

MANY_SQL = f"{CATALOGUE_SQL},\n{MANY_FRAMES_SQL},\n{ROTATION_SQL}"

PAIRS_SQL = """pair AS (SELECT a, b, degrees(acos(greatest(-1.0, least(1.0, d)))) AS ang FROM (SELECT s.hip AS a, t.hip AS b, s.x*t.x + s.y*t.y + s.z*t.z AS d FROM cat s JOIN cat t ON s.hip < t.hip)
    WHERE d BETWEEN cos(radians(20.0)) AND cos(radians(0.1)))"""


def angle_sql(a: str, b: str, names: tuple[str, str, str] = ("bx", "by_", "bz")) -> str:
    """Degrees between the vectors of two aliases by cross and dot product."""
    (ax, ay, az), (bx, by, bz) = ([f"{t}.{n}" for n in names] for t in (a, b))
    return f"degrees(atan2(sqrt(pow({ay}*{bz} - {az}*{by}, 2) + pow({az}*{bx} - {ax}*{bz}, 2) + pow({ax}*{by} - {ay}*{bx}, 2)), {ax}*{bx} + {ay}*{by} + {az}*{bz}))"


VOTES_SQL = f"""obs AS (SELECT s.frame_id, s.star_index AS i, t.star_index AS j, {angle_sql("s", "t")} AS obs FROM used s JOIN used t ON s.frame_id = t.frame_id AND s.star_index < t.star_index),
probe AS (SELECT *, unnest(range(floor(obs / 0.01)::BIGINT - 1, floor(obs / 0.01)::BIGINT + 2)) AS bucket FROM obs),
hit AS (SELECT frame_id, i, j, a, b, obs - ang AS off FROM probe JOIN (SELECT *, floor(ang / 0.01)::BIGINT AS bucket FROM pair) USING (bucket) WHERE abs(obs - ang) <= 0.01),
spoken AS (SELECT frame_id, i AS star_index, a AS hip FROM hit UNION ALL SELECT frame_id, j, b FROM hit UNION ALL SELECT frame_id, i, b FROM hit UNION ALL SELECT frame_id, j, a FROM hit),
counted AS (SELECT frame_id, star_index, hip, count(*) AS votes FROM spoken GROUP BY ALL),
led AS (SELECT *, row_number() OVER w AS rn, lead(votes) OVER w AS second FROM counted WINDOW w AS (PARTITION BY frame_id, star_index ORDER BY votes DESC, hip)),
cand AS (SELECT frame_id, star_index, hip, votes, CASE WHEN second IS NULL THEN 'infinity'::DOUBLE ELSE votes / greatest(second, 1) END AS ratio FROM led
    WHERE rn = 1 AND (second IS NULL OR (votes >= 3 AND (votes >= 1.5 * second OR votes - second >= 5)))),
full_ AS (SELECT d.*, s.bx, s.by_, s.bz, c.x, c.y, c.z FROM cand d JOIN used s USING (frame_id, star_index) JOIN cat c USING (hip)),
scored AS (SELECT s.frame_id, s.star_index, s.hip, s.votes, s.ratio, avg(CASE WHEN abs({angle_sql("s", "t")} - {angle_sql("s", "t", ("x", "y", "z"))}) <= 0.05 THEN 1.0 ELSE 0.0 END) AS confidence
    FROM full_ s JOIN full_ t ON s.frame_id = t.frame_id AND s.star_index <> t.star_index GROUP BY ALL),
strict AS (SELECT *, count(*) FILTER (WHERE confidence >= 0.4 AND ratio > 1.1) OVER (PARTITION BY frame_id) AS k FROM scored),
matched AS (SELECT frame_id, star_index, hip, votes, ratio, confidence FROM strict WHERE CASE WHEN k >= 3 THEN confidence >= 0.4 AND ratio > 1.1 ELSE confidence >= 0.3 END)"""

IMAGE_SQL = """lamp AS (SELECT s_suppkey * 100 // 4096 AS frame_id, s_suppkey AS star, (s_suppkey * 7919 % 6400) / 100 AS u, (s_suppkey * 104729 % 6400) / 100 AS v, s_acctbal + 1001 AS flux FROM supplier),
lit_rows AS (SELECT *, unnest(range(greatest(floor(v)::INT - 5, 0), least(floor(v)::INT + 5, 63) + 1)) AS r FROM lamp),
lit AS (SELECT *, unnest(range(greatest(floor(u)::INT - 5, 0), least(floor(u)::INT + 5, 63) + 1)) AS c FROM lit_rows),
glow AS (SELECT *, exp(-(pow(c - u, 2) + pow(r - v, 2)) / (2 * 1.44)) AS g FROM lit),
glow2 AS (SELECT frame_id, r, c, g * flux / sum(g) OVER (PARTITION BY frame_id, star) AS value FROM glow),
light AS (SELECT frame_id, r, c, sum(value) AS value FROM glow2 GROUP BY ALL),
dots AS (SELECT event_id // 4096 AS frame_id, event_id % 4096 // 64 AS r, event_id % 64 AS c, value / 10 AS noise FROM events),
px AS (SELECT frame_id, r, c, noise + coalesce(value, 0) AS value FROM dots LEFT JOIN light USING (frame_id, r, c)),
fixed AS (SELECT DISTINCT r, c, (r * 31 + c * 17) % 7 / 10 AS dark, 0.8 + (r * 13 + c * 7) % 41 / 100 AS flat FROM dots)"""

NOISE_SQL = """one AS (SELECT frame_id, median(value) AS mid, quantile_cont(value, 0.9) AS p90, stddev_pop(value) AS spread, median(value) FILTER (WHERE value > 0) AS midover FROM px GROUP BY frame_id),
two AS (SELECT frame_id, median(abs(value - mid)) AS mad, stddev_pop(value) FILTER (WHERE value <= p90) AS low, count(*) FILTER (WHERE value > 0) AS nover, count(*) FILTER (WHERE value > 0 AND value < midover) AS nlow,
    stddev_pop(value) FILTER (WHERE value > 0 AND value < midover) AS lowover, any_value(p90) AS p90, any_value(spread) AS spread FROM px JOIN one USING (frame_id) GROUP BY frame_id),
sig AS (SELECT frame_id, CASE WHEN 1.4826 * mad > 1e-10 THEN 1.4826 * mad WHEN p90 > 0 AND low > 1e-10 THEN low WHEN nover > 100 AND nlow > 10 AND lowover > 1e-10 THEN lowover ELSE greatest(spread / 10, 1.0) END AS sigma FROM two),
masked AS (SELECT frame_id, r, c, value, sigma FROM px JOIN sig USING (frame_id) WHERE value > 2.0 * greatest(sigma, 1.0))"""

BLOBS_SQL = """reach AS (SELECT frame_id, r, c, r * 1048576 + c AS l FROM masked
    UNION SELECT m.frame_id, m.r, m.c, w.l FROM reach w JOIN masked m ON m.frame_id = w.frame_id AND abs(m.r - w.r) + abs(m.c - w.c) = 1),
labelled AS (SELECT m.*, l FROM masked m JOIN (SELECT frame_id, r, c, min(l) AS l FROM reach GROUP BY ALL) USING (frame_id, r, c)),
shape AS (SELECT frame_id, l, count(*) AS area, sum(value) AS flux, max(value) AS peak, sum(value * c) / sum(value) AS u, sum(value * r) / sum(value) AS v, (var_samp(r) + var_samp(c)) / 2 AS half,
    sqrt(pow((var_samp(r) - var_samp(c)) / 2, 2) + pow(covar_samp(r, c), 2)) AS root, any_value(sigma) AS sigma FROM labelled GROUP BY ALL),
blob AS (SELECT frame_id, l, area, flux, peak, u, v, sigma, CASE WHEN area < 4 THEN 0.0 WHEN half - root > 1e-12 * half THEN sqrt(1 - (half - root) / (half + root)) ELSE 1.0 END AS ecc FROM shape),
judged AS (SELECT *, CASE WHEN area < 5 THEN 'too_small' WHEN area > 225 THEN 'too_large' WHEN ecc > 0.6 THEN 'elongated' WHEN flux <= 0 THEN 'faint' END AS reason FROM blob),
found AS (SELECT *, -2.5 * log10(flux) AS mag, peak / greatest(sigma, 1.0) AS snr FROM judged WHERE reason IS NULL)"""


def with_sql(*parts: str, recursive: bool = False) -> str:
    return ("WITH RECURSIVE " if recursive else "WITH ") + ",\n".join(parts[:-1]) + "\n" + parts[-1]
