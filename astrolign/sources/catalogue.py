"""The star catalogue: reading, cleaning, checking, the pair table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from astrolign.functions.geometry import radec_to_vector
from astrolign.sources.shared import staged

CSV_SCHEMA = "HIP long, RA_deg double, Dec_deg double, Vmag double"
#: Stars that a catalogue must hold within a degree.
KNOWN = [(32349, "Sirius", 101.3, -16.7, -1.46), (30438, "Canopus", 95.99, -52.7, -0.74), (69673, "Arcturus", 213.9, 19.2, -0.05), (91262, "Vega", 279.2, 38.8, 0.03), (24436, "Rigel", 78.6, -8.2, 0.13)]


def cleaned(stars: DataFrame, limit: float = 6.5) -> DataFrame:
    """hip, ra_deg, dec_deg, vmag of complete rows brighter than the limit."""
    named = stars.select(F.col("hip").cast("long").alias("hip"), *[F.col(c).cast("double").alias(c) for c in ("ra_deg", "dec_deg", "vmag")])
    return named.na.drop().where(F.col("vmag") < limit)


def with_vectors(stars: DataFrame) -> DataFrame:
    v = radec_to_vector(F.col("ra_deg"), F.col("dec_deg"))
    return stars.withColumns(v)


def with_order(stars: DataFrame) -> DataFrame:
    """cat_idx: place by brightness, ties by hip. Stars are dealt out by ranges of that order; places count from the sizes of the ranges before, so no task sees more than its range. Operators use hip
    wherever a place isn't asked for."""
    n = int(stars.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = staged(stars.repartitionByRange(n, "vmag", "hip").withColumn("part", F.spark_partition_id()), "by-brightness")
    sizes = dealt.groupBy("part").count()  # a row for each range
    before = sizes.select("part", F.coalesce(F.sum("count").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    place = F.row_number().over(Window.partitionBy("part").orderBy("vmag", "hip")) - 1
    return dealt.join(F.broadcast(before), "part").withColumn("cat_idx", F.col("before") + place).drop("part", "before")


def read(spark: SparkSession, path: str, limit: float = 99.0) -> DataFrame:
    raw = spark.read.schema(CSV_SCHEMA).csv(path, header=True)
    return with_vectors(cleaned(raw.withColumnsRenamed({"HIP": "hip", "RA_deg": "ra_deg", "Dec_deg": "dec_deg", "Vmag": "vmag"}), limit))


def write(stars: DataFrame, path: str) -> None:
    """A CSV folder, brightest first."""
    stars.select(F.col("hip").alias("HIP"), F.col("ra_deg").alias("RA_deg"), F.col("dec_deg").alias("Dec_deg"), F.col("vmag").alias("Vmag")).orderBy("Vmag", "HIP").write.mode("overwrite").csv(path, header=True)


def known_stars(spark: SparkSession) -> DataFrame:
    """hip, name, ra_deg, dec_deg, vmag of KNOWN."""
    return spark.createDataFrame(KNOWN, "hip long, name string, ra_deg double, dec_deg double, vmag double")


def check_known(stars: DataFrame, known: DataFrame | None = None, tolerance: float = 1.0) -> DataFrame:
    """status of each known star (KNOWN unless others are given): missing, off or ok."""
    known = known_stars(stars.sparkSession) if known is None else known
    own = stars.select("hip", F.col("ra_deg").alias("own_ra"), F.col("dec_deg").alias("own_dec"))
    off = (F.abs(F.col("own_ra") - F.col("ra_deg")) > tolerance) | (F.abs(F.col("own_dec") - F.col("dec_deg")) > tolerance)
    return known.join(own, "hip", "left").select("hip", F.when(F.col("own_ra").isNull(), "missing").when(off, "off").otherwise("ok").alias("status"))


def write_pairs(pairs: DataFrame, path: str, by_bucket: bool = True) -> None:
    """The pair table. By bucket: dealt out by ranges of buckets and sorted, so that a search of few angles skips most row groups. Else as it comes, without a shuffle: for searches of so many angles that
    every bucket is read anyhow."""
    ordered = pairs.repartitionByRange("bucket").sortWithinPartitions("bucket", "ang") if by_bucket else pairs
    ordered.write.mode("overwrite").parquet(path)


def read_pairs(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema("a long, b long, ang double, bucket long").parquet(path)


def placed(k) -> tuple:
    """Right ascension and declination that integers decide, the same in any engine: a place on the sphere for each key."""
    k = F.pmod(k, F.lit(1048573))
    return 360 * F.pmod(k * k * 1000003 + k * 7919 + 17, F.lit(1048573)) / 1048573, F.degrees(F.asin(2 * F.pmod(k * k * 999983 + k * 104729 + 91, F.lit(1048573)) / 1048573 - 1))


def placed_sql(k: str) -> tuple[str, str]:
    return f"360.0::DOUBLE * (({k} * {k} * 1000003 + {k} * 7919 + 17) % 1048573) / 1048573", f"degrees(asin(2.0::DOUBLE * (({k} * {k} * 999983 + {k} * 104729 + 91) % 1048573) / 1048573 - 1))"


def _made(spark: SparkSession, path: str, key: str, vmag, limit: float) -> DataFrame:
    ra, dec = placed(F.col(key))
    return with_vectors(cleaned(spark.read.parquet(path).select(F.col(key).alias("hip"), ra.alias("ra_deg"), dec.alias("dec_deg"), vmag.alias("vmag")), limit))


def from_orders(spark: SparkSession, sf_dir: str, limit: float = 6.5) -> DataFrame:
    """A made catalogue: each order is a star, the dearer the brighter."""
    return _made(spark, f"{sf_dir}/orders.parquet", "o_orderkey", 15 - 2.5 * F.log10("o_totalprice"), limit)


def from_customers(spark: SparkSession, sf_dir: str, limit: float = 6.5) -> DataFrame:
    """A made catalogue of a tenth of the stars, for the graphs of neighbourhoods."""
    return _made(spark, f"{sf_dir}/customer.parquet", "c_custkey", 6.5 - 2.5 * F.log10((F.col("c_acctbal") + 1001) / 1000), limit)


def _made_sql(table: str, key: str, vmag: str) -> str:
    ra, dec = placed_sql("k")
    return f"""raw AS (SELECT {key} AS hip, {key} % 1048573 AS k, {vmag} AS vmag FROM {table}),
placed AS (SELECT hip, {ra} AS ra_deg, {dec} AS dec_deg, vmag FROM raw WHERE vmag IS NOT NULL AND vmag < 6.5),
cat AS (SELECT *, cos(radians(dec_deg)) * cos(radians(ra_deg)) AS x, cos(radians(dec_deg)) * sin(radians(ra_deg)) AS y, sin(radians(dec_deg)) AS z,
    row_number() OVER (ORDER BY vmag, hip) - 1 AS cat_idx FROM placed)"""


CATALOGUE_SQL = _made_sql("orders", "o_orderkey", "15 - 2.5 * log10(o_totalprice)")
PATCH_SQL = _made_sql("customer", "c_custkey", "6.5 - 2.5 * log10((c_acctbal + 1001) / 1000)")


def _frames(spark: SparkSession, path: str, key: str) -> DataFrame:
    k = F.col(key).cast("long") * 37 + 5
    ra, dec = placed(k)
    return spark.read.parquet(path).select(F.col(key).cast("long").alias("frame_id"), ra.alias("ra"), dec.alias("dec"), F.pmod(k * 13, F.lit(360)).cast("double").alias("roll"))


def frames_from_nations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """frame_id, ra, dec, roll: a camera direction for each nation."""
    return _frames(spark, f"{sf_dir}/nation.parquet", "n_nationkey")


def frames_from_suppliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A camera direction for each supplier."""
    return _frames(spark, f"{sf_dir}/supplier.parquet", "s_suppkey")


def _frames_sql(table: str, key: str) -> str:
    ra, dec = placed_sql("(k % 1048573)")
    return f"""nk AS (SELECT {key}::BIGINT AS frame_id, {key}::BIGINT * 37 + 5 AS k FROM {table}),
frames AS (SELECT frame_id, {ra} AS ra, {dec} AS dec, (k * 13 % 360)::DOUBLE AS roll FROM nk)"""


FRAMES_SQL = _frames_sql("nation", "n_nationkey")
MANY_FRAMES_SQL = _frames_sql("supplier", "s_suppkey")
