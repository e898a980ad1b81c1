"""Mixing sources to target weights by Poisson replication.

A source's mean repetition rate is target * weight / (rows of the source). A hash of seed and doc_id gives a uniform number, the inverse of the
Poisson distribution turns it into a count, each row is exploded by its count, and all copies are ordered by a hash. A rate beyond PART, where exp(-rate) runs
out of a double's range, is the sum of equal parts below it, each with a uniform number of its own: sums of Poisson counts are Poisson counts, so no rate is refused (a row's copies
are numbered by 32-bit integers).
A null source is a source of its own, a null doc_id hashes as the empty string; rows that repeat a doc_id get the same count; empty tables give empty tables.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.llm.common import partitions, staged

#: The largest rate that one table inverts: exp(-700) still is a normal double.
PART = 700.0
#: Copies of a row that one array holds.
RUN = 10_000


def uniform(*parts):
    """Column: 52 bits of an md5 as a number from 0 to 1 (1 excluded)."""
    text = F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson_table(rate):
    """Column: cumulative probabilities of 0, 1, 2, ... as an array, as far as a double can tell them from 1."""
    step = lambda acc, k: F.struct((acc["p"] * rate / k).alias("p"), F.concat(acc["c"], F.array(F.element_at(acc["c"], -1) + acc["p"] * rate / k)).alias("c"))
    start = F.struct(F.exp(-rate).alias("p"), F.array(F.exp(-rate)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), F.ceil(rate + 12 * F.sqrt(rate) + 30).cast("int")), start, step, lambda acc: acc["c"])


def rates(docs: DataFrame, power: float = 0.5, target: float = 1.0, weights: dict[str, float] | None = None, source: str = "source", most: float | None = None) -> DataFrame:
    """source, n_docs, rate, parts, cumulative (of rate / parts). Weights: given by source (others get none), or rows ** power. target: size of the mix, as a
    multiple of all rows. A rate above `most`, if given, is refused."""
    counts = docs.groupBy(F.col(source).alias("source")).agg(F.count("*").alias("n_docs"))
    weight = F.pow(F.col("n_docs").cast("double"), F.lit(power))
    if weights is not None:
        weight = F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in weights.items() for x in kv]), F.coalesce("source", F.lit(""))), F.lit(0.0)) if weights else F.lit(0.0)
    counts = counts.withColumn("weight", weight)
    total = counts.agg(F.sum("weight").alias("all_weight"), F.sum("n_docs").alias("all_docs"))
    rate = F.when(F.col("all_weight") > 0, F.col("all_docs") * F.lit(float(target)) * F.col("weight") / F.col("all_weight") / F.col("n_docs")).otherwise(F.lit(0.0))
    if most is not None:
        rate = F.when(rate <= most, rate).otherwise(F.raise_error(F.lit(f"a source would be repeated more than {most} times")).cast("double"))
    out = counts.crossJoin(F.broadcast(total)).select("source", "n_docs", rate.alias("rate")).withColumn("parts", F.greatest(F.lit(1), F.ceil(F.col("rate") / PART)).cast("int"))
    return out.withColumn("cumulative", poisson_table(F.col("rate") / F.col("parts")))


def mix(docs: DataFrame, seed: str = "mix", source: str = "source", doc_id: str = "doc_id", broadcast_sources: int = 10_000, **options) -> DataFrame:
    """All columns of docs, replica (from 0) and shuffle_key, in the order of shuffle_key within partitions that it deals out: a global shuffle.
    The rates are broadcast if there are at most broadcast_sources of them, else joined by a shuffle that splits skewed sources."""
    taken = {c.lower() for c in docs.columns}
    table = rates(docs, source=source, **options).select(F.col("source").alias("__source"), F.col("parts").alias("__parts"), F.col("cumulative").alias("__cumulative"))
    table = staged(table, "rates")  # a row for each source
    few = table.limit(broadcast_sources + 1).count() <= broadcast_sources
    joined = docs.join(F.broadcast(table) if few else table, F.col(source).eqNullSafe(F.col("__source")))
    inverse = lambda u: F.size(F.filter("__cumulative", lambda c: c <= u))
    first, u = inverse(uniform(F.lit(seed), F.col(doc_id))), lambda j: uniform(F.concat(F.lit(f"{seed}+"), j.cast("string")), F.col(doc_id))
    others = F.aggregate(F.transform(F.sequence(F.lit(2), "__parts"), u), F.lit(0), lambda n, x: n + inverse(x))
    joined = joined.withColumn("__count", first + F.when(F.col("__parts") > 1, others).otherwise(F.lit(0))).where("__count > 0")
    # Exploded in two steps, so that no array holds all copies of a row.
    joined = joined.withColumn("__from", F.explode(F.sequence(F.lit(0), F.greatest(F.col("__count") - 1, F.lit(0)), F.lit(RUN))))
    replica, key = ("replica" if "replica" not in taken else "__replica"), ("shuffle_key" if "shuffle_key" not in taken else "__shuffle_key")
    out = joined.select(*docs.columns, F.explode(F.sequence("__from", F.least(F.col("__from") + (RUN - 1), F.col("__count") - 1))).alias(replica))
    out = out.withColumn(key, F.md5(F.concat_ws(":", F.lit(seed), F.coalesce(F.col(doc_id).cast("string"), F.lit("")), F.col(replica).cast("string")).cast("binary")))
    return out.repartition(partitions(docs.sparkSession), key).sortWithinPartitions(key)


def mix_sql(power: float = 0.5, seed: str = "mix") -> str:
    """DuckDB SQL for mix(documents) with default options."""
    return f"""
    WITH RECURSIVE counts AS (SELECT source, count(*) AS n, pow(count(*)::DOUBLE, {power}) AS w FROM documents GROUP BY source),
    rates AS (SELECT source, (SELECT sum(n) FROM counts) * 1.0::DOUBLE * w / (SELECT sum(w) FROM counts) / n AS rate FROM counts),
    cumul AS (
        SELECT source, rate, 0 AS k, exp(-rate) AS p, exp(-rate) AS c FROM rates
        UNION ALL SELECT source, rate, k + 1, p * rate / (k + 1), c + p * rate / (k + 1) FROM cumul WHERE k < ceil(rate + 12 * sqrt(rate) + 30)),
    tables AS (SELECT source, list(c ORDER BY k) AS cs FROM cumul GROUP BY source),
    counted AS (
        SELECT d.*, len(list_filter(t.cs, lambda c: c <= ('0x' || substr(md5('{seed}:' || coalesce(d.doc_id::VARCHAR, '')), 1, 13))::BIGINT / {float(1 << 52)})) AS n
        FROM documents d JOIN tables t ON d.source IS NOT DISTINCT FROM t.source)
    SELECT doc_id, text, lang, source, n_chars, replica::INT AS replica, md5('{seed}:' || coalesce(doc_id::VARCHAR, '') || ':' || replica) AS shuffle_key
    FROM (SELECT *, unnest(range(0, n)) AS replica FROM counted WHERE n > 0)"""
