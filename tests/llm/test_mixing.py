import math
import statistics

import duckdb
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from astrolign.llm import mixing

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def rows(n=600):
    return [(i, f"text {i}", "en", None if i % 50 == 0 else "hot" if i % 3 else f"s{i % 7}", 6) for i in range(n)]


def test_equals_sql(spark):
    frame = spark.createDataFrame(rows(), SCHEMA)
    got = sorted(map(repr, map(tuple, mixing.mix(frame).collect())))
    documents = frame.toPandas()  # noqa: F841
    assert got == sorted(map(repr, duckdb.sql(mixing.mix_sql()).fetchall()))
    assert got == sorted(map(repr, map(tuple, mixing.mix(frame, broadcast_sources=0).collect())))


def test_counts_follow_weights(spark):
    frame = spark.createDataFrame(rows(6000), SCHEMA)
    by = {r["source"]: r["count"] for r in mixing.mix(frame, weights={"hot": 1.0, "s0": 3.0}).groupBy("source").count().collect()}
    assert set(by) == {"hot", "s0"}
    for source, share in (("hot", 0.25), ("s0", 0.75)):
        assert abs(by[source] - 6000 * share) < 6 * math.sqrt(6000)


def test_poisson_inverse_matches_the_distribution(spark):
    table = spark.range(1).select(mixing.poisson_table(mixing.F.lit(2.5)).alias("c")).first().c
    want, p = [], math.exp(-2.5)
    for k in range(len(table)):
        want.append((want[-1] if want else 0) + p)
        p *= 2.5 / (k + 1)
    assert table == pytest.approx(want)


def test_clashing_columns_empty_tables_and_faulty_weights(spark):
    frame = spark.createDataFrame([(1, "a", 7, "k")] * 3, "doc_id long, source string, replica int, shuffle_key string")
    out = mixing.mix(frame)
    assert out.columns == ["doc_id", "source", "replica", "shuffle_key", "__replica", "__shuffle_key"] and all(r.replica == 7 for r in out.collect())
    assert mixing.mix(frame.where("false")).collect() == []
    assert mixing.mix(frame, weights={}).collect() == []
    with pytest.raises(PySparkException):
        mixing.mix(spark.createDataFrame(rows(), SCHEMA), weights={"s1": 1.0}, most=2.0).collect()


def test_rates_beyond_one_table_are_sums_of_parts(spark):
    frame = spark.createDataFrame([(i, "t", "en", "rare" if i < 40 else "large", 1) for i in range(60_000)], SCHEMA).coalesce(4)
    out = mixing.mix(frame, weights={"rare": 1.0}).groupBy("doc_id", "source").agg(F.count("*").alias("n"), F.countDistinct("replica").alias("k"), F.min("replica").alias("low"), F.max("replica").alias("high")).collect()
    assert {r.doc_id for r in out} == set(range(40)) and all((r.low, r.high, r.k) == (0, r.n - 1, r.n) for r in out)
    counts = [r.n for r in out]
    assert abs(statistics.mean(counts) - 1500) < 5 * math.sqrt(1500 / 40) and 0.4 * 1500 < statistics.variance(counts) < 2.2 * 1500


def test_default_weights_refuse_no_rate_and_equal_sql_while_it_inverts(spark):
    frame = spark.createDataFrame([(i, "t", "en", "rare" if i == 7 else "large", 1) for i in range(1201)], SCHEMA)
    documents = frame.toPandas()  # noqa: F841
    assert sorted(map(repr, map(tuple, mixing.mix(frame, power=0.0).collect()))) == sorted(map(repr, duckdb.sql(mixing.mix_sql(power=0.0)).fetchall()))
    one = spark.createDataFrame([(i, "t", "en", "rare" if i == 7 else "large", 1) for i in range(50_000)], SCHEMA)
    n = mixing.mix(one, power=0.0).where("source = 'rare'").agg(F.count("*"), F.countDistinct("replica")).first()
    assert n[0] == n[1] and abs(n[0] - 25_000) < 6 * math.sqrt(25_000)


def test_null_and_repeated_ids_null_and_long_texts(spark):
    """A null doc_id draws as an empty one does, rows that repeat an id draw alike, and texts play no part."""
    data = [(None, None, None, "a", None), (None, "x" * 200_000, "en", "a", 1), (3, "", "en", "a", 0), (3, "other", "de", "a", 5), *[(i, "t", "en", "b", 1) for i in range(10, 40)]]
    frame = spark.createDataFrame(data, SCHEMA)
    out = [tuple(r) for r in mixing.mix(frame, weights={"a": 1.0, "b": 1.0}).collect()]
    counts = {t: sum(r[0] == i and r[1] == t for r in out) for i, t in ((None, None), (None, "x" * 200_000), (3, ""), (3, "other"))}
    assert counts[None] == counts["x" * 200_000] and counts[""] == counts["other"]
    assert sorted({r[5] for r in out if r[1] == "other"}) == list(range(counts["other"]))
