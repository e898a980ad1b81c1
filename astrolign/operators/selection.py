"""Exact quantiles of groups of any size by passes of counting, without a buffer of a group's values."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from astrolign.sources.shared import staged


def _met(left: DataFrame, right: DataFrame, keys: list[str], also: Column | None = None) -> DataFrame:
    """Inner join by equality of keys, null with null, and a condition; left's keys stay."""
    right = right.withColumnsRenamed({k: f"__{k}" for k in keys})
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in keys])
    return left.join(right, same if also is None else same & also).drop(*[f"__{k}" for k in keys])


def _inside(values: DataFrame, ranges: DataFrame, by: list[str], salts: int) -> DataFrame:
    """Values with the range of their group that they lie in; a group's ranges are disjoint, so a value comes once. Ranges are few and mostly broadcast; where they are not, a group is dealt out over `salts` keys."""
    values = values.withColumn("salt", F.spark_partition_id() % salts)
    ranges = ranges.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return _met(values, ranges, [*by, "salt"], F.expr("__v BETWEEN low AND high")).select(*by, "__v", "low", "high", "below", "ranks")


def _bin(bins: int, steep: bool) -> Column:
    """The bin of a value between low and high, never falling as the value grows: equal parts of the range, or (steep) of its logarithm, where both ends have one sign; else negative, zero and positive values. The two ends lie in the first and the last
    bin, so every pass narrows a range; infinite ends are passed by on the way."""
    v, low, high = F.col("__v"), F.col("low"), F.col("high")
    part = lambda x, a, b: F.least(F.greatest(F.floor((x / 2 - a / 2) / F.nullif(b / 2 - a / 2, F.lit(0.0)) * bins), F.lit(0)), F.lit(bins - 1)).cast("int")  # noqa: E731  halves, since a whole difference may overflow
    if steep:
        inner = F.when(low > 0, part(F.ln(v), F.ln(low), F.ln(high))).when(high < 0, part(-F.ln(-v), -F.ln(-low), -F.ln(-high))).when(v < 0, 0).when(v > 0, bins - 1).otherwise(1)
    else:
        inner = part(v, low, high)
    return F.when(v == low, 0).when(v == high, bins - 1).when(low == float("-inf"), bins - 1).otherwise(inner)


def _narrowed(values: DataFrame, ranges: DataFrame, by: list[str], bins: int, steep: bool, salts: int) -> DataFrame:
    """Each range's bins that hold one of its ranks, as ranges of their own: from the least to the largest value there is in the bin."""
    counted = _inside(values, ranges, by, salts).groupBy(*by, "low", "high", "below", "ranks", _bin(bins, steep).alias("bin")).agg(F.count("*").alias("n"), F.min("__v").alias("least"), F.max("__v").alias("most"))
    cells = F.array_sort(F.collect_list(F.struct("bin", "n", "least", "most")))  # `bins` of them at most
    listed = counted.groupBy(*by, "low", "high", "below", "ranks").agg(cells.alias("cells"))
    start = F.aggregate("cells", F.array(F.col("below")), lambda done, cell: F.concat(done, F.array(F.element_at(done, -1) + cell["n"])))
    each = listed.withColumn("start", start).select(*by, "ranks", F.posexplode("cells").alias("at", "cell"), "start")
    each = each.withColumn("below", F.col("start")[F.col("at")])
    own = F.filter("ranks", lambda r: (r >= F.col("below")) & (r < F.col("below") + F.col("cell.n")))
    return each.select(*by, F.col("cell.least").alias("low"), F.col("cell.most").alias("high"), "below", F.col("cell.n").alias("size"), own.alias("ranks")).where(F.size("ranks") > 0)


def quantiles(values: DataFrame, by: list[str], column: str, fractions: list[float], bins: int = 1024, rest: int = 4096, salts: int = 16) -> DataFrame:
    """by, n, quantiles: an array in the order of `fractions`, equal to Spark's percentile(), of each group's values. Null and NaN take no part; a group without values gives no row. Ties and infinite values are right.

    A pass counts, in partial sums, the values of `bins` equal parts of the ranges in which the wanted ranks lie, and keeps the parts that hold them. It ends when a range is one value or holds `rest` values at most, which are then sorted. A task holds
    `bins` counts or `rest` values of a group, whatever its size. Each pass is a job that reads `values` anew (stage them if they are costly); even values take log(n / rest) / log(bins) passes; every second pass splits by logarithms, for values of unlike sizes, and each drops at least one value. bins: 3 at least."""
    v = F.col(column).cast("double")
    values = values.select(*by, v.alias("__v")).where(F.col("__v").isNotNull() & ~F.isnan("__v"))
    whole = staged(values.groupBy(*by).agg(F.count("*").alias("n"), F.min("__v").alias("low"), F.max("__v").alias("high")), "whole")
    place = [(F.col("n") - 1) * F.lit(float(p)) for p in fractions]
    ranks = F.array_distinct(F.array(*[f(x).cast("long") for x in place for f in (F.floor, F.ceil)]))
    ranges = whole.select(*by, "low", "high", F.lit(0).cast("long").alias("below"), F.col("n").alias("size"), ranks.alias("ranks"))
    found, is_open = [], (F.col("low") < F.col("high")) & (F.col("size") > rest)
    while True:
        found.append(ranges.where(~is_open))
        more = ranges.where(is_open)
        if more.isEmpty():
            break
        ranges = staged(_narrowed(values, more, by, bins, len(found) % 2 == 0, salts), "ranges")
    done = reduce(DataFrame.unionByName, found)
    single = done.where("low = high").select(*by, F.explode("ranks").alias("rank"), F.col("low").alias("value"))
    listed = _inside(values, done.where("low < high"), by, salts).groupBy(*by, "low", "below", "ranks").agg(F.array_sort(F.collect_list("__v")).alias("own"))
    listed = listed.withColumn("rank", F.explode("ranks")).select(*by, "rank", F.col("own")[(F.col("rank") - F.col("below")).cast("int")].alias("value"))
    known = single.unionByName(listed).groupBy(*by).agg(F.map_from_entries(F.collect_list(F.struct("rank", "value"))).alias("known"))

    def at(x: Column) -> Column:
        low, high = F.floor(x).cast("long"), F.ceil(x).cast("long")
        a, b = F.col("known")[low], F.col("known")[high]
        return F.when(a == b, a).otherwise((high - x) * a + (x - low) * b)

    return _met(whole, known, by).select(*by, "n", F.array(*[at(x) for x in place]).alias("quantiles"))
