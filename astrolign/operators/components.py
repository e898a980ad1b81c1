"""Connected components of links in a table, by rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from astrolign.sources.shared import staged


def _hung(links: DataFrame, by: list[str], both: bool) -> DataFrame:
    """Links of each node's neighbours to the least of them and it: of larger neighbours (both: the links are read in both directions) or of smaller ones and the node itself."""
    ends = links.unionByName(links.select(*by, F.col("b").alias("a"), F.col("a").alias("b"))) if both else links
    least = ends.groupBy(*by, "a").agg(F.min("b").alias("least")).withColumn("least", F.least("a", "least"))
    met = ends.join(least, [*by, "a"])
    if both:
        out = met.where("b > a").select(*by, F.col("b").alias("a"), F.col("least").alias("b"))
    else:
        out = met.select(*by, F.col("b").alias("a"), F.col("least").alias("b")).unionByName(least.select(*by, "a", F.col("least").alias("b")))
    return out.where("a <> b").distinct()


def components(links: DataFrame, by: list[str]) -> DataFrame:
    """by, node, root of every node in links (by, a, b), whose ends differ or not: root is the least node that can be reached. Links may come twice or in both directions; links with a null end take no part, and neither do links with a null in `by`.

    Large nodes are hung on the least of their neighbours, then small ones, in turn, until nothing changes: the number of rounds grows with the logarithm of the longest way. A round is a minimum for each node (summed up before the shuffle) and a join, so
    a node with many links is a long run of short rows, never a list; a round's links are written, so lost executors cost one round."""
    links = links.select(*by, "a", "b").dropna()
    alone = links.select(*by, F.col("a").alias("node")).unionByName(links.select(*by, F.col("b").alias("node"))).distinct()
    now = staged(links.where("a <> b").select(*by, F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "links")
    mark = _mark(now, by)
    while mark[0]:
        now = staged(_hung(staged(_hung(now, by, True), "large"), by, False), "small")
        before, mark = mark, _mark(now, by)
        if mark == before:
            break
    return alone.join(now.select(*by, F.col("a").alias("node"), F.col("b").alias("root")), [*by, "node"], "left").withColumn("root", F.coalesce("root", "node"))


def _mark(links: DataFrame, by: list[str]) -> tuple:
    """Tells sets of links apart: their number and two sums of hashes."""
    names = [*by, "a", "b"]
    return tuple(links.agg(F.count("*"), F.bit_xor(F.xxhash64(*names)), F.bit_xor(F.xxhash64(F.lit(1), *names))).first())
