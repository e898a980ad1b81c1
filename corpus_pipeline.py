"""A training corpus from raw documents: toxic documents go, one document of each near-duplicate group stays, secrets are redacted,
sources are mixed to target weights, and the rest is encoded as byte-level BPE.

A stage reads only the columns of documents, whatever others there are, writes its result to the shared folder, removes the tables that it needed on the way, and returns the written table; the
session's settings are as before when it ends. An empty table passes through every stage as an empty one.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps
from itertools import accumulate

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolign.llm import byte_bpe, common, minhash, mixing, secrets, toxicity
from astrolign.llm.queries import RANKS

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Arrow batches of 4 MB and 1000 rows at most: what a Python worker and its JVM side hold at once then has a bound that neither long texts nor many rows move.
SMALL_BATCHES = {"spark__sql__execution__arrow__maxBytesPerBatch": "4m", "spark__sql__execution__arrow__maxRecordsPerBatch": "1000"}

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def written(stage: Stage) -> Stage:
    """A stage that does its work when it is called: result written, tables on the way removed, settings restored."""

    @wraps(stage)
    def run(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        out = common.new_path(spark, f"pipeline-{stage.__name__}")
        with common.settings(spark, **SMALL_BATCHES), common.scratch(spark):
            result = stage(spark, docs.select(*COLUMNS), sf_dir)
            result.write.option("compression", "zstd").parquet(out)
        table = spark.read.schema(result.schema).parquet(out)
        table.staged_at = out
        return table

    return run


@written
def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Leaves out documents that score their language's threshold or more. The model learns from labels outside the held-out quarter.
    A null or empty text scores as a text without words, an unknown or null lang takes the threshold of all languages; repeated rows score alike, so all stay or all go; a null doc_id changes nothing."""
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.keep_clean(docs, model).select(*COLUMNS)


def with_rows(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs and `row`, a number of each row of its own: its doc_id, or one above all doc_ids where there is none, or where an earlier row has the doc_id for another
    text. Rows that repeat both doc_id and text become one. Tables without such rows cost a count of their doc_ids."""
    counts = common.staged(docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("doc_id IS NULL OR n > 1"), "repeated")
    if counts.isEmpty():
        return docs.withColumn("row", F.col("doc_id"))
    repeated = counts.where("doc_id IS NOT NULL").select("doc_id")
    odd = docs.where("doc_id IS NULL").union(docs.join(repeated, "doc_id", "left_semi").select(*COLUMNS))
    odd = common.staged(odd.withColumn("at", F.monotonically_increasing_id()), "odd-rows")
    part, place = F.shiftright("at", 33), F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = sorted(map(tuple, odd.groupBy(part.alias("part")).count().collect()))
    top = docs.agg(F.max("doc_id")).first()[0]
    starts = accumulate((n for _, n in sizes), initial=0 if top is None else top + 1)
    starts = spark.createDataFrame([(p, x) for (p, _), x in zip(sizes, starts, strict=False)], "part long, start long")
    behind = F.when(F.col("doc_id").isNull(), F.lit(sum(n for _, n in sizes))).otherwise(F.lit(0))  # rows without a doc_id come last
    odd = common.staged(odd.withColumn("part", part).join(F.broadcast(starts), "part").select(*COLUMNS, (F.col("start") + place + behind).alias("number")), "odd-rows")
    texts = odd.where("doc_id IS NOT NULL").groupBy("doc_id", F.sha2("text", 256).alias("digest")).agg(F.min("number").alias("number"))
    heads = texts.groupBy("doc_id").agg(F.min("number").alias("number")).select("number", F.lit(True).alias("head"))
    named = odd.where("doc_id IS NOT NULL").join(texts.select("number").join(heads, "number", "left"), "number")
    named = named.select(*COLUMNS, F.when(F.col("head"), F.col("doc_id")).otherwise(F.col("number")).alias("row"))
    rest = docs.where("doc_id IS NOT NULL").join(repeated, "doc_id", "left_anti").select(*COLUMNS, F.col("doc_id").alias("row"))
    return rest.union(common.staged(named.union(odd.where("doc_id IS NULL").select(*COLUMNS, F.col("number").alias("row"))), "odd-rows"))


@written
def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest doc_id of each group. Documents of a group share, as a chain of pairs, 80 % or more of their five-word shingles.
    Texts without words, null ones too, are like no other and stay. A document without a doc_id counts as one behind all others; rows that repeat a doc_id count as documents of their own
    if their texts differ, else as one."""
    docs = with_rows(spark, docs)
    groups = minhash.near_duplicates(docs.select(F.col("row").alias("doc_id"), "text"), n=5)
    return docs.join(groups.where("kept").select(F.col("doc_id").alias("row")), "row", "left_semi").select(*COLUMNS)


@written
def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets in the texts and counts characters anew; no document goes. A null text stays null, with a null count; repeated rows are redacted alike."""
    return secrets.redact(docs).withColumn("n_chars", F.length("text").cast("long"))


@written
def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats or drops documents so that sources come near weights of the square root of their size; copies share a doc_id. A null source is a source of its own, a null doc_id hashes as an empty
    one; rows that repeat a doc_id within a source are repeated alike."""
    return mixing.mix(docs).select(*COLUMNS)


@written
def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document of the mix. A null text counts as empty: no tokens; very long texts are encoded whole; repeated rows give repeated rows."""
    out = byte_bpe.decode(byte_bpe.encode(docs, RANKS), RANKS)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("mixing", mix_sources),
    ("byte_bpe", encode),
]

#: The classifier can't be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; only its table is left in the shared folder."""
    docs = common.documents(spark, sf_dir)
    for _, stage in STAGES:
        before, docs = docs, stage(spark, docs, sf_dir)
        if hasattr(before, "staged_at"):
            common.remove(spark, before.staged_at)
    return docs
