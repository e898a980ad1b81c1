"""The registered queries of this subpackage, and their SQL where DuckDB can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from astrolign.llm import bitplanes, byte_bpe, decontamination, lexical_search, media, minhash, mixing, oracles, pii, secrets, spelling, substring_dedup, topk, toxicity
from astrolign.llm.common import documents

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
TOKENIZER = public_tokenizers.path("byte_bpe_50k.json")


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    model = toxicity.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return toxicity.score(docs, model).select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"), "toxic_in_language")


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = byte_bpe.decode(byte_bpe.encode(documents(spark, sf_dir), RANKS), RANKS)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def joined_spans(spans, key):
    """Column: kind:start:end of the spans, comma-joined, sorted by the struct that key(span) gives."""
    ordered = F.array_sort(F.transform(spans, lambda x: F.struct(*key(x), x["kind"].alias("kind"), x["start"].alias("start"), x["end"].alias("end"))))
    return F.array_join(F.transform(ordered, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(documents(spark, sf_dir))
    place = lambda x: F.array_position(F.array(*[F.lit(k) for k in secrets.KINDS]), x["kind"])
    key = lambda x: (x["start"].alias("a"), place(x).alias("b"))
    base = F.filter("spans", lambda x: x["kind"] != "literal")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"), F.sha2(joined_spans(base, key).cast("binary"), 256).alias("base_sha256"), joined_spans(F.col("spans"), key).alias("spans"), count("literal")
    )


def op9_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find(documents(spark, sf_dir))
    joined = lambda spans: F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    count = lambda kind: F.size(F.filter("spans", lambda x: x["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = joined(F.filter("spans", lambda x: x["kind"].isin(*pii.BASE)))
    return found.select("doc_id", *[count(k) for k in pii.BASE], F.sha2(base.cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = media.read_back(media.sniffed(media.stored(documents(spark, sf_dir))))
    payload, n = F.col("payload"), F.length("payload")
    items = F.array_join(F.transform("items", lambda x: F.concat_ws(":", x["type"], x["start"].cast("string"), x["length"].cast("string"))), ",")
    return back.select(
        "doc_id", "n_bytes", n.cast("long").alias("payload_bytes"), F.sha2(payload, 256).alias("payload_sha256"), F.crc32(F.expr("substring(payload, length(payload) - 63, 64)")).alias("tail_crc32"),
        F.length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature", "actual_type", "corrected", items.alias("items"),
    )


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.deduplicate(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


def op5_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(documents(spark, sf_dir), n=2)


def op6_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


def op8_bitplanes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bitplanes.round_trip(documents(spark, sf_dir), TOKENIZER).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op11_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.matches(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda a, x: a + x["end"] - x["start"])
    listed = F.sha2(F.array_join("items", ",").cast("binary"), 256)
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), listed.alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


def op12_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical_search.ranked(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def op13_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(documents(spark, sf_dir)).select("word", "form", "root", "n", "n_near", "form_n")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_toxicity": op1_toxicity,
    "op2_byte_bpe": op2_byte_bpe,
    "op3_media": op3_media,
    "op4_substring_dedup": op4_substring_dedup,
    "op5_minhash": op5_minhash,
    "op6_topk": op6_topk,
    "op7_mixing": op7_mixing,
    "op8_bitplanes": op8_bitplanes,
    "op9_pii": op9_pii,
    "op10_secrets": op10_secrets,
    "op11_decontamination": op11_decontamination,
    "op12_ranked_search": op12_ranked_search,
    "op13_spelling": op13_spelling,
}

ORACLE_SQL: dict[str, str] = {
    "op4_substring_dedup": oracles.SUBSTRING_DEDUP,
    "op5_minhash": oracles.NEAR_DUPLICATES,
    "op6_topk": topk.TOP_K_SQL,
    "op7_mixing": mixing.mix_sql(),
    "op11_decontamination": oracles.CONTAMINATION,
    "op12_ranked_search": oracles.RANKED,
    "op13_spelling": oracles.SPELLING,
}
