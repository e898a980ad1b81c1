import os
import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F
from test_minhash import brute

from astrolign.llm import byte_bpe, common, minhash, secrets


def test_stages_in_order_and_columns():
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_duplicates", "secrets", "mixing", "byte_bpe"]


def test_pipeline_on_a_small_corpus(spark, tmp_path):
    rng = random.Random(2)
    docs, labels = [], []
    for i in range(240):
        words = [f"w{rng.randrange(500)}" for _ in range(60)]
        toxic = i % 6 == 0
        if toxic:
            words[5:5] = ["badword", "vileword"]
        if i % 10 == 9:
            words = docs[-1][1].split()[:59] + ["changed"]
            toxic = docs[-1][0] % 6 == 0
        if i % 15 == 1:
            words.append('password = "hunter2hunter2"')
        docs.append((i, " ".join(words), "en", f"s{i % 3}", 10))
        labels.append((i, 1, int(toxic)))
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    frame = spark.read.parquet(f"{tmp_path}/documents.parquet")
    clean = corpus_pipeline.drop_toxic(spark, frame, str(tmp_path)).cache()
    kept = {r.doc_id for r in clean.collect()}
    bad = {i for i, _, t in labels if t}
    assert len(kept & bad) <= 0.1 * len(bad) and len(kept - bad) >= 0.95 * (len(docs) - len(bad))
    single = corpus_pipeline.drop_near_duplicates(spark, clean, str(tmp_path)).cache()
    groups = {r.doc_id for r in minhash.near_duplicates(clean).where("kept").collect()}
    assert {r.doc_id for r in single.collect()} == groups and len(groups) < len(kept)
    safe = corpus_pipeline.redact_secrets(spark, single, str(tmp_path)).cache()
    assert safe.count() == single.count() and not any(secrets.spans(r.text) for r in safe.collect())
    assert safe.where(F.length("text") != F.col("n_chars")).count() == 0
    assert all(f.columns == corpus_pipeline.COLUMNS for f in (clean, single, safe))
    mixed = corpus_pipeline.mix_sources(spark, safe, str(tmp_path))
    out = corpus_pipeline.encode(spark, mixed, str(tmp_path)).collect()
    assert sorted(r.doc_id for r in out) == sorted(r.doc_id for r in mixed.collect())
    whole = corpus_pipeline.run(spark, str(tmp_path))
    assert sorted(map(tuple, whole.collect())) == sorted(map(tuple, out))  # run() chains the same stages
    enc = byte_bpe.encoding(corpus_pipeline.RANKS)
    texts = {r.doc_id: r.text for r in safe.collect()}
    assert all(r.n_tokens == len(enc.encode_ordinary(texts[r.doc_id])) for r in out)


def test_near_duplicate_stage_groups_like_brute_force_on_five_words(spark, tmp_path):
    rng = random.Random(4)
    texts = []
    for _ in range(8):
        base = [f"w{rng.randrange(400)}" for _ in range(100)]
        edited = list(base)
        for at in (10, 30, 50, 70, 90)[: rng.choice([1, 2, 5])]:
            edited[at] = "edit"
        texts += [" ".join(base), " ".join(edited), " ".join(f"w{rng.randrange(400)}" for _ in range(100))]
    docs = list(enumerate(texts))
    frame = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    got = sorted(r.doc_id for r in corpus_pipeline.drop_near_duplicates(spark, frame, str(tmp_path)).collect())
    assert got == [r[0] for r in brute(docs, n=5) if r[3]]
    assert 16 < len(got) < 24


def test_near_duplicate_stage_keeps_rows_without_id_and_one_of_repeated_rows(spark, tmp_path):
    rng = random.Random(5)
    a, b, c, d, e = (" ".join(f"w{rng.randrange(400)}" for _ in range(60)) for _ in range(5))
    docs = [(1, a), (1, a), (1, a), (2, b), (2, c), (9, a + " more"), (None, d), (None, d + " more"), (None, b), (None, ""), (5, ""), (5, ""), (6, None), (6, None), (7, e)]
    frame = spark.createDataFrame([(i, t, "en", "s", 3) for i, t in docs], "doc_id long, text string, lang string, source string, n_chars long")
    for parts in (1, 5):
        out = [(r.doc_id, r.text) for r in corpus_pipeline.drop_near_duplicates(spark, frame.repartition(parts), str(tmp_path)).collect()]
        nameless = [t for i, t in out if i is None and t]
        assert len(nameless) <= 1 and set(nameless) <= {d, d + " more"} and nameless
        assert sorted(map(repr, ((i, t) for i, t in out if i is not None or not t))) == sorted(map(repr, [(1, a), (2, b), (2, c), (None, ""), (5, ""), (6, None), (7, e)]))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, replica int, keys int"


def odd_corpus(spark, path, docs, labels=((1, 0),)):
    spark.createDataFrame([(i, t, g, s, n, "x", 1, 2) for i, t, g, s, n in docs], SCHEMA).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(list(labels), "doc_id long, toxic int").write.parquet(f"{path}/labels.parquet")


def test_run_on_nulls_empty_and_long_texts_repeats_ties_and_further_columns(spark, tmp_path):
    rng = random.Random(7)
    own = [" ".join(f"w{rng.randrange(900)}" for _ in range(50)) for _ in range(12)]
    long = " ".join(f"v{rng.randrange(9000)}" for _ in range(120_000)) + ' password = "q8Zk2LmP0xW4rT7v"'
    docs = [(i, t, "en", f"s{i % 2}", 5) for i, t in enumerate(own)]
    docs += [(20, None, None, None, None), (21, "", "de", "s0", 0), (22, " \n ", "de", "s0", 3), (None, own[3] + " tail", None, None, 1), (23, long, "fr", "s1", 9), (24, long, "fr", "s1", 9), (5, own[5], "en", "s1", 5), (None, None, None, None, None)]
    odd_corpus(spark, tmp_path, docs)
    before = {k: spark.conf.get(k, None) for k in ("spark.sql.execution.arrow.maxBytesPerBatch", "spark.sql.execution.arrow.maxRecordsPerBatch")}
    frame, texts = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in corpus_pipeline.STAGES:
        frame = stage(spark, frame, str(tmp_path))
        texts[name] = frame.collect()
        assert frame.columns == corpus_pipeline.COLUMNS or name == "byte_bpe"
    assert {k: spark.conf.get(k, None) for k in before} == before
    assert len(texts["toxicity"]) == len(docs)  # nothing is labelled toxic
    single = [(r.doc_id, r.text) for r in texts["near_duplicates"]]
    assert sorted(i for i, _ in single if i is not None) == [*range(12), 20, 21, 22, 23] and (None, None) in single and len(single) == 17
    assert not any("q8Zk2LmP0xW4rT7v" in (r.text or "") for r in texts["secrets"]) and {r.n_chars for r in texts["secrets"] if r.text is None} == {None}
    mixed = sorted((r.doc_id is None, r.doc_id or 0) for r in texts["mixing"])
    assert mixed == sorted((r.doc_id is None, r.doc_id or 0) for r in texts["byte_bpe"]) and {r.n_tokens for r in texts["byte_bpe"] if r.doc_id in (20, 21)} <= {0}
    again = sorted(map(repr, corpus_pipeline.run(spark, str(tmp_path)).collect()))
    assert again == sorted(map(repr, texts["byte_bpe"]))


def test_run_on_empty_tables(spark, tmp_path):
    odd_corpus(spark, tmp_path, [], labels=[])
    out = corpus_pipeline.run(spark, str(tmp_path))
    assert out.collect() == [] and out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]


def test_run_leaves_one_table_behind(spark, tmp_path):
    odd_corpus(spark, tmp_path, [(1, "a b c d e f", "en", "s", 1)])
    paths = common._staged.setdefault(spark.sparkContext.applicationId, [])
    before = set(paths)
    out = corpus_pipeline.run(spark, str(tmp_path))
    left = set(paths) - before
    assert len(left) == 1 and os.path.isdir(left.pop().removeprefix("file://")) and out.count() <= 3


def test_tables_need_a_shared_folder_off_local():
    class Context:
        master, applicationId = "spark://host:7077", "x"

        def getConf(self):
            return {}

    with pytest.raises(RuntimeError, match="checkpoint"):
        common.shared_dir(type("Session", (), {"sparkContext": Context()})())


def test_five_million_blanks_pass_all_stages(spark, tmp_path):
    """A text of white space alone, and one with words at its ends: neither crashes a stage nor takes other documents along."""
    rng = random.Random(8)
    docs = [(i, " ".join(f"w{rng.randrange(300)}" for _ in range(30)), "en", "s", 10) for i in range(60)]
    docs += [(100, " " * 5_000_000, "en", "s", 10), (101, "first" + " \n" * 2_500_000 + "last", "en", "s", 10)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    rows = {r.doc_id: r.n_tokens for r in corpus_pipeline.run(spark, str(tmp_path)).collect()}
    enc = byte_bpe.encoding(corpus_pipeline.RANKS)
    texts = {i: t for i, t, *_ in docs}
    assert len(rows) >= 40 and all(n == len(byte_bpe.encode_text(enc, texts[i])) for i, n in rows.items())
