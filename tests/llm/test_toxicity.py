import random
import zlib

import numpy as np

from astrolign.llm import toxicity


def corpus(n=900, seed=1):
    rng = random.Random(seed)
    clean = [f"w{i}" for i in range(300)]
    bad = [f"bad{i}x" for i in range(6)]
    out = []
    for i in range(n):
        words = [rng.choice(clean) for _ in range(rng.randrange(5, 80))]
        toxic = int(rng.random() < 0.2)
        for _ in range(toxic * rng.randrange(1, 4)):
            words.insert(rng.randrange(len(words)), rng.choice(bad).upper() + rng.choice(["", "!", ","]))
        out.append((i, " ".join(words), "en" if i % 2 else "de", toxic))
    return out


def test_held_out_accuracy_and_rows(spark):
    data = corpus()
    docs = spark.createDataFrame([(i, t, g, 9.0) for i, t, g, _ in data] + [(5000, None, "fr", 9.0), (5001, "", None, 9.0), (5001, "", None, 9.0), (None, "w1", "en", 9.0)], "doc_id long, text string, lang string, score double")
    labels = spark.createDataFrame([(i, y, 1) for i, _, _, y in data], "doc_id long, toxic int, score int")
    model = toxicity.train(docs, labels)
    rows = toxicity.score(docs, model).withColumn("held_out", toxicity.held_out()).collect()
    assert len(rows) == len(data) + 4 and all(0 <= r.score <= 1 for r in rows)
    truth = {i: y for i, _, _, y in data}
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert all(zlib.crc32(str(r.doc_id).encode()) % 4 == 2 for r in held)
    hits = sum((r.score >= 0.3) == truth[r.doc_id] for r in held)
    assert hits / len(held) > 0.95
    kept = toxicity.keep_clean(docs, model).count()
    assert 0.7 * len(data) < kept < 0.92 * len(data)


def test_labels_of_held_out_rows_change_nothing(spark):
    data = corpus(300)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in data], "doc_id long, text string, lang string")
    two = [spark.createDataFrame([(i, 1 - y if flip and zlib.crc32(str(i).encode()) % 4 == 2 else y) for i, _, _, y in data], "doc_id long, toxic int") for flip in (False, True)]
    a, b = (toxicity.train(docs, x) for x in two)
    assert np.array_equal(a.table, b.table) and a.thresholds == b.thresholds


def test_without_labels_every_row_still_scores(spark):
    docs = spark.createDataFrame([(1, "a b", "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([], "doc_id long, toxic int")
    model = toxicity.train(docs, labels)
    assert [0 <= r.score <= 1 for r in toxicity.score(docs, model).collect()] == [True]
    assert toxicity.score(docs.where("false"), model).collect() == []


def test_windows_of_unknown_words_can_be_left_out():
    model = toxicity.ConvTextClassifier(epochs=3).fit(*map(list, zip(*[(t, y) for _, t, _, y in corpus(300)], strict=True)))
    score = model.scorer()
    text = "w1 " + "zzz " * 50 + "bad1x " + "yyy " * 50 + "bad2x w3"
    alone = score([text])[0]
    assert np.allclose(score([text, "", "w1", text])[[0, 3]], alone)


def by_hand(model, text):
    """The forward pass word by word, window by window."""
    rows = {int(k): v for k, v in zip(model.known, model.table, strict=True)}
    vectors = []
    for word in text.lower().split():
        vectors.append(sum((rows.get(b, np.zeros(model.dim)) for b in toxicity.buckets_of(word, model.size, model.prefix)), np.zeros(model.dim)))
    vectors += [np.zeros(model.dim)] * (toxicity.PAD + (not vectors))
    total = float(model.layers["c"][0])
    k = 0
    for width in toxicity.WIDTHS:
        for f in range(model.filters):
            best = max(sum(float(vectors[at + j] @ model.layers[f"W{width}"][j][:, f]) for j in range(width)) for at in range(len(vectors) - toxicity.PAD))
            total += max(0.0, best + float(model.layers[f"b{width}"][f])) * float(model.layers["o"][k])
            k += 1
    return 1 / (1 + np.exp(-total))


def test_scores_equal_a_forward_pass_by_loops(spark):
    data = corpus(400)
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in data], "doc_id long, text string, lang string")
    model = toxicity.train(docs, spark.createDataFrame([(i, y) for i, _, _, y in data], "doc_id long, toxic int"), epochs=3)
    texts = [t for _, t, _, _ in data[:40]] + ["", "bad1x", "zzz " * 9 + "bad2x", "w1 " * 3000 + "bad3x"]
    assert np.allclose(model.scorer()(texts), [by_hand(model, t) for t in texts], atol=1e-5)


def test_fit_takes_long_texts_counts_only_labels_with_documents_and_ignores_row_order(spark):
    data = corpus(300)
    data = [(i, t + " w5" * (9000 if i % 9 == 0 else 0), g, y) for i, t, g, y in data]
    docs = spark.createDataFrame([(i, t, g) for i, t, g, _ in data] + [(5, "another text", "en"), (5, None, "en")], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, y) for i, _, _, y in data] + [(i, 1) for i in range(10_000, 10_400)], "doc_id long, toxic int")
    seen = []

    class Spy(toxicity.ConvTextClassifier):
        def fit(self, texts, labels):
            seen.append(texts)
            return super().fit(texts, labels)

    own, toxicity.ConvTextClassifier = toxicity.ConvTextClassifier, Spy
    try:
        a, b = (toxicity.train(frame, labels, max_rows=100, epochs=2) for frame in (docs, docs.repartition(7)))
    finally:
        toxicity.ConvTextClassifier = own
    assert len(seen[0]) == 80 and seen[0] == seen[1] and np.array_equal(a.table, b.table)  # 80 of 100 fit, the labels of missing documents don't count
    assert any(t.count(" ") > 9000 for t in seen[0])


def test_thresholds_by_language_reach_the_result(spark):
    docs = spark.createDataFrame([(1, "bad1x", "en"), (2, "bad1x", "de"), (3, "bad1x", None)], "doc_id long, text string, lang string")
    model = toxicity.ConvTextClassifier(epochs=2).fit(*map(list, zip(*[(t, y) for _, t, _, y in corpus(300)], strict=True)))
    s = model.scorer()(["bad1x"])[0]
    model.thresholds = {None: s + 0.001, "en": s - 0.001, "de": s + 0.001}
    assert sorted((r.doc_id, r.toxic_in_language) for r in toxicity.score(docs, model).collect()) == [(1, True), (2, False), (3, False)]
    assert sorted(r.doc_id for r in toxicity.keep_clean(docs, model).collect()) == [2, 3]


def test_all_labelled_documents_are_fitted_in_shards(spark, monkeypatch):
    """Each rare word is toxic in few documents; a sample of them would not know most."""
    rng = random.Random(3)
    data = [(i, " ".join(rng.choice([f"w{k}" for k in range(300)]) for _ in range(20)) + (f" rare{i // 5 % 40}word" if i % 5 == 0 else ""), "en", int(i % 5 == 0)) for i in range(3000)]
    docs, labels = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string"), spark.createDataFrame([(x[0], x[3]) for x in data], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "SHARD", 900)
    a, b = toxicity.train(docs, labels, epochs=4), toxicity.train(docs.repartition(7), labels.repartition(3), epochs=4)
    assert np.array_equal(a.table, b.table) and a.thresholds == b.thresholds
    rows = toxicity.score(docs, a).withColumn("held_out", toxicity.held_out()).where("held_out").collect()
    assert sum((r.score >= 0.3) == (r.doc_id % 5 == 0) for r in rows) / len(rows) > 0.95
    places = {toxicity.buckets_of(f"rare{k}word", a.size, a.prefix)[0] for k in range(40)}
    some = toxicity.train(docs, labels, max_rows=300, epochs=4)
    assert len(places & set(a.known.tolist())) > 0.75 * len(places) > 2 * len(places & set(some.known.tolist()))


def test_every_labelled_document_is_fitted_and_calibrates(spark, monkeypatch):
    """A fifth of them only calibrated thresholds, and more than one shard meant half the rounds."""
    data = corpus(1200)
    docs, labels = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string"), spark.createDataFrame([(x[0], x[3]) for x in data], "doc_id long, toxic int")
    known = sum(zlib.crc32(str(x[0]).encode()) % 4 != 2 for x in data)
    fitted, scored, averaged, calibrated = [], [], toxicity._averaged, toxicity._calibrated

    def spied(found, options):
        fitted.append((options, sum(np.frombuffer(x["weights"])[0] for x in found if x["block"] == -1)))
        return averaged(found, options)

    monkeypatch.setattr(toxicity, "_averaged", spied)
    monkeypatch.setattr(toxicity, "_calibrated", lambda rows: scored.append(rows.select("doc_id").distinct().count()) or calibrated(rows))
    for shard in (16384, 400):
        monkeypatch.setattr(toxicity, "SHARD", shard)
        toxicity.train(docs, labels)
        (options, whole), *parts = fitted
        assert options == {} and whole == known == scored.pop() and all(n < known for _, n in parts)
        assert sum(n for _, n in parts) == (known if shard == 400 else (toxicity.FOLDS - 1) * known)
        fitted.clear()


def test_the_number_of_shuffle_partitions_moves_no_shard(spark):
    """A join dealt the shards out over all of them: with many, a shard held a few documents, and hardly a word in three of them."""
    data = corpus(900)
    docs, labels = spark.createDataFrame([x[:3] for x in data], "doc_id long, text string, lang string"), spark.createDataFrame([(x[0], x[3]) for x in data], "doc_id long, toxic int")
    models = []
    for n in ("4", "60"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        try:
            models.append(toxicity.train(docs, labels, epochs=1))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert len(models[0].known) and np.array_equal(models[0].known, models[1].known) and np.array_equal(models[0].table, models[1].table)
