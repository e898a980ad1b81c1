import random

import pytest

from astrolign.llm import substring_dedup


def brute(docs, size):
    words = {i: (t or "").encode().split() for i, t in docs}
    first = {}
    for i in sorted(words):
        for k in range(len(words[i]) - size + 1):
            first.setdefault(tuple(words[i][k : k + size]), i)
    out = []
    for i, w in words.items():
        gone = set()
        for k in range(len(w) - size + 1):
            if first[tuple(w[k : k + size])] < i:
                gone.update(range(k, k + size))
        out.append((i, len(w), len(gone), b" ".join(x for k, x in enumerate(w) if k not in gone).decode()))
    return sorted(out)


def corpus(seed=5):
    rng = random.Random(seed)
    passages = [[f"p{k}w{rng.randrange(40)}" for _ in range(rng.randrange(5, 60))] for k in range(15)]
    docs = [(0, None), (1, ""), (2, "only few words"), (3, " ".join(["same"] * 5000)), (4, " ".join(["same"] * 20))]
    for i in range(150):
        text = []
        for _ in range(rng.randrange(0, 6)):
            text += rng.choice(passages) if rng.random() < 0.5 else [f"u{rng.randrange(50)}é" for _ in range(rng.randrange(1, 30))]
        docs.append((1000 - i * 5, rng.choice([" ", "\n", " \t "]).join(text)))
    return docs + [(5, " ".join(f"long{k % 977}" for k in range(60_000)))]


@pytest.mark.parametrize("size,buckets", [(13, None), (13, 1), (4, 7)])
def test_removes_what_brute_force_removes(spark, size, buckets):
    docs = corpus()
    frame = spark.createDataFrame([(i, t, 1, 2, "x") for i, t in docs], "doc_id long, text string, start int, cuts int, kept string").repartition(5)
    got = sorted(tuple(r) for r in substring_dedup.deduplicate(frame, size, buckets=buckets).collect())
    assert got == brute(docs, size)


def test_null_ids_and_repeated_rows_stay(spark):
    text = " ".join(map(str, range(20)))
    frame = spark.createDataFrame([(None, text), (7, text), (7, text), (8, text)], "doc_id long, text string")
    got = sorted(((r.doc_id or -1, r.n_words, r.n_removed) for r in substring_dedup.deduplicate(frame).collect()))
    assert got == [(-1, 20, 0), (7, 20, 0), (7, 20, 0), (8, 20, 20)]


def test_empty_table(spark):
    assert substring_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_unlike_texts_of_one_id_are_refused(spark):
    with pytest.raises(ValueError, match="doc_id 7"):
        substring_dedup.deduplicate(spark.createDataFrame([(7, "a"), (7, "b"), (8, "a")], "doc_id long, text string"))


def test_copies_settle_within_batches_and_across_them(spark):
    """Hundreds of copies with their own ends, in batches of some and of all documents, in one and in many tasks."""
    rng = random.Random(9)
    shared = [f"s{k}" for k in range(80)]
    docs = []
    for i in range(300):
        cut = rng.randrange(0, 40)
        docs.append((i * 11 % 307, " ".join([*[f"a{rng.randrange(9)}" for _ in range(rng.randrange(20))], *shared[cut:], *[f"b{rng.randrange(9)}" for _ in range(rng.randrange(20))], *shared[: 60 - cut]])))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    want = brute(docs, 13)
    for parts in (1, 9):
        assert sorted(tuple(r) for r in substring_dedup.deduplicate(frame.repartition(parts), buckets=5).collect()) == want
    sent = substring_dedup.blobs(frame.coalesce(1), 13, 3, 5).where("words IS NOT NULL").collect()
    occurrences = sum(len(substring_dedup._unpacked(r.docs, substring_dedup.zstandard.ZstdDecompressor().decompress)) for r in sent)
    assert occurrences < 20 * 300  # of some 120 words a document
