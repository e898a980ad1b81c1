import random

import pytest

from astrolign.llm import minhash

SCHEMA = "doc_id long, text string, rep string, keys string, n_shingles int"


def brute(docs, n=2, percent=80):
    sets = {}
    for i, text in docs:
        words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
        sets[i] = {tuple(words[k : k + n]) for k in range(len(words) - n + 1)} if len(words) >= n else ({tuple(words)} if words else set())
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(s), find(i), find(i) == i) for i, s in sets.items())


def run(spark, docs, **options):
    frame = spark.createDataFrame([(i, t, "x", "y", 3) for i, t in docs], SCHEMA)
    return sorted(tuple(r) for r in minhash.near_duplicates(frame, **options).collect())


def corpus(seed=3):
    rng = random.Random(seed)
    vocabulary = [f"W{i}" for i in range(400)]
    docs = [(0, None), (1, ""), (2, " \t\n"), (3, "one"), (4, "ONE"), (5, "one two"), (6, "One  two"), (7, "Été été"), (8, "été été")]
    for g in range(12):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([8, 40, 120]))]
        for _ in range(12):
            copy = list(base)
            for _ in range(rng.randrange(0, max(1, len(base) // 7))):
                copy[rng.randrange(len(copy))] = rng.choice(vocabulary)
            docs.append((len(docs) * 3 + 10, " ".join(copy)))
    docs.append((5000, "w1 " * 30000))
    return docs


def test_near_duplicates_are_those_of_brute_force(spark):
    docs = corpus()
    assert run(spark, docs, n=2) == brute(docs)
    assert run(spark, docs, n=2, small=2) == brute(docs)  # blocks instead of pairs
    assert run(spark, docs) == brute(docs, n=5)  # five words unless said otherwise


def test_repeated_rows_give_one_row_and_null_ids_none(spark):
    docs = [(1, "a b c d"), (1, "a b c d"), (2, "A b c d"), (None, "a b c d")]
    assert run(spark, docs, n=2) == [(1, 3, 1, True), (2, 3, 1, False)]


def test_unlike_texts_of_one_id_are_refused(spark):
    with pytest.raises(ValueError, match="doc_id 1"):
        run(spark, [(1, "a b c d"), (1, "a b c e")])


def test_empty_table(spark):
    assert run(spark, []) == []
