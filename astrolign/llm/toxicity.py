"""Toxicity: a convolutional text classifier over hashed word embeddings, trained in numpy.

A word is three hashed rows (two hashes of the word, one of its first letters); their sum is its vector. Filters of
width 1, 2 and 3 slide over the words, each filter keeps its largest value in the document, and a logistic layer makes
the score. A document without words scores what the padding scores. Thresholds are calibrated for each language.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

WIDTHS = (1, 2, 3)
PAD = max(WIDTHS) - 1
#: Words that a scorer remembers between batches; beyond, it starts anew.
KEPT_WORDS = 200_000
_EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")


def words_of(text: str) -> list[str]:
    """Lower-case words between white space, as they stand; buckets_of strips what isn't a letter from their ends."""
    return text.lower().split()


def buckets_of(word: str, size: int, prefix: int) -> tuple[int, int, int]:
    word = _EDGES.sub("", word)
    h = xxhash.xxh64_intdigest(word)
    return h % size, size + (h >> 32) % size, 2 * size + xxhash.xxh64_intdigest(word[:prefix], 7) % size


@dataclass
class ConvTextClassifier:
    """size: rows of each of the three hash tables; dim: of a word's vector; filters: of each width."""

    size: int = 1 << 15
    dim: int = 8
    filters: int = 8
    prefix: int = 5
    epochs: int = 4
    rate: float = 0.02
    seed: int = 11
    thresholds: dict = field(default_factory=dict)

    def fit(self, texts: list[str], labels: list[int]) -> ConvTextClassifier:
        rng = np.random.default_rng(self.seed)
        n, d, f = len(texts), self.dim, self.filters
        y = np.asarray(labels, float)
        vocabulary: dict[str, int] = {}
        docs = [np.array([vocabulary.setdefault(w, len(vocabulary)) for w in words_of(t)], np.int64) for t in texts]
        rows = np.array([buckets_of(w, self.size, self.prefix) for w in vocabulary] or [(0, 0, 0)], np.int64)
        # Rows seen in fewer than three documents stay zero: unknown words. The others start along the log odds of their documents' labels.
        seen = np.zeros((2, 3 * self.size))
        for doc, label in zip(docs, y, strict=True):
            seen[int(label), np.unique(rows[doc])] += 1
        odds = np.log((seen[1] + 0.5) / (y.sum() + 1)) - np.log((seen[0] + 0.5) / (n - y.sum() + 1))
        used = np.flatnonzero(seen.sum(0) >= 3)
        place = np.full(3 * self.size, len(used))
        place[used] = np.arange(len(used))
        triples, rows = rows, place[rows]
        keep = np.ones(len(used), bool)
        start = np.random.default_rng([self.seed, 1])  # filters start alike whatever the texts are, so that models of shards can be averaged
        p = {"E": rng.normal(0, 0.02, (len(used) + 1, d)), "o": start.uniform(0.2, 0.6, len(WIDTHS) * f), "c": np.array([-2.0])}
        p["E"][:-1, 0] = odds[used] / 4
        p["E"][-1] = 0
        for w in WIDTHS:
            p[f"W{w}"], p[f"b{w}"] = start.normal(0, 0.3 / np.sqrt(w * d), (w, d, f)), np.full(f, -0.1)
            p[f"W{w}"][:, 0] += 0.6 / w
        moments = {k: (np.zeros_like(v), np.zeros_like(v)) for k, v in p.items()}
        step = 0
        for epoch in range(self.epochs if n else 0):
            rate = self.rate * (1 - 0.8 * epoch / self.epochs)
            if epoch == self.epochs - 1:  # rows that raise no filter much leave; the last round adapts the rest to that
                most = np.max([np.abs(p["E"] @ p[f"W{w}"][j]).max(1) * (p["E"] @ p[f"W{w}"][j]).max(1).__gt__(0) for w in WIDTHS for j in range(w)], axis=0)
                keep = most[:-1] > 0.08 * most.max()
                p["E"][:-1][~keep] = 0
                place[used[~keep]] = len(used)
                rows = place[triples]
            order = rng.permutation(n)
            for at in range(0, n, 64):
                step += 1
                batch = order[at : at + 64]
                ids, starts, ends = _lay_out([docs[i] for i in batch])
                x = np.zeros((len(ids), d))
                x[ids >= 0] = p["E"][rows[ids[ids >= 0]]].sum(1)
                pooled, best = [], []
                for w in WIDTHS:
                    value = sum(x[j : len(x) - PAD + j] @ p[f"W{w}"][j] for j in range(w)) + p[f"b{w}"]
                    at_most = np.stack([s + value[s:e].argmax(0) for s, e in zip(starts, ends, strict=True)])
                    best.append(at_most)
                    pooled.append(np.take_along_axis(value, at_most, 0))
                h = np.maximum(np.concatenate(pooled, 1), 0)
                error = (_sigmoid(h @ p["o"] + p["c"]) - y[batch]) / len(batch)
                g = {"o": h.T @ error, "c": error.sum(keepdims=True)}
                back = error[:, None] * p["o"] * (h > 0)
                touched, deltas = [], []
                for k, w in enumerate(WIDTHS):
                    part = back[:, k * f : (k + 1) * f]
                    at_words = best[k][:, :, None] + np.arange(w)
                    g[f"W{w}"] = np.einsum("nf,nfwd->wdf", part, x[at_words])
                    g[f"b{w}"] = part.sum(0)
                    delta = np.einsum("nf,wdf->nfwd", part, p[f"W{w}"]).reshape(-1, d)
                    word = ids[at_words].reshape(-1)
                    live = word >= 0
                    touched.append(rows[word[live]].reshape(-1))
                    deltas.append(np.repeat(delta[live], 3, axis=0))
                touched, deltas = np.concatenate(touched), np.concatenate(deltas)
                live = touched < len(used)
                some, inverse = np.unique(touched[live], return_inverse=True)
                sums = np.zeros((len(some), d))
                np.add.at(sums, inverse, deltas[live])
                for key, grad in g.items():
                    _adam(p[key], moments[key], grad, rate, step)
                if len(some):
                    m, v = moments["E"][0][some], moments["E"][1][some]
                    part = p["E"][some]
                    _adam(part, (m, v), sums, rate, step)
                    p["E"][some], moments["E"][0][some], moments["E"][1][some] = part, m, v
        self.all_rows = used, seen.sum(0)[used], p["E"][:-1]
        self.known, self.table = used[keep], p["E"][:-1][keep].astype(np.float32)
        self.layers = {k: v.astype(np.float32) for k, v in p.items() if k != "E"}
        return self

    def scorer(self):
        """A function from texts to scores. It keeps each word's part of every filter, so a word is hashed once."""
        place = np.zeros(3 * self.size, np.int64)
        place[self.known] = np.arange(1, len(self.known) + 1)
        blocks = np.concatenate([self.layers[f"W{w}"][j] for w in WIDTHS for j in range(w)], axis=1)
        rows = np.concatenate([np.zeros((1, self.dim), np.float32), self.table]) @ blocks
        f = self.filters
        known: dict[tuple, int] = {(0, 0, 0): 0}
        triples = [(0, 0, 0)]

        class Memo(dict):
            def __missing__(memo, word: str) -> int:  # noqa: N805
                a, b, c = buckets_of(word, self.size, self.prefix)
                triple = (own[a], own[b], own[c])
                if (at := known.get(triple)) is None:
                    at = known[triple] = len(triples)
                    triples.append(triple)
                memo[word] = at
                return at

        memo = Memo()
        look_up = memo.__getitem__
        own = place.tolist()

        def score(texts: list[str]) -> np.ndarray:
            docs = [_near_known(np.fromiter(map(look_up, words_of(t)), np.int64)) for t in texts]
            ids, starts, ends = _lay_out(docs, 0)
            some, ids = np.unique(ids, return_inverse=True)
            table = rows[np.array(triples)[some]].sum(1)
            if max(len(triples), len(memo)) > KEPT_WORDS:
                memo.clear(), known.clear(), triples.clear()
                triples.append((0, 0, 0))
                known[triples[0]] = 0
            pooled, block = [], 0
            for w in WIDTHS:
                value = np.zeros((len(ids) - PAD, f), np.float32)
                for j in range(w):
                    own = np.ascontiguousarray(table[:, block : block + f])
                    value += own[ids[j : len(ids) - PAD + j]]
                    block += f
                bounds = np.stack([starts, ends], 1).reshape(-1)  # between an end and the next start lies padding
                bounds[-1] = min(bounds[-1], len(value) - 1)
                most = np.maximum.reduceat(value, bounds[:-1] if len(bounds) > 1 else bounds, axis=0)[::2]
                pooled.append(most + self.layers[f"b{w}"])
            h = np.maximum(np.concatenate(pooled, 1), 0)
            return _sigmoid(h.astype(float) @ self.layers["o"].astype(float) + float(self.layers["c"][0]))

        return score


def _lay_out(docs: list[np.ndarray], pad: int = -1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word ids of all documents with padding after each; where each document's windows start and end. A document has a window at least."""
    sizes = np.array([max(1, len(d)) for d in docs], np.int64) + PAD
    starts = np.concatenate([[0], np.cumsum(sizes)])
    ids = np.full(int(starts[-1]), pad, np.int64)
    for s, d in zip(starts, docs, strict=False):
        ids[s : s + len(d)] = d
    return ids, starts[:-1], starts[1:] - PAD


def _near_known(ids: np.ndarray) -> np.ndarray:
    """Leaves out unknown words (0) with no known word within a filter's width: their windows all have the value that padding has."""
    near = ids > 0
    for k in range(1, PAD + 1):
        near[k:] |= ids[:-k] > 0
        near[:-k] |= ids[k:] > 0
    return ids[near]


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _adam(value, moments, grad, rate, step):
    m, v = moments
    m *= 0.9
    m += 0.1 * grad
    v *= 0.98
    v += 0.02 * grad * grad
    value -= rate * m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.98**step)) + 1e-8)


def best_threshold(scores: np.ndarray, labels: np.ndarray) -> float:
    """The threshold of the largest F1; among equals, the middle of the widest gap's bounds."""
    order = np.argsort(-scores, kind="stable")
    s, y = scores[order], labels[order]
    hits = np.cumsum(y)
    f1 = 2 * hits / (np.arange(1, len(y) + 1) + y.sum())
    f1[:-1][s[:-1] == s[1:]] = -1
    k = int(f1.argmax())
    return float((s[k] + s[k + 1]) / 2) if k + 1 < len(s) else float(s[k])


def held_out(doc_id="doc_id"):
    """True for rows that learning never sees: crc32 of the id's text, modulo 4, is 2."""
    return F.coalesce(F.pmod(F.crc32(F.col(doc_id).cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def _marks(labels: DataFrame) -> DataFrame:
    return labels.where(F.col("toxic").isNotNull() & ~held_out()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max("toxic").alias("toxic"))


def _rows(docs: DataFrame) -> DataFrame:
    lang = F.col("lang").cast("string") if "lang" in docs.columns else F.lit(None).cast("string")
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), lang.alias("lang"))


def train(docs: DataFrame, labels: DataFrame, max_rows: int | None = None, **options) -> ConvTextClassifier:
    """Fits on all labelled documents with their whole texts. Labels without a document don't count. A doc_id with several labels counts as toxic if one of them
    says so; with several texts, the first in string order counts (null first).

    Documents are dealt by doc_id into shards of some SHARD, whatever the number of shuffle partitions, each of which is fitted in a task from the same filters; a row of the embedding is then the mean of the shards that know it, by how many documents hold it, filters the
    mean by documents. Thresholds are calibrated on all labelled documents too, each by the score of a model that didn't see it: that of the shards of the other parity, or, where there is one shard, one of FOLDS more fits, each
    without a part of the documents. What comes to the driver is a few models. max_rows: fits on so many labelled documents only, in the driver."""
    if max_rows is not None:
        return _train_some(docs, labels, max_rows, **options)
    marks, rows = _marks(labels), _rows(docs)
    r = F.xxhash64(F.lit("fit"), "doc_id")
    shards = max(1, -(-marks.count() // SHARD))
    shard = F.pmod(F.xxhash64(F.lit("shard"), "doc_id"), F.lit(shards)).cast("int")
    fold = shard % 2 if shards > 1 else F.pmod(r, F.lit(FOLDS)).cast("int")
    fit = rows.where(~held_out()).select("doc_id", "text").join(marks.hint("merge"), "doc_id").select("doc_id", r.alias("r"), "text", (F.col("toxic") > 0).cast("int").alias("toxic"), (shard if shards > 1 else fold).alias("task"))
    if shards == 1:
        fit = fit.withColumn("task", F.explode(F.filter(F.sequence(F.lit(0), F.lit(FOLDS)), lambda k: k != F.col("task"))))
    fit = fit.repartitionById(max(shards, FOLDS + 1), "task")  # a join would deal shards out anew, over all shuffle partitions
    out = pa.schema([("block", pa.int32()), ("half", pa.int32()), ("shard", pa.int32()), ("places", pa.binary()), ("weights", pa.binary()), ("sums", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tasks: dict[int, dict[int, tuple]] = {}
        for batch in batches:
            for doc_id, at, text, toxic, task in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own = tasks.setdefault(task, {})
                own[doc_id] = min(own.get(doc_id, (at, doc_id, text or "", toxic)), (at, doc_id, text or "", toxic))
        for task, own in sorted(tasks.items()):
            docs = sorted(own.values())
            model = ConvTextClassifier(**options).fit([d[2] for d in docs], [d[3] for d in docs])
            used, weights, table = model.all_rows
            parts = [(-1, np.zeros(1, np.int64), np.array([float(len(docs))]), _flat(model.layers)[None] * len(docs))]
            parts += [(k, used[m], weights[m], table[m] * weights[m, None]) for k in np.unique(used // BLOCK).tolist() for m in [used // BLOCK == k]]
            for k, places, w, sums in parts:
                row = k, task % 2 if shards > 1 else task, task, places.astype("<i8").tobytes(), w.astype("<f8").tobytes(), sums.astype("<f8").tobytes()
                yield pa.RecordBatch.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

    def add(table: pa.Table) -> pa.Table:
        rows = table.sort_by("shard").to_pylist()
        row = rows[0]["block"], rows[0]["half"], 0, *[x.tobytes() for x in _added(rows)]
        return pa.Table.from_arrays([pa.array([x], f.type) for x, f in zip(row, out, strict=True)], schema=out)

    sql = "block int, half int, shard int, places binary, weights binary, sums binary"
    found = [x.asDict() for x in sorted(fit.mapInArrow(run, sql).groupBy("block", "half").applyInArrow(add, sql).collect())]  # the rows of a few models
    halves = {k: [x for x in found if x["half"] == k] for k in range(FOLDS + 1)}
    model = _averaged(found if shards > 1 else halves[FOLDS], options)
    unseen = [_averaged(halves[1 - k if shards > 1 else k], options) for k in range(2 if shards > 1 else FOLDS)]
    scored = [_scored(rows.where(~held_out() & (fold == k)), one) for k, one in enumerate(unseen)]
    model.thresholds = _calibrated(reduce(DataFrame.unionAll, scored).join(marks, "doc_id"))
    return model


def _added(rows: list[dict]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """places, weights, sums of one block of the embedding, of several shards."""
    total: dict[int, list] = {}
    for row in rows:
        places, w = np.frombuffer(row["places"], "<i8"), np.frombuffer(row["weights"])
        for place, weight, value in zip(places.tolist(), w, np.frombuffer(row["sums"]).reshape(len(places), -1), strict=True):
            known = total.setdefault(place, [0.0, 0.0])
            known[0], known[1] = known[0] + weight, known[1] + value
    places = sorted(total)
    return np.array(places, "<i8"), np.array([total[k][0] for k in places]), np.stack([total[k][1] for k in places])


def _averaged(found: list[dict], options: dict) -> ConvTextClassifier:
    """The mean of fitted models, of rows (block, half, shard, places, weights, sums)."""
    model = ConvTextClassifier(**options).fit([], [])
    blocks: dict[int, list] = {}
    for row in found:
        blocks.setdefault(row["block"], []).append(row)
    if blocks:
        (_, weight, sums), *rest = [_added(own) for _, own in sorted(blocks.items())]
        model.layers = _unflat(sums[0] / weight, model.layers)
        places = np.concatenate([np.zeros(0, np.int64), *[x for x, _, _ in rest]])
        table = np.concatenate([np.zeros((0, model.dim)), *[sums / w[:, None] for _, w, sums in rest]])
        most = np.max([(table @ model.layers[f"W{w}"][j]).max(1, initial=0) for w in WIDTHS for j in range(w)], axis=0)
        keep = most > 0.08 * most.max(initial=0)
        model.known, model.table = places[keep], table[keep].astype(np.float32)
    del model.all_rows
    return model


#: Documents of a shard; rows of the embedding that are summed at once; cells of scores that thresholds are chosen from; parts of the documents of a single shard, each of which is scored by a model of the others.
SHARD, BLOCK, CELLS, FOLDS = 16384, 2048, 4096, 5


def _flat(layers: dict[str, np.ndarray]) -> np.ndarray:
    return np.concatenate([layers[k].astype(float).ravel() for k in sorted(layers)])


def _unflat(values: np.ndarray, like: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    ends = np.cumsum([like[k].size for k in sorted(like)])
    return {k: values[e - like[k].size : e].reshape(like[k].shape).astype(np.float32) for k, e in zip(sorted(like), ends.tolist(), strict=True)}


def _calibrated(scored: DataFrame) -> dict:
    """The threshold of the largest F1 of all languages and of each with ten toxic documents at least (score, lang, toxic; every row counts), between cells of scores."""
    cell = F.least(F.floor(F.col("score") * CELLS), F.lit(CELLS - 1)).cast("int")
    counts = scored.groupBy("lang", cell.alias("cell")).agg(F.count("*").alias("n"), F.sum((F.col("toxic") > 0).cast("long")).alias("hits")).collect()
    table = {own: np.zeros((2, CELLS), np.int64) for own in {None, *(x.lang for x in counts)}}
    for x in counts:
        for own in {None, x.lang}:
            table[own][:, x.cell] += x.n, x.hits
    thresholds = {None: 0.5}
    for own, (n, hits) in table.items():
        if (0 if own is None else 9) < hits.sum() < n.sum():
            cells = np.flatnonzero(n)[::-1]
            f1 = 2 * np.cumsum(hits[cells]) / (np.cumsum(n[cells]) + hits.sum())
            k = int(f1.argmax())
            thresholds[own] = float((cells[k] + (cells[k + 1] + 1 if k + 1 < len(cells) else cells[k])) / 2 / CELLS)
    return thresholds


def _train_some(docs: DataFrame, labels: DataFrame, max_rows: int, **options) -> ConvTextClassifier:
    """train() on max_rows labelled documents (all, if there are fewer), the first by a hash of the id; a fifth of them calibrates thresholds."""
    marks, rows = _marks(labels), _rows(docs)
    drawn = marks.join(rows.select("doc_id"), "doc_id", "left_semi").withColumn("r", F.xxhash64(F.lit("fit"), "doc_id")).orderBy("r", "doc_id").limit(max_rows)
    rows = rows.join(F.broadcast(drawn), "doc_id")  # at most max_rows of two numbers
    rows = rows.groupBy("doc_id").agg(F.first("r").alias("r"), F.first("toxic").alias("toxic"), F.min(F.struct("text", "lang")).alias("own")).select("r", "doc_id", "own.text", "own.lang", "toxic").collect()
    rows.sort(key=lambda r: (r.r, r.doc_id))
    model = ConvTextClassifier(**options)
    fit, rest = [r for i, r in enumerate(rows) if i % 5], rows[::5]
    model.fit([r.text or "" for r in fit], [int(r.toxic > 0) for r in fit])
    scores, y = (model.scorer()([r.text or "" for r in rest]) if rest else np.zeros(0)), np.array([int(r.toxic > 0) for r in rest])
    model.thresholds = {None: best_threshold(scores, y) if y.any() and not y.all() else 0.5}
    for own in {r.lang for r in rest} - {None}:
        at = np.array([r.lang == own for r in rest])
        if 10 <= y[at].sum() < at.sum():
            model.thresholds[own] = best_threshold(scores[at], y[at])
    return model


def score(docs: DataFrame, model: ConvTextClassifier) -> DataFrame:
    """doc_id, score (0 to 1) of every row's whole text, and toxic_in_language: whether it reaches the threshold that was calibrated for the row's lang, which the score itself doesn't read.
    Null and empty texts score as a text without words, a null doc_id stays null; very long texts are scored whole. A row in, a row out; repeated rows score alike; other columns are left out."""
    return _scored(_rows(docs), model).select("doc_id", "score", (F.col("score") >= threshold_of(model, F.col("lang"))).alias("toxic_in_language"))


def _scored(rows: DataFrame, model: ConvTextClassifier) -> DataFrame:
    """doc_id, lang, score of rows (doc_id, text, lang)."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # bounded by the sizes of the model
    out = pa.schema([("doc_id", pa.int64()), ("lang", pa.string()), ("score", pa.float64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = shared.value.scorer()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), pa.array(scorer([x or "" for x in part.column(1).to_pylist()]))], schema=out)

    return rows.mapInArrow(run, "doc_id long, lang string, score double")


def threshold_of(model: ConvTextClassifier, lang):
    """Column: the calibrated threshold of a language; that of all languages where it had too few labels."""
    out = F.lit(model.thresholds[None])
    for own, at in model.thresholds.items():
        if own is not None:
            out = F.when(lang == own, F.lit(at)).otherwise(out)
    return out


def keep_clean(docs: DataFrame, model: ConvTextClassifier) -> DataFrame:
    """docs without rows that score their language's threshold or more. Needs no join: the score is a column beside all others."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def scored(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scorer = shared.value.scorer()
        for part in parts:
            own = [x or "" for x in part]
            yield pd.Series(np.concatenate([scorer(own[i : i + 256]) for i in range(0, len(own), 256)]) if own else np.zeros(0))

    lang = F.col("lang") if "lang" in docs.columns else F.lit(None)
    return docs.where(scored(F.col("text").cast("string")) < threshold_of(model, lang))
