"""Quality rules: base counts, and a hashed n-gram logistic regression (operator 3).

The model sees the frequencies of words, word pairs, and strings of three and four
characters, hashed into BUCKETS weights. It is fitted in one task on the features, not the
texts, of FIT_ROWS labelled rows at most (those with the smallest hash of their key), a
quarter of which is kept back to calibrate the probabilities (Platt's sigmoid). Scoring is map-side, in Arrow batches: all
windows of a text are hashed and their weights summed, whole texts always.

Null counts as empty. A text without words has no features and gets the prior; the base
rules reject it. Labels that are null or of unknown documents are ignored; of several
labels of a key the lowest counts, of several texts of a key the smallest. Without both
labels there is no model, and the base rules decide alone. Repeated rows are judged alike,
an empty table gives none, and other columns of any name take no part.
"""

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import stored
from twinsieve.llm.text_stats import Stats
from twinsieve.llm.textbatch import Texts, Words, row_chunks, seeded

FIT_ROWS = 4096
BUCKETS_LOG2 = 17
BUCKETS = 1 << BUCKETS_LOG2
KEEP_AT = 0.5
EPOCHS, STEP, RIDGE = 12, 0.15, 1e-6
_U = np.uint64
_SHIFT = _U(64 - BUCKETS_LOG2)


def grams(texts: Texts, words: Words, hashes: np.ndarray) -> Iterator[tuple[np.ndarray, ...]]:
    """For each kind of gram: bucket of each, and the range of grams of each text."""
    edges = words.first
    yield (seeded(hashes, 1) >> _SHIFT).astype(np.int32), edges[:-1], edges[1:]
    pairs = seeded(hashes[:-1], 2) + seeded(hashes[1:], 3)
    last = np.minimum(np.maximum(edges[1:] - 1, edges[:-1]), len(pairs))
    yield (seeded(pairs, 4) >> _SHIFT).astype(np.int32), np.minimum(edges[:-1], last), last
    # Where characters start: all bytes but those that continue one.
    chars = np.append(np.flatnonzero((texts.raw & 0xC0) != 0x80), len(texts.raw))
    first, last = np.searchsorted(chars, texts.begin), np.searchsorted(chars, texts.end)
    for n in (3, 4):
        size = max(len(chars) - n, 0)
        value = texts.span_hashes(chars[:size], chars[n : n + size])
        end = np.minimum(np.maximum(last - n + 1, first), size)
        yield (seeded(value, n) >> _SHIFT).astype(np.int32), np.minimum(first, end), end


def raw_scores(stats: Stats, weights: np.ndarray, bias: float) -> np.ndarray:
    score = np.full(stats.texts.n, bias)
    for buckets, begin, end in grams(stats.texts, stats.words, stats.hashes):
        total = np.concatenate(([0.0], np.cumsum(weights[buckets], dtype=np.float64)))
        score += (total[end] - total[begin]) / np.maximum(end - begin, 1)
    return score


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def platt(score: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and offset that turn scores into probabilities, by Newton's method."""
    a, b = 1.0, 0.0
    good, bad = y.sum(), len(y) - y.sum()
    goal = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    for _ in range(50):
        p = sigmoid(a * score + b)
        h = np.maximum(p * (1 - p), 1e-9)
        g = np.array([((goal - p) * score).sum() - 1e-3 * (a - 1), (goal - p).sum()])
        hess = np.array([[(h * score * score).sum() + 1e-3, (h * score).sum()], [(h * score).sum(), h.sum()]])
        da, db = np.linalg.solve(hess + 1e-9 * np.eye(2), g)
        a, b = a + np.clip(da, -1, 1), b + np.clip(db, -2, 2)
        if abs(da) + abs(db) < 1e-8:
            break
    return float(a), float(b)


def features(texts: pa.Array) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets and frequencies of each text's grams, kind by kind."""
    for a, b in row_chunks(texts):
        stats = Stats(texts[a:b])
        kinds = list(grams(stats.texts, stats.words, stats.hashes))
        for i in range(b - a):
            index, value = [np.zeros(0, np.int32)], [np.zeros(0, np.float32)]
            for buckets, begin, end in kinds:
                if end[i] > begin[i]:
                    own, times = np.unique(buckets[begin[i] : end[i]], return_counts=True)
                    index.append(own)
                    value.append((times / (end[i] - begin[i])).astype(np.float32))
            yield np.concatenate(index), np.concatenate(value)


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, (index, value) in enumerate(features(batch["_text"])):
            yield pa.RecordBatch.from_arrays(
                [batch["_key"][i : i + 1], batch["_label"][i : i + 1],
                 pa.array([index], pa.list_(pa.int32())), pa.array([value], pa.list_(pa.float32()))],
                ["_key", "_label", "_index", "_value"],
            )


def fit(sparse: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, seed: int = 5):
    """(weights, bias, slope, offset); None without rows of both kinds."""
    if len(set(y.tolist())) < 2:
        return None
    index, value = (np.concatenate(x) for x in zip(*sparse))
    edge = np.concatenate(([0], np.cumsum([len(x) for x, _ in sparse])))

    rng = np.random.default_rng(seed)
    rows = rng.permutation(len(y))
    held = rows[: len(y) // 4]
    rows = rows[len(y) // 4 :]
    weights, seen = np.zeros(BUCKETS, np.float32), np.full(BUCKETS, 1e-8, np.float32)
    bias, seen_bias = 0.0, 1e-2

    def scores(batch):
        spans = [slice(edge[r], edge[r + 1]) for r in batch]
        return np.array([bias + weights[index[s]] @ value[s] for s in spans]), spans

    for _ in range(EPOCHS):  # Adagrad over small batches
        rng.shuffle(rows)
        for at in range(0, len(rows), 32):
            batch = rows[at : at + 32]
            score, spans = scores(batch)
            error = (y[batch] - sigmoid(score)) / len(batch)
            hit = np.concatenate([index[s] for s in spans])
            push = np.concatenate([value[s] * np.float32(e) for s, e in zip(spans, error)])
            own, place = np.unique(hit, return_inverse=True)
            gradient = np.bincount(place, push, len(own)).astype(np.float32) - RIDGE * weights[own]
            seen[own] += gradient**2
            weights[own] += STEP * gradient / np.sqrt(seen[own])
            g = error.sum()
            seen_bias += g * g
            bias += STEP * g / np.sqrt(seen_bias)
    use = held if len(set(y[held].tolist())) == 2 else rows
    return weights, float(bias), *platt(scores(use)[0], y[use])


def bounded_labels(labels: DataFrame, key: str, label: str, rows: int) -> DataFrame:
    """(_key, _label) of at most `rows` labelled keys, chosen by their hash."""
    known = labels.filter(F.col(key).isNotNull() & F.col(label).isNotNull())
    known = known.groupBy(F.col(key).alias("_key")).agg(F.min(label).alias("_label"))
    return known.orderBy(F.xxhash64(F.lit(11), "_key"), "_key").limit(rows)


def fit_quality_model(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str):
    """The model, fitted in one task on a bounded sample; the driver gets the weights only."""
    chosen = stored(bounded_labels(labels, key, label, FIT_ROWS), "rules-labels")
    narrow = docs.select(F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = narrow.join(F.broadcast(chosen), "_key")
    # A key may be repeated in the documents: one of its rows is enough.
    rows = rows.groupBy("_key").agg(F.min("_label").cast("double").alias("_label"), F.min("_text").alias("_text"))
    kind = rows.schema["_key"].dataType.simpleString()
    rows = rows.mapInArrow(_features, f"_key {kind}, _label double, _index array<int>, _value array<float>")

    def run(sample: pa.Table) -> pa.Table:
        rows = [row for batch in sample.to_batches() for row in zip(*(batch[c] for c in batch.schema.names))]
        rows.sort(key=lambda row: row[0].as_py())
        sparse = [(np.asarray(index.values), np.asarray(value.values)) for _, _, index, value in rows]
        y = np.array([label.as_py() for _, label, _, _ in rows])
        return pa.table({"model": pa.array([pickle.dumps(fit(sparse, y))], pa.binary())})

    found = rows.groupBy(F.lit("all")).applyInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else None


COLUMNS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, probability double"  # noqa: E501


def quality_rules(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    keep_at: float = KEEP_AT,
) -> DataFrame:
    """(key, base counts, base_failed, kept, probability) of every row."""
    model = fit_quality_model(docs, labels, key, text, label)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fitted = shared.value
        for batch in batches:
            for a, b in row_chunks(batch["_text"]):
                stats = Stats(batch["_text"][a:b])
                failed = stats.base_failed()
                good = np.ones(b - a)
                if fitted is not None:
                    weights, bias, slope, offset = fitted
                    good = sigmoid(slope * raw_scores(stats, weights, bias) + offset)
                counts = (stats.n_words, stats.word_chars, stats.n_symbols, stats.n_dup_lines, stats.n_repeat_words)
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"][a:b], *(pa.array(c, pa.int64()) for c in counts),
                     pa.array(failed), pa.array(~failed & (good >= keep_at)), pa.array(good)],
                    ["_id", *(c.split()[0] for c in COLUMNS.split(", "))],
                )

    return narrow.mapInArrow(run, f"_id {kind}, {COLUMNS}")
