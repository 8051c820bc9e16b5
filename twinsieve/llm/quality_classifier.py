"""Quality classifier: an additive model with pairwise terms (operator 7).

The logit of a text is a sum of lookup tables: one per feature, over quantile bins, and
one per chosen pair of features, over a coarse grid. Tables are learnt by boosting in
cycles: each feature in turn gets a small tree on the gradients per bin, scaled by a
small step, so that correlated features share the credit. Then the pairs with the largest
gain on what is left are boosted in the same way with trees of one cut per side.

Features are computed map-side in Arrow batches on whole texts. The fit uses the features
of at most FIT_ROWS labelled rows (smallest hash of the key) in one task.
Scoring adds up table entries for a whole batch at once.

Null counts as empty; empty texts have features like others. Null labels and labels of
unknown documents are ignored; of several labels of a key the lowest counts. Without
labels every score is 0.5.
"""

import pickle
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import stored
from twinsieve.llm.quality_rules import bounded_labels, sigmoid
from twinsieve.llm.text_stats import FEATURES, Stats
from twinsieve.llm.textbatch import row_chunks

FIT_ROWS = 20_000
BINS, COARSE = 32, 8
ROUNDS, PAIR_ROUNDS, PAIRS = 150, 60, 8
STEP, LEAST_ROWS, RIDGE = 0.1, 10, 1.0
ACCEPT_AT = 0.7


def _best_cut(g: np.ndarray, h: np.ndarray, n: np.ndarray):
    """Gain and place of the best cut of a run of bins."""
    left_g, left_h, left_n = (np.cumsum(x)[:-1] for x in (g, h, n))
    all_g, all_h, all_n = g.sum(), h.sum(), n.sum()
    gain = left_g**2 / (left_h + RIDGE) + (all_g - left_g) ** 2 / (all_h - left_h + RIDGE)
    gain = gain - all_g**2 / (all_h + RIDGE)
    gain[(left_n < LEAST_ROWS) | (all_n - left_n < LEAST_ROWS)] = -1
    at = int(np.argmax(gain)) if len(gain) else 0
    return (gain[at], at + 1) if len(gain) and gain[at] > 1e-9 else (0.0, 0)


def _tree(g: np.ndarray, h: np.ndarray, n: np.ndarray, depth: int) -> np.ndarray:
    """Leaf value of each bin, for a tree of so many levels over the bins."""
    gain, cut = _best_cut(g, h, n) if depth else (0.0, 0)
    if not cut:
        return np.full(len(g), g.sum() / (h.sum() + RIDGE))
    return np.concatenate(
        [_tree(g[s], h[s], n[s], depth - 1) for s in (slice(0, cut), slice(cut, None))]
    )


def _quadrants(g: np.ndarray, h: np.ndarray):
    """Best gain and leaf values of a grid cut once along each side."""
    sums = [np.pad(np.cumsum(np.cumsum(x, 0), 1), ((1, 0), (1, 0))) for x in (g, h)]
    best, at = 0.0, None
    for i in range(1, g.shape[0]):
        for j in range(1, g.shape[1]):
            parts = [
                [s[i, j], s[i, -1] - s[i, j], s[-1, j] - s[i, j], s[-1, -1] - s[i, -1] - s[-1, j] + s[i, j]]
                for s in sums
            ]
            gain = sum(a * a / (b + RIDGE) for a, b in zip(*parts))
            if gain > best:
                best, at = gain, (i, j, [a / (b + RIDGE) for a, b in zip(*parts)])
    leaves = np.zeros(g.shape)
    if at:
        i, j, (a, b, c, d) = at
        leaves[:i, :j], leaves[:i, j:], leaves[i:, :j], leaves[i:, j:] = a, b, c, d
    return best, leaves


def fit(x: np.ndarray, y: np.ndarray) -> dict | None:
    """Tables, from a row of features and a label 0 or 1 for each text."""
    if not len(y):
        return None
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    bins = np.stack([np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(edges)], axis=1)
    sizes = [len(e) + 1 for e in edges]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    bias = float(np.log(rate / (1 - rate)))
    logit = np.full(len(y), bias)
    tables = [np.zeros(s) for s in sizes]
    rows = [np.bincount(bins[:, f], minlength=s) for f, s in enumerate(sizes)]
    for _ in range(ROUNDS):
        for f, size in enumerate(sizes):
            p = sigmoid(logit)
            g = np.bincount(bins[:, f], y - p, size)
            h = np.bincount(bins[:, f], p * (1 - p), size)
            update = STEP * _tree(g, h, rows[f], 2)
            tables[f] += update
            logit += update[bins[:, f]]

    coarse = [np.arange(s) * min(COARSE, s) // s for s in sizes]
    cells = np.stack([c[bins[:, f]] for f, c in enumerate(coarse)], axis=1)
    width = [int(c[-1]) + 1 for c in coarse]

    def grid(a: int, b: int):
        p = sigmoid(logit)
        cell = cells[:, a] * width[b] + cells[:, b]
        shape = (width[a], width[b])
        return cell, *(np.bincount(cell, v, width[a] * width[b]).reshape(shape) for v in (y - p, p * (1 - p)))

    gains = {(a, b): _quadrants(*grid(a, b)[1:])[0] for a, b in combinations(range(len(sizes)), 2)}
    pairs = sorted(gains, key=lambda k: (-gains[k], k))[:PAIRS]
    pair_tables = [np.zeros((width[a], width[b])) for a, b in pairs]
    for _ in range(PAIR_ROUNDS):
        for t, (a, b) in enumerate(pairs):
            cell, g, h = grid(a, b)
            update = STEP * _quadrants(g, h)[1]
            pair_tables[t] += update
            logit += update.reshape(-1)[cell]
    return {"edges": edges, "bias": bias, "tables": tables, "coarse": coarse, "pairs": pairs, "pair_tables": pair_tables}


def score(model: dict | None, x: np.ndarray) -> np.ndarray:
    if model is None:
        return np.full(len(x), 0.5)
    bins = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(model["edges"])]
    logit = np.full(len(x), model["bias"])
    for f, table in enumerate(model["tables"]):
        logit += table[bins[f]]
    for (a, b), table in zip(model["pairs"], model["pair_tables"]):
        logit += table[model["coarse"][a][bins[a]], model["coarse"][b][bins[b]]]
    return sigmoid(logit)


def features_of(texts: pa.Array) -> np.ndarray:
    rows = [Stats(texts[a:b]).features() for a, b in row_chunks(texts)]
    return np.concatenate([np.empty((0, len(FEATURES))), *rows])


def fit_classifier(
    docs: DataFrame,
    labels: DataFrame,
    key: str = "doc_id",
    text: str = "text",
    label: str = "quality",
    learn: Column | None = None,
) -> dict | None:
    """The tables, fitted in one task; `learn` is a condition on `labels`: which to use."""
    labels = labels.filter(learn) if learn is not None else labels
    chosen = stored(bounded_labels(labels, key, label, FIT_ROWS), "classifier-labels")
    rows = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    rows = rows.join(F.broadcast(chosen), rows["_id"] == chosen["_key"])

    @F.arrow_udf("array<double>")
    def measured(texts: pa.Array) -> pa.Array:
        return pa.array(list(features_of(texts)), pa.list_(pa.float64()))

    rows = rows.select("_key", "_label", measured("_text").alias("_features")).groupBy("_key")
    # A key may be repeated in the documents: one of its rows is enough.
    rows = rows.agg(F.min("_label").alias("_label"), F.min("_features").alias("_features"))

    def run(sample: pa.Table) -> pa.Table:
        sample = sample.take(pa.array(np.argsort(np.asarray(sample["_key"]), kind="stable")))
        lists = sample["_features"].combine_chunks()
        x = np.asarray(lists.flatten()).reshape(-1, len(FEATURES))
        model = fit(x, np.asarray(sample["_label"]).astype(np.float64))
        return pa.table({"model": pa.array([pickle.dumps(model)], pa.binary())})

    found = rows.groupBy(F.lit("all")).applyInArrow(run, "model binary").first()
    return pickle.loads(found.model) if found else None


def quality_score(model: dict | None, text: Column) -> Column:
    """The probability of label 1, for use on any frame: map-side, nothing is shuffled."""

    @F.arrow_udf("double")
    def scored(texts: pa.Array) -> pa.Array:
        return pa.array(score(model, features_of(texts)))

    return scored(text)
