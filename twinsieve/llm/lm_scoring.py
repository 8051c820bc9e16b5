"""Language-model scores of texts (operator 10).

Two models, both from counts over every document that may be learnt from:

* The base counts tokens: words of bytes that are no white space, with A-Z lowered, and
  one end per text. Counts of the TOP_WORDS most frequent words, a bounded table, are
  broadcast; only the rarer words of each text are shuffled to meet their counts.
* The model mixes the opinions of bit predictors with contexts of one to five bytes
  (`mixing_model`). Its count tables come from all six-byte strings of the corpus, its
  weights from online steps over the same strings in SLICES fixed by their hashes, each
  string with its own case left out of the counts. Whatever tasks see is added up, so
  that one model results, however the input is partitioned. Its size is bounded by SLOTS,
  whatever the corpus, and small enough to broadcast. It goes on adapting within each text.

Words and strings are compared by 64-bit hash and by value, in that order.

Null counts as empty: one end, no words. Without documents to learn from all counts are 0,
and the model gives every bit one half.
"""

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from twinsieve.llm.columns import stored
from twinsieve.llm.mixing_model import GATES, INPUTS, ORDERS, SLOTS, Mixer, add_counts, byte_strings
from twinsieve.llm.textbatch import Texts, distinct_by_text, row_chunks, sums_by

TOP_WORDS = 1 << 18
END = 0  # stands for the end among word hashes
STRINGS_PER_TASK = 2_000_000
SLICES = 8  # online steps, one after the other
PART = 1 << 14  # values of an array of sums that travel together
LEARN_BATCH = 65_536
_U = np.uint64


def _signed(x: np.ndarray) -> pa.Array:
    return pa.array(x.astype(np.uint64).view(np.int64))


def _unsigned(x) -> np.ndarray:
    return np.asarray(x).view(np.uint64)


def corpus_counts(texts: DataFrame) -> DataFrame:
    """(kind, item, n): words, six-byte strings, and the end, over all rows of `_text`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b in row_chunks(batch["_text"]):
                chunk = Texts(batch["_text"][a:b], lower=True)
                words = np.unique(chunk.words().hashes(), return_counts=True)
                plain = Texts(batch["_text"][a:b])
                strings = np.unique(byte_strings(plain), return_counts=True)
                end = (np.array([END], np.uint64), np.array([b - a]))
                for kind, (items, n) in (("w", words), ("s", strings), ("w", end)):
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([kind] * len(items), pa.string()), _signed(items), pa.array(n.astype(np.int64))],
                        ["kind", "item", "n"],
                    )

    found = texts.mapInArrow(run, "kind string, item long, n long")
    return found.groupBy("kind", "item").agg(F.sum("n").alias("n"))


def _spread(strings: DataFrame) -> DataFrame:
    """The strings with their slice, in as few tasks as their number asks for. Rows of a
    slice lie together, so that reading one skips the others."""
    tasks = -(-strings.count() // STRINGS_PER_TASK)
    sliced = strings.withColumn("slice", F.pmod(F.xxhash64("item"), F.lit(SLICES)).cast("int"))
    return sliced.repartition(max(tasks, 1), F.xxhash64("item", F.lit(1))).sortWithinPartitions("slice")


def _added(strings: DataFrame, work: Callable, shape: tuple[int, ...], dtype) -> np.ndarray:
    """The sum of what `work(sums, items, n)` adds to an array of this fixed shape, over
    all (item, n) of `strings`.

    Tasks add up on their own, then parts of their arrays meet part by part.
    """
    size = int(np.prod(shape))
    parts = -(-size // PART)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(parts * PART, dtype)
        for batch in batches:
            items, n = _unsigned(batch["item"]), np.asarray(batch["n"])
            for a in range(0, len(items), LEARN_BATCH):
                work(sums[:size].reshape(shape), items[a : a + LEARN_BATCH], n[a : a + LEARN_BATCH])
        for part, values in enumerate(sums.reshape(parts, PART)):
            if not values.any():
                continue
            if dtype == np.int64 and values.max() < 1 << 31:
                values = values.astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([values.tobytes()], pa.binary())], ["part", "data"]
            )

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(PART, dtype)
        for batch in batches:
            for data in batch["data"]:
                raw = data.as_buffer()
                total += np.frombuffer(raw, np.int32 if raw.size < 8 * PART else dtype)
        yield pa.RecordBatch.from_arrays(
            [batch["part"][:1], pa.array([total.tobytes()], pa.binary())], ["part", "data"]
        )

    found = strings.mapInArrow(run, "part int, data binary")
    sums = np.zeros((parts, PART), dtype)
    for part, data in found.groupBy("part").applyInArrow(add, "part int, data binary").collect():
        sums[part] = np.frombuffer(data, dtype)
    return sums.reshape(-1)[:size].reshape(shape)


def fit_mixer(strings: DataFrame) -> Mixer:
    """The model of all (item, n, slice) of a stored table of six-byte strings."""
    counts = _added(strings, add_counts, (ORDERS, 2, SLOTS), np.int64).astype(np.float32)
    shared = strings.sparkSession.sparkContext.broadcast(counts)
    mixer = Mixer.fresh(counts)

    def as_learnt(weights: np.ndarray) -> Mixer:
        own = Mixer.fresh(shared.value)
        own.weights = weights
        return own

    for number in range(SLICES):

        def slopes(sums, items, n, weights=mixer.weights, number=number):
            as_learnt(weights).add_slopes(sums, items, n.astype(np.float64), number)

        part = strings.filter(F.col("slice") == number)
        mixer.step(_added(part, slopes, (GATES, 8, INPUTS, INPUTS + 1), np.float64))

    def outcomes(sums, items, n, weights=mixer.weights):
        as_learnt(weights).add_outcomes(sums, items, n.astype(np.float64))

    mixer.curve = _added(strings, outcomes, mixer.curve.shape, np.float64)
    shared.unpersist()
    return mixer


def lm_scores(
    docs: DataFrame, key: str = "doc_id", text: str = "text", learn: Column | None = None
) -> DataFrame:
    """(_id, n_tokens, n_known, train_tokens, base_score, score, bits_per_byte) of every row.

    `learn` is a condition on the columns of `docs`: which rows to learn from.
    """
    learnt = docs.filter(learn) if learn is not None else docs
    counts = stored(corpus_counts(learnt.select(F.col(text).alias("_text"))), "lm-counts")
    words = counts.filter("kind = 'w'").select("item", "n")
    n_types, n_tokens = words.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    top = words.orderBy(F.col("n").desc(), "item").limit(TOP_WORDS).toArrow()
    items = _unsigned(top["item"].to_numpy())
    order = np.argsort(items)
    top_items, top_counts = items[order], top["n"].to_numpy()[order]
    mixer = fit_mixer(_spread_stored(counts))
    shared = docs.sparkSession.sparkContext.broadcast((mixer, top_items, top_counts))
    divisor = float(n_tokens + n_types + 1)

    narrow = docs.select(F.col(key).alias("_id"), F.col(text).alias("_text"))
    kind = narrow.schema["_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, common, times = shared.value
        end_count = int(times[np.searchsorted(common, END)]) if len(common) and common[0] == END else 0
        for batch in batches:
            for a, b in row_chunks(batch["_text"]):
                n = b - a
                found = Texts(batch["_text"][a:b], lower=True).words()
                doc, item, tf = distinct_by_text(found.text, found.hashes())
                at = np.minimum(np.searchsorted(common, item), max(len(common) - 1, 0))
                known = common[at] == item if len(common) else np.zeros(len(item), bool)
                c = times[at[known]]
                base = sums_by(doc[known], tf[known] * np.log10((c + 1) / divisor), n)
                base = base + np.log10((end_count + 1) / divisor)
                n_known = sums_by(doc[known], tf[known], n) + (end_count > 0)
                rare = ~known
                offsets = np.concatenate(([0], np.cumsum(np.bincount(doc[rare], minlength=n)))).astype(np.int32)
                lists = [
                    pa.ListArray.from_arrays(pa.array(offsets), v)
                    for v in (_signed(item[rare]), pa.array(tf[rare].astype(np.int32)))
                ]
                plain = Texts(batch["_text"][a:b])
                bits = model.text_bits(plain)
                yield pa.RecordBatch.from_arrays(
                    [batch["_id"][a:b], pa.array(found.count + 1, pa.int64()), pa.array(n_known, pa.int64()),
                     pa.array(base), pa.array(-bits * np.log10(2)), pa.array(bits / (plain.end - plain.begin + 1)),
                     *lists],
                    ["_id", "n_tokens", "_known", "_base", "score", "bits_per_byte", "_rare", "_tf"],
                )

    columns = "n_tokens long, _known long, _base double, score double, bits_per_byte double"
    scored = narrow.mapInArrow(run, f"_id {kind}, {columns}, _rare array<long>, _tf array<int>")
    # Numbered once stored: keys may be null or repeated.
    scored = stored(scored.withColumn("_row", F.monotonically_increasing_id()), "lm-scored")
    rare = scored.select("_row", F.explode(F.arrays_zip("_rare", "_tf")).alias("_w"))
    rare = rare.select("_row", F.col("_w._rare").alias("item"), F.col("_w._tf").alias("_n"))
    met = rare.join(words.withColumnRenamed("n", "_c"), "item", "left")
    c = F.coalesce("_c", F.lit(0))
    more = met.groupBy("_row").agg(
        F.sum(F.col("_n") * F.log10((c + 1) / F.lit(divisor))).alias("_more"),
        F.sum(F.when(c > 0, F.col("_n")).otherwise(0)).alias("_more_known"),
    )
    return scored.join(more, "_row", "left").select(
        "_id",
        "n_tokens",
        (F.col("_known") + F.coalesce("_more_known", F.lit(0))).alias("n_known"),
        F.lit(n_tokens).cast("long").alias("train_tokens"),
        (F.col("_base") + F.coalesce("_more", F.lit(0.0))).alias("base_score"),
        "score",
        "bits_per_byte",
    )


def _spread_stored(counts: DataFrame) -> DataFrame:
    strings = counts.filter("kind = 's'").select("item", "n")
    return stored(_spread(strings), "lm-strings")
