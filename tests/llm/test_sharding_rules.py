"""Sharding by bytes, and quality rules beside columns of any name."""

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import functions as F

from twinsieve.llm import queries, sharding
from twinsieve.llm.quality_rules import features, fit, quality_rules, raw_scores, sigmoid
from twinsieve.llm.sharding import BUCKET_BYTES, record_bytes, scatter, shuffled_shards
from twinsieve.llm.text_stats import Stats


def test_equal_large_rows_do_not_overfill_a_bucket(spark):
    rows = spark.range(900).select(F.lit(7).cast("long").alias("doc_id"), F.repeat(F.lit("abc def "), 33750).alias("text"))
    size = F.octet_length("_row.text")
    per_bucket = scatter(rows, "doc_id", "text", 17, BUCKET_BYTES).groupBy("_bucket").agg(F.sum(size).alias("n"))
    assert per_bucket.agg(F.max("n")).first()[0] <= 2 * BUCKET_BYTES
    got = shuffled_shards(rows).select("shard", "slot").collect()
    assert sorted((r.slot, r.shard) for r in got) == sorted((i // 8, i % 8) for i in range(900))


def test_a_record_is_as_large_as_all_its_texts(spark):
    rows = spark.createDataFrame([(1, "abc", "éé", None)], "doc_id long, text string, other string, raw binary")
    assert rows.select(record_bytes(rows)).first()[0] == 1 + 8 + 3 + 4


def test_buckets_are_shuffled_by_fisher_yates(spark, sf_dir):
    """The same order as a plain version: by bucket, hash, and a seeded shuffle of each."""
    docs = queries.documents(spark, sf_dir).dropDuplicates(["doc_id"])
    hashed = scatter(docs, "doc_id", "text", 17, BUCKET_BYTES)
    held = {}
    for r in hashed.select("_bucket", "_h", "_row.doc_id").collect():
        held.setdefault(r["_bucket"], []).append((r["_h"], r["doc_id"]))
    order = []
    for bucket in sorted(held):
        ids = [d for _, d in sorted(held[bucket])]
        place = np.arange(len(ids))
        np.random.default_rng([17, bucket]).shuffle(place)
        order += [ids[i] for i in place]
    got = shuffled_shards(docs).select("doc_id", "shard", "slot").collect()
    assert Counter(map(tuple, got)) == Counter((d, i % 8, i // 8) for i, d in enumerate(order))


def test_columns_named_as_the_operator_names_its_own(spark, docs):
    labels = spark.createDataFrame([(0, 1), (3, 0), (6, 1), (9, 0)], "doc_id long, quality int")
    clashing = docs.withColumns({c: F.lit("own") for c in ("_key", "_label", "_index", "_value", "quality")})
    bag = lambda df: Counter(map(tuple, df.collect()))
    assert bag(quality_rules(clashing, labels)) == bag(quality_rules(docs, labels))


def plain_frequencies(text):
    """Of each kind of gram, the sorted frequencies in a text."""
    words = text.split()
    kinds = [words, list(zip(words, words[1:]))]
    kinds += [[text[i : i + n] for i in range(len(text) - n + 1)] for n in (3, 4)]
    return [sorted(c / len(k) for c in Counter(k).values()) for k in kinds if k]


def test_features_are_words_pairs_and_character_strings():
    for text in ("ab ab cd", "Straße naïve 😀😀 naïve", "é", "", "xyz"):
        ((index, value),) = features(pa.array([text]))
        want = np.array([x for kind in plain_frequencies(text) for x in kind])
        assert len(index) == len(want)
        assert np.allclose(np.sort(value), np.sort(want), atol=1e-6)


def test_scores_are_sums_over_the_features():
    texts = pa.array(["good words are here", "bad bad bad", None, "Straße 😀 und mehr", "x"] * 5)
    sparse = list(features(texts))
    y = np.array([1.0, 0.0, 0.0, 1.0, 0.0] * 5)
    weights, bias, slope, offset = fit(sparse, y)
    plain = [bias + float((weights[i].astype(float) * v).sum()) for i, v in sparse]
    assert np.allclose(raw_scores(Stats(texts), weights, bias), plain, atol=1e-4)
    assert 0 <= sigmoid(np.array(plain) * slope + offset).min()


def test_kept_is_what_a_plain_version_keeps(spark, sf_dir):
    docs, labels = queries.documents(spark, sf_dir), queries.table(spark, sf_dir, "labels")
    rows = {r.doc_id: r.text for r in docs.collect()}
    known = sorted((r.doc_id, r.quality) for r in labels.select("doc_id", "quality").dropDuplicates(["doc_id"]).collect() if r.doc_id in rows)
    weights, bias, slope, offset = fit(
        [x for d, _ in known for x in features(pa.array([rows[d]], pa.string()))], np.array([float(y) for _, y in known])
    )
    for r in quality_rules(docs, labels).collect():
        ((index, value),) = features(pa.array([rows[r["_id"]]], pa.string()))
        p = sigmoid(slope * (bias + float((weights[index].astype(float) * value).sum())) + offset)
        assert abs(p - r.probability) < 1e-4
        if abs(p - 0.5) > 1e-4:
            assert r.kept == (not r.base_failed and p >= 0.5)
