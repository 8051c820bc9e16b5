import hashlib

from pyspark.sql import functions as F

from tests.helpers import bag, column, same_rows
from twinsieve.operators import store
from twinsieve.sources import store_bucketed
from twinsieve.workspace import stage


def test_each_content_is_kept_once_and_all_rows_come_back(spark, heat):
    texts = ["same"] * 30 + ["twice", "twice", "once", "", "", None]
    rows = spark.createDataFrame(
        [(f"p{n:02}", text) for n, text in enumerate(texts)], "path string, text string"
    )
    refs = stage(store.store_refs(rows, "text"), "refs")
    redundant = stage(store.redundant_paths(refs), "redundant")
    blobs = stage(store.store_blobs(rows, "text", redundant), "blobs")
    assert redundant.count() == 29 + 1 + 1
    assert column(blobs, "payload", key="md5") == {
        hashlib.md5(t.encode()).hexdigest(): t for t in ["same", "twice", "once", ""]
    }
    restored = store.store_restore(refs, blobs)
    assert same_rows(restored, rows.withColumnRenamed("text", "payload"))


def test_binary_payloads(spark):
    rows = spark.createDataFrame(
        [("a", bytearray(b"\xff")), ("b", bytearray(b"\xff")), ("c", bytearray(b"\x00"))],
        "path string, data binary",
    )
    refs = store.store_refs(rows, "data")
    blobs = store.store_blobs(rows, "data", store.redundant_paths(refs))
    assert bag(blobs, "size") == {(1,): 2}
    assert column(store.store_restore(refs, blobs), "payload")["b"] == b"\xff"


def refs_of(spark, **refs):
    return spark.createDataFrame(list(refs.items()), "path string, md5 string")


def test_references_are_raised_lowered_and_named_when_unused(spark, heat):
    old = refs_of(spark, a="x", b="x", c="y", d="z", e=None, f="w")
    new = refs_of(spark, a="x", b="y", c="y", e="v", f=None, g="v")
    counts = old.filter("md5 is not null").groupBy("md5").count().withColumnRenamed("count", "n_refs")
    changes = store.ref_changes(old, new)
    assert column(changes, "by", key="md5") == {"x": -1, "y": 1, "z": -1, "w": -1, "v": 2}
    after = store.apply_ref_changes(counts, changes)
    assert column(after, "n_refs", key="md5") == {"x": 1, "y": 2, "z": 0, "w": 0, "v": 2}
    assert bag(store.garbage(after)) == {("z",): 1, ("w",): 1}
    assert column(store.new_blob_paths(new, counts, changes), "path", key="md5") == {"v": "e"}


def test_a_blob_that_comes_back_before_it_is_removed_is_not_copied(spark):
    counts = spark.createDataFrame([("x", 0), ("y", 2)], "md5 string, n_refs long")
    changes = store.ref_changes(refs_of(spark, b="y"), refs_of(spark, a="x", b="y"))
    assert store.new_blob_paths(refs_of(spark, a="x", b="y"), counts, changes).isEmpty()
    assert column(store.apply_ref_changes(counts, changes), "n_refs", key="md5") == {"x": 1, "y": 2}


def test_new_payloads_are_not_exchanged_on_bucketed_rows(spark):
    rows = spark.range(200).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("z"), F.col("id").cast("int")).alias("text"))
    spark.sql("DROP TABLE IF EXISTS payloads_by_path")
    rows = store_bucketed(rows, "payloads_by_path", 4)
    named = rows.filter("cast(path as int) % 3 = 0").select(F.md5("text").alias("md5"), "path")
    spark.sql("DROP TABLE IF EXISTS named_by_path")
    named = store_bucketed(named, "named_by_path", 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = store.new_blobs(rows, "text", named)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "Exchange hashpartitioning" not in plan
        assert got.count() == named.count()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
