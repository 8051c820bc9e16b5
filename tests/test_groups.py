import random
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import bag
from twinsieve.operators.groups import join_groups, salted_join, with_group_values


@pytest.fixture
def skewed():
    """A third of the rows on one key, a third on a few, a third on their own."""
    rnd = random.Random(5)
    keys = ["hot"] * 200 + [f"few{rnd.randrange(7)}" for _ in range(200)]
    keys += [f"one{n}" for n in range(200)]
    rnd.shuffle(keys)
    return [(f"p{n:04}", key, rnd.randrange(1000)) for n, key in enumerate(keys)]


def test_group_values_equal_brute_force(spark, heat, skewed):
    rows = spark.createDataFrame(skewed, "path string, key string, x long").repartition(5)
    groups = defaultdict(list)
    for path, key, x in skewed:
        groups[key].append((x, path))
    values = {"n": F.count("*"), "least": F.min(F.struct("x", "path")), "hi": F.max("x")}
    got = with_group_values(rows, ["key"], values).select("path", "key", "n", "least.*", "hi")
    want = Counter(
        (path, key, len(groups[key]), *min(groups[key]), max(groups[key])[0])
        for path, key, x in skewed
    )
    assert Counter(map(tuple, got.collect())) == want


def test_group_values_with_several_keys(spark, heat, skewed):
    rows = spark.createDataFrame(skewed, "path string, key string, x long")
    rows = rows.withColumn("part", F.col("x") % 2)
    want = Counter((key, x % 2) for _, key, x in skewed)
    got = with_group_values(rows, ["part", "key"], {"n": F.count("*")})
    assert {(r.key, r.part): r.n for r in got.collect()} == dict(want)
    assert got.count() == len(skewed)


def test_group_values_of_nothing(spark, heat):
    rows = spark.createDataFrame([], "path string, key string")
    assert with_group_values(rows, ["key"], {"n": F.count("*")}).collect() == []


@pytest.mark.parametrize("how", ["left", "inner"])
def test_join_groups_equals_plain_join(spark, heat, skewed, how):
    rows = spark.createDataFrame(
        skewed + [("null1", None, 1), ("null2", None, 2)], "path string, key string, x long"
    )
    groups = rows.filter("key is not null").groupBy("key").agg(
        F.count("*").alias("n"), F.max("x").alias("hi")
    )
    groups = groups.filter("hi % 2 = 0")
    got = join_groups(rows, groups, ["key"], how=how)
    assert bag(got) == bag(rows.join(groups, "key", how))


def test_join_groups_on_numbers(spark, heat):
    rows = spark.createDataFrame(
        [(f"p{n}", n % 3 if n < 40 else n) for n in range(60)] + [("none", None)],
        "path string, size long",
    )
    groups = rows.filter("size is not null").groupBy("size").agg(F.count("*").alias("n"))
    got = join_groups(rows, groups, ["size"])
    assert bag(got) == bag(rows.join(groups, "size", "left"))


def test_join_groups_rejects_other_kinds(spark):
    rows = spark.createDataFrame([("p", "k")], "path string, key string")
    groups = spark.createDataFrame([("k", 1)], "key string, n long")
    with pytest.raises(ValueError):
        join_groups(rows, groups, ["key"], how="full")


def test_salted_join_equals_plain_join(spark, heat, skewed):
    rows = spark.createDataFrame(skewed, "path string, key string, x long")
    wide = rows.select("key").distinct().filter("key <> 'few1'")
    wide = wide.withColumn("payload", F.repeat("key", 20))
    assert bag(salted_join(rows, wide, "key")) == bag(rows.join(wide, "key"))


def test_hot_rows_are_spread_and_exchange_is_shared(spark, skewed):
    spark.conf.set("spark.twinsieve.hotRows", "50")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        rows = spark.createDataFrame(skewed, "path string, key string, x long")
        groups = rows.groupBy("key").agg(F.count("*").alias("n"))
        joined = join_groups(rows, groups, ["key"])
        per_task = joined.groupBy(F.spark_partition_id().alias("task")).count().collect()
        # 600 rows, 200 of them on one key, over 4 tasks.
        assert max(row["count"] for row in per_task) < 220
        joined.collect()
        plan = joined._jdf.queryExecution().executedPlan().toString()
        assert "ReusedExchange" in plan
    finally:
        spark.conf.unset("spark.twinsieve.hotRows")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("reuse", ["true", "false"])
def test_many_hot_keys_are_all_split(spark, reuse):
    """5,000 keys, each above the bound, and one with a third of all rows."""
    settings = {
        "spark.twinsieve.hotRows": "2",
        "spark.sql.exchange.reuse": reuse,
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
    }
    for name, value in settings.items():
        spark.conf.set(name, value)
    try:
        rows = spark.range(30_000).select(
            F.concat(F.lit("p"), "id").alias("path"),
            F.when(F.col("id") < 10_000, -1).otherwise(F.col("id") % 5_000).cast("string").alias("key"),
        )
        got = with_group_values(rows, ["key"], {"n": F.count("*")})
        sizes = {r.key: (r.n, r.rows) for r in got.groupBy("key", "n").agg(F.count("*").alias("rows")).collect()}
        assert len(sizes) == 5_001 and all(n == rows for n, rows in sizes.values())
        tasks = got.groupBy(F.spark_partition_id().alias("task")).count().collect()
        # 30,000 rows over 4 tasks.
        assert max(row["count"] for row in tasks) < 8_000
    finally:
        for name in settings:
            spark.conf.unset(name)


def test_salted_join_splits_by_bytes(spark, monkeypatch):
    from twinsieve.operators import groups

    monkeypatch.setattr(groups, "PIECE_BYTES", 1_000)
    rows = spark.createDataFrame([(f"p{n}", "k" if n < 90 else f"k{n}") for n in range(99)], "path string, key string")
    wide = rows.select("key").distinct().withColumn("payload", F.repeat("key", 100))
    sizes = wide.select("key", F.octet_length("payload").alias("size"))
    assert bag(salted_join(rows, wide, "key", sizes=sizes)) == bag(rows.join(wide, "key"))
    # 90 rows of 100 bytes in pieces of 1,000 bytes.
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = salted_join(rows, wide, "key", sizes=sizes).filter("key = 'k'")
        assert got.select(F.spark_partition_id()).distinct().count() > 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.conf.unset("spark.sql.adaptive.enabled")
