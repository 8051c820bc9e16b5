from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from tests.helpers import bag, manifest
from twinsieve.operators import digest, members
from twinsieve.operators.balance import balanced, digest_bins
from twinsieve.operators.members import bitmap_bits, likely_members
from twinsieve.workspace import stage

SIZES = [0] * 40 + [1, 1, 2, 7, 30, 49, 50, 51, 99, 100, 101, 5000, None] + [10] * 60


@pytest.fixture
def rows(spark):
    return manifest(spark, *[{"path": f"p{i}", "size": s} for i, s in enumerate(SIZES)])


def plain_bins(sizes, bin_bytes, cost):
    import hashlib

    half = bin_bytes // 2
    order = sorted(
        (s or 0, hashlib.md5(f"p{i}".encode()).hexdigest()[:4], f"p{i}") for i, s in enumerate(sizes)
    )
    out, start = {}, 0
    for size, _, path in order:
        out[path] = start // half * 2 + (size + cost > half)
        start += size + cost
    return out


@pytest.mark.parametrize("bin_bytes,cost", [(100, 0), (100, 3), (64, 1), (10**6, 5)])
def test_bins_are_stretches_of_the_sizes(rows, bin_bytes, cost):
    got = {r["path"]: r["bin"] for r in digest_bins(rows, bin_bytes, cost).collect()}
    assert got == plain_bins(SIZES, bin_bytes, cost)


@pytest.mark.parametrize("bin_bytes,cost", [(100, 3), (64, 1), (300, 7)])
def test_no_bin_exceeds_its_bytes_unless_it_is_one_object(rows, bin_bytes, cost):
    bins = defaultdict(list)
    for r in digest_bins(rows, bin_bytes, cost).collect():
        bins[r["bin"]].append(r["bytes"] + cost)
    assert all(sum(held) <= bin_bytes or len(held) == 1 for held in bins.values())
    # And there are not many more than the bytes ask for.
    assert len(bins) <= 4 * sum((s or 0) + cost for s in SIZES) / bin_bytes + 1


def test_empty_objects_are_spread_by_their_cost(spark):
    rows = manifest(spark, *[{"path": f"e{i}", "size": 0} for i in range(200)])
    per_bin = digest_bins(rows, 1000, 10).groupBy("bin").count().collect()
    assert max(r["count"] for r in per_bin) <= 100


def test_a_partition_holds_one_bin(rows):
    wanted = rows.select("path", "size")
    dealt = balanced(wanted, 100, 3).withColumn("_at", F.spark_partition_id())
    both = dealt.join(digest_bins(wanted, 100, 3), "path")
    assert both.groupBy("_at").agg(F.count_distinct("bin").alias("n")).filter("n > 1").isEmpty()
    assert both.groupBy("bin").agg(F.count_distinct("_at").alias("n")).filter("n > 1").isEmpty()
    assert bag(dealt, "path", "size") == bag(wanted, "path", "size")


def test_nothing_pending_nothing_to_deal(rows):
    none = rows.filter("false")
    assert digest_bins(none).count() == 0
    assert balanced(none).count() == 0


# ------------------------------------------------------------------- membership


def test_a_long_list_drops_most_other_rows(spark):
    table = spark.range(1_000_000).select(F.concat(F.lit("/p/"), "id").alias("path"))
    wanted = stage(spark.range(0, 1_000_000, 17).select(F.concat(F.lit("/p/"), "id").alias("path")), "wanted")
    assert wanted.count() > digest.BROADCAST_ROWS
    near = likely_members(table, wanted, "path")
    n = near.count()
    assert wanted.count() <= n < 2.2 * wanted.count()
    assert wanted.join(near, "path", "left_anti").isEmpty()


def test_a_full_bitmap_drops_nothing_listed(spark, monkeypatch):
    monkeypatch.setattr(members, "LEAST_BITS", 64)
    monkeypatch.setattr(members, "MOST_BITS", 64)
    rows = spark.createDataFrame([(str(i),) for i in range(500)] + [(None,)], "path string")
    listed = stage(rows.filter("cast(path as int) % 2 = 0"), "listed")
    assert bitmap_bits(10**9) == 64
    got = {r["path"] for r in likely_members(rows, listed, "path").collect()}
    assert {str(i) for i in range(0, 500, 2)} <= got and None not in got


def test_an_empty_list_has_no_members(spark):
    rows = spark.createDataFrame([("a",), ("b",)], "path string")
    assert likely_members(rows, stage(rows.filter("false"), "none"), "path").isEmpty()


def test_a_long_pending_list_digests_its_own_payloads(spark, monkeypatch):
    monkeypatch.setattr(digest, "BROADCAST_ROWS", 10)
    table = spark.range(4000).select(F.col("id").cast("string").alias("path"), F.repeat(F.lit("x"), F.col("id").cast("int") % 90).alias("text"))
    table = stage(table, "payloads")
    wanted = stage(table.filter("cast(path as int) % 50 = 0").select("path"), "pending")
    got = digest.digest_rows(wanted, table, "text")
    want = table.join(wanted, "path").select("path", F.md5("text").alias("md5"))
    assert bag(got, "path", "md5") == bag(want, "path", "md5")
    plan = got._jdf.queryExecution().executedPlan().toString()
    # The bitmap is joined before payloads are digested, and payloads are not exchanged.
    assert plan.index("md5(") < plan.index("BroadcastHashJoin [_piece")
    assert not [line for line in plan.splitlines() if "Exchange hashpartitioning" in line and "_payload" in line]
