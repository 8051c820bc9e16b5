import pytest

from tests.helpers import bag, column, manifest, same_rows, snapshot
from twinsieve.operators import reuse
from twinsieve.schema import SNAPSHOT
from twinsieve.sources import store_bucketed


@pytest.fixture
def scan(spark):
    return manifest(
        spark,
        {"path": "linked1", "inode": 1, "size": 10, "mtime_us": 2, "links": 2},
        {"path": "linked2", "inode": 1, "size": 10, "mtime_us": 2, "links": 2},
        {"path": "same", "inode": 2, "size": 11, "mtime_us": 4},
        {"path": "resized", "inode": 3, "size": 12, "mtime_us": 5},
        {"path": "touched", "inode": 4, "size": 13, "mtime_us": 6},
        {"path": "undigested", "inode": 5, "size": 14, "mtime_us": 7},
        {"path": "fresh", "inode": 6, "size": 15, "mtime_us": 8},
    )


@pytest.fixture
def old(spark):
    return snapshot(
        spark,
        {"path": "linked2", "inode": 1, "size": 10, "mtime_us": 2, "md5": "aa"},
        {"path": "same", "inode": 2, "size": 11, "mtime_us": 4, "md5": "bb"},
        {"path": "resized", "inode": 3, "size": 99, "mtime_us": 5, "md5": "cc"},
        {"path": "touched", "inode": 4, "size": 13, "mtime_us": 1, "md5": "dd"},
        {"path": "undigested", "inode": 5, "size": 14, "mtime_us": 7},
        {"path": "deleted", "inode": 9, "size": 1, "mtime_us": 1, "md5": "ee"},
    )


@pytest.mark.parametrize("way", [reuse.reuse_digests, reuse.reuse_by_path])
def test_only_unchanged_rows_take_the_old_digest(scan, old, way):
    got = way(scan, old)
    known = {path: md5 for path, md5 in column(got, "md5").items() if md5}
    assert known == {"linked2": "aa", "same": "bb"}
    assert got.columns == scan.columns
    assert same_rows(got.drop("md5"), scan.drop("md5"))


@pytest.mark.parametrize("way", [reuse.reuse_digests, reuse.reuse_by_path])
def test_empty_snapshot_changes_nothing(spark, scan, way):
    assert same_rows(way(scan, spark.createDataFrame([], SNAPSHOT)), scan)


def test_repeated_snapshot_rows_do_not_multiply(scan, old):
    assert same_rows(
        reuse.reuse_digests(scan, old.unionByName(old)), reuse.reuse_digests(scan, old)
    )


@pytest.mark.parametrize("way", [reuse.reuse_digests, reuse.reuse_by_path])
def test_contradicting_snapshot_rows_are_not_trusted(spark, scan, old, way):
    other = snapshot(spark, {"path": "same", "size": 11, "mtime_us": 4, "md5": "zz"})
    got = column(way(scan, old.unionByName(other)), "md5")
    assert got["same"] is None and got["linked2"] == "aa"
    changes = column(reuse.snapshot_changes(scan, old.unionByName(other)), "change")
    assert changes["same"] == "unhashed" and changes["linked2"] == "reused"


@pytest.mark.parametrize("way", [reuse.reuse_digests, reuse.reuse_by_path])
def test_an_older_row_that_matches_counts(spark, scan, old, way):
    newer = snapshot(spark, {"path": "same", "size": 70, "mtime_us": 40, "md5": "zz"})
    assert column(way(scan, old.unionByName(newer)), "md5")["same"] == "bb"
    assert column(reuse.snapshot_changes(scan, old.unionByName(newer)), "change")["same"] == "reused"


def test_changes(scan, old):
    assert column(reuse.snapshot_changes(scan, old), "change") == {
        "linked1": "new",
        "linked2": "reused",
        "same": "reused",
        "resized": "changed",
        "touched": "changed",
        "undigested": "unhashed",
        "fresh": "new",
        "deleted": "deleted",
    }


@pytest.fixture
def recomputed(scan, old):
    """The scan with digests of its own; that of `same` contradicts the old one."""
    from pyspark.sql import functions as F

    own = F.when(F.col("path") == "same", "new").when(F.col("path") == "linked2", "aa")
    return scan.withColumn("md5", own)


def test_mismatches(recomputed, old):
    got = reuse.digest_mismatches(recomputed, old)
    assert bag(got, "path", "md5", "old_md5") == {("same", "new", "bb"): 1}


def test_mismatches_are_cleared(recomputed, old):
    got = column(reuse.clear_mismatches(recomputed, old), "md5")
    assert got["same"] is None and got["linked2"] == "aa" and got["fresh"] is None


def test_examples_show_the_first_and_count_all(spark):
    paths = [f"p{n:02}" for n in range(12)]
    scan = manifest(spark, *[{"path": p, "md5": "new"} for p in paths])
    old = snapshot(spark, *[{"path": p, "md5": "old"} for p in paths])
    got = reuse.mismatch_examples(reuse.digest_mismatches(scan, old))
    assert column(got, "n_mismatches") == {p: 12 for p in paths[:5]}


def test_bucketed_tables_are_compared_without_a_shuffle(spark, scan, old):
    from twinsieve.sources import store_bucketed

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        now = store_bucketed(scan, "bucketed_scan", 4)
        before = store_bucketed(old, "bucketed_old", 4)
        for way in (reuse.reuse_by_path, reuse.snapshot_changes):
            got = way(now, before)
            assert same_rows(got, way(scan, old))
            assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
        spark.sql("DROP TABLE IF EXISTS bucketed_scan")
        spark.sql("DROP TABLE IF EXISTS bucketed_old")


def test_bucketed_tables_are_compared_without_exchange(spark):
    rows = manifest(
        spark,
        {"path": "same", "size": 3, "mtime_us": 1},
        {"path": "resized", "size": 4, "mtime_us": 1},
        {"path": "touched", "size": 3, "mtime_us": 2},
        {"path": "has one", "size": 3, "mtime_us": 1, "md5": "own"},
        {"path": "contradicted", "size": 3, "mtime_us": 1},
        {"path": "twice", "size": 3, "mtime_us": 1},
        {"path": "new", "size": 3, "mtime_us": 1},
    )
    names = ["same", "resized", "touched", "has one", "twice", "twice", "gone"]
    old = [{"path": p, "size": 3, "mtime_us": 1, "md5": "old"} for p in names]
    old += [{"path": "contradicted", "size": 3, "mtime_us": 1, "md5": m} for m in ("x", "y")]
    old += [{"path": "same", "size": 9, "mtime_us": 1, "md5": "other size"}, {"path": "new", "size": 3, "mtime_us": 1}]
    old = snapshot(spark, *old)
    for df, name in ((rows, "now_by_path"), (old, "old_by_path")):
        spark.sql(f"DROP TABLE IF EXISTS {name}")
        store_bucketed(df, name, 4)
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        got = reuse.reuse_bucketed(spark.table("now_by_path"), spark.table("old_by_path"))
        assert "Exchange" not in got._jdf.queryExecution().executedPlan().toString()
        assert bag(got) == bag(reuse.reuse_digests(rows, old))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
