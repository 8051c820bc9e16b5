import pytest

from tests.helpers import bag, manifest, snapshot
from twinsieve.operators import reports
from twinsieve.schema import MANIFEST
from twinsieve.workspace import stage


def scan(spark):
    return manifest(
        spark,
        {"path": "a", "inode": 1, "size": 1500, "md5": "xx"},
        {"path": "b", "inode": 2, "size": 1500, "md5": "xx"},
        {"path": "c", "inode": 3, "size": 1500, "md5": "xx"},
        {"path": "d", "inode": 4, "size": 10, "md5": "yy"},
        {"path": "e", "inode": 5, "size": 20},
    )


def only(df):
    (row,) = df.collect()
    return tuple(row)


def test_totals(spark):
    assert only(reports.scan_totals(scan(spark))) == (5, 4530)
    assert only(reports.dry_run(scan(spark))) == (1, 20)
    text = only(reports.display(reports.scan_totals(scan(spark))))
    assert text == (5, 4530, "5", "4.5 kB")


def test_savings(spark):
    assert only(reports.savings(scan(spark))) == (1, 2, 3000)


def test_empty_input_gives_zeros(spark):
    nothing = spark.createDataFrame([], MANIFEST)
    assert only(reports.scan_totals(nothing)) == (0, 0)
    assert only(reports.savings(nothing)) == (0, 0, 0)
    assert only(reports.digest_size_check(nothing)) == (0,)


def test_one_device(spark):
    reports.require_one_device(scan(spark))
    reports.require_one_device(spark.createDataFrame([], MANIFEST))
    mixed = manifest(spark, {"path": "a", "root": "r1"}, {"path": "b", "root": "r2", "device": 4})
    with pytest.raises(OSError):
        reports.require_one_device(mixed)
    assert {tuple(r) for r in reports.device_report(mixed).collect()} == {
        ("r1", 1, 0, 0),
        ("r2", 1, 4, 4),
    }


def test_digest_shared_by_two_sizes_is_counted(spark):
    odd = manifest(
        spark, {"path": "a", "size": 1, "md5": "xx"}, {"path": "b", "size": 2, "md5": "xx"}
    )
    assert only(reports.digest_size_check(odd)) == (1,)
    assert only(reports.digest_size_check(scan(spark))) == (0,)


def test_run_summary(spark):
    old = snapshot(spark, {"path": "d", "size": 10, "md5": "other"})
    assert only(reports.run_summary(scan(spark), old)) == (5, 4, 1, 1, 1)


def test_only_objects_with_all_links_planned_are_surely_freed(spark):
    rows = manifest(
        spark,
        {"path": "a", "inode": 1, "size": 9, "md5": "xx", "links": 5},
        {"path": "b", "inode": 2, "size": 9, "md5": "xx", "links": 2},
        {"path": "c", "inode": 2, "size": 9, "md5": "xx", "links": 2},
        {"path": "d", "inode": 3, "size": 9, "md5": "xx", "links": 2},
        {"path": "e", "inode": 4, "size": 9, "md5": "xx", "links": None},
    )
    assert only(reports.sure_savings(rows)) == (3, 1, 9)
    assert only(reports.savings(rows)) == (1, 3, 27)
    assert only(reports.sure_savings(spark.createDataFrame([], MANIFEST))) == (0, 0, 0)


def test_a_summary_observed_while_the_run_writes(spark):
    rows = manifest(
        spark,
        {"path": "a", "inode": 1, "md5": "x"},
        {"path": "b", "inode": 2, "md5": "x"},
        {"path": "c", "inode": 3, "md5": "new"},
        {"path": "d", "inode": 4},
    )
    old = snapshot(spark, {"path": "c", "md5": "old"}, {"path": "a", "md5": "x"}, {"path": "d", "md5": "q"})
    to_write, counts = reports.observed(rows, old)
    written = stage(to_write, "observed")
    assert bag(written) == bag(rows)
    assert reports.observed_summary(written, counts).collect() == reports.run_summary(rows, old).collect()
