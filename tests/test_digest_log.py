from functools import partial

import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from tests.helpers import bag, manifest, snapshot
from twinsieve.operators.digest import digest_rows
from twinsieve.plans import hash_job
from twinsieve.streaming import digest_resumed, list_pending, logged_digests
from twinsieve.workspace import stage

N = 60


class Digester:
    """Digests from a table; counts what it is asked for, and is lost before one slice."""

    def __init__(self, payloads, lost_at=None):
        self.payloads, self.lost_at, self.asked, self.slices = payloads, lost_at, [], 0

    def __call__(self, rows):
        if self.slices == self.lost_at:
            raise ConnectionError("driver lost")
        self.slices += 1
        self.asked += [r.path for r in rows.collect()]
        return digest_rows(rows, self.payloads, "text")


@pytest.fixture
def payloads(spark):
    rows = spark.range(N).select(F.format_string("p%02d", "id").alias("path"), F.repeat(F.lit("y"), F.col("id").cast("int")).alias("text"))
    return stage(rows, "payloads")


@pytest.fixture
def scan(spark, payloads):
    rows = [{"path": f"p{i:02}", "inode": i + 1, "size": i, "mtime_us": 5} for i in range(N)]
    return manifest(spark, *rows)


def job(scan, folder, digester, **options):
    way = partial(digest_resumed, folder=folder, digest=digester, slice_bytes=1 << 20, **options)
    return hash_job(scan, None, way)


def test_a_lost_run_goes_on_and_digests_no_path_twice(spark, scan, payloads, tmp_path):
    folder = str(tmp_path / "log")
    first, second = Digester(payloads, lost_at=2), Digester(payloads)
    with pytest.raises(StreamingQueryException):
        job(scan, folder, first)
    assert 0 < len(first.asked) < N
    assert logged_digests(spark, folder).count() == len(first.asked)
    got = job(scan, folder, second)
    asked = first.asked + second.asked
    assert len(asked) == len(set(asked)) == N
    assert bag(got, "path", "md5") == bag(payloads.select("path", F.md5("text").alias("md5")), "path", "md5")


def test_a_finished_run_is_not_digested_again(scan, payloads, tmp_path):
    folder, again = str(tmp_path / "log"), Digester(payloads)
    want = bag(job(scan, folder, Digester(payloads)), "path", "md5")
    assert bag(job(scan, folder, again), "path", "md5") == want
    assert again.asked == []


def test_changed_and_new_rows_make_new_slices(spark, scan, payloads, tmp_path):
    folder, again = str(tmp_path / "log"), Digester(payloads)
    job(scan.filter("path <> 'p07'"), folder, Digester(payloads))
    touched = scan.withColumn("mtime_us", F.when(F.col("path") == "p11", 6).otherwise(F.col("mtime_us")))
    got = job(touched, folder, again)
    assert sorted(again.asked) == ["p07", "p11"]
    assert got.filter("md5 is null").isEmpty() and got.count() == N


def test_a_row_that_cannot_be_digested_is_done(spark, scan, payloads, tmp_path):
    folder = str(tmp_path / "log")
    some = payloads.withColumn("text", F.when(F.col("path") != "p03", F.col("text")))
    got = job(scan, folder, Digester(some))
    assert [r.path for r in got.filter("md5 is null").collect()] == ["p03"]
    again = Digester(some)
    job(scan, folder, again)
    assert again.asked == []


def test_nothing_pending(spark, scan, payloads, tmp_path):
    none = scan.filter("false").select("path", "size", "mtime_us")
    assert digest_resumed(none, str(tmp_path / "log"), Digester(payloads)).isEmpty()


def test_a_slice_is_a_file_and_slices_are_taken_together(spark, scan, payloads, tmp_path):
    folder, one, four = str(tmp_path / "log"), Digester(payloads), Digester(payloads)
    assert list_pending(scan, folder, 1 << 20) == N
    files = len(list((tmp_path / "log" / "pending").glob("part-*")))
    assert files > 4
    job(scan, folder, one)
    assert one.slices == files
    job(scan, str(tmp_path / "other"), four, slices=4)
    assert four.slices == -(-files // 4)


@pytest.mark.parametrize("most, slices", [(1, 1), (2, 1), (2, 2), (5, 1)])
def test_commits_are_bounded_whatever_the_list(spark, scan, payloads, tmp_path, most, slices):
    one = Digester(payloads)
    big = scan.withColumn("size", F.when(F.col("path") == "p59", 1 << 30).otherwise(F.col("size")))
    got = job(big, str(tmp_path / "log"), one, slices=slices, most_commits=most)
    assert 1 <= one.slices <= most
    assert sorted(one.asked) == [f"p{i:02}" for i in range(N)]
    assert bag(got, "path", "md5") == bag(payloads.select("path", F.md5("text").alias("md5")), "path", "md5")
    even, log = Digester(payloads), tmp_path / "even"
    job(scan, str(log), even, slices=slices, most_commits=most)
    assert len(list((log / "pending").glob("part-*"))) <= most * slices and even.slices == most


def test_old_digests_are_not_listed(spark, scan, payloads, tmp_path):
    old = snapshot(spark, {"path": "p05", "size": 5, "mtime_us": 5, "md5": "known"})
    asked = Digester(payloads)
    way = partial(digest_resumed, folder=str(tmp_path / "log"), digest=asked)
    got = hash_job(scan, old, way)
    assert "p05" not in asked.asked and len(asked.asked) == N - 1
    assert got.filter("path = 'p05'").first().md5 == "known"
