import pytest
from pyspark.sql import functions as F

from tests.helpers import bag, column, manifest, same_rows
from twinsieve.schema import MANIFEST
from twinsieve.streaming import (
    first_seen,
    planned_links,
    save_stream,
    saved_arrivals,
    start_link_stream,
)
from twinsieve.streaming.link_stream import link_batch

ARRIVALS = [
    [("b", 1, "xx"), ("a", 1, "xx"), ("c", 2, "xx"), ("d", 3, "yy")],
    [("e", 4, "yy"), ("aa", 5, "xx"), ("f", 6, "zz"), ("g", 7, None)],
    [("h", 1, "xx"), ("i", 8, "zz"), ("j", 0, "zz")],
]
# First by arrival, within a batch by path.
LINKS = {"c": "a", "aa": "a", "e": "d", "i": "f", "j": "f"}


def rows_of(spark, arrivals):
    return manifest(spark, *[{"path": p, "inode": i, "md5": m} for p, i, m in arrivals])


@pytest.fixture
def feed(spark, tmp_path):
    """A directory that gets one file per batch, and a stream that takes one at a time."""
    source = tmp_path / "source"

    def add(n):
        rows_of(spark, ARRIVALS[n]).coalesce(1).write.mode("append").parquet(str(source))

    source.mkdir()
    stream = (
        spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).parquet(str(source))
    )
    return add, stream


def test_links_in_order_of_arrival(spark, heat, feed, tmp_path):
    add, stream = feed
    base = str(tmp_path / "links")
    for n in range(3):
        add(n)
        # A restart between batches, as after a crash.
        start_link_stream(stream, base, every=None).awaitTermination()
    assert column(planned_links(spark, base), "canonical_path") == LINKS
    everything = [row for batch in ARRIVALS for row in batch if row[2]]
    assert bag(saved_arrivals(spark, base), "path", "inode", "md5") == {r: 1 for r in everything}


def test_a_batch_run_again_changes_nothing(spark, heat, tmp_path):
    base = str(tmp_path / "links")
    run = link_batch(base)
    for n in range(3):
        run(rows_of(spark, ARRIVALS[n]), n)
    before = bag(planned_links(spark, base))
    for n in (1, 2):
        run(rows_of(spark, ARRIVALS[n]), n)
    assert bag(planned_links(spark, base)) == before
    assert column(planned_links(spark, base), "canonical_path") == LINKS


def test_first_seen_is_exact(spark, feed, tmp_path):
    add, stream = feed
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n in range(3):
        add(n)
        save_stream(first_seen(stream), out, checkpoint, every=None).awaitTermination()
    assert bag(spark.read.parquet(out), "md5") == {("xx",): 1, ("yy",): 1, ("zz",): 1}


def test_first_seen_within_a_time(spark, feed, tmp_path):
    add, stream = feed
    # Some time after the epoch, where watermarks start.
    timed = stream.withColumn("seen", F.timestamp_micros(F.col("mtime_us") + 10**15))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n in range(3):
        add(n)
        got = first_seen(timed, event_time="seen", within="1 hour")
        save_stream(got, out, checkpoint, every=None).awaitTermination()
    assert bag(spark.read.parquet(out), "md5") == {("xx",): 1, ("yy",): 1, ("zz",): 1}


def test_saved_stream_resumes(spark, feed, tmp_path):
    add, stream = feed
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    for n in (0, 1):
        add(n)
        save_stream(stream, out, checkpoint, every=None).awaitTermination()
    want = rows_of(spark, ARRIVALS[0]).unionByName(rows_of(spark, ARRIVALS[1]))
    assert same_rows(spark.read.schema(MANIFEST).parquet(out), want)


def test_files_are_digested_as_their_paths_arrive(spark, tmp_path):
    import hashlib

    from twinsieve.operators.digest import digest_files

    paths = tmp_path / "paths"
    paths.mkdir()
    stream = spark.readStream.schema("path string, size long").parquet(str(paths))
    out, checkpoint = str(tmp_path / "out"), str(tmp_path / "checkpoint")
    want = {}
    for text in ("one", "two"):
        file = tmp_path / text
        file.write_text(text)
        want[str(file)] = hashlib.md5(text.encode()).hexdigest()
        arrived = spark.createDataFrame([(str(file), len(text))], stream.schema)
        arrived.write.mode("append").parquet(str(paths))
        digests = digest_files(stream, tasks=2)
        save_stream(digests, out, checkpoint, every=None).awaitTermination()
    assert column(spark.read.parquet(out), "md5") == want
