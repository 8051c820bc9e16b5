import pytest

from tests.helpers import bag, column
from tests.test_streaming import ARRIVALS, LINKS, rows_of
from twinsieve.schema import MANIFEST
from twinsieve.streaming import planned_links, saved_arrivals, start_keyed_link_stream
from twinsieve.streaming import keyed_links
from twinsieve.streaming.keyed_links import FIRST, elected_stream, first_of_contents, groups_of, keyed_batch


@pytest.fixture
def feed(spark, tmp_path):
    source = tmp_path / "source"
    source.mkdir()

    def add(n):
        rows_of(spark, ARRIVALS[n]).coalesce(1).write.mode("append").parquet(str(source))

    return add, spark.readStream.schema(MANIFEST).option("maxFilesPerTrigger", 1).parquet(str(source))


def test_links_in_order_of_arrival(spark, heat, feed, tmp_path):
    add, stream = feed
    base = str(tmp_path / "links")
    for n in range(3):
        add(n)
        start_keyed_link_stream(stream, base, every=None).awaitTermination()
    assert column(planned_links(spark, base), "canonical_path") == LINKS
    assert saved_arrivals(spark, base).count() == sum(m is not None for rows in ARRIVALS for *_, m in rows)


def test_a_batch_that_runs_twice_changes_nothing(spark, tmp_path):
    base = str(tmp_path / "links")
    for n, rows in enumerate(ARRIVALS):
        keyed_batch(base)(rows_of(spark, rows), n)
        keyed_batch(base)(rows_of(spark, rows), n)
    assert column(planned_links(spark, base), "canonical_path") == LINKS


@pytest.mark.parametrize("at", ["state", "links"])
def test_a_batch_that_was_lost_on_the_way_goes_on(spark, tmp_path, monkeypatch, at):
    base = str(tmp_path / "links")
    keyed_batch(base)(rows_of(spark, ARRIVALS[0]), 0)

    def lost(*_):
        raise ConnectionError("driver lost")

    with monkeypatch.context() as patch:
        patch.setattr(keyed_links, "_elect_new" if at == "state" else "groups_of", lost)
        with pytest.raises(ConnectionError):
            keyed_batch(base)(rows_of(spark, ARRIVALS[1]), 1)
    for n in (1, 2):
        keyed_batch(base)(rows_of(spark, ARRIVALS[n]), n)
    assert column(planned_links(spark, base), "canonical_path") == LINKS
    assert bag(groups_of(spark, base, 1), "md5", "canonical_path") == {
        ("xx", "a"): 1, ("yy", "d"): 1, ("zz", "f"): 1
    }


def test_the_step_reads_new_contents_only(spark, tmp_path):
    base = str(tmp_path / "links")
    keyed_batch(base)(rows_of(spark, ARRIVALS[0]), 0)
    stream = spark.readStream.schema(FIRST).option("recursiveFileLookup", "true").parquet(f"{base}/firsts")
    plan = elected_stream(stream)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") == 1 and "Join" not in plan and "FlatMapGroupsInPandasWithState" in plan
    # Of the answers, only those of the batch are read.
    scan = groups_of(spark, base, 0)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(batch" in scan


def test_an_empty_batch(spark, tmp_path):
    base = str(tmp_path / "links")
    keyed_batch(base)(rows_of(spark, ARRIVALS[0]).filter("false"), 0)
    keyed_batch(base)(rows_of(spark, ARRIVALS[0]), 1)
    assert column(planned_links(spark, base), "canonical_path") == {"c": "a"}


def test_no_content_is_sent_to_python(spark, tmp_path, monkeypatch):
    base = str(tmp_path / "links")
    monkeypatch.setattr(keyed_links, "elected_stream", None)
    for n, rows in enumerate(ARRIVALS):
        keyed_batch(base)(rows_of(spark, rows), n)
    assert column(planned_links(spark, base), "canonical_path") == LINKS
    stream = spark.readStream.schema(FIRST).option("recursiveFileLookup", "true").parquet(f"{base}/firsts")
    plan = first_of_contents(stream)._jdf.queryExecution().analyzed().toString()
    assert plan.count("Relation") == 1 and not any(w in plan for w in ("Join", "Pandas", "Python"))
    # A batch is told of its own contents only, with their numbers there.
    assert bag(groups_of(spark, base, 2), "md5", "n", "canonical_path", "canonical_inode") == {
        ("xx", 1, "a", 1): 1, ("zz", 2, "f", 6): 1
    }


def test_a_folder_with_the_state_of_elected_stream_goes_on_with_it(spark, tmp_path, monkeypatch):
    base = tmp_path / "links"
    (base / "state").mkdir(parents=True)
    monkeypatch.setattr(keyed_links, "first_of_contents", None)
    for n, rows in enumerate(ARRIVALS):
        keyed_batch(str(base))(rows_of(spark, rows), n)
    assert column(planned_links(spark, str(base)), "canonical_path") == LINKS
    assert not (base / "contents").exists()
