import pytest

from tests.helpers import bag, column, manifest, same_rows, snapshot
from twinsieve.operators.reuse import FINGERPRINT, reuse_digests
from twinsieve.sources import (
    as_of,
    latest_digests,
    read_history,
    reuse_from_history,
    snapshot_history,
)


def one(path, md5, size=1, mtime=0):
    return {"path": path, "md5": md5, "size": size, "mtime_us": mtime}


RUNS = {
    "2026-01-01": [one("a", "x"), one("b", "y"), one("c", "z"), one("twice", "t"), one("twice", "u")],
    "2026-01-02": [one("a", "x"), one("b", "y2", 2), one("twice", "t")],
    "2026-01-03": [one("a", "x"), one("b", "y"), one("c", "z"), one("none", None)],
    "2026-01-10": [one("a", "new"), one("b", "y"), one("roots", "r"), one("roots", "r")],
}


@pytest.fixture(scope="module")
def base(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("history"))
    for run, rows in RUNS.items():
        snapshot(spark, *rows).write.parquet(f"{folder}/snapshot={run}")
    return folder


def test_intervals_break_where_a_state_is_missing(spark, base):
    got = snapshot_history(read_history(spark, base))
    assert bag(got, "path", "size", "md5", "valid_from", "valid_to", "n_snapshots") == {
        ("a", 1, "x", "2026-01-01", "2026-01-03", 3): 1,
        ("a", 1, "new", "2026-01-10", "2026-01-10", 1): 1,
        ("b", 1, "y", "2026-01-01", "2026-01-01", 1): 1,
        ("b", 2, "y2", "2026-01-02", "2026-01-02", 1): 1,
        ("b", 1, "y", "2026-01-03", "2026-01-10", 2): 1,
        ("c", 1, "z", "2026-01-01", "2026-01-01", 1): 1,
        ("c", 1, "z", "2026-01-03", "2026-01-03", 1): 1,
        ("twice", 1, None, "2026-01-01", "2026-01-01", 1): 1,
        ("twice", 1, "t", "2026-01-02", "2026-01-02", 1): 1,
        ("roots", 1, "r", "2026-01-10", "2026-01-10", 1): 1,
    }


@pytest.mark.parametrize("run", RUNS)
def test_intervals_hold_every_snapshot(spark, base, run):
    history = read_history(spark, base)
    got = as_of(snapshot_history(history), run)
    want = {(r["path"], r["size"], r["mtime_us"]) for r in RUNS[run] if r["md5"]}
    assert {tuple(r)[:3] for r in got.collect()} == want
    plain = latest_digests(read_history(spark, base, since=run, until=run))
    assert same_rows(got.select(*FINGERPRINT, "md5"), plain.select(*FINGERPRINT, plain.old_md5.alias("md5")))


def test_the_latest_digest_counts_and_contradictions_do_not(spark, base):
    until = read_history(spark, base, until="2026-01-01")
    assert column(latest_digests(until), "old_md5")["twice"] is None
    scan = manifest(spark, *[one(p, None) for p in ("a", "b", "c", "twice", "none", "unknown")])
    got = column(reuse_from_history(scan, read_history(spark, base)), "md5")
    assert got == {"a": "new", "b": "y", "c": "z", "twice": "t", "none": None, "unknown": None}
    # A single snapshot is used as `reuse_digests` uses it.
    last = read_history(spark, base, since="2026-01-10")
    assert same_rows(reuse_from_history(scan, last), reuse_digests(scan, last))


def test_only_the_directories_in_question_are_read(spark, base):
    part = read_history(spark, base, since="2026-01-02", until="2026-01-03")
    plan = latest_digests(part)._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [isnotnull(snapshot" in plan
    assert len({f.split("snapshot=")[1][:10] for f in _read_files(part)}) == 2
    assert plan.count("Exchange") == 1  # one for both aggregates


def _read_files(df):
    return [r[0] for r in df.selectExpr("_metadata.file_path").distinct().collect()]


def test_no_runs(spark, base):
    none = read_history(spark, base, since="2027")
    assert snapshot_history(none).isEmpty() and latest_digests(none).isEmpty()
