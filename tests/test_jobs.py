import hashlib
import os
from functools import partial

import pytest
from pyspark.sql import functions as F

from tests.helpers import column, manifest, same_rows, snapshot
from twinsieve import sources
from twinsieve.operators import digest, linking, reports
from twinsieve.plans import dedupe_job, hash_dry_run, hash_job
from twinsieve.workspace import stage

CONTENT = {"a": "one", "b": "one", "c": "two", "d": "three", "e": "one"}


def md5(text):
    return hashlib.md5(text.encode()).hexdigest()


def scan(spark):
    return manifest(
        spark,
        {"path": "a", "inode": 1, "links": 2, "size": 3},
        {"path": "b", "inode": 1, "links": 2, "size": 3},
        {"path": "c", "inode": 2, "size": 3},
        {"path": "d", "inode": 3, "size": 5},
        {"path": "e", "inode": 4, "size": 3},
    )


@pytest.fixture
def payloads(spark):
    return spark.createDataFrame(list(CONTENT.items()), "path string, text string")


@pytest.fixture(params=["short list", "long list"])
def by_table(payloads, request, monkeypatch):
    """Digests from a table, with the pending paths broadcast and not."""
    if request.param == "long list":
        monkeypatch.setattr(digest, "BROADCAST_ROWS", 0)
    return partial(digest.digest_rows, table=payloads, payload="text")


def test_without_snapshot_everything_is_digested(spark, by_table):
    got = hash_job(scan(spark), None, by_table)
    assert column(got, "md5") == {path: md5(text) for path, text in CONTENT.items()}
    assert same_rows(got.drop("md5"), scan(spark).drop("md5"))


def test_old_digests_are_used_shared_and_not_recomputed(spark, by_table):
    asked = []

    def watch(pending):
        asked.extend(r.path for r in pending.collect())
        return by_table(pending)

    old = snapshot(
        spark,
        {"path": "b", "size": 3, "md5": "kept"},
        {"path": "c", "size": 4, "md5": "changed"},
        {"path": "x", "size": 3, "md5": "deleted"},
    )
    got = column(hash_job(scan(spark), old, watch), "md5")
    assert sorted(asked) == ["c", "d", "e"]
    assert got == {"a": "kept", "b": "kept", "c": md5("two"), "d": md5("three"), "e": md5("one")}


def test_one_digest_per_object(spark, by_table):
    asked = []

    def watch(pending):
        asked.extend(r.path for r in pending.collect())
        return by_table(pending)

    hash_job(scan(spark), None, watch)
    assert sorted(asked) == ["a", "c", "d", "e"]


def test_unique_sizes_can_be_skipped_but_keep_old_digests(spark, by_table):
    got = column(hash_job(scan(spark), None, by_table, skip_unique_sizes=True), "md5")
    assert got["d"] is None and got["c"] == md5("two")
    old = snapshot(spark, {"path": "d", "size": 5, "md5": "kept"})
    got = column(hash_job(scan(spark), old, by_table, skip_unique_sizes=True), "md5")
    assert got["d"] == "kept"


def test_contradicting_old_digests_are_computed_anew(spark, by_table):
    old = snapshot(
        spark, {"path": "a", "size": 3, "md5": "xx"}, {"path": "b", "size": 3, "md5": "yy"}
    )
    got = column(hash_job(scan(spark), old, by_table), "md5")
    assert got["a"] == got["b"] == md5("one")


def test_rows_that_cannot_be_digested_stay_null(spark, payloads):
    some = payloads.filter("path <> 'd'")
    got = hash_job(scan(spark), None, partial(digest.digest_rows, table=some, payload="text"))
    assert column(got, "md5")["d"] is None


def test_apply_digests_prefers_new_ones(spark):
    rows = manifest(spark, {"path": "a", "md5": "old"}, {"path": "b", "md5": "old"}, {"path": "c"})
    new = spark.createDataFrame([("a", "new"), ("c", "new")], "path string, md5 string")
    assert column(digest.apply_digests(rows, new), "md5") == {"a": "new", "b": "old", "c": "new"}


def test_dry_run(spark):
    old = snapshot(spark, {"path": "b", "size": 3, "md5": "kept"})
    assert tuple(hash_dry_run(scan(spark), old).first()) == (3, 11)
    assert tuple(hash_dry_run(scan(spark), None).first()) == (5, 17)


def test_dedupe(spark, by_table):
    hashed, plan = dedupe_job(scan(spark), None, by_table)
    assert column(plan, "canonical_path") == {"e": "a"}
    assert hashed.count() == 5


def test_several_devices(spark, by_table):
    mixed = scan(spark).withColumn("device", (F.col("path") == "e").cast("long"))
    with pytest.raises(OSError):
        dedupe_job(mixed, None, by_table, one_device=True)
    _, plan = dedupe_job(mixed, None, by_table)
    assert plan.isEmpty()


def test_file_tree_end_to_end(spark, tmp_path):
    """Scan, digest, plan, carry the plan out by hand, scan again: nothing is left."""
    root = tmp_path / "tree"
    root.mkdir()
    (root / "base").write_text("text")
    os.link(root / "base", root / "link")
    (root / "copy").write_text("text")
    os.link(root / "copy", root / "copy link")
    os.link(root / "copy", root / "copy link 2")
    (root / "other").write_text("different text")
    (root / "empty").touch()

    def look():
        entries = sources.inventory_of(sources.walk_tree(spark, [str(root)]))
        return stage(sources.manifest_from_inventory(entries), "look")

    saved = str(tmp_path / "snapshots")
    before = look()
    hashed, plan = dedupe_job(before, None, digest.digest_files, one_device=True)
    snapshot_dir = sources.write_snapshot(hashed, saved, "1")
    assert {os.path.basename(p) for p in column(plan, "md5")} == {"base", "link"}
    freed = reports.savings(hashed).first()
    assert (freed.n_groups, freed.n_bytes_freed) == (1, 4)

    planned = column(linking.apply_link_plan(hashed, plan), "inode")
    for path, target in column(plan, "canonical_path").items():
        os.unlink(path)
        os.link(target, path)
    after = look()
    assert column(after, "inode") == planned

    old = sources.read_snapshot(spark, snapshot_dir)
    again, plan = dedupe_job(after, old, digest.digest_files)
    assert plan.isEmpty()
    assert again.filter("md5 is null").isEmpty()
