import os
import stat

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from tests.helpers import column, manifest, same_rows
from twinsieve import sources
from twinsieve.operators import digest
from twinsieve.schema import MANIFEST, SNAPSHOT


@pytest.fixture
def tree(tmp_path):
    """Two roots with copies, hard links, and names and kinds that scans stumble on."""
    one, two = tmp_path / "one", tmp_path / "two"
    (one / "deep" / "er").mkdir(parents=True)
    two.mkdir()
    (one / "base").write_text("base text")
    os.link(one / "base", one / "deep" / "link")
    (one / "deep" / "er" / "copy").write_text("base text")
    (one / "other").write_text("another text")
    (two / "base").write_text("base text")
    (two / "name with spaces").write_text("spaces")
    (one / "empty").touch()
    (one / ".hidden").write_text("hidden")
    (one / "_under").write_text("under")
    (one / "symlink").symlink_to(one / "base")
    (one / "dangling").symlink_to(one / "nowhere")
    return one, two


FILES = {"one/base", "one/deep/link", "one/deep/er/copy", "one/other", "one/empty"}
FILES |= {"one/.hidden", "one/_under", "two/base", "two/name with spaces"}


def walk(spark, *roots):
    return sources.inventory_of(sources.walk_tree(spark, [str(r) for r in roots]))


def test_walk_lists_every_regular_file_with_its_identity(spark, tree, tmp_path):
    got = sources.manifest_from_inventory(walk(spark, *tree))
    assert got.columns == MANIFEST.fieldNames()
    rows = {os.path.relpath(r.path, tmp_path): r for r in got.collect()}
    assert set(rows) == FILES
    for name, row in rows.items():
        s = os.lstat(tmp_path / name)
        assert (row.inode, row.device, row.links) == (s.st_ino, s.st_dev, s.st_nlink)
        assert (row.size, row.mtime_us) == (s.st_size, s.st_mtime_ns // 1000)
        assert stat.S_ISREG(row.mode) and row.md5 is None
    assert rows["one/base"].inode == rows["one/deep/link"].inode
    assert rows["one/base"].links == 2


def test_walk_lists_other_entries_too(spark, tree, tmp_path):
    names = {os.path.relpath(r.path, tmp_path) for r in walk(spark, *tree).collect()}
    assert names - FILES == {"one/deep", "one/deep/er", "one/symlink", "one/dangling"}


def test_overlapping_roots_count_once(spark, tree, tmp_path):
    got = walk(spark, tmp_path, *tree).filter("stat.mode & 61440 = 32768")
    assert {os.path.relpath(r.path, tmp_path) for r in got.collect()} == FILES
    assert got.count() == len(FILES)


def test_missing_root_is_counted_not_fatal(spark, tree, tmp_path):
    entries = sources.walk_tree(spark, [str(tree[1]), str(tmp_path / "nowhere")])
    assert sources.inventory_of(entries).count() == 2
    (row,) = sources.unreadable(entries).collect()
    assert (row.root, row.n_unreadable) == (str(tmp_path / "nowhere"), 1)


def test_listing_by_spark_source(spark, tree, tmp_path):
    """What binaryFile sees: no empty and no hidden files, but symlinks followed."""
    got = column(sources.scan_listing(spark, [str(r) for r in tree]), "size")
    names = {os.path.relpath(p.removeprefix("file:"), tmp_path): n for p, n in got.items()}
    hidden = {"one/empty", "one/.hidden", "one/_under"}
    assert set(names) == FILES - hidden | {"one/symlink"}
    assert names["one/other"] == len("another text")


def test_listing_reads_no_content(spark, tree):
    plan = sources.scan_listing(spark, [str(r) for r in tree])
    read = "ReadSchema: struct<path:string,modificationTime:timestamp,length:bigint>"
    assert read in plan._jdf.queryExecution().executedPlan().toString()


def test_file_digests(spark, tree, tmp_path):
    import hashlib

    files = sources.manifest_from_inventory(walk(spark, *tree))
    files = files.unionByName(manifest(spark, {"path": str(tmp_path / "gone")}))
    got = column(digest.digest_files(files), "md5")
    assert got.pop(str(tmp_path / "gone")) is None
    assert len(got) == len(FILES)
    for path, md5 in got.items():
        with open(path, "rb") as file:
            assert md5 == hashlib.md5(file.read()).hexdigest()


def test_binary_file_digests_agree(spark, tree):
    paths = [str(r) for r in tree]
    files = sources.manifest_from_inventory(walk(spark, *tree))
    chunked = column(digest.digest_files(files), "md5")
    whole = column(digest.digest_binary_files(spark, paths), "md5")
    whole = {p.removeprefix("file:"): md5 for p, md5 in whole.items() if "symlink" not in p}
    assert whole == {p: chunked[p] for p in whole} and whole


def test_inventory_round_trip(spark, tree, tmp_path):
    found = walk(spark, *tree)
    found.write.parquet(str(tmp_path / "inventory"))
    assert same_rows(sources.read_inventory(spark, str(tmp_path / "inventory")), found)


def test_regular_files(spark):
    rows = manifest(
        spark,
        {"path": "file", "mode": 0o100600},
        {"path": "directory", "mode": 0o40755},
        {"path": "link", "mode": 0o120777},
    )
    assert set(column(sources.regular_files(rows), "mode")) == {"file"}


def test_union_of_overlapping_roots(spark):
    one = manifest(spark, {"path": "a", "root": "r1"}, {"path": "b", "root": "r1"})
    two = manifest(spark, {"path": "b", "root": "r2"}, {"path": "c", "root": "r2"})
    assert column(sources.union_roots(two, one), "root") == {"a": "r1", "b": "r1", "c": "r2"}


def test_rows_as_objects(spark):
    table = spark.createDataFrame([(1, "Größe")], "id long, text string")
    got = sources.manifest_from_rows(
        table, F.concat(F.lit("/t/"), "id"), "text", root=F.lit("t"), with_digest=False
    )
    row = got.first()
    assert (row.path, row.size, row.md5, row.inode) == ("/t/1", 7, None, None)
    assert [f.dataType for f in got.schema] == [f.dataType for f in MANIFEST]


def test_snapshot_round_trip(spark, tmp_path):
    rows = manifest(spark, {"path": "a", "md5": "xx", "size": 3}, {"path": "b"})
    path = sources.write_snapshot(rows, str(tmp_path), "2026-01-01")
    saved = sources.read_snapshot(spark, path)
    assert [tuple(r) for r in saved.collect()] == [("a", None, 3, 0, "xx")]
    assert same_rows(sources.read_digest_list(spark, path), saved.select("md5"))
    with pytest.raises(AnalysisException):
        sources.write_snapshot(rows, str(tmp_path), "2026-01-01")


def test_missing_snapshot_is_empty_but_typed(spark, tmp_path):
    none = sources.read_snapshot(spark, str(tmp_path / "nothing"))
    assert none.schema.simpleString() == SNAPSHOT.simpleString()
    assert none.isEmpty()


def test_missing_digest_list_is_an_error(spark, tmp_path):
    with pytest.raises(AnalysisException):
        sources.read_digest_list(spark, str(tmp_path / "nothing"))
