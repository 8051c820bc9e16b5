from tests.helpers import column, manifest
from twinsieve.operators import pending


def scan(spark):
    return manifest(
        spark,
        {"path": "a", "inode": 1, "size": 5},
        {"path": "b", "inode": 1, "size": 5},
        {"path": "c", "inode": 2, "size": 7},
        {"path": "d", "inode": 3, "size": 9, "md5": "dd"},
        {"path": "e", "inode": 4, "size": 9},
        {"path": "f", "inode": 0, "size": 3},
        {"path": "g", "inode": 0, "size": 3},
        {"path": "h", "inode": 5, "size": 8, "md5": "hh"},
    )


def test_without_digest_smallest_first(spark):
    got = [r.path for r in pending.by_size(pending.without_digest(scan(spark))).collect()]
    assert got == ["f", "g", "a", "b", "c", "e"]


def test_size_groups(spark):
    assert column(pending.size_groups(scan(spark)), "n", key="size") == {5: 2, 9: 2, 3: 2}


def test_size_collisions_count_digested_rows_too(spark, heat):
    got = pending.size_collisions(scan(spark))
    assert column(got, "n") == {"a": 2, "b": 2, "e": 2, "f": 2, "g": 2}
    ordered = [r.path for r in pending.by_size_largest_first(got).collect()]
    assert ordered == ["e", "a", "b", "f", "g"]


def test_one_per_inode_keeps_unknown_inodes_apart(spark):
    got = pending.one_per_inode(pending.without_digest(scan(spark)))
    assert column(got, "n") == {"a": 2, "c": 1, "e": 1, "f": 1, "g": 1}
    assert column(got, "identity")["f"] == "path:f"
