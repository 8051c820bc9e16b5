from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from tests.helpers import bag, column, manifest, same_rows
from twinsieve.operators import reconcile


def objects(spark):
    """Objects with no digest, one for some paths, one for all, and two."""
    return manifest(
        spark,
        {"path": "none1", "inode": 1, "links": 2},
        {"path": "none2", "inode": 1, "links": 2},
        {"path": "some1", "inode": 2, "links": 3, "md5": "aa"},
        {"path": "some2", "inode": 2, "links": 3},
        {"path": "some3", "inode": 2, "links": 3},
        {"path": "all1", "inode": 3, "links": 2, "md5": "bb"},
        {"path": "all2", "inode": 3, "links": 2, "md5": "bb"},
        {"path": "two1", "inode": 4, "links": 3, "md5": "aa"},
        {"path": "two2", "inode": 4, "links": 3, "md5": "cc"},
        {"path": "two3", "inode": 4, "links": 3},
        {"path": "alone", "inode": 5, "md5": "dd"},
        {"path": "unknown1", "inode": 0, "md5": "ee"},
        {"path": "unknown2", "inode": 0},
        {"path": "unknown3", "inode": None, "links": 2},
        {"path": "elsewhere", "inode": 2, "device": 1, "md5": "ff"},
    )


def test_sync(spark, heat):
    scan = objects(spark)
    got = reconcile.sync_digests(scan)
    want = column(scan, "md5")
    want |= {"some2": "aa", "some3": "aa", "two1": None, "two2": None}
    assert column(got, "md5") == want
    assert same_rows(got.drop("md5"), scan.drop("md5"))
    assert same_rows(reconcile.sync_digests(got), got)


def test_sync_with_trusted_link_counts(spark, heat):
    scan = objects(spark)
    got = reconcile.sync_digests(scan, trust_links=True)
    assert same_rows(got, reconcile.sync_digests(scan))


def test_rows_without_inode_are_not_shuffled(spark):
    scan = objects(spark).filter("inode is null or inode = 0")
    got = reconcile.sync_digests(scan)
    got.collect()
    final = got._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]
    assert "Window" not in final
    assert same_rows(got, scan)


def test_fill_leaves_contradictions(spark, heat):
    scan = objects(spark)
    want = column(scan, "md5") | {"some2": "aa", "some3": "aa"}
    assert column(reconcile.fill_digests(scan), "md5") == want


def test_profile(spark):
    got = reconcile.inode_profile(objects(spark))
    profile = {r.identity: (r.n_paths, r.n_hashed, r.n_digests, r.first_path) for r in got.collect()}
    assert profile["0:1"] == (2, 0, 0, "none1")
    assert profile["0:2"] == (3, 1, 1, "some1")
    assert profile["0:4"] == (3, 2, 2, "two1")
    assert profile["1:2"] == (1, 1, 1, "elsewhere")
    assert profile["path:unknown2"] == (1, 0, 0, "unknown2")


def test_conflicts(spark, heat):
    got = reconcile.inode_conflicts(objects(spark))
    assert bag(got, "identity", "md5", "n_paths", "n_digests", "first_path") == {
        ("0:4", "aa", 1, 2, "two1"): 1,
        ("0:4", "cc", 1, 2, "two2"): 1,
    }


def test_flags(spark):
    got = reconcile.inode_flags(objects(spark))
    flags = {r.identity: (r.all_hashed, r.any_hashed, r.none_hashed) for r in got.collect()}
    assert flags["0:1"] == (False, False, True)
    assert flags["0:2"] == (False, True, False)
    assert flags["0:3"] == (True, True, False)


def test_linked_without_digest_and_their_objects(spark, heat):
    scan = objects(spark)
    missing = {"none1", "none2", "some2", "some3", "two3", "unknown3"}
    assert set(column(reconcile.linked_without_digest(scan), "md5")) == missing
    assert set(column(reconcile.affected_rows(scan), "md5")) == missing | {"some1", "two1", "two2"}


digests = st.sampled_from([None, "aa", "bb"])


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(rows=st.lists(st.tuples(st.integers(0, 4), digests), min_size=1, max_size=25))
def test_sync_equals_brute_force(spark, rows):
    scan = manifest(
        spark, *[{"path": f"p{n}", "inode": i, "md5": m} for n, (i, m) in enumerate(rows)]
    )
    want = {}
    for n, (inode, md5) in enumerate(rows):
        known = {m for i, m in rows if i == inode and m} if inode else {md5} - {None}
        want[f"p{n}"] = known.pop() if len(known) == 1 else None
    assert column(reconcile.sync_digests(scan), "md5") == want
