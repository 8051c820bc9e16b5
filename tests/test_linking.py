import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.helpers import bag, column, manifest, same_rows
from twinsieve.functions import identity
from twinsieve.operators import canonical, linking
from twinsieve.schema import LINK_PLAN


def copies(spark):
    return manifest(
        spark,
        # Most links: e. Object with most paths: 2. Oldest: d.
        {"path": "a", "inode": 2, "links": 3, "mtime_us": 50, "md5": "xx"},
        {"path": "b", "inode": 2, "links": 3, "mtime_us": 50, "md5": "xx"},
        {"path": "c", "inode": 2, "links": 3, "mtime_us": 50, "md5": "xx"},
        {"path": "d", "inode": 1, "links": 1, "mtime_us": 10, "md5": "xx"},
        {"path": "e", "inode": 3, "links": 9, "mtime_us": 60, "md5": "xx"},
        # One object with two paths: nothing to link.
        {"path": "f", "inode": 7, "links": 2, "md5": "yy"},
        {"path": "g", "inode": 7, "links": 2, "md5": "yy"},
        # Unknown inodes are objects of their own.
        {"path": "h", "inode": 0, "mtime_us": 5, "md5": "zz"},
        {"path": "i", "inode": 0, "mtime_us": 4, "md5": "zz"},
        {"path": "alone", "inode": 11, "md5": "uu"},
        {"path": "undigested1", "inode": 12},
        {"path": "undigested2", "inode": 13},
    )


@pytest.mark.parametrize(
    ("policy", "kept", "moved"),
    [
        ("max_links", ("e", 3), {"a", "b", "c", "d"}),
        ("modal_inode", ("a", 2), {"d", "e"}),
        ("first_seen", ("d", 1), {"a", "b", "c", "e"}),
    ],
)
def test_policies(spark, heat, policy, kept, moved):
    scan = copies(spark)
    elected = canonical.canonicals(scan, policy).filter("md5 = 'xx'").first()
    assert (elected.canonical_path, elected.canonical_inode, elected.n) == (*kept, 5)
    plan = linking.link_plan(scan, policy)
    assert plan.columns == LINK_PLAN.fieldNames()
    targets = column(plan, "canonical_path")
    last = "i" if policy == "first_seen" else "h"
    want = {path: kept[0] for path in moved} | {({"h", "i"} - {last}).pop(): last}
    assert targets == want


def test_ties_go_to_the_smallest_path(spark, heat):
    scan = manifest(
        spark, *[{"path": p, "inode": n, "md5": "xx"} for n, p in enumerate("cabd", start=1)]
    )
    for policy in canonical.POLICIES:
        assert set(column(linking.link_plan(scan, policy), "canonical_path").values()) == {"a"}


def test_unknown_policy(spark):
    with pytest.raises(ValueError):
        linking.link_plan(copies(spark), "newest")


def test_never_across_devices(spark, heat):
    scan = copies(spark).withColumn("device", (F.col("path") == "d").cast("long"))
    assert "d" not in column(linking.link_plan(scan), "md5")


def test_duplicate_groups_and_rows(spark, heat):
    scan = copies(spark)
    groups = canonical.duplicate_groups(scan)
    assert bag(groups, "md5", "n_paths", "n_objects", "first_path") == {
        ("xx", 5, 3, "a"): 1,
        ("zz", 2, 2, "h"): 1,
    }
    assert set(column(canonical.duplicate_rows(scan), "md5")) == set("abcdefghi")


def test_applied_plan(spark, heat):
    scan = copies(spark)
    applied = linking.apply_link_plan(scan, linking.link_plan(scan))
    inodes = column(applied, "inode")
    assert {inodes[p] for p in "abcde"} == {3}
    assert inodes["f"] == 7 and inodes["alone"] == 11
    assert same_rows(applied.drop("inode"), scan.drop("inode"))


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    rows=st.lists(
        st.tuples(st.integers(0, 1), st.integers(1, 9), st.integers(1, 4)),
        min_size=1,
        max_size=20,
    ),
    policy=st.sampled_from(canonical.POLICIES),
)
def test_one_object_per_content_after_linking(spark, rows, policy):
    # All paths of an object share its digest, as they do after the sync.
    scan = manifest(
        spark,
        *[
            {"path": f"p{n:02}", "device": d, "inode": i, "links": k, "md5": f"m{i % 3}"}
            for n, (d, i, k) in enumerate(rows)
        ],
    )
    applied = linking.apply_link_plan(scan, linking.link_plan(scan, policy))
    objects = applied.groupBy("device", "md5").agg(F.count_distinct(identity()).alias("n"))
    assert {r.n for r in objects.collect()} == {1}
    assert linking.link_plan(applied, policy).isEmpty()


def test_rows_on_unknown_devices_take_no_part(spark):
    from twinsieve.operators.canonical import POLICIES
    from twinsieve.operators.reconcile import sync_digests

    rows = manifest(
        spark,
        {"path": "a", "device": None, "inode": 1, "md5": "xx"},
        {"path": "b", "device": None, "inode": 1, "md5": "yy"},
        {"path": "c", "device": None, "inode": 2, "md5": "xx"},
        {"path": "d", "inode": 3, "md5": "xx"},
    )
    for policy in POLICIES:
        assert linking.link_plan(rows, policy).isEmpty()
    # Equal inodes on unknown devices are not one object.
    assert column(sync_digests(rows), "md5") == {"a": "xx", "b": "yy", "c": "xx", "d": "xx"}
