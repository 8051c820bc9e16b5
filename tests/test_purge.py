import pytest

from tests.helpers import column, manifest, same_rows
from twinsieve.operators import purge
from twinsieve.plans import purge_job
from twinsieve.schema import DIGEST_LIST


@pytest.fixture(params=["short list", "long list"], autouse=True)
def length(request, monkeypatch):
    if request.param == "long list":
        monkeypatch.setattr(purge, "BROADCAST_DIGESTS", 0)


def scan(spark):
    return manifest(
        spark,
        {"path": "a", "inode": 1, "md5": "bad"},
        {"path": "b", "inode": 1, "md5": "bad"},
        {"path": "c", "inode": 2, "md5": "bad"},
        {"path": "d", "inode": 3, "md5": "good"},
        {"path": "e", "inode": 4},
    )


def listed(spark, *digests):
    return spark.createDataFrame([(d,) for d in digests], DIGEST_LIST)


def test_candidates_and_survivors_are_all_rows(spark, heat):
    rows, reference = scan(spark), listed(spark, "bad", "bad", "unheard", None)
    gone, kept = purge.purge_candidates(rows, reference), purge.purge_survivors(rows, reference)
    assert set(column(gone, "md5")) == {"a", "b", "c"}
    assert set(column(kept, "md5")) == {"d", "e"}
    assert same_rows(gone.unionByName(kept), rows)


def test_first_of_each_object(spark, heat):
    got = purge_job(scan(spark), listed(spark, "bad"), first_of_inode=True)
    assert set(column(got, "md5")) == {"a", "c"}
    assert got.columns == scan(spark).columns


def test_empty_list(spark):
    assert purge_job(scan(spark), listed(spark)).isEmpty()
    assert same_rows(purge.purge_survivors(scan(spark), listed(spark)), scan(spark))
