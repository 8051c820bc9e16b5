"""Every query against its SQL equivalent, and the size of each case in the fixture."""

from collections import Counter

import duckdb
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tests.helpers import column
from twinsieve.operators import canonical, reconcile, reports, reuse
from workload.fixture import fixture
from workload.oracle import ORACLE as SQL
from workload.queries import QUERIES

TABLES = ["documents", "pages", "benchmark", "conversations"]


@pytest.fixture(scope="module")
def db(sf_dir):
    connection = duckdb.connect()
    for name in TABLES:
        connection.sql(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return connection


def counted(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return Counter(tuple(row[i] for i in order) for row in rows)


def test_all_queries_have_sql():
    assert set(QUERIES) == set(SQL)
    assert set(QUERIES) <= set(entry.queries()) and set(SQL) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(SQL))
def test_query_equals_sql(spark, db, sf_dir, name):
    got = QUERIES[name](spark, sf_dir)
    want = db.sql(SQL[name])
    assert sorted(got.columns) == sorted(want.columns)
    assert counted(got.columns, got.collect()) == counted(want.columns, want.fetchall())


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_fixture_covers_every_case(spark, sf_dir):
    f = fixture(spark, sf_dir)
    assert f.manifest.count() == 200
    changes = reuse.snapshot_changes(f.manifest, f.previous).groupBy("change").count()
    assert column(changes, "count", key="change") == {
        "new": 40,
        "changed": 36,
        "unhashed": 9,
        "reused": 115,
        "deleted": 4,
    }
    assert reuse.digest_mismatches(f.hashed, f.previous).count() == 20
    merged = reuse.reuse_digests(f.manifest, f.previous)
    kind = (
        F.when(F.col("n_paths") == 1, "single")
        .when(F.col("n_digests") > 1, "conflict")
        .when(F.col("n_hashed") == 0, "null")
        .when(F.col("n_hashed") == F.col("n_paths"), "full")
        .otherwise("fill")
    )
    kinds = reconcile.inode_profile(merged).groupBy(kind.alias("kind")).count()
    assert column(kinds, "count", key="kind") == {"single": 191, "conflict": 1, "fill": 3}
    assert reconcile.linked_without_digest(merged).count() == 63
    assert canonical.duplicate_groups(f.hashed).count() == 6
    assert reports.savings(f.hashed).first().n_bytes_freed == 15459
