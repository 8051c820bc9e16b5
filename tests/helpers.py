from collections import Counter

from twinsieve.schema import MANIFEST, SNAPSHOT


def manifest(spark, *rows):
    """Rows given as dicts; what is left out gets a harmless value."""
    base = {"root": "r", "device": 0, "inode": None, "mode": 0o100644, "size": 1}
    base |= {"mtime_us": 0, "links": 1, "md5": None}
    full = [base | row for row in rows]
    return spark.createDataFrame(
        [tuple(row[c] for c in MANIFEST.fieldNames()) for row in full], MANIFEST
    )


def snapshot(spark, *rows):
    base = {"inode": None, "size": 1, "mtime_us": 0, "md5": None}
    full = [base | row for row in rows]
    return spark.createDataFrame(
        [tuple(row[c] for c in SNAPSHOT.fieldNames()) for row in full], SNAPSHOT
    )


def column(df, name, key="path"):
    """{key: value of the named column}"""
    collected = df.select(key, name).collect()
    found = {row[0]: row[1] for row in collected}
    assert len(found) == len(collected), f"{key} is not unique"
    return found


def bag(df, *names):
    return Counter(map(tuple, df.select(*(names or sorted(df.columns))).collect()))


def same_rows(a, b):
    """Equal as multisets of rows, whatever the order of rows and columns."""
    names = sorted(a.columns)
    a, b = a.select(*names), b.select(*names)
    return a.exceptAll(b).isEmpty() and b.exceptAll(a).isEmpty()
