import hashlib
import stat

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from twinsieve.functions import (
    byte_size,
    content_digest,
    display_bytes,
    display_count,
    identity,
    is_regular_file,
    snapshot_name,
)


def test_digest_and_size_are_those_of_the_utf8_bytes(spark):
    texts = ["", "a", "Größe", "日本語", "line\nline", "x" * 100_000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select("text", content_digest("text"), byte_size("text")).collect()
    for text, md5, size in got:
        data = text.encode()
        assert (md5, size) == (hashlib.md5(data).hexdigest(), len(data))


def test_digest_of_bytes_and_null(spark):
    df = spark.createDataFrame([(bytearray(b"\x00\xff"),), (None,)], "data binary")
    got = [r[0] for r in df.select(content_digest("data")).collect()]
    assert got == [hashlib.md5(b"\x00\xff").hexdigest(), None]


@pytest.mark.parametrize(
    ("device", "inode", "want"),
    [(3, 7, "3:7"), (3, 0, "path:/p"), (3, None, "path:/p"), (0, 7, "0:7")],
)
def test_identity(spark, device, inode, want):
    df = spark.createDataFrame(
        [(device, inode, "/p")], "device long, inode long, path string"
    )
    assert df.select(identity()).first()[0] == want


def test_regular_file_bits_agree_with_the_os(spark):
    modes = [0o100644, 0o100755, 0o40755, 0o120777, 0o10644, 0o140755, 0o60660]
    df = spark.createDataFrame([(m,) for m in modes], "mode int")
    got = dict(map(tuple, df.select("mode", is_regular_file("mode")).collect()))
    assert got == {m: stat.S_ISREG(m) for m in modes}


@pytest.mark.parametrize(
    ("root", "want"),
    [
        ("/data/photos", "fs_info--data-photos.parquet"),
        ("C:\\Users\\me", "fs_info-C-Users-me.parquet"),
        ("D:/mixed\\way", "fs_info-D-mixed-way.parquet"),
    ],
)
def test_snapshot_name(spark, root, want):
    df = spark.createDataFrame([(root,)], "root string")
    assert df.select(snapshot_name("root")).first()[0] == want


@pytest.mark.parametrize(
    ("n", "want"),
    [
        (0, "0 Bytes"),
        (1, "1 Byte"),
        (999, "999 Bytes"),
        (1000, "1.0 kB"),
        (1449, "1.4 kB"),
        (1450, "1.5 kB"),
        (999_949, "999.9 kB"),
        (2_000_000, "2.0 MB"),
        (3_140_000_000, "3.1 GB"),
        (5 * 10**12, "5.0 TB"),
        (7 * 10**15 + 49 * 10**12, "7.0 PB"),
        (9 * 10**18, "9.0 EB"),
    ],
)
def test_display_bytes(spark, n, want):
    df = spark.createDataFrame([(n,)], "n long")
    assert df.select(display_bytes("n")).first()[0] == want


@settings(max_examples=20, deadline=None, suppress_health_check=list(HealthCheck))
@given(numbers=st.lists(st.integers(0, 2**63 - 1), min_size=1, max_size=50))
def test_display_bytes_is_within_half_a_tenth(spark, numbers):
    units = {"kB": 1, "MB": 2, "GB": 3, "TB": 4, "PB": 5, "EB": 6}
    df = spark.createDataFrame([(n,) for n in numbers], "n long")
    for n, text in df.select("n", display_bytes("n")).collect():
        shown, unit = text.split(" ")
        if unit in units:
            whole, tenth = shown.split(".")
            scale = 1000 ** units[unit]
            tenths = int(whole) * 10 + int(tenth)
            assert abs(tenths * scale - n * 10) * 2 <= scale
        else:
            assert int(shown) == n


def test_display_count(spark):
    df = spark.range(1).select(F.lit(1234567).alias("n"))
    assert df.select(display_count("n")).first()[0] == "1,234,567"
