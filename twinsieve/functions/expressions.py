"""Column expressions. All of them run inside whole-stage code generation."""

from pyspark.sql import Column
from pyspark.sql import functions as F

# POSIX file-type bits of st_mode.
FILE_TYPE_MASK = 0o170000
REGULAR_FILE = 0o100000

# Names of snapshot files. Characters without a replacement are dropped.
SNAPSHOT_PREFIX = "fs_info-"
SNAPSHOT_SUFFIX = ".parquet"
SNAPSHOT_REPLACED = "/\\:"
SNAPSHOT_REPLACEMENTS = "--"

# Decimal size units.
SIZE_UNITS = ["kB", "MB", "GB", "TB", "PB", "EB"]


def identity(device="device", inode="inode", path="path") -> Column:
    """Text key of the physical object a row stands for.

    (device, inode) where both are known; an unknown device (null) or inode (null or 0)
    makes the path its own identity.
    """
    return F.expr(
        f"""CASE WHEN {device} IS NULL OR {inode} IS NULL OR {inode} = 0 THEN concat('path:', {path})
                 ELSE concat_ws(':', {device}, {inode}) END"""
    )


def is_regular_file(mode) -> Column:
    return F.col(mode).bitwiseAND(FILE_TYPE_MASK) == REGULAR_FILE


def content_digest(payload) -> Column:
    """md5 of the whole payload as 32 lower-case hex digits; null stays null."""
    return F.md5(F.col(payload).cast("binary"))


def byte_size(payload) -> Column:
    return F.octet_length(F.col(payload)).cast("long")


def snapshot_name(root) -> Column:
    """File name a snapshot of `root` goes by: slashes become dashes, colons go."""
    flat = F.translate(F.col(root), SNAPSHOT_REPLACED, SNAPSHOT_REPLACEMENTS)
    return F.concat(F.lit(SNAPSHOT_PREFIX), flat, F.lit(SNAPSHOT_SUFFIX))


def display_count(n) -> Column:
    """1234567 -> 1,234,567"""
    return F.format_number(F.col(n), 0)


def display_bytes(n) -> Column:
    """Byte count as text: 1 Byte, 999 Bytes, 1.5 kB, 2.0 GB.

    The one decimal is rounded half up in integer arithmetic, so the text does
    not depend on how a floating-point quotient happens to be stored.
    """
    count = F.col(n)
    text = F.when(count == 1, F.lit("1 Byte")).when(
        count < 1000, F.concat(count.cast("string"), F.lit(" Bytes"))
    )
    for power, unit in enumerate(SIZE_UNITS, start=1):
        scale = 1000**power
        # Tenths of a unit, rounded: whole and remainder apart, to stay in 64 bits.
        tenth = scale // 10
        whole = F.expr(f"`{n}` div {tenth}")
        rest = F.expr(f"`{n}` % {tenth}")
        tenths = whole + (rest * 2 >= tenth).cast("long")
        shown = F.concat(
            F.floor(tenths / 10).cast("string"),
            F.lit("."),
            (tenths % 10).cast("string"),
            F.lit(f" {unit}"),
        )
        last = power == len(SIZE_UNITS)
        text = text.otherwise(shown) if last else text.when(count < scale * 1000, shown)
    return text
