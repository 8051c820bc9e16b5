"""Small helpers for frames whose other columns are not known."""

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from twinsieve.workspace import new_path, remove_path


def stored(df: DataFrame, label: str, folder: str | None = None) -> DataFrame:
    """Write `df` to the shared work folder and read it back.

    The table cuts the lineage, outlives executors and tells Catalyst its size.
    """
    path = new_path(df.sparkSession, label) if folder is None else f"{folder}/{label}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Scratch:
    """Stored tables that nobody needs once a result of theirs is stored itself.

    They are deleted together at the end of the `with` block.
    """

    def __init__(self, spark: SparkSession, label: str):
        self.spark, self.folder, self.tables = spark, new_path(spark, label), 0
        self.kept: list[tuple[DataFrame, str]] = []

    def __enter__(self) -> "Scratch":
        return self

    def stored(self, df: DataFrame, label: str) -> DataFrame:
        self.tables += 1
        table = stored(df, f"{self.tables}-{label}", self.folder)
        self.kept.append((table, f"{self.folder}/{self.tables}-{label}"))
        return table

    def drop(self, *tables: DataFrame) -> None:
        """Delete tables that no frame reads any more before the end of the block."""
        for table, path in [k for k in self.kept if any(k[0] is t for t in tables)]:
            remove_path(self.spark, path)
            self.kept = [k for k in self.kept if k[0] is not table]

    def __exit__(self, *_) -> None:
        remove_path(self.spark, self.folder)


def keyed(docs: DataFrame, key: str, text: str) -> DataFrame:
    """Narrow to (_id, _fp, _text): key, fingerprint of the text, and the text itself.

    (_id, _fp) stands for a row in joins: rows equal in both have equal results, so a
    key that is null or repeated needs no further care.
    """
    return docs.select(
        F.col(key).alias("_id"), F.xxhash64(text).alias("_fp"), F.col(text).alias("_text")
    )


def same(left: DataFrame, right: DataFrame, *names: str) -> Column:
    """Join condition under which nulls are equal."""
    return reduce(lambda a, b: a & b, (left[n].eqNullSafe(right[n]) for n in names))


# Bits of the filter that goes before a join of texts: 16 per listed row, between these.
LEAST_BITS, MOST_BITS = 1 << 20, 1 << 28


def _bits(listed: DataFrame) -> int:
    wanted, bits = min(16 * listed.count(), MOST_BITS), LEAST_BITS
    while bits < wanted:
        bits *= 2
    return bits


def _maps(listed: DataFrame, place: Column) -> DataFrame:
    """Parts of 4 KB of the bitmap of the places, which count from 1."""
    return listed.groupBy(F.bitmap_bucket_number(place).alias("_part")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_map")
    )


def bitmap(listed: DataFrame, on: str) -> bytes:
    """The bitmap of `_filtered` as bytes, for Python steps: hash h is bit h modulo its length,
    the lowest of a byte first. Built by a distributed aggregate; 32 MB at most."""
    bits = _bits(listed)
    out = bytearray(bits // 8)
    for part, found in _maps(listed, F.pmod(F.col(on), F.lit(bits)) + 1).collect():
        out[(part - 1) * len(found) : part * len(found)] = found
    return bytes(out)


def _filtered(rows: DataFrame, listed: DataFrame, on: str = "_fp") -> DataFrame:
    """Add _maybe to rows: false only where no listed row has the same 64-bit hash `on`.

    A bitmap of the listed hashes, built by a distributed aggregate and broadcast: 32 MB at
    most, whatever the input. It only saves shuffles; where it fills up, results stay.
    """
    place = F.pmod(F.col(on), F.lit(_bits(listed))) + 1
    maps = _maps(listed, place)
    # Four bytes as an integer, since each row would spend more on the text of a byte.
    word = "cast(conv(hex(substring(_map, 4 * i + 1, 4)), 16, 10) as bigint)"
    signed = f"cast(shiftright(shiftleft({word}, 32), 32) as int)"
    maps = maps.select("_part", F.expr(f"transform(sequence(0, 1023), i -> {signed})").alias("_map"))
    maps = F.broadcast(stored(maps, "filter"))
    at = F.bitmap_bit_position(place)
    bit = F.expr("bit_get(_map[cast(_at div 32 as int)], cast(24 - _at div 8 % 4 * 8 + _at % 8 as int))")
    marked = rows.withColumns({"_part": F.bitmap_bucket_number(place), "_at": at})
    marked = marked.join(maps, "_part", "left")
    return marked.select(*rows.columns, F.coalesce(bit != 0, F.lit(False)).alias("_maybe"))


def likely_rows(rows: DataFrame, listed: DataFrame, on: str) -> DataFrame:
    """The rows but for most of those that a join to a stored list by `on` would drop."""
    return _filtered(rows, listed, on).filter("_maybe").drop("_maybe")


def listed_rows(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """Inner join of wide rows to a stored list on (_id, _fp), nulls equal.

    Rows that the list cannot hold are dropped before the join, so that it shuffles
    the text of candidates only.
    """
    near = likely_rows(rows, listed, "_fp")
    extra = [listed[c] for c in listed.columns if c not in ("_id", "_fp")]
    return near.join(listed, same(near, listed, "_id", "_fp")).select(*[near[c] for c in rows.columns], *extra)


def unlisted_rows(rows: DataFrame, listed: DataFrame) -> DataFrame:
    """The rows that are not in a stored list of (_id, _fp); their texts stay in place."""
    marked = _filtered(rows, listed)
    near = marked.filter("_maybe")
    rest = near.join(listed, same(near, listed, "_id", "_fp"), "left_anti")
    return marked.filter("not _maybe").unionByName(rest).drop("_maybe")


def packed(docs: DataFrame) -> Column:
    """All columns as one struct `_row`, so that no name of theirs can meet a helper's."""
    return F.struct(*[docs[c] for c in docs.columns]).alias("_row")


def unpacked(df: DataFrame, docs: DataFrame, added: dict[str, Column]) -> DataFrame:
    """The columns of `docs` from `_row` and new ones; an old one of a new name is replaced."""
    names = {n.lower() for n in added}
    kept = [F.col("_row").getField(c).alias(c) for c in docs.columns if c.lower() not in names]
    return df.select(*kept, *[value.alias(name) for name, value in added.items()])


def with_columns(docs: DataFrame, added: dict[str, Column]) -> DataFrame:
    """Append columns; an input column of the same name is replaced."""
    names = {n.lower() for n in added}
    return docs.select(
        *[docs[c] for c in docs.columns if c.lower() not in names],
        *[value.alias(name) for name, value in added.items()],
    )
