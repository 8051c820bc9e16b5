"""Bringing rows and their groups together when one group may be huge.

A window over the group key would put a whole group into one task, and so would a
join on it. Groups are therefore counted exactly, by an aggregate that combines on the
map side, and hot ones are treated in a way that never gathers their rows.

* `with_group_values` - values computed from the rows themselves.
* `join_groups` - values that come from elsewhere, one row per group.
* `salted_join` - partners too wide to broadcast.

Hot is every group above a bound; no group beyond it is left out. Which groups are hot
affects speed only, never the result: a row is marked once, and a row that is not
marked finds every group.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# A group with more rows than this counts as hot. Overridden by the session setting.
HOT_ROWS = 100_000
HOT_ROWS_SETTING = "spark.twinsieve.hotRows"
# Or a share of all rows, if that is more: so there are less than HOT_SHARE hot groups
# of any input, and what is broadcast about them is bounded.
HOT_SHARE = 100_000
# Bytes of copies of a wide partner that one piece of a salted join may hold.
PIECE_BYTES = 256 * 1024 * 1024


def hot_rows(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get(HOT_ROWS_SETTING, str(HOT_ROWS)))


def with_group_values(rows: DataFrame, keys: list[str], values: dict[str, Column]) -> DataFrame:
    """Add to each row aggregates over all rows with the same `keys`.

    Rows with a null key get nulls. `rows` is read twice and needs a `path`: pass a
    stored table or a narrow step on one.
    """
    groups = rows.groupBy(*keys).agg(
        F.count("*").alias("_n"), *[value.alias(name) for name, value in values.items()]
    )
    return join_groups(rows, groups, keys, n="_n").drop("_n")


def is_short(df: DataFrame, rows: int) -> bool:
    """Whether a stored table has at most so many rows; its file footers tell."""
    return df.count() <= rows


def _hot(groups: DataFrame, n: str, least: int) -> DataFrame:
    """Groups with more than `least` of what `n` counts, and more than their share."""
    total = groups.agg(F.coalesce(F.sum(n), F.lit(0))).scalar()
    return groups.filter((F.col(n) > least) & (F.col(n) * HOT_SHARE > total))


def _scattered(key: str, dtype: T.DataType, spread_by: str) -> Column:
    """A value no group has as `key`, different from row to row."""
    noise = F.xxhash64(spread_by)
    if isinstance(dtype, T.StringType):
        return F.concat(F.lit("#"), noise.cast("string"))
    # Numeric keys here are byte sizes, never negative.
    return F.lit(-1) - F.pmod(noise, F.lit(2**62))


def join_groups(
    rows: DataFrame,
    groups: DataFrame,
    keys: list[str],
    *,
    how: str = "left",
    n: str = "n",
    spread_by: str = "path",
) -> DataFrame:
    """Join each row to its group, safely for groups of any size.

    Hot groups are broadcast. Rows that match one get a made-up join key, so
    that the shuffle spreads them over all partitions instead of sending them to
    one. All other rows meet their group in an ordinary shuffle join, on the
    partitioning that the aggregate behind `groups` has produced already.

    `groups` has one row per `keys` and a column `n` with the group's row count.
    Its other columns are added to `rows`. Null keys match nothing. `how` is "left"
    or "inner". `spread_by` is a column that differs between rows.
    """
    values = [c for c in groups.columns if c not in keys]
    # Stated for both branches alike, or Catalyst adds it to one of them only and
    # the two aggregates no longer are the same plan.
    for key in keys:
        groups = groups.filter(F.col(key).isNotNull())
    packed = F.struct(*values)
    hot = _hot(groups, n, hot_rows(rows)).select(
        *[F.col(k).alias(f"_hot_{k}") for k in keys], packed.alias("_hot")
    )
    cold = groups.select(*[F.col(k).alias(f"_cold_{k}") for k in keys], packed.alias("_cold"))

    is_hot = [F.col(k) == F.col(f"_hot_{k}") for k in keys]
    marked = rows.join(F.broadcast(hot), is_hot, "left")

    *lead, last = keys
    dtype = rows.schema[last].dataType
    settled = F.col("_hot").isNotNull() | F.col(last).isNull()
    marked = marked.withColumn(
        "_key",
        F.when(settled, _scattered(last, dtype, spread_by)).otherwise(F.col(last)),
    )
    is_cold = [F.col(k) == F.col(f"_cold_{k}") for k in lead]
    is_cold.append(F.col("_key") == F.col(f"_cold_{last}"))
    joined = marked.join(cold, is_cold, "left").withColumn("_group", F.coalesce("_hot", "_cold"))
    if how == "inner":
        joined = joined.filter(F.col("_group").isNotNull())
    elif how != "left":
        raise ValueError(f"how must be 'left' or 'inner', not {how!r}")
    return joined.select(*rows.columns, *[F.col("_group")[v].alias(v) for v in values])


def salted_join(
    rows: DataFrame,
    wide: DataFrame,
    key: str,
    *,
    sizes: DataFrame | None = None,
    spread_by: str = "path",
) -> DataFrame:
    """Inner join of many rows per key to one `wide` row per key.

    For partners too wide to broadcast. A hot key is split into pieces, and only the
    partner of such a key is copied, once per piece. A piece has about `hot_rows` rows
    or, where `sizes` tells the bytes of each partner (key, size), PIECE_BYTES of
    copies if that is less.
    """
    pieces = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("_n"))
    pieces = pieces.withColumn("_pieces", F.ceil(F.col("_n") / hot_rows(rows)))
    if sizes is not None:
        by_bytes = F.ceil(F.col("_n") * F.col("size") / PIECE_BYTES)
        pieces = pieces.join(sizes.select(key, "size"), key)
        pieces = pieces.withColumn("_pieces", F.greatest("_pieces", by_bytes))
    pieces = pieces.withColumn("_pieces", F.col("_pieces").cast("long"))
    pieces = F.broadcast(
        _hot(pieces, "_pieces", 1).select(
            F.col(key).alias("_hot_key"), F.least("_n", "_pieces").alias("_pieces")
        )
    )
    left = rows.join(pieces, F.col(key) == F.col("_hot_key"), "left").select(
        *rows.columns,
        F.pmod(F.xxhash64(spread_by), F.coalesce("_pieces", F.lit(1))).alias("_piece"),
    )
    right = wide.join(pieces, F.col(key) == F.col("_hot_key"), "left").select(
        *wide.columns,
        F.explode(
            F.sequence(F.lit(0).cast("long"), F.coalesce("_pieces", F.lit(1)) - 1)
        ).alias("_piece"),
    )
    return left.join(right, [key, "_piece"], "inner").drop("_piece")
