"""A filter for long lists: most rows whose key is not listed are dropped where they are read.

Listed keys set bits in a bitmap that a distributed aggregate builds and that is broadcast.
Its size follows the length of the list up to a bound, 32 MiB. A longer list fills it up:
the filter then drops less, and never a listed row.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from twinsieve.workspace import stage

BITS_PER_KEY = 16
LEAST_BITS, MOST_BITS = 1 << 18, 1 << 28


def bitmap_bits(n_keys: int) -> int:
    """A power of two, about BITS_PER_KEY bits for each key."""
    bits = LEAST_BITS
    while bits < min(BITS_PER_KEY * n_keys, MOST_BITS):
        bits *= 2
    return bits


def likely_members(rows: DataFrame, listed: DataFrame, key: str) -> DataFrame:
    """The rows but for most of those whose `key` is not in the stored table `listed`.

    Keys are compared by hash. Null keys are dropped. Nothing of `rows` is moved.
    """
    bits = bitmap_bits(listed.count())
    place = F.pmod(F.xxhash64(key), F.lit(bits)) + 1
    pieces = (
        listed.filter(F.col(key).isNotNull())
        .groupBy(F.bitmap_bucket_number(place).alias("_piece"))
        .agg(F.bitmap_construct_agg(F.bitmap_bit_position(place)).alias("_bits"))
    )
    pieces = F.broadcast(stage(pieces, "members"))
    marked = rows.filter(F.col(key).isNotNull()).withColumns(
        {"_piece": F.bitmap_bucket_number(place), "_at": F.bitmap_bit_position(place)}
    )
    byte = F.expr("cast(conv(hex(substring(_bits, cast(_at div 8 as int) + 1, 1)), 16, 10) as int)")
    is_set = byte.bitwiseAND(F.expr("shiftleft(1, cast(_at % 8 as int))")) != 0
    return marked.join(pieces, "_piece").filter(is_set).select(*rows.columns)
