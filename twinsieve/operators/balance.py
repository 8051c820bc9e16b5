"""Work cut into bins of equal bytes, from an exact histogram of sizes.

Objects are put end to end, smallest first, and a bin is a stretch of half its bytes: an
object belongs to the bin in which it starts. One that is larger than the stretch is a bin
of its own. So no bin holds more than its bytes, unless it is a single object.

Where an object starts is known without sorting all rows in one place: counts per (size,
cell) are added up, a cell being the first hex digits of the path's md5, and rows are only
ranked within their cell. A size that a third of all rows have has 65,536 cells.
"""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What opening and listing an object costs, in bytes read meanwhile. Bounds the number of
# empty objects in a bin as well.
OBJECT_COST = 64 * 1024
BIN_BYTES = 256 * 1024 * 1024
CELL_DIGITS = 4


def _before(order: list[str], *partition: str):
    """All rows before the current one."""
    window = Window.partitionBy(*partition) if partition else Window.partitionBy()
    return window.orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def _sum_before(value: Column | str, order: list[str], *partition: str) -> Column:
    return F.coalesce(F.sum(value).over(_before(order, *partition)), F.lit(0))


def digest_bins(
    pending: DataFrame, bin_bytes: int = BIN_BYTES, object_cost: int = OBJECT_COST
) -> DataFrame:
    """path, bin and bytes of each pending row. Bin numbers have gaps.

    `pending` is read twice: pass a stored table. A null size counts as 0.
    """
    half = max(1, bin_bytes // 2)
    rows = pending.select(
        "path",
        F.coalesce("size", F.lit(0)).alias("bytes"),
        F.substring(F.md5(F.col("path").cast("binary")), 1, CELL_DIGITS).alias("_cell"),
    )
    weight = F.col("bytes") + F.lit(object_cost).cast("long")
    cells = rows.groupBy("bytes", "_cell").agg(F.count("*").alias("_n"))
    sizes = cells.groupBy("bytes").agg(F.sum("_n").alias("_n"))
    # The square root of a size splits the running sum into two short ones.
    sizes = sizes.withColumn("_part", F.floor(F.sqrt("bytes")))
    parts = sizes.groupBy("_part").agg(F.sum(weight * F.col("_n")).alias("_bytes"))
    parts = parts.select("_part", _sum_before("_bytes", ["_part"]).alias("_part_start"))
    starts = sizes.join(parts, "_part").select(
        "bytes",
        (F.col("_part_start") + _sum_before(weight * F.col("_n"), ["bytes"], "_part")).alias("_start"),
    )
    cells = cells.withColumn("_before", _sum_before("_n", ["_cell"], "bytes")).join(starts, "bytes")
    cells = cells.select("bytes", "_cell", (F.col("_start") + weight * F.col("_before")).alias("_start"))
    in_cell = F.row_number().over(Window.partitionBy("bytes", "_cell").orderBy("path")) - 1
    placed = rows.withColumn("_nth", in_cell).join(cells, ["bytes", "_cell"])
    stretch = F.floor((F.col("_start") + weight * F.col("_nth")) / half)
    return placed.select("path", (stretch * 2 + (weight > half).cast("long")).alias("bin"), "bytes")


def balanced(
    pending: DataFrame, bin_bytes: int = BIN_BYTES, object_cost: int = OBJECT_COST
) -> DataFrame:
    """The pending rows, one bin in each partition. Only rows of the list are moved."""
    bins = digest_bins(pending, bin_bytes, object_cost)
    # There are at most four per bin_bytes of the input, so one task can number them.
    numbers = bins.select("bin").distinct()
    numbers = numbers.withColumn("_number", F.row_number().over(Window.orderBy("bin")) - 1)
    n_bins = max(1, numbers.count())
    dealt = pending.join(bins.join(numbers, "bin").select("path", "_number"), "path")
    return dealt.repartitionById(n_bins, F.col("_number").cast("int")).drop("_number")
