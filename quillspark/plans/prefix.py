"""Row numbers and running totals over a whole table, without putting it in one task.

Rows fall into ranges of their numeric id. Each range is summed first; only these sums, one row per range, are put in
order to give the total before each range, and rows are then ordered within their range alone. Ranges follow the ids:
CELLS quantiles of them (one small pass over the id column), each cut into SUB parts of equal width, so dense, sparse and
hashed ids alike spread over CELLS * SUB ranges, and no range holds more than about a CELLS-th of the rows unless more
share one id. Null ids come first.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T

ROWS, CELLS, SUB = 16, 256, 64


def range_of(id_col: Column, bounds: list[float]) -> Column:
    """The number of the range an id falls in, ascending with the id; a few tens of comparisons a row."""
    if len(bounds) < 2:
        return F.when(id_col.isNull(), -1).otherwise(0).cast("long")
    width = -(-(len(bounds) - 1) // ROWS)  # bounds in a row
    cells = [(low, SUB / (high - low)) for low, high in zip(bounds, bounds[1:], strict=False)]
    rows = [cells[i : i + width] for i in range(0, len(cells), width)]
    first = F.array(*[F.lit(r[0][0]) for r in rows])
    starts, scales = (F.array(*[F.array(*[F.lit(c[k]) for c in r]) for r in rows]) for k in (0, 1))
    x = id_col.cast("double")
    last = lambda array: F.greatest(F.size(F.filter(array, lambda s: s <= x)) - 1, F.lit(0))

    def cell(row: Column) -> Column:
        return T.let(last(F.get(starts, row)), lambda k: place(row, k))

    def place(row: Column, k: Column) -> Column:
        part = F.floor((x - F.get(F.get(starts, row), k)) * F.get(F.get(scales, row), k))
        return (row * width + k) * SUB + F.greatest(F.lit(0), F.least(part, F.lit(SUB - 1)))

    return F.when(id_col.isNull(), F.lit(-1)).otherwise(T.let(last(first), cell)).cast("long")


def quantiles(df: DataFrame, id_col: str) -> list[float]:
    """Ascending distinct bounds of about CELLS equal parts of the ids; at most CELLS + 1 numbers come to the driver."""
    found = df.select(F.col(id_col).cast("double").alias("_id")).stat.approxQuantile("_id", [i / CELLS for i in range(CELLS + 1)], 0.25 / CELLS)
    return sorted(set(found))


def total_before(df: DataFrame, id_col: str, value: Column, out: str, ties: tuple[str, ...] = (), group: tuple[str, ...] = ()) -> DataFrame:
    """df with out: the sum of value over all rows of smaller id (ties broken by the columns given), per group if any."""
    rows = df.withColumns({"_range": range_of(F.col(id_col), quantiles(df, id_col)), "_value": value})
    keys = [*group, "_range"]
    before = Window.partitionBy(*group).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = rows.groupBy(*keys).agg(F.sum("_value").alias("_sum"))
    sums = sums.select(*keys, F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_value"), F.lit(True).alias("_first"))
    # a range's total before it is its first row, so rows are shuffled once, with no join before
    rows = rows.withColumn("_first", F.lit(False)).unionByName(sums, allowMissingColumns=True)
    within = Window.partitionBy(*keys).orderBy(F.desc("_first"), id_col, *ties).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn(out, F.coalesce(F.sum("_value").over(within), F.lit(0))).where(~F.col("_first"))
    return rows.drop("_range", "_value", "_first")


def row_number(df: DataFrame, id_col: str, out: str = "rn", ties: tuple[str, ...] = (), group: tuple[str, ...] = ()) -> DataFrame:
    """df with out: 1, 2, … in the order of id_col."""
    return total_before(df, id_col, F.lit(1), out, ties, group).withColumn(out, F.col(out) + 1)
