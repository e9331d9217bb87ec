"""Ordered windows per key that don't put a hot key in one task: segmented scans in two levels.

A key with more than `least` rows and more than 1 / `pieces` of all rows is hot; there are fewer than `pieces` such keys.
The rows of a hot key are cut into pieces along quantiles of the first order column. Each piece is summed up in a row: a
sum, a count, its last row, its last value that isn't null. These summaries, fewer than 3 * `pieces` rows in all whatever
the table's size, are put in order to give what a piece inherits from those before (or after) it, and are broadcast. Rows
then finish within their piece. Keys that aren't hot are one piece and inherit nothing, so the plan has the one shuffle of
a plain window, and where no key is hot it is the plain window.

Pieces are cut by the first order column alone, so rows of one key that are equal in it stay together. Null keys are a
key. A count of rows per key, and for hot keys their quantiles, are computed when the plan is built. Pieces are looked up by
numpy in Arrow batches of two numbers a row; filters over arrays of bounds took ten times as long.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.window import WindowSpec

PIECES, LEAST = 4096, 100_000


@dataclass(frozen=True)
class Scan:
    """summary: a piece as one value, given its rows' order. carry: from summaries what a piece inherits, given the key's
    window over pieces. finish: the result from what is inherited (null for the first piece, and for a key that isn't hot)
    and the window over the piece's rows in order. backward: that window goes from the last row to the first."""

    summary: Callable[[Column], Column]
    carry: Callable[[Column, WindowSpec], Column]
    finish: Callable[[Column, WindowSpec], Column]
    backward: bool = False


def _before(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, -1)


def _after(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(1, Window.unboundedFollowing)


def _or_zero(c: Column) -> Column:
    return F.coalesce(c, F.lit(0))


def running(value: Column, including: bool = True) -> Scan:
    """The sum over the key's rows up to this one, or before it."""
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0 if including else -1)
    return Scan(lambda _: F.sum(value), lambda s, w: F.sum(s).over(_before(w)), lambda c, w: _or_zero(c) + _or_zero(F.sum(value).over(frame(w))))


def row_number() -> Scan:
    return Scan(lambda _: F.count("*"), lambda s, w: F.sum(s).over(_before(w)), lambda c, w: _or_zero(c) + F.row_number().over(w))


def rank() -> Scan:
    return Scan(lambda _: F.count("*"), lambda s, w: F.sum(s).over(_before(w)), lambda c, w: _or_zero(c) + F.rank().over(w))


def dense_rank() -> Scan:
    return Scan(F.count_distinct, lambda s, w: F.sum(s).over(_before(w)), lambda c, w: _or_zero(c) + F.dense_rank().over(w))


def lag(value: Column) -> Scan:
    return Scan(lambda o: F.max_by(F.struct(value.alias("v")), o), lambda s, w: F.lag(s).over(w), lambda c, w: F.when(F.row_number().over(w) == 1, c["v"]).otherwise(F.lag(value).over(w)))


def lead(value: Column) -> Scan:
    def finish(c: Column, w: WindowSpec) -> Column:
        return F.coalesce(F.lead(F.struct(value.alias("v"))).over(w), c)["v"]

    return Scan(lambda o: F.min_by(F.struct(value.alias("v")), o), lambda s, w: F.lead(s).over(w), finish)


def last_known(value: Column) -> Scan:
    """The last value up to this row that isn't null."""
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return Scan(
        lambda o: F.max_by(value, F.when(value.isNotNull(), o)),
        lambda s, w: F.last(s, ignorenulls=True).over(_before(w)),
        lambda c, w: F.coalesce(F.last(value, ignorenulls=True).over(frame(w)), c),
    )


def next_known(value: Column) -> Scan:
    """The first value from this row on that isn't null. Rows are walked from the last, as a frame that shrinks from its front
    would be read anew for each row."""
    frame = lambda w: w.rowsBetween(Window.unboundedPreceding, 0)
    return Scan(
        lambda o: F.min_by(value, F.when(value.isNotNull(), o)),
        lambda s, w: F.first(s, ignorenulls=True).over(_after(w)),
        lambda c, w: F.coalesce(F.last(value, ignorenulls=True).over(frame(w)), c),
        backward=True,
    )


def whole(value: Column) -> Scan:
    """The sum over all of the key's rows."""
    everything = lambda w: w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return Scan(lambda _: F.sum(value), lambda s, w: F.sum(s).over(everything(w)), lambda c, w: F.coalesce(c, F.sum(value).over(everything(w))))


def _position(df: DataFrame, name: str) -> Column:
    """A double that rises with the column, so that equal values and, at worst, close ones get the same."""
    c, kind = F.col(name), df.schema[name].dataType.typeName()
    if kind == "string":
        return F.conv(F.rpad(F.hex(F.substring(F.encode(c, "utf-8"), 1, 6)), 12, "0"), 16, 10).cast("double")
    if kind.startswith("timestamp"):
        return F.unix_micros(c.cast("timestamp")).cast("double")
    if kind == "date":
        return F.unix_date(c).cast("double")
    if kind == "boolean":
        return c.cast("int").cast("double")
    if kind in ("array", "struct", "map", "binary", "variant"):
        raise ValueError(f"{name}: rows of a hot key can't be cut by a column of type {kind}")
    return c.cast("double")


class Order:
    """Order columns by name, each ascending, or descending with a minus before it. As in Spark, null is the least value."""

    def __init__(self, df: DataFrame, names: list[str]) -> None:
        self.names, down = [n.removeprefix("-") for n in names], [n.startswith("-") for n in names]
        self.columns = [F.desc(n) if d else F.asc(n) for n, d in zip(self.names, down, strict=True)]
        self.reverse = [F.asc(n) if d else F.desc(n) for n, d in zip(self.names, down, strict=True)]
        if any(df.schema[n].dataType.typeName() in ("string", "binary", "boolean") for n, d in zip(self.names, down, strict=True) if d):
            raise ValueError("only numbers and times can be in descending order")
        place, first = _position(df, self.names[0]), F.lit(float("-inf"))
        if down[0]:
            place = F.when(F.isnan(place), first).otherwise(-place)
            first = F.lit(float("inf"))
        self.place = F.coalesce(place, first)
        falling = lambda n: (F.col(n).isNull(), -_position(df, n), F.isnan(_position(df, n)))
        parts = [c for n, d in zip(self.names, down, strict=True) for c in (falling(n) if d else (F.col(n),))]
        self.key = F.struct(*[c.alias(f"o{i}") for i, c in enumerate(parts)])


def _cuts(df: DataFrame, keys: list[str], order: Order, least: int, pieces: int) -> list[tuple]:
    """(keys…, bounds) of the hot keys: fewer than `pieces` keys and 3 * `pieces` bounds."""
    counts = df.groupBy(*[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)]).agg(F.count("*").alias("_n"))
    total, most = counts.agg(F.sum("_n"), F.max("_n")).first()
    if not total or most <= max(least, total / pieces):
        return []
    hot = counts.where(F.col("_n") > max(least, total / pieces))
    grid = min(pieces, -(-most * pieces // total))
    on = [F.col(k).eqNullSafe(F.col(f"_k{i}")) for i, k in enumerate(keys)]
    rows = df.withColumn("_place", order.place).join(F.broadcast(hot), on).groupBy(*[f"_k{i}" for i in range(len(keys))])
    at = rows.agg(F.percentile_approx("_place", [i / grid for i in range(grid)], 20 * grid).alias("_at"), F.first("_n").alias("_n"))
    step = F.greatest(F.lit(1), F.floor(F.lit(grid * total / pieces) / F.col("_n")))
    at = at.select(*[f"_k{i}" for i in range(len(keys))], F.array_distinct(F.filter("_at", lambda _, i: i % step == 0)).alias("_at"))
    return [(*r[:-1], r[-1]) for r in at.collect()]


def _piece(bounds: list[list[float]]):
    """The number of a place's piece, by the number of its hot key; -1 where it has none."""
    arrays = [np.array(b) for b in bounds]

    @F.pandas_udf("int")
    def piece(hot: pd.Series, place: pd.Series) -> pd.Series:
        out = np.full(len(hot), -1, np.int32)
        key, at = hot.fillna(-1).to_numpy().astype(np.int64), place.to_numpy(dtype=np.float64, na_value=-np.inf)
        for k in np.unique(key[key >= 0]):
            own = key == k
            out[own] = np.searchsorted(arrays[k], at[own], side="right")
        return pd.Series(out)

    return piece


def scan(df: DataFrame, keys: str | list[str], order: str | list[str], outs: dict[str, Scan], least: int = LEAST, pieces: int = PIECES) -> DataFrame:
    """df with a column for each of outs, computed over the key's rows in order. Values of outs read df's columns."""
    keys, order = [keys] if isinstance(keys, str) else keys, Order(df, [order] if isinstance(order, str) else order)
    cuts = _cuts(df, keys, order, least, pieces)
    if not cuts:
        w = [Window.partitionBy(*keys).orderBy(*c) for c in (order.columns, order.reverse)]
        return df.withColumns({name: s.finish(_nothing(s, df, order), w[s.backward]) for name, s in outs.items()})
    names = [f"_k{i}" for i in range(len(keys))]
    schema = ", ".join(f"{n} {df.schema[k].dataType.simpleString()}" for n, k in zip(names, keys, strict=True)) + ", _hot int"
    on = [F.col(k).eqNullSafe(F.col(n)) for k, n in zip(keys, names, strict=True)]
    hot = df.sparkSession.createDataFrame([(*c[:-1], i) for i, c in enumerate(cuts)], schema)
    piece = _piece([c[-1] for c in cuts])("_hot", "_place").alias("_piece")
    rows = df.withColumn("_place", order.place).join(F.broadcast(hot), on, "left").drop(*names)
    summary = rows.where("_hot IS NOT NULL").select(*df.columns, piece).groupBy(*[F.col(k).alias(n) for k, n in zip(keys, names, strict=True)], F.col("_piece").alias("_p"))
    rows = rows.select(*df.columns, piece)
    summary = summary.agg(*[s.summary(order.key).alias(f"_s{i}") for i, s in enumerate(outs.values())])
    by_piece = Window.partitionBy(*names).orderBy("_p")
    carried = summary.select(*names, "_p", *[s.carry(F.col(f"_s{i}"), by_piece).alias(f"_c{i}") for i, s in enumerate(outs.values())])
    rows = rows.join(F.broadcast(carried), [*on, F.col("_piece") == F.col("_p")], "left")
    w = [Window.partitionBy(*keys, "_piece").orderBy(*c) for c in (order.columns, order.reverse)]
    rows = rows.withColumns({name: s.finish(F.col(f"_c{i}"), w[s.backward]) for i, (name, s) in enumerate(outs.items())})
    return rows.select(*[c for c in df.columns if c not in outs], *outs)


def _nothing(s: Scan, df: DataFrame, order: Order) -> Column:
    """A null of the type that s inherits."""
    kind = df.limit(0).groupBy().agg(s.summary(order.key).alias("s")).select(s.carry(F.col("s"), Window.partitionBy(F.lit(0)).orderBy(F.lit(0))).alias("c"))
    return F.lit(None).cast(kind.schema["c"].dataType)
