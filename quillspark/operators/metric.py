"""Exact nearest neighbours by a metric index: pivots, cells sorted by distance, pruning by the triangle inequality.

Equal vectors are one row with the n least of their ids, among the base and among the queries, so copies cost nothing. Each
distinct vector belongs to the cell of its nearest pivot and keeps its distance to it. A cell's rows, in the order of that
distance, are cut into shells of about SHELL rows; a shell's least and greatest distance are all that is known of it
without reading it. A query first meets the shell its own distance falls in, in the cell of its nearest pivot: the n-th
best there bounds how far its neighbours can be. Then it meets the shells that the bound leaves:

* |d(query, pivot) - d(row, pivot)| <= d(query, row), so shells and rows beyond the bound around d(query, pivot) are out;
* a row is nearer to its own pivot than to the query's, so a cell is out if half the difference of the query's distances to
  the two pivots is above the bound.

Pivots are sampled by hash; which they are changes the work, not the result. They and the cells' summaries are bounded by
their number. Shells are rows of a table, joined by cell. Distances to pivots are computed with numpy in Arrow batches.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.plans.scan import row_number, scan, whole
from quillspark.plans.shared import table

SHELL, MOST_PIVOTS = 256, 1024
#: So many queries at most are broadcast as a matrix; a task compares it with so many rows at a time.
MOST_QUERIES, BLOCK = 32_768, 1024
#: Distances to pivots are rounded differently from those between rows; bounds are this much wider.
SLACK = 1e-9


def squared_distance(a: Column, b: Column) -> Column:
    d = F.zip_with(a, b, lambda x, y: (x.cast("double") - y.cast("double")) * (x.cast("double") - y.cast("double")))
    return F.aggregate(d, F.lit(0.0), lambda acc, x: acc + x)


def _distinct(rows: DataFrame, id_col: str, vec_col: str, n: int) -> DataFrame:
    """(vec, ids): distinct vectors with the n least ids of each. A task keeps n ids of a vector before the shuffle."""
    first = Window.partitionBy("vec").orderBy("id")
    rows = rows.select(F.col(id_col).alias("id"), F.col(vec_col).alias("vec")).where("vec IS NOT NULL")
    rows = rows.withColumn("_rn", F.row_number().over(first)).where(F.col("_rn") <= n)
    return rows.groupBy("vec").agg(F.sort_array(F.collect_list("id")).alias("ids"))


def _pivot_distances(pivots: np.ndarray):
    @F.pandas_udf("array<double>")
    def distances(vectors: pd.Series) -> pd.Series:
        rows = np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.empty((0, pivots.shape[1]))
        return pd.Series(list(np.stack([np.sqrt(((rows - p) ** 2).sum(axis=1)) for p in pivots], axis=1)))

    return distances


def _nearest_pivot(pivots: np.ndarray):
    @F.pandas_udf("cell int, at double")
    def cell(vectors: pd.Series) -> pd.DataFrame:
        rows = np.stack(vectors.to_list()).astype(np.float64) if len(vectors) else np.empty((0, pivots.shape[1]))
        best, own = np.full(len(rows), np.inf), np.zeros(len(rows), np.int32)
        for k, p in enumerate(pivots):
            d = np.sqrt(((rows - p) ** 2).sum(axis=1))
            near = d < best
            best[near], own[near] = d[near], k
        return pd.DataFrame({"cell": own, "at": best})

    return cell


class Index:
    """A base of vectors in cells and shells. Rows without a vector are in none; all others have one length."""

    def __init__(self, base: DataFrame, id_col: str, vec_col: str, n: int, pivots: int, shell: int = SHELL) -> None:
        self.n = n
        rows = table(_distinct(base, id_col, vec_col, n), "vectors")
        found = rows.select("vec").orderBy(F.xxhash64("vec"), "vec").limit(min(pivots, MOST_PIVOTS)).collect()
        self.pivots = np.array([r.vec for r in found], dtype=np.float64)
        if not found:
            self.rows = self.cells = self.shells = None
            return
        placed = rows.withColumn("_c", _nearest_pivot(self.pivots)("vec")).select("vec", "ids", "_c.cell", "_c.at")
        self.rows = table(_in_shells(table(placed, "placed"), shell), "index")
        self.shells = table(self.rows.groupBy("cell", "shell").agg(F.min("at").alias("low"), F.max("at").alias("high"), F.sum(F.size("ids")).alias("n")), "shells")
        self.cells = self.shells.groupBy("cell").agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"))

    def candidates(self, queries: DataFrame, id_col: str, vec_col: str) -> DataFrame:
        """(query vector q, ids, _d: squared distance) of all rows that the bounds leave, among them the n nearest."""
        distinct = queries.select(F.col(vec_col).alias("q")).where("q IS NOT NULL").distinct()
        known = {r.cell: (r.low, r.high, r.n) for r in self.cells.collect()}  # a row per pivot at most
        cells = F.array(*[F.struct(F.lit(c).alias("cell"), F.lit(low).alias("low"), F.lit(high).alias("high")) for c, (low, high, _) in sorted(known.items())])
        full = [c for c, (_, _, n) in known.items() if n >= self.n] or list(known)
        q = table(distinct.withColumn("_d", _pivot_distances(self.pivots)("q")), "queries")
        at = lambda c: F.get(F.col("_d"), c)
        home = F.array_min(F.transform(F.array(*map(F.lit, full)), lambda c: F.struct(at(c).alias("d"), c.alias("cell"))))
        q = q.withColumns({"home": home, "nearest": F.array_min("_d")})
        # the shell whose distances are nearest to the query's
        mine = q.select("q", F.col("home.cell").alias("cell"), F.col("home.d").alias("d")).join(self.shells, "cell")
        off = F.greatest(F.col("low") - F.col("d"), F.col("d") - F.col("high"), F.lit(0.0))
        mine = mine.where(F.col("n") >= self.n).groupBy("q").agg(F.min_by(F.struct("cell", "shell"), F.struct(off, "shell")).alias("s")).select("q", "s.cell", "s.shell")
        met = mine.join(self.rows, ["cell", "shell"]).select("q", "ids", squared_distance(F.col("q"), F.col("vec")).alias("_d"))
        # a row's vector stands for as many neighbours as it has ids
        upto = Window.partitionBy("q").orderBy("_d").rowsBetween(Window.unboundedPreceding, 0)
        met = met.withColumn("_n", F.sum(F.size("ids")).over(upto)).where(F.col("_n") >= self.n)
        bound = table(met.groupBy("q").agg(F.sqrt(F.min("_d")).alias("bound")), "bounds")
        q = q.join(bound, "q", "left").withColumn("bound", F.coalesce(F.col("bound") * (1 + SLACK) + SLACK, F.lit(math.inf)))
        left = F.filter(cells, lambda c: (at(c["cell"]) - F.col("bound") <= c["high"]) & (at(c["cell"]) + F.col("bound") >= c["low"]) & ((at(c["cell"]) - F.col("nearest")) / 2 <= F.col("bound")))
        visits = q.select("q", "bound", F.explode(F.transform(left, lambda c: F.struct(c["cell"].alias("cell"), at(c["cell"]).alias("d")))).alias("v")).select("q", "bound", "v.*")
        near = visits.join(self.shells.select("cell", "shell", "low", "high"), "cell").where((F.col("low") <= F.col("d") + F.col("bound")) & (F.col("high") >= F.col("d") - F.col("bound")))
        pairs = near.select("q", "bound", "d", "cell", "shell").join(self.rows, ["cell", "shell"]).where(F.abs(F.col("d") - F.col("at")) <= F.col("bound"))
        return pairs.select("q", "ids", squared_distance(F.col("q"), F.col("vec")).alias("_d"))


def _in_shells(placed: DataFrame, size: int) -> DataFrame:
    """placed with shell: rows of a cell in the order of their distance, so many to a shell; the last may have up to twice as many."""
    rows = scan(placed, "cell", ["at", "vec"], {"_rn": row_number(), "_all": whole(F.lit(1))})
    last = F.greatest(F.floor(F.col("_all") / size) - 1, F.lit(0))
    return rows.withColumn("shell", F.least(F.floor((F.col("_rn") - 1) / size), last)).drop("_rn", "_all")


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Squared distances of rows, summed in the order of squared_distance()."""
    out = np.zeros(len(a))
    for k in range(a.shape[1]):
        out += (a[:, k] - b[:, k]) ** 2
    return out


def _meet(queries: pa.Array, asked: np.ndarray, n: int):
    """The n nearest of a task's rows (vec, ids) to each of the asked vectors, as (query, _d, ids).

    Products of matrices give each distance within a known error, and what that leaves among the n nearest so far is computed
    anew. A task holds n rows a query and the distances of a block of rows and one of queries."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slack = np.finfo(np.float64).eps * (4 * asked.shape[1] + 16)
        norms, bound = (asked**2).sum(axis=1) * (1 - slack), np.full(len(asked), np.inf)
        held_q, held_d, held_id, held = np.empty(0, np.int64), np.empty(0), None, []
        for batch in batches:
            for start in range(0, batch.num_rows, BLOCK):
                part = batch.slice(start, BLOCK)
                ids = part["ids"].to_pylist()
                rows, first = np.stack(part["vec"].to_numpy(zero_copy_only=False)).astype(np.float64), np.array([x[0] for x in ids])
                sizes = (rows**2).sum(axis=1) * (1 - slack)
                found = [(held_q, held_d, np.arange(len(held)))]
                for at in range(0, len(asked), BLOCK):
                    q = slice(at, at + BLOCK)
                    low = norms[q, None] + sizes[None, :] - 2 * (asked[q] @ rows.T)
                    if len(rows) >= n and np.isinf(bound[q]).any():
                        high = low + 2 * slack / (1 - slack) * (norms[q, None] + sizes[None, :])
                        bound[q] = np.fmin(bound[q], np.partition(high, n - 1, axis=1)[:, n - 1])
                    i, j = np.nonzero(~(low > bound[q, None]))
                    found.append((i + at, _squares(rows[j], asked[i + at]), j + len(held)))
                query, d, place = (np.concatenate([f[k] for f in found]) for k in range(3))
                held, firsts = [*held, *ids], first if held_id is None else np.concatenate([held_id, first])
                order = np.lexsort((firsts[place], d, query))
                query, d, place = query[order], d[order], place[order]
                rank = np.arange(len(query)) - np.searchsorted(query, query)
                last = rank == n - 1
                bound[query[last]] = np.fmin(bound[query[last]], d[last])
                keep = rank < n
                held_q, held_d, place = query[keep], d[keep], place[keep]
                held, held_id = [held[p] for p in place], firsts[place]
        if held:
            yield pa.RecordBatch.from_arrays([queries.take(pa.array(held_q)), pa.array(held_d), pa.array(held, batch.schema.field("ids").type)], ["query", "_d", "ids"])

    return run


def nearest(base: DataFrame, queries: DataFrame, n: int, id_col: str = "vec_id", vec_col: str = "embedding", most: int = MOST_QUERIES) -> DataFrame:
    """(query, id, distance, rank): the n nearest rows of each query, ties by id.

    Queries are counted. Up to `most` of them are broadcast and meet the whole base by products of matrices; more go through an
    index. Both give the same rows. Null vectors have and are no neighbours.
    """
    asked = queries.select(F.col(id_col).alias("query"), F.col(vec_col).alias("q")).where("q IS NOT NULL")
    count = asked.count()
    best = Window.partitionBy("query").orderBy("_d", "id")
    if not count:
        return asked.select("query", F.col("query").alias("id"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank"))
    if count <= most:
        known = asked.toArrow().combine_chunks()
        vectors = np.stack(known["q"].to_numpy()).astype(np.float64)
        rows = _distinct(base, id_col, vec_col, n)
        kinds = {c: df.schema[c].dataType.simpleString() for c, df in (("query", asked), ("ids", rows))}
        pairs = rows.mapInArrow(_meet(known["query"].combine_chunks(), vectors, n), f"query {kinds['query']}, _d double, ids {kinds['ids']}")
        pairs = pairs.select("query", "_d", F.explode("ids").alias("id"))
    else:
        index = Index(base, id_col, vec_col, n, max(8, 2 * math.isqrt(count)))
        if index.rows is None:
            return asked.limit(0).select("query", F.col("query").alias("id"), F.lit(0.0).alias("distance"), F.lit(0).cast("long").alias("rank"))
        one = Window.partitionBy("q").orderBy("_d", "id")
        found = index.candidates(queries, id_col, vec_col).select("q", "_d", F.explode("ids").alias("id"))
        found = found.withColumn("_rank", F.row_number().over(one)).where(F.col("_rank") <= n)
        pairs = asked.join(found, "q").select("query", "id", "_d")
    ranked = pairs.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= n)
    return ranked.select("query", "id", F.sqrt("_d").alias("distance"), F.col("rank").cast("long").alias("rank"))
