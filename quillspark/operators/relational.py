"""Plain SQL coverage: any SELECT over the registered tables, behind a guard that lets only queries pass."""

from __future__ import annotations

import functools
import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.functions.query import Query
from quillspark.plans.closures import descendants, layers
from quillspark.plans.scan import dense_rank, lag, lead, rank, row_number, scan, whole

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()

#: How the names of parsed plans begin that aren't queries.
_CHANGES = ("Command", "Insert", "CreateTable", "CreateNamespace", "CreateView", "CreateFunction", "Drop", "Alter", "Truncate", "Delete", "Update", "Merge", "Set", "Load", "Refresh", "Cache", "Uncache", "Add", "Describe", "Show", "Use", "Reset", "Clear", "Analyze", "Repair", "Comment", "Rename", "Replace")


def register(spark: SparkSession, sf_dir: str, tables: list[str] = TABLES) -> None:
    for name in tables:
        spark.read.parquet(f"{sf_dir}/{name}.parquet").createOrReplaceTempView(name)


def _names(plan) -> Iterator[str]:
    yield plan.getClass().getSimpleName()
    for i in range(plan.children().size()):
        yield from _names(plan.children().apply(i))


def select_only(spark: SparkSession, text: str, most: int | None = None) -> DataFrame:
    """The query's result; anything but a query (parsed, not by its first word) is a ValueError. most: rows at most."""
    plan = spark._jsparkSession.sessionState().sqlParser().parsePlan(text)
    if any(name.startswith(_CHANGES) or name.endswith(("Command", "Statement")) for name in _names(plan)):
        raise ValueError("only queries are allowed")
    out = spark.sql(text)
    return out.limit(most) if most is not None else out


def markdown(rows: DataFrame, most: int = 50) -> str:
    """A pipe table of the first rows."""
    cell = lambda v: "" if v is None else str(v)
    lines = [" | ".join(rows.columns), " | ".join("---" for _ in rows.columns)]
    return "\n".join(lines + [" | ".join(map(cell, r)) for r in rows.limit(most).collect()])


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _revenue():
    return F.round(F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))), 2).alias("revenue")


def _lines(s, d):
    return _read(s, d, "lineitem")


def ranks(df: DataFrame, key: str, order: list[str], parts: int) -> DataFrame:
    """df with rn, rk, dr and nt: row number, rank, dense rank and, of so many parts of the key's rows, the row's."""
    rows = scan(df, key, order, {"rn": row_number(), "rk": rank(), "dr": dense_rank(), "_n": whole(F.lit(1))})
    rn, size, larger = F.col("rn") - 1, F.floor(F.col("_n") / parts), F.col("_n") % parts  # so many parts have one row more
    front = larger * (size + 1)
    nt = F.when(rn < front, F.floor(rn / (size + 1))).otherwise(larger + F.floor((rn - front) / F.greatest(size, F.lit(1)))) + 1
    return rows.withColumns({"nt": nt.cast("long"), **{c: F.col(c).cast("long") for c in ("rn", "rk", "dr")}}).drop("_n")


def mean_of_three(df: DataFrame, key: str, order: str, value: str, out: str = "mean") -> DataFrame:
    """df with out: the mean of the key's row before, this one and the one after, as far as there are any."""
    v = F.col(value)
    rows = scan(df, key, order, {"_before": lag(v), "_after": lead(v)})
    three = F.filter(F.array("_before", value, "_after"), lambda x: x.isNotNull())
    return rows.withColumn(out, F.try_divide(F.aggregate(three, F.lit(0.0), lambda a, x: a + x), F.size(three))).drop("_before", "_after")


def _tree(s, d) -> DataFrame:
    name = lambda mark, key: F.concat(F.lit(mark), F.col(key).cast("string"))
    nations = _read(s, d, "nation").select(name("r", "n_regionkey").alias("parent"), name("n", "n_nationkey").alias("child"))
    customers = _read(s, d, "customer").select(name("n", "c_nationkey").alias("parent"), name("c", "c_custkey").alias("child"))
    return descendants(_read(s, d, "region").select(name("r", "r_regionkey").alias("node")), nations.union(customers))


def _flow(s, d) -> DataFrame:
    """Layers of the rows that others refer to: a line after its order and its supplier, these after nations, and so on."""
    name = lambda mark, *keys: F.concat_ws("-", F.lit(mark), *[F.col(k).cast("string") for k in keys])
    refs = [
        ("nation", name("r", "n_regionkey"), name("n", "n_nationkey")), ("customer", name("n", "c_nationkey"), name("c", "c_custkey")),
        ("supplier", name("n", "s_nationkey"), name("s", "s_suppkey")), ("orders", name("c", "o_custkey"), name("o", "o_orderkey")),
        ("lineitem", name("o", "l_orderkey"), name("l", "l_orderkey", "l_linenumber")), ("lineitem", name("s", "l_suppkey"), name("l", "l_orderkey", "l_linenumber")),
    ]
    edges = functools.reduce(DataFrame.union, [_read(s, d, t).select(a.alias("parent"), b.alias("child")) for t, a, b in refs])
    return layers(_read(s, d, "region").select(name("r", "r_regionkey").alias("node")).union(edges.select("child")), edges)


def _json(text: str) -> dict:
    """A column, or a number, as a tree."""
    return {"literal": {"this": text, "is_string": False}} if text.isdigit() else {"column": {"this": {"identifier": text}}}


#: Suppliers with money by nation, as a tree.
JSON_QUERY = json.dumps({
    "select": {"expressions": [
        _json("n_name"),
        {"alias": {"this": {"count": {"this": {"star": {}}}}, "alias": {"identifier": "n"}}},
        {"alias": {"this": {"max": {"this": {"mul": {"this": _json("s_acctbal"), "expression": _json("2")}}}}, "alias": {"identifier": "most"}}},
    ]},
    "from": {"expressions": [
        {"table": {"this": {"identifier": "supplier"}, "alias": {"identifier": "s"}}},
        {"table": {"this": {"identifier": "nation"}, "on": {"eq": {"this": _json("s_nationkey"), "expression": _json("n_nationkey")}}}},
    ]},
    "where": {"and": {
        "this": {"gt": {"this": _json("s_acctbal"), "expression": _json("100")}},
        "expression": {"not": {"this": {"in": {"this": _json("n_name"), "expressions": [{"literal": {"this": "FRANCE"}}, {"literal": {"this": "NATION_3"}}]}}}},
    }},
    "group": {"expressions": [_json("n_name")]},
})

QUERIES = {
    "i01_equi_join": lambda s, d: _read(s, d, "orders").join(_lines(s, d), F.col("o_orderkey") == F.col("l_orderkey")).groupBy("o_orderpriority").agg(_revenue()),
    "i02_small_side": lambda s, d: _lines(s, d).join(_read(s, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey")).join(_read(s, d, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).groupBy("n_name").agg(_revenue()),
    "i03_outer": lambda s, d: _read(s, d, "customer").join(_read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left").groupBy("c_custkey").agg(F.count("o_orderkey").alias("orders")),
    "i03_full": lambda s, d: _read(s, d, "nation").where("n_nationkey < 15").select(F.col("n_nationkey").alias("k"), "n_name").join(_read(s, d, "supplier").groupBy(F.col("s_nationkey").alias("k")).agg(F.count("*").alias("n")).where("k > 5"), "k", "full"),
    "i04_anti": lambda s, d: _read(s, d, "customer").join(_read(s, d, "orders"), F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey"),
    "i04_semi": lambda s, d: _read(s, d, "customer").join(_read(s, d, "orders").where("o_totalprice > 400000"), F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey"),
    "i05_pairs_in_group": lambda s, d: _read(s, d, "supplier").alias("a").join(_read(s, d, "supplier").alias("b"), (F.col("a.s_nationkey") == F.col("b.s_nationkey")) & (F.col("a.s_suppkey") < F.col("b.s_suppkey"))).select(F.col("a.s_suppkey").alias("a"), F.col("b.s_suppkey").alias("b")),
    "i08_group_having": lambda s, d: _lines(s, d).groupBy("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("sum_qty"), _revenue(), F.count("*").alias("n"), F.count_distinct("l_suppkey").alias("suppliers")).where("n > 10"),
    "i09_rollup": lambda s, d: _lines(s, d).rollup("l_returnflag", "l_linestatus").agg(_revenue(), F.count("*").alias("n")),
    "i09_cube": lambda s, d: _lines(s, d).cube("l_returnflag", "l_linestatus").agg(F.sum("l_quantity").alias("qty")),
    "i10_ranks": lambda s, d: ranks(_read(s, d, "orders"), "o_custkey", ["-o_totalprice", "o_orderkey"], 3).where("rn <= 3").select("o_orderkey", "rn", "rk", "dr", "nt"),
    "i11_frames": lambda s, d: _read(s, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n")).select("day", "n", F.sum("n").over(Window.partitionBy(F.year("day")).orderBy("day").rowsBetween(-6, 0)).alias("week"), F.lag("n").over(Window.partitionBy(F.year("day")).orderBy("day")).alias("before"), F.first("n").over(Window.partitionBy(F.year("day")).orderBy("day")).alias("first")),
    "i12_union": lambda s, d: _read(s, d, "customer").select(F.col("c_nationkey").alias("k")).union(_read(s, d, "supplier").select("s_nationkey")).distinct(),
    "i12_intersect": lambda s, d: _read(s, d, "customer").select(F.col("c_nationkey").alias("k")).intersect(_read(s, d, "supplier").select("s_nationkey")),
    "i12_except": lambda s, d: _read(s, d, "nation").select(F.col("n_nationkey").alias("k")).exceptAll(_read(s, d, "supplier").where("s_acctbal > 5000").select("s_nationkey").distinct()),
    "i13_correlated": lambda s, d: (register(s, d, ["part"]), s.sql("SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)"))[1],
    "i14_recursive": _tree,
    "i15_page": lambda s, d: _read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").offset(50).limit(50).select("o_orderkey", "o_totalprice"),
    "i16_case": lambda s, d: _read(s, d, "orders").groupBy(F.when(F.col("o_totalprice") < 100000, "low").when(F.col("o_totalprice") < 300000, "mid").otherwise("high").alias("band")).agg(F.count("*").alias("n"), F.count(F.nullif("o_orderstatus", F.lit("O"))).alias("closed")),
    "i17_built_ins": lambda s, d: _read(s, d, "events").groupBy(F.date_trunc("month", "ts").cast("date").alias("month"), F.substring("event_type", 1, 3).alias("kind")).agg(F.sum(F.get_json_object("props", "$.k").cast("long")).alias("k")),
    "i18_approximate": lambda s, d: _read(s, d, "events").groupBy("event_type").agg(F.approx_count_distinct("user_id", 0.02).alias("users"), F.percentile_approx("value", 0.5, 10000).alias("median")),
    "i19_pivot": lambda s, d: _read(s, d, "events").groupBy(F.to_date("ts").alias("day")).pivot("event_type", ["click", "error", "purchase", "signup", "view"]).agg(F.count(F.lit(1))).na.fill(0),
    "i19_unpivot": lambda s, d: _read(s, d, "labels").select("doc_id", F.col("quality").cast("long").alias("quality"), F.col("toxic").cast("long").alias("toxic")).unpivot("doc_id", ["quality", "toxic"], "name", "value"),
    "j08_tree": lambda s, d: _tree(s, d).groupBy("depth").agg(F.count("*").alias("n")),
    "s16_table_scan": lambda s, d: (register(s, d, ["supplier"]), select_only(s, "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0"))[1],
    "s09_catalog": lambda s, d: _read(s, d, {"corpus": "documents", "chat": "conversations"}["corpus"]).groupBy("lang").agg(F.count("*").alias("n")),
    "s21_take": lambda s, d: _read(s, d, "orders").orderBy("o_orderkey").limit(25).select("o_orderkey"),
    "u16_set_union": lambda s, d: _read(s, d, "labels").where("toxic = 1").select("doc_id").union(_read(s, d, "labels").where("quality = 1").select("doc_id")).distinct(),
    "u16_set_difference": lambda s, d: _read(s, d, "documents").select("doc_id").subtract(_read(s, d, "labels").where("quality = 1").select("doc_id")),
    "u16_set_intersection": lambda s, d: _read(s, d, "labels").where("toxic = 1").select("doc_id").intersect(_read(s, d, "documents").where("lang = 'en'").select("doc_id")),
    "w17_frames": lambda s, d: mean_of_three(_read(s, d, "orders"), "o_custkey", "o_orderkey", "o_totalprice").select("o_orderkey", F.round("mean", 4).alias("mean")),
    "y10_json_query": lambda s, d: Query({t: _read(s, d, t) for t in ("supplier", "nation")}, JSON_QUERY).frame().withColumn("most", F.round("most", 2)),
    "p01_layers": lambda s, d: _flow(s, d).groupBy("layer", F.substring("node", 1, 1).alias("kind")).agg(F.count("*").alias("n"), F.min("node").alias("first"), F.max("node").alias("last")),
    "p06_descendants": lambda s, d: _tree(s, d).where("depth = 2 AND node LIKE 'c1%'").select("node"),
}

_REV = "round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue"
_TREE = """(SELECT 'r' || r_regionkey::VARCHAR AS node, 0 AS depth FROM region UNION ALL SELECT 'n' || n_nationkey::VARCHAR, 1 FROM nation JOIN region ON n_regionkey = r_regionkey
  UNION ALL SELECT 'c' || c_custkey::VARCHAR, 2 FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey)"""
_FLOW = """(WITH RECURSIVE e AS (
    SELECT 'r-' || n_regionkey AS parent, 'n-' || n_nationkey AS child FROM nation UNION ALL SELECT 'n-' || c_nationkey, 'c-' || c_custkey FROM customer
    UNION ALL SELECT 'n-' || s_nationkey, 's-' || s_suppkey FROM supplier UNION ALL SELECT 'c-' || o_custkey, 'o-' || o_orderkey FROM orders
    UNION ALL SELECT 'o-' || l_orderkey, 'l-' || l_orderkey || '-' || l_linenumber FROM lineitem UNION ALL SELECT 's-' || l_suppkey, 'l-' || l_orderkey || '-' || l_linenumber FROM lineitem),
  w AS (SELECT 'r-' || r_regionkey AS node, 0 AS layer FROM region UNION SELECT child, layer + 1 FROM w JOIN e ON parent = node)
  SELECT node, max(layer) AS layer FROM w GROUP BY node)"""
SQL = {
    "i01_equi_join": f"SELECT o_orderpriority, {_REV} FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1",
    "i02_small_side": f"SELECT n_name, {_REV} FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey GROUP BY 1",
    "i03_outer": "SELECT c_custkey, count(o_orderkey) AS orders FROM customer LEFT JOIN orders ON c_custkey = o_custkey GROUP BY 1",
    "i03_full": "SELECT coalesce(n_nationkey, k) AS k, n_name, n FROM (SELECT * FROM nation WHERE n_nationkey < 15) FULL JOIN (SELECT s_nationkey AS k, count(*) AS n FROM supplier WHERE s_nationkey > 5 GROUP BY 1) ON n_nationkey = k",
    "i04_anti": "SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey)",
    "i04_semi": "SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 400000)",
    "i05_pairs_in_group": "SELECT a.s_suppkey AS a, b.s_suppkey AS b FROM supplier a JOIN supplier b ON a.s_nationkey = b.s_nationkey AND a.s_suppkey < b.s_suppkey",
    "i08_group_having": f"SELECT l_returnflag, l_linestatus, sum(l_quantity) AS sum_qty, {_REV}, count(*) AS n, count(DISTINCT l_suppkey) AS suppliers FROM lineitem GROUP BY 1, 2 HAVING count(*) > 10",
    "i09_rollup": f"SELECT l_returnflag, l_linestatus, {_REV}, count(*) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)",
    "i09_cube": "SELECT l_returnflag, l_linestatus, sum(l_quantity) AS qty FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "i10_ranks": "SELECT * FROM (SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr, ntile(3) OVER w AS nt FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey)) WHERE rn <= 3",
    "i11_frames": """SELECT day, n, (sum(n) OVER (PARTITION BY year(day) ORDER BY day ROWS BETWEEN 6 PRECEDING AND CURRENT ROW))::BIGINT AS week, lag(n) OVER w AS before, first_value(n) OVER w AS first FROM (
      SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1) WINDOW w AS (PARTITION BY year(day) ORDER BY day)""",
    "i12_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "i12_intersect": "SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier",
    "i12_except": "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000",
    "i13_correlated": "SELECT p_partkey FROM part p WHERE p_retailprice > (SELECT avg(p_retailprice) FROM part q WHERE q.p_brand = p.p_brand)",
    "i14_recursive": f"SELECT * FROM {_TREE}",
    "i15_page": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 50 OFFSET 50",
    "i16_case": "SELECT CASE WHEN o_totalprice < 100000 THEN 'low' WHEN o_totalprice < 300000 THEN 'mid' ELSE 'high' END AS band, count(*) AS n, count(nullif(o_orderstatus, 'O')) AS closed FROM orders GROUP BY 1",
    "i17_built_ins": "SELECT date_trunc('month', ts)::DATE AS month, left(event_type, 3) AS kind, sum((props->>'$.k')::BIGINT)::BIGINT AS k FROM events GROUP BY 1, 2",
    "i19_pivot": "SELECT ts::DATE AS day, " + ", ".join(f"count(*) FILTER (event_type = '{t}') AS {t}" for t in ("click", "error", "purchase", "signup", "view")) + " FROM events GROUP BY 1",
    "i19_unpivot": "SELECT doc_id, 'quality' AS name, quality::BIGINT AS value FROM labels UNION ALL SELECT doc_id, 'toxic', toxic::BIGINT FROM labels",
    "j08_tree": f"SELECT depth, count(*) AS n FROM {_TREE} GROUP BY depth",
    "s16_table_scan": "SELECT s_suppkey, s_name FROM supplier WHERE s_acctbal > 0",
    "s09_catalog": "SELECT lang, count(*) AS n FROM documents GROUP BY lang",
    "s21_take": "SELECT o_orderkey FROM orders ORDER BY o_orderkey LIMIT 25",
    "u16_set_union": "SELECT doc_id FROM labels WHERE toxic = 1 UNION SELECT doc_id FROM labels WHERE quality = 1",
    "u16_set_difference": "SELECT doc_id FROM documents EXCEPT SELECT doc_id FROM labels WHERE quality = 1",
    "u16_set_intersection": "SELECT doc_id FROM labels WHERE toxic = 1 INTERSECT SELECT doc_id FROM documents WHERE lang = 'en'",
    "w17_frames": "SELECT o_orderkey, round(avg(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING), 4) AS mean FROM orders",
    "y10_json_query": "SELECT n_name, count(*) AS n, round(max(s_acctbal * 2), 2) AS most FROM supplier s JOIN nation ON s_nationkey = n_nationkey WHERE s_acctbal > 100 AND n_name NOT IN ('FRANCE', 'NATION_3') GROUP BY n_name",
    "p01_layers": f"SELECT layer, left(node, 1) AS kind, count(*) AS n, min(node) AS first, max(node) AS last FROM {_FLOW} GROUP BY ALL",
    "p06_descendants": f"SELECT node FROM {_TREE} WHERE depth = 2 AND node LIKE 'c1%'",
}
