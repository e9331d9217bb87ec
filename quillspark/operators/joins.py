"""Joins: lookups, enrichment, fan-out, substring and interval matches, as-of, and nearest neighbours.

Plain equi joins carry no hint: Spark broadcasts a side of known small size and sorts or splits the others. Only tables
whose size the code counts first, or bounds itself, are broadcast by hand.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.operators.metric import nearest
from quillspark.operators.stores import newest_per_key
from quillspark.plans import prefix
from quillspark.plans.scan import last_known, next_known, scan


def lookup(df: DataFrame, table: DataFrame, on: str, value: str, default: str) -> DataFrame:
    """df with value looked up by on; default where the table has no row or no value. Keys of the table are unique."""
    return df.join(table.select(on, value), on, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def enrich(df: DataFrame, key: Column, table: DataFrame, table_key: Column, out: str) -> DataFrame:
    """df with the struct column out: the table's row of the same trimmed, lower-cased key, else null."""
    norm = lambda c: F.lower(F.trim(c))
    right = table.select(norm(table_key).alias("_right"), F.struct(*table.columns).alias(out))
    return df.withColumn("_left", norm(key)).join(right, F.col("_left") == F.col("_right"), "left").drop("_left", "_right")


def _cuts(text: Column, n: int) -> Column:
    places = F.when(F.length(text) >= n, F.sequence(F.lit(1), F.length(text) - (n - 1))).otherwise(F.array().cast("array<int>"))
    return F.transform(places, lambda i: F.substr(text, i, F.lit(n)))


def _runs(text: Column) -> Column:
    """Distinct runs of one to three characters."""
    return F.array_distinct(F.concat(*[_cuts(text, n) for n in (1, 2, 3)]))


def _anchor(text: Column) -> Column:
    least = F.array_min(F.transform(_cuts(text, 3), lambda x: F.struct(F.xxhash64(x).alias("hash"), x.alias("run"))))
    return F.when(F.length(text) < 3, text).otherwise(least["run"])


def substring_match(names: DataFrame, name: str, known: DataFrame, known_name: str, value: str, default: str) -> DataFrame:
    """(name, value, confidence) per distinct name: an exact match, else the first known name (by its ord column) that
    contains the name or is in it, else default. Blank names match nothing.

    Only distinct names are compared, and only those that share a key: the shorter text's three characters of least hash
    (or all of it, if it has fewer) are among the longer one's runs of up to three characters.
    """
    left = names.select(F.lower(F.trim(F.col(name))).alias("_name")).where("_name <> ''").distinct()
    right = known.select(F.lower(known_name).alias("_known"), F.col(value).alias("_value"), "ord").where("_known <> ''")
    inside = left.withColumn("_key", F.explode(_runs(F.col("_name")))).join(right.withColumn("_key", _anchor(F.col("_known"))), "_key").where(F.col("_name").contains(F.col("_known")))
    around = left.withColumn("_key", _anchor(F.col("_name"))).join(right.withColumn("_key", F.explode(_runs(F.col("_known")))), "_key").where(F.col("_known").contains(F.col("_name")))
    best = inside.unionByName(around).groupBy("_name").agg(F.min(F.struct((F.col("_name") != F.col("_known")).alias("partial"), "ord", "_value")).alias("_best"))
    out = left.join(best, "_name", "left")
    confidence = F.when(F.col("_best").isNull(), "low").when(F.col("_best.partial"), "medium").otherwise("high")
    return out.select(F.col("_name").alias(name), F.coalesce("_best._value", F.lit(default)).alias(value), confidence.alias("confidence"))


def pair_requests(requests: DataFrame, responses: DataFrame, key: str, at: str, seconds: int, row_id: str = "event_id") -> DataFrame:
    """(request id, response id): the first response of the same key within the time; null if there is none.

    Both sides are put in one order and each request looks forward to the next response, so the work is that of one sort
    however many requests and responses a key has within the time. A response can answer several requests."""
    side = lambda df, n: df.select(key, at, F.col(row_id).alias("_id"), F.lit(n).alias("_side"))
    both = side(requests, 0).union(side(responses.where(F.col(key).isNotNull()), 1))
    response = F.when(F.col("_side") == 1, F.struct(F.col(at).alias("at"), F.col("_id").alias("id")))
    rows = scan(both, key, [at, "_side", "_id"], {"_next": next_known(response)}).where("_side = 0")
    in_time = F.col("_next.at") <= F.expr(f"`{at}` + INTERVAL {seconds} SECONDS")
    return rows.select(F.col("_id").alias("request_id"), F.when(in_time, F.col("_next.id")).alias("response_id"))


def as_of(left: DataFrame, right: DataFrame, key: str, at: str, value: str) -> DataFrame:
    """left with value: that of right's last row of the same key at or before the time. One shuffle, no join.

    Among right's rows of one time the one of greatest value counts.
    """
    both = left.withColumns({"_side": F.lit(1), "_value": F.lit(None).cast(right.schema[value].dataType)}).unionByName(
        right.select(key, at, F.col(value).alias("_value")).withColumn("_side", F.lit(0)), allowMissingColumns=True
    )
    return scan(both, key, [at, "_side", "_value"], {value: last_known(F.col("_value"))}).where("_side = 1").drop("_side", "_value")


def within_days(df: DataFrame, key: str, row_id: str, at: str, days: int) -> DataFrame:
    """Pairs (a, b) of rows of one key, b later than a by at most so many days.

    Rows meet in day bins of that width: a row meets those of its own bin and of the next, not its key's whole history.
    """
    day = F.datediff(F.col(at), F.lit("1970-01-01"))
    rows = df.select(key, F.col(row_id).alias("_id"), day.alias("_day"), F.floor(day / days).alias("_bin"))
    a = rows.select(key, F.col("_id").alias("a"), F.col("_day").alias("_from"), F.explode(F.array("_bin", F.col("_bin") + 1)).alias("_bin"))
    b = rows.select(key, F.col("_id").alias("b"), F.col("_day").alias("_to"), "_bin")
    return a.join(b, [key, "_bin"]).where((F.col("_to") > F.col("_from")) & (F.col("_to") <= F.col("_from") + days)).select(key, "a", "b")


def zip_rows(left: DataFrame, left_order: str, right: DataFrame, right_order: str) -> DataFrame:
    """Rows of the same place in both orders, side by side; what one side has more of is dropped."""
    a, b = prefix.row_number(left, left_order, "_place"), prefix.row_number(right, right_order, "_place")
    return a.join(b, "_place").drop("_place")


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


#: Stands for a declared list of known names, in order.
KNOWN = [("widget", "product"), ("red", "service"), ("steel bolt", "hybrid"), ("large", "startup"), ("x", "consulting")]


def known_names(spark) -> DataFrame:
    return spark.createDataFrame([(k, v, i) for i, (k, v) in enumerate(KNOWN)], "known string, type string, ord int")


def _classified(s, d):
    return substring_match(_read(s, d, "part"), "p_name", known_names(s), "known", "type", "unknown")


def _agents(s, d):
    return _read(s, d, "nation").select(F.col("n_nationkey").alias("agent"))


def _newest_line(s, d) -> DataFrame:
    """An order's line of the greatest number that has a status. Numbers repeat: the line that comes first in the files counts."""
    lines = _read(s, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_linestatus", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    lines = lines.where("l_linenumber IS NOT NULL AND l_linestatus IS NOT NULL")
    return newest_per_key(lines, ["o_orderkey"], ["l_linenumber"], ties=("_file", "_row")).select("o_orderkey", "l_linestatus")


QUERIES = {
    "j01_lookup": lambda s, d: lookup(_read(s, d, "supplier").withColumnRenamed("s_nationkey", "n_nationkey"), _read(s, d, "nation").where("n_regionkey < 3"), "n_nationkey", "n_name", "unknown").select("s_suppkey", "n_name"),
    "j02_enrich": lambda s, d: enrich(_read(s, d, "part"), F.concat(F.lit(" "), F.upper("p_type")), _read(s, d, "part").groupBy("p_type").agg(F.count("*").alias("parts"), F.max("p_size").alias("most")), F.col("p_type"), "info").select("p_partkey", "info.parts", "info.most"),
    "j04_substring_match": _classified,
    "j05_cascade": lambda s, d: _read(s, d, "part").join(_classified(s, d).withColumnRenamed("p_name", "_n"), F.lower(F.trim(F.col("p_name"))) == F.col("_n"), "left").groupBy(F.coalesce("type", F.lit("unknown")).alias("type"), "confidence").agg(F.count("*").alias("n")),
    "j06_request_response": lambda s, d: pair_requests(_read(s, d, "events").where("event_type = 'signup'"), _read(s, d, "events").where("event_type = 'purchase'"), "user_id", "ts", 3600 * 24),
    "j07_delegation_result": lambda s, d: _read(s, d, "orders").join(_newest_line(s, d), "o_orderkey", "left").select("o_orderkey", "o_orderstatus", F.coalesce("l_linestatus", F.lit("none")).alias("result")),
    "j09_fan_out": lambda s, d: _agents(s, d).alias("a").join(_read(s, d, "region").alias("m"), F.col("a.agent") != F.col("m.r_regionkey")).select("agent", "r_regionkey"),
    "j10_zip": lambda s, d: _read(s, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m")).select("conv_id", F.posexplode(F.arrays_zip(F.col("m.turn").alias("turn"), F.col("m.role").alias("role"))).alias("pos", "z")).select("conv_id", F.col("pos").cast("long").alias("pos"), "z.turn", "z.role"),
    "j11_positional_join": lambda s, d: zip_rows(_read(s, d, "labels").select("doc_id", "quality"), "doc_id", _read(s, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("at"), "conv_id", "turn", "role"), "at").select("doc_id", "quality", "conv_id", "turn", "role"),
    "j12_disjoint_split": lambda s, d: _read(s, d, "orders").join(_read(s, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_anti").select("o_orderkey"),
    "j12_held_out": lambda s, d: _read(s, d, "orders").join(_read(s, d, "customer").where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("o_custkey")), "o_custkey", "left_semi").select("o_orderkey"),
    "j13_nearest": lambda s, d: nearest(_read(s, d, "embeddings"), _read(s, d, "embeddings").where("vec_id % 100 = 0"), 5).withColumn("distance", F.round("distance", 5)),
    "j14_as_of": lambda s, d: as_of(_read(s, d, "events").where("event_type = 'purchase'").select("event_id", "user_id", "ts"), _read(s, d, "events").where("event_type = 'signup'"), "user_id", "ts", "value").select("event_id", "value"),
    "i06_within_days": lambda s, d: within_days(_read(s, d, "orders"), "o_custkey", "o_orderkey", "o_orderdate", 30),
}

_KNOWN = ", ".join(f"('{k}', '{v}', {i})" for i, (k, v) in enumerate(KNOWN))
_MATCH = f"""(WITH k(known, type, ord) AS (VALUES {_KNOWN}), n AS (SELECT DISTINCT lower(trim(p_name)) AS p_name FROM part)
  SELECT p_name, coalesce(type, 'unknown') AS type, CASE WHEN type IS NULL THEN 'low' WHEN partial THEN 'medium' ELSE 'high' END AS confidence FROM (
    SELECT p_name, type, p_name <> known AS partial, row_number() OVER (PARTITION BY p_name ORDER BY p_name <> known, ord) AS rn FROM n LEFT JOIN k ON contains(p_name, known) OR contains(known, p_name)) WHERE rn = 1)"""

SQL = {
    "j01_lookup": "SELECT s_suppkey, coalesce(n_name, 'unknown') AS n_name FROM supplier LEFT JOIN (SELECT * FROM nation WHERE n_regionkey < 3) ON s_nationkey = n_nationkey",
    "j02_enrich": "SELECT p_partkey, parts, most FROM part JOIN (SELECT p_type, count(*) AS parts, max(p_size) AS most FROM part GROUP BY p_type) USING (p_type)",
    "j04_substring_match": f"SELECT * FROM {_MATCH}",
    "j05_cascade": f"SELECT coalesce(m.type, 'unknown') AS type, m.confidence, count(*) AS n FROM part LEFT JOIN {_MATCH} m ON lower(trim(part.p_name)) = m.p_name GROUP BY ALL",
    "j06_request_response": """SELECT r.event_id AS request_id, arg_min(a.event_id, (a.ts, a.event_id)) AS response_id FROM events r LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') a
      ON a.user_id = r.user_id AND a.ts BETWEEN r.ts AND r.ts + INTERVAL 1 DAY WHERE r.event_type = 'signup' GROUP BY r.event_id""",
    "j07_delegation_result": "SELECT o_orderkey, o_orderstatus, coalesce(l_linestatus, 'none') AS result FROM orders LEFT JOIN (SELECT l_orderkey, arg_max(l_linestatus, l_linenumber) AS l_linestatus FROM lineitem GROUP BY l_orderkey) ON o_orderkey = l_orderkey",
    "j09_fan_out": "SELECT n_nationkey AS agent, r_regionkey FROM nation, region WHERE n_nationkey <> r_regionkey",
    "j10_zip": "SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS pos, turn, role FROM conversations",
    "j11_positional_join": "SELECT doc_id, quality, conv_id, turn, role FROM (SELECT doc_id, quality, row_number() OVER (ORDER BY doc_id) AS n FROM labels) JOIN (SELECT conv_id, turn, role, row_number() OVER (ORDER BY conv_id, turn) AS n FROM conversations) USING (n)",
    "j12_disjoint_split": "SELECT o_orderkey FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)",
    "j12_held_out": "SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 = 3)",
    "j13_nearest": """SELECT query, id, round(distance, 5) AS distance, rank FROM (SELECT q.vec_id AS query, e.vec_id AS id, sqrt(list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2))) AS distance,
      row_number() OVER (PARTITION BY q.vec_id ORDER BY list_sum(list_transform(list_zip(e.embedding, q.embedding), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)), e.vec_id) AS rank
      FROM embeddings e, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5""",
    "j14_as_of": "SELECT p.event_id, s.value FROM (SELECT * FROM events WHERE event_type = 'purchase') p ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'signup') s ON p.user_id = s.user_id AND p.ts >= s.ts",
    "i06_within_days": """SELECT x.o_custkey, x.o_orderkey AS a, y.o_orderkey AS b FROM orders x JOIN orders y ON x.o_custkey = y.o_custkey
      AND y.o_orderdate::DATE > x.o_orderdate::DATE AND y.o_orderdate::DATE <= x.o_orderdate::DATE + 30""",
}
