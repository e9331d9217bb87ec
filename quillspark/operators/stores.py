"""Stores of keyed records: upserts, retention, replay, deduplication and counts.

"Newest" and "first" always follow an order column, with ties broken by the columns given, so results don't depend on
partitioning. Null keys are keys of their own.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T


def newest_per_key(df: DataFrame, keys: list[str], order: list[str], n: int = 1, ties: tuple[str, ...] = ()) -> DataFrame:
    """The n newest rows of each key, of equally new ones those that come first by ties; Spark cuts each task's rows to n
    before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc(c) for c in order], *ties)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= n).drop("_rank")


def first_per_key(df: DataFrame, keys: list[Column], order: list[str]) -> DataFrame:
    """The first row of each key."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") == 1).drop("_rank")


def latest_values(df: DataFrame, keys: list[str], value: str, order: str, tie: str) -> DataFrame:
    """Keys and the value of the newest row, as one aggregation with map-side combine."""
    return df.groupBy(*keys).agg(F.max_by(value, F.struct(order, tie)).alias(value))


def upsert(store: DataFrame, changes: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """store with each key of changes replaced by (or given) its newest change."""
    new = newest_per_key(changes, keys, order)
    return store.join(new, keys, "left_anti").unionByName(new)


def insert_new(store: DataFrame, batch: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Rows of batch, first per key, whose key the store doesn't hold."""
    return first_per_key(batch.join(store.select(*keys), keys, "left_anti"), [F.col(k) for k in keys], order)


def patch(store: DataFrame, changes: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """store with columns replaced where a change has a value that is neither null nor empty."""
    new = changes.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = store.join(new, store[key] == new["_key"], "left")
    return out.withColumns({c: F.coalesce(F.nullif(F.col(f"_new_{c}"), F.lit("")), F.col(c)) for c in columns}).drop("_key", *[f"_new_{c}" for c in columns])


def delete_keys(store: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    return store.join(gone.select(*keys).distinct(), keys, "left_anti")


def replay_after(df: DataFrame, key: str, order: list[str], last: DataFrame) -> DataFrame:
    """Rows of each key after its row of last (key, order columns); keys without one are replayed whole."""
    seen = last.select(F.col(key).alias("_key"), F.struct(*order).alias("_at"))
    return df.join(seen, df[key] == seen["_key"], "left").where(F.col("_at").isNull() | (F.struct(*order) > F.col("_at"))).drop("_key", "_at")


def record_hash(*parts: Column) -> Column:
    """First 16 hex digits of the SHA-256 of the parts, lower-cased, trimmed and joined by bars."""
    return F.substring(F.sha2(F.concat_ws("|", *[F.lower(F.trim(F.coalesce(p, F.lit("")))) for p in parts]), 256), 1, 16)


def channel_summary(df: DataFrame, channel: str, key: str, at: str) -> DataFrame:
    """Per channel: entries, first and last time, and its distinct keys in order."""
    keys = F.array_join(F.array_sort(F.collect_set(F.col(key).cast("string"))), ",")
    return df.groupBy(channel).agg(F.count("*").alias("entries"), F.min(at).alias("first_at"), F.max(at).alias("last_at"), keys.alias("keys"))


def roots_and_children(df: DataFrame, key: str, parent: str) -> DataFrame:
    """(key, is_root, children): whether a row has no parent, and how many rows name it as theirs."""
    named = df.where(F.col(parent).isNotNull()).groupBy(F.col(parent).alias("_parent")).agg(F.count("*").alias("_children"))
    out = df.join(named, F.col(key) == F.col("_parent"), "left")
    return out.select(key, F.col(parent).isNull().alias("is_root"), F.coalesce("_children", F.lit(0)).alias("children"))


def _agents(s, d):
    """The first nation of each region leads the others."""
    first = F.min("n_nationkey").over(Window.partitionBy("n_regionkey"))
    return _read(s, d, "nation").select("n_nationkey", F.nullif(first, F.col("n_nationkey")).alias("parent"))


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _events(s, d):
    return _read(s, d, "events")


def _split_events(s, d):
    e = _events(s, d)
    return e.where("event_id % 3 <> 0"), e.where("event_id % 3 = 0 OR event_id % 7 = 0")


def _upsert(s, d):
    base, changes = _split_events(s, d)
    store = newest_per_key(base, ["user_id", "event_type"], ["event_id"])
    return upsert(store, changes, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


def _patch(s, d):
    c = _read(s, d, "customer")
    return patch(c.select("c_custkey", "c_name", "c_mktsegment"), c.where("c_custkey % 2 = 0").select("c_custkey", F.when(F.col("c_custkey") % 4 == 0, "").otherwise("renamed").alias("c_name"), F.lit(None).cast("string").alias("c_mktsegment")), "c_custkey", ["c_name", "c_mktsegment"])


def _replay(s, d):
    e = _events(s, d)
    last = e.where("event_id % 500 = 0").groupBy("user_id").agg(F.max("event_id").alias("event_id"))
    return replay_after(e, "user_id", ["event_id"], last).select("event_id", "user_id")


def _dedup_new(s, d):
    docs = _read(s, d, "documents").withColumn("h", record_hash(F.col("text"), F.col("source")))
    store = docs.where("doc_id % 10 = 0").select("h").distinct()
    return insert_new(store, docs, ["h"], ["doc_id"]).select("doc_id", "h")


QUERIES = {
    "k09_upsert": _upsert,
    "k10_insert_new": lambda s, d: insert_new(_events(s, d).where("event_id < 500").select("user_id", "props"), _events(s, d).where("event_id >= 500"), ["user_id", "props"], ["event_id"]).select("event_id", "user_id", "props"),
    "k11_patch": _patch,
    "k12_delete": lambda s, d: delete_keys(_events(s, d), _events(s, d).where("event_type = 'error'"), ["user_id", "event_type"]).select("event_id"),
    "k13_retention": lambda s, d: newest_per_key(_events(s, d), ["user_id"], ["ts", "event_id"], 50).select("event_id", "user_id"),
    "k14_keep_newest": lambda s, d: newest_per_key(_read(s, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], 3).select("o_orderkey", "o_custkey"),
    "w04_ring_buffer": lambda s, d: newest_per_key(_events(s, d), ["event_type"], ["ts", "event_id"], 200).select("event_id", "event_type"),
    "w05_replay": _replay,
    "w06_latest_value": lambda s, d: latest_values(_events(s, d), ["event_type", "user_id"], "value", "ts", "event_id"),
    "w07_newest": lambda s, d: _events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(50).select("event_id", "ts"),
    "w08_oldest": lambda s, d: _events(s, d).where("user_id = 8").orderBy("ts", "event_id").limit(20).select("event_id", "ts"),
    "w13_result_cap": lambda s, d: _read(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(30).select("o_orderkey", "o_totalprice"),
    "r06_delivery": lambda s, d: _events(s, d).join(_read(s, d, "customer").where("c_custkey % 3 = 0").select(F.col("c_custkey").alias("user_id"), F.lit(True).alias("registered")), "user_id", "left").select("event_id", F.coalesce("registered", F.lit(False)).alias("delivered")),
    "r15_last_events": lambda s, d: _events(s, d).orderBy(F.desc("ts"), F.desc("event_id")).limit(200).select("event_id"),
    "g01_channel_summary": lambda s, d: channel_summary(_events(s, d), "event_type", "user_id", "ts"),
    "g02_distinct_counts": lambda s, d: _events(s, d).agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"), F.count_distinct("event_type").alias("types")),
    "g03_counts_per_agent": lambda s, d: _events(s, d).groupBy("user_id").agg(F.count("*").alias("n")),
    "g04_message_totals": lambda s, d: _events(s, d).agg(F.count("*").alias("n"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type").isin("view", "click")).alias("reads")),
    "g05_fleet_counts": lambda s, d: _read(s, d, "customer").agg(F.count_if(F.col("c_custkey") % 10 == 0).alias("roots"), F.count_if(F.col("c_custkey") % 10 != 0).alias("subs"), F.count_if(F.col("c_acctbal") > 0).alias("active")),
    "g06_tool_stats": lambda s, d: _events(s, d).groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(F.col("event_type") == "error").alias("errors"), F.round(F.sum("value"), 4).alias("total_ms")),
    "g07_run_totals": lambda s, d: _read(s, d, "lineitem").groupBy("l_suppkey").agg(F.count_distinct("l_orderkey").alias("runs"), F.sum("l_quantity").alias("tokens"), F.count("*").alias("calls")),
    "g32_step_counts": lambda s, d: _read(s, d, "orders").groupBy("o_custkey").agg(F.count_if(F.col("o_orderstatus") == "F").alias("completed"), F.count_if(F.col("o_orderstatus") == "P").alias("failed")),
    "p07_status_tracker": lambda s, d: newest_per_key(_read(s, d, "orders"), ["o_custkey", "o_orderstatus"], ["o_orderdate", "o_orderkey"]).groupBy("o_orderstatus").agg(F.count("*").alias("n"), F.max("o_orderkey").alias("last_key")),
    "u01_union_sources": lambda s, d: _read(s, d, "documents").where("source = 'src1'").unionByName(_read(s, d, "documents").where("source = 'src2'").select("doc_id", "source"), allowMissingColumns=True).select("doc_id", "source", "lang"),
    "u02_first_wins": lambda s, d: first_per_key(_read(s, d, "documents"), [F.lower("text"), F.lower("lang")], ["doc_id"]).select("doc_id"),
    "u03_distinct_names": lambda s, d: first_per_key(_read(s, d, "part").where(F.trim(F.col("p_name")) != ""), [F.lower(F.trim(F.col("p_name")))], ["p_partkey"]).select("p_partkey", "p_name"),
    "u04_content_hash": lambda s, d: _read(s, d, "documents").select("doc_id", record_hash(F.col("lang"), F.col("source"), F.col("text")).alias("h")),
    "u04_page_hash": lambda s, d: _read(s, d, "pages").select("page_id", record_hash(F.col("url")).alias("h")),
    "u05_new_records": _dedup_new,
    "u06_drop_duplicates": lambda s, d: first_per_key(_read(s, d, "documents"), [F.col("text")], ["doc_id"]).select("doc_id"),
    "j03_unseen": lambda s, d: insert_new(_read(s, d, "benchmark").select("text"), _read(s, d, "documents"), ["text"], ["doc_id"]).select("doc_id"),
    "k15_markdown_row": lambda s, d: _read(s, d, "region").orderBy("r_regionkey").limit(50).select("r_regionkey", F.concat(F.lit("| "), F.concat_ws(" | ", F.col("r_regionkey").cast("string"), "r_name"), F.lit(" |")).alias("line")),
    "f16_direction": lambda s, d: _read(s, d, "orders").select("o_orderkey", F.when(F.col("o_custkey") == 7, "sent").when((F.col("o_orderkey") % 50 == 7) | (F.col("o_orderpriority") == "1-URGENT"), "received").alias("direction")).where("direction IS NOT NULL"),
    "f17_thread": lambda s, d: _read(s, d, "lineitem").where("(l_suppkey = 1 AND l_partkey % 100 = 2) OR (l_suppkey = 2 AND l_partkey % 100 = 1)").select("l_orderkey", "l_linenumber"),
    "f27_children": lambda s, d: _read(s, d, "orders").where((F.col("o_custkey") == 10) | (F.col("o_custkey") == 20)).select("o_orderkey", "o_custkey"),
    "f28_roots": lambda s, d: roots_and_children(_agents(s, d), "n_nationkey", "parent"),
    "f29_runs": lambda s, d: _read(s, d, "lineitem").where("l_orderkey = 5").select("l_orderkey", "l_linenumber", "l_quantity"),
    "f04_messages": lambda s, d: _read(s, d, "conversations").groupBy("conv_id").agg(F.count_if(~T.is_blank(F.col("text"))).alias("n")).where("n > 0"),
}

_E = "events"
SQL = {
    "k09_upsert": """WITH base AS (SELECT * FROM events WHERE event_id % 3 <> 0), ch AS (SELECT * FROM events WHERE event_id % 3 = 0 OR event_id % 7 = 0),
      a AS (SELECT user_id, event_type, max(event_id) AS event_id FROM base GROUP BY ALL), b AS (SELECT user_id, event_type, max(event_id) AS event_id FROM ch GROUP BY ALL)
      SELECT user_id, event_type, coalesce(b.event_id, a.event_id) AS event_id FROM a FULL JOIN b USING (user_id, event_type)""",
    "k10_insert_new": """SELECT event_id, user_id, props FROM (SELECT *, row_number() OVER (PARTITION BY user_id, props ORDER BY event_id) AS rn FROM events e WHERE event_id >= 500
      AND NOT EXISTS (SELECT 1 FROM events o WHERE o.event_id < 500 AND o.user_id = e.user_id AND o.props = e.props)) WHERE rn = 1""",
    "k11_patch": "SELECT c_custkey, CASE WHEN c_custkey % 4 = 2 THEN 'renamed' ELSE c_name END AS c_name, c_mktsegment FROM customer",
    "k12_delete": "SELECT event_id FROM events WHERE event_type <> 'error'",
    "k13_retention": "SELECT event_id, user_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 50",
    "k14_keep_newest": "SELECT o_orderkey, o_custkey FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn <= 3",
    "w04_ring_buffer": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn <= 200",
    "w05_replay": "SELECT event_id, user_id FROM events LEFT JOIN (SELECT user_id, max(event_id) AS seen FROM events WHERE event_id % 500 = 0 GROUP BY user_id) USING (user_id) WHERE seen IS NULL OR event_id > seen",
    "w06_latest_value": "SELECT event_type, user_id, value FROM (SELECT *, row_number() OVER (PARTITION BY event_type, user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1",
    "w07_newest": "SELECT event_id, ts FROM events ORDER BY ts DESC, event_id DESC LIMIT 50",
    "w08_oldest": "SELECT event_id, ts FROM events WHERE user_id = 8 ORDER BY ts, event_id LIMIT 20",
    "w13_result_cap": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 30",
    "r06_delivery": "SELECT event_id, c_custkey IS NOT NULL AS delivered FROM events LEFT JOIN (SELECT c_custkey FROM customer WHERE c_custkey % 3 = 0) ON user_id = c_custkey",
    "r15_last_events": "SELECT event_id FROM events ORDER BY ts DESC, event_id DESC LIMIT 200",
    "g01_channel_summary": "SELECT event_type, count(*) AS entries, min(ts) AS first_at, max(ts) AS last_at, string_agg(DISTINCT user_id::VARCHAR, ',' ORDER BY user_id::VARCHAR) AS keys FROM events GROUP BY event_type",
    "g02_distinct_counts": "SELECT count(*) AS n, count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS types FROM events",
    "g03_counts_per_agent": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id",
    "g04_message_totals": "SELECT count(*) AS n, count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type IN ('view', 'click')) AS reads FROM events",
    "g05_fleet_counts": "SELECT count(*) FILTER (c_custkey % 10 = 0) AS roots, count(*) FILTER (c_custkey % 10 <> 0) AS subs, count(*) FILTER (c_acctbal > 0) AS active FROM customer",
    "g06_tool_stats": "SELECT user_id, count(*) AS calls, count(*) FILTER (event_type = 'error') AS errors, round(sum(value), 4) AS total_ms FROM events GROUP BY user_id",
    "g07_run_totals": "SELECT l_suppkey, count(DISTINCT l_orderkey) AS runs, sum(l_quantity) AS tokens, count(*) AS calls FROM lineitem GROUP BY l_suppkey",
    "g32_step_counts": "SELECT o_custkey, count(*) FILTER (o_orderstatus = 'F') AS completed, count(*) FILTER (o_orderstatus = 'P') AS failed FROM orders GROUP BY o_custkey",
    "p07_status_tracker": """SELECT o_orderstatus, count(*) AS n, max(o_orderkey) AS last_key FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey, o_orderstatus ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
      WHERE rn = 1 GROUP BY o_orderstatus""",
    "u01_union_sources": "SELECT doc_id, source, lang FROM documents WHERE source = 'src1' UNION ALL SELECT doc_id, source, NULL FROM documents WHERE source = 'src2'",
    "u02_first_wins": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY lower(text), lower(lang)",
    "u03_distinct_names": "SELECT p_partkey, p_name FROM (SELECT *, row_number() OVER (PARTITION BY lower(trim(p_name)) ORDER BY p_partkey) AS rn FROM part WHERE trim(p_name) <> '') WHERE rn = 1",
    "u04_content_hash": "SELECT doc_id, left(sha256(lower(trim(coalesce(lang, ''))) || '|' || lower(trim(coalesce(source, ''))) || '|' || lower(trim(coalesce(text, '')))), 16) AS h FROM documents",
    "u04_page_hash": "SELECT page_id, left(sha256(lower(trim(coalesce(url, '')))), 16) AS h FROM pages",
    "u05_new_records": """WITH h AS (SELECT doc_id, left(sha256(lower(trim(coalesce(text, ''))) || '|' || lower(trim(coalesce(source, '')))), 16) AS h FROM documents)
      SELECT min(doc_id) AS doc_id, h FROM h WHERE h NOT IN (SELECT h FROM h WHERE doc_id % 10 = 0) GROUP BY h""",
    "u06_drop_duplicates": "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text",
    "j03_unseen": "SELECT min(doc_id) AS doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM benchmark b WHERE b.text = d.text) GROUP BY text",
    "k15_markdown_row": "SELECT r_regionkey, '| ' || r_regionkey::VARCHAR || ' | ' || r_name || ' |' AS line FROM region ORDER BY r_regionkey LIMIT 50",
    "f16_direction": """SELECT o_orderkey, CASE WHEN o_custkey = 7 THEN 'sent' ELSE 'received' END AS direction FROM orders WHERE o_custkey = 7 OR o_orderkey % 50 = 7 OR o_orderpriority = '1-URGENT'""",
    "f17_thread": "SELECT l_orderkey, l_linenumber FROM lineitem WHERE (l_suppkey = 1 AND l_partkey % 100 = 2) OR (l_suppkey = 2 AND l_partkey % 100 = 1)",
    "f27_children": "SELECT o_orderkey, o_custkey FROM orders WHERE o_custkey IN (10, 20)",
    "f28_roots": """WITH a AS (SELECT n_nationkey, nullif(min(n_nationkey) OVER (PARTITION BY n_regionkey), n_nationkey) AS parent FROM nation)
      SELECT n_nationkey, parent IS NULL AS is_root, (SELECT count(*) FROM a c WHERE c.parent = a.n_nationkey) AS children FROM a""",
    "f29_runs": "SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey = 5",
    "f04_messages": r"SELECT conv_id, count(*) FILTER (regexp_matches(coalesce(text, ''), '\S')) AS n FROM conversations GROUP BY conv_id HAVING count(*) FILTER (regexp_matches(coalesce(text, ''), '\S')) > 0",
}
