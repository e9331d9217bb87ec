"""Filters, and the first reason for which a row fails a chain of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T


def non_blank(df: DataFrame, col: str) -> DataFrame:
    return df.where(~T.is_blank(F.col(col)))


def min_stripped_length(df: DataFrame, col: str, n: int) -> DataFrame:
    return df.where(F.length(T.strip(F.col(col))) >= n)


def first_reason(rules: list[tuple[str, Column]]) -> Column:
    """Name of the first rule that holds (null counts as not), else null."""
    out = F.lit(None).cast("string")
    for name, fails in reversed(rules):
        out = F.when(F.coalesce(fails, F.lit(False)), name).otherwise(out)
    return out


def any_keyword(text: Column, keywords: list[str]) -> Column:
    low = F.lower(text)
    out = F.lit(False)
    for k in keywords:
        out = out | F.contains(low, F.lit(k.lower()))
    return F.coalesce(out, F.lit(False))


def token_range(tokens: Column, vocabulary: int) -> Column:
    """Whether any id is out of range; -100 is exempt."""
    return F.exists(tokens, lambda x: (x != -100) & ((x < 0) | (x >= vocabulary)))


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _reasons(s, d):
    docs = _read(s, d, "documents")
    rules = [("source", F.col("source") == "src3"), ("language", ~F.col("lang").isin("en", "fr")), ("short", F.length("text") < 200), ("shouting", F.col("text").rlike("!!"))]
    return docs.withColumn("reason", first_reason(rules))


_REASON_SQL = """(SELECT *, CASE WHEN source = 'src3' THEN 'source' WHEN lang NOT IN ('en', 'fr') THEN 'language' WHEN length(text) < 200 THEN 'short'
  WHEN contains(text, '!!') THEN 'shouting' END AS reason FROM documents)"""

QUERIES = {
    "f01_non_blank": lambda s, d: non_blank(_read(s, d, "documents"), "text").select("doc_id"),
    "f02_non_empty": lambda s, d: _read(s, d, "documents").where(F.length("text") > 0).select("doc_id"),
    "f03_min_length": lambda s, d: min_stripped_length(_read(s, d, "documents"), "text", 10).select("doc_id"),
    "f06_drop_nulls": lambda s, d: _read(s, d, "documents").dropna().select("doc_id"),
    "f07_max_tokens": lambda s, d: _read(s, d, "documents").where(F.size(T.tokens(F.col("text"))) <= 256).select("doc_id"),
    "f08_token_range": lambda s, d: _read(s, d, "documents")
    .select(F.transform(T.tokens(F.col("text")), lambda w: F.length(w)).alias("t"))
    .agg(F.count("*").alias("rows"), F.count_if(token_range(F.col("t"), 20)).alias("bad"), F.min(F.array_min("t")).cast("long").alias("low"), F.max(F.array_max("t")).cast("long").alias("high")),
    "f10_filter_chain": lambda s, d: _reasons(s, d).where("reason IS NULL").select("doc_id"),
    "f11_any_keyword": lambda s, d: _read(s, d, "part").where(any_keyword(F.col("p_name"), ["Red", "steel", "x"])).select("p_partkey"),
    "f12_unknown_in": lambda s, d: _read(s, d, "documents").where(F.coalesce("lang", F.lit("unknown")).isin("en", "unknown")).select("doc_id"),
    "f15_history": lambda s, d: _read(s, d, "events").where((F.col("ts") >= F.lit("2024-01-10").cast("timestamp_ntz")) & (F.col("event_type").ilike("%CL%") | F.col("props").ilike("%7%"))).select("event_id"),
    "f18_status_count": lambda s, d: _read(s, d, "orders").agg(F.count_if(F.col("o_orderstatus").isin("O", "P")).alias("n")),
    "f21_single_characters": lambda s, d: _read(s, d, "documents").select("doc_id", F.array_join(F.filter(T.tokens(F.col("text")), lambda w: F.length(w) != 1), " ").alias("text")),
    "f23_label_mask": lambda s, d: _read(s, d, "labels").where("quality = 1").select("doc_id"),
    "f24_blank_lines": lambda s, d: _read(s, d, "documents").select("doc_id", F.size(F.filter(F.split("text", "\n"), lambda x: F.trim(x) != "")).cast("long").alias("n")),
    "f25_intent": lambda s, d: _read(s, d, "conversations").where(F.lower("text").rlike("find|search|the")).select("conv_id", "turn"),
    "g22_reason_histogram": lambda s, d: _reasons(s, d).where("reason IS NOT NULL").groupBy("reason").agg(F.count("*").alias("n")),
}

_WS = "list_filter(regexp_split_to_array(text, '[ \\t\\n\\r\\f\\v]+'), lambda w: w <> '')"
SQL = {
    "f01_non_blank": r"SELECT doc_id FROM documents WHERE regexp_matches(coalesce(text, ''), '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')",
    "f02_non_empty": "SELECT doc_id FROM documents WHERE length(text) > 0",
    "f03_min_length": r"SELECT doc_id FROM documents WHERE length(regexp_replace(text, '^[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+|[\s\x{0B}\x{85}\x{A0}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]+$', '', 'g')) >= 10",
    "f06_drop_nulls": "SELECT doc_id FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL AND lang IS NOT NULL AND source IS NOT NULL AND n_chars IS NOT NULL",
    "f07_max_tokens": f"SELECT doc_id FROM documents WHERE len({_WS}) <= 256",
    "f08_token_range": f"""SELECT count(*) AS rows, count(*) FILTER (len(list_filter(t, lambda x: x < 0 OR x >= 20)) > 0) AS bad, min(list_min(t)) AS low, max(list_max(t)) AS high
      FROM (SELECT list_transform({_WS}, lambda w: length(w)) AS t FROM documents)""",
    "f10_filter_chain": f"SELECT doc_id FROM {_REASON_SQL} WHERE reason IS NULL",
    "f11_any_keyword": "SELECT p_partkey FROM part WHERE contains(lower(p_name), 'red') OR contains(lower(p_name), 'steel') OR contains(lower(p_name), 'x')",
    "f12_unknown_in": "SELECT doc_id FROM documents WHERE coalesce(lang, 'unknown') IN ('en', 'unknown')",
    "f15_history": "SELECT event_id FROM events WHERE ts >= TIMESTAMP '2024-01-10' AND (event_type ILIKE '%CL%' OR props ILIKE '%7%')",
    "f18_status_count": "SELECT count(*) FILTER (o_orderstatus IN ('O', 'P')) AS n FROM orders",
    "f21_single_characters": f"SELECT doc_id, coalesce(array_to_string(list_filter({_WS}, lambda w: length(w) <> 1), ' '), '') AS text FROM documents",
    "f23_label_mask": "SELECT doc_id FROM labels WHERE quality = 1",
    "f24_blank_lines": "SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda x: trim(x) <> '')) AS n FROM documents",
    "f25_intent": "SELECT conv_id, turn FROM conversations WHERE regexp_matches(lower(text), 'find|search|the')",
    "g22_reason_histogram": f"SELECT reason, count(*) AS n FROM {_REASON_SQL} WHERE reason IS NOT NULL GROUP BY reason",
}
