"""Queries of the scalar functions: text, JSON and URL expressions on the supplied tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from quillspark.functions import json as J
from quillspark.functions import text as T


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _docs(s, d):
    return _read(s, d, "documents")


def _talk(s, d):
    """Turns with thinking marks, lists and headings."""
    t = F.concat(F.lit("# Title\n- one **bold** \n<think>a"), "text", F.when(F.col("turn") % 2 == 0, "</think>").otherwise(""), F.lit("answer "), "text")
    return _read(s, d, "conversations").select("conv_id", "turn", t.alias("t"))


_TALK = """(SELECT conv_id, turn, '# Title' || chr(10) || '- one **bold** ' || chr(10) || '<think>a' || text || CASE WHEN turn % 2 = 0 THEN '</think>' ELSE '' END || 'answer ' || text AS t FROM conversations)"""


def _bodies(s, d):
    """Open-shaped bodies made from events: lists, known keys, nested and broken ones."""
    e = F.col("event_id")
    item = F.concat(F.lit('{"title": "t'), e.cast("string"), F.lit('", "company": {"name": "c"}, "n": '), (e % 9).cast("string"), F.lit("}"))
    body = (
        F.when(e % 5 == 0, F.concat(F.lit("["), item, F.lit("]")))
        .when(e % 5 == 1, F.concat(F.lit('{"jobs": ['), item, F.lit(", "), item, F.lit("]}")))
        .when(e % 5 == 2, F.concat(F.lit('{"data": {"x": 1}, "results": ['), item, F.lit("]}")))
        .when(e % 5 == 3, F.concat(F.lit("broken {"), item))
        .otherwise(F.concat(F.lit("text ```json\n"), item, F.lit("\n``` more")))
    )
    return _read(s, d, "events").select("event_id", body.alias("body"))


QUERIES = {
    "x01_strip": lambda s, d: _docs(s, d).select("doc_id", F.length(T.strip(F.col("text"))).cast("long").alias("n"), F.left(F.lower("text"), F.lit(20)).alias("head")),
    "x02_truncate": lambda s, d: _docs(s, d).select("doc_id", T.truncate(F.col("text"), 500).alias("text")),
    "x03_normalise_lines": lambda s, d: _docs(s, d).select("doc_id", T.normalise_lines(F.col("text")).alias("text")),
    "x04_clean_tweet": lambda s, d: _docs(s, d).select("doc_id", T.clean_tweet(F.col("text")).alias("text")),
    "x05_emoji": lambda s, d: _docs(s, d).select("doc_id", T.emoji_words(F.concat("text", F.lit(" :) x :-( <3 ;) :D "))).alias("text")),
    "x06_contractions": lambda s, d: _docs(s, d).select("doc_id", T.expand_contractions(F.concat(F.lit("i'm sure it isn't, we'll see; "), "text")).alias("text")),
    "x07_tokens": lambda s, d: _docs(s, d).select("doc_id", F.size(T.tokens(F.col("text"))).cast("long").alias("n"), F.array_join(T.tokens(F.col("text")), " ").alias("text")),
    "x08_stop_words": lambda s, d: _docs(s, d).select("doc_id", F.array_join(T.drop_stop_words(T.tokens(F.col("text"))), " ").alias("text")),
    "x09_stems": lambda s, d: _docs(s, d).select(F.explode(T.tokens(F.lower("text"))).alias("word")).distinct().select("word", T.stem(F.col("word")).alias("stem")),
    "x11_sentences": lambda s, d: _docs(s, d).select("doc_id", F.size(T.sentences(F.col("text"))).cast("long").alias("n")),
    "x12_markdown": lambda s, d: _talk(s, d).select("conv_id", "turn", T.strip_markdown(F.col("t")).alias("t")),
    "x13_clauses": lambda s, d: _docs(s, d).select("doc_id", F.size(T.clauses(F.col("text"))).cast("long").alias("n"), F.coalesce(F.get(T.clauses(F.col("text")), F.lit(0)), F.lit("")).alias("first")),
    "x14_zip_code": lambda s, d: _docs(s, d).select("doc_id", T.zip_code(F.col("text")).alias("zip"), T.zip_start(F.col("text")).cast("long").alias("start")),
    "x15_unwrap_call": lambda s, d: _docs(s, d).select("doc_id", T.unwrap_calls(F.concat(F.lit("SELECT CONVERT_TZ(a.b, 'x', 'y'), coalesce(c, 0) FROM t WHERE id = "), F.col("doc_id").cast("string"))).alias("q")),
    "x16_thinking": lambda s, d: _talk(s, d).select("conv_id", "turn", T.strip_thinking(F.col("t")).alias("answer"), T.thinking(F.col("t")).alias("thinking")),
    "x17_slug_title": lambda s, d: _read(s, d, "pages").select("page_id", T.slug_title(F.regexp_extract("url", r"^[a-z]+://[^/]+/([^/?#]*)", 1)).alias("name")),
    "x18_url_parts": lambda s, d: _read(s, d, "pages").select("page_id", F.try_parse_url("url", F.lit("HOST")).alias("host"), F.try_parse_url("url", F.lit("PATH")).alias("path")),
    "x19_page_type": lambda s, d: _read(s, d, "pages").select("page_id", T.page_type(F.col("url")).alias("kind")),
    "x20_collection_name": lambda s, d: _docs(s, d).select("doc_id", T.collection_name(F.concat(F.lit("a-"), F.col("text")), "agent_").alias("name")),
    "x21_fill": lambda s, d: _docs(s, d).select("doc_id", F.format_string("%s: %d", F.coalesce("source", F.lit("")), "n_chars").alias("t")),
    "s18_page_source": lambda s, d: _read(s, d, "pages").select("page_id", F.length("html").cast("long").alias("n")),
    "s19_url_glob": lambda s, d: _read(s, d, "pages").where(T.url_glob(F.col("url"), "*://*.ORG/*")).select("page_id"),
    "h03_title": lambda s, d: _read(s, d, "pages").select("page_id", F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1).alias("title")),
    "n01_json_columns": lambda s, d: _read(s, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"), F.to_json(F.struct(F.from_json("props", "k bigint")["k"].alias("k"))).alias("again")),
    "n02_records": lambda s, d: _bodies(s, d).select("event_id", J.n_records(F.col("body")).cast("long").alias("n")),
    "n03_alias_fields": lambda s, d: _bodies(s, d).select("event_id", J.record_fields(F.col("body")).alias("r")).select("event_id", "r.title", "r.company"),
    "n04_safe_get": lambda s, d: _read(s, d, "events").select("event_id", F.get_json_object("props", "$.k").alias("k"), F.get_json_object("props", "$.a.b").alias("missing")),
    "n05_json_ladder": lambda s, d: _bodies(s, d).select("event_id", J.first_json(F.col("body")).alias("json")),
    "n08_references": lambda s, d: _docs(s, d).select("doc_id", J.resolve(F.concat(F.lit("$steps."), F.coalesce("lang", F.lit("zz")), F.lit(".output")), F.create_map(F.lit("en"), F.lit("one"), F.lit("fr"), F.lit("two"))).alias("value")),
    "n09_csv_set": lambda s, d: _read(s, d, "part").select("p_partkey", F.array_join(F.array_sort(F.array_distinct(F.filter(F.transform(F.split(F.concat(F.lit(" B,, "), F.replace(F.upper("p_name"), F.lit(" "), F.lit(" , "))), ","), lambda x: F.lower(F.trim(x))), lambda x: x != ""))), ",").alias("names")),
    "n16_stream_deltas": lambda s, d: _read(s, d, "events").select("event_id", J.delta(F.concat(F.when(F.col("event_id") % 7 == 0, "data: {broken").otherwise(F.concat(F.lit('data: {"choices": [{"delta": {"content": "'), "event_type", F.lit('"}}]}'))))).alias("delta")).where("delta IS NOT NULL"),
    "y03_coercion": lambda s, d: _read(s, d, "events").select("event_id", J.coerce(F.regexp_extract("props", r": (.*)\}", 1), "int").alias("n"), J.coerce(F.col("event_type"), "int").alias("bad"), J.coerce(F.when(F.col("event_id") % 2 == 0, "Yes").otherwise("no"), "boolean").alias("flag")),
    "a13_chip": lambda s, d: _docs(s, d).select("doc_id", F.concat(F.lit("<human>: q"), F.col("doc_id").cast("string"), F.lit("\n<bot>: "), "text").alias("t")).select("doc_id", F.replace(F.split_part("t", F.lit("\n<bot>: "), F.lit(1)), F.lit("<human>: "), F.lit("")).alias("input"), F.split_part("t", F.lit("\n<bot>: "), F.lit(2)).alias("output")),
    "a14_renamed_pairs": lambda s, d: _read(s, d, "conversations").select("conv_id", "turn", F.col("role").alias("input"), F.col("text").alias("output")),
    "a15_output_only": lambda s, d: _docs(s, d).select("doc_id", F.lit("").alias("input"), F.col("text").alias("output")),
    "a17_pruned_pairs": lambda s, d: _docs(s, d).select(F.col("source").alias("input"), F.col("lang").alias("output")),
    "a19_marked_prompt": lambda s, d: _docs(s, d).select("doc_id", F.concat(F.lit("<bos>translate: "), "text", F.lit("\n<eos>")).alias("t")),
    "a29_label_maps": lambda s, d: _read(s, d, "labels").select("doc_id", F.create_map(F.lit(0), F.lit("poor"), F.lit(1), F.lit("good"))[F.col("quality")].alias("name")),
    "a32_result_preview": lambda s, d: _read(s, d, "events").select("event_id", F.left(F.repeat("props", F.lit(300)), F.lit(2000)).alias("output"), F.round(F.col("value") * 1.23456, 2).alias("ms")),
    "a36_catalogue": lambda s, d: _read(s, d, "nation").groupBy("n_regionkey").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: F.format_string("- %s: %d", x["n_name"], x["n_nationkey"])), "\n").alias("lines")),
}

_SP = r"\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"
_WS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')"
_STRIP = lambda c: f"regexp_replace({c}, '^[{_SP}]+|[{_SP}]+$', '', 'g')"
_STOP = ", ".join(f"'{w}'" for w in T.STOP_WORDS)
_NOTHINK = r"trim(regexp_replace(regexp_replace(t, '(?s)<think>.*?</think>', '', 'g'), '(?s)<think>.*$', ''))"


def _emoji(text: str) -> str:
    for pattern, word in T.EMOJI:
        text = f"regexp_replace({text}, '" + pattern.replace("'", "''") + f"', '{word}', 'g')"
    return text


_EXPANDED = "'i''m sure it isn''t, we''ll see; ' || text"
for _old, _new in (("\\bwon't", "will not"), ("\\bcan't", "cannot"), ("\\bi'm", "i am"), ("\\blet's", "let us"), ("n't", " not"), ("'re", " are"), ("'ll", " will"), ("'ve", " have"), ("'d", " would")):
    _EXPANDED = f"regexp_replace({_EXPANDED}, '{_old.replace(chr(39), chr(39) * 2)}\\b', '{_new}', 'gi')"

SQL = {
    "x06_contractions": f"SELECT doc_id, {_EXPANDED} AS text FROM documents",
    "x01_strip": f"SELECT doc_id, length({_STRIP('text')}) AS n, left(lower(text), 20) AS head FROM documents",
    "x02_truncate": "SELECT doc_id, CASE WHEN length(text) > 500 THEN left(text, 500) || chr(10) || chr(10) || '...[truncated]' ELSE text END AS text FROM documents",
    "x03_normalise_lines": f"SELECT doc_id, coalesce(array_to_string(list_filter(list_transform(string_split(text, chr(10)), lambda x: {_STRIP('x')}), lambda x: x <> ''), chr(10)), '') AS text FROM documents",
    "x05_emoji": "SELECT doc_id, " + _emoji("text || ' :) x :-( <3 ;) :D '") + " AS text FROM documents",
    "x07_tokens": f"SELECT doc_id, len({_WS}) AS n, coalesce(array_to_string({_WS}, ' '), '') AS text FROM documents",
    "x08_stop_words": f"SELECT doc_id, coalesce(array_to_string(list_filter({_WS}, lambda w: lower(w) NOT IN ({_STOP})), ' '), '') AS text FROM documents",
    "x12_markdown": rf"SELECT conv_id, turn, regexp_replace(regexp_replace(replace(t, '**', ''), '(?m)^#+ *', '', 'g'), '(?m)^- ', '', 'g') AS t FROM {_TALK}",
    "x13_clauses": "SELECT doc_id, len(c) AS n, coalesce(c[1], '') AS first FROM (SELECT doc_id, regexp_extract_all(text, '[^.!?,;]+[.!?,;]?') AS c FROM documents)",
    "x14_zip_code": r"SELECT doc_id, z AS zip, CASE WHEN z IS NOT NULL THEN length(regexp_extract(text, '(?s)^(.*?)\b(?:\d{5}(?:-\d{4})?|\d{6})\b', 1)) END AS start FROM (SELECT doc_id, text, nullif(regexp_extract(text, '\b(\d{5}(?:-\d{4})?|\d{6})\b', 1), '') AS z FROM documents)",
    "x15_unwrap_call": "SELECT doc_id, 'SELECT a.b, c FROM t WHERE id = ' || doc_id::VARCHAR AS q FROM documents",
    "x16_thinking": rf"SELECT conv_id, turn, {_NOTHINK} AS answer, trim(regexp_extract(t, '(?s)<think>(.*?)(?:</think>|$)', 1)) AS thinking FROM {_TALK}",
    "x18_url_parts": r"SELECT page_id, regexp_extract(url, '^[a-z]+://([^/:?#]+)', 1) AS host, regexp_extract(url, '^[a-z]+://[^/?#]+([^?#]*)', 1) AS path FROM pages",
    "x19_page_type": "SELECT page_id, CASE WHEN contains(lower(url), 'greenhouse.io') THEN 'greenhouse' WHEN contains(lower(url), 'lever.co') THEN 'lever' WHEN contains(lower(url), 'workday') THEN 'workday' WHEN contains(lower(url), 'ashbyhq.com') THEN 'ashby' ELSE 'auto' END AS kind FROM pages",
    "x20_collection_name": "SELECT doc_id, left(replace('agent_a-' || text, '-', '_'), 63) AS name FROM documents",
    "x21_fill": "SELECT doc_id, coalesce(source, '') || ': ' || n_chars::VARCHAR AS t FROM documents",
    "s18_page_source": "SELECT page_id, length(html) AS n FROM pages",
    "s19_url_glob": r"SELECT page_id FROM pages WHERE regexp_matches(url, '(?i)^.*://.*\.org/.*$')",
    "h03_title": "SELECT page_id, regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1) AS title FROM pages",
    "n01_json_columns": "SELECT event_id, k, '{\"k\":' || k::VARCHAR || '}' AS again FROM (SELECT event_id, (props->>'$.k')::BIGINT AS k FROM events)",
    "n04_safe_get": "SELECT event_id, props->>'$.k' AS k, props->>'$.a.b' AS missing FROM events",
    "n08_references": "SELECT doc_id, CASE lang WHEN 'en' THEN 'one' WHEN 'fr' THEN 'two' END AS value FROM documents",
    "n09_csv_set": "SELECT p_partkey, array_to_string(list_sort(list_distinct(list_concat(['b'], list_filter(string_split(lower(p_name), ' '), lambda x: x <> '')))), ',') AS names FROM part",
    "n16_stream_deltas": "SELECT event_id, event_type AS delta FROM events WHERE event_id % 7 <> 0",
    "y03_coercion": "SELECT event_id, (props->>'$.k')::BIGINT AS n, NULL::BIGINT AS bad, event_id % 2 = 0 AS flag FROM events",
    "a13_chip": "SELECT doc_id, 'q' || doc_id::VARCHAR AS input, text AS output FROM documents",
    "a14_renamed_pairs": "SELECT conv_id, turn, role AS input, text AS output FROM conversations",
    "a15_output_only": "SELECT doc_id, '' AS input, text AS output FROM documents",
    "a17_pruned_pairs": "SELECT source AS input, lang AS output FROM documents",
    "a19_marked_prompt": "SELECT doc_id, '<bos>translate: ' || text || chr(10) || '<eos>' AS t FROM documents",
    "a29_label_maps": "SELECT doc_id, CASE quality WHEN 0 THEN 'poor' WHEN 1 THEN 'good' END AS name FROM labels",
    "a32_result_preview": "SELECT event_id, left(repeat(props, 300), 2000) AS output, round(value * 1.23456::DOUBLE, 2) AS ms FROM events",
    "a36_catalogue": "SELECT n_regionkey, string_agg('- ' || n_name || ': ' || n_nationkey::VARCHAR, chr(10) ORDER BY n_nationkey) AS lines FROM nation GROUP BY n_regionkey",
}
