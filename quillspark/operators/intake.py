"""Intake of raw records: loader fall-backs, board mappings, guards, context assembly and stream lines."""

from __future__ import annotations

from collections.abc import Callable, Iterable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import adapters, corpus, records
from quillspark.operators.expressions import _STRIP

# Statuses of an application, as given, and the score of an entity found by pattern.
STATUSES = ("found", "applied", "interviewing", "offer", "rejected", "withdrawn")
ZIP_SCORE = 0.9852345
TAGS = {"LOC": "Location", "PER": "Person"}


def has_key(line: Column, key: str) -> Column:
    """Whether line is a JSON object with that key, whatever its value."""
    return F.coalesce(F.array_contains(F.json_object_keys(line), key), F.lit(False))


def line_text(line: Column) -> Column:
    """Text of a JSON line: its rendered messages if it has that key, else text or, where that is empty, content; null for
    lines without any of these, that aren't JSON, or whose text is blank."""
    parsed = F.from_json(line, "messages array<struct<role: string, content: string>>, text string, content string")
    plain = F.coalesce(F.nullif(parsed["text"], F.lit("")), parsed["content"])
    found = F.when(has_key(line, "messages"), adapters.render_chat(F.coalesce(parsed["messages"], F.array())))
    found = found.when(has_key(line, "text") | has_key(line, "content"), plain)
    return F.when(~T.is_blank(found), found)


def instruction_pairs(df: DataFrame) -> DataFrame:
    """instruction and response become input and output; other columns stay."""
    return df.withColumnsRenamed({"instruction": "input", "response": "output"})


def _text(body: Column, *paths: str) -> Column:
    """The first of the paths that isn't empty, else an empty text."""
    return F.coalesce(*[F.nullif(F.get_json_object(body, p), F.lit("")) for p in paths], F.lit(""))


def _pay(body: Column, low: str, high: str) -> Column:
    return records.salary_range(*[F.get_json_object(body, p).try_cast("double") for p in (low, high)])


def board_record(body: Column, board: str) -> Column:
    """A job of one of three boards, as a JSON text, in common fields."""
    if board == "remotive":
        place = F.coalesce(F.get_json_object(body, "$.candidate_required_location"), F.lit("Worldwide"))
        fields = [_text(body, "$.id"), _text(body, "$.title"), _text(body, "$.company_name"), _text(body, "$.url"), place, _text(body, "$.salary"), _text(body, "$.publication_date"), "Remotive"]
    elif board == "adzuna":
        pay = _pay(body, "$.salary_min", "$.salary_max")
        fields = [_text(body, "$.id"), _text(body, "$.title"), _text(body, "$.company.display_name"), _text(body, "$.redirect_url"), _text(body, "$.location.display_name"), pay, _text(body, "$.created"), "Adzuna"]
    elif board == "jsearch":
        pay, period = _pay(body, "$.job_min_salary", "$.job_max_salary"), _text(body, "$.job_salary_period")
        pay = F.when((period != "") & pay.contains("–"), F.concat(pay, F.lit(" ("), period, F.lit(")"))).otherwise(pay)
        fields = [
            _text(body, "$.job_id"), _text(body, "$.job_title"), _text(body, "$.employer_name"), _text(body, "$.job_apply_link", "$.job_google_link"),
            _text(body, "$.job_city", "$.job_country"), pay, _text(body, "$.job_posted_at_datetime_utc"), "JSearch",
        ]
    else:
        raise ValueError(f"no such board: {board}")
    names = ("id", "title", "company", "url", "location", "salary", "date", "source")
    cut = {"date": lambda c: F.left(c, F.lit(10)), "source": F.lit}
    return F.struct(*[cut.get(n, lambda c: c)(f).alias(n) for n, f in zip(names, fields, strict=True)])


def name_entities(entities: Column, zip_code: Column, start: Column, end: Column) -> Column:
    """Entities (word, tag, start, end, score) with tags spelt out, those of one character dropped, and the zip code, if
    any, behind them as a place."""
    kept = F.filter(entities, lambda e: F.length(e["word"]) != 1)
    tag = lambda t: F.when(t == "LOC", TAGS["LOC"]).when(t == "PER", TAGS["PER"]).otherwise("Organization")
    named = F.transform(kept, lambda e: F.struct(e["word"].alias("token"), tag(e["tag"]).alias("tag"), e["start"].alias("start"), e["end"].alias("end"), e["score"].alias("score")))
    more = F.array(F.struct(zip_code.alias("token"), F.lit(TAGS["LOC"]).alias("tag"), start.alias("start"), end.alias("end"), F.lit(ZIP_SCORE).alias("score")))
    return F.when(F.coalesce(zip_code, F.lit("")) != "", F.concat(named, more)).otherwise(named)


def history(messages: Column) -> Column:
    """Messages as sender and content."""
    return F.transform(messages, lambda m: F.struct(m["role"].alias("sender"), m["content"].alias("content")))


def assemble_context(system: Column, messages: Column, goal: Column, most: int = 20) -> Column:
    """The system prompt, the newest `most` messages in order, and the goal."""
    one = lambda role, content: F.array(F.struct(F.lit(role).alias("role"), content.alias("content")))
    newest = F.slice(messages, F.greatest(F.size(messages) - most, F.lit(0)) + 1, most)
    return F.concat(one("system", system), newest, one("user", F.concat(F.lit("Goal: "), goal)))


def isolated(function: Callable, returns: str = "string"):
    """function as a column function over Arrow batches, for rows that may fail: a struct of ok and value."""

    @F.pandas_udf(f"ok boolean, value {returns}")
    def run(*columns: pd.Series) -> pd.DataFrame:
        out: list[tuple] = []
        for row in zip(*columns, strict=True):
            try:
                out.append((True, function(*row)))
            except Exception:  # noqa: BLE001  whatever a row's formatter raises, the row is skipped
                out.append((False, None))
        return pd.DataFrame(out, columns=["ok", "value"])

    return run


def require_columns(df: DataFrame, names: Iterable[str]) -> DataFrame:
    """df, or a ValueError that says which columns are missing."""
    if missing := [n for n in names if n not in df.columns]:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def status_error(status: Column, valid: tuple[str, ...] = STATUSES) -> Column:
    """What is wrong with a status that is given and not valid; null otherwise."""
    wrong = (F.coalesce(status, F.lit("")) != "") & ~status.isin(*valid)
    return F.when(wrong, F.concat(F.lit("ERROR: Invalid status '"), status, F.lit(f"'. Valid: {', '.join(sorted(valid))}")))


def on_allowed_part(path: Column, allowed: list[str]) -> Column:
    """Whether any part of the path is in the list."""
    return F.arrays_overlap(F.split(path, "/"), F.array(*map(F.lit, allowed)))


def without_prompt(prediction: Column, prompt: Column) -> Column:
    """The generated text with the prompt taken out, stripped."""
    return T.strip(F.replace(prediction, prompt, F.lit("")))


def company_names(body: Column) -> Column:
    """Names in a JSON list of texts or of objects with a company, in an object with jobs, or in a plain text; stripped,
    each once (whatever its case), in order."""
    v = F.try_parse_json(body)
    listed = F.when(F.schema_of_variant(v).startswith("ARRAY"), v.try_cast("array<variant>"))
    jobs = F.when(F.schema_of_variant(v).startswith("OBJECT"), F.try_variant_get(v, "$.jobs", "array<variant>"))
    kind = F.schema_of_variant
    name = lambda x: F.when(kind(x) == "STRING", x.try_cast("string")).when(kind(x).startswith("OBJECT"), F.try_variant_get(x, "$.company", "string"))
    job = lambda x: F.when(kind(x).startswith("OBJECT"), F.try_variant_get(x, "$.company", "string"))
    found = F.coalesce(F.transform(listed, name), F.transform(jobs, job), F.when(v.isNull(), F.array(body)), F.array().cast("array<string>"))
    stripped = F.filter(F.transform(found, T.strip), lambda x: x != "")
    seen = F.aggregate(
        stripped, F.expr("cast(array() as array<string>)"),
        lambda acc, x: F.when(F.exists(acc, lambda y: F.lower(y) == F.lower(x)), acc).otherwise(F.concat(acc, F.array(x))),
    )
    return seen


def stream_tokens(line: Column) -> Column:
    """Tokens of a streamed line: usage and first data of a 'data: ' line, its body where that isn't JSON, any other line whole."""
    body = F.substr(line, F.lit(7))
    v = F.try_parse_json(body)
    fields = F.array(F.try_variant_get(v, "$.usage.completion_tokens", "string"), F.try_variant_get(v, "$.data[0].data", "string"))
    found = F.when(v.isNull(), F.array(body)).otherwise(F.filter(fields, lambda x: x.isNotNull()))
    return F.when(line == "", F.array().cast("array<string>")).when(line.startswith("data: "), found).otherwise(F.array(line))


def cached_read(reads: DataFrame, cache: DataFrame, store: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """reads (keys) with the value that the cache has, else the store's newest; keys that neither knows are dropped."""
    newest = lambda df, name: df.groupBy(*keys).agg(F.max_by(value, order).alias(name))
    found = reads.select(*keys).join(newest(cache, "_cached"), keys, "left").join(newest(store, "_stored"), keys, "left")
    out = F.coalesce("_cached", "_stored").alias(value)
    return found.where(F.coalesce("_cached", "_stored").isNotNull()).select(*keys, out, F.col("_cached").isNotNull().alias("cached"))


def apply_changes(store: DataFrame, updates: DataFrame, deleted: DataFrame, key: str, columns: list[str]) -> DataFrame:
    """store with columns replaced where an update of a known key gives them (an empty text is given, null isn't), and
    without the deleted keys."""
    new = updates.select(F.col(key).alias("_key"), *[F.col(c).alias(f"_new_{c}") for c in columns])
    out = store.join(new, store[key] == new["_key"], "left")
    out = out.withColumns({c: F.coalesce(f"_new_{c}", c) for c in columns}).drop("_key", *[f"_new_{c}" for c in columns])
    return out.join(deleted.select(key).distinct(), key, "left_anti")


def seeded_draw(index: Column, n: int, seed: str) -> Column:
    """A number below n for each index, the same in whatever order rows are drawn."""
    return corpus.bucket(F.concat(F.lit(seed + ":"), index.cast("string")), n)


def call_stats(calls: DataFrame, tool: str, failed: Column, ms: str) -> DataFrame:
    """Per tool: calls, errors and total_ms."""
    return calls.groupBy(tool).agg(F.count("*").alias("calls"), F.count_if(failed).alias("errors"), F.sum(ms).alias("total_ms"))


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _lines(s, d):
    """Documents as JSON lines of five shapes."""
    k, t = F.col("doc_id") % 5, F.col("text")
    message = F.to_json(F.struct(F.array(F.struct(F.lit("user").alias("role"), t.alias("content"))).alias("messages")))
    line = F.when(k == 0, message).when(k == 1, F.to_json(F.struct("text"))).when(k == 2, F.to_json(F.struct(F.lit("").alias("text"), t.alias("content"))))
    return _read(s, d, "documents").select("doc_id", line.when(k == 3, F.lit('{"other": 1}')).otherwise(F.lit("broken {")).alias("line"))


def _jobs(s, d):
    p, k = _read(s, d, "part"), F.col("p_partkey")
    pay = [F.when(k % 3 > 0, F.col("p_retailprice") * 100), F.when(k % 2 > 0, F.col("p_retailprice") * 150)]
    body = lambda **fields: F.to_json(F.struct(*[v.alias(n) for n, v in fields.items()]))
    nested = lambda c: F.struct(c.alias("display_name"))
    day = F.lit("2024-05-06T07:08:09")
    return p.select(
        "p_partkey",
        board_record(body(id=k, title=F.col("p_name"), company_name=F.col("p_type"), url=F.lit("u"), salary=F.lit("1k"), publication_date=day), "remotive").alias("a"),
        board_record(body(id=k, title=F.col("p_name"), company=nested(F.col("p_type")), redirect_url=F.lit("u"), location=nested(F.lit("here")), salary_min=pay[0], salary_max=pay[1], created=day), "adzuna").alias("b"),
        board_record(body(job_id=k, job_title=F.col("p_name"), employer_name=F.col("p_type"), job_google_link=F.lit("g"), job_country=F.lit("DE"), job_min_salary=pay[0], job_max_salary=pay[1], job_salary_period=F.lit("YEAR")), "jsearch").alias("c"),
    )


def _entities(s, d):
    e, k = _read(s, d, "events"), F.col("event_id")
    tag = F.element_at(F.array(*map(F.lit, ("LOC", "PER", "ORG", "MISC"))), (k % 4 + 1).cast("int"))
    one = lambda word: F.struct(word.alias("word"), tag.alias("tag"), k.alias("start"), (k + 3).alias("end"), F.col("value").alias("score"))
    named = name_entities(F.array(one(F.col("event_type")), one(F.lit("x"))), F.when(k % 5 == 0, "12345"), k + 9, k + 14)
    return e.select("event_id", F.posexplode(named).alias("pos", "e")).select("event_id", F.col("pos").cast("long").alias("pos"), "e.*")


def _context(s, d):
    c = adapters.messages_of(_read(s, d, "conversations"))
    built = assemble_context(F.concat(F.lit("Plan "), F.col("conv_id").cast("string")), F.col("messages"), F.col("conv_id").cast("string"), 3)
    return c.select("conv_id", F.posexplode(built).alias("pos", "m")).select("conv_id", F.col("pos").cast("long").alias("pos"), "m.role", "m.content")


def _shapes(s, d):
    k = F.col("event_id")
    a, b = F.concat(F.lit('"'), "event_type", F.lit('"')), F.concat(F.lit('{"company": " '), F.upper("event_type"), F.lit('"}'))
    body = (
        F.when(k % 4 == 0, F.concat(F.lit("["), a, F.lit(", "), b, F.lit(', "other", 7]'))).when(k % 4 == 1, F.concat(F.lit('{"jobs": ['), b, F.lit(', {"x": 1}]}')))
        .when(k % 4 == 2, F.concat(F.lit(" "), "event_type", F.lit(" ltd "))).otherwise(F.lit('{"none": 1}'))
    )
    return _read(s, d, "events").select("event_id", F.array_join(company_names(body), "|").alias("names"))


def _streamed(s, d):
    k, t = F.col("event_id"), F.col("event_type")
    line = (
        F.when(k % 5 == 0, F.concat(F.lit('data: {"usage": {"completion_tokens": '), k.cast("string"), F.lit("}}")))
        .when(k % 5 == 1, F.concat(F.lit('data: {"data": [{"data": "'), t, F.lit('"}]}'))).when(k % 5 == 2, F.concat(F.lit("data: broken "), t)).when(k % 5 == 3, t).otherwise("")
    )
    return _read(s, d, "events").select("event_id", F.explode(stream_tokens(line)).alias("token"))


def _cached(s, d):
    e = _read(s, d, "events").withColumn("value", F.col("event_id"))
    return cached_read(e.select("user_id", "event_type").distinct(), e.where("event_id % 7 = 0"), e.where("event_id % 2 = 0"), ["user_id", "event_type"], "event_id", "value")


def _workflow_runs(s, d):
    c = _read(s, d, "customer")
    updates = c.where("c_custkey % 3 = 0").select("c_custkey", F.when(F.col("c_custkey") % 2 == 0, "renamed").alias("c_name"))
    flows = apply_changes(c.select("c_custkey", "c_name"), updates, c.where("c_custkey % 10 = 0"), "c_custkey", ["c_name"])
    runs = _read(s, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("*").alias("runs"))
    return flows.join(runs, "c_custkey", "left").select("c_custkey", "c_name", F.coalesce("runs", F.lit(0)).alias("runs"))


def _formatted(s, d):
    made = isolated(lambda kind, k: f"{kind.upper()}:{100 // (k % 5)}")("event_type", "event_id")
    return _read(s, d, "events").select("event_id", made.alias("made")).where("made.ok").select("event_id", F.col("made.value").alias("text"))


def _generated(s, d):
    pairs = adapters.pairs_of(_read(s, d, "conversations"))
    made = F.concat("question", F.lit("\n "), "answer", F.lit(" "))
    return pairs.select("conv_id", "turn", without_prompt(made, F.col("question")).alias("prediction"), T.strip(made).alias("prediction_with_input"))


def _path():
    return F.concat_ws("/", F.lit("/data"), "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".wav")))


QUERIES = {
    "a16_instruction_pairs": lambda s, d: instruction_pairs(adapters.pairs_of(_read(s, d, "conversations")).withColumnsRenamed({"question": "instruction", "answer": "response"})),
    "a23_line_text": lambda s, d: _lines(s, d).select("doc_id", line_text(F.col("line")).alias("text")).where("text IS NOT NULL"),
    "a26_board_records": lambda s, d: _jobs(s, d).select("p_partkey", F.explode(F.array("a", "b", "c")).alias("r")).select("p_partkey", "r.*"),
    "a28_name_entities": _entities,
    "a30_history": lambda s, d: adapters.messages_of(_read(s, d, "conversations")).select("conv_id", F.array_join(F.transform(history(F.col("messages")), lambda m: F.concat(m["sender"], F.lit(": "), m["content"])), "\n").alias("history")),
    "a35_context": _context,
    "f05_error_isolation": _formatted,
    "f09_allowed_parts": lambda s, d: _read(s, d, "documents").where(on_allowed_part(_path(), ["src1", "fr", "missing"])).select("doc_id"),
    "f20_status_error": lambda s, d: _read(s, d, "events").select("event_id", status_error(F.when(F.col("event_id") % 3 == 0, "offer").when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise("")).alias("error")),
    "f22_required_columns": lambda s, d: require_columns(_read(s, d, "documents"), ["doc_id", "text"]).select("doc_id", F.length("text").cast("long").alias("n")),
    "k07_predictions": _generated,
    "n06_company_names": _shapes,
    "n07_stream_tokens": _streamed,
    "p05_workflow_runs": _workflow_runs,
    "r07_cached_read": _cached,
    "u17_seeded_draw": lambda s, d: _read(s, d, "documents").select("doc_id", seeded_draw(F.col("doc_id"), 25, "11").alias("n_nationkey")).join(_read(s, d, "nation"), "n_nationkey").select("doc_id", "n_name"),
    "y07_call_stats": lambda s, d: call_stats(_read(s, d, "events"), "event_type", F.col("event_id") % 7 == 0, "value").withColumn("total_ms", F.round("total_ms", 2)),
}

_PAY = """CASE WHEN p_partkey % 3 > 0 AND p_partkey % 2 > 0 THEN '$' || format('{:,}', trunc(p_retailprice * 100)::BIGINT) || ' – $' || format('{:,}', trunc(p_retailprice * 150)::BIGINT){more}
  WHEN p_partkey % 3 > 0 THEN 'From $' || format('{:,}', trunc(p_retailprice * 100)::BIGINT) ELSE '' END"""

SQL = {
    "a16_instruction_pairs": f"SELECT conv_id, turn, question AS input, answer AS output FROM {adapters.PAIRS_SQL}",
    "a23_line_text": f"""SELECT doc_id, text FROM (SELECT doc_id, CASE WHEN doc_id % 5 = 0 THEN '<|user|>' || chr(10) || coalesce(text, '') || chr(10) || '<|endoftext|>' WHEN doc_id % 5 < 3 THEN text END AS text FROM documents)
      WHERE {_STRIP('text')} <> ''""",
    "a26_board_records": f"""SELECT p_partkey, p_partkey::VARCHAR AS id, p_name AS title, p_type AS company, 'u' AS url, 'Worldwide' AS location, '1k' AS salary, '2024-05-06' AS date, 'Remotive' AS source FROM part
      UNION ALL SELECT p_partkey, p_partkey::VARCHAR, p_name, p_type, 'u', 'here', {_PAY.replace('{more}', '')}, '2024-05-06', 'Adzuna' FROM part
      UNION ALL SELECT p_partkey, p_partkey::VARCHAR, p_name, p_type, 'g', 'DE', {_PAY.replace('{more}', " || ' (YEAR)'")}, '', 'JSearch' FROM part""",
    "a28_name_entities": """SELECT event_id, 0 AS pos, event_type AS token, CASE event_id % 4 WHEN 0 THEN 'Location' WHEN 1 THEN 'Person' ELSE 'Organization' END AS tag, event_id AS start, event_id + 3 AS "end", value AS score FROM events
      UNION ALL SELECT event_id, 1, '12345', 'Location', event_id + 9, event_id + 14, 0.9852345 FROM events WHERE event_id % 5 = 0""",
    "a30_history": "SELECT conv_id, coalesce(string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text), '') AS history FROM conversations GROUP BY conv_id",
    "a35_context": """WITH t AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC, text DESC) AS back FROM conversations), h AS (SELECT conv_id, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY back DESC) AS pos FROM t WHERE back <= 3)
      SELECT DISTINCT conv_id, 0 AS pos, 'system' AS role, 'Plan ' || conv_id::VARCHAR AS content FROM h UNION ALL SELECT conv_id, pos, role, text FROM h UNION ALL SELECT conv_id, count(*) + 1, 'user', 'Goal: ' || conv_id::VARCHAR FROM h GROUP BY conv_id""",
    "f05_error_isolation": "SELECT event_id, upper(event_type) || ':' || (100 // (event_id % 5))::VARCHAR AS text FROM events WHERE event_id % 5 <> 0",
    "f09_allowed_parts": "SELECT doc_id FROM documents WHERE source = 'src1' OR lang = 'fr'",
    "f20_status_error": "SELECT event_id, CASE WHEN event_id % 3 = 1 THEN 'ERROR: Invalid status ''' || event_type || '''. Valid: applied, found, interviewing, offer, rejected, withdrawn' END AS error FROM events",
    "f22_required_columns": "SELECT doc_id, length(text) AS n FROM documents",
    "k07_predictions": f"SELECT conv_id, turn, {_STRIP('''replace(question || chr(10) || ' ' || answer || ' ', question, '')''')} AS prediction, {_STRIP('''question || chr(10) || ' ' || answer || ' ' ''')} AS prediction_with_input FROM {adapters.PAIRS_SQL}",
    "n06_company_names": "SELECT event_id, CASE event_id % 4 WHEN 0 THEN event_type || '|other' WHEN 1 THEN upper(event_type) WHEN 2 THEN event_type || ' ltd' ELSE '' END AS names FROM events",
    "n07_stream_tokens": "SELECT event_id, CASE event_id % 5 WHEN 0 THEN event_id::VARCHAR WHEN 1 THEN event_type WHEN 2 THEN 'broken ' || event_type ELSE event_type END AS token FROM events WHERE event_id % 5 < 4",
    "p05_workflow_runs": """SELECT c_custkey, CASE WHEN c_custkey % 6 = 0 THEN 'renamed' ELSE c_name END AS c_name, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey) AS runs FROM customer WHERE c_custkey % 10 <> 0""",
    "r07_cached_read": """SELECT user_id, event_type, coalesce(max(event_id) FILTER (event_id % 7 = 0), max(event_id) FILTER (event_id % 2 = 0)) AS value, count(*) FILTER (event_id % 7 = 0) > 0 AS cached FROM events
      GROUP BY user_id, event_type HAVING count(*) FILTER (event_id % 7 = 0 OR event_id % 2 = 0) > 0""",
    "u17_seeded_draw": "SELECT doc_id, n_name FROM documents JOIN nation ON n_nationkey = ('0x' || left(md5('11:' || doc_id::VARCHAR), 8))::BIGINT % 25",
    "y07_call_stats": "SELECT event_type, count(*) AS calls, count(*) FILTER (event_id % 7 = 0) AS errors, round(sum(value), 2) AS total_ms FROM events GROUP BY event_type",
}
