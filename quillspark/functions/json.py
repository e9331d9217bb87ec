"""JSON of unknown shape: finding records, fields by alias, JSON in prose, references, stream lines, coercion."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Keys under which a list of records may stand, in order, and the aliases of two fields.
LIST_KEYS = ["jobs", "results", "data", "items", "postings", "positions", "openings", "hits", "records", "listings"]
TITLE = ["title", "name", "jobTitle", "position"]
COMPANY = ["company.name", "company", "companyName", "employer", "organization"]


def records(body: Column) -> Column:
    """The list of records as JSON text: the whole if it is a list, else that under the first known key holding one; null if none."""
    whole = F.when(F.trim(body).startswith("[") & F.json_array_length(body).isNotNull(), body)
    listed = [F.get_json_object(body, f"$.{k}") for k in LIST_KEYS]
    return F.coalesce(whole, *[F.when(x.startswith("["), x) for x in listed])


def n_records(body: Column) -> Column:
    return F.coalesce(F.json_array_length(records(body)), F.lit(0))


def record_fields(body: Column) -> Column:
    """Title and company of the first record, or of the body itself; empty and object values count as missing."""
    first = F.coalesce(F.get_json_object(records(body), "$[0]"), body)

    def pick(names: list[str]) -> Column:
        values = [F.get_json_object(first, f"$.{n}") for n in names]
        return F.coalesce(*[F.when((v != "") & ~v.startswith("{"), v) for v in values], F.lit(""))

    return F.struct(pick(TITLE).alias("title"), pick(COMPANY).alias("company"))


def first_json(text: Column) -> Column:
    """JSON in prose: a fenced block, else the whole, else what stands between the first and last brace; null if none parses."""
    fenced = F.regexp_extract(text, r"(?s)```(?:json)?\s*(.*?)```", 1)
    braces = F.regexp_extract(text, r"(?s)(\{.*\})", 1)
    tries = [F.trim(fenced), F.trim(text), braces]
    return F.coalesce(*[F.when(x != "", F.to_json(F.try_parse_json(x))) for x in tries])


def resolve(reference: Column, outputs: Column) -> Column:
    """$steps.<id>.output looked up in a map; other text stays as it is."""
    parts = F.split(reference, r"\.")
    is_ref = reference.startswith("$steps.") & (F.size(parts) >= 3)
    return F.when(is_ref, F.try_element_at(outputs, F.get(parts, F.lit(1)))).otherwise(reference)


def delta(line: Column) -> Column:
    """Text of a streamed chat line; null for other lines, the end mark and broken JSON."""
    body = F.when(line.startswith("data: ") & (line != "data: [DONE]"), F.substr(line, F.lit(7)))
    return F.get_json_object(body, "$.choices[0].delta.content")


def coerce(value: Column, kind: str) -> Column:
    """value as kind (int, number, boolean, string); null where it can't be."""
    if kind == "int":
        return value.try_cast("long")
    if kind == "number":
        return value.try_cast("double")
    if kind == "boolean":
        return F.lower(F.trim(value)).isin("true", "1", "yes")
    return value.cast("string")
