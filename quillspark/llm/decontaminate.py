"""Benchmark decontamination with a broadcast set of word n-grams, in DataFrame functions alone.

Benchmark items give their distinct windows of n words (an item of fewer words is one window). Each document's windows
are hashed to 64 bits row by row and looked up in the broadcast set; only hits are kept, one row per document and window
with its places. A window's list of items joins those rows, so it travels once per document that holds the window. The
hits then join the documents, where the words themselves verify them. Documents without a hit aren't shuffled: a
broadcast list of the keys with hits tells them apart.

The set is broadcast up to `broadcast_bytes` (measured first), the list of keys up to `broadcast_keys` (counted first);
beyond that each lookup is a shuffled join of the same result.

Edge cases: null or empty text, and text of punctuation only, has no words and no hits, and is not contaminated. Items
without words are ignored; an item without an id marks words but isn't listed. Repeated rows are judged alike, and so
are rows that share an id. Empty tables give no hits or no rows. Other columns pass through untouched.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, read, table

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
NO_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def normalised_words(text: Column) -> Column:
    """Lower-case A-Z; words are runs of ASCII letters, digits and all characters beyond ASCII."""
    lower = F.translate(F.coalesce(text.cast("string"), F.lit("")), UPPER, LOWER)
    return F.array_remove(F.split(lower, NO_WORD), "")


def benchmark_windows(benchmark: DataFrame, n: int, id_col: str, text_col: str) -> DataFrame:
    """Distinct windows: length, hash (of word hashes), gram (its words) and the item ids as sorted strings."""
    items = benchmark.select(F.col(id_col).cast("string").alias("item"), normalised_words(F.col(text_col)).alias("words")).where(F.size("words") > 0)
    items = items.withColumn("length", F.least(F.lit(n), F.size("words")))
    grams = items.select("item", "length", F.explode(F.expr("transform(sequence(1, size(words) - length + 1), i -> slice(words, i, length))")).alias("gram"))
    grams = grams.groupBy("length", "gram").agg(F.array_sort(F.collect_set("item")).alias("items"))
    return grams.select("length", F.xxhash64(F.transform("gram", lambda w: F.xxhash64(w))).alias("hash"), F.concat_ws(" ", "gram").alias("gram"), "items")


def find_hits(docs: DataFrame, grams: DataFrame, id_col: str, text_col: str, broadcast_bytes: int) -> DataFrame:
    """(key, hits) for documents with windows whose hash is in the set; key tells rows of equal id apart by their text."""
    lengths = [r[0] for r in grams.select("length").distinct().collect()]  # at most n
    size = F.octet_length("gram") + F.coalesce(F.octet_length(F.concat_ws(",", "items")), F.lit(0)) + 64
    small = (grams.agg(F.sum(size)).first()[0] or 0) <= broadcast_bytes
    held = F.broadcast if small else _merged
    hashes = docs.select(_key(id_col, text_col), F.transform(normalised_words(F.col(text_col)), lambda w: F.xxhash64(w)).alias("words"))
    windows = [
        F.expr(
            f"if(size(words) >= {k}, transform(sequence(1, size(words) - {k} + 1),"
            f" i -> struct({k} as length, i as at, xxhash64(slice(words, i, {k})) as hash)), array())"
        )
        for k in sorted(lengths)
    ] or [F.expr("cast(array() as array<struct<length: int, at: int, hash: bigint>>)")]
    windows = hashes.select("key", F.inline(F.concat(*windows)))
    found = windows.join(held(grams.select("length", "hash", "gram")), ["length", "hash"])
    # sets, as rows that share id and text share a key: no group outgrows its document
    found = found.groupBy("key", "length", "gram").agg(F.collect_set("at").alias("places"))
    found = found.join(held(grams.select("gram", "items")), "gram")
    return found.groupBy("key").agg(F.collect_list(F.struct("length", "gram", "places", "items")).alias("hits"))


def _merged(df: DataFrame) -> DataFrame:
    """df, to be joined by sorting. Spark judges a written table by its compressed files: hits repeat the same words and take
    up 30 times theirs, so Spark would collect and broadcast them."""
    return df.hint("merge")


def _key(id_col: str, text_col: str) -> Column:
    return F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string")).alias("key")


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, n: int = 13, id_col: str = "doc_id", text_col: str = "text",
    item_id_col: str = "item_id", item_text_col: str = "text", broadcast_bytes: int = 1 << 26, broadcast_keys: int = 1_000_000,
) -> DataFrame:
    """All rows and columns of docs plus one struct column `contamination` (replaced where it exists).

    Its fields: n_words, n_hit (words inside a window), items (sorted ids of the items hit, as strings), contaminated
    (n_hit > 0 and 20 * n_hit >= n_words) and clean_text: the normalised words outside all hits, joined by one space,
    for users who remove spans in place of documents.
    """
    grams = table(benchmark_windows(benchmark, n, item_id_col, item_text_col), "windows")
    hits = table(find_hits(docs, grams, id_col, text_col, broadcast_bytes), "hits")
    drop_table(grams)
    columns = [F.col(f"d.`{c}`") for c in docs.columns if c.lower() != "contamination"]
    held = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), _key(id_col, text_col))
    if hits.count() <= broadcast_keys:
        keys = F.broadcast(hits.select("key"))
        none = F.lit(None).cast(hits.schema["hits"].dataType).alias("hits")
        both = held.join(keys, "key", "left_semi").join(_merged(hits), "key").select("d", "hits")
        both = both.unionByName(held.join(keys, "key", "left_anti").select("d", none))
    else:
        both = held.join(_merged(hits), "key", "left")
    both = both.select("d", normalised_words(F.col(f"d.`{text_col}`")).alias("words"), "hits")
    verified = F.expr(
        "filter(transform(coalesce(hits, array()), h -> named_struct('length', h.length, 'items', h.items, 'places',"
        " filter(h.places, p -> concat_ws(' ', slice(words, p, h.length)) = h.gram))), h -> size(h.places) > 0)"
    )
    both = both.withColumn("hits", verified)
    places = F.expr("array_distinct(flatten(flatten(transform(hits, h -> transform(h.places, p -> sequence(p, p + h.length - 1))))))")
    both = both.select(
        "d", "words", places.alias("places"),
        F.array_sort(F.array_distinct(F.flatten(F.transform("hits", lambda h: h["items"])))).alias("items"),
    )
    n_hit, n_words = F.size("places").cast("long"), F.size("words").cast("long")
    outside = F.expr(
        "if(size(places) = 0, words, transform(array_except(sequence(1, greatest(size(words), 1)), places), i -> try_element_at(words, i)))"
    )
    return both.select(
        *columns,
        F.struct(
            n_words.alias("n_words"), n_hit.alias("n_hit"), F.col("items"),
            ((n_hit > 0) & (20 * n_hit >= n_words)).alias("contaminated"),
            F.concat_ws(" ", outside).alias("clean_text"),
        ).alias("contamination"),
    )


def op5_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = decontaminate(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    c = "contamination"
    return out.select(
        "doc_id", f"{c}.n_words", f"{c}.n_hit", F.size(f"{c}.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", f"{c}.items"), 256).alias("items_sha256"), f"{c}.contaminated",
    )


OP5_SQL = r"""
WITH d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
g AS (
  SELECT DISTINCT item_id, l, array_to_string(w[i:i + l - 1], ' ') AS gram
  FROM (SELECT item_id, w, l, unnest(range(1, len(w) - l + 2)) AS i
        FROM (SELECT item_id, w, least(13, len(w)) AS l FROM b WHERE len(w) > 0))),
h AS (
  SELECT DISTINCT doc_id, i, l, item_id
  FROM (SELECT doc_id, l, i, array_to_string(w[i:i + l - 1], ' ') AS gram
        FROM (SELECT doc_id, w, l, unnest(range(1, len(w) - l + 2)) AS i FROM d, (SELECT DISTINCT l FROM g) WHERE len(w) >= l))
  JOIN g USING (l, gram)),
p AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + l)) AS at FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS items
      FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM h WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN p USING (doc_id) LEFT JOIN t USING (doc_id)
"""
