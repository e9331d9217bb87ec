"""Corpus building: budgets, quotas, interleaving, splits, mixtures, shards, chunks and packing.

Orders over a whole table use the two-level prefix sums of plans.prefix, so no task holds all rows, and neither does one
large source. Null texts count as empty; equal ids are broken by the columns named in `ties`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.plans import prefix


def estimated_tokens(text: Column) -> Column:
    """A token per four characters."""
    return F.floor(F.coalesce(F.length(text), F.lit(0)) / 4)


def within_budget(df: DataFrame, id_col: str, size: Column, limit: int, group: tuple[str, ...] = ()) -> DataFrame:
    """Rows in the order of id_col while the total before them is below limit; the row that crosses it is kept."""
    return prefix.total_before(df, id_col, F.coalesce(size, F.lit(0)), "_before_row", group=group).where(F.col("_before_row") < limit).drop("_before_row")


def first_rows(df: DataFrame, id_col: str, n: int | Column, group: tuple[str, ...] = ()) -> DataFrame:
    """The first n rows of each group in the order of id_col; n may be a column, and a null there keeps none."""
    return prefix.row_number(df, id_col, "_nth", group=group).where(F.col("_nth") <= n).drop("_nth")


def quotas(df: DataFrame, id_col: str, group: str, limits: dict[str, int], default: int) -> DataFrame:
    """At most limits[group] rows of each group, in the order of id_col."""
    pairs = [F.lit(x) for k, v in limits.items() for x in (k, v)]
    limit = F.coalesce(F.create_map(*pairs)[F.col(group)], F.lit(default)) if pairs else F.lit(default)
    return first_rows(df, id_col, limit, (group,))


def interleave(df: DataFrame, id_col: str, group: str, block: int, out: str = "position") -> DataFrame:
    """df with out: 0, 1, … in the order that takes block rows of each group by turns."""
    rows = prefix.row_number(df, id_col, "_nth", group=(group,)).withColumn("_turn", F.floor((F.col("_nth") - 1) / block))
    sizes = rows.groupBy("_turn", F.col(group).alias("_group")).agg(F.count("*").alias("_size")).withColumnRenamed("_turn", "_at")
    turns = sizes.groupBy("_at").agg(F.sum("_size").alias("_all"))
    turns = prefix.total_before(turns, "_at", F.col("_all"), "_start").select("_at", "_start")
    within = Window.partitionBy("_at").orderBy(F.col("_group").asc_nulls_first())
    sizes = sizes.withColumn("_offset", F.sum("_size").over(within) - F.col("_size")).join(turns, "_at").drop("_size")
    joined = rows.join(sizes, (rows["_turn"] == sizes["_at"]) & rows[group].eqNullSafe(sizes["_group"]))
    place = F.col("_start") + F.col("_offset") + (F.col("_nth") - 1) % block
    return joined.withColumn(out, place.cast("long")).drop("_nth", "_turn", "_at", "_group", "_start", "_offset")


def buffered_shuffle(df: DataFrame, size: int = 10_000, seed: int = 42) -> DataFrame:
    """df's rows, each partition's in a seeded order, with a buffer of so many rows and no shuffle between tasks.

    A partition's rows stream through: each that comes takes a random place in the full buffer, and what was there goes on;
    at the end the rest goes on in random order. So a row moves forward by at most size places, however long the
    partition, and a task holds the buffer and a batch. Reruns agree where partitions hold the same rows in the same order."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rng, held = np.random.default_rng([seed, TaskContext.get().partitionId()]), None
        for batch in batches:
            rows = pa.Table.from_batches([batch])
            rows = pa.concat_tables([held, rows]) if held is not None else rows
            here = min(size, rows.num_rows)
            places, out = list(range(here)), []
            for i, at in enumerate(rng.integers(0, size, rows.num_rows - here).tolist(), start=here):
                out.append(places[at])
                places[at] = i
            if out:
                yield from rows.take(out).combine_chunks().to_batches()
            held = rows.take(places).combine_chunks()
        if held is not None and held.num_rows:
            yield from held.take(rng.permutation(held.num_rows)).combine_chunks().to_batches()

    return df.mapInArrow(run, df.schema)


def chunk_numbers(df: DataFrame, id_col: str, size: int, out: str = "chunk") -> DataFrame:
    """df with out: 0 for the first size rows, 1 for the next, and so on."""
    return prefix.row_number(df, id_col, "_nth").withColumn(out, F.floor((F.col("_nth") - 1) / size)).drop("_nth")


def positional_split(df: DataFrame, id_col: str, share: float, out: str = "split") -> DataFrame:
    """df with out: train for the first floor(share * rows) rows, else val."""
    total = df.agg(F.count("*").alias("_total"))  # one row
    rows = prefix.row_number(df, id_col, "_nth").crossJoin(F.broadcast(total))
    return rows.withColumn(out, F.when(F.col("_nth") <= F.floor(F.col("_total") * share), "train").otherwise("val")).drop("_nth", "_total")


def bucket(key: Column, n: int, seed: str = "") -> Column:
    """A number below n by the MD5 of the key's text, the same in any engine and partitioning."""
    return F.conv(F.substring(F.md5(F.concat(F.lit(seed), key.cast("string")).cast("binary")), 1, 8), 16, 10).cast("long") % n


def hash_split(df: DataFrame, key: Column, permille: int, seed: str = "", out: str = "split") -> DataFrame:
    """df with out: test for about permille of 1000 keys, else train; all rows of a key go together."""
    return df.withColumn(out, F.when(bucket(key, 1000, seed) < permille, "test").otherwise("train"))


def held_out_groups(df: DataFrame, key: str, n: int, seed: str = "", out: str = "split") -> DataFrame:
    """df with out: val for the n groups of least hash, else train."""
    keys = df.select(F.col(key).alias("_key")).where("_key is not null").distinct()
    order = F.md5(F.concat(F.lit(seed), F.col("_key").cast("string")).cast("binary"))
    held = keys.orderBy(order, "_key").limit(n)
    return df.join(held, df[key] == held["_key"], "left").withColumn(out, F.when(F.col("_key").isNotNull(), "val").otherwise("train")).drop("_key")


def shuffled(df: DataFrame, id_col: str, seed: str, n: int) -> DataFrame:
    """The first n rows in the order of the seeded hash of their id."""
    return df.orderBy(F.md5(F.concat(F.lit(seed), F.col(id_col).cast("string")).cast("binary")), id_col).limit(n)


def mixture_quotas(df: DataFrame, group: str, weights: dict[str, float], total: int) -> DataFrame:
    """(group, weight, quota): the groups present that have a weight share total by largest remainder."""
    pairs = F.create_map(*[F.lit(x) for k, v in weights.items() for x in (k, float(v))])
    found = df.groupBy(group).agg(F.lit(None).cast("int").alias("_")).select(group, pairs[F.col(group)].alias("weight")).where("weight > 0")
    everything, order = Window.partitionBy(), Window.orderBy(F.desc("_rest"), group)  # a row per source
    found = found.withColumn("weight", F.col("weight") / F.sum("weight").over(everything))
    found = found.withColumn("_floor", F.floor(F.round(F.col("weight") * total, 9))).withColumn("_rest", F.round(F.col("weight") * total - F.col("_floor"), 9))
    left = F.lit(total) - F.sum("_floor").over(everything)
    return found.withColumn("quota", F.col("_floor") + (F.row_number().over(order) <= left).cast("long")).select(group, "weight", "quota")


def shard(df: DataFrame, id_col: str, n: int, rank: int) -> DataFrame:
    """Every n-th row, from the rank-th."""
    return prefix.row_number(df, id_col, "_nth").where((F.col("_nth") - 1) % n == rank).drop("_nth")


def repeat_batches(df: DataFrame, id_col: str, epochs: int, batch: int) -> DataFrame:
    """Rows repeated per epoch and dealt to full batches of an epoch; the remainder is dropped. Adds epoch and batch."""
    total = df.agg(F.count("*").alias("_total"))
    rows = prefix.row_number(df, id_col, "_nth").crossJoin(F.broadcast(total)).withColumn("batch", F.floor((F.col("_nth") - 1) / batch))
    rows = rows.where(F.col("batch") < F.floor(F.col("_total") / batch))
    return rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).drop("_nth", "_total")


def pack(df: DataFrame, id_col: str, tokens: Column, length: int, group: str) -> DataFrame:
    """(group, chunk, tokens): the tokens of each group, one document after the other, cut to length; the rest is dropped.

    A document travels once, as it is in df, and is cut to tokens where it arrives; tokens is computed twice. Chunks that lie in
    one document stay there, so only what a document has of its first and last chunk travels again.
    """
    rows = df.withColumn("_n", F.greatest(F.coalesce(F.size(tokens), F.lit(0)), F.lit(0)))
    rows = prefix.total_before(rows, id_col, F.col("_n"), "_at", group=(group,)).where("_n > 0")
    end, rows = F.col("_at") + F.col("_n"), rows.select(group, tokens.alias("_tokens"), "_at", "_n")
    first, last = F.floor(F.col("_at") / length), F.floor((end - 1) / length)
    inner, after = F.ceil(F.col("_at") / length), F.floor(end / length)  # chunks that begin here, up to the one that doesn't end here

    def part(chunk: Column) -> Column:
        start = F.greatest(chunk * length - F.col("_at"), F.lit(0))
        stop = F.least((chunk + 1) * length - F.col("_at"), F.col("_n"))
        piece = F.slice("_tokens", (start + 1).cast("int"), (stop - start).cast("int"))
        return F.struct(chunk.alias("chunk"), (F.col("_at") + start).alias("at"), piece.alias("tokens"))

    def parts(chunks: Column) -> DataFrame:
        # cut before exploding: an exploded row holds its piece, not the whole document; _outer: the plain form would cut twice
        return rows.select(group, F.explode_outer(F.transform(chunks, part)).alias("_p")).select(group, "_p.*").where("chunk IS NOT NULL")

    whole = parts(F.when(inner < after, F.sequence(inner, after - 1))).select(group, "chunk", "tokens")
    edges = parts(F.array_distinct(F.array(first, last))).where(F.size("tokens") < length)
    pieces = F.array_sort(F.collect_list(F.struct("at", "tokens")))
    joined = edges.groupBy(group, "chunk").agg(F.flatten(F.transform(pieces, lambda p: p["tokens"])).alias("tokens"))
    return whole.union(joined.where(F.size("tokens") == length))


def _docs(s, d):
    return s.read.parquet(f"{d}/documents.parquet")


WEIGHTS = {"src0": 0.8, "src1": 0.04, "src2": 0.04, "src3": 0.04, "src4": 0.04, "src5": 0.04, "absent": 0.1}

QUERIES = {
    "s10_take": lambda s, d: first_rows(_docs(s, d), "doc_id", 100).select("doc_id"),
    "s20_truncated_read": lambda s, d: _docs(s, d).select("doc_id", T.truncate(F.col("text"), 200).alias("text")),
    "k03_chunks": lambda s, d: chunk_numbers(_docs(s, d), "doc_id", 300).groupBy("chunk").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_id"), F.max("doc_id").alias("last_id")),
    "k05_concatenate": lambda s, d: _docs(s, d).select("doc_id", "text").unionByName(s.read.parquet(f"{d}/benchmark.parquet").select(F.col("item_id").alias("doc_id"), "text", F.lit("benchmark").alias("part")), allowMissingColumns=True),
    "w01_prefix_budget": lambda s, d: within_budget(_docs(s, d), "doc_id", estimated_tokens(F.col("text")), 100_000).select("doc_id"),
    "w01_byte_budget": lambda s, d: within_budget(_docs(s, d), "doc_id", F.octet_length("text") + 1, 20_000, ("source",)).select("doc_id", "source"),
    "w02_sample_cap": lambda s, d: _docs(s, d).orderBy("source", "doc_id").limit(333).select("doc_id", "source"),
    "w03_interleave": lambda s, d: interleave(_docs(s, d), "doc_id", "source", 7).select("doc_id", "position"),
    "w15_buffered_shuffle": lambda s, d: buffered_shuffle(_docs(s, d).select("doc_id", F.length("text").alias("chars"))),
    "w16_shuffle_take": lambda s, d: shuffled(_docs(s, d), "doc_id", "42-", 50).select("doc_id"),
    "w18_pack": lambda s, d: pack(_docs(s, d), "doc_id", T.tokens(F.col("text")), 33, "source").select("source", "chunk", F.array_join(F.slice("tokens", 1, 32), " ").alias("inputs"), F.array_join(F.slice("tokens", 2, 32), " ").alias("targets")),
    "u07_positional_split": lambda s, d: positional_split(_docs(s, d), "doc_id", 0.95).select("doc_id", "split"),
    "u08_hash_split": lambda s, d: hash_split(_docs(s, d), F.col("doc_id"), 100, "7-").select("doc_id", "split"),
    "u09_held_out_groups": lambda s, d: held_out_groups(_docs(s, d), "source", 3, "7-").select("doc_id", "split"),
    "u10_quotas": lambda s, d: quotas(_docs(s, d), "doc_id", "source", {"src0": 5, "src1": 30}, 20).select("doc_id", "source"),
    "u11_oversample": lambda s, d: first_rows(_docs(s, d), "doc_id", int(300 * 1.1)).where(F.length("text") >= 200).select("doc_id"),
    "u12_mixture_quotas": lambda s, d: mixture_quotas(_docs(s, d), "source", WEIGHTS, 1000).withColumn("weight", F.round("weight", 6)),
    "u13_shard": lambda s, d: shard(_docs(s, d), "doc_id", 8, 3).select("doc_id"),
    "u14_batches": lambda s, d: repeat_batches(_docs(s, d), "doc_id", 2, 64).select("doc_id", F.col("epoch").cast("long").alias("epoch"), "batch"),
    "u15_take": lambda s, d: first_rows(_docs(s, d), "doc_id", 3, ("lang",)).select("doc_id", "lang"),
    "g08_token_totals": lambda s, d: _docs(s, d).groupBy("source").agg(F.sum(F.size(T.tokens(F.col("text")))).alias("tokens")),
    "g09_estimated_tokens": lambda s, d: _docs(s, d).select("doc_id", estimated_tokens(F.col("text")).alias("tokens")),
    "g10_bytes": lambda s, d: _docs(s, d).agg(F.sum(F.octet_length("text") + 1).alias("bytes")),
    "g11_loader_counters": lambda s, d: _docs(s, d).groupBy("source").agg(
        F.count_if(~T.is_blank(F.col("text"))).alias("processed"), F.count_if(T.is_blank(F.col("text"))).alias("skipped"), F.sum(estimated_tokens(F.col("text"))).alias("tokens")
    ),
    "g31_size_share": lambda s, d: _docs(s, d).groupBy("source").agg(F.sum("n_chars").alias("size")).withColumn("share", F.round(F.col("size") / F.sum("size").over(Window.partitionBy()), 6)),
    "t06_append_end": lambda s, d: _docs(s, d).select("doc_id", F.array_join(F.array_append(T.tokens(F.col("text")), F.lit("<|endoftext|>")), " ").alias("text")),
    "flagship_token_supply": lambda s, d: within_budget(
        quotas(_docs(s, d).where(~T.is_blank(F.col("text"))), "doc_id", "source", {}, 40), "doc_id", estimated_tokens(F.col("text")), 300_000
    ).groupBy("source").agg(F.count("*").alias("docs"), F.sum(estimated_tokens(F.col("text"))).alias("tokens")),
}

_TOKENS = r"list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> '')"
_EST = "coalesce(length(text), 0) // 4"
_BLANK = r"NOT regexp_matches(coalesce(text, ''), '[^\s\x{0B}\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]')"
_WEIGHTS = ", ".join(f"('{k}', {v})" for k, v in WEIGHTS.items())

SQL = {
    "s10_take": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100",
    "s20_truncated_read": "SELECT doc_id, CASE WHEN length(text) > 200 THEN left(text, 200) || chr(10) || chr(10) || '...[truncated]' ELSE text END AS text FROM documents",
    "k03_chunks": "SELECT chunk, count(*) AS n, min(doc_id) AS first_id, max(doc_id) AS last_id FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 300 AS chunk FROM documents) GROUP BY chunk",
    "k05_concatenate": "SELECT doc_id, text, NULL::VARCHAR AS part FROM documents UNION ALL SELECT item_id, text, 'benchmark' FROM benchmark",
    "w01_prefix_budget": f"SELECT doc_id FROM (SELECT doc_id, coalesce(sum({_EST}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 100000",
    "w01_byte_budget": "SELECT doc_id, source FROM (SELECT doc_id, source, coalesce(sum(coalesce(strlen(text) + 1, 0)) OVER (PARTITION BY source ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM documents) WHERE b < 20000",
    "w02_sample_cap": "SELECT doc_id, source FROM documents ORDER BY source NULLS FIRST, doc_id LIMIT 333",
    "w03_interleave": """SELECT doc_id, row_number() OVER (ORDER BY (rn - 1) // 7, source NULLS FIRST, rn) - 1 AS position
      FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents)""",
    "w15_buffered_shuffle": "SELECT doc_id, length(text)::INT AS chars FROM documents",
    "w16_shuffle_take": "SELECT doc_id FROM documents ORDER BY md5('42-' || doc_id::VARCHAR), doc_id LIMIT 50",
    "w18_pack": f"""SELECT source, chunk, array_to_string(t[1:32], ' ') AS inputs, array_to_string(t[2:33], ' ') AS targets FROM (
      SELECT source, chunk, list(w ORDER BY g) AS t FROM (
        SELECT source, w, g, g // 33 AS chunk FROM (
          SELECT source, w, row_number() OVER (PARTITION BY source ORDER BY doc_id, pos) - 1 AS g FROM (
            SELECT source, doc_id, unnest(t) AS w, generate_subscripts(t, 1) AS pos FROM (SELECT source, doc_id, {_TOKENS} AS t FROM documents))))
      GROUP BY source, chunk HAVING count(*) = 33)""",
    "u07_positional_split": "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY doc_id) <= floor(count(*) OVER () * 0.95::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM documents",
    "u08_hash_split": "SELECT doc_id, CASE WHEN ('0x' || left(md5('7-' || doc_id::VARCHAR), 8))::BIGINT % 1000 < 100 THEN 'test' ELSE 'train' END AS split FROM documents",
    "u09_held_out_groups": """SELECT doc_id, CASE WHEN source IN (SELECT source FROM (SELECT DISTINCT source FROM documents WHERE source IS NOT NULL) ORDER BY md5('7-' || source), source LIMIT 3)
      THEN 'val' ELSE 'train' END AS split FROM documents""",
    "u10_quotas": "SELECT doc_id, source FROM (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents) WHERE rn <= CASE source WHEN 'src0' THEN 5 WHEN 'src1' THEN 30 ELSE 20 END",
    "u11_oversample": "SELECT doc_id FROM (SELECT doc_id, text FROM documents ORDER BY doc_id LIMIT 330) WHERE length(text) >= 200",
    "u12_mixture_quotas": f"""WITH w(source, weight) AS (VALUES {_WEIGHTS}), p AS (SELECT source, weight::DOUBLE / sum(weight::DOUBLE) OVER () AS weight FROM w WHERE source IN (SELECT source FROM documents)),
      f AS (SELECT *, floor(round(weight * 1000, 9)) AS fl, round(weight * 1000 - floor(round(weight * 1000, 9)), 9) AS rest FROM p)
      SELECT source, round(weight, 6) AS weight, (fl + CASE WHEN row_number() OVER (ORDER BY rest DESC, source) <= 1000 - sum(fl) OVER () THEN 1 ELSE 0 END)::BIGINT AS quota FROM f""",
    "u13_shard": "SELECT doc_id FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS rn FROM documents) WHERE (rn - 1) % 8 = 3",
    "u14_batches": "SELECT doc_id, epoch, b AS batch FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // 64 AS b, count(*) OVER () AS n FROM documents), (VALUES (1::BIGINT), (2::BIGINT)) e(epoch) WHERE b < n // 64",
    "u15_take": "SELECT doc_id, lang FROM (SELECT doc_id, lang, row_number() OVER (PARTITION BY lang ORDER BY doc_id) AS rn FROM documents) WHERE rn <= 3",
    "g08_token_totals": f"SELECT source, sum(len({_TOKENS}))::BIGINT AS tokens FROM documents GROUP BY source",
    "g09_estimated_tokens": f"SELECT doc_id, {_EST} AS tokens FROM documents",
    "g10_bytes": "SELECT sum(strlen(text) + 1)::BIGINT AS bytes FROM documents",
    "g11_loader_counters": f"SELECT source, count(*) FILTER (NOT {_BLANK}) AS processed, count(*) FILTER ({_BLANK}) AS skipped, sum({_EST})::BIGINT AS tokens FROM documents GROUP BY source",
    "g31_size_share": "SELECT source, sum(n_chars)::BIGINT AS size, round(sum(n_chars) / sum(sum(n_chars)) OVER (), 6) AS share FROM documents GROUP BY source",
    "t06_append_end": f"SELECT doc_id, array_to_string(list_append({_TOKENS}, '<|endoftext|>'), ' ') AS text FROM documents",
    "flagship_token_supply": f"""SELECT source, count(*) AS docs, sum({_EST})::BIGINT AS tokens FROM (
      SELECT *, coalesce(sum({_EST}) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (
        SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) AS rn FROM documents WHERE NOT ({_BLANK})) WHERE rn <= 40) WHERE b < 300000 GROUP BY source""",
}
