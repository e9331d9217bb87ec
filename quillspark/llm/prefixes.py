"""The trie of conversation prefixes, by ROLLUP over columns of turn ids.

Turns are equal if their role and text are. A turn's id is 128 bits of a SHA-256 of both and the length of its text. A
conversation is cut into blocks of WIDTH turns, a row each with the turn ids in columns t1, t2, … and the key of the node
at which the block before ended. GROUP BY block and node, ROLLUP (t1, t2, …) then aggregates the prefixes of all lengths of
all conversations together, and grouping_id tells a prefix's length. A node's key is its depth and 128 bits that combine
its turns' ids and places, so later blocks need not wait for earlier ones: however long conversations get, there is one
ROLLUP over all blocks for each of two passes.

The first pass gives each node its members' number and least id. A conversation is the least member of the nodes from some
depth on, or of none. In these terms all else is a sum over a node's members alone, which the second pass takes: a child
node or a leaf counts for its least member, and tokens are saved by every member that isn't the least.

A node with very many members is aggregated where rows lie before anything is shuffled. Places of turns, and what a long
conversation's block inherits from those before it, come from scans that cut a long conversation into pieces. The ids that
end at a node are joined in ranges of ids and hashed as a stream, so no list of them is held whole.

Edge cases: null role and text become empty. Null turns come first; turns of equal number are ordered by role and text,
and repeated rows are turns of their own. Rows without a conversation id belong to no conversation and are left out. An
empty table gives no rows, not even a root. Columns are renamed on entry, so other columns' names can't clash.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quillspark.plans import prefix
from quillspark.plans.scan import Scan, row_number, running, scan, whole

from .common import drop_table, n_partitions, read, table

WIDTH = 8
TURNS = [f"t{i}" for i in range(1, WIDTH + 1)]


def _xor(values: list[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseXOR(b), values)


def mixed(value: Column) -> Scan:
    """The exclusive or of the key's rows before this one."""
    before = lambda w: w.rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long"))
    return Scan(lambda _: F.bit_xor(value), lambda s, w: F.bit_xor(s).over(before(w)), lambda c, w: zero(c).bitwiseXOR(zero(F.bit_xor(value).over(before(w)))))


def turn_ids(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """(conv, pos, id): each conversation's turns, numbered from 1. The last four bytes of an id are its text's length."""
    kinds = {"conv": "long", "turn": conversations.schema[turn_col].dataType.simpleString(), "role": "string", "text": "string"}
    cols = zip((conv_col, turn_col, role_col, text_col), kinds.items(), strict=True)
    rows = conversations.select(*[F.col(c).cast(kind).alias(name) for c, (name, kind) in cols]).where("conv IS NOT NULL")
    rows = rows.fillna("", ["role", "text"])
    size = F.octet_length("text")
    same = F.unhex(F.sha2(F.encode(F.concat_ws(":", F.octet_length("role").cast("string"), "role", "text"), "utf-8"), 256))
    turn = F.concat(F.substring(same, 1, 16), F.unhex(F.lpad(F.hex(size.cast("long")), 8, "0")))
    rows = scan(rows.withColumn("id", turn), "conv", ["turn", "role", "text"], {"pos": row_number()})
    return rows.select("conv", F.col("pos").cast("long").alias("pos"), "id")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The query's conversations: (conv, pos, id) of turns and (conv, size) of all conversations, also of those without turns."""
    sizes = turns.groupBy("conv").agg(F.max("pos").alias("own"))
    first = F.crc32(F.col("conv").cast("string").cast("binary")) % 9
    model = F.col("conv") - F.col("conv") % 5
    convs = sizes.select("conv", "own", first.alias("h"), model.alias("model"))
    convs = convs.join(sizes.select(F.col("conv").alias("model"), F.col("own").alias("theirs")), "model", "left")
    taken = F.least("h", F.coalesce("theirs", F.lit(0)))
    convs = table(convs.select("conv", "model", "h", taken.alias("taken"), (taken + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("size")), "conversations")
    front = turns.where(F.col("pos") <= 8).withColumnRenamed("conv", "model").join(convs, "model").where("pos <= h").select("conv", "pos", "id")
    rest = turns.join(convs, "conv").where("pos > h").select("conv", (F.col("pos") - F.col("h") + F.col("taken")).alias("pos"), "id")
    return front.union(rest), convs.select("conv", "size")


def _size_of(turn: Column) -> Column:
    return F.coalesce(F.conv(F.hex(F.substring(turn, 17, 4)), 16, 10).cast("long"), F.lit(0).cast("long"))


def _marks(place: Column, turn: Column) -> tuple[Column, Column]:
    return F.xxhash64(place, turn), F.xxhash64(turn, place, F.lit("2"))


def blocks(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """A row per block: conv, size, block, t1 …, x1 and x2 (the node before), before and total (bytes of text)."""
    place = (F.col("pos") - 1) % WIDTH
    held = turns.groupBy("conv", F.floor((F.col("pos") - 1) / WIDTH).alias("block")).agg(*[F.max(F.when(place == i, F.col("id"))).alias(t) for i, t in enumerate(TURNS)])
    none = convs.where("size = 0").select("conv", F.lit(0).cast("long").alias("block"), *[F.lit(None).cast("binary").alias(t) for t in TURNS])
    rows = table(held.union(none), "blocks")
    at = [F.col("block") * WIDTH + i for i in range(1, WIDTH + 1)]
    marks = [_marks(p, F.col(t)) for p, t in zip(at, TURNS, strict=True)]
    here = [_xor([F.when(F.col(t).isNotNull(), m[k]).otherwise(0) for m, t in zip(marks, TURNS, strict=True)]) for k in (0, 1)]
    size = reduce(lambda a, b: a + b, [_size_of(F.col(t)) for t in TURNS])
    out = scan(rows, "conv", "block", {"x1": mixed(here[0]), "x2": mixed(here[1]), "before": running(size, including=False), "total": whole(size)})
    out = table(out.join(convs, "conv"), "blocks")
    drop_table(rows)
    return out


def _rollup(rows: DataFrame, aggregates: str) -> DataFrame:
    """A row per node: depth, level (turns in its block), its key (x1, x2), its parent's (y1, y2), and aggregates of its members."""
    turns = ", ".join(TURNS)
    found = rows.sparkSession.sql(
        f"SELECT block, x1 AS p1, x2 AS p2, {turns}, {WIDTH} - bit_count(grouping_id()) AS level, {aggregates} FROM {{rows}} GROUP BY block, x1, x2, ROLLUP ({turns})", rows=rows
    )
    # a prefix ends with a turn; the node without turns in its block is the one before's, but for the root
    whole_prefix = F.when(F.col("level") == 0, F.col("block") == 0).otherwise(F.get(F.array(*TURNS), F.col("level") - 1).isNotNull())
    marks = [_marks(F.col("block") * WIDTH + i, F.col(t)) for i, t in enumerate(TURNS, 1)]

    def key(k: int, less: int) -> Column:
        return _xor([F.col(f"p{k + 1}"), *[F.when(F.col("level") - less >= i, m[k]).otherwise(0) for i, m in enumerate(marks, 1)]])

    cols = {"depth": F.col("block") * WIDTH + F.col("level"), "x1": key(0, 0), "x2": key(1, 0), "y1": key(0, 1), "y2": key(1, 1)}
    return found.where(whole_prefix).withColumns(cols)


def _least_members(rows: DataFrame) -> DataFrame:
    """(conv, since, up, shared, leaf) of conversations that are the least member of nodes: of those from depth since on; up is
    the least member of the node above these, shared the bytes of text down to it; leaf: whether one of them has no child."""
    nodes = _rollup(rows, "min(conv) AS conv, max(size) AS longest, max(before) AS before")
    above = reduce(lambda a, b: a + b, [F.col("before"), *[F.when(F.col("level") - 1 >= i, _size_of(F.col(t))).otherwise(0) for i, t in enumerate(TURNS, 1)]])
    nodes = table(nodes.select("depth", "x1", "x2", "y1", "y2", "conv", (F.col("longest") == F.col("depth")).alias("leaf"), above.alias("shared")), "nodes")
    since = nodes.groupBy("conv").agg(F.min("depth").alias("since"), *[F.min_by(c, "depth").alias(c) for c in ("y1", "y2", "shared")], F.bool_or("leaf").cast("long").alias("leaf"))
    upper = nodes.select((F.col("depth") + 1).alias("since"), F.col("x1").alias("y1"), F.col("x2").alias("y2"), F.col("conv").alias("up"))
    out = table(table(since, "since").join(upper, ["since", "y1", "y2"], "left").select("conv", "since", "up", "shared", "leaf"), "least")
    drop_table(nodes)
    return out


def _hash(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each node's parts, which come in order, as one hash."""
    schema = pa.schema([("depth", pa.int64()), ("x1", pa.int64()), ("x2", pa.int64()), ("ends", pa.string())])
    node, digest = None, None
    for batch in batches:
        out = []
        for *own, ids in zip(*[batch[c].to_pylist() for c in ("depth", "x1", "x2", "ids")], strict=True):
            if own != node:
                if node:
                    out.append((*node, digest.hexdigest()))
                node, digest = own, hashlib.sha256(ids.encode())
            else:
                digest.update(b"," + ids.encode())
        yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], f.type) for i, f in enumerate(schema)], schema=schema)
    if node:
        yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((*node, digest.hexdigest()), schema, strict=True)], schema=schema)


def _ends(rows: DataFrame) -> DataFrame:
    """(depth, x1, x2, ends): hash of the ids of the conversations that end at a node, joined in ascending order."""
    last = rows.where(F.col("size") <= (F.col("block") + 1) * WIDTH)
    marks = [_marks(F.col("block") * WIDTH + i, F.col(t)) for i, t in enumerate(TURNS, 1)]
    keys = [_xor([F.col(f"x{k + 1}"), *[F.when(F.col(t).isNotNull(), m[k]).otherwise(0) for m, t in zip(marks, TURNS, strict=True)]]) for k in (0, 1)]
    part = prefix.range_of(F.col("conv"), prefix.quantiles(rows, "conv"))
    ends = last.select(F.col("size").alias("depth"), keys[0].alias("x1"), keys[1].alias("x2"), "conv", part.alias("part"))
    parts = ends.groupBy("depth", "x1", "x2", "part").agg(F.array_join(F.sort_array(F.collect_list("conv")), ",").alias("ids"))
    parts = parts.repartition(n_partitions(rows.sparkSession), "depth", "x1", "x2").sortWithinPartitions("depth", "x1", "x2", "part")
    return parts.mapInArrow(_hash, "depth long, x1 long, x2 long, ends string")


def trie(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """The nodes of conversations given as turns (conv, pos, id) and sizes (conv, size).

    conv_id (least member), depth, parent_conv_id (null for the root), n_convs (members), n_children, n_leaves (childless
    nodes below, itself included), saved_tokens (bytes of text, in the nodes below and its own, that members share) and
    ends_sha256 (of the ids of members that end here).
    """
    rows = blocks(turns, convs)
    least = _least_members(rows)
    known = rows.join(least.drop("up"), "conv", "left")
    since, shared = F.coalesce("since", F.col("size") + 1), F.coalesce("shared", "total")
    levels = range(WIDTH + 1)
    depth = [F.col("block") * WIDTH + i for i in levels]
    sizes = [_size_of(F.col(t)) for t in TURNS]
    upto = [reduce(lambda a, b: a + b, [F.col("before"), *sizes[: max(0, i - 1)]]) for i in levels]
    own = {f"child{i}": ((F.col("size") > depth[i]) & (since <= depth[i] + 1)).cast("long") for i in levels}
    own |= {f"saved{i}": F.greatest(shared - upto[i], F.lit(0)) for i in levels}
    known = known.select("conv", "block", "x1", "x2", *TURNS, F.coalesce("leaf", F.lit(0)).alias("leaf"), *[c.alias(k) for k, c in own.items()])
    sums = ", ".join(f"sum({k}) AS {k}" for k in ("leaf", *own))
    nodes = _rollup(known, f"min(conv) AS conv, count(*) AS n, {sums}")
    pick = lambda kind: F.get(F.array(*[f"{kind}{i}" for i in levels]), F.col("level"))
    nodes = nodes.select("depth", "x1", "x2", "conv", "n", "leaf", pick("child").alias("children"), pick("saved").alias("saved"))
    nodes = nodes.join(_ends(rows), ["depth", "x1", "x2"], "left").join(least.select("conv", "since", "up"), "conv")
    parent = F.when(F.col("depth") == 0, None).when(F.col("depth") == F.col("since"), F.col("up")).otherwise(F.col("conv"))
    return nodes.select(
        F.col("conv").alias("conv_id"), "depth", parent.alias("parent_conv_id"), F.col("n").alias("n_convs"), F.col("children").alias("n_children"),
        F.col("leaf").alias("n_leaves"), F.col("saved").alias("saved_tokens"), F.coalesce("ends", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
    )


def prefix_trie(conversations: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text") -> DataFrame:
    """The trie of the conversations as they are; columns as in trie()."""
    turns = table(turn_ids(conversations, conv_col, turn_col, role_col, text_col), "turns")
    return trie(turns, turns.groupBy("conv").agg(F.max("pos").alias("size")))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(*rebuilt(table(turn_ids(read(spark, sf_dir, "conversations")), "turns")))


OP12_SQL = r"""
WITH t AS (
  SELECT conv_id, {'r': coalesce(role, ''), 'x': coalesce(text, '')} AS s,
    row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS p
  FROM conversations WHERE conv_id IS NOT NULL),
-- CRC-32 of the decimal id, bit by bit
c AS (
  SELECT conv_id, list(s ORDER BY p) AS l, xor(4294967295, list_reduce(
    list_concat([4294967295::BIGINT], list_transform(string_split(conv_id::VARCHAR, ''), lambda d: ascii(d)::BIGINT)),
    lambda a, b: list_reduce(list_concat([xor(a, b)], [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]),
      lambda v, z: xor(v // 2, CASE WHEN v % 2 = 1 THEN 3988292384 ELSE 0 END)))) % 9 AS h
  FROM t GROUP BY conv_id),
r AS (SELECT c.conv_id, list_concat(coalesce(b.l[1:c.h], []), c.l[c.h + 1:]) AS l FROM c LEFT JOIN c b ON b.conv_id = c.conv_id - c.conv_id % 5),
p AS (SELECT conv_id, l, unnest(range(0, len(l) + 1)) AS d FROM r),
m AS (SELECT conv_id, d, len(l) AS size, l[d].x AS x, min(conv_id) OVER w AS rep, count(*) OVER w AS n FROM p WINDOW w AS (PARTITION BY d, l[1:d])),
v AS (
  SELECT rep, d, any_value(n) AS n, max(size) > d AS inner_node, any_value(CASE WHEN d = 0 THEN 0 ELSE strlen(x) END) AS bytes,
    coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE size = d), '') AS ends
  FROM m GROUP BY rep, d),
-- every node with the nodes above it and itself
below AS (
  SELECT m.rep, m.d, count(*) FILTER (WHERE v.d = m.d + 1) AS n_children, count(*) FILTER (WHERE NOT v.inner_node) AS n_leaves,
    sum((v.n - 1) * v.bytes) AS saved
  FROM v JOIN m ON m.conv_id = v.rep AND m.d <= v.d GROUP BY m.rep, m.d)
SELECT v.rep AS conv_id, v.d::BIGINT AS depth, up.rep AS parent_conv_id, v.n AS n_convs, n_children, n_leaves, saved::BIGINT AS saved_tokens, sha256(ends) AS ends_sha256
FROM v JOIN below USING (rep, d) LEFT JOIN m up ON up.conv_id = v.rep AND up.d = v.d - 1
"""
