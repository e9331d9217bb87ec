"""SimHash near-duplicates by multi-index hashing.

Rows of equal fingerprint collapse first, so copies cost one row each. The 64 bits are cut into segments, and radii are
dealt to them such that two fingerprints within the distance are, in one segment, within its radius: with 3 segments
and distance 4 the radii are 1, 1 and 0, with 2 segments 2 and 1. There are as many segments, at most three, as leave
tables sparse: fewer and longer ones when 2 ** bits of a segment would hold more than `bucket` fingerprints a key. Each fingerprint stands in one table bucket per segment and looks up the
buckets of the small Hamming ball around its segment; of the two ends of a pair only the one whose lowest differing bit
is 0 enumerates it. Fetched matches are verified on all 64 bits inside the join.

A bucket of more than `bucket` fingerprints (thousands of near copies share most bits) isn't joined, as that would emit
all pairs. Its members are dealt to tiles, every pair of blocks being one tile, and a task reduces each tile to a
spanning forest of its verified links. Nothing is capped: both ways compare every pair of a bucket, and a forest has
the same components. Fingerprints equal to one another within distance r number at most sum(C(64, i)), i <= r, however
many documents there are.

Edge cases: null text, empty text and text without words have fingerprint 0 and link like any other. Repeated rows and
repeated ids give one row each. Ids are integers or cast to them. Rows with a null id take the class of their fingerprint and pass on no links; where no
row of that fingerprint has an id, the class is null. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import read, table
from .components import components

CHUNK = 1 << 16


def fingerprint(words: list[bytes], shingle: int, seed: int = 42) -> int:
    """Bit i is 1 if it is 1 in over half the hashes of the shingles."""
    if not words:
        return 0
    line, ends = b" ".join(words), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    k = min(shingle, len(words))
    starts = [0, *(ends[: len(words) - k] + 1).tolist()]
    hashes = [xxhash.xxh64_intdigest(line[a:b], seed) for a, b in zip(starts, ends[k - 1 :].tolist(), strict=True)]
    ones = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = np.array(hashes[i : i + CHUNK], dtype="<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(shingle: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint((t.as_py() or b"").lower().split(), shingle) for t in batch["text"]]
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(np.array(found, dtype=np.uint64).view(np.int64))], ["id", "print"])

    return run


def fingerprints(docs: DataFrame, id_col: str, text_col: str, shingle: int) -> DataFrame:
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    return rows.mapInArrow(_fingerprints(shingle), "id long, print long")


def segments(distance: int, n: int) -> list[tuple[int, int, int]]:
    """(first bit, bits, radius) of each segment; the radii + 1 sum to distance + 1."""
    n = min(n, distance + 1)
    radius, more = divmod(distance + 1 - n, n)
    edges = [64 - 64 * (n - i) // n for i in range(n + 1)]
    return [(a, b - a, radius + (i < more)) for i, (a, b) in enumerate(zip(edges, edges[1:], strict=False))]


def _keys(fingerprint: Column, segment: int, first: int, bits: int, radius: int) -> Column:
    """Array of (key, looks up): the own bucket first, then those of the ball which this end enumerates."""
    own = F.shiftrightunsigned(fingerprint, first).bitwiseAND(F.lit((1 << bits) - 1))
    masks = [sum(1 << b for b in c) for r in range(1, radius + 1) for c in combinations(range(bits), r)]
    here = F.lit(segment << 50)
    table_key = F.struct((own + here).alias("key"), F.lit(False).alias("probe"))
    if not masks:
        return F.array(table_key)
    ball = F.filter(F.array(*[F.lit(m).cast("long") for m in masks]), lambda m: own.bitwiseAND(m).bitwiseAND(-m) == 0)
    return F.concat(F.array(table_key), F.transform(ball, lambda m: F.struct((own.bitwiseXOR(m) + here).alias("key"), F.lit(True).alias("probe"))))


def _forest(nodes: np.ndarray, prints: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links of a spanning forest of the fingerprints within the distance of one another."""
    left, a, b = np.arange(len(nodes)), [], []
    front = left[:0]
    while len(left):
        if not len(front):
            front, left = left[:1], left[1:]
        some, front = front[:64], front[64:]
        near = np.bitwise_count(prints[some][:, None] ^ prints[left][None, :]) <= distance
        hit = near.any(axis=0)
        a.append(nodes[left[hit]])
        b.append(nodes[some[near[:, hit].argmax(axis=0)]])
        front, left = np.concatenate([front, left[hit]]), left[~hit]
    return np.concatenate(a or [nodes[:0]]), np.concatenate(b or [nodes[:0]])


def _tiles(distance: int):
    """Rows come sorted by tile, so that a tile is complete when the next one begins."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(parts: list) -> pa.RecordBatch:
            a, b = _forest(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), distance)
            return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

        tile, parts = None, []
        for batch in batches:
            keys = np.stack([batch[c].to_numpy() for c in ("key", "i", "j")], axis=1)
            nodes, prints = batch["node"].to_numpy(), batch["print"].to_numpy().view(np.uint64)  # signed, bits of the absolute value would be counted
            cuts = [0, *(np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1).tolist(), len(keys)]
            for x, y in zip(cuts, cuts[1:], strict=False):
                if x == y:
                    continue
                if tuple(keys[x]) != tile and parts:
                    yield links(parts)
                    parts = []
                tile = tuple(keys[x])
                parts.append((nodes[x:y], prints[x:y]))
        if parts:
            yield links(parts)

    return run


def segments_for(count: int, distance: int, bucket: int) -> int:
    """The most segments, up to three, whose tables hold at most `bucket` of `count` fingerprints a key on average, else two."""
    return next((n for n in (3, 2) if n <= distance + 1 and count <= bucket << 64 // n), 2 if distance else 1)


def links(prints: DataFrame, distance: int = 4, n_segments: int | None = None, bucket: int = 64, block: int = 4096) -> DataFrame:
    """Links (a, b) between the distinct fingerprints (node, print) that connect all pairs within the distance.

    n_segments is by default chosen from the number of fingerprints; it and bucket choose the way, not the result.
    """
    n_segments = n_segments or segments_for(prints.count(), distance, bucket)
    arrays = [_keys(F.col("print"), s, *x) for s, x in enumerate(segments(distance, n_segments))]
    keys = prints.select("node", "print", F.inline(F.concat(*arrays)))
    entries, probes = keys.where("not probe").drop("probe"), keys.where("probe").drop("probe")
    large = table(entries.groupBy("key").count().where(F.col("count") > bucket).select("key"), "large-buckets")

    fetched = keys.join(large, "key", "left_anti").alias("p").join(entries.alias("t"), "key")
    close = F.bit_count(F.col("p.print").bitwiseXOR(F.col("t.print"))) <= distance
    fetched = fetched.where(close & (F.col("p.probe") | (F.col("p.node") < F.col("t.node"))))
    fetched = fetched.select(F.col("p.node").alias("a"), F.col("t.node").alias("b"))

    members = table(entries.union(probes).join(large, "key"), "members")
    blocks = table(members.groupBy("key").count().select("key", F.ceil(F.col("count") / block).cast("int").alias("blocks")), "blocks")
    mine = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    dealt = members.join(blocks, "key").withColumn("mine", mine)
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "node", "print")
    tiles = dealt.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")
    return fetched.union(tiles.mapInArrow(_tiles(distance), "a long, b long"))


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = 4, distance: int = 4
) -> DataFrame:
    """One row per input row: id_col, fingerprint (16 hex digits) and component_id, the least id reachable by links."""
    prints = table(fingerprints(docs, id_col, text_col, shingle), "prints")
    classes = table(prints.groupBy("print").agg(F.min("id").alias("node")), "classes")
    found = components(links(classes.where("node is not null"), distance))
    classes = classes.join(found, "node", "left").select("print", F.coalesce("component", "node").alias("component_id"))
    return prints.join(classes, "print").select(
        F.col("id").alias(id_col), F.lower(F.lpad(F.hex("print"), 16, "0")).alias("fingerprint"), "component_id"
    )


def op3_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read(spark, sf_dir, "documents"))
