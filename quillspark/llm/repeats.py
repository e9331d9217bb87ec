"""Substring dedup by repeated-phrase automata.

1. Every document selects phrases (k consecutive words) by content alone: the k-gram of least hash in each window, so
   that two equal windows always select the same phrase. A count over all documents confirms those that more than one
   document selects; the least id among these owns the phrase.
2. Confirmed phrases are dealt to shards of about `shard_phrases` by their owner, so a passage's phrases lie together. A
   document goes to the shards where it selected something; one that selected nothing confirmed has no recurring
   window. A shard of many documents is split into groups of about `group_docs`, each of which gets the shard's phrases.
3. A task compiles one Aho-Corasick automaton from all phrases of the shard, whoever selected them, and streams the
   whole texts of the group through it. Each window of words is anchored at the leftmost occurrence inside it, which is
   the same in every document of the shard. Windows of one anchor form a run of up to 2 * window - k words.
4. A run is one row, keyed by 128 bits of a hash of its words. Documents with the same run are compared by id alone.
   Only where the runs of one anchor differ between documents (at the edges of passages) are single windows hashed, once
   for each distinct run. The least id owns a run or a window; everybody else's words inside it are removed.

Shuffled are: about 5 % of the words as (hash, id), all texts for the join with the shards and again for the cut, the
texts of documents with recurring phrases once for each of their shards, and the runs. The least ids are combined before
the shuffle; joins on a hot phrase or run are split by AQE. A document's runs travel to it as its own spans. Memory of a
task: the automaton (a few kB a phrase) and one Arrow batch.

Edge cases: ids are integers or cast to them. Null or empty text has no words and gives a row with zeros and an empty
kept text. Documents of fewer words than the window are never touched. Rows with a null id can't be ordered: they keep
all words and own no window. Rows with equal ids are judged one by one; as no id is smaller than itself, they don't
remove each other's words. Other columns of the input are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, read, table

BASE = np.uint64(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))


def _powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, dtype=np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


class Rolling:
    """Hashes of all k-grams of a word-hash array, from prefix sums."""

    def __init__(self) -> None:
        self.up, self.down = _powers(BASE, 4096), _powers(INVERSE, 4096)

    def __call__(self, words: np.ndarray, k: int) -> np.ndarray:
        n = len(words)
        if n > len(self.up):
            self.up, self.down = _powers(BASE, 2 * n), _powers(INVERSE, 2 * n)
        sums = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum(words * self.up[:n], out=sums[1:])
        x = (sums[k:] - sums[:-k]) * self.down[: n - k + 1]
        x ^= x >> np.uint64(31)
        x *= np.uint64(0xBF58476D1CE4E5B9)
        x ^= x >> np.uint64(29)
        return x


def word_hashes(words: list[bytes], seed: int = 0) -> np.ndarray:
    return np.fromiter((xxhash.xxh64_intdigest(w, seed) for w in words), np.uint64, len(words))


def sliding(values: np.ndarray, width: int, pick: np.ufunc) -> np.ndarray:
    """pick (np.minimum or np.maximum) over each window, by doubling."""
    out, have = values, 1
    while have < width:
        step = min(have, width - have)
        out = pick(out[:-step], out[step:])
        have += step
    return out


def selected(grams: np.ndarray, per_window: int) -> tuple[np.ndarray, np.ndarray]:
    """Which k-grams are the least of some window, and the least value of each window."""
    least = sliding(grams, per_window, np.minimum)
    pad = np.zeros(per_window - 1, dtype=np.uint64)
    most = sliding(np.concatenate([pad, least, pad]), per_window, np.maximum)
    return most == grams, least


def _spans(covered: np.ndarray) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate([[0], covered.view(np.int8), [0]])))
    return [(int(a), int(b)) for a, b in zip(edge[::2], edge[1::2], strict=True)]


def _phrases(window: int, k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            ids, hashes = [], []
            for doc, text in zip(batch["id"].to_pylist(), batch["text"], strict=True):
                words = (text.as_py() or b"").split()
                if doc is None or len(words) < window:
                    continue
                grams = rolling(word_hashes(words), k)
                found = np.unique(grams[selected(grams, window - k + 1)[0]])
                hashes.append(found.view(np.int64))
                ids.append(np.full(len(found), doc, dtype=np.int64))
            if ids:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(hashes)), pa.array(np.concatenate(ids))], ["phrase", "id"])

    return run


def _words(text: pa.Scalar) -> list[bytes]:
    return (text.as_py() or b"").split()


def _deal(window: int, k: int):
    """Rows for the shards: each document (kind 1), and the texts of the phrases it owns (kind 0)."""
    names = ["shard", "groups", "kind", "id", "key", "text"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rolling = Rolling()
        for batch in batches:
            kinds = pa.array(np.ones(batch.num_rows, dtype=np.int8))
            yield pa.RecordBatch.from_arrays([batch["shard"], batch["groups"], kinds, batch["id"], batch["key"], batch["text"]], names)
            at, phrases = [], []
            for i, (text, owned) in enumerate(zip(batch["text"], batch["owned"], strict=True)):
                if not len(owned):
                    continue
                words = _words(text)
                if len(words) < window:
                    continue
                grams, first = np.unique(rolling(word_hashes(words), k), return_index=True)
                for j in first[np.isin(grams, owned.values.to_numpy().view(np.uint64))].tolist():
                    at.append(i)
                    phrases.append(b" ".join(words[j : j + k]))
            if at:
                rows = batch.take(pa.array(at))
                kinds = pa.array(np.zeros(len(at), dtype=np.int8))
                yield pa.RecordBatch.from_arrays([rows["shard"], rows["groups"], kinds, rows["id"], rows["key"], pa.array(phrases, pa.binary())], names)

    return run


RUNS = pa.schema(
    [("anchor", pa.int64()), ("r1", pa.int64()), ("r2", pa.int64()), ("id", pa.int64()), ("key", pa.int64()), ("starts", pa.list_(pa.int32())),
     ("length", pa.int32()), ("words", pa.binary())]
)


def _occurrences(window: int, k: int):
    """Streams the documents of each group through the automaton of its shard. Phrases come before documents."""

    def runs_of(automaton: ahocorasick.Automaton, words: list[bytes], shard: int) -> dict[tuple, list]:
        # bytes as latin-1: pyahocorasick takes str, and equal bytes are equal text
        ends = [e for e, _ in automaton.iter((b" " + b" ".join(words) + b" ").decode("latin-1"))]
        found: dict[tuple, list] = {}
        if not ends:
            return found
        lengths = np.fromiter(map(len, words), np.int64, len(words))
        at = (np.searchsorted(np.cumsum(lengths + 1), np.array(ends)) - k + 1).tolist()
        before = -1
        for p in at:
            low, high = max(p + k - window, before + 1, 0), min(p, len(words) - window)
            before = p
            if low <= high:
                run = b" ".join(words[low : high + window])
                digest = xxhash.xxh3_128_intdigest(run)
                anchor = xxhash.xxh3_64_intdigest(b" ".join(words[p : p + k]), shard)
                key = (anchor, digest >> 64, digest & (1 << 64) - 1)
                found.setdefault(key, [run, high + window - low]).append(low)
        return found

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, automaton, compiled = None, ahocorasick.Automaton(), False
        for batch in batches:
            columns: list[list] = [[] for _ in RUNS]
            rows = zip(*(batch[c].to_pylist() for c in ("shard", "group", "kind", "id", "key")), batch["text"], strict=True)
            for shard, number, kind, doc, key, text in rows:
                if (shard, number) != group:
                    group, automaton, compiled = (shard, number), ahocorasick.Automaton(), False
                if kind == 0:
                    automaton.add_word((b" " + text.as_py() + b" ").decode("latin-1"), k)
                    continue
                if not compiled:
                    automaton.make_automaton()
                    compiled = True
                words = _words(text)
                if len(words) < window or not len(automaton):
                    continue
                for (anchor, r1, r2), (line, length, *starts) in runs_of(automaton, words, shard).items():
                    for column, value in zip(columns, (anchor, r1, r2, doc, key, starts, length, line), strict=True):
                        column.append(value)
            if columns[0]:
                signed = [pa.array(np.array(c, dtype=np.uint64).view(np.int64)) for c in columns[:3]]
                yield pa.RecordBatch.from_arrays([*signed, *(pa.array(c, f.type) for c, f in zip(columns[3:], list(RUNS)[3:], strict=True))], schema=RUNS)

    return run


def _windows(window: int):
    """Every window of a run: 128 bits of a hash of its words, and its place in the run."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, high, low, offset = [], [], [], []
            for i, line in enumerate(batch["words"]):
                words = _words(line)
                for j in range(len(words) - window + 1):
                    digest = xxhash.xxh3_128_intdigest(b" ".join(words[j : j + window]))
                    rows.append(i)
                    high.append(digest >> 64)
                    low.append(digest & (1 << 64) - 1)
                    offset.append(j)
            same = batch.select(["anchor", "r1", "r2", "id"]).take(pa.array(rows, pa.int64()))
            hashes = [pa.array(np.array(x, dtype=np.uint64).view(np.int64)) for x in (high, low)]
            yield pa.RecordBatch.from_arrays([*same.columns, *hashes, pa.array(offset, pa.int32())], ["anchor", "r1", "r2", "id", "w1", "w2", "offset"])

    return run


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        n, removed, kept, spans = [], [], [], []
        for text, repeats in zip(batch["text"], batch["repeats"], strict=True):
            words = _words(text)
            covered = np.zeros(len(words) + 1, dtype=np.int64)
            if repeats.is_valid:
                starts, ends = (repeats.values.field(c).to_numpy() for c in ("start", "end"))
                np.add.at(covered, starts, 1)
                np.add.at(covered, ends, -1)
            cover = np.cumsum(covered)[:-1] > 0
            n.append(len(words))
            removed.append(int(cover.sum()))
            spans.append([{"start": a, "end": b} for a, b in _spans(cover)])
            kept.append(b" ".join(words if not removed[-1] else [w for w, c in zip(words, cover.tolist(), strict=True) if not c]))
        yield pa.RecordBatch.from_arrays(
            [batch["id"], pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(kept, pa.binary()).cast(pa.string()), pa.array(spans, span)],
            ["id", "n_words", "n_removed", "kept", "spans"],
        )


def _routes(rows: DataFrame, window: int, phrase: int, shard_phrases: int, group_docs: int) -> DataFrame:
    """(id, shard, groups, owned): the shards each document goes to, their groups, and the phrases it owns there."""
    chosen = table(rows.select("id", "text").mapInArrow(_phrases(window, phrase), "phrase long, id long"), "phrases")
    recurring = chosen.groupBy("phrase").agg(F.min("id").alias("owner"), F.max("id").alias("last")).where("owner < last")
    recurring = table(recurring.select("phrase", "owner"), "recurring")
    n_shards = -(-recurring.count() // shard_phrases)
    shard = F.pmod(F.xxhash64("owner"), F.lit(max(n_shards, 1))).alias("shard")
    visits = chosen.join(recurring, "phrase").select("id", shard, F.when(F.col("id") == F.col("owner"), F.col("phrase")).alias("phrase"))
    visits = table(visits.groupBy("id", "shard").agg(F.collect_set("phrase").alias("owned")), "visits")
    groups = table(visits.groupBy("shard").agg(F.ceil(F.count("*") / group_docs).cast("int").alias("groups")), "groups")
    routes = table(visits.join(groups, "shard"), "routes")
    for old in (chosen, recurring, visits, groups):
        drop_table(old)
    return routes


def _runs(rows: DataFrame, routes: DataFrame, window: int, phrase: int) -> DataFrame:
    """What the automata find: one row per document, shard and distinct run, with the places where it starts."""
    dealt = rows.join(routes, "id").select("id", "key", "text", "shard", "groups", "owned")
    dealt = dealt.mapInArrow(_deal(window, phrase), "shard long, groups int, kind byte, id long, key long, text binary")
    everywhere, one = F.sequence(F.lit(0), F.col("groups") - 1), F.array(F.pmod(F.xxhash64("id", "key"), F.col("groups")).cast("int"))
    dealt = dealt.withColumn("group", F.explode(F.when(F.col("kind") == 0, everywhere).otherwise(one))).drop("groups")
    dealt = dealt.repartition("shard", "group").sortWithinPartitions("shard", "group", "kind")
    return dealt.mapInArrow(
        _occurrences(window, phrase), "anchor long, r1 long, r2 long, id long, key long, starts array<int>, length int, words binary"
    )


def _repeats(runs: DataFrame, window: int) -> DataFrame:
    """(id, key, repeats): the spans of words, by document, that a document of smaller id has as well."""
    run = ["anchor", "r1", "r2"]
    owners = table(runs.groupBy(*run).agg(F.min("id").alias("owner")), "run-owners")
    # written before they are joined back: AQE can then split an anchor or a window that very many runs share
    forked = table(owners.groupBy("anchor").count().where("count > 1").select("anchor"), "forked")
    own = runs.select(*run, "id", "words").join(owners.join(forked, "anchor", "left_semi"), run).where("id = owner")
    windows = table(own.select(*run, "id", "words").mapInArrow(_windows(window), "anchor long, r1 long, r2 long, id long, w1 long, w2 long, offset int"), "windows")
    shared = windows.groupBy("w1", "w2").agg(F.min("id").alias("first"), F.max("id").alias("last")).where("first < last")
    shared = table(shared.select("w1", "w2", "first"), "shared-windows")
    late = windows.join(shared, ["w1", "w2"]).where("id > first").groupBy(*run).agg(F.collect_set("offset").alias("offsets"))
    judged = table(owners.join(late, run, "left"), "run-offsets")
    for old in (owners, forked, windows, shared):
        drop_table(old)
    whole = F.transform("starts", lambda a: F.struct(a.alias("start"), (a + F.col("length")).alias("end")))
    places = F.transform("offsets", lambda o: F.transform("starts", lambda a: F.struct((a + o).alias("start"), (a + o + window).alias("end"))))
    spans = F.when(F.col("id") > F.col("owner"), whole).when(F.col("offsets").isNotNull(), F.flatten(places))
    found = runs.drop("words").join(judged, run).select("id", "key", spans.alias("spans")).where("spans is not null")
    # a set, as all rows of one id and text bring the same spans
    found = table(found.groupBy("id", "key").agg(F.flatten(F.collect_set("spans")).alias("repeats")), "repeats")
    drop_table(judged)
    return found


def remove_repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = 50, phrase: int = 12,
    shard_phrases: int = 4096, group_docs: int = 2048,
) -> DataFrame:
    """Remove words of windows that also start in a document with a smaller id.

    One row per input row: id_col, n_words, n_removed, kept (kept words joined by one space) and spans (removed word
    ranges, end exclusive). phrase is the length of the automata's patterns, at most window. shard_phrases and
    group_docs bound the automata and the documents that one of them reads; they don't change the result.
    """
    if not 1 <= phrase <= window:
        raise ValueError("phrase must be between 1 and window")
    rows = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").cast("binary").alias("text"))
    rows = rows.withColumn("key", F.xxhash64("text"))  # rows may share an id
    routes = _routes(rows, window, phrase, shard_phrases, group_docs)
    runs = table(_runs(rows, routes, window, phrase), "runs")
    drop_table(routes)
    repeats = _repeats(runs, window)
    drop_table(runs)
    out = rows.join(repeats, ["id", "key"], "left").select("id", "text", "repeats")
    out = out.mapInArrow(_cut, "id long, n_words long, n_removed long, kept string, spans array<struct<start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def op1_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = remove_repeats(read(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
