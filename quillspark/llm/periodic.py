"""Runs of words that repeat with a period, found by a dictionary of basic factors.

The factors of 1, 2, 4, … words of a text get numbers, equal factors the same: a factor's number comes from the numbers of
its halves, and places whose factor comes only once in their text are left out from then on. At each length L from 4 on,
the occurrences of a factor that follow within 2 * L are walked. Evenly spaced ones are stepped over as one arithmetic
progression: its first, second and last member propose a period, as any other pair would only propose the same run or a
multiple of a shorter period. A proposed pair is extended to both sides by the numbers of ever shorter factors; runs that
are found several times, or as a multiple of their period, are one.

A run of period q has at least 2 * q (and least_words) words, so the longest factor of a power of two that isn't above q
recurs q words later in it; for periods below 4 the factors of 4 words do, as runs have 12 words.

Texts are looked at where they lie, without a shuffle. A task holds the numbers of about batch_words words, or of one text
where that is longer; of long factors only the places that recur.

Edge cases: null and empty texts have no words and no runs. Repeated rows and null ids give a row each; an empty table
gives none. Columns beyond id and text aren't read, so their names can't clash.
"""

from __future__ import annotations

import itertools
import re
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillspark.functions.text import let

from .common import read, words_of

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: More steps than groups of occurrences can lie within twice a factor's length.
STEPS = 12
RUNS = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))


class Factors:
    """Numbers of the factors of one length that recur, by place; -1 for the others."""

    def __init__(self, size: int, places: np.ndarray, names: np.ndarray) -> None:
        self.size, self.places, self.names, self.all = size, places, names, None
        if len(places) * 8 >= size:
            self.all = np.full(size, -1, np.int32)
            self.all[places] = names

    def at(self, i: np.ndarray) -> np.ndarray:
        inside = (i >= 0) & (i < self.size)
        i = np.where(inside, i, 0)
        if self.all is not None:
            return np.where(inside, self.all[i], -1)
        if not len(self.places):
            return np.full(len(i), -1, np.int32)
        k = np.minimum(np.searchsorted(self.places, i), len(self.places) - 1)
        return np.where(inside & (self.places[k] == i), self.names[k], -1)

    def same(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        a = self.at(a)
        return (a >= 0) & (a == self.at(b))


def dictionary(words: np.ndarray) -> Iterator[tuple[int, Factors, np.ndarray, np.ndarray]]:
    """(length, factors, places, first) for 1, 2, 4, …: places by number and then place; first marks each number's first."""
    size = len(words)
    recur = np.flatnonzero(np.bincount(words)[words] > 1) if size else np.empty(0, np.int64)
    names, length = words[recur], 1
    while len(recur):
        order = np.argsort(names, kind="stable")
        level = Factors(size, recur, names)
        by_name = names[order]
        yield length, level, recur[order], np.diff(by_name, prepend=by_name[:1] - 1) != 0
        right = level.at(recur + length)
        both = right >= 0
        recur, key = recur[both], names[both].astype(np.int64) << 32 | right[both]
        order = np.argsort(key, kind="stable")
        new = np.diff(key[order], prepend=-1) != 0
        number = np.empty(len(key), np.int32)
        number[order] = np.cumsum(new) - 1
        often = np.bincount(number)[number] > 1 if len(number) else np.empty(0, bool)
        recur, names, length = recur[often], number[often], length * 2


def proposals(length: int, places: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, period) of equal factors that may begin a run."""
    n, far = len(places), 2 * length
    gap = np.full(n, far + 1, np.int64)  # to the factor's next occurrence
    gap[:-1] = np.where(first[1:], far + 1, np.diff(places))
    turn = np.ones(n, bool)  # the gap after isn't the gap before
    turn[1:] = (gap[1:] != gap[:-1]) | first[1:]
    turns = np.flatnonzero(turn)
    after = np.searchsorted(turns, np.arange(n), side="right")
    last = np.where(after < len(turns), turns[np.minimum(after, len(turns) - 1)], n - 1)  # of the progression from here
    start = np.flatnonzero(gap <= far)
    cur, found = start, []
    for _ in range(STEPS):
        near = gap[cur] <= far
        start, cur = start[near], cur[near]
        if not len(cur):
            break
        for to in (cur + 1, last[cur]):
            period = places[to] - places[start]
            good = (period <= far) & ((period >= length) | (length == 4))
            found.append(np.stack([period[good], places[start[good]]]))
        cur = np.where(last[cur] > cur, last[cur], cur + 1)
        near = places[cur] - places[start] <= far
        start, cur = start[near], cur[near]
    if not found:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    period, place = np.concatenate(found, axis=1)
    order = np.lexsort((place, period))
    period, place = period[order], place[order]
    follows = (np.diff(period, prepend=-1) == 0) & (np.diff(place, prepend=-1) <= 1)
    return place[~follows], period[~follows]


def runs(words: np.ndarray, least_words: int = 12) -> np.ndarray:
    """Rows (start, length, period) of all runs, by start and period. Equal words have equal numbers, below their count."""
    levels: list[tuple[int, Factors]] = []
    places, periods = [], []
    for length, level, by_name, first in dictionary(words):
        levels.append((length, level))
        if length >= 4:
            a, q = proposals(length, by_name, first)
            places.append(a)
            periods.append(q)
    if not places:
        return np.empty((0, 3), np.int64)
    begin, period = np.concatenate(places), np.concatenate(periods)
    end = begin.copy()  # both words of a pair are the same up to here
    for length, level in reversed(levels):
        end += length * level.same(end, end + period)
        begin -= length * level.same(begin - length, begin - length + period)
    size = end + period - begin
    whole = size >= np.maximum(least_words, 2 * period)
    begin, size, period = begin[whole], size[whole], period[whole]
    order = np.lexsort((period, size, begin))
    begin, size, period = begin[order], size[order], period[order]
    new = (np.diff(begin, prepend=-1) != 0) | (np.diff(size, prepend=-1) != 0)
    out = np.stack([begin[new], size[new], period[new]], axis=1)
    return out[np.lexsort((out[:, 2], out[:, 0]))]


def _find(least_words: int, batch_words: int, id_type: pa.DataType):
    schema = pa.schema([("id", id_type), ("n_words", pa.int64()), ("runs", RUNS), ("collapsed", pa.string())])

    def texts(ids: list[pa.Array], parts: list[list[str]], numbers: np.ndarray) -> pa.RecordBatch:
        stops = np.cumsum([0, *map(len, parts)])
        found = runs(numbers, least_words)
        cuts = np.searchsorted(found[:, 0], stops)
        found[:, 0] -= np.repeat(stops[:-1], np.diff(cuts))
        kept = []
        for words, a, b in zip(parts, cuts, cuts[1:], strict=False):
            if a < b:
                depth = np.zeros(len(words) + 1, np.int64)
                np.add.at(depth, found[a:b, 0] + found[a:b, 2], 1)
                np.add.at(depth, found[a:b, 0] + found[a:b, 1], -1)
                words = itertools.compress(words, np.cumsum(depth)[:-1] == 0)
            kept.append(" ".join(words))
        structs = pa.StructArray.from_arrays([pa.array(found[:, k]) for k in range(3)], fields=list(RUNS.value_type))
        lists = pa.ListArray.from_arrays(pa.array(cuts, pa.int32()), structs)
        return pa.RecordBatch.from_arrays([pa.concat_arrays(ids), pa.array(np.diff(stops)), lists, pa.array(kept, pa.string())], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, parts, numbers, held, count = [], [], [], 0, itertools.count()
        for batch in batches:
            for i, text in enumerate(batch["text"]):
                words = WORD.findall(text.as_py() or "")
                own = defaultdict(count.__next__)  # no two texts share a number, so no factor spans two of them
                ids.append(batch["id"].slice(i, 1))
                parts.append(words)
                numbers.append(np.fromiter(map(own.__getitem__, words), np.int32, len(words)))
                held += len(words)
                if held >= batch_words or len(ids) >= batch_words:
                    yield texts(ids, parts, np.concatenate(numbers))
                    ids, parts, numbers, held, count = [], [], [], 0, itertools.count()
        if ids:
            yield texts(ids, parts, np.concatenate(numbers))

    return run


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_words: int = 12, batch_words: int = 1 << 19) -> DataFrame:
    """(id_col, n_words, runs, collapsed) of every row. runs: (start, length, period) in words, by start and period, of all
    stretches with smallest period q that no neighbouring word extends and that have max(least_words, 2 * q) words or more.
    collapsed: the words that aren't after the first q of a run, joined by spaces.

    least_words: 8 or more, as shorter runs of short periods needn't hold a factor of four words twice.
    """
    from pyspark.sql.pandas.types import to_arrow_type

    if least_words < 8:
        raise ValueError("least_words is below 8")
    kind = docs.schema[id_col].dataType
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    out = "id {}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
    found = rows.mapInArrow(_find(least_words, batch_words, to_arrow_type(kind)), out.format(kind.simpleString()))
    return found.withColumnRenamed("id", id_col)


def with_period(text: Column, doc_id: Column) -> Column:
    """The text of the query's contract: in a tenth of the documents, by checksum of the id, words from some place on repeat."""
    h = F.crc32(doc_id.cast("string").cast("binary"))
    g = F.floor(h / 10)

    def repeat(words: Column) -> Column:
        n = F.size(words)
        return let(g % n, lambda a: let(1 + F.floor((n - a) / (3 + g % 8)), lambda p: F.transform(
            words, lambda w, i: F.when(i < a, w).otherwise(F.get(words, (a + (i - a) % p).cast("int")))
        )))

    changed = let(words_of(text), lambda w: F.when(F.size(w) > 0, F.array_join(repeat(w), " ")).otherwise(text))
    return F.when(h % 10 == 0, changed).otherwise(text)


def op11_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = periodic_runs(docs.select("doc_id", with_period(F.col("text"), F.col("doc_id")).alias("text")))
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    line = F.transform("runs", lambda r: F.concat_ws("", r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n")))
    best = found.withColumn("best", longest)
    return best.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("best.start")).alias("start"), F.col("best.length").alias("length"),
        (-F.col("best.period")).alias("period"), F.expr("1000 * best.length div -best.period").alias("exponent_milli"),
        F.sha2(F.array_join(line, "").cast("binary"), 256).alias("runs_sha256"), F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
