"""Language identification by unigram piece models with all segmentations summed out.

The pieces are those of a fixed public byte-level vocabulary that can stand in a lower-cased word (a leading space marks
its start). Each language has a probability per piece. A word's probability is the sum over all its segmentations into
pieces, by the forward algorithm; a text's is the product over its words, and the score is the posterior under equal
priors. Probabilities are fitted by expectation-maximisation, whose E-step (forward and backward) runs as a Spark job
over distinct words with their counts; the driver sees one number per language and piece.

The model is fitted on a bounded sample of labelled rows: about `docs_per_language` documents of each language, chosen by
a hash of the id; of more than `most_languages` labels the most frequent are learned. Everything else covers all rows.
The sum runs over all segmentations into all pieces of the vocabulary that fit, for words of any length: prefix
probabilities carry an exponent of their own, so that none underflows.

Edge cases: null or empty text and text without a letter give `und` and score 0; so does every text where no labelled
row exists to learn from. A word that has no segmentation (the vocabulary lacks a byte) counts as 1e-300. A null or empty language is no label. Rows with a null id are predicted, not learned from.
Repeated rows give equal rows. Other columns pass through.
"""

from __future__ import annotations

import base64
import re
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, read, table
from .repeats import BASE, INVERSE, _powers

WORD = re.compile(r"[^\W\d_]+")
SMALL = 1e-100
NEVER = np.log(1e-300)
ROWS = 256  # texts of a batch that are looked at together


def vocabulary(path: str) -> list[bytes]:
    """Pieces of a tiktoken file that can occur in a space and a lower-cased word."""
    with open(path, "rb") as f:
        pieces = {base64.b64decode(line.split()[0]) for line in f if line.strip()}
    fits = re.compile(rb"(?=.)[ ]?[a-z\x80-\xff]*\Z", re.S)
    return sorted(p for p in pieces if fits.match(p))


class Lattice:
    """All pieces of all segmentations of many words at once.

    A word of n bytes has n + 1 places; the places of all words are numbered one after the other.
    """

    MAYBE = 22  # bits of a table that tells most other strings from pieces

    def __init__(self, pieces: list[bytes]) -> None:
        self.up, self.down = _powers(BASE, 1 << 16), _powers(INVERSE, 1 << 16)
        keys = np.array([self.hash(np.frombuffer(p, np.uint8)) for p in pieces], dtype=np.uint64)
        self.order = np.argsort(keys)
        self.keys = keys[self.order]
        self.lengths = sorted(set(map(len, pieces)))
        self.maybe = np.zeros(1 << self.MAYBE, dtype=bool)
        self.maybe[keys >> np.uint64(64 - self.MAYBE)] = True

    def hash(self, data: np.ndarray) -> np.uint64:
        return np.sum(self.mixed(data) * self.up[: len(data)], dtype=np.uint64)

    @staticmethod
    def mixed(data: np.ndarray) -> np.ndarray:
        return (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0xD6E8FEB86659FD93)

    def edges(self, words: list[bytes]) -> tuple[np.ndarray, ...]:
        """First place of each word; then from, to, piece and distance of `to` from its word's start, for each edge."""
        size = np.fromiter(map(len, words), np.int64, len(words))
        data = np.frombuffer(b"".join(words), np.uint8)
        if len(data) > len(self.up):
            self.up, self.down = _powers(BASE, len(data)), _powers(INVERSE, len(data))
        sums = np.zeros(len(data) + 1, dtype=np.uint64)
        np.cumsum(self.mixed(data) * self.up[: len(data)], out=sums[1:])
        word = np.repeat(np.arange(len(words)), size)
        begin = np.cumsum(size) - size
        left = np.repeat(begin + size, size) - np.arange(len(data))  # bytes to the end of the word
        at, to, piece = [], [], []
        here = np.arange(len(data))
        for length in self.lengths:
            here = here[left[here] >= length]
            key = (sums[here + length] - sums[here]) * self.down[here]
            some = np.flatnonzero(self.maybe[key >> np.uint64(64 - self.MAYBE)])
            n = np.minimum(np.searchsorted(self.keys, key[some]), len(self.keys) - 1)
            ok = self.keys[n] == key[some]
            found = here[some[ok]]
            at.append(found + word[found])
            to.append(found + word[found] + length)
            piece.append(self.order[n[ok]])
        at, to, piece = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (at, to, piece))
        first = begin + np.arange(len(words))
        owner = np.searchsorted(first, to, side="right") - 1
        return first, at, to, piece, to - first[owner]


def _sweep(known: np.ndarray, source: np.ndarray, target: np.ndarray, factor: np.ndarray, step: np.ndarray, back: int) -> tuple[np.ndarray, np.ndarray]:
    """Sums over all paths: value and exponent of each place, from those known. Edges of one step don't depend on one
    another; `back` leads from a place to the one whose exponent it starts with."""
    value, exponent = known.copy(), np.zeros(known.shape)
    order = np.lexsort((target, step))
    source, target, factor = source[order], target[order], factor[order]
    cuts = np.searchsorted(step[order], np.arange(int(step.max(initial=0)) + 2))
    for i, j in zip(cuts, cuts[1:], strict=False):
        if i == j:
            continue
        t, s = target[i:j], source[i:j]
        head = np.flatnonzero(np.concatenate([[True], t[1:] != t[:-1]]))
        places = t[head]
        base = exponent[places + back]
        terms = value[s] * factor[i:j] * np.exp(exponent[s] - np.repeat(base, np.diff(np.append(head, j - i)), axis=0))
        total = np.add.reduceat(terms, head, axis=0)
        low = (total < SMALL) & (total > 0)
        if low.any():
            base = base + np.where(low, np.log(np.where(low, total, 1.0)), 0.0)
            total = np.where(low, 1.0, total)
        value[places], exponent[places] = total, base
    return value, exponent


def _forward(words: list[bytes], first: np.ndarray, edges: tuple, factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at, to, _, distance = edges
    start = np.zeros((sum(map(len, words)) + len(words), factor.shape[1]))
    start[first] = 1
    return _sweep(start, at, to, factor, distance, -1)


def _log(value: np.ndarray, exponent: np.ndarray) -> np.ndarray:
    return np.where(value > 0, np.log(np.where(value > 0, value, 1.0)) + exponent, NEVER)


def _parts(words: list[bytes], columns: int) -> Iterator[slice]:
    """Slices of the words of so many bytes that the work on one of them takes some tens of MB."""
    most, begin, held = (1 << 19) // max(columns, 1), 0, 0
    for i, w in enumerate(words):
        if held and held + len(w) > most:
            yield slice(begin, i)
            begin, held = i, 0
        held += len(w)
    if begin < len(words):
        yield slice(begin, len(words))


def word_log_probs(lattice: Lattice, probs: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log of the sum over all segmentations: a row per word, a column per language."""
    out = np.zeros((len(words), probs.shape[1]))
    for here in _parts(words, probs.shape[1]):
        part = words[here]
        first, *edges = lattice.edges(part)
        alpha, exponent = _forward(part, first, tuple(edges), probs[edges[2]])
        last = first + np.fromiter(map(len, part), np.int64, len(part))
        out[here] = _log(alpha[last], exponent[last])
    return out


def expected_counts(lattice: Lattice, probs: np.ndarray, words: list[bytes], weights: np.ndarray, total: np.ndarray) -> None:
    """Add each piece's expected occurrences in the words of one language to total."""
    for here in _parts(words, 1):
        part, w = words[here], weights[here]
        size = np.fromiter(map(len, part), np.int64, len(part))
        first, at, to, piece, distance = lattice.edges(part)
        factor = probs[piece][:, None]
        alpha, up = _forward(part, first, (at, to, piece, distance), factor)
        last = first + size
        owner = np.searchsorted(first, to, side="right") - 1
        start = np.zeros_like(alpha)
        start[last] = 1
        beta, down = _sweep(start, to, at, factor, size[owner] - (at - first[owner]), 1)
        whole = _log(alpha[last], up[last])[:, 0]
        share = alpha[at, 0] * factor[:, 0] * beta[to, 0]
        share = np.where(share > 0, share * np.exp(np.minimum(up[at, 0] + down[to, 0] - whole[owner], 700)), 0.0)
        np.add.at(total, piece, w[owner] * share)


def spaced(word: str) -> bytes:
    return b" " + word.encode()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter = Counter()
        for lang, text in zip(batch["lang"].to_pylist(), batch["text"].to_pylist(), strict=True):
            counts.update((lang, spaced(w)) for w in WORD.findall((text or "").lower()))
        langs, words = zip(*counts, strict=True) if counts else ((), ())
        yield pa.RecordBatch.from_arrays(
            [pa.array(langs, pa.string()), pa.array(words, pa.binary()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"]
        )


def _e_step(pieces: list[bytes], probs: dict[str, np.ndarray]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice, totals = Lattice(pieces), {}
        for batch in batches:
            langs = np.array(batch["lang"].to_pylist(), dtype=object)
            words, n = batch["word"].to_pylist(), batch["n"].to_numpy().astype(float)
            for lang in set(langs):
                mine = np.flatnonzero(langs == lang)
                total = totals.setdefault(lang, np.zeros(len(pieces)))
                expected_counts(lattice, probs[lang], [words[i] for i in mine], n[mine], total)
        for lang, total in totals.items():
            some = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(some), pa.string()), pa.array(some), pa.array(total[some])], ["lang", "piece", "n"])

    return run


class Model:
    """Languages, pieces, and the probability of each piece (row) in each language (column)."""

    def __init__(self, langs: list[str], pieces: list[bytes], probs: np.ndarray) -> None:
        self.langs, self.pieces, self.probs = langs, pieces, probs


def fit(
    labelled: DataFrame, vocabulary_path: str, docs_per_language: int = 500, rounds: int = 3, smoothing: float = 0.05, most_languages: int = 256,
) -> Model:
    """Fit on labelled (id, text, lang). Holds docs_per_language documents a language, give or take chance."""
    pieces = vocabulary(vocabulary_path)
    labelled = labelled.where("lang is not null and lang <> '' and id is not null")
    common = labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(most_languages)
    sizes = {r["lang"]: r["count"] for r in common.collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], pieces, np.zeros((len(pieces), 0)))
    keep = F.create_map(*[F.lit(x) for k in langs for x in (k, min(1.0, docs_per_language / sizes[k]))])
    chance = F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1 << 20)) / float(1 << 20)
    sample = labelled.where(chance < F.coalesce(F.element_at(keep, F.col("lang")), F.lit(0.0))).select("lang", "text")
    counts = sample.mapInArrow(_count, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counts = table(counts, "word-counts")
    place = {lang: i for i, lang in enumerate(langs)}
    probs = np.full((len(pieces), len(langs)), 1 / len(pieces))
    for _ in range(rounds):
        now = {lang: probs[:, i].copy() for lang, i in place.items()}
        found = counts.mapInArrow(_e_step(pieces, now), "lang string, piece long, n double").groupBy("lang", "piece").agg(F.sum("n").alias("n"))
        probs = np.full_like(probs, smoothing)
        for r in found.toArrow().to_pylist():  # at most a number per language and piece
            probs[r["piece"], place[r["lang"]]] += r["n"]
        probs /= probs.sum(axis=0)
    drop_table(counts)
    return Model(langs, pieces, probs)


class _Numbers(dict):
    """Numbers words as they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = n = len(self)
        return n


def _predict(model, most: int = 400_000, held: int = 1 << 22):
    """Languages and scores of batches of texts, ROWS texts at a time. Between these, at most `most` words are kept, and of
    many languages no more than have `held` numbers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, pieces, probs = model.value
        lattice, numbers, scores = Lattice(pieces), _Numbers(), np.zeros((0, len(names)))
        keep = min(most, held // max(len(names), 1))

        def learn() -> np.ndarray:
            """Score the words that were numbered since the last call, all at once."""
            new = [spaced(w) for w in islice(numbers, len(scores), None)]
            return np.concatenate([scores, word_log_probs(lattice, probs, new)]) if new else scores

        for batch in batches:
            langs, posts = [], []
            for begin in range(0, batch.num_rows, ROWS):
                places = []
                if len(numbers) > keep:
                    numbers.clear()
                    scores = scores[:0]
                for text in batch["text"].slice(begin, ROWS):
                    words = WORD.findall((text.as_py() or "").lower())
                    if names and any(c.isalpha() for w in words for c in w):
                        places.append(np.fromiter(map(numbers.__getitem__, words), np.int32, len(words)))
                    else:
                        places.append(None)
                scores = learn()
                for at in places:
                    if at is None:
                        langs.append("und")
                        posts.append(0.0)
                        continue
                    total = scores[at].sum(axis=0)
                    best = int(total.argmax())
                    langs.append(names[best])
                    posts.append(float(1 / np.exp(total - total[best]).sum()))
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(posts, pa.float64())], ["lang_pred", "score"])

    return run


def predict(docs: DataFrame, model: Model, text_col: str = "text", out_col: str = "language") -> DataFrame:
    """docs with the struct column out_col (replaced where it exists): lang_pred, a learned language or `und`, and score,
    the posterior of lang_pred."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.pieces, model.probs))  # a number per piece of the vocabulary and language

    @F.arrow_udf("lang_pred string, score double")
    def identify(texts: Iterator[pa.Array]) -> Iterator[pa.Array]:
        batches = (pa.RecordBatch.from_arrays([x], ["text"]) for x in texts)
        for found in _predict(shared)(batches):
            yield found.to_struct_array()

    return docs.withColumn(out_col, identify(F.col(text_col).cast("string")))


def held_out(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 3, is 1: never learned from."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit_documents(docs: DataFrame) -> Model:
    rows = docs.where(~held_out()).select(F.col("doc_id").alias("id"), "text", "lang")
    return fit(rows, public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = predict(docs.select("doc_id", "text"), fit_documents(docs))
    return found.select("doc_id", held_out().alias("held_out"), "language.lang_pred", "language.score")
