"""Byte-pair training against one merge at a time in plain Python."""

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.operators import bpe

from .oracle import SF


def plain(words, merges, least=2):
    """The most frequent pair, ties by ids, merged everywhere, again and again; pairs are counted afresh each time."""
    v = bpe.Vocabulary()
    rows = [([v.ids[c] for c in w], n) for w, n in words.items()]
    while len(v.merges) < merges:
        counts = Counter()
        for t, n in rows:
            for p in zip(t, t[1:], strict=False):
                counts[p] += n
        best = min(counts, key=lambda p: (-counts[p], p), default=None)
        if best is None or counts[best] < least:
            break
        new = v.add(*best, counts[best])
        rows = [(bpe.merged(t, {best: new}), n) for t, n in rows]
    return v


def trained(spark, words, **more):
    return bpe.train(spark.createDataFrame(list(words.items()), "word string, n long"), **more)


def test_merges_are_those_of_one_at_a_time(spark):
    counts = {r["word"]: r["n"] for r in bpe.word_counts(spark.read.parquet(f"{SF}/documents.parquet")).collect()}
    rounds = []
    independent = bpe.independent
    with pytest.MonkeyPatch.context() as m:
        m.setattr(bpe, "independent", lambda *a: rounds.append(1) or independent(*a))
        got = trained(spark, counts, merges=60)
    assert got.merges == plain(counts, 60).merges
    assert len(rounds) < 45


@pytest.mark.parametrize("seed", range(3))
def test_few_letters_and_many_ties(spark, seed):
    """Repeated letters, equal counts, and tokens that two merges spell."""
    rng = random.Random(seed)
    words = Counter("".join(rng.choices("abc" if seed else "ab", k=rng.randint(1, 7))) for _ in range(60))
    got = trained(spark, words, merges=25)
    want = plain(words, 25)
    assert got.merges == want.merges and got.tokens == want.tokens


def test_bounds_and_empty(spark):
    words = {"ab": 5, "cd": 1}
    assert trained(spark, words).merges == [("a", "b", 5)]
    assert trained(spark, {"ab": 5, "cd": 4}, size=262).merges == [("a", "b", 5)]
    assert trained(spark, {}).merges == [] and len(bpe.Vocabulary()) == 261 and len(set(bpe.alphabet())) == 256


def test_round_trip(spark):
    words = Counter({"Ġthe": 9, "the": 5, "Ġthen": 3, "Ã©": 4})
    v = plain(words, 10)
    texts = ["the then the", "hé 世界 \n\t the", "", None, "a'll  x ", "<|user|>"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = bpe.lossless(df, v, "doc_id").orderBy("doc_id").collect()
    assert all(r.same for r in rows) and [r.n_chars for r in rows] == [len(t or "") for t in texts]
    assert rows[0].n_tokens == len(bpe.encode(texts[0], v)) == 3
    assert bpe.lossless(df.limit(0), v, "doc_id").agg(F.count("*")).first()[0] == 0


def test_words_are_those_of_whole_texts(spark):
    """However white space is cut: Python finds the words of whole texts."""
    import regex

    assert set(bpe.SPACE) == {chr(c) for c in range(0x110000) if regex.match(r"\s", chr(c))}
    rng = random.Random(7)
    texts = ["".join(rng.choices([" ", " ", "a", "Bé", "'ll", "\n", "\t", "　", "\xa0", "\x1c", "7", "世", "😀", ".", "́"], k=rng.randint(0, 30))) for _ in range(400)] + [None, "", " ", "  ", " a", "a ", "a b  c"]
    letters = bpe.alphabet()
    want = Counter("".join(letters[b] for b in w.encode()) for t in texts for w in regex.findall(bpe.PATTERN, t or ""))
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    assert {r.word: r.n for r in bpe.word_counts(df).collect()} == want


def test_words_are_not_written_in_each_round(spark, monkeypatch):
    rng, written, table = random.Random(5), [], bpe.table
    words = Counter("".join(rng.choices("abcdef", k=rng.randint(1, 9))) for _ in range(200))
    monkeypatch.setattr(bpe, "table", lambda df, name: written.append(name) or table(df, name))
    assert trained(spark, words, merges=20).merges == plain(words, 20).merges
    assert written.count("words") == 1 and written.count("pairs") > 5
    monkeypatch.setattr(bpe, "PENDING", 3)
    assert trained(spark, words, merges=12).merges == plain(words, 12).merges
    assert written.count("words") > 2


def test_characters_are_ordered_as_tokens(spark):
    ids = [0, 5, 300, 0xD6FF, 0xD700, 70_000]
    assert sorted(ids, key=lambda i: bpe.character(i).encode()) == ids and len({bpe.character(i) for i in range(100_000)}) == 100_000
    df = spark.createDataFrame([("".join(map(bpe.character, ids)), 2)], "word string, n long")
    assert [r.pair for r in bpe._pairs(df).collect()] == [bpe.character(a) + bpe.character(b) for a, b in zip(ids, ids[1:], strict=False)]
