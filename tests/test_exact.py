"""Results that rounding, the order of rows or the place of a text must not change."""

import math
import random
from collections import Counter
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from quillspark.llm import langid
from quillspark.operators import features, timeseries


def test_a_row_after_just_half_is_kept(spark):
    """97 + 51 of 296 hundredths come before the third row; as doubles they are more than half. Other weights stay doubles."""
    cents = [97, 51, 44, 39, 28, 15, 13, 9]
    rows = [("a", i, x / 100) for i, x in enumerate(cents)] + [("b", i, x) for i, x in enumerate((1e-20, 2e-20, 1e-21))] + [("c", 0, 3e12), ("c", 1, 1e12)]
    df = spark.createDataFrame(rows, "key string, id long, weight double")
    got = timeseries.nucleus(df, "key", "weight", "id", 0.5)
    assert {(r.key, r.id) for r in got.collect()} == {("a", 0), ("a", 1), ("a", 2), ("b", 1), ("c", 0)}
    assert got.where("key = 'c'").first().share == 0.75
    low = timeseries.nucleus(df.where("key = 'a'").withColumn("weight", F.col("weight") * 1e-10), "key", "weight", "id", 0.4)
    assert {r.id for r in low.collect()} == {0, 1}


def test_texts_of_a_batch_are_predicted_in_slices(monkeypatch):
    """Words of so many texts are held and scored at once, whatever the batch, and of many languages fewer are kept."""
    asked = []
    monkeypatch.setattr(langid, "word_log_probs", lambda lattice, probs, words: asked.append(words) or -np.tile(np.arange(1.0, probs.shape[1] + 1), (len(words), 1)))
    texts = ["".join(chr(97 + int(d)) for d in str(i)) + " word" if i % 100 else None for i in range(1000)]
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])

    def predict(langs: int, **held):
        asked.clear()
        shared = SimpleNamespace(value=([f"l{i:02}" for i in range(langs)], [b"a"], np.ones((1, langs))))
        return pa.Table.from_batches(langid._predict(shared, **held)(iter([batch, batch]))).to_pylist()

    want = [("l00", 1.0) if x else ("und", 0.0) for x in texts * 2]
    for langs, held in ((40, {}), (40, {"held": 40 * 300})):
        got = predict(langs, **held)
        assert [r["lang_pred"] for r in got] == [x for x, _ in want] and all((r["score"] > 0) == (y > 0) for r, (_, y) in zip(got, want, strict=True))
        assert max(map(len, asked)) <= 2 * langid.ROWS < 1000
        assert (sum(map(len, asked)) == 991) == (not held)


@pytest.mark.parametrize("repeated", [False, True])
def test_terms_kept_by_their_hashes_are_those_kept_by_counting(spark, monkeypatch, repeated):
    """The most frequent terms and their weights against plain Python, from texts in small slices, with and without shared ids;
    no row is shuffled for its weights unless it shares its id."""
    rng = random.Random(4)
    texts = [None, "", "lone"] + [" ".join(rng.choices([f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)], k=rng.randint(1, 90))) for _ in range(120)]
    ids = [None if i == 5 else i % 100 if repeated else i for i in range(len(texts))]
    monkeypatch.setattr(features, "WORDS_AT_ONCE", 200)
    tf = {}
    for i, x in zip(ids, texts, strict=True):
        w = (x or "").split()
        tf.setdefault(i, Counter()).update([*w, *map(" ".join, zip(w, w[1:], strict=False))])
    df, total = Counter(t for c in tf.values() for t in c), sum(tf.values(), Counter())
    for most in (40, 300):
        n = len(texts)
        kept = sorted((t for t in df if df[t] <= 0.3 * n), key=lambda t: (-total[t], t))[:most]
        want = {}
        for i, c in tf.items():
            v = {t: c[t] * (math.log((1 + n) / (1 + df[t])) + 1) for t in kept if t in c}
            want |= {(i, t): x / math.sqrt(sum(y * y for y in v.values())) for t, x in v.items()}
        docs = spark.createDataFrame(list(zip(ids, texts, strict=True)), "doc_id long, text string").repartition(3)
        found = features.tf_idf(docs, "doc_id", features._words(), 0.3, most)
        got = {(r.doc_id, r.term): r.weight for r in found.collect()}
        assert got == {k: pytest.approx(v) for k, v in want.items()}
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan and ("Generate" in plan) == repeated
