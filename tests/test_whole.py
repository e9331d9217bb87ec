"""Queries cover whole tables and whole texts: brute force on rows and words that a cut at the head would lose."""

import json
from collections import Counter

import numpy as np
import pytest

from quillspark.plans import catalog


def write(spark, d, name, rows, schema):
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{d}/{name}.parquet")


@pytest.fixture(scope="module")
def late_ids(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("late"))
    write(spark, d, "events", [(i, "click") for i in LATE], "event_id long, event_type string")
    write(spark, d, "embeddings", [(i, 0, v) for i, v in VECTORS.items()], "vec_id long, label int, embedding array<float>")
    return d


LATE = [0, 1, 2, 3, 4, 999, 1000, 1001, 1002, 1003, 1004, 1999, 2000, 2001, 10**9, 10**9 + 1]
VECTORS = {i: [float(i % 5), 1.0, float(-i % 3)] for i in (0, 1, 19, 20, 21, 10**6)}


def test_records_of_late_events(spark, late_ids):
    got = {r["event_id"]: r["n"] for r in catalog.QUERIES["n02_records"](spark, late_ids).collect()}
    assert got == {i: {0: 1, 1: 2, 2: 1, 3: 0}.get(i % 5, got.get(i)) for i in LATE}
    fields = {r["event_id"]: r["title"] for r in catalog.QUERIES["n03_alias_fields"](spark, late_ids).collect()}
    assert set(fields) == set(LATE)
    found = {r["event_id"]: r["json"] for r in catalog.QUERIES["n05_json_ladder"](spark, late_ids).collect()}
    assert set(found) == set(LATE)
    assert all(json.loads(found[i])["title"] == f"t{i}" for i in LATE if i % 5 == 4)


def test_deltas_of_late_events(spark, late_ids):
    got = {(r["event_id"], r["delta"]) for r in catalog.QUERIES["n16_stream_deltas"](spark, late_ids).collect()}
    assert got == {(i, "click") for i in LATE if i % 7}


def test_product_of_all_vectors(spark, late_ids):
    v = np.array(list(VECTORS.values()))
    got = {(r["i"], r["j"]): r["x"] for r in catalog.QUERIES["d18_matrix_product"](spark, late_ids).collect()}
    assert got == {(i, j): pytest.approx(x) for (i, j), x in np.ndenumerate(v.T @ v)}


def test_new_records_differ_in_their_tails(spark, tmp_path):
    opening = "boilerplate " * 30
    texts = [opening + "store", opening + "a", opening + "b", opening + "a", opening + "STORE ", None, "short"]
    write(spark, str(tmp_path), "documents", [(10 + i, x, "s") for i, x in enumerate(texts)], "doc_id long, text string, source string")
    got = sorted(r["doc_id"] for r in catalog.QUERIES["u05_new_records"](spark, str(tmp_path)).collect())
    assert got == [11, 12, 15, 16]


WORDS = ("a bb ccc dddd bb a eeeee " * 30 + "ffffff ggggggg").split()


@pytest.fixture(scope="module")
def long_texts(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("long"))
    texts = [" ".join(WORDS), "one two", "", None]
    write(spark, d, "documents", list(enumerate(texts)), "doc_id long, text string")
    write(spark, d, "conversations", [(0, i, " ".join(WORDS) + " :)") for i in range(2)], "conv_id long, turn int, text string")
    return d


def of(spark, d, name, column, **at):
    rows = catalog.QUERIES[name](spark, d).collect()
    return next(r[column] for r in rows if all(r[k] == v for k, v in ({"doc_id": 0} | at).items()))


def joined(values):
    return " ".join(str(x).lower() if isinstance(x, bool) else str(x) for x in values)


def test_labels_of_all_tokens(spark, long_texts):
    t = [len(w) for w in WORDS]
    k = len(t) // 3
    assert of(spark, long_texts, "n11_label_mask", "labels") == joined([-100] * k + t[k:])
    assert of(spark, long_texts, "n12_target_mask", "mask") == joined([False] * k + [True] * (len(t) - k))
    assert of(spark, long_texts, "n14_replace_ignored", "labels") == joined([0] * k + t[k:])
    ids = [None] + [i // 2 for i in range(1, len(t))]
    want = [-100 if w is None or w == before else t[w] for w, before in zip(ids, [-1] + ids[:-1], strict=True)]
    assert of(spark, long_texts, "n13_spread_labels", "labels") == joined(want)


def test_blocks_of_all_tokens(spark, long_texts):
    t = [len(w) for w in WORDS]
    got = sorted((r["pos"], r["block"], r["next"]) for r in catalog.QUERIES["w19_sliding_blocks"](spark, long_texts).collect())
    assert got == [(i, joined(t[i : i + 8]), t[i + 8]) for i in range(len(t) - 8)]


def test_rouge_of_all_words(spark, long_texts):
    k = len(WORDS) // 4
    a, b = WORDS[: len(WORDS) - k], WORDS[k:]
    for name, n in (("g15_rouge", 2), ("g15_rouge_1", 1)):
        x, y = (Counter(zip(*[w[i:] for i in range(n)], strict=False)) for w in (a, b))
        assert of(spark, long_texts, name, "f") == pytest.approx(200 * (x & y).total() / (x.total() + y.total()), abs=1e-4)
    row = [0] * (len(b) + 1)
    for x in a:
        last = row
        row = [0]
        for j, y in enumerate(b):
            row.append(last[j] + 1 if x == y else max(row[j], last[j + 1]))
    assert of(spark, long_texts, "g15_rouge_l", "f") == pytest.approx(200 * row[-1] / (len(a) + len(b)), abs=1e-4)
    assert of(spark, long_texts, "g15_rouge_l", "f", doc_id=3) == 0
    assert catalog.QUERIES["g15_generated_length"](spark, long_texts).first()[0] == (len(b) + 2) / 4


def test_expressions_on_whole_texts(spark, long_texts):
    whole = " ".join(WORDS)
    assert whole in of(spark, long_texts, "x05_emoji", "text")
    assert of(spark, long_texts, "x06_contractions", "text").endswith("; " + whole)
    assert of(spark, long_texts, "a13_chip", "output") == whole
    assert of(spark, long_texts, "a19_marked_prompt", "t") == f"<bos>translate: {whole}\n<eos>"
    turns = {r["turn"]: r for r in catalog.QUERIES["x16_thinking"](spark, long_texts).collect()}
    assert turns[0]["answer"].endswith(f"answer {whole} :)") and turns[0]["thinking"] == f"a{whole} :)"
    assert all(r["t"].count(whole) == 2 for r in catalog.QUERIES["x12_markdown"](spark, long_texts).collect())


def test_tf_idf_keeps_terms_beyond_20000(spark, tmp_path):
    write(spark, str(tmp_path), "documents", [(i, " ".join(f"w{i}x{k}" for k in range(120))) for i in range(100)], "doc_id long, text string")
    got = catalog.QUERIES["t01_tf_idf"](spark, str(tmp_path))
    assert got.count() == 100 * (120 + 119)
    assert got.where("abs(weight - 1 / sqrt(239)) > 1e-5").count() == 0
