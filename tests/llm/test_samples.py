"""Samples of tables larger than any here: their sizes are faked; and repeated rows of one id and text."""

import numpy as np
import pytest

from quillspark.llm import pii, quality, repeats
from tests.oracle import SF


@pytest.fixture
def huge(spark, monkeypatch):
    """Documents whose count is said to be 10**11."""
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    monkeypatch.setattr(type(docs), "count", lambda self: 10**11)
    return docs


def test_pii_field_of_a_huge_table(spark, huge):
    small = spark.read.parquet(f"{SF}/documents.parquet")
    got = pii.fit(huge)
    with pytest.MonkeyPatch.context() as m:
        m.setattr(type(small), "count", lambda self: 200)
        want = pii.fit(small)
    assert np.array_equal(got.unary, want.unary) and np.array_equal(got.pair, want.pair) and np.any(got.unary)


def test_scorer_of_a_huge_table(spark, monkeypatch):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = quality.fit(docs)
    frames = quality.least_hashes
    monkeypatch.setattr(quality, "least_hashes", lambda rows, order, most, total: frames(rows, order, most, 10**11))
    got = quality.fit(docs)
    assert np.array_equal(got.quality[0], want.quality[0]) and np.array_equal(got.toxic[0], want.toxic[0]) and np.any(want.quality[0])


def test_repeated_rows_share_their_spans(spark):
    words = [f"w{i}" for i in range(130)]
    first, again = " ".join(words), " ".join(["x", *words[10:100], "y"])
    rows = [(1, first)] + [(2, again)] * 3000 + [(3, again)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    seen = []
    table = repeats.table
    with pytest.MonkeyPatch.context() as m:
        def kept(frame, name):
            out = table(frame, name)
            if name == "repeats":
                seen.extend(len(r["repeats"]) for r in out.collect())
            return out

        m.setattr(repeats, "table", kept)
        got = repeats.remove_repeats(df).collect()
    assert sorted({(r.doc_id, r.n_words, r.n_removed, r.kept) for r in got}) == [(1, 130, 0, first), (2, 92, 90, "x y"), (3, 92, 92, "")]
    assert len(got) == 3002 and max(seen) < 200
