"""The pipeline against plain Python, as a whole and stage by stage."""

import itertools
import math
import re
import zlib

import corpus_pipeline
import duckdb
import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from quillspark.llm import langid, mixing, simhash

from ..oracle import SF
from .test_corpus_operators import DOCS, ODD, fingerprint, frame, log_probability


def kept_languages(docs, model):
    place, known = {p: k for k, p in enumerate(model.pieces)}, {}
    columns = [[math.log(x) for x in model.probs[:, k]] for k in range(len(model.langs))]
    out = {}
    for doc, text in docs.items():
        words = langid.WORD.findall(text.lower())
        for w in set(words) - known.keys():
            known[w] = [log_probability(place, c, langid.spaced(w)) for c in columns]
        total = [sum(x) for x in zip(*map(known.get, words), strict=True)]
        if words and 1 / sum(math.exp(t - max(total)) for t in total) >= 0.5:
            out[doc] = text
    return out


def one_of_each_group(docs):
    prints, parent = {d: fingerprint(t) for d, t in docs.items()}, {d: d for d in docs}

    def root(d):
        while parent[d] != d:
            d = parent[d]
        return d

    for a, b in itertools.combinations(prints, 2):
        if (prints[a] ^ prints[b]).bit_count() <= 4:
            x, y = sorted((root(a), root(b)))
            parent[y] = x
    return {d: t for d, t in docs.items() if root(d) == d}


def uncontaminated(docs, items):
    def words(text):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in text))

    windows = {tuple(w[i : i + min(13, len(w))]) for w in map(words, items) if w for i in range(len(w) - min(13, len(w)) + 1)}
    lengths, out = {len(w) for w in windows}, {}
    for doc, text in docs.items():
        w = words(text)
        hit = {k for n in lengths for i in range(len(w) - n + 1) if tuple(w[i : i + n]) in windows for k in range(i, i + n)}
        if not (hit and 20 * len(hit) >= len(w)):
            out[doc] = text
    return out


def test_run_is_brute_force(spark):
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r["doc_id"]: (r["text"] or "", r["source"]) for r in docs.collect()}
    left = kept_languages({d: t for d, (t, _) in rows.items()}, langid.fit_documents(docs))
    left = uncontaminated(one_of_each_group(left), [r["text"] or "" for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()])
    assert 0 < len(left) < len(rows)
    con = duckdb.connect()
    con.execute("create table documents (doc_id bigint, text varchar, source varchar)")
    con.executemany("insert into documents values (?, ?, ?)", [(d, t, rows[d][1]) for d, t in left.items()])
    found = con.execute(mixing.OP9_SQL)
    names = [d[0] for d in found.description]
    times = {r["doc_id"]: r["taken"] // r["size"] for r in (dict(zip(names, x, strict=True)) for x in found.fetchall())}
    tokenizer, start, want = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), 0, []
    for d in sorted(left):
        ids = [*tokenizer.encode(left[d], add_special_tokens=False).ids, 2]
        for _ in range(times[d]):
            want.append((d, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
            start += len(ids)
    got = corpus_pipeline.run(spark, SF).collect()
    assert sorted((r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in got) == want


def test_near_duplicates_of_rows_without_ids_and_with_equal_ones(spark):
    a, b = "one and two and three and four and five " * 9, "quite another text that says nothing of the kind " * 9
    df = frame(spark, [(None, a), (7, a), (3, a), (3, a), (None, b), (9, a + "x"), (9, "short"), (None, None)]).withColumn("_row", F.lit("mine"))
    got = corpus_pipeline.near_duplicates(spark, df, SF)
    assert got.columns == df.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", r["_row"]) for r in got.collect()) == [
        (False, 3, a, "mine"), (False, 9, "short", "mine"), (True, 0, "", "mine"), (True, 0, b, "mine"),
    ]


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    frames = [docs]
    for _, stage in corpus_pipeline.STAGES:
        frames.append(corpus_pipeline.table(stage(spark, frames[-1], SF), "stage"))
    assert all(f.columns == docs.columns for f in frames[:-1])
    ids = [[r["doc_id"] for r in f.select("doc_id").collect()] for f in frames]
    lang = {r["doc_id"]: r["language"] for r in langid.predict(docs, langid.fit_documents(docs)).collect()}
    assert set(ids[1]) == {d for d, x in lang.items() if x["lang_pred"] != "und" and x["score"] >= 0.5}
    classes = {r["doc_id"]: r["component_id"] for r in simhash.near_duplicates(frames[1]).collect()}
    assert sorted(ids[2]) == sorted(set(classes.values()))
    assert set(ids[3]) <= set(ids[2]) and set(ids[4]) <= set(ids[3])
    out = frames[5].orderBy("start").collect()
    assert sorted(r["doc_id"] for r in out) == sorted(ids[4])
    assert [r["start"] for r in out] == [sum(r["n_tokens"] for r in out[:k]) for k in range(len(out))]
    assert all(r["ids_crc32"] < 1 << 32 for r in out) and zlib.crc32(b"") == 0


def test_pipeline_of_odd_rows(spark):
    rows = spark.createDataFrame([(i, t, "en", None, None) for i, t in ODD], DOCS)
    for df in (rows, rows.limit(0)):
        for _, stage in corpus_pipeline.STAGES:
            df = corpus_pipeline.table(stage(spark, df, SF), "stage")
        assert df.columns[:1] == ["doc_id"]
