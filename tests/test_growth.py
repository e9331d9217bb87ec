"""What grows with the tables must not go through the driver, one task or one batch."""

import random
import re
import time
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from quillspark.llm import decontaminate
from quillspark.operators import bpe, features, metric, pages
from quillspark.plans import catalog, closures

from .oracle import SF, TABLES, duck_rows, spark_rows


def executed(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_hits_are_not_broadcast(spark):
    """Only the keys of documents with hits are; the hits' words and places compress to almost nothing, so their files look small."""
    words = [f"w{i}" for i in range(40)]
    items = spark.createDataFrame([(i, " ".join(words[i : i + 13])) for i in range(20)], "item_id long, text string")
    docs = spark.createDataFrame([(i, " ".join(words) if i % 2 else "nothing here") for i in range(50)], "doc_id long, text string")
    for most in (10, 1_000_000):
        out = decontaminate.decontaminate(docs, items, broadcast_keys=most)
        plan = executed(out)
        assert not re.search(r"BroadcastHashJoin .*(Inner|LeftOuter)", plan) and "SortMergeJoin" in plan
        assert {r.doc_id for r in out.where("contamination.contaminated").collect()} == set(range(1, 50, 2))


def test_long_and_many_words_are_encoded_fast():
    v = bpe.Vocabulary()
    for left, right in [("a", "b"), ("b", "c"), ("ab", "c"), ("abc", "a"), ("a", "bc"), ("a", "a"), ("aa", "aa")]:
        v.add(v.ids[left], v.ids[right], 1)
    order, rng = v.ranks(), random.Random(3)
    for _ in range(500):
        parts = word = rng.choices("abc", k=rng.randint(0, 12))
        parts = [*parts]
        while pairs := [(order[p], i) for i, p in enumerate(zip(parts, parts[1:], strict=False)) if p in order]:
            i = min(pairs)[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        assert bpe.encode("".join(word), v) == [v.ids[p] for p in parts]
    began = time.process_time()
    assert len(bpe.encode("aaab" * 10_000, v)) == 20_000
    for i in range(5_000):
        bpe.encode(f"zx{i}", v)
    assert time.process_time() - began < 4


@pytest.mark.parametrize("kind", ["normal", "few values"])
def test_many_queries_meet_vectors_without_clusters(spark, kind):
    """Nothing can be pruned, distances are equal by the dozen, and more than an old limit of 1,024 queries ask."""
    rng = np.random.default_rng(5)
    v = rng.normal(0, 1, (3000, 16)) if kind == "normal" else rng.integers(0, 2, (3000, 16))
    v = v.astype(np.float32).astype(np.float64)
    df = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(v)], "vec_id long, embedding array<float>").cache()
    got = {}
    began = time.time()
    for r in metric.nearest(df, df.where("vec_id % 2 = 0"), 5).orderBy("query", "rank").collect():
        got.setdefault(r["query"], []).append(r["id"])
    took = time.time() - began
    for i in range(0, 3000, 2):
        d = sum((v[:, k] - v[i, k]) ** 2 for k in range(16))
        assert got[i] == np.lexsort((np.arange(3000), d))[:5].tolist()
    assert took < 20
    text = df.select(F.col("vec_id").cast("string").alias("vec_id"), "embedding")
    assert metric.nearest(text, text.where("vec_id % 500 = 0"), 3).count() == 18


def linked(tmp_path, **own) -> str:
    """A folder of the small tables but for those given as arrow tables."""
    for name in TABLES:
        if name in own:
            pq.write_table(own[name], tmp_path / f"{name}.parquet", row_group_size=1000)
        else:
            (tmp_path / f"{name}.parquet").symlink_to(f"{SF}/{name}.parquet")
    return str(tmp_path)


def test_lines_of_one_number_count_by_their_place(spark, tmp_path):
    n = 30_000
    rng = np.random.default_rng(1)
    lines = pq.read_table(f"{SF}/lineitem.parquet").slice(0, 5000)
    lines = pa.concat_tables([lines] * 6)
    lines = lines.set_column(lines.schema.get_field_index("l_linenumber"), "l_linenumber", pa.array(rng.integers(1, 4, n), pa.int32()))
    lines = lines.set_column(lines.schema.get_field_index("l_linestatus"), "l_linestatus", pa.array([None if x == 2 else "OF"[x] for x in rng.integers(0, 3, n)]))
    at = linked(tmp_path, lineitem=lines)
    con = duckdb.connect(config={"threads": 1})  # several threads would read row groups in any order
    for name in ("orders", "lineitem"):
        con.execute(f"create view {name} as select * from '{at}/{name}.parquet'")
    want = con.sql(catalog.SQL["j07_delegation_result"]).fetchall()
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "32k")
    try:
        assert sorted(map(tuple, catalog.QUERIES["j07_delegation_result"](spark, at).collect())) == sorted(want)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)


def test_pages_of_a_batch_are_parsed_in_slices(spark):
    html = "".join(f'<a href="/{i}">link {i}</a>' for i in range(20))
    df = spark.range(2 * pages.PAGES + 3, numPartitions=1).select("id", F.when(F.col("id") != 40, F.lit(html)).alias("html"), F.concat(F.lit("http://x.y/"), "id", F.lit("/")).alias("url"))
    found = df.select("id", pages.page_fields(F.col("html"), F.col("url")).alias("f")).collect()
    assert pages.PAGES <= 64 and [r.id for r in found] == list(range(2 * pages.PAGES + 3))
    for r in found:
        assert [(x.url, x.text) for x in r.f.links] == ([] if r.id == 40 else [(f"http://x.y/{i}", f"link {i}") for i in range(20)])


def test_rows_of_their_own_id_are_not_shuffled(spark):
    texts = ["a b a b c d e f", "one", "", None, "x y x y x y x y"]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "doc_id long, text string")
    sides = features._sides()
    plan = executed(features.rouge_n(df, "doc_id", *sides, 2))
    assert "Exchange" not in plan and "Generate" not in plan
    more = df.union(spark.createDataFrame([(0, "b a b a"), (2, "q r s t"), (3, None)], df.schema))
    for n in (1, 2):
        want = {r[0]: r[1] for r in _rouge(more.collect(), n)}
        got = {r.doc_id: round(r.f, 9) for r in features.rouge_n(more, "doc_id", *sides, n).collect()}
        assert got == want and want[0] > 0
        alone = {r.doc_id: round(r.f, 9) for r in features.rouge_n(df, "doc_id", *sides, n).collect()}
        assert alone == dict(_rouge(df.collect(), n))


def _rouge(rows, n):
    """Counts of both sides by id, in plain Python."""
    counts = {}
    for r in rows:
        w = (r.text or "").split()
        for side, words in enumerate((w[: len(w) - len(w) // 4], w[len(w) // 4 :])):
            for i in range(len(words) - n + 1):
                counts.setdefault(r.doc_id, (Counter(), Counter()))[side][" ".join(words[i : i + n])] += 1
    return [(k, round(200 * sum((a & b).values()) / (sum(a.values()) + sum(b.values())), 9)) for k, (a, b) in counts.items()]


def test_ends_of_ways_go_through_no_rounds(spark, monkeypatch):
    """A thousand leaves of two parents each follow in one join; those below a cycle are in no layer."""
    seen = []
    own = closures.anchors
    monkeypatch.setattr(closures, "anchors", lambda edges, stops: seen.append(edges.count()) or own(edges, stops))
    pairs = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x")] + [(p, f"l{i}") for i in range(1000) for p in ("a", "bc"[i % 2])] + [("y", "m"), ("a", "m")]
    nodes = sorted({x for p in pairs for x in p} | {"alone"})
    found = closures.layers(spark.createDataFrame([(x,) for x in nodes], "node string"), spark.createDataFrame(pairs, "parent string, child string"))
    want = {"a": 0, "b": 1, "c": 2, "alone": 0} | {f"l{i}": 2 + i % 2 for i in range(1000)}
    assert {r["node"]: r["layer"] for r in found.collect()} == want
    assert seen == [4]  # edges to nodes that lead on: a-b, b-c, x-y, y-x
