"""Step deadlines, JSON queries, buffered shuffles, subscriptions, first responses and naive Bayes from counts."""

import math
import re
import time
from collections import Counter

import pytest
from pyspark.sql import functions as F

from quillspark.functions.query import Query
from quillspark.operators import bayes, corpus, joins
from quillspark.plans import dag
from quillspark.streaming import responses, streams, utterances

from .oracle import SF

# --- deadlines


def _slow(spark, seconds):
    def nap(batches):
        time.sleep(seconds)
        yield from batches

    return spark.range(1).mapInArrow(nap, "id long")


def test_a_late_step_is_cancelled_and_its_sibling_is_not(spark):
    tries = []
    steps = {"late": lambda _: tries.append(1) or _slow(spark, 60), "other": lambda _: _slow(spark, 3)}
    began, finished = time.time(), []
    with pytest.raises(TimeoutError, match="late"):
        dag.run(steps, [], lambda name, df: finished.append((name, df.count())) or df, retries=1, timeout_s={"late": 1.5}, spark=spark)
    assert len(tries) == 2 and finished == [("other", 1)] and time.time() - began < 40


def test_a_step_in_time_and_one_that_fails_at_first(spark):
    calls = []

    def flaky(done):
        calls.append(1)
        if len(calls) < 3:
            raise RuntimeError("again")
        return done["a"].where("id > 0")

    done = dag.run({"a": lambda _: spark.range(3), "b": flaky}, [("a", "b")], lambda _, df: (df.count(), df)[1], retries=2, timeout_s=60, spark=spark)
    assert done["b"].count() == 2
    with pytest.raises(RuntimeError):
        dag.run({"a": lambda _: (_ for _ in ()).throw(RuntimeError("no"))}, [], lambda _, df: df, spark=spark)


def test_conditions(spark):
    assert dag.holds(spark, "1 / n > 0", {"n": 0}) and dag.holds(spark, "missing > 0", {"n": 0}) and not dag.holds(spark, "n > 0", {"n": 0})


# --- JSON queries


def col(name, **more):
    return {"column": {"this": {"identifier": name}, **{k: {"identifier": v} for k, v in more.items()}}}


def simple(select, **more):
    return {"select": {"expressions": select}, "from": {"expressions": [{"table": {"this": {"identifier": "t"}}}]}, **more}


def number(n):
    return {"literal": {"this": str(n), "is_string": False}}


@pytest.fixture(scope="module")
def rows(spark):
    return {"t": spark.createDataFrame([("a", 1, 2.5), ("b", 150, None), ("c", 300, 1.0), ("b", 7, 0.0)], "name string, price int, `odd name` double")}


def test_json_queries(rows):
    take = lambda tree: [tuple(r) for r in Query(rows, tree).frame().collect()]
    assert take(simple([col("name"), col("odd name")]))[0] == ("a", 2.5)
    assert take(simple([col("name")], where={"gt": {"this": col("price"), "expression": number(100)}})) == [("b",), ("c",)]
    assert take(simple([{"star": {}}], where={"is_null": {"this": col("odd name")}})) == [("b", 150, None)]
    assert take(simple([col("name")], where={"like": {"this": col("name"), "expression": {"literal": {"this": "a%"}}}})) == [("a",)]
    assert take(simple([col("price")], where={"between": {"this": col("price"), "low": number(5), "high": number(200)}}, order={"expressions": [{"this": {"identifier": "price"}, "desc": True}]}, limit=1)) == [(150,)]
    group = simple([{"alias": {"this": {"sum": {"this": col("price")}}, "alias": {"identifier": "s"}}}, col("name"), {"count": {"this": {"star": {}}}}], group={"expressions": [col("name")]}, order={"expressions": [{"this": {"identifier": "name"}}]})
    assert take(group) == [(1, "a", 1), (157, "b", 2), (300, "c", 1)]
    assert take(simple([{"count_distinct": {"this": col("name")}}])) == [(3,)]
    # a name or literal is never more than one
    assert take(simple([col("name")], where={"eq": {"this": col("name"), "expression": {"literal": {"this": "x' OR '1'='1"}}}})) == []


@pytest.mark.parametrize(
    "tree",
    [
        simple([col("nothing")]), simple([col("name", table="u")]), simple([]), simple([{"exec": {"this": col("name")}}]), simple([col("name")], having={}), simple([col("name"), col("name")]),
        simple([col("name")], where={"eq": {"this": col("name")}}), simple([col("name")], where={"sum": {"this": col("price")}}), simple([col("name"), {"sum": {"this": col("price")}}]),
        simple([{"literal": {"this": "1; DROP", "is_string": False}}]), simple([col("name")], limit="1"), simple([col("name")], order={"expressions": [{"this": {"identifier": "price"}}]}),
        {"select": {"expressions": [col("name")]}, "from": {"expressions": [{"table": {"this": {"identifier": "users"}}}]}}, {"select": {"expressions": [col("name")]}},
        {"select": {"expressions": [col("name")]}, "from": {"expressions": [{"table": {"this": {"identifier": "t"}}}, {"table": {"this": {"identifier": "t"}, "alias": {"identifier": "u"}}}]}},
    ],
)
def test_unknown_parts_are_refused(rows, tree):
    with pytest.raises(ValueError):
        Query(rows, tree).frame()


# --- buffered shuffle


def test_buffered_shuffle(spark):
    df = spark.range(0, 5000, 1, 2).selectExpr("id", "cast(id % 3 AS string) AS s")
    places = df.select(F.spark_partition_id().alias("p"), "id").collect()
    out = corpus.buffered_shuffle(df, 100, 42)
    got = out.select(F.spark_partition_id().alias("p"), "id", "s").collect()
    assert sorted(r.id for r in got) == list(range(5000)) and all(r.s == str(r.id % 3) for r in got)
    assert got == corpus.buffered_shuffle(df, 100, 42).select(F.spark_partition_id().alias("p"), "id", "s").collect()
    assert got != corpus.buffered_shuffle(df, 100, 43).select(F.spark_partition_id().alias("p"), "id", "s").collect()
    for p in (0, 1):
        before, after = [r.id for r in places if r.p == p], [r.id for r in got if r.p == p]
        at = {x: i for i, x in enumerate(before)}
        assert all(at[x] - i <= 100 for i, x in enumerate(after))
        assert sum(at[x] != i for i, x in enumerate(after)) > 2000
    assert corpus.buffered_shuffle(df.limit(0)).collect() == []
    assert sorted(r.id for r in corpus.buffered_shuffle(df.limit(7), 100).collect()) == list(range(7))


# --- streams


def test_subscriptions_change_between_batches(spark, tmp_path):
    at = lambda n: F.timestamp_seconds(F.lit(n))
    events = lambda a, b: spark.range(a, b).select(F.col("id"), F.when(F.col("id") % 4 < 3, F.concat(F.lit("k"), (F.col("id") % 4).cast("string"))).alias("key"))
    subs = str(tmp_path / "subs")

    def subscribe(who, key, active, n):
        row = spark.range(1).select(F.lit(who).alias("subscriber"), F.lit(key).cast("string").alias("key"), F.lit(active).alias("active"), at(n).alias("at"))
        row.coalesce(1).write.mode("append").parquet(subs)

    def publish(a, b):
        events(a, b).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        stream = streams.follow(spark, str(tmp_path / "in"), events(0, 1).schema)
        streams.deliver(stream, "key", subs, str(tmp_path / "out"), str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()

    subscribe("ann", "k1", True, 1)
    subscribe("bob", None, True, 1)
    subscribe("bob", "k1", True, 1)  # to all and to one: each event once
    publish(0, 8)
    subscribe("cid", "k0", True, 2)
    subscribe("ann", "k1", False, 2)
    publish(8, 16)
    got = {(r.subscriber, r.id) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {("ann", 1), ("ann", 5), *(("bob", i) for i in range(16)), ("cid", 8), ("cid", 12)}
    assert spark.read.parquet(str(tmp_path / "out")).count() == len(got)


def test_first_responses_agree_with_batch(spark, tmp_path):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    utterances.with_rocksdb(spark)
    batch = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(3):
        batch.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    for days in (80, 160):  # they move the watermark past all others
        later = batch.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "event_type": F.lit("purchase"), "ts": F.col("ts") + F.expr(f"INTERVAL {days} DAYS")})
        later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = streams.follow(spark, str(tmp_path / "in"), batch.schema, 1)
    found = responses.first_responses(stream, "event_type = 'signup'", "event_type = 'purchase'", "user_id", "ts", 86400, late="40 days")
    try:
        found.writeStream.format("memory").queryName("firsts").outputMode("append").option("checkpointLocation", str(tmp_path / "at")).trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    want = joins.pair_requests(batch.where("event_type = 'signup'"), batch.where("event_type = 'purchase'"), "user_id", "ts", 86400).collect()
    assert sorted(map(tuple, spark.table("firsts").collect()), key=str) == sorted(map(tuple, want), key=str)
    assert any(r.response_id is None for r in want) and any(r.response_id is not None for r in want)


def test_first_response_is_one_sort(spark):
    """A user with very many requests and responses in the time: no pairs of them are made."""
    n = 100_000
    rows = spark.range(n).select(F.lit(1).alias("k"), F.timestamp_seconds(1_700_000_000 + F.col("id") / 10).alias("ts"), F.col("id").alias("event_id"))
    got = joins.pair_requests(rows.where("event_id % 2 = 0"), rows.where("event_id % 2 = 1"), "k", "ts", 86400)
    assert got.where("response_id = request_id + 1").count() == n // 2


# --- functions of whole columns


def test_vectorised_functions(spark):
    import pandas as pd

    from quillspark.functions.registry import Registry

    r, calls = Registry(), []

    @r.tool(returns="double")
    def scaled(a: pd.Series, b: pd.Series) -> pd.Series:
        """a times b"""
        assert isinstance(a, pd.Series)
        return a * b

    @r.tool()
    def plain(a: int) -> str:
        return f"<{a}>"

    df = spark.range(5).withColumn("half", F.col("id") / 2)
    assert [x.v for x in df.select(r.call("scaled", "id", "half").alias("v")).collect()] == [0, 0.5, 2, 4.5, 8]
    r.register(spark)
    assert spark.sql("SELECT plain(3) AS p, scaled(2D, 3D) AS s").first() == ("<3>", 6.0)
    assert [s["arguments"] for s in r.schemas()] == [{"a": "bigint"}, {"a": "column", "b": "column"}] and not calls
    with pytest.raises(ValueError):
        r.tool()(scaled)


# --- naive Bayes


def plain_accuracy(docs, alpha, equal, folds):
    right = []
    vocabulary = {w for *_, ws in docs for w in ws}
    classes = sorted({c for _, c, _ in docs})
    for fold in folds:
        train = [d for d in docs if d[0] % 3 != fold]
        counts = {c: Counter(w for _, k, ws in train if k == c for w in ws) for c in classes}
        prior = {c: 1 / len(classes) if equal else sum(k == c for _, k, _ in train) / len(train) for c in classes}

        def score(c, ws):
            total = sum(counts[c].values()) + alpha * len(vocabulary)
            return math.log(prior[c] or 1e-300) + sum(math.log((counts[c][w] + alpha) / total) for w in ws)  # noqa: B023

        held = [d for d in docs if d[0] % 3 == fold]
        right.append(sum(max(classes, key=lambda c: (score(c, ws), -c)) == k for _, k, ws in held) / len(held))  # noqa: B023
    return sum(right) / len(right)


def test_naive_bayes_is_that_of_fitted_models(spark):
    import random

    rng = random.Random(4)
    docs = [(i, c, rng.choices("abcdefgh", weights=[3 + c, 3, 3 - c, 1, 1, 1 + c, 1, 1], k=rng.randint(1, 12))) for i in range(150) for c in [rng.choice([0, 0, 1, 2])]]
    df = spark.createDataFrame([(i, c, ws) for i, c, ws in docs] + [(900, 1, []), (901, None, ["a"]), (902, 1, None)], "id long, c int, words array<string>")
    counts = bayes.Counts(df, "id", F.col("words"), "c", F.col("id") % 3)
    got = {(r.alpha, r.equal_priors): r.accuracy for r in counts.search((0.1, 2.0)).collect()}
    assert got == {(a, e): pytest.approx(plain_accuracy(docs, a, e, range(3))) for a in (0.1, 2.0) for e in (False, True)}
    weights = {r.term: r.weights for r in counts.model(1.0).collect()}
    assert len(weights) == 8 and all(sum(math.exp(w[c]) for w in weights.values()) == pytest.approx(1) for c in range(3))


def test_naive_bayes_of_rare_words(spark):
    """Words that one fold alone has, rows of nothing else, and repeated words; a row's counts travel to it, not its sums."""
    import random

    rng = random.Random(9)
    docs = [(i, c, [f"only{i}"] * rng.randint(0, 3) + [f"pair{i // 6}"] * rng.randint(0, 2) + rng.choices("ab", weights=[1 + c, 2], k=rng.randint(0, 4)) + ["z"] * (i % 5 == 0)) for i in range(120) for c in [rng.choice([0, 1, 1])]]
    docs = [d for d in docs if d[2]]
    counts = bayes.Counts(spark.createDataFrame(docs, "id long, c int, words array<string>"), "id", F.col("words"), "c", F.col("id") % 3)
    scores = counts.scores((0.1, 2.0))
    assert scores.count() == len(docs) * 4
    got = {(r.alpha, r.equal_priors): r.accuracy for r in counts.search((0.1, 2.0)).collect()}
    assert got == {(a, e): pytest.approx(plain_accuracy(docs, a, e, range(3))) for a in (0.1, 2.0) for e in (False, True)}
    plan = scores._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(id" in plan and not re.search(r"hashpartitioning\(id#\d+L, fold", plan)
