import json
import wave

import numpy as np
import pytest
from pyspark.sql import functions as F

from quillspark.functions import json as J
from quillspark.functions import text as T
from quillspark.functions.porter import stem_word
from quillspark.functions.registry import Registry, sql_type
from quillspark.operators import adapters, arrays, bpe, corpus, features, intake, joins, pages, records, relational, stores, timeseries
from quillspark.plans import dag, prefix
from quillspark.sources import readers, writers


def one(spark, expr, *values, names=("x", "y")):
    kinds = ", ".join(f"{n} string" for n, _ in zip(names, values, strict=False))
    return spark.createDataFrame([tuple(values)], kinds).select(expr.alias("r")).first()["r"]


@pytest.mark.parametrize("text, years", [("5-7 years", 5), ("5-7 years of experience", 7), ("3+ years exp", 3), ("international", 0), ("nothing", None), (None, None)])
def test_years(spark, text, years):
    assert one(spark, records.years_of_experience(F.col("x")), text) == years


@pytest.mark.parametrize("text, salary", [("$100k", "$100"), ("pays $100,000 – $150,000 a year", "$100,000 – $150,000"), ("", ""), (None, "")])
def test_salary(spark, text, salary):
    assert one(spark, records.salary_text(F.col("x")), text) == salary


def test_role_markers(spark):
    text = "noise ### Human: hi Human: there\n### Assistant: \n### Assistant: yes "
    assert [tuple(m) for m in one(spark, adapters.parse_role_markers(F.col("x")), text)] == [("user", "hi Human: there"), ("assistant", "yes")]
    assert one(spark, adapters.parse_role_markers(F.col("x")), "no marker") == []


def test_chat_template_drops_unknown_roles(spark):
    df = spark.createDataFrame([([("tool", "x"), ("user", "a"), ("assistant", None)],)], "m array<struct<role:string,content:string>>")
    assert df.select(adapters.render_chat(F.col("m"))).first()[0] == "<|user|>\na\n<|assistant|>\n\n<|endoftext|>"


def test_blank_and_strip(spark):
    for blank in (None, "", " ", "\n\t", " "):
        assert one(spark, T.is_blank(F.col("x")), blank)
    assert one(spark, T.strip(F.col("x")), "  é \n") == "é"
    assert one(spark, T.truncate(F.col("x"), 3), "a\U0001f30aéz") == "a\U0001f30aé" + T.MARKER
    assert one(spark, T.expand_contractions(F.col("x")), "I'm sure it isn't") == "i am sure it is not"


def test_stems():
    want = {"caresses": "caress", "ponies": "poni", "agreed": "agre", "hopping": "hop", "filing": "file", "relational": "relat", "sky": "sky", "adoption": "adopt", "roll": "roll", "controlling": "control"}
    assert {w: stem_word(w) for w in want} == want


@pytest.mark.parametrize("body, n", [('[{"title": "a"}]', 1), ('{"jobs": [1, 2]}', 2), ('{"data": {"a": 1}, "results": [1]}', 1), ("3", 0), ("broken {", 0), (None, 0)])
def test_records_in_json(spark, body, n):
    assert one(spark, J.n_records(F.col("x")), body) == n


def test_json_ladder_and_references(spark):
    assert json.loads(one(spark, J.first_json(F.col("x")), 'so ```json\n{"a": 1}\n``` done')) == {"a": 1}
    assert json.loads(one(spark, J.first_json(F.col("x")), 'so {"a": {"b": 2}} done')) == {"a": {"b": 2}}
    assert one(spark, J.first_json(F.col("x")), "none") is None
    outputs = F.create_map(F.lit("s1"), F.lit("v"))
    assert one(spark, J.resolve(F.col("x"), outputs), "$steps.s1.output") == "v"
    assert one(spark, J.resolve(F.col("x"), outputs), "$steps.s2.output") is None
    assert one(spark, J.resolve(F.col("x"), outputs), "plain") == "plain"


def test_page_fields(spark):
    html = "<title>t</title><nav>menu<nav>deep</nav></nav><script>'</p>'</script><div id=content><p>a &amp; b</p><p>c</p></div><a href='/x'>go</a>"
    f = one(spark, pages.page_fields(F.col("x"), F.col("y"), ("article", "#content", "body")), html, "http://h/p/q")
    assert (f["title"], f["text"], f["main"]) == ("t", "t\na & b\nc\ngo", "a & b\nc")
    assert [tuple(x) for x in f["links"]] == [("http://h/x", "go")]
    assert one(spark, pages.page_fields(F.col("x"), F.col("y")), None, None)["text"] == ""


def test_spread_labels(spark):
    df = spark.createDataFrame([([None, 0, 0, 1, None], [5, 6])], "w array<int>, l array<int>")
    assert df.select(arrays.spread_labels(F.col("w"), F.col("l"))).first()[0] == [-100, 5, -100, 6, -100]
    assert df.select(arrays.spread_labels(F.col("w"), F.col("l"), True)).first()[0] == [-100, 5, 5, 6, -100]


def test_frames_are_numpys(spark):
    y = np.arange(10.0)
    got = spark.createDataFrame([(y.tolist(),)], "y array<double>").select(arrays.frames(F.col("y"), 4, 2)).first()[0]
    p = np.pad(y, 2, mode="reflect")
    assert got == [p[i * 2 : i * 2 + 4].tolist() for i in range((len(p) - 4) // 2 + 1)]


@pytest.mark.parametrize("parts", [1, 7])
def test_packing_keeps_tokens(spark, parts):
    rows = [(i, "ab"[i % 2], " ".join(f"{i}.{k}" for k in range(i % 5))) for i in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string").repartition(parts)
    got = {(r["source"], r["chunk"]): r["tokens"] for r in corpus.pack(df, "doc_id", T.tokens(F.col("text")), 7, "source").collect()}
    for s in "ab":
        flat = [t for i, source, text in rows if source == s for t in text.split()]
        assert [got[s, k] for k in range(len(flat) // 7)] == [flat[k * 7 : k * 7 + 7] for k in range(len(flat) // 7)]
    assert len(got) == sum(sum(len(t.split()) for _, x, t in rows if x == s) // 7 for s in "ab")


@pytest.mark.parametrize("length", [1, 4, 33])
def test_packing_of_texts_of_all_lengths(spark, length):
    """Empty, null and one-word texts, such that fill chunks exactly or many of them, null sources; texts are shuffled once."""
    rng = np.random.default_rng(length)
    sizes = [0, 1, length - 1, length, length + 1, 2 * length, 5 * length + 3]
    rows = [(int(i) * 3, [None, "a", "b"][i % 3], None if i % 11 == 5 else " ".join(f"{i}.{k}" for k in range(rng.choice(sizes)))) for i in rng.permutation(150)]
    df = spark.createDataFrame(rows, "doc_id long, source string, text string")
    packed = corpus.pack(df, "doc_id", T.tokens(F.col("text")), length, "source")
    got = [(r["source"], r["chunk"], r["tokens"]) for r in packed.collect()]
    want = []
    for s in (None, "a", "b"):
        flat = [t for _, source, text in sorted(rows, key=lambda r: r[0]) if source == s for t in (text or "").split()]
        want += [(s, k, flat[k * length : k * length + length]) for k in range(len(flat) // length)]
    assert sorted(got, key=str) == sorted(want, key=str)
    plan = packed._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan


@pytest.mark.parametrize("parts", [1, 5])
def test_prefix_sums(spark, parts):
    df = spark.range(0, 10_000, 3).withColumn("v", F.col("id") % 7).repartition(parts)
    got = {r["id"]: r["s"] for r in prefix.total_before(df, "id", F.col("v"), "s").collect()}
    total = 0
    for i in range(0, 10_000, 3):
        assert got[i] == total
        total += i % 7


def test_budget_edges(spark):
    df = spark.createDataFrame([(1, 0), (2, 9), (3, 1), (4, 0), (5, 2)], "id long, n long")
    assert sorted(r["id"] for r in corpus.within_budget(df, "id", F.col("n"), 10).collect()) == [1, 2, 3]
    assert [r["id"] for r in corpus.within_budget(df.where("id = 5"), "id", F.col("n"), 1).collect()] == [5]
    assert corpus.within_budget(df, "id", F.col("n"), 0).count() == 0


def test_split_is_complete_and_disjoint(spark):
    split = corpus.hash_split(spark.range(1000), F.col("id"), 100, "s")
    sizes = {r["split"]: r["count"] for r in split.groupBy("split").count().collect()}
    assert sum(sizes.values()) == 1000 and 50 < sizes["test"] < 150
    quotas = corpus.mixture_quotas(spark.createDataFrame([("a",), ("b",)], "s string"), "s", {"a": 2, "b": 1, "gone": 5}, 10)
    assert {r["s"]: r["quota"] for r in quotas.collect()} == {"a": 7, "b": 3}


def test_stores(spark):
    store = spark.createDataFrame([("a", 1, "x"), ("b", 2, "y")], "k string, o int, v string")
    changes = spark.createDataFrame([("a", 5, "n"), ("a", 6, ""), ("c", 1, None)], "k string, o int, v string")
    assert {(r["k"], r["o"]) for r in stores.upsert(store, changes, ["k"], ["o"]).collect()} == {("a", 6), ("b", 2), ("c", 1)}
    assert {(r["k"], r["v"]) for r in stores.patch(store, changes.where("o = 6"), "k", ["v"]).collect()} == {("a", "x"), ("b", "y")}
    assert [r["k"] for r in stores.insert_new(store, changes, ["k"], ["o"]).collect()] == ["c"]
    assert stores.upsert(store.limit(0), changes.limit(0), ["k"], ["o"]).count() == 0


def test_substring_match(spark):
    known = spark.createDataFrame([("tata", "service", 0), ("ey", "consulting", 1), ("abc", "product", 2)], "known string, type string, ord int")
    names = spark.createDataFrame([("Tata Consultancy",), ("abc",), ("zzz",), (" ",), (None,)], "n string")
    got = {r["n"]: (r["type"], r["confidence"]) for r in joins.substring_match(names, "n", known, "known", "type", "unknown").collect()}
    assert got == {"tata consultancy": ("service", "medium"), "abc": ("product", "high"), "zzz": ("unknown", "low")}


def test_metrics_without_positives(spark):
    df = spark.createDataFrame([(0, 0), (0, 0)], "t int, p int")
    assert tuple(features.binary_metrics(df, "t", "p").first()) == (0, 0, 0, 0.0, 0.0, 0.0, 1.0)


def test_merges(spark):
    df = spark.createDataFrame([("low low low lower lowest newest newest",)], "text string")
    assert [m[:2] for m in bpe.train(bpe.word_counts(df), merges=2).merges] == [("l", "o"), ("lo", "w")]


def test_nearest_with_ties(spark):
    df = spark.createDataFrame([(0, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [3.0, 4.0])], "vec_id long, embedding array<double>")
    got = joins.nearest(df, df.where("vec_id = 0"), 3).orderBy("rank").collect()
    assert [(r["id"], r["distance"]) for r in got] == [(0, 0.0), (1, 0.0), (2, 5.0)]
    assert joins.nearest(df, df, 1, most=2).count() == 3


def test_select_only(spark):
    spark.range(3).createOrReplaceTempView("three")
    assert relational.select_only(spark, "WITH x AS (SELECT id FROM three) SELECT sum(id) AS s FROM x").first()["s"] == 3
    for text in ("DROP VIEW three", "CREATE TABLE t AS SELECT 1", "INSERT INTO three VALUES (1)", "SET a=b", "CACHE TABLE three", "WITH x AS (SELECT 1 AS id) INSERT INTO three SELECT * FROM x"):
        with pytest.raises(ValueError):
            relational.select_only(spark, text)
    assert relational.markdown(spark.sql("SELECT 1 AS a, NULL AS b")) == "a | b\n--- | ---\n1 | "


def test_layers(spark):
    assert dag.layers(["d", "b", "c", "a"], [("a", "b"), ("a", "c"), ("b", "d"), ("c", "d"), ("a", "b"), ("gone", "a")]) == [["a"], ["b", "c"], ["d"]]
    with pytest.raises(ValueError):
        dag.layers(["a", "b"], [("a", "b"), ("b", "a")])
    assert dag.holds(spark, "n > 2", {"n": 3}) and not dag.holds(spark, "n > 2", {"n": 1}) and dag.holds(spark, "broken >", {"n": 1})
    done = dag.run({"a": lambda _: spark.range(3), "b": lambda x: x["a"].where("id > 0")}, [("a", "b")], lambda _, df: df)
    assert done["b"].count() == 2


def test_registry(spark):
    r = Registry()

    @r.tool(description="adds", tags=("math",))
    def plus(a: int, b: int | None) -> int:
        return a + (b or 0)

    r.register(spark)
    assert spark.sql("SELECT plus(2, 3) AS x").first()["x"] == 5
    assert r.schemas()[0]["arguments"] == {"a": "bigint", "b": "bigint"} and sql_type(list[int]) == "array<bigint>" and sql_type(object) == "string"
    with pytest.raises(KeyError):
        r.call("gone")


def test_sources_and_sinks(spark, tmp_path):
    p = tmp_path / "a.jsonl"
    p.write_text('{"text": "é"}\nbroken\n\n{"text": null}\n', encoding="utf-8")
    good, bad = readers.json_lines(spark, str(p), "text string")
    assert [r["text"] for r in good.collect()] == ["é", None] and [r["value"] for r in bad.collect()] == ["broken"]
    (tmp_path / "l.csv").write_bytes("1,caf\xe9\n".encode("latin-1"))
    assert readers.latin_csv(spark, str(tmp_path / "l.csv"), ["label", "text"]).first()["text"] == "café"
    (tmp_path / "arr.json").write_text('[{"a": 1},\n {"a": 2}]')
    assert readers.json_array(spark, str(tmp_path / "arr.json"), "a int").count() == 2
    with pytest.raises(ValueError):
        readers.by_suffix(spark, "x.xyz")
    d = tmp_path / "bins"
    d.mkdir()
    (d / "b.bin").write_bytes(np.array([1, 65535], "<u2").tobytes())
    (d / "odd.bin").write_bytes(b"123")
    assert [r["ids"] for r in readers.token_files(spark, str(d)).collect()] == [[1, 65535]]
    assert readers.listed(spark, str(d)).count() == 2
    with wave.open(str(d / "w.wav"), "wb") as w:
        w.setnchannels(2)
        w.setsampwidth(2)
        w.setframerate(8000)
        w.writeframes(np.array([[0, 16384], [-16384, -16384]], "<i2").tobytes())
    got = readers.wave_files(spark, str(d)).select("sample_rate", "samples", readers.resample(F.col("samples"), 8000, 16000).alias("twice")).first()
    assert got["samples"] == [0.25, -0.5] and len(got["twice"]) == 4
    s = tmp_path / "sessions"
    s.mkdir()
    (s / "1.json").write_text('{"messages": [{"role": "user", "content": "hi"}]}')
    (s / "2.json").write_text("{broken")
    assert sorted(len(r["messages"]) for r in readers.sessions(spark, str(s)).collect()) == [0, 1]
    writers.write_chunks(spark.range(25), str(tmp_path / "chunks"), "id", 10)
    assert sorted(x.name for x in (tmp_path / "chunks").iterdir() if x.is_dir()) == ["chunk=0", "chunk=1", "chunk=2"]
    writers.write_splits(corpus.hash_split(spark.range(50), F.col("id"), 200), str(tmp_path / "splits"))
    writers.write_splits(spark.range(1).withColumn("split", F.lit("x")), str(tmp_path / "splits"))
    assert spark.read.json(str(tmp_path / "splits")).count() == 50
    writers.write_shuffled(spark.range(50), str(tmp_path / "shards"), "id", 4, "s")
    assert spark.read.json(str(tmp_path / "shards")).count() == 50
    writers.write_report(spark.range(1), str(tmp_path / "report"))


def test_clean_tweet_is_its_eleven_steps(spark):
    import re

    def plain(tweet):
        tweet = re.sub(r"@[^\s]+", "", tweet.lower())
        tweet = re.sub(r"((www\.[^\s]+)|(https?://[^\s]+))", " ", tweet)
        tweet = re.sub("&quot;", " ", re.sub(r"\d+", " ", tweet))
        for pattern, word in T.EMOJI:
            tweet = re.sub(pattern, word, tweet)
        tweet = re.sub(r"[^\w\s]", " ", re.sub(r"\b[a-zA-Z]\b", "", tweet))
        tweet = re.sub(r"\b[a-zA-Z]{2}\b", "", re.sub(r"(..)\1+", r"\1", tweet))
        return re.sub(r"\s+", " ", tweet)

    tweets = ["@me Hahahaha :) see https://x.y/z?a=1 &quot;it&quot; is 12 o'clock, ÉÉÉÉ ab", "", "a b c\tdd\n\nsoooo goooood!!", "É 日本日本日本 x :-( <3 www.a.b"]
    rows = spark.createDataFrame([(t,) for t in tweets], "t string").select("t", T.clean_tweet(F.col("t")).alias("x")).collect()
    assert all(r["x"] == plain(r["t"]) for r in rows)


def test_unwrap_calls_up_to_the_first_bracket(spark):
    found = lambda q: one(spark, T.unwrap_calls(F.col("x")), q)
    assert found("SELECT convert_tz( a.b , 'x','y'), COALESCE(c) FROM t") == "SELECT a.b, c FROM t"
    assert found("COALESCE(f(b, c), d)") == "f(b, c, d)" and found("COALESCE()") == "" and found("none (a, b)") == "none (a, b)"


def test_sentences_titles_and_first_fields(spark):
    assert one(spark, T.sentences(F.col("x")), "One. Two!  Three? four.five") == ["One.", "Two!", "Three?", "four.five"]
    assert one(spark, T.slug_title(F.col("x")), "two-big words") == "Two Big Words"
    assert one(spark, J.record_fields(F.col("x")), '[{"title": "t", "company": {"name": "c"}}]')["title"] == "t"


def test_container_is_the_first_of_the_first_selector(spark):
    html = "<body>head<article>late</article><div data-testid='jobDescription'>by <b>mark</b></div><p class='x description'>one</p><p class=description>two</p></body>"
    main = lambda h: one(spark, pages.page_fields(F.col("x"), F.lit("http://h")), h)["main"]
    assert main(html) == "one" and main(html.replace("description", "other")) == "by\nmark"
    assert main("<body>a<p>b</p></body>") == "a\nb" and main("<p>no body</p>") == ""
    deep = pages._Page("<aside>" * 30000 + "x" + "</b>" * 30000)
    assert deep.first("aside") == ["x"]


def test_substring_match_is_brute_force(spark):
    import random

    r = random.Random(6)
    names = ["".join(r.choice("abc ") for _ in range(r.randint(1, 6))) for _ in range(80)]
    known = [("".join(r.choice("ABc") for _ in range(r.randint(1, 5))), f"v{i}", i) for i in range(30)]
    got = joins.substring_match(spark.createDataFrame([(n,) for n in names], "n string"), "n", spark.createDataFrame(known, "k string, v string, ord int"), "k", "v", "none")
    want = {}
    for n in {x.strip().lower() for x in names} - {""}:
        exact = [(o, v) for k, v, o in known if k.lower() == n]
        part = [(o, v) for k, v, o in known if k.lower() in n or n in k.lower()]
        want[n] = (min(exact)[1], "high") if exact else (min(part)[1], "medium") if part else ("none", "low")
    assert {x["n"]: (x["v"], x["confidence"]) for x in got.collect()} == want


def test_nearest_in_blocks(spark):
    rows = [(i, [float(i % 7), float(i % 11)]) for i in range(120)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = {(x["query"], x["rank"]): x["id"] for x in joins.nearest(df, df, 3, most=13).collect()}
    for q, v in rows:
        best = sorted(rows, key=lambda b: (sum((x - y) ** 2 for x, y in zip(b[1], v, strict=True)), b[0]))[:3]
        assert [got[q, k] for k in (1, 2, 3)] == [b[0] for b in best]
    assert len(got) == 360


def test_descendants_and_cycles(spark):
    edges = spark.createDataFrame([("a", "b"), ("b", "c"), ("x", "y")], "parent string, child string")
    root = spark.createDataFrame([("a",)], "node string")
    assert {tuple(r) for r in relational.descendants(root, edges).collect()} == {("a", 0), ("b", 1), ("c", 2)}
    around = spark.createDataFrame([("a", "b"), ("b", "a"), ("b", "c")], "parent string, child string")  # a cycle is walked once
    assert {tuple(r) for r in relational.descendants(root, around).collect()} == {("a", 0), ("b", 1), ("c", 2)}


@pytest.mark.parametrize("kind", ["hashed", "clustered", "one", "empty"])
def test_prefix_sums_of_any_ids(spark, kind):
    import random

    r = random.Random(1)
    ids = {"hashed": [r.getrandbits(63) - (1 << 62) for _ in range(3000)], "clustered": [10**18 + i for i in range(2000)] + [-5] * 3 + [None] * 2 + [i * 10**9 for i in range(300)], "one": [7] * 50, "empty": []}[kind]
    df = spark.createDataFrame([(i, k % 7) for k, i in enumerate(ids)], "id long, v long")
    total, want = 0, []
    for given, i, v in sorted((i is not None, i or 0, k % 7) for k, i in enumerate(ids)):
        want.append((given, i, v, total))
        total += v
    got = prefix.total_before(df, "id", F.col("v"), "t", ties=("v",)).collect()
    assert sorted((x["id"] is not None, x["id"] or 0, x["v"], x["t"]) for x in got) == want
    ranges = df.select(prefix.range_of(F.col("id"), prefix.quantiles(df, "id")).alias("r")).groupBy("r").count().agg(F.max("count")).first()[0]
    assert (ranges or 0) <= max(50, len(ids) // 10)


def test_percentiles_are_exact(spark):
    import numpy as np

    values = [float(x % 13) / 3 for x in range(500)] + [1e9, -4.5]
    got = timeseries.percentiles(spark.createDataFrame([(v,) for v in values] + [(None,)], "v double"), "v", (0.5, 0.9, 0.99)).first()
    assert np.allclose(list(got), np.percentile(values, [50, 90, 99]))


def test_line_text_shapes(spark):
    text = lambda line: one(spark, intake.line_text(F.col("x")), line)
    assert text('{"messages": [{"role": "user", "content": "hi"}], "text": "no"}') == "<|user|>\nhi\n<|endoftext|>"
    assert text('{"text": "", "content": "c"}') == "c" and text('{"text": "t", "content": "c"}') == "t"
    assert [text(x) for x in ('{"content": " "}', '{"other": 1}', "broken", "[1]", None)] == [None] * 5


def test_guards(spark):
    df = spark.createDataFrame([(1, "a")], "k long, v string")
    with pytest.raises(ValueError, match="missing columns: w"):
        intake.require_columns(df, ["k", "w"])
    with pytest.raises(ValueError, match="no such board"):
        intake.board_record(F.col("v"), "other")
    assert one(spark, intake.company_names(F.col("x")), '["A ", {"company": "a"}, {"company": "B"}, {"x": 1}, 3, null]') == ["A", "B"]
    assert one(spark, intake.stream_tokens(F.col("x")), 'data: {"usage": {"completion_tokens": 3}, "data": [{"data": "d"}]}') == ["3", "d"]


def test_log_mel_of_a_tone(spark):
    rate, n = 16_000, 4000
    tone = np.sin(2 * np.pi * 1000 * np.arange(n) / rate)
    got = np.array(spark.createDataFrame([(tone.tolist(),), ([0.0] * 10,)], "x array<double>").select(arrays.log_mel(F.col("x")).alias("m")).collect()[0]["m"])
    assert got.shape == (n // 160 + 1, 80)
    padded, window = np.pad(tone, 256, mode="reflect"), np.zeros(512)
    window[56:456] = [0.5 - 0.5 * np.cos(2 * np.pi * k / 400) for k in range(400)]
    filters = arrays.mel_filters(80, 512, rate)
    for t in (0, 7, 25):
        frame = padded[t * 160 : t * 160 + 512] * window
        power = [abs(sum(frame * np.exp(-2j * np.pi * k * np.arange(512) / 512))) ** 2 for k in range(257)]
        assert np.allclose(got[t], np.log(filters @ power + 1e-6), atol=1e-6)
    top = 700 * (10 ** ((got[10].argmax() + 1) * 2595 * np.log10(1 + 8000 / 700) / 81 / 2595) - 1)
    assert abs(top - 1000) < 60 and (filters.max(axis=0)[1:-1] > 0).all()


def test_classifiers_by_grid_search(spark):
    from quillspark.operators import classifiers

    rows = [(f"{'good fine' if i % 2 else 'bad poor'} word{i % 3}", i % 2) for i in range(40)] + [(None, 1), ("no label", None)]
    data = classifiers.hashed_terms(spark.createDataFrame(rows, "text string, y int"), T.tokens(F.col("text")), "y", size=64)
    assert data.count() == 40
    model, settings, score = classifiers.naive_bayes_search(data, alphas=(0.1, 1.0), folds=2)
    assert score == 1.0 and settings["smoothing"] in (0.1, 1.0) and model.transform(data).where("prediction <> label").count() == 0
    model, settings, score = classifiers.boosted_trees_search(data, depths=(2,), rates=(0.1,), trees=(2,), folds=2)
    assert score > 0.9 and settings == {"maxDepth": 2, "stepSize": 0.1, "maxIter": 2} and model.transform(data).where("prediction <> label").count() == 0
