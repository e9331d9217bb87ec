"""Periodic runs, the prefix trie and SentencePiece coding against brute force, and their odd rows."""

import hashlib
import random
import re
import struct
import zlib

import duckdb
import numpy as np
import public_tokenizers
import pytest
import sentencepiece

from quillspark.llm import periodic, pieces, prefixes
from tests.oracle import SF, norm, spark_rows

MODEL = public_tokenizers.path("piece_bpe_32k.model")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


# --- periodic runs


def plain_runs(words, least=12):
    numbers, seen, out = {}, set(), []
    w = np.array([numbers.setdefault(x, len(numbers)) for x in words], dtype=np.int64)
    for q in range(1, len(w) // 2 + 1):
        edges = np.diff(np.concatenate([[0], w[:-q] == w[q:], [0]]).astype(int))
        for a, b in zip(np.flatnonzero(edges == 1), np.flatnonzero(edges == -1), strict=True):
            run = (int(a), int(b - a + q))
            if run[1] >= max(least, 2 * q) and run not in seen:
                seen.add(run)
                out.append((*run, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def collapsed(words, found):
    drop = {i for a, size, q in found for i in range(a + q, a + size)}
    return " ".join(w for i, w in enumerate(words) if i not in drop)


def made_words(rng):
    kind = rng.random()
    if kind < 0.3:
        return rng.choices(rng.choice(["ab", "abc"]), k=rng.randint(0, 200))
    if kind < 0.7:  # runs within runs, with a word changed here and there
        w = rng.choices("abc", k=rng.randint(1, 4))
        for _ in range(rng.randint(1, 4)):
            w = (w * rng.randint(1, 6))[:300]
            if rng.random() < 0.6:
                w[rng.randrange(len(w))] = rng.choice("abcd")
            w = rng.choices("abc", k=rng.randint(0, 3)) + w
        return (w * 2)[:400]
    if kind < 0.8:  # Fibonacci words have as many runs as words can
        a, b = ["a"], ["a", "b"]
        while len(b) < 150:
            a, b = b, b + a
        return b[rng.randint(0, 9) :]
    w = rng.choices("abcdefgh", k=rng.randint(10, 60)) * rng.randint(2, 5)
    return w[: rng.randint(0, len(w))] + rng.choices("abcdefgh", k=5)


@pytest.mark.parametrize("seed", range(4))
def test_runs_are_those_of_every_period(seed):
    rng = random.Random(seed)
    for _ in range(300):
        words, numbers = made_words(rng), {}
        got = periodic.runs(np.array([numbers.setdefault(w, len(numbers)) for w in words], dtype=np.int32))
        assert [tuple(map(int, r)) for r in got] == plain_runs(words), words


def test_runs_of_odd_rows(spark):
    rng = random.Random(9)
    texts = [None, "", " \t\n", "a " * 12, "a " * 11, "A a " * 12, " ".join("ab" * 6 + "c"), "x " * 30000 + "y", " ".join(map(str, range(5000))) * 2]
    texts += [" ".join(made_words(rng)) for _ in range(60)]
    rows = [(i, t, "r", 1) for i, t in enumerate(texts)] + [(None, "b " * 20, "r", 1), (3, "a " * 12, "r", 1), (3, "a " * 12, "r", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, runs string, n_words int")
    want = []
    for doc, text, *_ in rows:
        words = WORD.findall(text or "")
        found = plain_runs(words) if len(words) < 3000 else [(0, 30000, 1)] if words[0] == "x" else None
        want.append((doc, len(words), found, None if found is None else collapsed(words, found)))
    for batch in (7, 1 << 19):  # every text of its own, and all together
        got = [(r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in periodic.periodic_runs(df, batch_words=batch).collect()]
        got = [(*g[:2], None, None) if g[1] == 9999 else g for g in got]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert periodic.periodic_runs(df.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periodic.periodic_runs(df, least_words=7)


def test_op11_as_its_contract_says(spark):
    def expected(doc, text):
        words = WORD.findall(text or "")
        n, h = len(words), zlib.crc32(str(doc).encode())
        g = h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        found = plain_runs(words)
        best = max(found, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
        row = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
        return (doc, len(found), *row, digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(collapsed(words, found)))

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = periodic.op11_periodic_runs(spark, SF)
    assert got.columns[:8] == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(r.doc_id, r.text) for r in docs)


# --- SentencePiece


@pytest.fixture(scope="module")
def library():
    return sentencepiece.SentencePieceProcessor(model_file=MODEL)


def made_text(rng):
    parts = [*"ab cdeth.,;:!?()[]{}«»”’*%#01  ▁\n\té世😀<>s/|　\xa0\x00̀À.-'\"", "  ", "   ", "the", "ing", " word", "ﬁ"]
    return "".join(rng.choices(parts, k=rng.randint(0, 40)))


def test_codes_are_those_of_the_library(spark, library):
    rng = random.Random(3)
    rows = [(i, made_text(rng), "x") for i in range(4000)]
    rows += [(None, None, "x"), (None, "a", "x"), (5, "", "x"), (5, " ", "x"), (5, " ", "x"), (6, "ab" * 30000, "x"), (7, " " * 4000 + "▁", "x"), (8, "b ", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    want = []
    for doc, text, _ in rows:
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        want.append((doc, struct.pack(f"<{len(ids)}I", *ids), library.decode(ids)))
    for size in (900, 1 << 25):  # many blocks, and one a task
        got = [(r.doc_id, bytes(r.ids), r.decoded) for r in pieces.encode_decode(df, MODEL, block_chars=size).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert pieces.encode_decode(df.limit(0), MODEL).collect() == []


def test_op13_as_its_contract_says(spark, library):
    def expected(doc, text):
        ids = library.encode(text or "", add_bos=True, add_eos=True)
        digest = lambda b: hashlib.sha256(b).hexdigest()
        return doc, len(ids), digest(struct.pack(f"<{len(ids)}I", *ids)), digest(library.decode(ids).encode())

    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    got = pieces.op13_sentencepiece(spark, SF)
    assert got.columns[:4] == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted(map(tuple, got.collect())) == sorted(expected(r.doc_id, r.text) for r in docs)


def test_chunks_need_a_model_without_pieces_across_markers(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    spec = sentencepiece_model_pb2.ModelProto()
    spec.ParseFromString(open(MODEL, "rb").read())
    spec.pieces[900].piece = "a▁b"
    (tmp_path / "odd.model").write_bytes(spec.SerializeToString())
    with pytest.raises(ValueError):
        pieces.Sides(str(tmp_path / "odd.model"))
    assert pieces.Sides(MODEL).is_other.match(".") and not pieces.Sides(MODEL).is_other.match("a")


# --- the prefix trie


def made_conversations(rng, ids, longest):
    """Few distinct turns, so that prefixes are shared; ties, nulls and repeated rows."""
    rows = []
    for c in ids:
        for t in range(rng.randint(1, longest)):
            turn = None if rng.random() < 0.02 else t // 2 if rng.random() < 0.1 else t
            rows.append((c, turn, rng.choice(["user", "user", "user", None]), rng.choice(["yes", "yes", "yes", "nö", "", None]), "x"))
    return rows


@pytest.mark.parametrize(("ids", "longest", "least"), [(range(40), 40, 100_000), ([*range(-30, 30), 10**12, 10**12 + 1], 20, 3), ([5], 300, 10)])
def test_trie_is_that_of_the_sql(spark, tmp_path, monkeypatch, ids, longest, least):
    rows = made_conversations(random.Random(longest), ids, longest)
    df = spark.createDataFrame([*rows, (None, 1, "user", "lost", "x")], "conv_id long, turn long, role string, text string, conv string")
    df.coalesce(1).write.parquet(f"{tmp_path}/conversations.parquet")
    con = duckdb.connect()
    con.execute(f"create view conversations as select * from '{tmp_path}/conversations.parquet/*.parquet'")
    found = con.execute(prefixes.OP12_SQL)
    names = [d[0] for d in found.description]
    want = sorted(tuple(norm(r[names.index(c)]) for c in sorted(names)) for r in found.fetchall())
    scan = prefixes.scan
    monkeypatch.setattr(prefixes, "scan", lambda *a: scan(*a, least=least))  # conversations are cut into pieces
    assert spark_rows(prefixes.op12_prefix_trie(spark, str(tmp_path)))[1] == want


def test_trie_of_conversations_as_they_are(spark):
    rows = [(1, 0, "u", "hé"), (1, 1, "a", "you"), (2, 0, "u", "hé"), (2, 1, "a", "you"), (3, 0, "u", "hé"), (3, 1, "a", "no"), (4, 0, "u", "bye")]
    df = spark.createDataFrame(rows, "c long, t long, r string, x string")
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    got = {tuple(r) for r in prefixes.prefix_trie(df, "c", "t", "r", "x").collect()}
    assert got == {
        (1, 0, None, 4, 2, 3, 9, digest("")), (1, 1, 1, 3, 2, 2, 9, digest("")), (1, 2, 1, 2, 0, 1, 3, digest("1,2")), (3, 2, 1, 1, 0, 1, 0, digest("3")), (4, 1, 1, 1, 0, 1, 0, digest("4")),
    }
    assert prefixes.prefix_trie(df.limit(0), "c", "t", "r", "x").collect() == []


# --- HTML: parts inside articles, and names that tell nothing

LONG = "Yesterday the council met in the old hall to talk about the bridge over the river. It was decided that work will begin in the spring of next year."
SHORT = "The bridge was closed. It will open in May."
LINKS = "<a href=#>Home</a> <a href=#>About us</a>"


@pytest.fixture(scope="module")
def model10():
    from quillspark.llm import html_extract

    return html_extract.default_model()


@pytest.mark.parametrize(
    ("html", "text"),
    [
        (f"<body><div id=wrapper><div class=qz><p>{LONG}</p></div><div class=qy>{LINKS}</div></div></body>", LONG),
        (f"<div id=wrapper><div class=x1><p>{SHORT}</p></div></div>", SHORT),
        (f"<body><article><h1>Title here</h1><p>{LONG}</p><aside>Related: <a href=#>one</a></aside><p>{SHORT}</p></article></body>", f"Title here\n{LONG}\n{SHORT}"),
        (f"<body><article><p>{LONG}</p><footer>Tags: x</footer></article></body>", LONG),
        (f"<body><article><p>{LONG}</p><form><p>Subscribe to our letter</p></form></article></body>", LONG),
        (f"<body><table><tr><td>{LINKS}</td><td><p>{LONG}</p></td></tr></table></body>", LONG),
    ],
)
def test_articles_keep_their_text_and_no_more(model10, html, text):
    assert model10.extract(html) == text


def test_characters_of_made_pages(model10):
    """Pages of every shape, made with a seed that training didn't see; by characters."""
    from quillspark.llm import html_extract, html_pages

    kept = right = held = 0
    for html in html_pages.labelled_pages(150, seed=4711):
        tree = html_extract.Tree(html)
        content, size = model10.marginals(tree), [0] * len(tree.tags)
        for _, node, text, _ in tree.pieces:
            size[node] += len(text.strip())
        for gold, p, n in zip(tree.gold, content, size, strict=True):
            kept, right, held = kept + n * (p >= 0.5), right + n * (p >= 0.5 and gold == "1"), held + n * (gold == "1")
    assert right / kept >= 0.95 and right / held >= 0.95
