"""Personal data by fixed patterns and a skip-chain conditional random field.

Base spans are what the patterns find: email, ip, card, phone. The field's nodes are the tokens of a document that hold a
digit, a plus sign, an @ or an (at), and runs of seven or more English digit words; its labels are those four kinds and
none. Neighbouring tokens share a chain potential. Each token shares skip potentials with the first and the latest one
before it, however far away, that has the same letters and digits, the same shape, the same last four digits, the same last
seven digits counting those of the tokens that it continues, or the same name before its @; so the skip edges grow with
the document and not with the square of a repeated token's count. Loopy sum-product message passing runs over all documents
of an Arrow batch at once. Tokens of base spans are observed, the rest are inferred: evidence for one spelling of a
number reaches its other spellings in the document. Runs of tokens inferred to be of a kind, clear of all base spans,
are added.

The field learns from a bounded sample (`sample_docs` and `sample_nodes`, by a hash of id and text). The labels are the
base spans. As documents seldom spell a thing twice, documents with base spans are used again with one of these spelt
otherwise at another place (labelled with its kind) and with an unrelated number, date or amount (labelled none), and often
with a telephone number of another length and grouping in place of theirs: that teaches the skip potentials what to carry,
and the features not to learn the lengths and groups of the numbers in the sample by heart. Weights climb the pseudo-likelihood. All rows are searched where they lie,
nothing is shuffled.

All patterns run in time linear in the text, whatever it holds. Edge cases: null counts as empty and has no spans.
Repeated rows give equal rows. With nothing to learn from, no spans are added. Other columns are not read.
"""

from __future__ import annotations

import random
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import least_hashes, read, share

KINDS = ("email", "ip", "card", "phone")
K = len(KINDS) + 1  # label 0: none
BITS = 16
HASHES = 1 << BITS
EDGES = 6  # chain; equal letters and digits; equal shape; equal last four digits; equal name before the @; equal last seven digits of the run
DIGITS = {"zero": "0", "oh": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9"}

LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
DOMAIN = re.compile(r"@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]+)+")
# a run of digits is passed over whole, so that a long one isn't tried from each of its digits
IP = re.compile(r"[0-9]++(?:(\.[0-9]++)(\.[0-9]++)(\.[0-9]++))?+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
AT = re.compile(r"@|[(\[]at[)\]]", re.I)
MARK = re.compile(r"[0-9@+]|[(\[][Aa][Tt][)\]]")
SPELT = [w for w in DIGITS if w != "oh"]
_WORD = f"(?:{'|'.join(DIGITS)})"
TOKEN = re.compile(rf"(?P<spelt>{_WORD}(?:[ -]{_WORD}){{6,}}(?!\w))|\S+", re.I)
SHAPES = ((re.compile(r"[A-Z]+"), "A"), (re.compile(r"[^\W\dA-Z_]+"), "a"))


def _luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 * (n > 9)
    return total % 10 == 0


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) in code points, by kind and start; leftmost and non-overlapping within a kind."""
    out, done, last = [], 0, -1
    for m in DOMAIN.finditer(text):
        head = text[max(done, last + 1) : m.start()]
        size = len(head) - len(head.rstrip(LOCAL))
        last = m.start()
        if size:
            out.append((0, m.start() - size, m.end()))
            done = m.end()
    if not re.search("[0-9]", text):
        return out
    for m in IP.finditer(text):
        if m[1]:
            parts = (p.lstrip("0") for p in m[0].split("."))
            if all(len(p) < 3 or (len(p) == 3 and p <= "255") for p in parts):
                out.append((1, *m.span()))
    for m in CARD.finditer(text):
        digits = m[0].replace(" ", "").replace("-", "")
        if 13 <= len(digits) <= 19 and _luhn(digits):
            out.append((2, *m.span()))
    for m in PHONE.finditer(text):
        if 9 <= sum(c in "0123456789" for c in m[0]) <= 15:
            out.append((3, *m.span()))
    return out


class Graph:
    """Nodes and edges of the documents of a batch."""

    def __init__(self) -> None:
        self.where: list[tuple[int, int, int]] = []  # document, start, end of each node
        self.labels: list[int] = []  # that of the base span the token is in, else 0
        self.features: list[list[int]] = []
        self.edges: tuple[list, ...] = ([], [], [])  # from, to, kind

    def add(self, doc: int, text: str, spans: list[tuple[int, int, int]]) -> None:
        if not MARK.search(text):
            return
        spans = sorted((a, b, k) for k, a, b in spans)
        at, before, previous_end, word, run = 0, None, -9, "", ""
        known: dict[tuple[int, str], tuple[int, int]] = {}  # the first and the latest node of each key
        for m in TOKEN.finditer(text):
            token, (start, end) = m[0], m.span()
            spelt = m["spelt"] is not None
            if not spelt and not MARK.search(token):
                word = token
                continue
            core = "".join(DIGITS[w] for w in re.split("[ -]", token.lower())) if spelt else token.strip("\"'.,;:!?#$%&*()[]<>|=")
            at_sign = AT.search(core)
            if not core:
                continue
            node = len(self.where)
            while at < len(spans) and spans[at][1] <= start:
                at += 1
            label = spans[at][2] + 1 if at < len(spans) and spans[at][0] < end else 0
            shape = re.sub(r"[0-9]", "9", core)
            for pattern, letter in SHAPES:
                shape = pattern.sub(letter, shape)
            joined = start - previous_end == 1 and before is not None
            digits = sum(c.isdigit() for c in core)
            many = sum(digits >= n for n in (1, 4, 7, 10, 13, 20))
            valid = 13 <= digits <= 19 and _luhn("".join(c for c in core if c in "0123456789"))
            marks = [
                "all", f"shape {shape}", f"form {re.sub('9+', '9', shape)}", f"digits {many}", f"number {len(core) == digits} {many} {valid}", f"at {at_sign[0].lower() if at_sign else ''}", f"dots {min(core.count('.'), 4)}",
                f"first {token[0] if not token[0].isalnum() else ''}", f"before {word.lower()}", f"joined {joined}", f"spelt {spelt}",
            ]
            self.features.append([zlib.crc32(f.encode()) & (HASHES - 1) for f in marks])
            self.where.append((doc, start, end))
            self.labels.append(label)
            keys = [(1, re.sub(r"[\W_]", "", AT.sub("", core)).lower())]
            if digits > 2 or at_sign:
                keys.append((2, shape))
            figures = re.sub(r"[^0-9]", "", core)
            run = (run + figures if joined else figures)[-7:]
            if digits > 3:
                keys.append((3, figures[-4:]))
            if figures and len(run) == 7:
                keys.append((5, run))
            if at_sign and at_sign.start():
                keys.append((4, re.sub(r"[\W_]", "", core[: at_sign.start()]).lower()))
            for kind, key in ([(0, "")] if joined else []) + keys:
                others = (before,) if kind == 0 else known.get((kind, key), ())
                for other in dict.fromkeys(others):
                    for column, value in zip(self.edges, (other, node, kind), strict=True):
                        column.append(value)
                if kind:
                    known[kind, key] = others[0] if others else node, node
            before, previous_end, word = node, end, ""

    def arrays(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        a, b, kind = (np.array(x, dtype=np.int64) for x in self.edges)
        return np.array(self.features, dtype=np.int64).reshape(len(self.where), len(self.features[0]) if self.features else 0), a, b, kind


class Field:
    """Weights: feature and label; per kind of edge, label and label."""

    def __init__(self, unary: np.ndarray, pair: np.ndarray) -> None:
        self.unary, self.pair = unary, pair

    def marginals(self, graph: Graph, rounds: int = 12, damping: float = 0.3) -> np.ndarray:
        """Loopy sum-product over all documents of the graph; nodes with a base label are observed."""
        features, a, b, kind = graph.arrays()
        local = self.unary[features].sum(axis=1)
        seen = np.flatnonzero(graph.labels)
        local[seen] = -50.0
        local[seen, np.array(graph.labels)[seen]] = 0.0
        table = np.exp(self.pair)[kind]
        to_b, to_a = np.zeros((len(a), K)), np.zeros((len(a), K))  # log messages

        def send(belief: np.ndarray, back: np.ndarray, pair: np.ndarray, old: np.ndarray) -> np.ndarray:
            x = belief - back
            x -= x.max(axis=1, keepdims=True)
            y = np.log(np.einsum("ek,ekl->el", np.exp(x), pair) + 1e-300)
            y -= y.max(axis=1, keepdims=True)
            return damping * old + (1 - damping) * y

        for _ in range(rounds if len(a) else 0):
            belief = local.copy()
            np.add.at(belief, b, to_b)
            np.add.at(belief, a, to_a)
            to_b, to_a = send(belief[a], to_a, table, to_b), send(belief[b], to_b, table.transpose(0, 2, 1), to_a)
        belief = local.copy()
        np.add.at(belief, b, to_b)
        np.add.at(belief, a, to_a)
        belief = np.exp(belief - belief.max(axis=1, keepdims=True))
        return belief / belief.sum(axis=1, keepdims=True)


def train(graph: Graph, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> Field:
    """Climb the pseudo-likelihood: each label given its token and the labels of its neighbours."""
    unary, pair = np.zeros((HASHES, K)), np.zeros((EDGES, K, K))
    features, a, b, kind = graph.arrays()
    y = np.array(graph.labels, dtype=np.int64)
    n = len(y)
    if not n:
        unary[:, 0] = 1.0
        return Field(unary, pair)
    gold = np.eye(K)[y]
    size_u, size_p = np.full_like(unary, 1e-8), np.full_like(pair, 1e-8)
    for _ in range(steps):
        score = unary[features].sum(axis=1)
        np.add.at(score, b, pair[kind, y[a]])
        np.add.at(score, a, pair[kind, :, y[b]])
        p = np.exp(score - score.max(axis=1, keepdims=True))
        p /= p.sum(axis=1, keepdims=True)
        gap = (gold - p) / n
        g_u, g_p = -decay / n * unary, -decay / n * pair
        for column in features.T:
            np.add.at(g_u, column, gap)
        np.add.at(g_p, (kind, y[a]), gap[b])
        np.add.at(g_p.transpose(0, 2, 1), (kind, y[b]), gap[a])
        size_u += g_u**2
        size_p += g_p**2
        unary += rate * g_u / np.sqrt(size_u)
        pair += rate * g_p / np.sqrt(size_p)
    return Field(unary, pair)


def added_spans(graph: Graph, marginals: np.ndarray, texts: list[str], base: list[list[tuple[int, int, int]]], least: float = 0.5) -> list[list[tuple[int, int, int]]]:
    """Runs of neighbouring tokens of one inferred kind, clear of base spans, per document."""
    out: list[list[tuple[int, int, int]]] = [[] for _ in texts]
    best = marginals.argmax(axis=1)
    joins = {(i, j) for i, j, k in zip(*graph.edges, strict=True) if k == 0}
    kept = [bool(not y and k and p[k] >= least) for y, k, p in zip(graph.labels, best, marginals, strict=True)]

    def whole(node: int) -> bool:
        """Of a kind that is one token, or a card number by itself."""
        doc, start, end = graph.where[node]
        return best[node] < 3 or (best[node] == 3 and sum(c.isdigit() for c in texts[doc][start:end]) >= 13) or texts[doc][start:end].replace(" ", "").isalpha()

    i, n = 0, len(kept)
    while i < n:
        j = i + 1
        if kept[i]:
            while j < n and kept[j] and best[j] == best[i] and (j - 1, j) in joins and not (whole(i) or whole(j)):
                j += 1
            doc, start, end = *graph.where[i][:2], graph.where[j - 1][2]
            text = texts[doc]
            while start < end and not (text[start].isalnum() or text[start] in "+("):
                start += 1
            while end > start and not text[end - 1].isalnum():
                end -= 1
            if start < end and not any(a < end and start < b for _, a, b in base[doc]):
                out[doc].append((int(best[i]) - 1, start, end))
        i = j
    return out


def _spell(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for k, a, b in sorted(spans))


def _find(model, docs_at_once: int = 500):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        field = Field(*model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, docs_at_once):
                batch = whole.slice(at, docs_at_once)
                texts = [t or "" for t in batch["text"].to_pylist()]
                base = [base_spans(t) for t in texts]
                graph = Graph()
                for i, (text, spans) in enumerate(zip(texts, base, strict=True)):
                    graph.add(i, text, spans)
                more = added_spans(graph, field.marginals(graph), texts, base) if graph.where else [[]] * len(texts)
                counts = [[sum(s[0] == k for s in spans) for spans in base] for k in range(len(KINDS))]
                yield pa.RecordBatch.from_arrays(
                    [
                        batch["id"], *(pa.array(c, pa.int64()) for c in counts), pa.array([len(b) + len(m) for b, m in zip(base, more, strict=True)], pa.int64()),
                        pa.array(map(_spell, base), pa.string()), pa.array([_spell(b + m) for b, m in zip(base, more, strict=True)], pa.string()),
                    ],
                    ["id", *(f"n_{k}" for k in KINDS), "n_spans", "base", "spans"],
                )

    return run


def respell(kind: int, text: str, r: random.Random) -> str:
    """Another way to write the same address or number, which the patterns don't match."""
    if kind == 0:
        name, _, domain = text.partition("@")
        return r.choice([f"{name}(at){domain}", f"{name}[at]{domain}", f"{name.upper()}@{domain.split('.')[0]}", f"{name}@{domain.split('.')[0]}"])
    digits = re.sub("[^0-9]", "", text)
    if kind == 1:
        return r.choice("-:_/").join(text.split("."))
    if kind == 2:
        return r.choice(["./_:"[r.randrange(4)].join(digits[i : i + 4] for i in range(0, len(digits), 4)), f"{digits[:8]}{r.choice('_/.')}{digits[8:]}"])
    parts = re.findall("[0-9]+", text)
    if len(parts) < 3:
        parts = [digits[:2], digits[2:5], digits[5:]]
    head, area, rest = parts[0], parts[1], parts[2:]
    words = r.choice(" -").join(SPELT[int(d)] for d in digits)
    return r.choice([f"00{digits}", words, f"0{area}{''.join(rest)}", f"00{head} {area} {' '.join(rest)}", f"0{area}/{''.join(rest)}", f"({area}) {'-'.join(rest)}", f"({head}) {area}-{''.join(rest)}", digits, f"{area}.{'.'.join(rest)}"])


def unrelated(r: random.Random) -> str:
    """A number that is nobody's."""
    n = lambda k: "".join(r.choices("0123456789", k=k))
    return r.choice([
        f"20{n(2)}-0{r.randint(1, 9)}-{r.randint(10, 28)}", f"{r.randint(0, 23)}:{n(2)}", f"{r.randint(1, 9)}.{n(1)}.{n(1)}", f"${r.randint(1, 9)},{n(3)}.{n(2)}", n(r.randint(1, 6)),
        n(8), n(11), n(r.randint(9, 15)), f"00{n(r.randint(8, 12))}", " ".join(r.choices(SPELT, k=r.randint(7, 14))), f"#{n(5)}", f"{n(4)}/{n(7)}", f"{n(3)}-{n(7)}", f"({n(3)}) {n(3)}-{n(4)}", f"{n(4)}.{n(4)}", f"{n(2)}%", f"+{n(1)}", f"@{''.join(r.choices('abcdefgh', k=6))}",
    ])


def telephone(r: random.Random) -> str:
    n = lambda k: "".join(r.choices("0123456789", k=k))
    head, area, rest = str(r.randint(1, 999)), n(r.randint(2, 4)), [n(r.randint(3, 4)) for _ in range(2)]
    return r.choice([f"+{head} {area} {''.join(rest)}", f"+{head} ({area}) {'-'.join(rest)}", f"+{head}-{area}-{'-'.join(rest)}", f"+{head}{area}{''.join(rest)}", f"+{head} {area} {' '.join(rest)}"])


def varied(text: str, spans: list[tuple[int, int, int]], r: random.Random) -> tuple[str, list[tuple[int, int, int]]]:
    """text with one of its spans written once more in another spelling, and with an unrelated number; and its spans."""
    kind, start, end = r.choice(spans)
    if kind == 3 and r.random() < 0.7:  # telephone numbers of other lengths and groups than the sample's
        new = telephone(r)
        other_text = text[:start] + new + text[end:]
        other_spans = base_spans(other_text)
        if (3, start, start + len(new)) in other_spans:
            text, spans, end = other_text, other_spans, start + len(new)
    again, other = respell(kind, text[start:end], r), unrelated(r)
    breaks = [m.start() for m in re.finditer(r"(?<=\S) (?=\S)", text)]
    breaks = [i for i in breaks if not any(a < i < b for _, a, b in spans)] or [len(text)]
    first, second = sorted((r.choice(breaks), r.choice(breaks)))
    words = [again, other] if r.random() < 0.5 else [other, again]
    out = f"{text[:first]} {words[0]}{text[first:second]} {words[1]}{text[second:]}"
    at = first + 1 if words[0] is again else second + len(words[0]) + 2
    base = base_spans(out)
    return out, base + [(kind, at, at + len(again))] * (not any(a < at + len(again) and at < b for _, a, b in base))


def _sampled(variants: int):
    schema = pa.schema([("order", pa.int64()), ("labels", pa.list_(pa.int64())), ("features", pa.list_(pa.list_(pa.int64()))), ("edges", pa.list_(pa.list_(pa.int64())))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Features, labels and edges of each document and of its varied copies, as one row."""
        for batch in batches:
            rows = []
            for order, text in zip(batch["order"].to_pylist(), batch["text"].to_pylist(), strict=True):
                graph, spans, r = Graph(), base_spans(text or ""), random.Random(order)
                for k, (t, s) in enumerate([(text or "", spans), *(varied(text, spans, r) for _ in range(variants if spans else 0))]):
                    graph.add(k, t, s)
                rows.append({"order": order, "labels": graph.labels, "features": graph.features, "edges": [list(map(int, e)) for e in graph.edges]})
            yield pa.RecordBatch.from_pylist(rows, schema=schema)

    return run


def fit(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = 3000, sample_nodes: int = 60_000, variants: int = 16) -> Field:
    """Learn from the sample_docs documents of the smallest hashes, as far as they have nodes, whatever the table's size. The
    driver takes them in the order of the hash until sample_nodes nodes are full."""
    total = docs.count()
    order = F.xxhash64(F.col(id_col).cast("string"), F.col(text_col).cast("string"), F.lit("sample")).alias("order")
    texts = docs.select(order, F.col(text_col).cast("string").alias("text"))
    for sample in least_hashes(texts, "order", sample_docs, total):
        rows = sample.mapInArrow(_sampled(variants), "order long, labels array<long>, features array<array<long>>, edges array<array<long>>")
        graph, seen, full = Graph(), 0, False
        for r in rows.orderBy(share(F.col("order")), "order", F.size("labels")).limit(sample_docs).toLocalIterator():
            first, seen = len(graph.where), seen + 1
            if first + len(r["labels"]) > sample_nodes:
                if full := bool(first):
                    break
                continue
            graph.where += [(0, 0, 0)] * len(r["labels"])
            graph.labels += r["labels"]
            graph.features += r["features"]
            for column, values, shift in zip(graph.edges, r["edges"], (first, first, 0), strict=True):
                column.extend(v + shift for v in values)
        if full or seen >= min(sample_docs, total):
            break
    return train(graph)


def find_pii(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, n_email, n_ip, n_card, n_phone (base spans), n_spans (all), base and spans (kind:start:end, comma-joined) of every row."""
    model = docs.sparkSession.sparkContext.broadcast((field.unary, field.pair))  # of fixed size
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = docs.schema[id_col].dataType.simpleString()
    out = rows.mapInArrow(_find(model), f"id {kind}, {', '.join(f'n_{k} long' for k in KINDS)}, n_spans long, base string, spans string")
    return out.withColumnRenamed("id", id_col)


def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    found = find_pii(docs, fit(docs))
    return found.select("doc_id", *(f"n_{k}" for k in KINDS), F.sha2("base", 256).alias("base_sha256"), "spans", "n_spans")
