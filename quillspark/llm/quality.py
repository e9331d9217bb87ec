"""Quality and toxicity from weak labels.

Heuristic labellers vote on every document: for, against or not at all. Those of quality look at its characters, words
and lines. Those of toxicity look words, five-letter and four-letter beginnings of words up in three dictionaries, each
mined from a third of its own of a bounded sample of labelled rows (`label_rows`), so that they err apart from one another;
documents whose crc32(id as text) mod 3 is 1 are never mined, which leaves labels to test on. How often each combination
of votes occurs is counted over all documents; there are at most 3 ** labellers of them, whatever the corpus.
Expectation-maximisation over these counts estimates each labeller's accuracies and the share of each class, without any
true label. The posteriors label a bounded sample of documents (`sample_docs`), on which a hashed linear scorer (logistic;
words, beginnings and binned statistics) is trained; it scores all rows where they lie. There is one such model for quality
and one for toxicity.

Texts are read once: a task numbers tokens as they first occur and looks at each distinct token once; a document is then a
row of its votes and 16-bit feature buckets (`numbers`), kept as a table from which votes are counted, the sample is drawn
and all rows are scored.

Edge cases: null and empty text have no words; the labellers call them poor and not toxic, and they get scores like any
other. Repeated rows get equal scores. Labels that are null, of unknown documents or repeated don't matter (a document is
toxic if one of its rows says so); without labels nothing is called toxic. An empty table gives no rows. Other columns are
not read.
"""

from __future__ import annotations

import math
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import drop_table, least_hashes, read, share, table
from .langid import held_out

BUCKETS = 1 << 16
EDGES = re.compile(r"^[\W\d_]+|[\W\d_]+$")
PROSE = re.compile(r"[(\"'“«¿¡]*+[^\W\d_]++(?:['’-][^\W\d_]++)*+[)\"'”»]*+[.,;:!?]?")

QUALITY = ("symbols", "capitals", "bars", "shouts", "variety", "stutter", "prose", "sentences", "plain")
MINED = ("word", "five", "four")  # kinds of terms: whole words and beginnings of five and of four letters
COUNTED = tuple(f"mined {k}" for k in MINED)


def hashed(name: str) -> int:
    return zlib.crc32(name.encode()) & (BUCKETS - 1)


NO_START = hashed("^")


def terms_of(core: str) -> tuple[str, str, str]:
    return core, core[:5] if len(core) > 4 else "", core[:4] if len(core) > 3 else ""


def read_token(token: str) -> tuple[str, bool]:
    """Its core, and whether it is spelt like prose; most tokens are a word with at most one mark behind it."""
    if token.isalpha():
        return token.lower(), True
    if token[-1] in ".,;:!?" and token[:-1].isalpha():
        return token[:-1].lower(), True
    return EDGES.sub("", token).lower(), bool(PROSE.fullmatch(token))


class Tokens:
    """Numbers white-space separated tokens as they first occur, and knows of each: its core (lower case, without what
    isn't a letter at its edges; core 0 is none) and whether it is spelt like prose; of each core: its bucket, that of its
    beginning, and in which dictionaries its terms are (`core_table`)."""

    PART = 1 << 21

    def __init__(self, mined: tuple[frozenset[str], ...] = (frozenset(),) * 3, most: int = 300_000) -> None:
        self.mined, self.most = mined, most
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = {}
        self.cores: dict[str, int] = {"": 0}
        self.table = np.zeros((0, 2), dtype=np.int64)
        self.core_table = np.zeros((1, 5), dtype=np.int64)

    def learn(self, tokens: set[str]) -> None:
        number, cores, rows, names = self.number, self.cores, [], []
        n, known = len(number), len(cores)
        for token in tokens:
            if token in number:
                continue
            core, prose = read_token(token)
            k = cores.get(core)
            if k is None:
                k = cores[core] = known + len(names)
                names.append(core)
            number[token] = n + len(rows)
            rows.append((k, prose))
        if rows:
            self.table = np.concatenate([self.table, np.array(rows, dtype=np.int64)])
        if names:
            words, fives, fours = self.mined
            terms = [(hashed(c), hashed("^" + c[:5]) if len(c) > 4 else NO_START, c in words, c[:5] in fives, c[:4] in fours) for c in names]
            self.core_table = np.concatenate([self.core_table, np.array(terms, dtype=np.int64)])

    def read(self, texts: list[str]) -> Iterator[tuple[dict[str, float], np.ndarray]]:
        """Statistics of each text, and its distinct cores as rows of core_table. Texts are split some MB at a time."""
        begin = held = 0
        for i, text in enumerate(texts):
            held += len(text)
            if held >= self.PART:
                yield from self._read(texts[begin : i + 1])
                begin, held = i + 1, 0
        yield from self._read(texts[begin:])

    def _read(self, texts: list[str]) -> Iterator[tuple[dict[str, float], np.ndarray]]:
        if len(self.number) > self.most:
            self.reset()
        split = [t.split() for t in texts]
        self.learn(set().union(*split))
        for text, tokens in zip(texts, split, strict=True):
            cores, prose = self.table[np.fromiter(map(self.number.__getitem__, tokens), np.int64, len(tokens))].T
            rows = self.core_table[np.unique(cores[cores > 0])]
            n, again = int(np.count_nonzero(cores)), int(np.count_nonzero((cores[1:] == cores[:-1]) & (cores[1:] > 0)))
            yield statistics(text, len(tokens), n, int(prose.sum()), again, rows), rows


def statistics(text: str, tokens: int, n: int, prose: int, again: int, cores: np.ndarray) -> dict[str, float]:
    data = np.frombuffer(text.encode(), np.uint8)
    c = np.bincount(data, minlength=256)
    size = max(len(data), 1)
    letters = int(c[65:91].sum() + c[97:123].sum() + c[128:].sum())
    lines = [x for x in text.split("\n") if x.strip()]
    return {
        "symbols": int(c[33:48].sum() + c[58:65].sum() + c[91:97].sum() + c[123:127].sum() - c[44] - c[46] - c[39] - c[45] - c[33] - c[124]) / size,
        "capitals": int(c[65:91].sum()) / max(letters, 1),
        "bars": int(c[124]) / max(n, 1),
        "shouts": int(c[33]) / max(n, 1),
        # the longer a text, the fewer of its words are new
        "variety": len(cores) / max(n, 1) ** 0.75,
        "stutter": again / max(n, 1),  # words that repeat the one before
        "prose": prose / max(tokens, 1),
        "sentences": sum(x.rstrip()[-1] in ".?!…\"'”" for x in lines) / max(len(lines), 1),
        "repeated lines": 1 - len(set(lines)) / max(len(lines), 1),
        "word length": letters / max(n, 1),
        "length": float(n),
        "digits": int(c[48:58].sum()) / size,
        **dict(zip(COUNTED, map(float, cores[:, 2:].sum(axis=0)), strict=True)),
    }


def votes(s: dict[str, float]) -> tuple[str, str]:
    """One character per labeller: 1 for the class, 0 against, - no vote."""
    n = s["length"]
    dull = n >= 30 and (s["variety"] < 0.9 or s["repeated lines"] > 0.4)
    good = "-" if dull else "1"  # what is said over and over isn't prose for its spelling
    quality = (
        ("0" if s["symbols"] >= 0.06 else "-") + ("0" if s["capitals"] >= 0.5 else "-") + ("0" if s["bars"] >= 0.1 else "-")
        + ("0" if s["shouts"] >= 0.15 else "-") + ("0" if dull else "-") + ("0" if s["stutter"] >= 0.1 else "-")
        + (good if s["prose"] >= 0.9 else "0" if s["prose"] <= 0.75 else "-") + (good if s["sentences"] >= 0.7 else "0" if s["sentences"] <= 0.3 else "-")
        + (good if n >= 3 and s["symbols"] < 0.03 and s["capitals"] < 0.3 and s["bars"] < 0.02 and s["digits"] < 0.1 else "0" if n < 3 else "-")
    )
    return quality, "".join("1" if s[k] >= 1 else "0" for k in COUNTED)


def _texts(batch: pa.RecordBatch) -> list[str]:
    return [t or "" for t in batch["text"].to_pylist()]


NUMBERS = "quality string, toxic string, n_words int, n_starts int, features binary"


def _numbers(mined: tuple[frozenset[str], ...]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = Tokens(mined)
        for batch in batches:
            made = [(*votes(s), *features(s, cores)) for s, cores in tokens.read(_texts(batch))]
            quality, toxic, words, starts, buckets = zip(*made, strict=True) if made else [()] * 5
            columns = [
                pa.array(quality, pa.string()), pa.array(toxic, pa.string()), pa.array(words, pa.int32()), pa.array(starts, pa.int32()), pa.array(buckets, pa.binary()),
            ]
            yield pa.RecordBatch.from_arrays([batch["id"], batch["order"], *columns], ["id", "order", "quality", "toxic", "n_words", "n_starts", "features"])

    return run


def numbers(docs: DataFrame, mined: tuple[frozenset[str], ...], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document as its votes and features (`features`), with order, a hash of id and text; texts are left behind."""
    text = F.col(text_col).cast("string")
    order = F.xxhash64(F.col(id_col).cast("string"), text, F.lit("sample"))
    rows = docs.select(F.col(id_col).alias("id"), text.alias("text"), order.alias("order"))
    return rows.mapInArrow(_numbers(mined), f"id {docs.schema[id_col].dataType.simpleString()}, order long, {NUMBERS}")


def _terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The distinct terms of each document, but for those of the kind that its part of the sample isn't for; and the least
    hash of its words, which copies and near copies share."""
    for batch in batches:
        found, bad, family = [], [], []
        for text, part, toxic in zip(_texts(batch), batch["part"].to_pylist(), batch["toxic"].to_pylist(), strict=True):
            cores = {read_token(t)[0] for t in set(text.split())} - {""}
            least = min((zlib.crc32(c.encode()) for c in cores), default=0)
            for kind, terms in enumerate(map(set, zip(*map(terms_of, cores), strict=True))):
                if kind != part:
                    terms.discard("")
                    found += [(kind, t) for t in terms]
                    bad += [toxic] * len(terms)
                    family += [least] * len(terms)
        yield pa.RecordBatch.from_arrays(
            [pa.array([k for k, _ in found], pa.int32()), pa.array([t for _, t in found], pa.string()), pa.array(family, pa.int64()), pa.array(bad, pa.int64())],
            ["kind", "term", "family", "toxic"],
        )


def mine_terms(
    docs: DataFrame, labels: DataFrame, text_col: str = "text", id_col: str = "doc_id", label_rows: int = 30_000, toxic_share: float = 0.6, most: int = 30_000,
) -> tuple[frozenset[str], ...]:
    """The dictionaries of the labellers of toxicity, from about label_rows labelled documents: terms of which `toxic_share` of the
    documents are toxic, and so many that chance would give fewer than one term like it (near copies count as one document);
    at most `most` terms in all."""
    labels = labels.where(F.col(id_col).isNotNull() & F.col("toxic").isNotNull() & ~held_out(id_col)).groupBy(id_col).agg(F.max("toxic").cast("long").alias("toxic"))
    size = labels.agg(F.count("*").alias("n"), F.coalesce(F.sum("toxic"), F.lit(0)).alias("bad")).first()
    rate = min(max(size["bad"] / max(size["n"], 1), 1e-3), 0.5)
    keep = min(1.0, label_rows / max(size["n"], 1))
    number = F.xxhash64(F.col(id_col).cast("string"), F.lit("mine"))
    labels = labels.where(share(number) < keep).withColumn("part", F.pmod(F.shiftright(number, 20), F.lit(len(MINED))).cast("int"))
    # label_rows of them by their hashes, give or take chance, so texts needn't be shuffled
    rows = docs.select(F.col(id_col), F.col(text_col).cast("string").alias("text")).join(F.broadcast(labels), id_col)
    terms = rows.select("text", "part", "toxic").mapInArrow(_terms, "kind int, term string, family long, toxic long")
    terms = terms.groupBy("kind", "term", "family").agg(F.max("toxic").alias("toxic"))
    terms = table(terms.groupBy("kind", "term").agg(F.sum("toxic").alias("bad"), F.count("*").alias("n")), "terms")
    alike = terms.groupBy("kind", "n").agg(F.count("*").alias("alike"))
    found = terms.where((F.col("bad") >= 3) & (F.col("bad") >= toxic_share * F.col("n"))).join(alike, ["kind", "n"])
    q = F.least(F.col("bad") / F.col("n"), F.lit(1 - 1e-9))
    chance = F.exp(-F.col("n") * (q * F.log(q / rate) + (1 - q) * F.log((1 - q) / (1 - rate))))  # Chernoff's bound
    found = found.where(F.col("alike") * chance < 1).orderBy(F.desc("bad"), "kind", "term").limit(most)
    mined: tuple[set[str], ...] = (set(), set(), set())
    for r in found.select("kind", "term").collect():
        mined[r["kind"]].add(r["term"])
    drop_table(terms)
    return tuple(map(frozenset, mined))


class LabelModel:
    """P(class) and P(vote | class) for each labeller, by expectation-maximisation over vote combinations."""

    def __init__(self, counts: dict[str, float], prior: float, rounds: int = 100) -> None:
        self.prior = prior
        patterns = sorted(counts)
        width = len(patterns[0]) if patterns else 0
        code = np.array([["01-".index(c) for c in p] for p in patterns], dtype=np.int64).reshape(len(patterns), width)  # - says nothing
        n = np.array([counts[p] for p in patterns], dtype=float)
        # at first every labeller is right four times in five
        first = np.array([[0.8, 0.2], [0.2, 0.8]])
        self.table = np.zeros((width, 2, 3))
        self.table[:, :, :2] = np.log(first)
        for _ in range(rounds if len(n) else 0):
            p = self._posterior(code)
            self.prior = float(np.clip((n * p).sum() / n.sum(), 0.01, 0.99))
            for k in range(width):
                for y, w in enumerate((n * (1 - p), n * p)):
                    # a little of the rows' worth of the first belief keeps a class from turning into its opposite
                    c = np.bincount(code[:, k], w, minlength=3)[:2] + first[y] * 0.003 * n.sum()
                    self.table[k, y, :2] = np.log(c / c.sum())

    def _posterior(self, code: np.ndarray) -> np.ndarray:
        score = np.array([np.log(1 - self.prior), np.log(self.prior)]) + sum(self.table[k][:, code[:, k]].T for k in range(code.shape[1]))
        return 1 / (1 + np.exp(np.clip(score[:, 0] - score[:, 1], -500, 500)))

    def __call__(self, pattern: str) -> float:
        return float(self._posterior(np.array([["01-".index(c) for c in pattern]]))[0])


def features(s: dict[str, float], cores: np.ndarray) -> tuple[int, int, bytes]:
    """How many distinct words and beginnings a document has, and their buckets, then those of the binned statistics."""
    bins = [hashed(f"#{k} {min(int(v), 3) if k in COUNTED else int(math.log2(v * 64 + 1) * 2)}") for k, v in s.items()]
    words, starts = np.sort(cores[:, 0]), np.unique(cores[:, 1])
    return len(words), len(starts), np.concatenate([words, starts, np.array(bins, dtype=np.int64)]).astype("<u2").tobytes()


def unpacked(words: list[int], starts: list[int], buckets: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, bucket and value of every feature: 1 for each binned statistic; the distinct words share a length of 1,
    and so do beginnings."""
    sizes = np.stack([np.array(words, np.int64), np.array(starts, np.int64), np.array([len(b) // 2 for b in buckets], np.int64)], axis=1)
    sizes[:, 2] -= sizes[:, 0] + sizes[:, 1]
    values = np.concatenate([np.maximum(sizes[:, :2], 1) ** -0.5, np.ones((len(sizes), 1))], axis=1)
    owner = np.repeat(np.arange(len(sizes)), sizes.sum(axis=1))
    return owner, np.frombuffer(b"".join(buckets), "<u2").astype(np.int64), np.repeat(values.ravel(), sizes.ravel())


def train_scorer(rows: tuple[np.ndarray, np.ndarray, np.ndarray], y: np.ndarray, least_docs: int = 4, steps: int = 300, rate: float = 0.5, decay: float = 1e-4) -> tuple[np.ndarray, float]:
    """Logistic weights per bucket; buckets of fewer than least_docs sample documents keep weight 0."""
    w, bias = np.zeros(BUCKETS), 0.0
    if not len(y):
        return w, bias
    owner, flat, x = rows
    some = np.bincount(flat, minlength=BUCKETS)[flat] >= least_docs
    flat, owner, x = flat[some], owner[some], x[some]
    size, size_b = np.full(BUCKETS, 1e-8), 1e-8
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(owner, w[flat] * x, minlength=len(y)) + bias, -30, 30)))
        gap = (y - p) / len(y)
        g = np.bincount(flat, gap[owner] * x, minlength=BUCKETS) - decay * w
        size, size_b = size + g**2, size_b + gap.sum() ** 2
        w = w + rate * 0.2 * g / np.sqrt(size)
        bias += rate * gap.sum() / np.sqrt(size_b)
    return w, float(bias)


class Scorer:
    def __init__(self, quality: tuple, toxic: tuple, labels: tuple[LabelModel, LabelModel], mined: tuple[frozenset[str], ...]) -> None:
        self.quality, self.toxic, self.labels, self.mined = quality, toxic, labels, mined


def fit(
    docs: DataFrame, text_col: str = "text", id_col: str = "doc_id", sample_docs: int = 4000, mined: tuple[frozenset[str], ...] = (frozenset(),) * 3,
) -> Scorer:
    """Votes of all documents fit the label models; the sample_docs documents of the smallest hashes train the scorers."""
    rows = table(numbers(docs, mined, id_col, text_col), "quality-numbers")
    scorer = fit_numbers(rows, mined, sample_docs)
    drop_table(rows)
    return scorer


def fit_numbers(docs: DataFrame, mined: tuple[frozenset[str], ...], sample_docs: int = 4000) -> Scorer:
    """fit() for documents that are numbers already."""
    counts: tuple[dict, dict] = ({}, {})
    total = 0
    for r in docs.groupBy("quality", "toxic").count().collect():  # at most a row per combination of votes
        total += r["count"]
        for c, k in zip(counts, ("quality", "toxic"), strict=True):
            c[r[k]] = c.get(r[k], 0) + r["count"]
    labels = LabelModel(counts[0], 0.8), LabelModel(counts[1], 0.1)
    rows: list = []
    for sample in least_hashes(docs.drop("id"), "order", sample_docs, total):
        rows = list(sample.orderBy(share(F.col("order")), "order", "features").limit(sample_docs).toLocalIterator())
        if len(rows) >= min(sample_docs, total):
            break
    made = unpacked(*([r[k] for r in rows] for k in ("n_words", "n_starts", "features")))
    wanted = [np.array([model(r[k]) for r in rows]) for model, k in zip(labels, ("quality", "toxic"), strict=True)]
    return Scorer(train_scorer(made, wanted[0]), train_scorer(made, wanted[1]), labels, mined)


def _score(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, bias = model.value
        for batch in batches:
            owner, at, x = unpacked(*(batch[k].to_pylist() for k in ("n_words", "n_starts", "features")))
            total = np.stack([np.bincount(owner, weights[at, k] * x, minlength=batch.num_rows) + bias[k] for k in range(2)], axis=1)
            p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
            yield pa.RecordBatch.from_arrays([batch["id"], pa.array(p[:, 0]), pa.array(p[:, 1])], ["id", "quality", "toxic"])

    return run


def score(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, quality and toxic (0 to 1), and keep: quality of at least and toxicity below one half, for every row."""
    return score_numbers(numbers(docs, scorer.mined, id_col, text_col), scorer, id_col)


def score_numbers(docs: DataFrame, scorer: Scorer, id_col: str = "doc_id") -> DataFrame:
    """score() for documents that are numbers already."""
    weights = np.stack([scorer.quality[0], scorer.toxic[0]], axis=1), np.array([scorer.quality[1], scorer.toxic[1]])
    model = docs.sparkSession.sparkContext.broadcast(weights)  # two numbers per bucket
    kind = docs.schema["id"].dataType.simpleString()
    rows = docs.select("id", "n_words", "n_starts", "features")
    out = rows.mapInArrow(_score(model), f"id {kind}, quality double, toxic double").withColumnRenamed("id", id_col)
    return out.withColumn("keep", (F.col("quality") >= 0.5) & (F.col("toxic") < 0.5))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    mined = mine_terms(docs, read(spark, sf_dir, "labels"))
    rows = table(numbers(docs, mined), "quality-numbers")
    return score_numbers(rows, fit_numbers(rows, mined)).withColumn("held_out", held_out())
