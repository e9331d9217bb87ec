"""Text features and model metrics: n-gram TF-IDF, word counts, byte-pair counts, vocabularies, classification metrics."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillspark.functions import text as T
from quillspark.operators import bayes, bpe
from quillspark.plans.shared import drop_table, table


def ngrams(words: Column, n: int) -> Column:
    """Runs of n words, space-joined."""
    def cut(w: Column) -> Column:
        return F.slice(F.transform(w, lambda _, i: F.array_join(F.slice(w, i + 1, n), " ")), 1, F.greatest(F.size(w) - (n - 1), F.lit(0)))

    return T.let(words, cut)


#: Terms are hashed some words at a time; candidates for the most frequent terms are broadcast up to so many.
WORDS_AT_ONCE, MOST_CANDIDATES = 1 << 19, 2_000_000


def _hashed(lists: pa.Array) -> Iterator[tuple[slice, pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
    """Slices of rows of words: their words, and for each uni- and bigram its 64-bit hash, its row in the slice, and its first
    word's place (bigrams' come after the unigrams')."""
    size = pc.fill_null(pc.list_value_length(lists), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    part = np.cumsum(size) // WORDS_AT_ONCE
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1), len(size)]
    for i, j in zip(cuts, cuts[1:], strict=False):
        words = lists.slice(i, j - i).flatten()
        if not len(words):
            continue
        coded = words.dictionary_encode()
        one = pd.util.hash_array(coded.dictionary.to_numpy(zero_copy_only=False).astype(object), categorize=False)[coded.indices.to_numpy()]
        row = np.repeat(np.arange(j - i), size[i:j])
        pair = np.flatnonzero(row[1:] == row[:-1])
        two = one[pair] * np.uint64(0x9E3779B97F4A7C15) + (one[pair + 1] ^ (one[pair + 1] >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        two = (two ^ (two >> np.uint64(32))) * np.uint64(0x94D049BB133111EB)
        yield slice(i, j), words, np.concatenate([one, two]), np.concatenate([row, row[pair]]), np.concatenate([np.arange(len(one)), pair])


def _hash_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """By hash, the rows with it and how often it occurs."""
    for batch in batches:
        for _, _, hashes, row, _ in _hashed(batch["words"]):
            order = np.argsort(hashes, kind="stable")  # rows of one hash stay in order
            h, r = hashes[order], row[order]
            first = np.flatnonzero(np.concatenate([[True], h[1:] != h[:-1]]))
            fresh = np.concatenate([[True], (h[1:] != h[:-1]) | (r[1:] != r[:-1])]).astype(np.int64)
            counts = np.add.reduceat(fresh, first), np.diff(np.append(first, len(h)))
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (h[first].view(np.int64), *counts)], ["hash", "df", "total"])


def _row_terms(batch: pa.RecordBatch, hashes: np.ndarray) -> Iterator[tuple[slice, np.ndarray, pa.Array, np.ndarray, np.ndarray]]:
    """Of terms with one of the sorted hashes: rows of the batch looked at; then (row in them, number of term, count), once for
    each term of a row, and the terms by number. Strings are compared, so hashes that collide do no harm."""
    for rows, words, found, row, at in _hashed(batch["words"]):
        place = np.minimum(np.searchsorted(hashes, found), len(hashes) - 1)
        hit = np.flatnonzero(hashes[place] == found)
        n = int(np.searchsorted(hit, len(words)))
        first = at[hit]
        pairs = pc.binary_join_element_wise(words.take(pa.array(first[n:])), words.take(pa.array(first[n:] + 1)), " ")
        coded = pa.concat_arrays([words.take(pa.array(first[:n])), pairs]).dictionary_encode()
        kinds = max(len(coded.dictionary), 1)
        both, tf = np.unique(row[hit] * kinds + coded.indices.to_numpy(), return_counts=True)
        yield rows, both // kinds, coded.dictionary, both % kinds, tf


def _term_counts(hashes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, terms, code, tf in _row_terms(batch, hashes.value):
                df, total = np.bincount(code, minlength=len(terms)), np.bincount(code, tf, len(terms)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([terms, pa.array(df.astype(np.int64)), pa.array(total)], ["term", "_df", "_total"])

    return run


def _weights(kept):
    """Weights of the kept terms, of rows that don't share their id."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms, idf = kept.value
        terms = pa.array(terms, pa.string())
        hashes = np.sort(np.concatenate([_whole_terms(h, row) for _, _, h, row, _ in _hashed(pc.split_pattern(terms, " "))]))
        for batch in batches:
            for rows, row, found, code, tf in _row_terms(batch, hashes):
                number = pc.fill_null(pc.index_in(found, value_set=terms), -1).to_numpy(zero_copy_only=False)[code]
                row, number, tf = (x[number >= 0] for x in (row, number, tf))
                w = tf * idf[number]
                norm = np.sqrt(np.bincount(row, w * w))
                yield pa.RecordBatch.from_arrays([batch["id"].slice(rows.start, rows.stop - rows.start).take(pa.array(row)), terms.take(pa.array(number)), pa.array(w / norm[row])], ["id", "term", "weight"])

    return run


def _whole_terms(hashes: np.ndarray, row: np.ndarray) -> np.ndarray:
    """Of rows of one or two words, the hash of all of a row: its last one."""
    last = np.zeros(int(row.max()) + 1, np.uint64)
    last[row] = hashes  # bigrams come after unigrams
    return last


def _frequent(once: DataFrame, many: DataFrame | None, n: int, most_df: float, most_features: int) -> DataFrame | None:
    """(term, _df, _total) of the kept terms, or None where hashes can't tell them.

    First hashes of terms are counted, in place of the terms, and those of more than one occurrence written. A total is then
    chosen that somewhat more than most_features of them reach; the terms whose hashes reach it are counted as they are. A
    term's hash counts at least what the term does, so if enough terms reach that total, no other one is kept."""
    rows = once if many is None else once.union(many)
    counts = rows.mapInArrow(_hash_counts, "hash long, df long, total long").groupBy("hash").agg(F.sum("df").alias("df"), F.sum("total").alias("total"))
    counts = table(counts.where("total > 1"), "hashes")
    try:
        totals = counts.groupBy("total").agg(F.count("*").alias("n"), F.count_if(F.col("df") <= most_df * n).alias("kept")).collect()  # fewer than the root of twice all terms
        least = enough = every = 0
        for r in sorted(totals, reverse=True):
            enough, every, least = enough + r["kept"], every + r["n"], r["total"]
            if enough >= most_features + most_features // 100 + 10:
                break
        else:
            return None
        if every > MOST_CANDIDATES:
            return None
        hashes = np.sort(counts.where(F.col("total") >= least).select("hash").toArrow()["hash"].to_numpy().view(np.uint64))
    finally:
        drop_table(counts)
    stats = once.mapInArrow(_term_counts(once.sparkSession.sparkContext.broadcast(hashes)), "term string, _df long, _total long")
    if many is not None:
        terms = many.repartition("id").select("id", F.explode(F.concat("words", ngrams(F.col("words"), 2))).alias("term")).groupBy("id", "term").agg(F.count("*").alias("_tf"))
        stats = stats.union(terms.groupBy("term").agg(F.count("*"), F.sum("_tf")))
    stats = stats.groupBy("term").agg(F.sum("_df").alias("_df"), F.sum("_total").alias("_total"))
    kept = stats.where((F.col("_df") <= most_df * n) & (F.col("_total") >= least)).orderBy(F.desc("_total"), "term").limit(most_features).toArrow()
    return once.sparkSession.createDataFrame(kept) if kept.num_rows == most_features else None


def tf_idf(df: DataFrame, id_col: str, words: Column, most_df: float = 0.01, most_features: int = 100_000) -> DataFrame:
    """(id, term, weight) of uni- and bigrams: tf * (ln((1 + n) / (1 + df)) + 1), rows scaled to unit length.

    Terms in more than most_df of the rows are dropped; of the rest the most_features most frequent are kept, by total
    count and then by term. Words hold no space. Rows are weighed where they lie, and only those that share an id are shuffled.
    Which terms are kept is found by counts of hashes; where too few terms occur twice, or too many equally often, all terms
    are counted as they are. The kept terms are broadcast; most_features bounds them.
    """
    again = df.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    n, kind = df.count(), df.schema[id_col].dataType.simpleString()
    rows = lambda part: part.select(F.col(id_col).alias("id"), words.alias("words"))
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() < cores:
        df = df.repartition(cores)
    many, once = None, df
    if not again.isEmpty():
        many, once = (df.join(again, F.col(id_col).eqNullSafe(F.col("_again")), how) for how in ("left_semi", "left_anti"))
    kept = _frequent(rows(once), many and rows(many), n, most_df, most_features)

    def counted(part: DataFrame) -> DataFrame:
        terms = part.repartition(id_col).select(id_col, F.explode(T.let(words, lambda w: F.concat(w, ngrams(w, 2)))).alias("term"))
        return terms.groupBy(id_col, "term").agg(F.count("*").alias("_tf"))

    idf = F.log((1 + F.lit(n)) / (1 + F.col("_df"))) + 1

    def weighed(tf: DataFrame, kept: DataFrame) -> DataFrame:
        weighted = tf.join(F.broadcast(kept.select("term", idf.alias("_idf"))), "term").withColumn("_w", F.col("_tf") * F.col("_idf"))
        norm = F.sqrt(F.sum(F.col("_w") * F.col("_w")).over(Window.partitionBy(id_col)))
        return weighted.select(id_col, "term", (F.col("_w") / norm).alias("weight"))

    if kept is None:
        tf = counted(df)
        stats = tf.groupBy("term").agg(F.count("*").alias("_df"), F.sum("_tf").alias("_total"))
        return weighed(tf, stats.where(F.col("_df") <= most_df * n).orderBy(F.desc("_total"), "term").limit(most_features))
    found = kept.select("term", idf.alias("idf")).toArrow()
    shared = df.sparkSession.sparkContext.broadcast((found["term"].to_pylist(), found["idf"].to_numpy()))
    out = rows(once).mapInArrow(_weights(shared), f"id {kind}, term string, weight double").withColumnRenamed("id", id_col)
    return out if many is None else out.union(weighed(counted(many), kept))


def word_counts(df: DataFrame, words: Column, by: str) -> DataFrame:
    return df.select(by, F.explode(words).alias("word")).groupBy(by, "word").agg(F.count("*").alias("n"))


def pair_counts(df: DataFrame, words: Column) -> DataFrame:
    """(left, right, n) of neighbouring characters, weighted by word counts: the first step of byte-pair merging.

    Words are counted first, so each distinct word is cut up once.
    """
    counted = df.select(F.explode(words).alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    letters = F.filter(F.split("word", ""), lambda c: c != "")
    pairs = F.zip_with(F.slice(letters, 1, F.greatest(F.size(letters) - 1, F.lit(0))), F.slice(letters, 2, F.greatest(F.size(letters) - 1, F.lit(1))), lambda a, b: F.struct(a.alias("left"), b.alias("right")))
    return counted.where(F.length("word") > 1).select(F.inline(pairs), "n").groupBy("left", "right").agg(F.sum("n").alias("n"))


def vocabulary(df: DataFrame, text: Column) -> DataFrame:
    """(id, character) of the distinct characters, numbered in order; as many rows as characters, however long the texts."""
    chars = df.select(F.explode(F.array_distinct(F.split(text, ""))).alias("char")).where("char <> ''").distinct()
    return chars.select((F.row_number().over(Window.orderBy("char")) - 1).cast("long").alias("id"), "char")


def confusion(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    return df.groupBy(truth, predicted).agg(F.count("*").alias("n"))


def binary_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: tp, fp, fn, precision, recall, f1 (denominators of at least 1) and accuracy."""
    y, p = F.col(truth) == 1, F.col(predicted) == 1
    counts = df.agg(F.count_if(y & p).alias("tp"), F.count_if(~y & p).alias("fp"), F.count_if(y & ~p).alias("fn"), F.count_if(F.col(truth) == F.col(predicted)).alias("_right"), F.count("*").alias("_n"))
    one = F.lit(1)
    counts = counts.withColumns({"precision": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fp")), "recall": F.col("tp") / F.greatest(one, F.col("tp") + F.col("fn"))})
    f1 = 2 * F.col("precision") * F.col("recall") / F.greatest(F.lit(1e-9), F.col("precision") + F.col("recall"))
    return counts.select("tp", "fp", "fn", "precision", "recall", f1.alias("f1"), (F.col("_right") / F.greatest(one, F.col("_n"))).alias("accuracy"))


def class_report(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """(class, precision, recall, support), by one pass over the pairs of classes."""
    pairs = df.select(F.col(truth).alias("t"), F.col(predicted).alias("p"))
    both = F.explode(F.array_distinct(F.array("t", "p"))).alias("class")
    counts = pairs.select("t", "p", both).groupBy("class").agg(F.count_if((F.col("t") == F.col("class")) & (F.col("p") == F.col("class"))).alias("hit"), F.count_if(F.col("p") == F.col("class")).alias("said"), F.count_if(F.col("t") == F.col("class")).alias("support"))
    return counts.select("class", (F.col("hit") / F.greatest(F.lit(1), F.col("said"))).alias("precision"), (F.col("hit") / F.greatest(F.lit(1), F.col("support"))).alias("recall"), "support")


def spans(df: DataFrame, keys: list[str], pos: str, tag: str) -> DataFrame:
    """(keys, label, start, end) of BIO tags, end exclusive; an I that continues nothing opens a span."""
    w = Window.partitionBy(*keys).orderBy(pos)
    label, before = F.substring(F.col(tag), 3, 100), F.lag(tag, 1, "O").over(w)
    opens = F.col(tag).startswith("B-") | (F.col(tag).startswith("I-") & (F.substring(before, 3, 100) != label))
    rows = df.withColumns({"_label": label, "_opens": F.when(opens, 1).otherwise(0)}).withColumn("_span", F.sum("_opens").over(w)).where(F.col(tag) != "O")
    return rows.groupBy(*keys, "_span", F.col("_label").alias("label")).agg(F.min(pos).alias("start"), (F.max(pos) + 1).alias("end")).drop("_span")


def span_metrics(truth: DataFrame, predicted: DataFrame, columns: list[str]) -> DataFrame:
    """Precision, recall and F1 of exact spans."""
    both = truth.select(*columns, F.lit(1).alias("t"), F.lit(0).alias("p")).union(predicted.select(*columns, F.lit(0), F.lit(1)))
    rows = both.groupBy(*columns).agg(F.max("t").alias("truth"), F.max("p").alias("predicted"))
    return binary_metrics(rows, "truth", "predicted").select("precision", "recall", "f1")


def _shared_grams(n: int):
    """(id, f) of rows (id, a, b) that have n-grams; a row's n-grams are counted alone."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, scores = [], []
            for i, (a, b) in enumerate(zip(batch["a"], batch["b"], strict=True)):
                a, b = (w if n == 1 else [" ".join(g) for g in zip(*[w[k:] for k in range(n)], strict=False)] for w in (a.as_py(), b.as_py()))
                if a or b:
                    at.append(i)
                    scores.append(200.0 * (Counter(a) & Counter(b)).total() / (len(a) + len(b)))
            yield pa.RecordBatch.from_arrays([batch["id"].take(pa.array(at, pa.int64())), pa.array(scores, pa.float64())], ["id", "f"])

    return run


def rouge_n(df: DataFrame, id_col: str, reference: Column, candidate: Column, n: int) -> DataFrame:
    """(id, f): 100 * F-measure of shared n-grams, repeats counted up to the rarer side.

    Rows are scored where they lie. Ids are counted first: n-grams of rows that share an id are counted together, after these
    rows alone are shuffled.
    """
    def grams(words, a, b):
        return F.transform(F.coalesce(ngrams(words, n), F.array()), lambda g: F.struct(g.alias("gram"), F.lit(a).alias("_a"), F.lit(b).alias("_b")))

    again = df.groupBy(F.col(id_col).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again")
    many, once = None, df
    if not again.isEmpty():
        many, once = (df.join(again, F.col(id_col).eqNullSafe(F.col("_again")), how) for how in ("left_semi", "left_anti"))
    words = [F.coalesce(side, F.array().cast("array<string>")).alias(name) for side, name in ((reference, "a"), (candidate, "b"))]
    kind = df.schema[id_col].dataType.simpleString()
    scored = once.select(F.col(id_col).alias("id"), *words).mapInArrow(_shared_grams(n), f"id {kind}, f double").withColumnRenamed("id", id_col)
    if many is None:
        return scored
    rows = many.repartition(id_col).select(id_col, F.inline(F.concat(grams(reference, 1, 0), grams(candidate, 0, 1))))
    both = rows.groupBy(id_col, "gram").agg(F.sum("_a").alias("_a"), F.sum("_b").alias("_b"))
    totals = both.groupBy(id_col).agg(F.sum(F.least("_a", "_b")).alias("_hit"), F.sum("_a").alias("_ref"), F.sum("_b").alias("_cand"))
    return scored.union(totals.select(id_col, (200.0 * F.col("_hit") / F.greatest(F.lit(1), F.col("_ref") + F.col("_cand"))).alias("f")))


def rouge_l(df: DataFrame, id_col: str, reference: Column, candidate: Column) -> DataFrame:
    """(id, f): 100 * F-measure of the longest common subsequence. Rows are scored where they lie, with one bit per reference word."""
    @F.pandas_udf("double")
    def score(a: pd.Series, b: pd.Series) -> pd.Series:
        return pd.Series([200.0 * common_subsequence(x, y) / max(1, len(x) + len(y)) for x, y in zip(a, b, strict=True)], dtype=float)

    return df.select(id_col, F.coalesce(reference, F.array()).alias("_a"), F.coalesce(candidate, F.array()).alias("_b")).select(id_col, score("_a", "_b").alias("f"))


def common_subsequence(a: Sequence[str], b: Sequence[str]) -> int:
    """Length of the longest one, by bit-parallel rows: the zeros of s are where a row's length grows."""
    at: dict[str, int] = {}
    for i, w in enumerate(a):
        at[w] = at.get(w, 0) | 1 << i
    every = s = (1 << len(a)) - 1
    for w in b:
        if u := s & at.get(w, 0):
            s = ((s + u) | (s - u)) & every
    return len(a) - s.bit_count()


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _words(text="text"):
    return T.tokens(F.lower(text))


def _sides():
    """Reference and candidate of a document: all but its last quarter of words, and all but its first."""
    words = F.coalesce(_words(), F.array())
    quarter = lambda w: F.floor(F.size(w) / 4).cast("int")
    return T.let(words, lambda w: F.slice(w, 1, F.size(w) - quarter(w))), T.let(words, lambda w: F.slice(w, quarter(w) + 1, F.size(w)))


def _tagged(s, d):
    tags = ["O", "B-PER", "I-PER", "I-LOC", "O", "B-LOC", "B-LOC", "I-LOC"]
    k = F.col("event_id")
    pick = F.element_at(F.array(*map(F.lit, tags)), (k * 7 % 8 + 1).cast("int"))
    other = F.element_at(F.array(*map(F.lit, tags)), (k * F.when(k % 5 == 0, 3).otherwise(7) % 8 + 1).cast("int"))
    return _read(s, d, "events").select("user_id", "event_id", pick.alias("truth"), other.alias("pred"))


_SPAN_KEYS = ["user_id", "label", "start", "end"]

QUERIES = {
    "t01_tf_idf": lambda s, d: tf_idf(_read(s, d, "documents"), "doc_id", _words()).withColumn("weight", F.round("weight", 5)),
    "t02_word_counts": lambda s, d: word_counts(_read(s, d, "documents").join(_read(s, d, "labels"), "doc_id"), _words(), "quality"),
    "t03_naive_bayes": lambda s, d: bayes.Counts(_read(s, d, "documents").join(_read(s, d, "labels"), "doc_id"), "doc_id", _words(), "quality", F.col("doc_id") % 10).search().withColumn("accuracy", F.round("accuracy", 6)),
    "t04_byte_merges": lambda s, d: bpe.merge_table(_read(s, d, "documents"), "text", 12),
    "t05_lossless": lambda s, d: bpe.lossless(_read(s, d, "documents"), bpe.train(bpe.word_counts(_read(s, d, "benchmark")), merges=12), "doc_id").select("doc_id", "n_chars", "same"),
    "t04_pair_counts": lambda s, d: pair_counts(_read(s, d, "documents"), _words()),
    "t08_ngrams": lambda s, d: _read(s, d, "benchmark").select("item_id", F.explode(ngrams(_words(), 3)).alias("gram")).groupBy("gram").agg(F.count("*").alias("n")),
    "g12_binary_metrics": lambda s, d: binary_metrics(_read(s, d, "labels"), "quality", "toxic").select("tp", "fp", "fn", *[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]),
    "g13_class_report": lambda s, d: class_report(_read(s, d, "labels"), "quality", "toxic").select("class", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"), "support"),
    "g13_confusion": lambda s, d: confusion(_read(s, d, "labels"), "quality", "toxic"),
    "g14_span_metrics": lambda s, d: span_metrics(spans(_tagged(s, d), ["user_id"], "event_id", "truth"), spans(_tagged(s, d), ["user_id"], "event_id", "pred"), _SPAN_KEYS).select(*[F.round(c, 6).alias(c) for c in ("precision", "recall", "f1")]),
    "g14_spans": lambda s, d: spans(_tagged(s, d), ["user_id"], "event_id", "truth"),
    "g15_rouge": lambda s, d: rouge_n(_read(s, d, "documents"), "doc_id", *_sides(), 2).withColumn("f", F.round("f", 4)),
    "g15_rouge_1": lambda s, d: rouge_n(_read(s, d, "documents"), "doc_id", *_sides(), 1).withColumn("f", F.round("f", 4)),
    "g15_rouge_l": lambda s, d: rouge_l(_read(s, d, "documents"), "doc_id", *_sides()).withColumn("f", F.round("f", 4)),
    "g15_generated_length": lambda s, d: _read(s, d, "documents").agg(F.round(F.avg(F.size(_sides()[1])), 4).alias("gen_len")),
    "g16_class_balance": lambda s, d: _read(s, d, "labels").groupBy("toxic").agg(F.count("*").alias("n")),
    "g24_vocabulary": lambda s, d: vocabulary(_read(s, d, "documents"), F.col("text")),
}

_W = r"list_filter(regexp_split_to_array(lower(text), '[ \t\n\r\f\v]+'), lambda w: w <> '')"
_GRAMS = lambda n: f"list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))"
_TAGS = "['O', 'B-PER', 'I-PER', 'I-LOC', 'O', 'B-LOC', 'B-LOC', 'I-LOC']"
_SPAN = lambda tag: f"""(SELECT user_id, label, min(event_id) AS start, max(event_id) + 1 AS "end" FROM (
  SELECT *, sum(CASE WHEN tag[1:2] = 'B-' OR (tag[1:2] = 'I-' AND prev[3:] <> label) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS span FROM (
    SELECT user_id, event_id, tag, tag[3:] AS label, lag(tag, 1, 'O') OVER (PARTITION BY user_id ORDER BY event_id) AS prev FROM (SELECT user_id, event_id, {tag} AS tag FROM events))) WHERE tag <> 'O' GROUP BY user_id, label, span)"""  # noqa: E731
_TRUTH = f"{_TAGS}[event_id * 7 % 8 + 1]"
_PRED = f"{_TAGS}[event_id * CASE WHEN event_id % 5 = 0 THEN 3 ELSE 7 END % 8 + 1]"

_ROUGE = lambda n: f"""WITH d AS (SELECT doc_id, w[1:len(w) - len(w) // 4] AS a, w[len(w) // 4 + 1:] AS b FROM (SELECT doc_id, {_W} AS w FROM documents)), a AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({_GRAMS(n)}) AS gram FROM (SELECT doc_id, a AS w FROM d)) GROUP BY ALL),
      b AS (SELECT doc_id, gram, count(*) AS n FROM (SELECT doc_id, unnest({_GRAMS(n)}) AS gram FROM (SELECT doc_id, b AS w FROM d)) GROUP BY ALL)
      SELECT doc_id, round(200.0::DOUBLE * sum(coalesce(least(a.n, b.n), 0) * CASE WHEN a.n IS NULL OR b.n IS NULL THEN 0 ELSE 1 END) / greatest(1, sum(coalesce(a.n, 0) + coalesce(b.n, 0))), 4) AS f FROM a FULL JOIN b USING (doc_id, gram) GROUP BY doc_id"""  # noqa: E731

SQL = {
    "t01_tf_idf": f"""WITH t AS (SELECT doc_id, unnest(list_concat(w, {_GRAMS(2)})) AS term FROM (SELECT doc_id, {_W} AS w FROM documents)), tf AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
      k AS (SELECT term, count(*) AS df, sum(tf) AS total FROM tf GROUP BY term HAVING count(*) <= 0.01::DOUBLE * (SELECT count(*) FROM documents) ORDER BY total DESC, term LIMIT 100000),
      x AS (SELECT doc_id, term, tf * (ln((1 + (SELECT count(*) FROM documents)) / (1 + df)::DOUBLE) + 1) AS v FROM tf JOIN k USING (term))
      SELECT doc_id, term, round(v / sqrt(sum(v * v) OVER (PARTITION BY doc_id)), 5) AS weight FROM x""",
    "t02_word_counts": f"SELECT quality, word, count(*) AS n FROM (SELECT quality, unnest({_W}) AS word FROM documents JOIN labels USING (doc_id)) GROUP BY ALL",
    "t03_naive_bayes": f"""WITH x AS (SELECT doc_id, doc_id % 10 AS fold, quality AS c, unnest({_W}) AS term FROM documents JOIN labels USING (doc_id)),
      tf AS (SELECT doc_id, fold, c, term, count(*) AS tf FROM x GROUP BY ALL), k AS (SELECT DISTINCT c FROM tf), f AS (SELECT DISTINCT fold FROM tf),
      own AS (SELECT fold, c, term, sum(tf) AS n FROM tf GROUP BY ALL), al AS (SELECT c, term, sum(n) AS n FROM own GROUP BY ALL),
      mass AS (SELECT f.fold, k.c, (SELECT count(DISTINCT term) FROM tf) AS v, coalesce((SELECT sum(tf) FROM tf WHERE tf.c = k.c AND tf.fold <> f.fold), 0) AS w,
        (SELECT count(DISTINCT doc_id) FROM tf WHERE tf.c = k.c AND tf.fold <> f.fold) AS docs, (SELECT count(DISTINCT doc_id) FROM tf WHERE tf.fold <> f.fold) AS every FROM f, k),
      a AS (SELECT unnest([0.001, 0.01, 0.1, 1.0, 1.3, 1.4, 1.7, 2.0, 2.4, 2.5, 10.0]::DOUBLE[]) AS alpha),
      s AS (SELECT tf.doc_id, tf.fold, tf.c AS truth, mass.c, alpha, sum(tf.tf * ln(coalesce(al.n, 0) - coalesce(own.n, 0) + alpha)) - sum(tf.tf) * ln(any_value(w) + alpha * any_value(v)) AS score, any_value(docs) AS docs, any_value(every) AS every
        FROM tf JOIN mass USING (fold) CROSS JOIN a LEFT JOIN al ON al.c = mass.c AND al.term = tf.term LEFT JOIN own ON own.fold = tf.fold AND own.c = mass.c AND own.term = tf.term GROUP BY tf.doc_id, tf.fold, tf.c, mass.c, alpha),
      p AS (SELECT doc_id, fold, truth, alpha, equal_priors, arg_min(c, (-(score + CASE WHEN equal_priors THEN ln(0.5::DOUBLE) ELSE ln(docs / every::DOUBLE) END), c)) AS c
        FROM s, (VALUES (TRUE), (FALSE)) e(equal_priors) GROUP BY doc_id, fold, truth, alpha, equal_priors)
      SELECT alpha, equal_priors, round(avg(r), 6) AS accuracy FROM (SELECT alpha, equal_priors, fold, avg((c = truth)::INT) AS r FROM p GROUP BY ALL) GROUP BY ALL""",
    "t05_lossless": "SELECT doc_id, coalesce(length(text), 0) AS n_chars, TRUE AS same FROM documents",
    "t04_pair_counts": f"""SELECT w[i] AS "left", w[i + 1] AS "right", count(*) AS n FROM (SELECT w, unnest(range(1, length(w))) AS i FROM (SELECT unnest({_W}) AS w FROM documents)) GROUP BY ALL""",
    "t08_ngrams": f"SELECT gram, count(*) AS n FROM (SELECT unnest({_GRAMS(3)}) AS gram FROM (SELECT {_W} AS w FROM benchmark)) GROUP BY gram",
    "g12_binary_metrics": """SELECT tp, fp, fn, round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1e-9, p + r), 6) AS f1 FROM (SELECT *, tp / greatest(1, tp + fp) AS p, tp / greatest(1, tp + fn) AS r FROM (
      SELECT count(*) FILTER (quality = 1 AND toxic = 1) AS tp, count(*) FILTER (quality <> 1 AND toxic = 1) AS fp, count(*) FILTER (quality = 1 AND toxic <> 1) AS fn FROM labels))""",
    "g13_class_report": """SELECT c AS class, round(hit / greatest(1, said), 6) AS precision, round(hit / greatest(1, support), 6) AS recall, support FROM (SELECT c, count(*) FILTER (quality = c AND toxic = c) AS hit,
      count(*) FILTER (toxic = c) AS said, count(*) FILTER (quality = c) AS support FROM labels, (VALUES (0), (1)) v(c) GROUP BY c)""",
    "g13_confusion": "SELECT quality, toxic, count(*) AS n FROM labels GROUP BY ALL",
    "g14_spans": f"SELECT * FROM {_SPAN(_TRUTH)}",
    "g14_span_metrics": f"""WITH t AS (SELECT * FROM {_SPAN(_TRUTH)}), p AS (SELECT * FROM {_SPAN(_PRED)}), h AS (SELECT count(*) AS n FROM (SELECT * FROM t INTERSECT SELECT * FROM p)),
      m AS (SELECT h.n / (SELECT count(*) FROM p) AS p, h.n / (SELECT count(*) FROM t) AS r FROM h) SELECT round(p, 6) AS precision, round(r, 6) AS recall, round(2 * p * r / greatest(1e-9, p + r), 6) AS f1 FROM m""",
    "g15_rouge": _ROUGE(2),
    "g15_rouge_1": _ROUGE(1),
    "g15_generated_length": f"SELECT round(avg(len(w) - len(w) // 4), 4) AS gen_len FROM (SELECT {_W} AS w FROM documents)",
    "g16_class_balance": "SELECT toxic, count(*) AS n FROM labels GROUP BY toxic",
    "g24_vocabulary": "SELECT row_number() OVER (ORDER BY encode(c)) - 1 AS id, c AS char FROM (SELECT DISTINCT unnest(string_split(text, '')) AS c FROM documents) WHERE c <> ''",
}
