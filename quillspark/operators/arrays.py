"""Array columns: padding, label masks, frames, signal levels and vector arithmetic, without leaving the JVM."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.functions import text as T

IGNORED = -100


def pad(values: Column, n: int, fill: Column) -> Column:
    """The first n values, filled up at the end."""
    return F.slice(F.concat(values, F.array_repeat(fill, F.greatest(F.lit(n) - F.size(values), F.lit(0)))), 1, n)


def attention_mask(values: Column, n: int) -> Column:
    return F.transform(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: F.when(i < F.size(values), 1).otherwise(0))


def label_mask(source: Column, target: Column) -> Column:
    """IGNORED for each source token, then the target."""
    return F.concat(F.array_repeat(F.lit(IGNORED), F.size(source)), target)


def target_mask(source: Column, target: Column) -> Column:
    return F.concat(F.array_repeat(F.lit(False), F.size(source)), F.array_repeat(F.lit(True), F.size(target)))


def replace_ignored(labels: Column, fill: int) -> Column:
    return F.transform(labels, lambda x: F.when(x == IGNORED, fill).otherwise(x))


def spread_labels(word_ids: Column, labels: Column, every: bool = False) -> Column:
    """Labels of words on their sub-tokens: IGNORED for special tokens (null) and, unless every, for all but the first."""
    previous = lambda i: F.get(word_ids, i - 1)
    first = lambda w, i: (i == 0) | ~w.eqNullSafe(previous(i))
    return F.transform(word_ids, lambda w, i: F.when(w.isNotNull() & (F.lit(every) | first(w, i)), F.get(labels, w)).otherwise(IGNORED))


def causal_mask(n: int) -> Column:
    rows = F.sequence(F.lit(0), F.lit(n - 1))
    return F.transform(rows, lambda i: F.transform(rows, lambda j: F.when(j <= i, 1).otherwise(0)))


def sliding_blocks(values: Column, n: int) -> Column:
    """Every (block, next value) of n consecutive values."""
    def cut(v: Column) -> Column:
        every = F.transform(v, lambda _, i: F.struct(F.slice(v, i + 1, n).alias("block"), F.get(v, i + n).alias("next")))
        return F.slice(every, 1, F.greatest(F.size(v) - n, F.lit(0)))

    return T.let(values, cut)


def frames(signal: Column, size: int, hop: int) -> Column:
    """Overlapping frames of the signal, reflected by half a frame at both ends; signals shorter than that have none."""
    half = size // 2
    head = F.reverse(F.slice(signal, 2, half))
    tail = F.reverse(F.slice(signal, F.greatest(F.size(signal) - half, F.lit(1)), half))
    padded = F.concat(head, signal, tail)
    cut = lambda y: F.transform(F.sequence(F.lit(0), F.floor((F.size(y) - size) / hop).cast("int")), lambda i: F.slice(y, i * hop + 1, size))
    return F.when(F.size(signal) > half, T.let(padded, cut))


def mean_square(signal: Column) -> Column:
    return F.aggregate(signal, F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")) / F.size(signal)


def decibels(frames_: Column) -> Column:
    """Level of each frame, relative to the loudest."""
    levels = F.transform(frames_, lambda f: F.sqrt(mean_square(f) + 1e-12))
    return T.let(levels, lambda v: T.let(F.struct(v.alias("v"), F.array_max(v).alias("most")), lambda s: F.transform(s["v"], lambda x: 20 * F.log10(x / (s["most"] + 1e-12) + 1e-12))))


def speech_labels(frames_: Column, threshold: float = -40.0) -> Column:
    return F.transform(decibels(frames_), lambda x: F.when(x > threshold, 1).otherwise(0))


def mix_at_ratio(speech: Column, noise: Column, decibel: float) -> Column:
    """speech plus noise scaled to the ratio; the whole is scaled down where its peak passes 0.99."""
    gain = F.sqrt((mean_square(speech) + 1e-12) / 10.0 ** (decibel / 10.0) / (mean_square(noise) + 1e-12))
    mix = T.let(gain, lambda g: F.zip_with(speech, noise, lambda a, b: a.cast("double") + b.cast("double") * g))
    scaled = lambda s: F.transform(s["mix"], lambda x: F.when(s["peak"] > 0.99, x * 0.99 / s["peak"]).otherwise(x))
    return T.let(mix, lambda m: T.let(F.struct(m.alias("mix"), F.array_max(F.transform(m, F.abs)).alias("peak")), scaled))


def fit_length(signal: Column, n: int, start: int = 0, fill: float = 0.0) -> Column:
    """n values from start; a shorter signal is centred in the fill."""
    before = F.floor((F.lit(n) - F.size(signal)) / 2).cast("int")
    short = F.concat(F.array_repeat(F.lit(fill), before), signal, F.array_repeat(F.lit(fill), F.lit(n) - F.size(signal) - before))
    return F.when(F.size(signal) >= n, F.slice(signal, start + 1, n)).otherwise(short)


def edge_pad(values: Column, n: int) -> Column:
    """n values; the last one is repeated where there are fewer."""
    return F.slice(F.concat(values, F.array_repeat(F.element_at(values, -1), F.greatest(F.lit(n) - F.size(values), F.lit(0)))), 1, n)


def to_pcm(signal: Column) -> Column:
    return F.transform(signal, lambda x: F.round(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), x.cast("double"))) * 32767).cast("int"))


def mel_filters(bands: int, size: int, rate: int) -> np.ndarray:
    """Triangles of equal width on the mel scale (2595 log10(1 + f / 700)) up to half the rate: a row per band."""
    mel = np.linspace(0.0, 2595 * np.log10(1 + rate / 2 / 700), bands + 2)
    edge = 700 * (10 ** (mel / 2595) - 1)
    at = np.linspace(0.0, rate / 2, size // 2 + 1)
    rise = (at - edge[:-2, None]) / (edge[1:-1] - edge[:-2])[:, None]
    fall = (edge[2:, None] - at) / (edge[2:] - edge[1:-1])[:, None]
    return np.maximum(0.0, np.minimum(rise, fall))


def log_mel(signal: Column, rate: int = 16_000, bands: int = 80, size: int = 512, frame_ms: float = 25.0, hop_ms: float = 10.0) -> Column:
    """Log-mel spectrogram, one array of bands per frame: Hann windows of frame_ms in the middle of Fourier frames of `size`,
    hop_ms apart, over the signal reflected by half a frame at both ends; ln(power + 1e-6). Signals of up to half a frame
    have none. In Arrow batches, as the JVM has no Fourier transform."""
    length, hop = int(frame_ms / 1000 * rate), int(hop_ms / 1000 * rate)
    left = (size - length) // 2
    window = np.pad(0.5 - 0.5 * np.cos(2 * np.pi * np.arange(length) / length), (left, size - length - left))
    filters = mel_filters(bands, size, rate)

    @F.pandas_udf("array<array<double>>")
    def run(signals: pd.Series) -> pd.Series:
        out = []
        for x in signals:
            if x is None or len(x) <= size // 2:
                out.append([])
                continue
            y = np.pad(np.asarray(x, dtype=float), size // 2, mode="reflect")
            frames = np.lib.stride_tricks.sliding_window_view(y, size)[::hop] * window
            power = np.abs(np.fft.rfft(frames, axis=1)) ** 2
            out.append(np.log(power @ filters.T + 1e-6).tolist())
        return pd.Series(out, dtype=object)

    return run(signal)


def centroids(df: DataFrame, group: str, vector: str) -> DataFrame:
    """(group, dim, mean): a partial sum per task, group and dimension is shuffled, not the vectors."""
    rows = df.select(group, F.posexplode(vector).alias("dim", "x"))
    return rows.groupBy(group, "dim").agg(F.avg(F.col("x").cast("double")).alias("mean"))


def matrix_product(a: DataFrame, b: DataFrame) -> DataFrame:
    """Of two sparse matrices (i, j, x): a join on the inner index and a sum."""
    left, right = a.select("i", F.col("j").alias("k"), F.col("x").alias("_a")), b.select(F.col("i").alias("k"), "j", F.col("x").alias("_b"))
    return left.join(right, "k").groupBy("i", "j").agg(F.sum(F.col("_a") * F.col("_b")).alias("x"))


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _tok(s, d):
    return _read(s, d, "documents").select("doc_id", F.transform(T.tokens(F.col("text")), lambda w: F.length(w)).alias("t"))


def _parts(c):
    """The first third of the values as source, the rest as target."""
    n = F.floor(F.size(c) / 3).cast("int")
    return F.slice(c, 1, n), F.slice(c, n + 1, F.size(c))


def _vec(s, d):
    return _read(s, d, "embeddings").select("vec_id", "label", F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _pairs(s, d):
    v = _vec(s, d)
    return v.join(v.select((F.col("vec_id") - 1).alias("vec_id"), F.col("v").alias("w")), "vec_id")


def _joined(c):
    return F.array_join(F.transform(c, lambda x: x.cast("string")), " ")


def _sparse(s, d):
    return _vec(s, d).select(F.col("vec_id").alias("i"), F.posexplode("v").alias("j", "x")).withColumn("j", F.col("j").cast("long"))


QUERIES = {
    "n10_pad": lambda s, d: _tok(s, d).select("doc_id", _joined(pad(F.col("t"), 32, F.lit(0))).alias("ids"), _joined(attention_mask(F.col("t"), 32)).alias("mask")),
    "n11_label_mask": lambda s, d: _tok(s, d).select("doc_id", _joined(label_mask(*_parts("t"))).alias("labels")),
    "n12_target_mask": lambda s, d: _tok(s, d).select("doc_id", _joined(target_mask(*_parts("t"))).alias("mask")),
    "n14_replace_ignored": lambda s, d: _tok(s, d).select("doc_id", _joined(replace_ignored(label_mask(*_parts("t")), 0)).alias("labels")),
    "n13_spread_labels": lambda s, d: _tok(s, d).select("doc_id", F.transform("t", lambda x, i: F.when(i == 0, None).otherwise(F.floor(i / 2).cast("int"))).alias("w"), F.col("t").alias("l")).select("doc_id", _joined(spread_labels(F.col("w"), F.col("l"))).alias("labels")),
    "n15_causal_mask": lambda s, d: _read(s, d, "region").select("r_regionkey", F.posexplode(causal_mask(4)).alias("row", "m")).select("r_regionkey", F.col("row").cast("long").alias("row"), _joined(F.col("m")).alias("mask")),
    "w19_sliding_blocks": lambda s, d: _tok(s, d).select("doc_id", F.posexplode(sliding_blocks(F.col("t"), 8)).alias("pos", "b")).select("doc_id", F.col("pos").cast("long").alias("pos"), _joined(F.col("b.block")).alias("block"), F.col("b.next").alias("next")),
    "w20_frames": lambda s, d: _vec(s, d).select("vec_id", F.posexplode(frames(F.col("v"), 8, 4)).alias("pos", "f")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.aggregate("f", F.lit(0.0), lambda a, x: a + x), 5).alias("total")),
    "d12_levels": lambda s, d: _vec(s, d).select("vec_id", F.posexplode(decibels(F.transform(F.sequence(F.lit(0), F.floor(F.size("v") / 8).cast("int") - 1), lambda i: F.slice("v", i * 8 + 1, 8)))).alias("pos", "db")).select("vec_id", F.col("pos").cast("long").alias("pos"), (F.round("db", 4) + 0.0).alias("db"), (F.col("db") > -6).alias("loud")),
    "d13_mix": lambda s, d: _pairs(s, d).select("vec_id", F.round(F.array_max(F.transform(mix_at_ratio(F.col("v"), F.col("w"), 5.0), F.abs)), 5).alias("peak")),
    "d14_fit_length": lambda s, d: _tok(s, d).select("doc_id", F.transform("t", lambda x: x.cast("double")).alias("t")).select("doc_id", _joined(F.transform(fit_length(F.col("t"), 16, 0), lambda x: x.cast("int"))).alias("t")),
    "d15_log_mel": lambda s, d: _vec(s, d).select("vec_id", F.posexplode(log_mel(F.flatten(F.array_repeat("v", F.lit(8))), 1000, 8, 64, 40.0, 32.0)).alias("pos", "m")).select("vec_id", F.col("pos").cast("long").alias("pos"), F.round(F.array_max("m"), 4).alias("most")),
    "d16_edge_pad": lambda s, d: _tok(s, d).where(F.size("t") > 0).select("doc_id", _joined(edge_pad(F.col("t"), 16)).alias("t")),
    "d17_pcm": lambda s, d: _vec(s, d).select("vec_id", F.aggregate(to_pcm(F.col("v")), F.lit(0).cast("long"), lambda a, x: a + x).alias("total"), F.array_max(to_pcm(F.col("v"))).alias("peak")),
    "d18_elementwise": lambda s, d: _pairs(s, d).select("vec_id", F.round(F.aggregate(F.zip_with("v", "w", lambda a, b: a * b), F.lit(0.0), lambda a, x: a + x), 5).alias("dot"), F.round(F.aggregate(F.zip_with("v", "w", lambda a, b: a + b), F.lit(0.0), lambda a, x: a + x), 5).alias("total")),
    "d18_matrix_product": lambda s, d: matrix_product(_sparse(s, d).select(F.col("j").alias("i"), F.col("i").alias("j"), "x"), _sparse(s, d)).withColumn("x", F.round("x", 5)),
    "g25_reductions": lambda s, d: _vec(s, d).select("vec_id", F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.aggregate("v", F.lit(0.0), lambda a, x: a + x) / F.size("v"), 5).alias("mean"), F.round(F.array_max("v"), 5).alias("most")),
    "g30_centroids": lambda s, d: centroids(_vec(s, d), "label", "v").select("label", F.col("dim").cast("long").alias("dim"), F.round("mean", 5).alias("mean")),
    "d08_softmax": lambda s, d: _vec(s, d).select("vec_id", F.transform("v", lambda x: F.exp((x - F.array_max("v")) / 0.7)).alias("e")).select("vec_id", F.round(F.array_max("e") / F.aggregate("e", F.lit(0.0), lambda a, x: a + x), 5).alias("top")),
}

_T = r"(SELECT doc_id, list_transform(list_filter(regexp_split_to_array(text, '[ \t\n\r\f\v]+'), lambda w: w <> ''), lambda w: length(w)) AS t FROM documents)"
_V = "(SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings)"
_P = f"(SELECT a.vec_id, a.v, b.v AS w FROM {_V} a JOIN {_V} b ON b.vec_id = a.vec_id + 1)"
_MS = lambda c: f"(list_sum(list_transform({c}, lambda x: x * x)) / len({c}))"
_LABELS = "list_concat(list_transform(t[1:len(t) // 3], lambda x: -100), t[len(t) // 3 + 1:])"
_ROW = "i, j - 1 AS j, x FROM (SELECT vec_id AS i, unnest(v) AS x, generate_subscripts(v, 1) AS j"

SQL = {
    "n10_pad": f"SELECT doc_id, array_to_string(list_transform(range(1, 33), lambda i: coalesce(t[i], 0)), ' ') AS ids, array_to_string(list_transform(range(1, 33), lambda i: CASE WHEN i <= len(t) THEN 1 ELSE 0 END), ' ') AS mask FROM {_T}",
    "n11_label_mask": f"SELECT doc_id, coalesce(array_to_string({_LABELS}, ' '), '') AS labels FROM {_T}",
    "n12_target_mask": f"SELECT doc_id, coalesce(array_to_string(list_concat(list_transform(t[1:len(t) // 3], lambda x: 'false'), list_transform(t[len(t) // 3 + 1:], lambda x: 'true')), ' '), '') AS mask FROM {_T}",
    "n14_replace_ignored": f"SELECT doc_id, coalesce(array_to_string(list_concat(list_transform(t[1:len(t) // 3], lambda x: 0), t[len(t) // 3 + 1:]), ' '), '') AS labels FROM {_T}",
    "n15_causal_mask": "SELECT r_regionkey, i AS row, array_to_string(list_transform(range(0, 4), lambda j: CASE WHEN j <= i THEN 1 ELSE 0 END), ' ') AS mask FROM region, range(0, 4) r(i)",
    "w19_sliding_blocks": f"""SELECT doc_id, pos, concat_ws(' ', x, lead(x, 1) OVER w, lead(x, 2) OVER w, lead(x, 3) OVER w, lead(x, 4) OVER w, lead(x, 5) OVER w, lead(x, 6) OVER w, lead(x, 7) OVER w) AS block, lead(x, 8) OVER w AS next
      FROM (SELECT doc_id, generate_subscripts(t, 1) - 1 AS pos, unnest(t) AS x FROM {_T}) WINDOW w AS (PARTITION BY doc_id ORDER BY pos) QUALIFY next IS NOT NULL""",
    "w20_frames": f"""SELECT vec_id, i AS pos, round(list_sum(y[i * 4 + 1:i * 4 + 8]), 5) AS total FROM (SELECT vec_id, y, unnest(range(0, (len(y) - 8) // 4 + 1)) AS i FROM (
      SELECT vec_id, list_concat(list_concat(list_reverse(v[2:5]), v), list_reverse(v[len(v) - 4:len(v) - 1])) AS y FROM {_V}))""",
    "d12_levels": f"""SELECT vec_id, i AS pos, round(db, 4) + 0.0 AS db, db > -6 AS loud FROM (SELECT vec_id, i, 20 * log10(x / (max(x) OVER (PARTITION BY vec_id) + 1e-12) + 1e-12) AS db FROM (
      SELECT vec_id, i, sqrt(list_sum(list_transform(v[i * 8 + 1:i * 8 + 8], lambda x: x * x)) / len(v[i * 8 + 1:i * 8 + 8]) + 1e-12) AS x FROM (SELECT vec_id, v, unnest(range(0, len(v) // 8)) AS i FROM {_V})))""",
    "d13_mix": f"""SELECT vec_id, round(CASE WHEN p > 0.99 THEN p * 0.99 / p ELSE p END, 5) AS peak FROM (SELECT vec_id, list_max(list_transform(list_zip(v, w), lambda z: abs(z[1] + z[2] * g))) AS p FROM (
      SELECT *, sqrt(({_MS('v')} + 1e-12) / 10.0::DOUBLE ** 0.5 / ({_MS('w')} + 1e-12)) AS g FROM {_P}))""",
    "d14_fit_length": f"""SELECT doc_id, array_to_string(list_transform(range(1, 17), lambda i: CASE WHEN len(t) >= 16 THEN t[i] WHEN i - (16 - len(t)) // 2 BETWEEN 1 AND len(t) THEN t[i - (16 - len(t)) // 2] ELSE 0 END), ' ') AS t FROM {_T}""",
    "d16_edge_pad": f"SELECT doc_id, array_to_string(list_transform(range(1, 17), lambda i: t[least(i, len(t))]), ' ') AS t FROM {_T} WHERE len(t) > 0",
    "d17_pcm": f"SELECT vec_id, list_sum(p)::BIGINT AS total, list_max(p) AS peak FROM (SELECT vec_id, list_transform(v, lambda x: round(greatest(-1.0::DOUBLE, least(1.0::DOUBLE, x)) * 32767)::INT) AS p FROM {_V})",
    "d18_elementwise": f"SELECT vec_id, round(list_sum(list_transform(list_zip(v, w), lambda z: z[1] * z[2])), 5) AS dot, round(list_sum(list_transform(list_zip(v, w), lambda z: z[1] + z[2])), 5) AS total FROM {_P}",
    "d18_matrix_product": f"WITH m AS (SELECT {_ROW} FROM {_V})) SELECT a.j AS i, b.j, round(sum(a.x * b.x), 5) AS x FROM m a JOIN m b ON a.i = b.i GROUP BY a.j, b.j",
    "g25_reductions": f"SELECT vec_id, round(list_sum(v), 5) AS total, round(list_sum(v) / len(v), 5) AS mean, round(list_max(v), 5) AS most FROM {_V}",
    "g30_centroids": f"SELECT label, j - 1 AS dim, round(avg(x), 5) AS mean FROM (SELECT label, unnest(v) AS x, generate_subscripts(v, 1) AS j FROM {_V}) GROUP BY ALL",
    "d08_softmax": f"SELECT vec_id, round(list_max(e) / list_sum(e), 5) AS top FROM (SELECT vec_id, list_transform(v, lambda x: exp((x - list_max(v)) / 0.7::DOUBLE)) AS e FROM {_V})",
}
