"""Event series: gaps, latency, load, smoothing, sampling cuts, step folds, windows and sessions."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quillspark.plans import prefix
from quillspark.plans.scan import lag, rank, row_number, running, scan, whole
from quillspark.streaming.utterances import Machine, utterances


def seconds(at: Column) -> Column:
    return F.unix_micros(at.cast("timestamp")) / 1e6


def gaps(df: DataFrame, key: str, at: str, tie: str, out: str = "gap") -> DataFrame:
    """df with out: seconds since the key's previous row."""
    rows = scan(df, key, [at, tie], {"_before": lag(F.col(at))})
    return rows.withColumn(out, seconds(F.col(at)) - seconds(F.col("_before"))).drop("_before")


def latency_metrics(df: DataFrame, key: str, at: str, tie: str) -> DataFrame:
    """Per key: arrivals, first, total seconds, rate, and the mean, least and greatest gap."""
    rows = gaps(df, key, at, tie, "_gap")
    total = seconds(F.max(at)) - seconds(F.min(at))
    return rows.groupBy(key).agg(
        F.count("*").alias("n"), F.round(total, 3).alias("total_s"), F.round(F.count("*") / F.nullif(total, F.lit(0.0)), 6).alias("rate"),
        F.round(F.avg("_gap"), 3).alias("mean_gap"), F.round(F.min("_gap"), 3).alias("min_gap"), F.round(F.max("_gap"), 3).alias("max_gap"),
    )


def percentiles(df: DataFrame, value: str, shares: tuple[float, ...]) -> DataFrame:
    """One row of exact, interpolated percentiles (p50 for 0.5), nulls aside: values are counted, and their places found by
    prefix sums, so no task holds all distinct values."""
    counts = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("_v")).agg(F.count("*").alias("_n"))
    rows = prefix.total_before(counts, "_v", F.col("_n"), "_under").crossJoin(F.broadcast(counts.agg(F.sum("_n").alias("_all"))))

    def at(place: Column) -> Column:
        return F.max(F.when((F.col("_under") <= place) & (place < F.col("_under") + F.col("_n")), F.col("_v")))

    def percentile(p: float) -> Column:
        place = (F.col("_all") - 1) * F.lit(p)
        low, part = at(F.floor(place)), F.max(place - F.floor(place))
        return low + (at(F.ceil(place)) - low) * part

    return rows.agg(*[percentile(p).alias(f"p{int(p * 100)}") for p in shares])


def load_summary(df: DataFrame, at: str, value: str, target: float) -> DataFrame:
    """One row: requests, rate, daily projection, headroom over the target, whether it is met, and percentiles of value."""
    span = seconds(F.max(at)) - seconds(F.min(at))
    shares = (0.5, 0.9, 0.95, 0.99)
    exact = percentiles(df, value, shares).select(*[F.round(f"p{int(p * 100)}", 4).alias(f"p{int(p * 100)}") for p in shares])
    out = df.agg(F.count("*").alias("n"), span.alias("_s")).crossJoin(exact).withColumn("_rate", F.col("n") / F.col("_s"))
    return out.select("n", F.round("_rate", 6).alias("rate"), F.round(F.col("_rate") * 86400).cast("long").alias("daily"), F.round(F.col("_rate") / target, 4).alias("headroom"), (F.col("_rate") >= target).alias("met"), "p50", "p90", "p95", "p99")


def moving_average(df: DataFrame, key: str, order: list[str], value: str, alpha: float = 0.1) -> DataFrame:
    """(key, ema): the exponential average of each key's values in order, seeded by the first.

    Unrolled, it is a sum weighted by place, so no key's values are gathered in one row, and tasks add up what they hold.
    """
    rows = scan(df.select(key, *order, F.col(value).cast("double").alias("_v")), key, order, {"_k": row_number(), "_n": whole(F.lit(1))})
    weight = F.pow(F.lit(1 - alpha), F.col("_n") - F.col("_k")) * F.when(F.col("_k") == 1, 1.0).otherwise(alpha)
    return rows.groupBy(key).agg(F.sum(F.col("_v") * weight).alias("ema"))


def nucleus(df: DataFrame, key: str, weight: str, tie: str, p: float) -> DataFrame:
    """Rows of each key by falling share, with share, until p is passed; the row that passes it is kept.

    Where all weights of a key are decimals of up to eight places, below ten billion, shares are compared exactly: a row
    before which just p lies is kept, however sums of doubles would be rounded."""
    w = F.col(weight)
    cents = w.try_cast("decimal(18, 8)")
    units, rough = (cents * 10**8).cast("decimal(18, 0)"), F.when(cents.cast("double").eqNullSafe(w.cast("double")), 0).otherwise(1)
    outs = {"_all": whole(w), "_before": running(w, including=False), "_units": whole(units), "_under": running(units, including=False), "_rough": whole(rough)}
    rows = scan(df, key, [f"-{weight}", tie], outs)
    within = F.when(F.col("_rough") == 0, F.col("_under") <= F.col("_units").cast("decimal(28, 0)") * F.lit(Decimal(str(p)))).otherwise(F.col("_before") / F.col("_all") <= p)
    return rows.where(within).withColumn("share", w / F.col("_all")).drop(*outs)


def top_with_ties(df: DataFrame, key: str, weight: str, k: int) -> DataFrame:
    return scan(df, key, f"-{weight}", {"_r": rank()}).where(F.col("_r") <= k).drop("_r")


def islands(df: DataFrame, key: str, order: str, opens: Column, out: str = "island") -> DataFrame:
    """df with out: how many rows that open a group the key has had so far."""
    return scan(df, key, order, {out: running(F.when(opens, 1).otherwise(0))})


def text_deltas(df: DataFrame, key: str, order: str, text: str, most: int, out: str = "delta") -> DataFrame:
    """df with out: the text without as many characters at its front as the key's text before had, at most so many."""
    rows = scan(df, key, order, {"_before": lag(F.col(text))})
    shown = F.least(F.coalesce(F.length("_before"), F.lit(0)), F.lit(most))
    return rows.withColumn(out, F.substr(F.col(text), shown + 1)).drop("_before")


def sessions(df: DataFrame, key: str, at: str, gap_s: int) -> DataFrame:
    """(key, start, stop, n): rows less than gap_s after the one before are of its session."""
    rows = df.select(key, F.col(at).cast("timestamp").alias("_at"))
    out = rows.groupBy(key, F.session_window("_at", f"{gap_s} seconds").alias("_w")).agg(F.min("_at").alias("start"), F.max("_at").alias("stop"), F.count("*").alias("n"))
    return out.select(key, F.col("start").cast("timestamp_ntz").alias("start"), F.col("stop").cast("timestamp_ntz").alias("stop"), "n")


def tumbling(df: DataFrame, at: str, width: str, slide: str | None = None) -> DataFrame:
    w = F.window(F.col(at).cast("timestamp"), width, *([slide] if slide else []))
    return df.groupBy(w.alias("_w"), "event_type").agg(F.count("*").alias("n")).select(F.col("_w.start").cast("timestamp_ntz").alias("start"), "event_type", "n")


def date_bucket(day: Column, as_of: str) -> Column:
    age = F.datediff(F.to_date(F.lit(as_of)), day)
    return F.when(age <= 0, "today").when(age == 1, "yesterday").when(age <= 7, "week").otherwise("older")


def warm_cosine(step: Column, warm: int, total: int, peak: float) -> Column:
    """Linear rise to peak over warm steps, then half a cosine down to zero."""
    late = F.least(F.lit(1.0), (step - warm) / float(max(1, total - warm)))
    return F.when(step < warm, peak * step / float(max(1, warm))).otherwise(peak * 0.5 * (1 + F.cos(F.lit(3.141592653589793) * late)))


def batch_size(step: Column, kind: str, start: int, most: int, interval: int, total: int, milestones: list[tuple[int, float]] = ()) -> Column:
    """Effective batch size at a step: fixed, doubling each interval, linear to most, or multiplied at milestones."""
    if kind == "fixed":
        return F.lit(start).cast("long")
    if kind == "doubling":
        return F.least(F.lit(most), start * F.pow(F.lit(2.0), F.least(F.lit(40), F.floor(step / interval)))).cast("long")
    if kind == "linear":
        return F.floor(start + (most - start) * F.least(F.lit(1.0), step / total)).cast("long")
    if kind == "step":
        out = F.lit(float(start))
        for at, by in milestones:
            out = F.when(step >= at, F.least(F.lit(float(most)), F.floor(out * by))).otherwise(out)
        return out.cast("long")
    raise ValueError(kind)


def _read(s, d, name):
    return s.read.parquet(f"{d}/{name}.parquet")


def _events(s, d):
    return _read(s, d, "events")


def _steps(s, d) -> DataFrame:
    """Events as optimizer steps, numbered from 0 in the order of their ids."""
    return prefix.row_number(_events(s, d), "event_id", "_nth").withColumn("step", F.col("_nth") - 1)


#: Two frames of prefix, one of suffix, two days of silence.
SPEECH = Machine(2, 1, 2 * 86400)

QUERIES = {
    "g17_latency": lambda s, d: latency_metrics(_events(s, d), "user_id", "ts", "event_id"),
    "r13_first_response": lambda s, d: _events(s, d).groupBy("event_type").agg(F.min("ts").alias("first_at"), F.round(seconds(F.max("ts")) - seconds(F.min("ts")), 3).alias("total_s")),
    "g18_load_summary": lambda s, d: load_summary(_events(s, d), "ts", "value", 0.004),
    "g19_moving_average": lambda s, d: moving_average(_events(s, d), "user_id", ["ts", "event_id"], "value").withColumn("ema", F.round("ema", 5)),
    "g20_histogram": lambda s, d: _events(s, d).groupBy(F.width_bucket("value", F.lit(0.0), F.lit(100.0), F.lit(20)).alias("bin")).agg(F.count("*").alias("n"), F.min("value").alias("low"), F.max("value").alias("high")),
    "g27_step_state": lambda s, d: _events(s, d).groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"), F.max("ts").alias("at")),
    "g28_islands": lambda s, d: islands(_events(s, d), "user_id", "event_id", F.col("event_type") == "signup").groupBy("user_id", "island").agg(F.count("*").alias("n")),
    "g33_mean_of_first": lambda s, d: _events(s, d).orderBy("event_id").limit(320).agg(F.round(F.avg("value"), 6).alias("mean")),
    "w09_gaps": lambda s, d: gaps(_events(s, d), "user_id", "ts", "event_id").select("event_id", F.round("gap", 4).alias("gap")),
    "w10_nucleus": lambda s, d: nucleus(_events(s, d).where("value > 0"), "user_id", "value", "event_id", 0.5).select("event_id"),
    "w11_top_k": lambda s, d: top_with_ties(_events(s, d), "user_id", "value", 5).select("event_id"),
    "w14_date_buckets": lambda s, d: _events(s, d).groupBy(date_bucket(F.to_date("ts"), "2024-01-20").alias("bucket")).agg(F.count("*").alias("n")),
    "r12_delta": lambda s, d: text_deltas(_events(s, d), "user_id", "event_id", "props", 3).select("event_id", "delta"),
    "r11_utterances": lambda s, d: utterances(_events(s, d), "user_id", "ts", "event_id", F.col("event_id"), F.col("event_type") == "purchase", SPEECH).withColumnRenamed("key", "user_id"),
    "r16_tumbling": lambda s, d: tumbling(_events(s, d), "ts", "10 minutes"),
    "r16_sliding": lambda s, d: tumbling(_events(s, d), "ts", "1 hour", "30 minutes"),
    "i20_sessions": lambda s, d: sessions(_events(s, d), "user_id", "ts", 1800),
    "d09_schedule": lambda s, d: _steps(s, d).select("event_id", F.round(warm_cosine(F.col("step"), 200, 700, 0.001), 8).alias("rate")),
    "d10_batch_sizes": lambda s, d: _steps(s, d).select("event_id", batch_size(F.col("step"), "fixed", 8, 512, 25, 200).alias("fixed"), batch_size(F.col("step"), "doubling", 8, 512, 25, 200).alias("doubling"), batch_size(F.col("step"), "linear", 8, 512, 25, 100).alias("linear"), batch_size(F.col("step"), "step", 8, 512, 25, 100, [(50, 3), (100, 2.5)]).alias("step")),
    "d11_steps": lambda s, d: _read(s, d, "documents").groupBy("source").agg((F.floor(F.count("*") / 16) * 3).alias("steps")),
    "d19_token_range": lambda s, d: _read(s, d, "part").select("p_partkey", (F.col("p_size") * 1.5).alias("mean"), F.round(F.col("p_size") / (F.col("p_size") * 2 + 1), 6).alias("ratio")),
    "d20_age_window": lambda s, d: _events(s, d).where(seconds(F.col("ts")) >= 1704067200 + 5 * 86400).select("event_id"),
    "d01_rounding": lambda s, d: _events(s, d).select("event_id", F.round("value", 1).alias("value")),
}

_SEC = lambda c: f"epoch_us({c}) / 1e6"
_GAPS = f"(SELECT *, {_SEC('ts')} - {_SEC('lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id)')} AS gap FROM events)"
_PCT = ", ".join(f"round(quantile_cont(value, {p}), 4) AS p{int(p * 100)}" for p in (0.5, 0.9, 0.95, 0.99))
_STEPS = "(SELECT event_id, row_number() OVER (ORDER BY event_id) - 1 AS id FROM events)"
SQL = {
    "g17_latency": f"""SELECT user_id, count(*) AS n, round(max({_SEC('ts')}) - min({_SEC('ts')}), 3) AS total_s, round(count(*) / nullif(max({_SEC('ts')}) - min({_SEC('ts')}), 0), 6) AS rate,
      round(avg(gap), 3) AS mean_gap, round(min(gap), 3) AS min_gap, round(max(gap), 3) AS max_gap FROM {_GAPS} GROUP BY user_id""",
    "r13_first_response": f"SELECT event_type, min(ts) AS first_at, round(max({_SEC('ts')}) - min({_SEC('ts')}), 3) AS total_s FROM events GROUP BY event_type",
    "g18_load_summary": f"""SELECT n, round(r, 6) AS rate, round(r * 86400)::BIGINT AS daily, round(r / 0.004::DOUBLE, 4) AS headroom, r >= 0.004::DOUBLE AS met, p50, p90, p95, p99 FROM (
      SELECT count(*) AS n, count(*) / (max({_SEC('ts')}) - min({_SEC('ts')})) AS r, {_PCT} FROM events)""",
    "g19_moving_average": """SELECT user_id, round(sum(value * w), 5) AS ema FROM (SELECT user_id, value, CASE WHEN k = 1 THEN 0.9::DOUBLE ** (n - 1) ELSE 0.1::DOUBLE * 0.9::DOUBLE ** (n - k) END AS w FROM (
      SELECT user_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k, count(*) OVER (PARTITION BY user_id) AS n FROM events)) GROUP BY user_id""",
    "g20_histogram": "SELECT CASE WHEN value < 0 THEN 0 WHEN value >= 100 THEN 21 ELSE floor(value / 5) + 1 END::BIGINT AS bin, count(*) AS n, min(value) AS low, max(value) AS high FROM events GROUP BY 1",
    "g27_step_state": "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status, max(ts) AS at FROM events GROUP BY user_id",
    "g28_islands": "SELECT user_id, island, count(*) AS n FROM (SELECT user_id, count(*) FILTER (event_type = 'signup') OVER (PARTITION BY user_id ORDER BY event_id) AS island FROM events) GROUP BY ALL",
    "g33_mean_of_first": "SELECT round(avg(value), 6) AS mean FROM (SELECT value FROM events ORDER BY event_id LIMIT 320)",
    "w09_gaps": f"SELECT event_id, round(gap, 4) AS gap FROM {_GAPS}",
    "w10_nucleus": """SELECT event_id FROM (SELECT event_id, coalesce(sum(share) OVER (PARTITION BY user_id ORDER BY share DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS b FROM (
      SELECT *, value / sum(value) OVER (PARTITION BY user_id) AS share FROM events WHERE value > 0)) WHERE b <= 0.5""",
    "w11_top_k": "SELECT event_id FROM (SELECT event_id, rank() OVER (PARTITION BY user_id ORDER BY value DESC) AS r FROM events) WHERE r <= 5",
    "w14_date_buckets": "SELECT CASE WHEN a <= 0 THEN 'today' WHEN a = 1 THEN 'yesterday' WHEN a <= 7 THEN 'week' ELSE 'older' END AS bucket, count(*) AS n FROM (SELECT date_diff('day', ts::DATE, DATE '2024-01-20') AS a FROM events) GROUP BY 1",
    "r12_delta": "SELECT event_id, substr(props, least(length(coalesce(lag(props) OVER (PARTITION BY user_id ORDER BY event_id), '')), 3) + 1) AS delta FROM events",
    "r11_utterances": """WITH RECURSIVE e AS (SELECT user_id, event_id, epoch_us(ts) AS us, event_type = 'purchase' AS stop FROM events),
      g AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS part FROM (
        SELECT *, CASE WHEN us - lag(us) OVER (PARTITION BY user_id ORDER BY us, event_id) > 172800000000 THEN 1 ELSE 0 END AS o FROM e)),
      f AS (SELECT *, row_number() OVER w AS n, count(*) OVER (PARTITION BY user_id, part) AS size FROM g WINDOW w AS (PARTITION BY user_id, part ORDER BY us, event_id)),
      -- the first stop from each frame on, and the turn that would begin there
      h AS (SELECT *, min(CASE WHEN stop THEN n END) OVER (PARTITION BY user_id, part ORDER BY n ROWS BETWEEN 2 FOLLOWING AND UNBOUNDED FOLLOWING) AS halt FROM f),
      t AS (SELECT user_id, part, n AS a, halt, least(coalesce(halt + 1, size), size) AS b, coalesce(halt + 1 <= size, false) AS complete, size FROM h WHERE n = 1
        UNION ALL SELECT h.user_id, h.part, h.n, h.halt, least(coalesce(h.halt + 1, h.size), h.size), coalesce(h.halt + 1 <= h.size, false), h.size FROM t JOIN h ON h.user_id = t.user_id AND h.part = t.part AND h.n = t.b + 1 WHERE t.complete)
      SELECT t.user_id, min(f.us) AS began, max(f.us) AS ended, count(*)::INT AS frames,
        coalesce(string_agg(f.event_id::VARCHAR, ' ' ORDER BY f.n) FILTER (WHERE f.n >= t.a + 2 AND f.n <= coalesce(t.halt, t.size)), '') AS text, CASE WHEN complete THEN 'complete' ELSE 'timeout' END AS outcome
      FROM t JOIN f ON f.user_id = t.user_id AND f.part = t.part AND f.n BETWEEN t.a AND t.b GROUP BY t.user_id, t.part, t.a, t.complete""",
    "r16_tumbling": "SELECT time_bucket(INTERVAL 10 MINUTES, ts) AS start, event_type, count(*) AS n FROM events GROUP BY ALL",
    "r16_sliding": "SELECT start, event_type, count(*) AS n FROM (SELECT event_type, time_bucket(INTERVAL 30 MINUTES, ts) - x * INTERVAL 30 MINUTES AS start FROM events, (VALUES (0), (1)) v(x)) GROUP BY ALL",
    "i20_sessions": """SELECT user_id, min(ts) AS start, max(ts) AS stop, count(*) AS n FROM (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS s FROM (
      SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) < INTERVAL 1800 SECONDS THEN 0 ELSE 1 END AS o FROM events)) GROUP BY user_id, s""",
    "d09_schedule": f"""SELECT event_id, round(CASE WHEN id < 200 THEN 0.001::DOUBLE * id / 200.0::DOUBLE ELSE 0.001::DOUBLE * 0.5::DOUBLE * (1 + cos(pi() * least(1.0::DOUBLE, (id - 200) / 500.0::DOUBLE))) END, 8) AS rate FROM {_STEPS}""",
    "d10_batch_sizes": f"""SELECT event_id, 8::BIGINT AS fixed, least(512, 8 * 2 ** least(40, id // 25))::BIGINT AS doubling, floor(8 + 504 * least(1.0::DOUBLE, id / 100.0::DOUBLE))::BIGINT AS linear,
      CASE WHEN id >= 100 THEN 60 WHEN id >= 50 THEN 24 ELSE 8 END::BIGINT AS step FROM {_STEPS}""",
    "d11_steps": "SELECT source, count(*) // 16 * 3 AS steps FROM documents GROUP BY source",
    "d19_token_range": "SELECT p_partkey, (p_size * 1.5)::DOUBLE AS mean, round(p_size / (p_size * 2 + 1)::DOUBLE, 6) AS ratio FROM part",
    "d20_age_window": "SELECT event_id FROM events WHERE epoch_us(ts) / 1e6 >= 1704067200 + 5 * 86400",
    "d01_rounding": "SELECT event_id, round(value, 1) AS value FROM events",
}
