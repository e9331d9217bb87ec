"""Structured Streaming forms of the event operators. State is bounded: by a count per key, or by a watermark."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def follow(spark: SparkSession, path: str, schema, files_per_batch: int = 100) -> DataFrame:
    """Parquet files as they come; times without zone become timestamps, as watermarks need them."""
    rows = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    return rows.withColumns({f.name: F.col(f.name).cast("timestamp") for f in rows.schema if f.dataType.typeName() == "timestamp_ntz"})


def subscribe(events: DataFrame, key: str, value) -> DataFrame:
    return events.where(F.col(key) == value)


SUBSCRIPTIONS = "subscriber string, key string, active boolean, at timestamp"


def subscribers(table: DataFrame) -> DataFrame:
    """(subscriber, key) that are subscribed by now: the last row of each says. A null key subscribes to all events; of rows of
    one time an active one counts."""
    last = table.groupBy("subscriber", "key").agg(F.max(F.struct("at", "active")).alias("last"))
    return last.where("last.active").select("subscriber", "key")


def matched(events: DataFrame, key: str, subscriptions: DataFrame) -> DataFrame:
    """Events once for each of their subscribers, with the column subscriber. An event meets the subscriptions of its key and
    those to all events in one equi join; a subscriber of both gets it once."""
    to = F.explode(F.array(F.struct(F.lit(False).alias("all"), F.col(key).cast("string").alias("key")), F.struct(F.lit(True).alias("all"), F.lit(None).cast("string").alias("key"))))
    rows = events.withColumn("_to", to).where("_to.all OR _to.key IS NOT NULL")
    subs = subscriptions.select("subscriber", F.struct(F.col("key").isNull().alias("all"), F.col("key").alias("key")).alias("_sub"))
    keyed = subs.withColumnRenamed("subscriber", "_global").where("_sub.all").select("_global").distinct()
    subs = subs.join(keyed, F.col("subscriber") == F.col("_global"), "left").where("_sub.all OR _global IS NULL").drop("_global")
    on = (F.col("_to.all") == F.col("_sub.all")) & F.col("_to.key").eqNullSafe(F.col("_sub.key"))
    return rows.join(subs, on).select("subscriber", *events.columns)


def deliver(events: DataFrame, key: str, subscriptions: str, sink: str, checkpoint: str):
    """One query for all subscriptions: each batch is joined with the table of subscriptions (SUBSCRIPTIONS, Parquet at that
    path) as it is then, and written to sink/batch=n/subscriber=…. Who is added gets the batches to come, and who is taken
    off no more. A batch that is run again replaces what it wrote."""
    def batch(rows: DataFrame, number: int) -> None:
        table = rows.sparkSession.read.schema(SUBSCRIPTIONS).parquet(subscriptions)
        matched(rows, key, subscribers(table)).write.mode("overwrite").partitionBy("subscriber").parquet(f"{sink}/batch={number}")

    return events.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint)


def replay_then_live(events: DataFrame, key: str, order: str, last: DataFrame) -> DataFrame:
    """Each key's events after the one it saw last (key, order), first those that are there, then those to come. A key without
    one, or whose last event is unknown, gets all of them: the stream begins at the first file, and the checkpoint goes on."""
    seen = last.groupBy(F.col(key).alias("_key")).agg(F.max(order).alias("_last"))
    joined = events.join(seen, events[key] == seen["_key"], "left")
    return joined.where(F.col("_last").isNull() | (F.col(order) > F.col("_last"))).drop("_key", "_last")


def with_heartbeats(events: DataFrame, key: str, value: str, seconds: int = 30) -> DataFrame:
    """Append mode: (key, kind, value) for each event, and of kind heartbeat for a key that was silent so long, again and
    again while it is. State is one number a key."""
    kinds = {f.name: f.dataType.simpleString() for f in events.schema.fields}

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            yield pd.DataFrame({key: [k[0]], "kind": ["heartbeat"], value: [None]})
        else:
            for part in parts:
                yield pd.DataFrame({key: part[key], "kind": "event", value: part[value]})
        state.update((1,))
        state.setTimeoutDuration(seconds * 1000)

    return events.select(key, value).groupBy(key).applyInPandasWithState(
        run, f"{key} {kinds[key]}, kind string, {value} {kinds[value]}", "n bigint", "append", GroupStateTimeout.ProcessingTimeTimeout
    )


def ring_buffer(events: DataFrame, key: str, order: str, n: int) -> DataFrame:
    """Update mode: (key, kept) with the orders of the key's n newest rows after each batch."""
    kind = events.schema[key].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = list(state.get[0]) if state.exists else []
        for part in parts:
            kept = sorted([*kept, *map(int, part[order])])[-n:]
        state.update((kept,))
        yield pd.DataFrame({key: [k[0]], "kept": [kept]})

    return events.select(key, F.col(order).cast("long").alias(order)).groupBy(key).applyInPandasWithState(run, f"{key} {kind}, kept array<bigint>", "kept array<bigint>", "update", GroupStateTimeout.NoTimeout)


def rechunk(frames: DataFrame, key: str, order: str, values: str, size: int) -> DataFrame:
    """Append mode: (key, chunk) of exactly size values; the remainder waits for the next batch. Batches of a key come in order."""
    kind = frames.schema[key].dataType.simpleString()

    def run(k: tuple, parts: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest = list(state.get[0]) if state.exists else []
        rows = pd.concat(list(parts)).sort_values(order)
        for v in rows[values]:
            rest.extend(float(x) for x in v)
        whole = len(rest) // size
        state.update((rest[whole * size :],))
        yield pd.DataFrame({key: [k[0]] * whole, "chunk": [rest[i * size : (i + 1) * size] for i in range(whole)]})

    return frames.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, chunk array<double>", "rest array<double>", "append", GroupStateTimeout.NoTimeout)


def request_response(requests: DataFrame, responses: DataFrame, key: str, at: str, seconds: int, late: str = "1 minute") -> DataFrame:
    """Each request with its responses within the time; null once that time has passed without one."""
    r = requests.withWatermark(at, late).alias("r")
    a = responses.withWatermark(at, late).alias("a")
    on = F.expr(f"r.{key} = a.{key} AND a.{at} >= r.{at} AND a.{at} <= r.{at} + INTERVAL {seconds} SECONDS")
    return r.join(a, on, "left_outer").select(F.col("r.event_id").alias("request_id"), F.col("a.event_id").alias("response_id"))


def new_records(events: DataFrame, keys: list[str], at: str, within: str) -> DataFrame:
    """The first row of each key; a key may come again after the watermark has passed it."""
    return events.withWatermark(at, within).dropDuplicatesWithinWatermark(keys)


def windowed_counts(events: DataFrame, at: str, width: str, late: str, by: str) -> DataFrame:
    """Counts per window, final once the watermark has passed it; later rows are dropped."""
    return events.withWatermark(at, late).groupBy(F.window(at, width).alias("w"), by).agg(F.count("*").alias("n")).select("w.start", by, "n")


def on_change(events: DataFrame, notify: Callable[[DataFrame, int], None], checkpoint: str):
    """Call notify with each batch; the checkpoint lets a restarted query go on where it stopped."""
    return events.writeStream.foreachBatch(notify).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
