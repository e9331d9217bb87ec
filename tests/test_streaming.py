from pyspark.sql import functions as F

from quillspark.operators import stores
from quillspark.streaming import streams

SF = "/root/testdata/sf0.001"


def drain(df, tmp_path, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
    q.awaitTermination()
    return df.sparkSession.table(name)


def events(spark, tmp_path, parts=3):
    batch = spark.read.parquet(f"{SF}/events.parquet")
    for k in range(parts):
        batch.where(F.col("event_id") % parts == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return batch, streams.follow(spark, str(tmp_path / "in"), batch.schema, 1)


def test_ring_buffer_is_the_batch_operator(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    out = drain(streams.ring_buffer(stream, "user_id", "event_id", 5), tmp_path, "ring", "update")
    last = {}
    for r in out.collect():
        last[r["user_id"]] = max(last.get(r["user_id"], []), sorted(r["kept"]), key=lambda x: (len(x), x))
    want = {}
    for r in stores.newest_per_key(batch, ["user_id"], ["event_id"], 5).collect():
        want.setdefault(r["user_id"], []).append(r["event_id"])
    assert last == {k: sorted(v) for k, v in want.items()}


def test_new_records_and_subscription(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    out = drain(streams.new_records(streams.subscribe(stream, "event_type", "click"), ["user_id"], "ts", "365 days"), tmp_path, "fresh", "append")
    assert out.count() == batch.where("event_type = 'click'").select("user_id").distinct().count()


def test_windowed_counts_close(spark, tmp_path):
    batch, stream = events(spark, tmp_path, 1)
    out = drain(streams.windowed_counts(stream, "ts", "1 day", "0 seconds", "event_type"), tmp_path, "win", "append")
    days = batch.select(F.to_date("ts").alias("d")).distinct().count()
    assert out.select("start").distinct().count() in (days - 1, days)


def test_request_response(spark, tmp_path):
    batch, stream = events(spark, tmp_path, 1)
    _, again = batch, streams.follow(spark, str(tmp_path / "in"), batch.schema, 1)
    out = drain(streams.request_response(stream.where("event_type = 'signup'"), again.where("event_type = 'purchase'"), "user_id", "ts", 3600), tmp_path, "pairs", "append")
    hit = batch.alias("r").join(batch.alias("a"), F.expr("r.event_type = 'signup' AND a.event_type = 'purchase' AND r.user_id = a.user_id AND a.ts BETWEEN r.ts AND r.ts + INTERVAL 1 HOUR"))
    assert out.where("response_id IS NOT NULL").count() == hit.count()


def test_rechunk_carries_the_rest(spark, tmp_path):
    rows = spark.range(10).select((F.col("id") % 2).alias("k"), "id", F.transform(F.sequence(F.lit(0), F.lit(2)), lambda i: (F.col("id") * 3 + i).cast("double")).alias("v"))
    rows.coalesce(1).write.parquet(str(tmp_path / "in"))
    out = drain(streams.rechunk(streams.follow(spark, str(tmp_path / "in"), rows.schema), "k", "id", "v", 4), tmp_path, "chunks", "append")
    assert sorted(len(r["chunk"]) for r in out.collect()) == [4] * 6
    seen = []
    streams.on_change(streams.follow(spark, str(tmp_path / "in"), rows.schema), lambda df, _: seen.append(df.count()), str(tmp_path / "notify")).awaitTermination()
    assert sum(seen) == 10


def test_replay_then_live(spark, tmp_path):
    batch, stream = events(spark, tmp_path)
    last = batch.where("event_id % 400 = 0").select("user_id", "event_id")
    out = drain(streams.replay_then_live(stream, "user_id", "event_id", last).select("event_id"), tmp_path, "replayed", "append")
    want = stores.replay_after(batch, "user_id", ["event_id"], last.groupBy("user_id").agg(F.max("event_id").alias("event_id")))
    assert sorted(r[0] for r in out.collect()) == sorted(r["event_id"] for r in want.collect())


def test_heartbeats_of_silent_keys(spark, tmp_path):
    import time

    batch, stream = events(spark, tmp_path, 1)
    few = streams.with_heartbeats(stream.where("user_id < 3"), "user_id", "event_type", 1)
    q = few.writeStream.format("memory").queryName("beats").outputMode("append").option("checkpointLocation", str(tmp_path / "beats")).trigger(processingTime="1 second").start()
    try:
        until = time.time() + 90
        while time.time() < until and spark.table("beats").where("kind = 'heartbeat'").select("user_id").distinct().count() < 2:
            time.sleep(1)
    finally:
        q.stop()
    rows = spark.table("beats")
    assert rows.where("kind = 'event'").count() == batch.where("user_id < 3").count()
    assert {r["user_id"] for r in rows.where("kind = 'heartbeat'").collect()} >= {r["user_id"] for r in batch.where("user_id < 3").select("user_id").distinct().limit(1).collect()}
