"""Turns as a stream and as its batch twin."""

from pyspark.sql import functions as F

from quillspark.operators.timeseries import SPEECH
from quillspark.streaming import streams, utterances

from .oracle import SF


def turns(machine, frames):
    turn, out = None, []
    for at, piece, stop in frames:
        turn, over = machine.step(turn, at * 1_000_000, piece, stop)
        out += over
    return turn, [(a // 1_000_000, b // 1_000_000, n, text, how) for a, b, n, text, how in out]


def test_phases():
    m = utterances.Machine(prefix=1, suffix=2, timeout_s=10)
    open_, over = turns(m, [(0, "x", True), (1, "a", False), (2, "b", True), (3, "y", False), (4, "z", False), (5, "p", False), (6, "q", False), (20, "p", False)])
    assert over == [(0, 4, 5, "a b", "complete"), (5, 6, 2, "q", "timeout")]
    assert open_.frames == 1 and open_.stopped < 0
    assert turns(utterances.Machine(0, 0, 10), [(0, "a", True), (1, None, True)])[1] == [(0, 0, 1, "a", "complete"), (1, 1, 1, "", "complete")]


def test_stream_agrees_with_batch(spark, tmp_path):
    """Files hold a user's frames in no order of time; two late files move the watermark past them all."""
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    utterances.with_rocksdb(spark)
    batch = spark.read.parquet(f"{SF}/events.parquet")
    args = ("user_id", "ts", "event_id", F.col("event_id"), F.col("event_type") == "purchase", SPEECH)
    for k in range(3):
        batch.where(F.col("event_id") % 3 == k).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = utterances.stream_utterances(streams.follow(spark, str(tmp_path / "in"), batch.schema, 1), *args, late="40 days")
    out = stream.writeStream.format("parquet").option("path", str(tmp_path / "out")).outputMode("append").option("checkpointLocation", str(tmp_path / "at"))
    try:
        out.trigger(availableNow=True).start().awaitTermination()
        found = spark.read.schema(utterances.OUT.format("long")).parquet
        assert found(str(tmp_path / "out")).count() == 0  # the watermark hasn't passed a frame
        for days in (80, 160):
            later = batch.limit(1).withColumns({"user_id": F.lit(-1).cast("long"), "ts": F.col("ts") + F.expr(f"INTERVAL {days} DAYS")})
            later.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        out.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
    got = [tuple(r) for r in found(str(tmp_path / "out")).where("key >= 0").collect()]
    want = [tuple(r) for r in utterances.utterances(batch, *args).collect()]
    assert sorted(got) == sorted(want) and len(want) > 100


def test_odd_frames(spark):
    rows = [(None, 1, "2024-01-01 00:00:00", "a", True), (None, 2, "2024-01-01 00:00:01", "b", None), (1, 3, None, "c", True), (1, 4, "2024-01-01 00:00:00", None, True)]
    df = spark.createDataFrame(rows, "k long, n long, at string, piece string, stop boolean").withColumn("at", F.to_timestamp("at"))
    got = utterances.utterances(df, "k", "at", "n", F.col("piece"), F.col("stop"), utterances.Machine(0, 1, 5))
    assert sorted((r.key is None, r.frames, r.text, r.outcome) for r in got.collect()) == [(False, 1, "", "timeout"), (True, 2, "a", "complete")]
    assert utterances.utterances(df.limit(0), "k", "at", "n", F.col("piece"), F.col("stop"), SPEECH).collect() == []
