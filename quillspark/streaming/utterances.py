"""The state machine of spoken turns: prefix, listening, suffix, complete; as a stream and as its batch twin.

A turn takes up the first `prefix` frames of a key without hearing them, then hears frames until one that stops it, takes up
`suffix` more without hearing, and is complete; the next frame begins the next turn. A silence of more than `timeout_s`
seconds, in whatever phase, ends the turn as it is. Its text is the frames heard, the stopping one included.

The stream goes by event time: frames wait in state until the watermark has passed them and are then taken in order of their
time, so batches may hold them in any order. State is a key's waiting frames and its open turn; both go when a timer at the
end of the silence fires. Streams need the RocksDB state store, see `with_rocksdb`.

The machine is sequential, so a key's frames are taken by one task, as a stream within a batch: no group is held in memory.
Null keys are a key. Frames without a time are left out: they are at no place in the order.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple, dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

OUT = "key {}, began long, ended long, frames int, text string, outcome string"


def with_rocksdb(spark: SparkSession) -> None:
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


@dataclass
class Turn:
    """An open turn: frames taken up so far, and how many were when it was stopped (-1 while it isn't)."""

    began: int
    last: int
    frames: int = 0
    stopped: int = -1
    text: str = ""


@dataclass(frozen=True)
class Machine:
    prefix: int
    suffix: int
    timeout_s: float

    def ends(self, turn: Turn) -> int:
        """The time, in microseconds, after which a frame is too late for the turn."""
        return turn.last + int(self.timeout_s * 1e6)

    def close(self, turn: Turn, outcome: str) -> tuple:
        return turn.began, turn.last, turn.frames, turn.text.strip(), outcome

    def step(self, turn: Turn | None, at: int, piece: str | None, stop: bool) -> tuple[Turn | None, list[tuple]]:
        """The turn after a frame, and the turns that are over."""
        over = []
        if turn and at > self.ends(turn):
            over.append(self.close(turn, "timeout"))
            turn = None
        turn = turn or Turn(at, at)
        turn.frames, turn.last = turn.frames + 1, at
        if turn.stopped < 0 and turn.frames > self.prefix:
            turn.text += " " + (piece or "")
            if stop:
                turn.stopped = turn.frames
        if turn.stopped >= 0 and turn.frames - turn.stopped >= self.suffix:
            over.append(self.close(turn, "complete"))
            turn = None
        return turn, over


class Processor(StatefulProcessor):
    def __init__(self, machine: Machine) -> None:
        self.rules = machine

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.turn = handle.getValueState("turn", "began long, last long, frames int, stopped int, text string")
        self.waiting = handle.getListState("waiting", "at long, tie long, piece string, stop boolean")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, r.tie, r.piece, bool(r.stop)) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        frames = sorted(tuple(r) for r in self.waiting.get())
        later = [f for f in frames if f[0] > passed]
        turn, out = Turn(*self.turn.get()) if self.turn.exists() else None, []
        for at, _, piece, stop in frames[: len(frames) - len(later)]:
            turn, over = self.rules.step(turn, at, piece, stop)
            out += over
        if turn and self.rules.ends(turn) < passed:
            out.append(self.rules.close(turn, "timeout"))
            turn = None
        if later:
            self.waiting.put(later)
            self.handle.registerTimer(later[0][0] // 1000 + 1)
        else:
            self.waiting.clear()
        if turn:
            self.turn.update(astuple(turn))
            self.handle.registerTimer(self.rules.ends(turn) // 1000 + 1)
        else:
            self.turn.clear()
        return iter([Row(key=key[0], began=o[0], ended=o[1], frames=o[2], text=o[3], outcome=o[4]) for o in out])

    def close(self) -> None:
        pass


def _frames(df: DataFrame, key: str, at: str, tie: str, piece: Column, stop: Column) -> DataFrame:
    time = F.unix_micros(F.col(at).cast("timestamp"))
    return df.where(F.col(at).isNotNull()).select(F.col(key).alias("key"), time.alias("at"), F.col(tie).cast("long").alias("tie"), piece.cast("string").alias("piece"), F.coalesce(stop, F.lit(False)).alias("stop"), F.col(at).cast("timestamp").alias("ts"))


def stream_utterances(events: DataFrame, key: str, at: str, tie: str, piece: Column, stop: Column, machine: Machine, late: str = "1 minute") -> DataFrame:
    """Append mode: (key, began, ended, frames, text, outcome) of turns once the watermark has passed their end; times in
    microseconds. Rows later than the watermark are dropped."""
    rows = _frames(events, key, at, tie, piece, stop).withWatermark("ts", late)
    kind = events.schema[key].dataType.simpleString()
    return rows.groupBy("key").transformWithState(Processor(machine), OUT.format(kind), "Append", "EventTime")


def utterances(df: DataFrame, key: str, at: str, tie: str, piece: Column, stop: Column, machine: Machine) -> DataFrame:
    """The batch twin: the same columns, with turns that no silence has ended yet as timed out."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        names = ["key", "began", "ended", "frames", "text", "outcome"]
        own, turn = None, None
        for part in parts:
            out = []
            for r in part.itertuples(index=False):
                k = None if pd.isna(r.key) else r.key
                if own != (k,):
                    if turn:
                        out.append((own[0], *machine.close(turn, "timeout")))
                    own, turn = (k,), None
                turn, over = machine.step(turn, r.at, r.piece, r.stop)
                out += [(k, *o) for o in over]
            yield pd.DataFrame(out, columns=names)
        if turn:
            yield pd.DataFrame([(own[0], *machine.close(turn, "timeout"))], columns=names)

    rows = _frames(df, key, at, tie, piece, stop).drop("ts")
    rows = rows.repartition("key").sortWithinPartitions("key", "at", "tie", "piece", "stop")
    return rows.mapInPandas(run, OUT.format(df.schema[key].dataType.simpleString()))
