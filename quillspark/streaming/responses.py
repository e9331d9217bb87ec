"""First responses as a stream: each request with the first response of its key in time, or null when time is up.

Rows wait in state until the watermark has passed them and are then taken in order of their time, so batches may hold them
in any order and the result is that of the batch operator. Open requests wait in order; a response answers all that are
not too old for it, and an event-time timer ends the others. State is what the watermark hasn't passed and the open requests.
Streams need the RocksDB state store, see utterances.with_rocksdb. Rows without a key or a time are left out, as nothing can
answer them.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle


class FirstResponse(StatefulProcessor):
    def __init__(self, seconds: float) -> None:
        self.limit = int(seconds * 1e6)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getListState("waiting", "at long, response boolean, id string")
        self.open = handle.getListState("open", "at long, id string")

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:
        new = [(r.at, bool(r.response), r.id) for r in rows]
        if new:
            self.waiting.appendList(new)
            self.handle.registerTimer(min(r[0] for r in new) // 1000 + 1)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        passed = timerValues.getCurrentWatermarkInMs() * 1000
        rows, open_, out = sorted(tuple(r) for r in self.waiting.get()), [tuple(r) for r in self.open.get()], []
        later = [r for r in rows if r[0] > passed]
        for at, response, own in rows[: len(rows) - len(later)]:
            if not response:
                open_.append((at, own))
                continue
            out += [(i, own if at - asked <= self.limit else None) for asked, i in open_]
            open_ = []
        out += [(i, None) for asked, i in open_ if asked + self.limit < passed]
        open_ = [(asked, i) for asked, i in open_ if asked + self.limit >= passed]
        for state, kept in ((self.waiting, later), (self.open, open_)):
            if kept:
                state.put(kept)
            else:
                state.clear()
        nexts = [r[0] for r in later[:1]] + [asked + self.limit for asked, _ in open_[:1]]
        if nexts:
            self.handle.registerTimer(min(nexts) // 1000 + 1)
        return iter([Row(request_id=i, response_id=j) for i, j in out])

    def close(self) -> None:
        pass


def first_responses(events: DataFrame, requests: str, responses: str, key: str, at: str, seconds: float, late: str = "1 minute", row_id: str = "event_id") -> DataFrame:
    """Append mode: (request_id, response_id). requests, responses: SQL conditions on one stream of both. A response at the
    time of its request counts."""
    kind = events.schema[row_id].dataType.simpleString()
    rows = events.where(f"({requests}) OR ({responses})").where(F.col(key).isNotNull() & F.col(at).isNotNull())
    rows = rows.select(
        F.col(key).alias("key"), F.unix_micros(F.col(at).cast("timestamp")).alias("at"), F.coalesce(F.expr(responses), F.lit(False)).alias("response"),
        F.col(row_id).cast("string").alias("id"), F.col(at).cast("timestamp").alias("ts"),
    ).withWatermark("ts", late)
    found = rows.groupBy("key").transformWithState(FirstResponse(seconds), "request_id string, response_id string", "Append", "EventTime")
    return found.select(*[F.col(c).cast(kind).alias(c) for c in found.columns])
