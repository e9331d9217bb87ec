"""Steps with dependencies: layers in order, and a runner that evaluates them as lazy DataFrames."""

from __future__ import annotations

import threading
import uuid
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor

from pyspark.errors import AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException
from pyspark.sql import DataFrame, SparkSession


def layers(steps: list[str], edges: list[tuple[str, str]]) -> list[list[str]]:
    """Steps in layers, each after all it depends on. Unknown ends are ignored; a cycle is a ValueError."""
    known = set(steps)
    needs = {s: {a for a, b in edges if b == s and a in known and a != s} for s in steps}
    out: list[list[str]] = []
    while needs:
        ready = sorted(s for s, n in needs.items() if not n)
        if not ready:
            raise ValueError(f"cycle among {sorted(needs)}")
        out.append(ready)
        needs = {s: n - set(ready) for s, n in needs.items() if s not in ready}
    return out


def holds(spark: SparkSession, condition: str | None, values: dict) -> bool:
    """A SQL condition over named values; none, or one that can't be evaluated, holds. Failures of Spark itself are raised."""
    if not condition:
        return True
    try:
        row = spark.createDataFrame([tuple(values.values())], list(values)) if values else spark.range(1)
        return bool(row.selectExpr(f"({condition}) AS ok").first()["ok"])
    except (AnalysisException, ArithmeticException, ArrayIndexOutOfBoundsException, DateTimeException, NumberFormatException):
        return True  # a broken condition doesn't stop its step


class _Deadline:
    """While a step runs in this thread, its jobs have a tag of their own; once time is up they are cancelled by it, those that
    the step starts afterwards too."""

    def __init__(self, spark: SparkSession, name: str, seconds: float | None) -> None:
        self.context, self.tag, self.seconds = spark.sparkContext, f"{name}-{uuid.uuid4().hex}", seconds
        self.over, self.late = threading.Event(), False

    def _watch(self) -> None:
        if not self.over.wait(self.seconds):
            self.late = True
            while not self.over.wait(0.2):
                self.context.cancelJobsWithTag(self.tag)

    def __enter__(self) -> _Deadline:
        self.context.addJobTag(self.tag)
        self.watcher = threading.Thread(target=self._watch, daemon=True)
        if self.seconds is not None:
            self.watcher.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.context.removeJobTag(self.tag)
        if self.seconds is not None:
            self.watcher.join()


def run(
    steps: dict[str, Callable[[dict[str, DataFrame]], DataFrame]], edges: list[tuple[str, str]], finish: Callable[[str, DataFrame], DataFrame],
    retries: int = 0, timeout_s: float | dict[str, float] | None = None, spark: SparkSession | None = None,
) -> dict[str, DataFrame]:
    """Build each step from the results so far and finish it (write, cache or nothing), a layer's steps at once.

    A step that fails is tried again, as often as retries says. timeout_s, of all steps or by name: seconds for one try;
    after these the try's Spark jobs, and no other step's, are cancelled, and the try counts as failed by TimeoutError. What a
    step does in the driver besides its jobs isn't interrupted."""
    done: dict[str, DataFrame] = {}
    session = spark or SparkSession.getActiveSession()

    def one(name: str) -> tuple[str, DataFrame]:
        seconds = timeout_s.get(name) if isinstance(timeout_s, dict) else timeout_s
        for k in range(retries + 1):
            deadline = _Deadline(session, name, seconds)
            try:
                with deadline:
                    out = finish(name, steps[name](done))
                if deadline.late:
                    raise TimeoutError(f"{name}: more than {seconds} s")
                return name, out
            except Exception as failed:
                if k == retries:
                    if deadline.late and not isinstance(failed, TimeoutError):
                        raise TimeoutError(f"{name}: more than {seconds} s") from failed
                    raise
        raise AssertionError

    for layer in layers(list(steps), edges):
        with ThreadPoolExecutor(max(1, len(layer))) as pool:
            done |= dict(list(pool.map(one, layer)))
    return done
