"""Readers with explicit schemas. Paths may be anything that Spark reads; no schema is inferred from data."""

from __future__ import annotations

import io
import wave
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

READERS = {".jsonl": ("json", {}), ".json": ("json", {}), ".csv": ("csv", {"header": True}), ".tsv": ("csv", {"header": True, "sep": "\t"}), ".txt": ("text", {}), ".parquet": ("parquet", {})}


def json_lines(spark: SparkSession, path: str, schema: str) -> tuple[DataFrame, DataFrame]:
    """(good rows, lines that aren't JSON objects of the schema)."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{schema}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("r"), "value")
    bad = F.col("r").isNull() | F.col("r._bad").isNotNull()
    return parsed.where(~bad).select("r.*").drop("_bad"), parsed.where(bad).select("value")


def by_suffix(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Read by the path's suffix; an unknown one is a ValueError."""
    end = next((s for s in READERS if path.rstrip("/").endswith(s)), None)
    if end is None:
        raise ValueError(f"no reader for {path}")
    kind, options = READERS[end]
    reader = spark.read.options(**options)
    return (reader.schema(schema) if schema else reader).format(kind).load(path)


def json_array(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A file that is one JSON array of records."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def latin_csv(spark: SparkSession, path: str, names: list[str]) -> DataFrame:
    schema = ", ".join(f"{n} string" for n in names)
    return spark.read.schema(schema).option("encoding", "ISO-8859-1").csv(path)


def listed(spark: SparkSession, path: str, suffixes: tuple[str, ...] = (".bin", ".jsonl", ".txt")) -> DataFrame:
    """(path, length, kind) of the files below path, kinds in the given order and names within them; none is an error."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    kind = F.coalesce(*[F.when(F.lower("path").endswith(s), i) for i, s in enumerate(suffixes)])
    out = files.withColumn("kind", kind).where("kind IS NOT NULL").orderBy("kind", "path")
    if out.isEmpty():
        raise FileNotFoundError(f"no {suffixes} below {path}")
    return out


def token_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, ids) of little-endian unsigned 16-bit files; files of odd length are skipped."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.bin").load(path).where("length % 2 = 0")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield pd.DataFrame({"path": batch["path"], "ids": [np.frombuffer(c, "<u2").astype(np.int32) for c in batch["content"]]})

    return files.select("path", "content").mapInPandas(run, "path string, ids array<int>")


def wave_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, sample_rate, samples) of 16-bit WAV files, channels averaged to one in -1..1."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.wav").load(path)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for name, content in zip(batch["path"], batch["content"], strict=True):
                with wave.open(io.BytesIO(content)) as w:
                    data = np.frombuffer(w.readframes(w.getnframes()), "<i2").reshape(-1, w.getnchannels())
                    rows.append((name, w.getframerate(), (data.mean(axis=1) / 32768).astype(np.float32)))
            yield pd.DataFrame(rows, columns=["path", "sample_rate", "samples"])

    return files.select("path", "content").mapInPandas(run, "path string, sample_rate int, samples array<float>")


def resample(samples: Column, rate: int, to: int) -> Column:
    """Linear interpolation from one rate to another."""
    @F.pandas_udf("array<float>")
    def run(signals: pd.Series) -> pd.Series:
        def one(y):
            x = np.asarray(y, dtype=np.float32)
            at = np.arange(int(len(x) * to / rate)) * (rate / to)
            return np.interp(at, np.arange(len(x)), x).astype(np.float32) if len(x) else x
        return signals.map(one, na_action="ignore")

    return run(samples)


def sessions(spark: SparkSession, path: str) -> DataFrame:
    """(path, messages) of JSON session files; a corrupt one has no messages."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    messages = F.from_json("value", "messages array<struct<role:string,content:string>>")["messages"]
    return files.select("path", F.coalesce(messages, F.expr("cast(array() as array<struct<role:string,content:string>>)")).alias("messages"))
