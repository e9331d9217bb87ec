"""Writers: splits, chunk files, shuffled shards and one-row reports."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillspark.operators import corpus


def write_splits(df: DataFrame, path: str, split: str = "split") -> None:
    """JSON lines, a folder per split; an existing output is left as it is."""
    df.write.mode("ignore").partitionBy(split).json(path)


def write_chunks(df: DataFrame, path: str, id_col: str, size: int) -> None:
    """A folder per size rows in the order of id_col."""
    corpus.chunk_numbers(df, id_col, size).repartition("chunk").sortWithinPartitions(id_col).write.partitionBy("chunk").json(path)


def write_shuffled(df: DataFrame, path: str, key: str, shards: int, seed: str) -> None:
    """Shards dealt and ordered by the seeded hash of a key."""
    order = F.md5(F.concat(F.lit(seed), F.col(key).cast("string")).cast("binary"))
    rows = df.withColumns({"shard": corpus.bucket(F.col(key), shards, seed), "_order": order})
    rows.repartition("shard").sortWithinPartitions("shard", "_order", key).drop("_order").write.partitionBy("shard").json(path)


def write_report(df: DataFrame, path: str) -> None:
    """A document of few rows as one JSON file."""
    df.coalesce(1).write.mode("overwrite").json(path)
