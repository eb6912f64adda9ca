"""Table sinks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame


def write_table(df: DataFrame, path: str, partition_by: Sequence[str] = (), mode: str = "overwrite") -> str:
    """Parquet, or CSV with a header when the path ends in .csv; returns the path."""
    writer = df.write.mode(mode)
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if path.rstrip("/").lower().endswith(".csv"):
        writer.option("header", True).csv(path)
    else:
        writer.parquet(path)
    return path


def write_predictions(df: DataFrame, path: str, files_per_dataset: int = 8) -> str:
    """Predictions by dataset folder; a large dataset is spread over several writers."""
    from pyspark.sql import functions as F

    salt = F.pmod(F.xxhash64("model", "horizon", "origin_date"), F.lit(files_per_dataset))
    return write_table(df.repartition("dataset", salt), path, ["dataset"])
