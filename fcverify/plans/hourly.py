"""Hourly evaluation on expanding folds or a holdout, positions on a dense grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.scan import CHUNK, running
from fcverify.operators import events, forecast, series, splits
from fcverify.session import settle

HORIZONS = (1, 6, 24, 48)


def prepared(hourly: DataFrame, chunk: int = CHUNK) -> DataFrame:
    """Dense grid with position, causal fill and the running mean of observations.

    Written out once: bounds, thresholds, targets and covariates all read it.
    """
    grid = series.grid_position(series.densify(hourly))
    seen = F.when(F.col("y").isNotNull(), F.lit(1))
    grown = running(grid, series.KEYS, ["idx"], sums={"__s": F.col("y"), "__c": seen}, lasts={"y_causal": F.col("y")}, chunk=chunk)
    return settle(grown.withColumn("mean_y", X.divide("__s", "__c")).drop("__s", "__c"))


def lengths(grid: DataFrame) -> DataFrame:
    return grid.groupBy("dataset").agg(F.max("n_rows").alias("n_rows"))


def fold_bounds(grid: DataFrame, protocol: str = "rolling_origin") -> DataFrame:
    if protocol == "rolling_origin":
        return splits.expanding_folds(lengths(grid))
    if protocol == "holdout":
        return splits.holdout_split(lengths(grid))
    raise ValueError(f"unknown protocol: {protocol}")


def targets(grid: DataFrame, horizons: Sequence[int] = HORIZONS, chunk: int = CHUNK) -> DataFrame:
    """Long over horizons: ``target, target_time`` for each grid row."""
    long = series.add_targets(grid, horizons, chunk)
    return long.withColumnRenamed("target_date", "target_time")


def test_rows(grid: DataFrame, protocol: str = "rolling_origin", horizons: Sequence[int] = HORIZONS, chunk: int = CHUNK) -> DataFrame:
    """Test origins of every fold with an observed target and a usable origin value."""
    long = targets(grid, horizons, chunk).filter(F.col("target").isNotNull() & F.col("y_causal").isNotNull())
    return splits.fold_membership(long, fold_bounds(grid, protocol)).filter(F.col("role") == "test")


def hourly_predictions(
    grid: DataFrame, protocol: str = "rolling_origin", horizons: Sequence[int] = HORIZONS, chunk: int = CHUNK
) -> DataFrame:
    """Contrast forecasts in the hourly contract, baseline and training threshold attached."""
    rows = test_rows(grid, protocol, horizons, chunk)
    y, mean = F.col("y_causal"), F.col("mean_y")
    fan = F.explode(
        F.array(
            *[
                F.struct(F.lit(n).alias("model"), c.alias("y_pred"))
                for n, c in (
                    ("smooth", F.lit(0.3) * y + F.lit(0.7) * mean),
                    ("amplified", mean + F.lit(1.5) * (y - mean)),
                )
            ]
        )
    )
    long = rows.select(
        "dataset", "fold", "pos", F.col("ts").alias("origin_time"), "target_time", "horizon",
        F.col("target").alias("y_true"), y.alias("y_persistence"), fan.alias("m"),
    ).select("*", "m.*").drop("m")
    limits = events.train_thresholds(grid, fold_bounds(grid, protocol), {"p75_train": 0.75})
    return long.join(limits, ["dataset", "fold"]).withColumn("protocol", F.lit(protocol))


def positional(predictions: DataFrame, baseline: str = "persistence") -> DataFrame:
    """The hourly contract as positional rows with the baseline as a model of its own."""
    fan = F.array(
        F.struct(F.col("model").alias("model"), F.col("y_pred").alias("y_pred")),
        F.struct(F.lit(baseline).alias("model"), F.col("y_persistence").alias("y_pred")),
    )
    keys = ["dataset", "fold", "pos", "horizon"]
    return (
        predictions.select(*keys, F.explode(fan).alias("m"))
        .select(*keys, "m.*")
        .groupBy(*keys, "model")
        .agg(F.first("y_pred").alias("y_pred"))
    )


def boosted_samples(grid: DataFrame, protocol: str = "rolling_origin", horizons: Sequence[int] = HORIZONS, chunk: int = 4 * CHUNK) -> DataFrame:
    """Complete feature rows with target, fold and role for the boosted models."""
    featured = forecast.hourly_features(grid, chunk=chunk)
    long = series.add_cyclic_target_time(targets(featured, horizons, chunk))
    complete = series.complete_cases(long, [*forecast.feature_names(), "target"])
    return splits.fold_membership(complete, fold_bounds(grid, protocol))


