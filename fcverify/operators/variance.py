"""Variance retention (alpha), its flags, confidence intervals and counts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.quantiles import grouped_percentile
from fcverify.operators.metrics import CELL

SUMMARY_COLUMNS = [
    "dataset", "model", "horizon", "n", "skill", "mae_skill", "alpha", "alpha_ci_low", "alpha_ci_high",
    "skill_vp", "collapse_flag", "inflation_flag", "near_ideal_flag", "low_sample_flag",
]
COLLAPSE, INFLATION, IDEAL, MIN_N = 0.5, 1.5, (0.8, 1.2), 30


def alpha_table(predictions: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return predictions.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), X.alpha().alias("alpha"))


def add_flags(df: DataFrame) -> DataFrame:
    a = F.col("alpha")
    return df.withColumns(
        {
            "skill_vp": X.skill_vp("skill", "alpha"),
            "collapse_flag": X.truth(a < COLLAPSE),
            "inflation_flag": X.truth(a > INFLATION),
            "near_ideal_flag": X.truth((F.col("skill") > 0) & a.between(*IDEAL)),
            "low_sample_flag": X.truth(F.col("n") < MIN_N),
        }
    )


def variance_retention_summary(predictions: DataFrame, skill: DataFrame, ci: DataFrame | None = None) -> DataFrame:
    """One row per cell in the fixed column order; ``ci`` comes from ``bootstrap_alpha_ci``."""
    cells = alpha_table(predictions)
    if ci is None:
        empty = F.lit(None).cast("double")
        cells = cells.withColumns({"alpha_ci_low": empty, "alpha_ci_high": empty})
    else:
        cells = cells.join(ci, CELL, "left")
    extra = skill if "mae_skill" in skill.columns else skill.withColumn("mae_skill", F.lit(None).cast("double"))
    return add_flags(cells.join(extra.select(*CELL, "skill", "mae_skill"), CELL)).select(*SUMMARY_COLUMNS)


# ---- bootstrap -------------------------------------------------------------

# Cumulative Poisson(1) probabilities; the tail beyond is below the resolution of a double.
POISSON_STEPS = np.cumsum(np.exp(-1.0) / np.cumprod(np.maximum(np.arange(21.0), 1.0)))


def _mix(x: np.ndarray) -> np.ndarray:
    """64-bit finaliser: uniform bits from structured keys."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def poisson_weights(row_keys: np.ndarray, replicas: np.ndarray, seed: int) -> np.ndarray:
    """Poisson(1) weights (rows x replicas), a pure function of row key, replica and seed."""
    with np.errstate(over="ignore"):
        salt = _mix(replicas.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(seed))
        bits = _mix(row_keys.astype(np.int64).view(np.uint64)[:, None] ^ salt[None, :])
    uniform = (bits >> np.uint64(11)).astype(np.float64) / float(1 << 53)
    return np.searchsorted(POISSON_STEPS, uniform, side="right").astype(np.float64)


def _partial_moments(n_boot: int, seed: int):
    """Per task: weighted moments of every replica for each run of rows of one cell.

    Rows arrive sorted by cell, so one accumulator of ``n_boot`` rows is alive at a
    time and a cell leaves the task as ``n_boot`` rows however many rows it has.
    """
    replicas = np.arange(n_boot, dtype=np.int64)

    def emit(cell, totals):
        frame = pd.DataFrame(totals, columns=["w", "wt", "wtt", "wp", "wpp"])
        frame.insert(0, "replica", replicas)
        for name, value in zip(reversed(CELL), reversed(cell)):
            frame.insert(0, name, value)
        return frame

    def run(batches):
        current, totals = None, None
        for batch in batches:
            for cell, rows in batch.groupby(CELL, sort=False):
                if cell != current:
                    if current is not None:
                        yield emit(current, totals)
                    current, totals = cell, np.zeros((n_boot, 5))
                t, p = rows["t"].to_numpy(float), rows["p"].to_numpy(float)
                parts = np.column_stack([np.ones(len(t)), t, t * t, p, p * p])
                keys = rows["row_key"].to_numpy()
                for start in range(0, len(t), 2048):
                    piece = slice(start, start + 2048)
                    totals += poisson_weights(keys[piece], replicas, seed).T @ parts[piece]
        if current is not None:
            yield emit(current, totals)

    return run


def bootstrap_alpha_ci(
    predictions: DataFrame,
    n_boot: int = 1000,
    ci: float = 0.95,
    seed: int = 42,
    row_key: Sequence[str] = ("dataset", "model", "horizon", "origin_date", "date"),
) -> DataFrame:
    """Percentile interval of alpha per cell.

    Every row is weighted independently from a hash of its key, so the result does
    not depend on partitioning and one cell may span many tasks.
    """
    means = predictions.groupBy(*CELL).agg(F.avg("y_true").alias("__mt"), F.avg("y_pred").alias("__mp"))
    centred = predictions.join(means, CELL).select(
        *CELL,
        (F.col("y_true") - F.col("__mt")).alias("t"),
        (F.col("y_pred") - F.col("__mp")).alias("p"),
        F.xxhash64(*row_key).alias("row_key"),
    )
    schema = "dataset string, model string, horizon int, replica long, w double, wt double, wtt double, wp double, wpp double"
    partial = centred.withColumn("horizon", F.col("horizon").cast("int")).sortWithinPartitions(*CELL).mapInPandas(
        _partial_moments(n_boot, seed), schema
    )
    sums = partial.groupBy(*CELL, "replica").agg(*[F.sum(c).alias(c) for c in ("w", "wt", "wtt", "wp", "wpp")])

    def var(total, squares):
        return X.divide(F.col(squares), F.col("w")) - X.square(X.divide(F.col(total), F.col("w")))

    vt, vp = var("wt", "wtt"), var("wp", "wpp")
    alphas = sums.withColumn("alpha", F.when(vt > 0, X.divide(F.greatest(vp, F.lit(0.0)), vt)).otherwise(0.0))
    lo, hi = (1 - ci) / 2, (1 + ci) / 2
    return grouped_percentile(alphas, CELL, "alpha", {"alpha_ci_low": lo, "alpha_ci_high": hi})


# ---- counts over the summary ----------------------------------------------


def membership(groups: Mapping[str, Sequence[str]]) -> Column:
    """Names of the (overlapping) groups a model belongs to, as an array column."""
    hits = [F.when(F.col("model").isin(*models), F.lit(name)) for name, models in groups.items()]
    return F.array_compact(F.array(*hits))


def threshold_sensitivity(cells: DataFrame, thresholds: Sequence[float] = (0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """Collapsed cells per threshold and model."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    return (
        cells.select("model", "alpha", F.explode(limits).alias("threshold"))
        .groupBy("threshold", "model")
        .agg(F.count(F.lit(1)).alias("total_cells"), F.count_if(F.col("alpha") < F.col("threshold")).alias("collapsed_cells"))
        .withColumn("collapse_rate_pct", X.percent(F.col("collapsed_cells"), F.col("total_cells"), None))
    )


def group_collapse_rates(cells: DataFrame, groups: Mapping[str, Sequence[str]], thresholds: Sequence[float] = (0.4, 0.5, 0.6)) -> DataFrame:
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    return (
        cells.select("alpha", F.explode(membership(groups)).alias("group"))
        .select("alpha", "group", F.explode(limits).alias("threshold"))
        .groupBy("threshold", "group")
        .agg(F.count_if(F.col("alpha") < F.col("threshold")).alias("collapsed_cells"), F.count(F.lit(1)).alias("total_cells"))
        .withColumn("collapse_rate_pct", X.percent(F.col("collapsed_cells"), F.col("total_cells")))
    )


def ci_position_counts(
    cells: DataFrame, groups: Mapping[str, Sequence[str]], thresholds: Sequence[float] = (0.5,)
) -> DataFrame:
    """Intervals below, across and above each threshold per model group."""
    limits = F.array(*[F.lit(float(t)) for t in thresholds])
    lo, hi, t = F.col("alpha_ci_low"), F.col("alpha_ci_high"), F.col("threshold")
    names = ["ci_high_below_threshold", "ci_crosses_threshold", "ci_low_above_threshold"]
    counts = (
        cells.select("alpha_ci_low", "alpha_ci_high", F.explode(membership(groups)).alias("section"))
        .select("*", F.explode(limits).alias("threshold"))
        .groupBy("section", "threshold")
        .agg(
            F.count_if(hi < t).alias(names[0]),
            F.count_if((lo <= t) & (t <= hi)).alias(names[1]),
            F.count_if(lo > t).alias(names[2]),
            F.count(F.lit(1)).alias("total"),
        )
    )
    return counts.unpivot(["section", "threshold", "total"], names, "category", "count").withColumn(
        "percentage", X.percent(F.col("count"), F.col("total"))
    )


CELL_VIEW = ["station_name", "station_id", "model", "horizon", "alpha", "alpha_ci_low", "alpha_ci_high"]


def crossing_cells(cells: DataFrame, threshold: float = COLLAPSE, models: Sequence[str] | None = None) -> DataFrame:
    rows = cells if models is None else cells.filter(F.col("model").isin(*models))
    hit = (F.col("alpha_ci_low") <= threshold) & (F.col("alpha_ci_high") >= threshold)
    return rows.filter(hit).select(*[c for c in CELL_VIEW if c in cells.columns])


def noncollapsed_exceptions(cells: DataFrame, models: Sequence[str], threshold: float = COLLAPSE) -> DataFrame:
    hit = F.col("model").isin(*models) & (F.col("alpha") >= threshold)
    return cells.filter(hit).select(*[c for c in CELL_VIEW if c in cells.columns])


def station_collapse_rates(
    cells: DataFrame, keys: Sequence[str] = ("dataset",), models: Sequence[str] | None = None, expected_total: int | None = None
) -> DataFrame:
    rows = cells if models is None else cells.filter(F.col("model").isin(*models))
    counts = rows.groupBy(*keys).agg(
        F.count_if("collapse_flag").alias("collapsed"), F.count(F.lit(1)).alias("total")
    )
    if expected_total is not None:
        counts = counts.withColumn("total_ok", F.col("total") == expected_total)
    return counts.withColumn("collapse_rate_pct", X.percent(F.col("collapsed"), F.col("total")))


def rollup_counts(cells: DataFrame, groups: Mapping[str, Sequence[str]]) -> DataFrame:
    """Per model and per overlapping group: collapsed and total cells, and flags that disagree with alpha."""
    own = F.array(F.concat(F.lit("model:"), F.col("model")))
    labels = F.concat(own, F.transform(membership(groups), lambda g: F.concat(F.lit("group:"), g)))
    wrong = F.col("collapse_flag") != (F.col("alpha") < COLLAPSE)
    return (
        cells.select(F.explode(labels).alias("label"), "collapse_flag", "alpha")
        .groupBy("label")
        .agg(
            F.count_if("collapse_flag").alias("collapsed"),
            F.count(F.lit(1)).alias("total"),
            F.count_if(wrong).alias("flag_mismatches"),
        )
    )


def desirable_cells(summary: DataFrame, model: str = "sarima", min_alpha: float = 0.8) -> DataFrame:
    return summary.filter((F.col("model") == model) & (F.col("skill") > 0) & (F.col("alpha") >= min_alpha)).select(
        *CELL, "skill", "alpha"
    )


def model_summary(summary: DataFrame) -> DataFrame:
    stats = [
        f(c).alias(f"{c}_{name}")
        for c in ("skill", "alpha", "skill_vp")
        for name, f in (("mean", F.avg), ("min", F.min), ("max", F.max))
    ]
    flags = ("collapse_flag", "inflation_flag", "near_ideal_flag", "low_sample_flag")
    return summary.groupBy("model").agg(*stats, *[F.count_if(c).alias(f"{c}_n") for c in flags], F.min("n").alias("min_n"))


def run_profile(predictions: DataFrame) -> DataFrame:
    """One row that describes a predictions table; sizes per cell are counted first."""
    sizes = predictions.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n"), F.min("date").alias("lo"), F.max("date").alias("hi"),
        F.count_if(F.col("y_pred").isNull()).alias("missing"),
    )
    return sizes.agg(
        F.sum("n").alias("n_rows"),
        F.countDistinct("dataset").alias("n_datasets"),
        F.countDistinct("model").alias("n_models"),
        F.countDistinct("horizon").alias("n_horizons"),
        F.min("horizon").alias("min_horizon"),
        F.max("horizon").alias("max_horizon"),
        F.min("lo").alias("first_date"),
        F.max("hi").alias("last_date"),
        F.min("n").alias("min_cell_rows"),
        F.count_if(F.col("n") < MIN_N).alias("low_sample_cells"),
        F.sum("missing").alias("missing_predictions"),
    )


def concentration_scale(
    predictions: DataFrame, models: Sequence[str], horizons: Sequence[int] = (1, 7), dimension: DataFrame | None = None
) -> DataFrame:
    """Observed and predicted spread per dataset in the units of the series."""
    days = predictions.groupBy("dataset", "date").agg(F.first("y_true", ignorenulls=True).alias("y"))
    seen = days.groupBy("dataset").agg(F.avg("y").alias("obs_mean_ug"), F.stddev_pop("y").alias("obs_std_ug"))
    spread = predictions.groupBy("dataset").agg(
        *[
            F.stddev_pop(F.when((F.col("model") == m) & (F.col("horizon") == h), F.col("y_pred"))).alias(f"pred_std_{m}_h{h}")
            for m in models
            for h in horizons
        ]
    )
    out = seen.join(spread, "dataset").withColumn("observed_range_ug", F.lit(2.0) * F.col("obs_std_ug"))
    for m in models:
        for h in horizons:
            sd = F.col(f"pred_std_{m}_h{h}")
            out = out.withColumn(f"predicted_range_{m}_h{h}_ug", F.lit(2.0) * sd).withColumn(
                f"alpha_{m}_h{h}", F.when(F.col("obs_std_ug") > 0, X.square(X.divide(sd, "obs_std_ug")))
            )
    return out if dimension is None else out.join(dimension, "dataset", "left")
