"""Baseline joins and accuracy metrics over a predictions table."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.functions import expr as X

CELL = ["dataset", "model", "horizon"]
BASELINE_KEYS = ["dataset", "horizon", "origin_date", "date"]


def with_baseline(
    predictions: DataFrame,
    baseline: str = "persistence",
    keys: Sequence[str] = BASELINE_KEYS,
    keep: Mapping[str, str] | None = None,
) -> DataFrame:
    """Every other model's rows with the baseline of the same keys; rows without one go.

    One shuffle of the predictions by the keys, which the baseline has once; no self-join.
    ``keep`` maps further baseline columns to output names.
    """
    extra = dict(keep or {})
    base = F.struct(F.col("y_pred").alias("y_base"), *[F.col(c).alias(n) for c, n in extra.items()])
    keyed = predictions.filter(reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in keys]))
    found = F.max(F.when(F.col("model") == baseline, base)).over(Window.partitionBy(*keys))
    return (
        keyed.withColumn("__base", found)
        .filter((F.col("model") != baseline) & F.col("__base").isNotNull())
        .select(*[c for c in predictions.columns], "__base.*")
    )


def error_table(predictions: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    return predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        X.rmse("y_true", "y_pred").alias("rmse"),
        X.mae("y_true", "y_pred").alias("mae"),
    )


def skill_matched(predictions: DataFrame, baseline: str = "persistence", on_zero: str = "null") -> DataFrame:
    """RMSE and MAE skill per cell over rows that the baseline also has."""
    return skill_of_matched(with_baseline(predictions, baseline), on_zero)


def skill_of_matched(matched: DataFrame, on_zero: str = "null") -> DataFrame:
    errors = matched.groupBy(*CELL).agg(
        F.count(F.lit(1)).alias("n_pairs"),
        X.rmse("y_true", "y_pred").alias("rmse"),
        X.rmse("y_true", "y_base").alias("rmse_base"),
        X.mae("y_true", "y_pred").alias("mae"),
        X.mae("y_true", "y_base").alias("mae_base"),
    )
    return errors.select(
        *CELL,
        "n_pairs",
        X.relative_skill("rmse", "rmse_base", on_zero).alias("skill"),
        X.relative_skill("mae", "mae_base", on_zero).alias("mae_skill"),
    )


def skill_unmatched(predictions: DataFrame, baseline: str = "persistence", on_zero: str = "null") -> DataFrame:
    """Skill against all baseline rows of (dataset, horizon); one pass over the errors per cell."""
    errors = error_table(predictions)
    base = errors.filter(F.col("model") == baseline).select(
        "dataset", "horizon", F.col("rmse").alias("rmse_base"), F.col("mae").alias("mae_base")
    )
    return (
        errors.filter(F.col("model") != baseline)
        .join(base, ["dataset", "horizon"])
        .select(
            *CELL,
            X.relative_skill("rmse", "rmse_base", on_zero).alias("skill"),
            X.relative_skill("mae", "mae_base", on_zero).alias("mae_skill"),
        )
    )


def metrics_by_horizon(matched: DataFrame, keys: Sequence[str] = ("model", "horizon"), base: str = "y_base") -> DataFrame:
    """Population variances; zero guards give 0."""
    sums = matched.groupBy(*keys).agg(
        X.rmse("y_true", "y_pred").alias("rmse"),
        X.rmse("y_true", base).alias("rmse_persistence"),
        F.var_pop("y_true").alias("var_obs"),
        F.var_pop("y_pred").alias("var_pred"),
    )
    ratio = X.variance_ratio(F.col("var_pred"), F.col("var_obs"), 0.0)
    return (
        sums.withColumn("skill", X.relative_skill("rmse", "rmse_persistence", "zero"))
        .withColumn("var_pct", F.lit(100.0) * ratio)
        .withColumn("skill_vp", F.col("skill") * F.col("var_pct") / 100.0)
    )


def metrics_reproduction(predictions: DataFrame, keys: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Sample variances and ``skill * min(1, ratio)``; the baseline is a column of the table."""
    sums = predictions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        X.rmse("y_true", "y_pred").alias("rmse"),
        X.rmse("y_true", "y_persistence").alias("rmse_persistence"),
        F.var_samp("y_true").alias("variance_observed"),
        F.var_samp("y_pred").alias("variance_predicted"),
    )
    ratio = X.divide("variance_predicted", "variance_observed")
    skill = F.lit(1.0) - X.divide("rmse", "rmse_persistence")
    return sums.select(
        "*",
        skill.alias("skill_rmse"),
        (F.lit(100.0) * ratio).alias("variance_retention_pct"),
        (skill * F.when(ratio.isNotNull(), F.least(F.lit(1.0), ratio))).alias("skill_vp"),
    )


def protocol_comparison(
    left: DataFrame,
    right: DataFrame,
    metrics: Sequence[str] = ("rmse", "skill", "var_pct", "skill_vp"),
    label: str = "rolling_origin_vs_holdout",
) -> DataFrame:
    """Absolute and percent difference of two protocols per model, horizon and metric."""
    names = [m for m in metrics if m in left.columns and m in right.columns]
    a = left.select("model", "horizon", *names).unpivot(["model", "horizon"], names, "metric", "ro_value")
    b = right.select("model", "horizon", *names).unpivot(["model", "horizon"], names, "metric", "ho_value")
    gap = F.abs(F.col("ho_value") - F.col("ro_value"))
    return (
        a.join(b, ["model", "horizon", "metric"])
        .filter(F.col("ro_value").isNotNull() & F.col("ho_value").isNotNull())
        .select(
            F.lit(label).alias("protocol"), "model", "horizon", "metric", "ro_value", "ho_value",
            gap.alias("diff_absolute"),
            F.coalesce(X.divide(F.lit(100.0) * gap, F.abs("ro_value")), F.lit(0.0)).alias("diff_pct"),
        )
    )


def describe_by(df: DataFrame, key: str, value: str) -> DataFrame:
    """Count, mean, sample SD and quartiles of a column per group (a metric table)."""
    return df.groupBy(key).agg(
        F.count(value).alias("count"),
        F.avg(value).alias("mean"),
        F.stddev_samp(value).alias("std"),
        F.min(value).alias("min"),
        F.percentile(value, F.lit(0.25)).alias("q25"),
        F.percentile(value, F.lit(0.5)).alias("q50"),
        F.percentile(value, F.lit(0.75)).alias("q75"),
        F.max(value).alias("max"),
    )


DEFAULT_DECIMALS = {"rmse": 4, "skill": 4, "var_pct": 2, "skill_vp": 4, "recall": 4}


def canonical_wide_table(
    metrics: DataFrame, events: DataFrame, models: Sequence[str], decimals: Mapping[str, int] | None = None
) -> DataFrame:
    """One row per horizon with prefixed columns per model and events at P75 and P90."""
    places = {**DEFAULT_DECIMALS, **(decimals or {})}
    first = F.col("model") == F.lit(sorted(models)[0])

    def pick(condition, column, digits):
        return F.round(F.max(F.when(condition, F.col(column))), digits)

    wide = metrics.groupBy("horizon").agg(
        pick(first, "rmse_persistence", places["rmse"]).alias("rmse_persistence"),
        pick(first, "var_obs", places["rmse"]).alias("var_obs"),
        *[
            pick(F.col("model") == m, c, places[c]).alias(f"{m}_{c}")
            for m in models
            for c in ("rmse", "skill", "var_pct", "skill_vp")
        ],
    )
    wanted = [(75, "recall_events", "recall"), (75, "precision_events", "precision"), (75, "flag_rate", "flag_rate"),
              (90, "recall_events", "recall"), (90, "precision_events", "precision")]
    tall = events.groupBy("horizon").agg(
        *[
            pick((F.col("model") == m) & (F.col("threshold") == p), c, places["recall"]).alias(f"{m}_{name}_p{p}")
            for m in models
            for p, c, name in wanted
        ]
    )
    return wide.join(tall, "horizon", "left")
