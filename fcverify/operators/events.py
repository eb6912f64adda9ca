"""Exceedance-event verification."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.expanding import expanding_percentile
from fcverify.functions.quantiles import grouped_percentile
from fcverify.functions.scan import CHUNK, asof_join
from fcverify.operators.metrics import CELL
from fcverify.operators.series import day_index
from fcverify.operators.splits import training_rows


def event_aggregates(threshold: Column | str, y: str = "y_true", p: str = "y_pred") -> list[Column]:
    t = X.col(threshold)
    seen, flagged = F.col(y) > t, F.col(p) > t
    return [
        F.count(F.lit(1)).alias("n"),
        F.count_if(seen & flagged).alias("tp"),
        F.count_if(seen & X.truth(~flagged)).alias("fn"),
        F.count_if(X.truth(~seen) & flagged).alias("fp"),
    ]


def add_event_scores(df: DataFrame, zero_division: float | None = None) -> DataFrame:
    """recall, precision, f1, flag_rate and base_rate from ``n, tp, fn, fp``.

    ``zero_division`` None leaves undefined scores NULL; 0.0 makes them zero.
    """
    def fill(c: Column) -> Column:
        return c if zero_division is None else F.coalesce(c, F.lit(float(zero_division)))

    tp, fn, fp, n = (F.col(c) for c in ("tp", "fn", "fp", "n"))
    scored = df.withColumns({"recall": fill(X.divide(tp, tp + fn)), "precision": fill(X.divide(tp, tp + fp))})
    both = F.col("precision") + F.col("recall")
    return scored.withColumns(
        {
            "f1": fill(F.when(both > 0, X.divide(F.lit(2.0) * F.col("precision") * F.col("recall"), both))),
            "flag_rate": X.divide(tp + fp, n),
            "base_rate": X.divide(tp + fn, n),
        }
    )


def event_counts(df: DataFrame, threshold: Column | str, keys: Sequence[str] = CELL, zero_division: float | None = None) -> DataFrame:
    return add_event_scores(df.groupBy(*keys).agg(*event_aggregates(threshold)), zero_division)


def train_thresholds(
    observed: DataFrame, bounds: DataFrame, levels: Mapping[str, float], horizons: Sequence[int] | None = None
) -> DataFrame:
    """Percentiles of each fold's training window.

    ``observed`` is a dense series with ``pos``. Without ``horizons`` the sample is
    the training observations; with them it is the training *targets*
    (origin before train_end, value at origin + horizon).
    """
    rows = observed.filter(F.col("y").isNotNull())
    if horizons is None:
        return grouped_percentile(training_rows(rows, bounds), ["dataset", "fold"], "y", levels)
    fan = rows.withColumn("horizon", F.explode(F.array(*[F.lit(h) for h in horizons]))).filter(F.col("pos") >= F.col("horizon"))
    inside = training_rows(fan, bounds, -F.col("horizon"))
    return grouped_percentile(inside, ["dataset", "fold", "horizon"], "y", levels)


def observed_history(predictions: DataFrame) -> DataFrame:
    """One verified observation per dataset and target date."""
    return (
        predictions.filter(F.col("y_true").isNotNull() & F.col("date").isNotNull())
        .groupBy("dataset", "date")
        .agg(F.min("y_true").alias("y"))
        .withColumn("idx", day_index("date"))
    )


def expanding_thresholds(
    predictions: DataFrame, levels: Mapping[str, float], fixed: Mapping[str, float] | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Per origin: percentiles of the observations dated on or before it, plus fixed thresholds.

    Returns ``dataset, origin_date`` and one column per threshold; a column is NULL
    where no history exists yet.
    """
    history = expanding_percentile(observed_history(predictions), ["dataset"], "idx", "y", levels, chunk=chunk)
    origins = predictions.select("dataset", "origin_date").distinct().withColumn("__o", day_index("origin_date"))
    found = asof_join(origins, history, ["dataset"], "__o", "idx", list(levels), chunk=chunk).drop("__o")
    return found.withColumns({n: F.lit(float(v)) for n, v in (fixed or {}).items()})


EXCEEDANCE_LEVELS = {"p75": 0.75, "p90": 0.90}
EXCEEDANCE_FIXED = {"abs_50": 50.0}


def exceedance_table(
    predictions: DataFrame,
    levels: Mapping[str, float] | None = None,
    fixed: Mapping[str, float] | None = None,
    chunk: int = CHUNK,
) -> DataFrame:
    """Event scores per cell and threshold type with thresholds known at each origin."""
    levels = EXCEEDANCE_LEVELS if levels is None else levels
    fixed = EXCEEDANCE_FIXED if fixed is None else fixed
    rows = predictions.filter(
        F.col("origin_date").isNotNull() & F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    )
    limits = expanding_thresholds(rows, levels, fixed, chunk)
    names = [*levels, *fixed]
    fan = F.explode(F.array(*[F.struct(F.lit(n).alias("threshold_type"), F.col(n).alias("threshold_value")) for n in names]))
    long = rows.join(limits, ["dataset", "origin_date"]).select(*CELL, "y_true", "y_pred", fan.alias("t"))
    scored = (
        long.select(*CELL, "y_true", "y_pred", "t.*")
        .filter(F.col("threshold_value").isNotNull())
        .groupBy(*CELL, "threshold_type")
        .agg(F.avg("threshold_value").alias("threshold_value"), *event_aggregates("threshold_value"))
    )
    return add_event_scores(scored).select(
        *CELL, "threshold_type", "threshold_value", "recall", "precision", "f1", "flag_rate", "base_rate"
    )


def _fold_scores(predictions: DataFrame, thresholds: DataFrame, levels: Sequence[str]) -> DataFrame:
    """Scores per dataset, fold, model, horizon and threshold; zero divisions are 0."""
    keys = ["dataset", "fold", "model", "horizon"]
    fan = F.explode(
        F.array(*[F.struct(F.lit(int(n.lstrip("p"))).alias("threshold"), F.col(n).alias("threshold_value")) for n in levels])
    )
    long = predictions.join(thresholds, ["dataset", "fold"]).select(*keys, "y_true", "y_pred", "y_persistence", fan.alias("t"))
    scored = (
        long.select(*keys, "y_true", "y_pred", "y_persistence", "t.*")
        .groupBy(*keys, "threshold")
        .agg(
            F.first("threshold_value").alias("threshold_value"),
            *event_aggregates("threshold_value"),
            X.rmse("y_true", "y_pred").alias("__rm"),
            X.rmse("y_true", "y_persistence").alias("__rp"),
            F.var_pop("y_true").alias("__vt"),
            F.var_pop("y_pred").alias("__vp"),
        )
    )
    ratio = X.variance_ratio(F.col("__vp"), F.col("__vt"), 0.0)
    return (
        add_event_scores(scored, 0.0)
        .withColumn("skill", X.relative_skill("__rm", "__rp", "zero"))
        .withColumn("var_pct", F.lit(100.0) * ratio)
        .withColumn("skill_vp", F.col("skill") * F.col("var_pct") / 100.0)
    )


EVENT_VALUES = ["threshold_value", "base_rate", "recall", "precision", "flag_rate", "skill", "var_pct", "skill_vp"]
EVENT_NAMES = {"base_rate": "base_rate_test", "recall": "recall_events", "precision": "precision_events"}


def event_metrics_by_fold(
    predictions: DataFrame, thresholds: DataFrame, levels: Sequence[str] = ("p75", "p90"), protocol: str = "rolling_origin"
) -> DataFrame:
    """Scores per fold, then the unweighted mean over folds."""
    folds = _fold_scores(predictions, thresholds, levels)
    return folds.groupBy(*CELL, "threshold").agg(
        F.lit(protocol).alias("protocol"), *[F.avg(c).alias(EVENT_NAMES.get(c, c)) for c in EVENT_VALUES]
    )


def event_metrics_holdout(predictions: DataFrame, thresholds: DataFrame, levels: Sequence[str] = ("p75", "p90")) -> DataFrame:
    return event_metrics_by_fold(predictions, thresholds, levels, protocol="holdout")


def events_pooled(predictions: DataFrame, threshold: str = "p75_train", keys: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Pooled counts with each row's own training threshold."""
    counts = predictions.groupBy(*keys).agg(*event_aggregates(threshold))
    return add_event_scores(counts).select(
        *keys, "n", (F.col("tp") + F.col("fn")).alias("events"), F.lit(f"fold_train_{threshold.split('_')[0]}").alias("threshold_policy"),
        "recall", "precision", "flag_rate", "base_rate",
    )


def csi_far(df: DataFrame) -> DataFrame:
    """Critical success index from F1 and false-alarm ratio from precision."""
    f1 = F.col("f1")
    return df.withColumns(
        {
            "csi": F.when(f1.isNull(), None).when(f1 > 0, X.divide(f1, F.lit(2.0) - f1)).otherwise(0.0),
            "far": F.lit(1.0) - F.col("precision"),
        }
    )


def event_pivots(events: DataFrame, models: Sequence[str], threshold: int = 75) -> DataFrame:
    """Horizon rows with recall, precision and flag rate per model, and the base rate."""
    values = {"recall": "recall_events", "precision": "precision_events", "flag_rate": "flag_rate"}
    return (
        events.filter(F.col("threshold") == threshold)
        .groupBy("dataset", "horizon")
        .agg(
            F.avg("base_rate_test").alias("base_rate"),
            *[
                F.avg(F.when(F.col("model") == m, F.col(c))).alias(f"{m}_{name}")
                for m in models
                for name, c in values.items()
            ],
        )
    )
