"""Decision rules over the diagnostic table and model-family summaries."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.quantiles import grouped_percentile, medians
from fcverify.operators.events import csi_far
from fcverify.operators.metrics import CELL

ALPHA_MIN, RECALL_MIN = 0.5, 0.2


def decision_rules(cells: DataFrame, alpha_min: float = ALPHA_MIN, recall_min: float = RECALL_MIN) -> DataFrame:
    """Rule A (skill and significance), rule B (A plus alpha and recall), the change and its reason."""
    a = X.truth((F.col("skill") > 0) & F.col("dm_significant"))
    b = a & X.truth(F.col("alpha") >= alpha_min) & X.truth(F.col("recall_p75") >= recall_min)
    ruled = cells.withColumns({"rule_a": a, "rule_b": b}).withColumn("decision_change", F.col("rule_a") & ~F.col("rule_b"))
    return change_reason(ruled, alpha_min, recall_min)


def change_reason(ruled: DataFrame, alpha_min: float = ALPHA_MIN, recall_min: float = RECALL_MIN) -> DataFrame:
    """A NULL recall fails rule B but is no recall failure: the reason stays no_change."""
    alpha_fail = X.truth(F.col("alpha") < alpha_min)
    recall_fail = X.truth(F.col("recall_p75") < recall_min)
    return ruled.withColumn(
        "reason_change",
        F.when(~F.col("rule_a"), "n/a")
        .when(alpha_fail & recall_fail, "both")
        .when(alpha_fail, "collapse_only")
        .when(recall_fail, "recall_only")
        .otherwise("no_change"),
    )


def _stacked(df: DataFrame, dims: Mapping[str, str], aggregates: Sequence, overall: bool) -> DataFrame:
    """One GROUPING SETS aggregate over single dimensions as rows ``group, label``."""
    columns = list(dims)
    sets = ([[]] if overall else []) + [[F.col(d)] for d in columns]
    grouped = df.groupingSets(sets, *[F.col(d) for d in columns]).agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in columns], *aggregates
    )
    group, label = F.lit("overall"), F.lit("all")
    for d in columns:
        here = F.col(f"__g_{d}") == 0
        text = F.concat(F.lit("h"), F.col(d).cast("string")) if d == "horizon" else F.col(d).cast("string")
        group, label = F.when(here, dims[d]).otherwise(group), F.when(here, text).otherwise(label)
    return grouped.withColumns({"group": group, "label": label}).drop(*columns, *[f"__g_{d}" for d in columns])


def decision_summary(ruled: DataFrame, station_type: str | None = "station_type") -> DataFrame:
    """Counts overall and by model, horizon and station type."""
    dims = {"model": "model", "horizon": "horizon"}
    if station_type is not None:
        dims[station_type] = "station_type"
    counts = [
        F.count_if("rule_a").alias("rule_a_n"),
        F.count_if("rule_b").alias("rule_b_n"),
        F.count_if("decision_change").alias("decision_change_n"),
    ]
    return _stacked(ruled, dims, counts, overall=True).withColumn(
        "decision_change_pct_of_ruleA", X.percent(F.col("decision_change_n"), F.col("rule_a_n"))
    )


def decision_sensitivity(
    ruled: DataFrame,
    alphas: Sequence[float] = (0.3, 0.5, 0.7),
    recalls: Sequence[float] = (0.1, 0.2, 0.3),
    primary: tuple[float, float] = (ALPHA_MIN, RECALL_MIN),
) -> DataFrame:
    """Passes, changes and reasons on a grid of thresholds; the grid is a literal, not a join."""
    grid = X.table_of(*[(float(a), float(r)) for a in alphas for r in recalls], names=["alpha_thresh", "recall_thresh"])
    rows = ruled.filter("rule_a").select("alpha", "recall_p75", F.explode(grid).alias("g")).select("alpha", "recall_p75", "g.*")
    a_ok = X.truth(F.col("alpha") >= F.col("alpha_thresh"))
    r_ok = X.truth(F.col("recall_p75") >= F.col("recall_thresh"))
    a_bad = X.truth(F.col("alpha") < F.col("alpha_thresh"))
    r_bad = X.truth(F.col("recall_p75") < F.col("recall_thresh"))
    counted = rows.groupBy("alpha_thresh", "recall_thresh").agg(
        F.count(F.lit(1)).alias("rule_a_n"),
        F.count_if(a_ok & r_ok).alias("pass_rule_b_n"),
        F.count_if(~(a_ok & r_ok)).alias("decision_change_n"),
        F.count_if(a_bad & ~r_bad).alias("collapse_only_n"),
        F.count_if(~a_bad & r_bad).alias("recall_only_n"),
        F.count_if(a_bad & r_bad).alias("both_n"),
    )
    is_primary = (F.col("alpha_thresh") == primary[0]) & (F.col("recall_thresh") == primary[1])
    return counted.withColumns(
        {"decision_change_pct": X.percent(F.col("decision_change_n"), F.col("rule_a_n")), "primary": is_primary}
    )


def sensitivity_pivot(sensitivity: DataFrame, recalls: Sequence[float] = (0.1, 0.2, 0.3)) -> DataFrame:
    return (
        sensitivity.groupBy("alpha_thresh")
        .pivot("recall_thresh", [float(r) for r in recalls])
        .agg(F.first("decision_change_pct"))
        .toDF("alpha_thresh", *[f"recall_{int(round(r * 100))}" for r in recalls])
    )


def discordant_cells(ruled: DataFrame, alpha_min: float = ALPHA_MIN, recall_min: float = RECALL_MIN) -> DataFrame:
    return ruled.filter(F.col("rule_a") & (F.col("recall_p75") >= recall_min) & (F.col("alpha") < alpha_min))


def discordant_summary(
    ruled: DataFrame,
    dims: Sequence[str] = ("dataset", "model", "horizon", "station_type"),
    alpha_min: float = ALPHA_MIN,
    recall_min: float = RECALL_MIN,
) -> DataFrame:
    """Discordant cells with denominators by each dimension."""
    hit = X.truth(F.col("rule_a") & (F.col("recall_p75") >= recall_min) & (F.col("alpha") < alpha_min))
    counts = [
        F.count(F.lit(1)).alias("n_total"),
        F.count_if("rule_a").alias("n_rule_a"),
        F.count_if(hit).alias("n_discordant"),
    ]
    return _stacked(ruled, {d: d for d in dims if d in ruled.columns}, counts, overall=False).withColumn(
        "pct_of_ruleA", X.percent(F.col("n_discordant"), F.col("n_rule_a"))
    )


def distribution(df: DataFrame, column: str) -> DataFrame:
    """Count, mean, SD, quartiles and range of a column of a cell table as one row."""
    quart = grouped_percentile(df.withColumn("__one", F.lit(1)), ["__one"], column, {"q25": 0.25, "q50": 0.5, "q75": 0.75})
    base = df.agg(
        F.count(column).alias("count"), F.avg(column).alias("mean"), F.stddev_samp(column).alias("std"),
        F.min(column).alias("min"), F.max(column).alias("max"), F.lit(1).alias("__one"),
    )
    return base.join(quart, "__one", "left").drop("__one")


def failure_decomposition(ruled: DataFrame, alpha_min: float = ALPHA_MIN, recall_min: float = RECALL_MIN) -> DataFrame:
    """Mutually exclusive counts among rule A cells; ``adds_up`` tells whether they sum to the total."""
    a, r = X.truth(F.col("alpha") < alpha_min), X.truth(F.col("recall_p75") < recall_min)
    one = ruled.filter("rule_a").agg(
        F.count_if(~a & ~r).alias("pass_rule_b"),
        F.count_if(a & ~r).alias("fail_alpha_only"),
        F.count_if(~a & r).alias("fail_recall_only"),
        F.count_if(a & r).alias("fail_both"),
        F.count(F.lit(1)).alias("total_rule_a"),
    )
    parts = F.col("pass_rule_b") + F.col("fail_alpha_only") + F.col("fail_recall_only") + F.col("fail_both")
    return one.withColumn("adds_up", parts == F.col("total_rule_a"))


def incremental_auc(ruled: DataFrame, min_rows: int = 20, max_iter: int = 1000) -> DataFrame:
    """ROC AUC of a logistic model for the decision change without and with alpha, in sample.

    Returns no rows when there are fewer than ``min_rows`` rule A cells or one class only.
    """
    from pyspark.ml import Pipeline
    from pyspark.ml.classification import LogisticRegression
    from pyspark.ml.evaluation import BinaryClassificationEvaluator
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    spark = ruled.sparkSession
    schema = "n long, auc_without_alpha double, auc_with_alpha double, delta_auc double"
    rows = ruled.filter("rule_a").select(
        *[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in ("skill", "recall_p75", "alpha")],
        (~F.col("rule_b")).cast("double").alias("label"),
    ).cache()
    size = rows.agg(F.count(F.lit(1)).alias("n"), F.countDistinct("label").alias("k")).first()
    if size["n"] < min_rows or size["k"] < 2:
        rows.unpersist()
        return spark.createDataFrame([], schema)

    def area(columns):
        stages = [
            VectorAssembler(inputCols=columns, outputCol="raw"),
            StandardScaler(inputCol="raw", outputCol="features", withMean=True, withStd=True),
            LogisticRegression(maxIter=max_iter, regParam=1.0 / size["n"], standardization=False),
        ]
        scored = Pipeline(stages=stages).fit(rows).transform(rows)
        return BinaryClassificationEvaluator(metricName="areaUnderROC").evaluate(scored)

    plain, full = area(["skill", "recall_p75"]), area(["skill", "recall_p75", "alpha"])
    rows.unpersist()
    return spark.createDataFrame([(size["n"], plain, full, full - plain)], schema)


def model_family_summary(
    master: DataFrame, exceedance: DataFrame, murphy: DataFrame, families: Mapping[str, str] | None = None
) -> DataFrame:
    """One row per model: medians and counts over the diagnostic, exceedance and Murphy tables."""
    s, a, sig = F.col("skill"), F.col("alpha"), X.truth(F.col("dm_significant"))
    counts = master.groupBy("model").agg(
        F.count(F.lit(1)).alias("n_cells"),
        F.count_if(a < 0.5).alias("collapsed_cells"),
        F.count_if(a >= 0.8).alias("retained_cells"),
        F.count_if(s > 0).alias("positive_skill_cells"),
        F.count_if((s > 0) & a.between(0.8, 1.2)).alias("near_ideal_cells"),
        F.count_if((s > 0) & sig).alias("sig_imp_cells"),
        F.count_if((s > 0) & ~sig).alias("ns_imp_cells"),
        F.count_if((s < 0) & sig).alias("sig_deg_cells"),
    )
    for name in ("collapsed", "retained", "positive_skill", "near_ideal"):
        rate = {"collapsed": "collapse"}.get(name, name)
        counts = counts.withColumn(f"{rate}_rate_pct", X.percent(F.col(f"{name}_cells"), F.col("n_cells"), None))
    mid = medians(master, ["model"], ["skill", "alpha", "skill_vp"])
    events = medians(csi_far(exceedance), ["model"], ["recall", "csi", "far"])
    parts = medians(murphy, ["model"], ["mse", "bias_sq", "cond_bias_sq", "irreducible_sq"])

    def named(df, prefix, renames=None):
        return df.select("model", *[F.col(c).alias(f"{prefix}{(renames or {}).get(c, c).removesuffix('_median')}") for c in df.columns if c != "model"])

    out = (
        counts.join(named(mid, "median_"), "model", "left")
        .join(named(events, "median_", {"recall_median": "exceedance_recall"}), "model", "left")
        .join(named(parts, "median_murphy_"), "model", "left")
    )
    if families:
        family = F.lit(None).cast("string")
        for model, label in families.items():
            family = F.when(F.col("model") == model, label).otherwise(family)
        out = out.withColumn("model_family", family)
    return out


def quadrant_counts(cells: DataFrame, alpha_min: float = ALPHA_MIN) -> DataFrame:
    s, a = F.col("skill"), F.col("alpha")
    return cells.groupBy("model").agg(
        F.count_if((s > 0) & (a >= alpha_min)).alias("positive_retained"),
        F.count_if((s > 0) & (a < alpha_min)).alias("positive_collapsed"),
        F.count_if((s <= 0) & (a >= alpha_min)).alias("negative_retained"),
        F.count_if((s <= 0) & (a < alpha_min)).alias("negative_collapsed"),
    )


EXCEEDANCE_METRICS = ("recall", "precision", "f1", "flag_rate", "base_rate")


def exceedance_pivot(exceedance: DataFrame, types: Sequence[str] = ("p75", "p90", "abs_50")) -> DataFrame:
    return exceedance.groupBy(*CELL).agg(
        *[
            F.avg(F.when(F.col("threshold_type") == t, F.col(m))).alias(f"{m}_{t}")
            for m in EXCEEDANCE_METRICS
            for t in types
        ]
    )


def master_table(
    variance: DataFrame,
    dm: DataFrame | None = None,
    murphy: DataFrame | None = None,
    exceedance: DataFrame | None = None,
    concentration: DataFrame | None = None,
    types: Sequence[str] = ("p75", "p90", "abs_50"),
) -> DataFrame:
    """Variance summary left-joined with every diagnostic given."""
    out = variance
    if dm is not None:
        out = out.join(dm.select(*CELL, "dm_pval_bh", "dm_significant", "dm_stat", "n_pairs"), CELL, "left")
    if murphy is not None:
        out = out.join(
            murphy.select(*CELL, "bias_sq", "cond_bias_sq", "irreducible_sq", "rho", "std_pred_ug", "std_true_ug"), CELL, "left"
        )
    if exceedance is not None:
        out = out.join(exceedance_pivot(exceedance, types), CELL, "left")
    if concentration is not None:
        out = out.join(concentration.select("dataset", "obs_mean_ug", "obs_std_ug", "observed_range_ug"), "dataset", "left")
    return out


def horizon_profiles(cells: DataFrame, metric: str, keys: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Mean, median and the 2%-98% range of a metric per model and horizon."""
    middle = grouped_percentile(cells, list(keys), metric, {"median": 0.5, "low": 0.02, "high": 0.98})
    return cells.groupBy(*keys).agg(F.avg(metric).alias("mean"), F.count(metric).alias("n")).join(middle, list(keys), "left")
