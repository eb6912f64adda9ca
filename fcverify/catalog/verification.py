"""Queries over the predictions table: metrics, variance, events, tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from fcverify.catalog import tables as T
from fcverify.catalog.base import register
from fcverify.functions.quantiles import grouped_percentile
from fcverify.operators import events, metrics, series, stattests, variance
from fcverify.plans import hourly

CELL_SQL = "dataset, model, horizon"

# ---- baseline joins and accuracy -------------------------------------------

register(
    "with_baseline",
    "SELECT dataset, model, horizon, origin_date, date, y_true, y_pred, y_base FROM paired",
    "y_true y_pred y_base", "origin_date date",
)(lambda s, d: metrics.with_baseline(T.predictions(s, d)).select("dataset", "model", "horizon", "origin_date", "date", "y_true", "y_pred", "y_base"))

register(
    "error_table",
    "SELECT dataset, model, horizon, count(*) AS n, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, "
    "avg(abs(y_true - y_pred)) AS mae FROM pred GROUP BY ALL",
    "rmse mae",
)(lambda s, d: metrics.error_table(T.predictions(s, d)))

register("skill_matched", "SELECT * FROM cell_skill", "skill mae_skill")(lambda s, d: metrics.skill_matched(T.predictions(s, d)))

register(
    "supplier_skill",
    "SELECT dataset, model, horizon, count(*) AS n_pairs, "
    "1 - sqrt(avg((y_true - y_pred) * (y_true - y_pred))) / nullif(sqrt(avg((y_true - y_base) * (y_true - y_base))), 0) AS skill, "
    "1 - avg(abs(y_true - y_pred)) / nullif(avg(abs(y_true - y_base)), 0) AS mae_skill FROM supplier_pred WHERE model <> 'persistence' GROUP BY ALL",
    "skill mae_skill",
)(lambda s, d: metrics.skill_matched(T.supplier_predictions(s, d)))
register(
    "supplier_alpha",
    "SELECT dataset, model, horizon, count(*) AS n, coalesce(var_pop(y_pred) / nullif(var_pop(y_true), 0), 0.0) AS alpha FROM supplier_pred GROUP BY ALL",
    "alpha",
)(lambda s, d: variance.alpha_table(T.supplier_predictions(s, d)))
register(
    "quantity_percentiles",
    "SELECT l_returnflag, quantile_cont(l_quantity, 0.1) AS p10, quantile_cont(l_quantity, 0.5) AS p50, quantile_cont(l_quantity, 0.75) AS p75, "
    "quantile_cont(l_quantity, 0.9) AS p90 FROM lineitem GROUP BY l_returnflag",
    "p10 p50 p75 p90",
)(lambda s, d: grouped_percentile(T.table(s, d, "lineitem"), ["l_returnflag"], "l_quantity", {"p10": 0.1, "p50": 0.5, "p75": 0.75, "p90": 0.9}))

_errors = (
    "SELECT dataset, model, horizon, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, avg(abs(y_true - y_pred)) AS mae FROM pred GROUP BY ALL"
)
register(
    "skill_unmatched",
    f"SELECT e.dataset, e.model, e.horizon, 1 - e.rmse / nullif(b.rmse, 0) AS skill, 1 - e.mae / nullif(b.mae, 0) AS mae_skill FROM ({_errors}) e "
    f"JOIN ({_errors}) b ON b.dataset = e.dataset AND b.horizon = e.horizon AND b.model = 'persistence' WHERE e.model <> 'persistence'",
    "skill mae_skill",
)(lambda s, d: metrics.skill_unmatched(T.predictions(s, d)))


@register("relative_skill", "SELECT dataset, model, horizon, 1 - mae / nullif(mae_base, 0) AS skill, "
          "CASE WHEN mae_base > 0 THEN 1 - mae / mae_base ELSE 0 END AS skill_or_zero FROM "
          "(SELECT dataset, model, horizon, avg(abs(y_true - y_pred)) AS mae, avg(abs(y_true - y_base)) AS mae_base FROM paired GROUP BY ALL)",
          "skill skill_or_zero")
def _relative_skill(s, d):
    from fcverify.functions import expr as X

    sums = metrics.with_baseline(T.predictions(s, d)).groupBy(*metrics.CELL).agg(
        X.mae("y_true", "y_pred").alias("m"), X.mae("y_true", "y_base").alias("b")
    )
    return sums.select(*metrics.CELL, X.relative_skill("m", "b").alias("skill"), X.relative_skill("m", "b", "zero").alias("skill_or_zero"))


_by_horizon = (
    "SELECT {k}, rmse, rmse_persistence, var_obs, var_pred, CASE WHEN rmse_persistence > 0 THEN 1 - rmse / rmse_persistence ELSE 0 END AS skill, "
    "CASE WHEN var_obs > 0 THEN 100 * var_pred / var_obs ELSE 0 END AS var_pct, "
    "CASE WHEN rmse_persistence > 0 THEN 1 - rmse / rmse_persistence ELSE 0 END * CASE WHEN var_obs > 0 THEN var_pred / var_obs ELSE 0 END AS skill_vp FROM ("
    "SELECT {k}, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, sqrt(avg((y_true - {b}) * (y_true - {b}))) AS rmse_persistence, "
    "var_pop(y_true) AS var_obs, var_pop(y_pred) AS var_pred FROM {t} GROUP BY {k})"
)
_daily_metrics = _by_horizon.format(k="model, horizon", b="y_base", t="paired")
register("metrics_by_horizon", _daily_metrics, "rmse rmse_persistence skill var_obs:4 var_pred:4 var_pct:4 skill_vp")(
    lambda s, d: metrics.metrics_by_horizon(metrics.with_baseline(T.predictions(s, d)))
)
_repro = (
    "SELECT model, horizon, n, rmse, rmse_persistence, 1 - rmse / nullif(rmse_persistence, 0) AS skill_rmse, variance_observed, variance_predicted, "
    "100 * variance_predicted / variance_observed AS variance_retention_pct, "
    "(1 - rmse / nullif(rmse_persistence, 0)) * least(1.0, variance_predicted / variance_observed) AS skill_vp FROM ("
    "SELECT model, horizon, count(*) AS n, sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rmse, "
    "sqrt(avg((y_true - y_persistence) * (y_true - y_persistence))) AS rmse_persistence, var_samp(y_true) AS variance_observed, "
    "var_samp(y_pred) AS variance_predicted FROM rolling_pred GROUP BY ALL)"
)
register("metrics_reproduction", _repro, "rmse rmse_persistence skill_rmse variance_observed:4 variance_predicted:4 variance_retention_pct:4 skill_vp")(
    lambda s, d: metrics.metrics_reproduction(T.hourly_predictions(s, d))
)

_compare = " UNION ALL ".join(
    f"SELECT 'rolling_origin_vs_holdout' AS protocol, a.model, a.horizon, '{m}' AS metric, a.{m} AS ro_value, b.{m} AS ho_value, "
    f"abs(b.{m} - a.{m}) AS diff_absolute, coalesce(100 * abs(b.{m} - a.{m}) / nullif(abs(a.{m}), 0), 0) AS diff_pct FROM "
    f"({_by_horizon.format(k='model, horizon', b='y_persistence', t='rolling_pred')}) a JOIN "
    f"({_by_horizon.format(k='model, horizon', b='y_persistence', t='holdout_pred')}) b USING (model, horizon)"
    for m in ("rmse", "skill", "var_pct", "skill_vp")
)


def _comparison(s, d):
    parts = [
        metrics.metrics_by_horizon(T.hourly_predictions(s, d, p), base="y_persistence") for p in ("rolling_origin", "holdout")
    ]
    return metrics.protocol_comparison(*parts)


register("protocol_comparison", _compare, "ro_value ho_value diff_absolute diff_pct:4")(_comparison)
register(
    "protocol_comparison_summary",
    f"SELECT metric, count(diff_pct) AS count, avg(diff_pct) AS mean, stddev_samp(diff_pct) AS std, min(diff_pct) AS min, "
    f"quantile_cont(diff_pct, 0.25) AS q25, quantile_cont(diff_pct, 0.5) AS q50, quantile_cont(diff_pct, 0.75) AS q75, max(diff_pct) AS max FROM ({_compare}) GROUP BY metric",
    "mean:4 std:4 min:4 q25:4 q50:4 q75:4 max:4",
)(lambda s, d: metrics.describe_by(_comparison(s, d), "metric", "diff_pct"))

# ---- fold events (hourly) ---------------------------------------------------


def _fold_event_sql(p: str) -> str:
    label = "rolling_origin" if p == "rolling" else "holdout"
    inner = (
        "SELECT w.dataset, w.fold, w.model, w.horizon, x.threshold, CASE x.threshold WHEN 75 THEN t.p75 ELSE t.p90 END AS thr, w.y_true, w.y_pred, w.y_persistence "
        f"FROM {p}_pred w JOIN {p}_threshold t USING (dataset, fold) CROSS JOIN (SELECT CAST(unnest([75, 90]) AS INTEGER) AS threshold) x"
    )
    fold = (
        "SELECT dataset, fold, model, horizon, threshold, any_value(thr) AS threshold_value, "
        "count(*) FILTER (y_true > thr) / count(*)::DOUBLE AS base_rate_test, "
        "coalesce(count(*) FILTER (y_true > thr AND y_pred > thr) / nullif(count(*) FILTER (y_true > thr), 0)::DOUBLE, 0) AS recall_events, "
        "coalesce(count(*) FILTER (y_true > thr AND y_pred > thr) / nullif(count(*) FILTER (y_pred > thr), 0)::DOUBLE, 0) AS precision_events, "
        "count(*) FILTER (y_pred > thr) / count(*)::DOUBLE AS flag_rate, "
        "coalesce(1 - sqrt(avg((y_true - y_pred) * (y_true - y_pred))) / nullif(sqrt(avg((y_true - y_persistence) * (y_true - y_persistence))), 0), 0) AS skill, "
        f"coalesce(100 * var_pop(y_pred) / nullif(var_pop(y_true), 0), 0) AS var_pct FROM ({inner}) GROUP BY dataset, fold, model, horizon, threshold"
    )
    return (
        f"SELECT dataset, model, horizon, threshold, '{label}' AS protocol, avg(threshold_value) AS threshold_value, avg(base_rate_test) AS base_rate_test, "
        "avg(recall_events) AS recall_events, avg(precision_events) AS precision_events, avg(flag_rate) AS flag_rate, avg(skill) AS skill, "
        f"avg(var_pct) AS var_pct, avg(skill * var_pct / 100) AS skill_vp FROM ({fold}) GROUP BY dataset, model, horizon, threshold"
    )


EVENT_DIGITS = "threshold_value base_rate_test recall_events precision_events flag_rate skill var_pct:4 skill_vp"


def fold_events(s, d, protocol="rolling_origin"):
    grid = T.hourly_grid(s, d)
    limits = events.train_thresholds(grid, hourly.fold_bounds(grid, protocol), {"p75": 0.75, "p90": 0.9})
    made = hourly.hourly_predictions(grid, protocol)
    make = events.event_metrics_by_fold if protocol == "rolling_origin" else events.event_metrics_holdout
    return make(made, limits)


register("event_metrics_by_fold", _fold_event_sql("rolling"), EVENT_DIGITS)(fold_events)
register("event_metrics_holdout", _fold_event_sql("holdout"), EVENT_DIGITS)(lambda s, d: fold_events(s, d, "holdout"))

_hourly_models = ("amplified", "smooth")
register(
    "event_pivots",
    "SELECT dataset, horizon, avg(base_rate_test) AS base_rate, "
    + ", ".join(
        f"avg({c}) FILTER (model = '{m}') AS {m}_{n}"
        for m in _hourly_models
        for n, c in (("recall", "recall_events"), ("precision", "precision_events"), ("flag_rate", "flag_rate"))
    )
    + f" FROM ({_fold_event_sql('rolling')}) WHERE threshold = 75 GROUP BY dataset, horizon",
    "base_rate " + " ".join(f"{m}_{n}" for m in _hourly_models for n in ("recall", "precision", "flag_rate")),
)(lambda s, d: events.event_pivots(fold_events(s, d), _hourly_models))

_ms = _by_horizon.format(k="model, horizon", b="y_persistence", t="rolling_pred")
_ev = f"SELECT model, horizon, threshold, avg(recall_events) AS recall_events, avg(precision_events) AS precision_events, avg(flag_rate) AS flag_rate FROM ({_fold_event_sql('rolling')}) GROUP BY ALL"
register(
    "canonical_wide_table",
    "SELECT * FROM (SELECT horizon, round(max(rmse_persistence) FILTER (model = 'amplified'), 4) AS rmse_persistence, round(max(var_obs) FILTER (model = 'amplified'), 4) AS var_obs, "
    + ", ".join(f"round(max({c}) FILTER (model = '{m}'), {n}) AS {m}_{c}" for m in _hourly_models for c, n in (("rmse", 4), ("skill", 4), ("var_pct", 2), ("skill_vp", 4)))
    + f" FROM ({_ms}) GROUP BY horizon) LEFT JOIN (SELECT horizon, "
    + ", ".join(
        f"round(max({c}) FILTER (model = '{m}' AND threshold = {p}), 4) AS {m}_{n}_p{p}"
        for m in _hourly_models
        for p, c, n in ((75, "recall_events", "recall"), (75, "precision_events", "precision"), (75, "flag_rate", "flag_rate"), (90, "recall_events", "recall"), (90, "precision_events", "precision"))
    )
    + f" FROM ({_ev}) GROUP BY horizon) USING (horizon)",
    "rmse_persistence:4 var_obs:4 " + " ".join(f"{m}_{c}:4" for m in _hourly_models for c in ("rmse", "skill", "var_pct", "skill_vp", "recall_p75", "precision_p75", "flag_rate_p75", "recall_p90", "precision_p90")),
)(
    lambda s, d: metrics.canonical_wide_table(
        metrics.metrics_by_horizon(T.hourly_predictions(s, d), base="y_persistence"),
        fold_events(s, d).groupBy("model", "horizon", "threshold").agg(*[F.avg(c).alias(c) for c in ("recall_events", "precision_events", "flag_rate")]),
        _hourly_models,
    )
)

register(
    "events_pooled",
    "SELECT model, horizon, count(*) AS n, count(*) FILTER (y_true > p75_train) AS events, 'fold_train_p75' AS threshold_policy, "
    "count(*) FILTER (y_true > p75_train AND y_pred > p75_train) / nullif(count(*) FILTER (y_true > p75_train), 0)::DOUBLE AS recall, "
    "count(*) FILTER (y_true > p75_train AND y_pred > p75_train) / nullif(count(*) FILTER (y_pred > p75_train), 0)::DOUBLE AS precision, "
    "count(*) FILTER (y_pred > p75_train) / count(*)::DOUBLE AS flag_rate, count(*) FILTER (y_true > p75_train) / count(*)::DOUBLE AS base_rate "
    "FROM rolling_pred GROUP BY model, horizon",
    "recall precision flag_rate base_rate",
)(lambda s, d: events.events_pooled(T.hourly_predictions(s, d)))

register(
    "train_thresholds",
    "SELECT dataset, CAST(fold AS INTEGER) AS fold, p50, p75, p90 FROM rolling_threshold", "p50 p75 p90",
)(lambda s, d: events.train_thresholds(T.hourly_grid(s, d), T.hourly_bounds(s, d), {"p50": 0.5, "p75": 0.75, "p90": 0.9}))

register(
    "train_target_thresholds",
    "SELECT b.dataset, b.fold, h.horizon, quantile_cont(g.y, 0.75) AS p75 FROM rolling_bound b CROSS JOIN hourly_horizon h "
    "JOIN hour_grid g ON g.dataset = b.dataset AND g.pos - h.horizon < b.train_end AND g.pos - h.horizon >= 0 GROUP BY b.dataset, b.fold, h.horizon",
    "p75",
)(lambda s, d: events.train_thresholds(T.hourly_grid(s, d), T.hourly_bounds(s, d), {"p75": 0.75}, hourly.HORIZONS))

# ---- events (daily) ---------------------------------------------------------

register(
    "event_counts",
    f"SELECT dataset, model, horizon, n, tp, fn, fp, coalesce(tp / nullif(tp + fn, 0)::DOUBLE, 0) AS recall, coalesce(tp / nullif(tp + fp, 0)::DOUBLE, 0) AS precision, "
    "coalesce(2 * (tp / nullif(tp + fp, 0)::DOUBLE) * (tp / nullif(tp + fn, 0)::DOUBLE) / nullif((tp / nullif(tp + fp, 0)::DOUBLE) + (tp / nullif(tp + fn, 0)::DOUBLE), 0), 0) AS f1, "
    f"(tp + fp) / n::DOUBLE AS flag_rate, (tp + fn) / n::DOUBLE AS base_rate FROM (SELECT dataset, model, horizon, count(*) AS n, count(*) FILTER (y_true > {T.FIXED} AND y_pred > {T.FIXED}) AS tp, "
    f"count(*) FILTER (y_true > {T.FIXED} AND NOT y_pred > {T.FIXED}) AS fn, count(*) FILTER (NOT y_true > {T.FIXED} AND y_pred > {T.FIXED}) AS fp FROM pred GROUP BY ALL)",
    "recall precision f1 flag_rate base_rate",
)(lambda s, d: events.event_counts(T.predictions(s, d), F.lit(T.FIXED), zero_division=0.0))

register("expanding_thresholds", f"SELECT dataset, origin_date, p75, p90, {T.FIXED}::DOUBLE AS abs_50 FROM origin_threshold", "p75 p90 abs_50", "origin_date")(
    lambda s, d: events.expanding_thresholds(T.predictions(s, d), {"p75": 0.75, "p90": 0.9}, {"abs_50": T.FIXED})
)
EXC_DIGITS = "threshold_value recall precision f1 flag_rate base_rate"
register("exceedance_table", "SELECT * FROM exceedance_cell", EXC_DIGITS)(lambda s, d: T.diagnostics(s, d).exceedance)
register(
    "csi_far",
    "SELECT *, CASE WHEN f1 IS NULL THEN NULL WHEN f1 > 0 THEN f1 / (2 - f1) ELSE 0 END AS csi, 1 - precision AS far FROM exceedance_cell",
    EXC_DIGITS + " csi far",
)(lambda s, d: events.csi_far(T.diagnostics(s, d).exceedance))

# ---- variance retention ------------------------------------------------------

SUMMARY_DIGITS = "skill mae_skill alpha skill_vp"
register("alpha", "SELECT * FROM cell_alpha", "alpha")(lambda s, d: variance.alpha_table(T.predictions(s, d)))
register("variance_retention_summary", "SELECT * EXCLUDE (alpha_ci_low, alpha_ci_high) FROM cell_summary", SUMMARY_DIGITS)(
    lambda s, d: T.diagnostics(s, d).summary.drop("alpha_ci_low", "alpha_ci_high")
)
register("bootstrap_alpha_ci", None, "alpha_ci_low alpha_ci_high")(lambda s, d: variance.bootstrap_alpha_ci(T.predictions(s, d)))
register(
    "bootstrap_summary", None, "skill mae_skill alpha alpha_ci_low alpha_ci_high skill_vp",
)(lambda s, d: variance.variance_retention_summary(
    T.predictions(s, d), metrics.skill_matched(T.predictions(s, d)), variance.bootstrap_alpha_ci(T.predictions(s, d))))

_limits7 = "(SELECT unnest([0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9])::DOUBLE AS threshold)"
register(
    "threshold_sensitivity",
    f"SELECT threshold, model, count(*) AS total_cells, count(*) FILTER (alpha < threshold) AS collapsed_cells, "
    f"100.0::DOUBLE * count(*) FILTER (alpha < threshold) / count(*) AS collapse_rate_pct FROM cell_summary CROSS JOIN {_limits7} GROUP BY ALL",
    "threshold collapse_rate_pct",
)(lambda s, d: variance.threshold_sensitivity(T.diagnostics(s, d).summary))

_members = (
    "(SELECT * FROM (VALUES ('Contrasts', 'smooth'), ('Contrasts', 'amplified'), ('Seasonal naive', 'seasonal_naive'), "
    "('All models', 'smooth'), ('All models', 'amplified'), ('All models', 'seasonal_naive')) m(grp, model))"
)
register(
    "group_collapse_rates",
    f'SELECT threshold, grp AS "group", count(*) FILTER (alpha < threshold) AS collapsed_cells, count(*) AS total_cells, '
    f"round(100.0::DOUBLE * count(*) FILTER (alpha < threshold) / count(*), 1) AS collapse_rate_pct FROM cell_summary JOIN {_members} USING (model) "
    "CROSS JOIN (SELECT unnest([0.4, 0.5, 0.6])::DOUBLE AS threshold) GROUP BY threshold, grp",
    "threshold collapse_rate_pct",
)(lambda s, d: variance.group_collapse_rates(T.diagnostics(s, d).summary, T.GROUPS))


def interval_cells(s, d):
    """Cells with a wide interval around alpha, so that the counting operators have SQL counterparts."""
    cells = T.stations(s, d)
    from fcverify.sources.stations import station_dimension

    return station_dimension(
        T.diagnostics(s, d).summary.withColumns({"alpha_ci_low": F.col("alpha") * 0.5, "alpha_ci_high": F.col("alpha") * 1.5}), cells
    )


_interval = (
    "(SELECT s.* REPLACE (s.alpha * 0.5::DOUBLE AS alpha_ci_low, s.alpha * 1.5::DOUBLE AS alpha_ci_high), s.dataset AS station_id, coalesce(t.station_name, s.dataset) AS station_name, "
    "coalesce(t.station_type, 'Unknown') AS station_type FROM cell_summary s LEFT JOIN station t ON t.station_id = s.dataset)"
)
register(
    "ci_position_counts",
    " UNION ALL ".join(
        f"SELECT grp AS section, threshold, count(*) AS total, '{n}' AS category, count(*) FILTER ({c}) AS count, "
        f"round(100.0::DOUBLE * count(*) FILTER ({c}) / count(*), 1) AS percentage FROM {_interval} JOIN {_members} USING (model) "
        "CROSS JOIN (SELECT unnest([0.5, 0.8])::DOUBLE AS threshold) GROUP BY grp, threshold"
        for n, c in (
            ("ci_high_below_threshold", "alpha_ci_high < threshold"),
            ("ci_crosses_threshold", "alpha_ci_low <= threshold AND threshold <= alpha_ci_high"),
            ("ci_low_above_threshold", "alpha_ci_low > threshold"),
        )
    ),
    "threshold percentage",
)(lambda s, d: variance.ci_position_counts(interval_cells(s, d), T.GROUPS, (0.5, 0.8)))
_cells_view = "station_name, station_id, model, horizon, alpha, alpha_ci_low, alpha_ci_high"
register("crossing_cells", f"SELECT {_cells_view} FROM {_interval} WHERE alpha_ci_low <= 0.5 AND alpha_ci_high >= 0.5", "alpha alpha_ci_low alpha_ci_high")(
    lambda s, d: variance.crossing_cells(interval_cells(s, d), 0.5)
)
register(
    "noncollapsed_exceptions",
    f"SELECT {_cells_view} FROM {_interval} WHERE model IN ('smooth', 'amplified') AND alpha >= 0.5", "alpha alpha_ci_low alpha_ci_high",
)(lambda s, d: variance.noncollapsed_exceptions(interval_cells(s, d), ["smooth", "amplified"]))
register(
    "station_collapse_rates",
    f"SELECT station_id, station_type, count(*) FILTER (collapse_flag) AS collapsed, count(*) AS total, count(*) = 14 AS total_ok, "
    f"round(100.0::DOUBLE * count(*) FILTER (collapse_flag) / count(*), 1) AS collapse_rate_pct FROM {_interval} "
    "WHERE model IN ('smooth', 'amplified') GROUP BY station_id, station_type",
    "collapse_rate_pct",
)(lambda s, d: variance.station_collapse_rates(interval_cells(s, d), ["station_id", "station_type"], ["smooth", "amplified"], 14))
register(
    "rollup_counts",
    "SELECT label, count(*) FILTER (collapse_flag) AS collapsed, count(*) AS total, count(*) FILTER (collapse_flag <> (alpha < 0.5)) AS flag_mismatches FROM ("
    f"SELECT 'group:' || grp AS label, collapse_flag, alpha FROM cell_summary JOIN {_members} USING (model) UNION ALL "
    "SELECT 'model:' || model, collapse_flag, alpha FROM cell_summary) GROUP BY label",
)(lambda s, d: variance.rollup_counts(T.diagnostics(s, d).summary, T.GROUPS))
register(
    "desirable_cells",
    "SELECT dataset, model, horizon, skill, alpha FROM cell_summary WHERE model = 'seasonal_naive' AND skill > 0 AND alpha >= 0.8", "skill alpha",
)(lambda s, d: variance.desirable_cells(T.diagnostics(s, d).summary, "seasonal_naive"))
_flags = ("collapse_flag", "inflation_flag", "near_ideal_flag", "low_sample_flag")
register(
    "model_summary",
    "SELECT model, "
    + ", ".join(f"{f}({c}) AS {c}_{n}" for c in ("skill", "alpha", "skill_vp") for n, f in (("mean", "avg"), ("min", "min"), ("max", "max")))
    + ", " + ", ".join(f"count(*) FILTER ({c}) AS {c}_n" for c in _flags) + ", min(n) AS min_n FROM cell_summary GROUP BY model",
    " ".join(f"{c}_{n}" for c in ("skill", "alpha", "skill_vp") for n in ("mean", "min", "max")),
)(lambda s, d: variance.model_summary(T.diagnostics(s, d).summary))
register(
    "run_profile",
    "SELECT CAST(sum(n) AS BIGINT) AS n_rows, count(DISTINCT dataset) AS n_datasets, count(DISTINCT model) AS n_models, count(DISTINCT horizon) AS n_horizons, "
    "min(horizon) AS min_horizon, max(horizon) AS max_horizon, min(lo) AS first_date, max(hi) AS last_date, min(n) AS min_cell_rows, "
    "count(*) FILTER (n < 30) AS low_sample_cells, CAST(sum(missing) AS BIGINT) AS missing_predictions FROM "
    "(SELECT dataset, model, horizon, count(*) AS n, min(date) AS lo, max(date) AS hi, count(*) FILTER (y_pred IS NULL) AS missing FROM pred GROUP BY ALL)",
    None, "first_date last_date",
)(lambda s, d: variance.run_profile(T.predictions(s, d)))
_conc = ", ".join(
    f"p.pred_std_{m}_h{h}, 2 * p.pred_std_{m}_h{h} AS predicted_range_{m}_h{h}_ug, "
    f"(p.pred_std_{m}_h{h} / nullif(o.obs_std_ug, 0)) * (p.pred_std_{m}_h{h} / nullif(o.obs_std_ug, 0)) AS alpha_{m}_h{h}"
    for m in ("smooth", "seasonal_naive") for h in (1, 7)
)
_conc_std = ", ".join(
    f"stddev_pop(y_pred) FILTER (model = '{m}' AND horizon = {h}) AS pred_std_{m}_h{h}" for m in ("smooth", "seasonal_naive") for h in (1, 7)
)
register(
    "concentration_scale",
    f"SELECT o.dataset, o.obs_mean_ug, o.obs_std_ug, 2 * o.obs_std_ug AS observed_range_ug, {_conc}, s.station_name, s.station_type FROM "
    "(SELECT dataset, avg(y) AS obs_mean_ug, stddev_pop(y) AS obs_std_ug FROM (SELECT dataset, date, any_value(y_true) AS y FROM pred GROUP BY ALL) GROUP BY dataset) o "
    f"JOIN (SELECT dataset, {_conc_std} FROM pred GROUP BY dataset) p USING (dataset) LEFT JOIN station s ON s.station_id = o.dataset",
    "obs_mean_ug obs_std_ug observed_range_ug "
    + " ".join(f"{c}" for m in ("smooth", "seasonal_naive") for h in (1, 7) for c in (f"pred_std_{m}_h{h}", f"predicted_range_{m}_h{h}_ug", f"alpha_{m}_h{h}")),
)(lambda s, d: variance.concentration_scale(
    T.predictions(s, d), ["smooth", "seasonal_naive"],
    dimension=T.stations(s, d).select(F.col("station_id").alias("dataset"), "station_name", "station_type")))

# ---- significance and decompositions -----------------------------------------

register(
    "autocovariance",
    "SELECT dataset, model, horizon, n, CAST(unnest(range(0, 7)) AS INTEGER) AS lag, unnest([g0, g1, g2, g3, g4, g5, g6]) AS autocov FROM loss_autocov",
    "autocov:2",
)(lambda s, d: stattests.autocovariance(
    stattests.loss_differences(T.predictions(s, d)).withColumn("i", series.day_index("date")), metrics.CELL, "i", "loss_diff", 6))
register("dm_hln", "SELECT dataset, model, horizon, n_pairs AS n_finite, dm_stat FROM dm_stat_cell", "dm_stat")(
    lambda s, d: stattests.dm_hln(stattests.loss_differences(T.predictions(s, d)).withColumn("i", series.day_index("date")), "i")
)
register("dm_table", "SELECT * FROM dm_cell", "dm_stat dm_pval_raw dm_pval_bh")(lambda s, d: T.diagnostics(s, d).dm)


@register(
    "bh_adjust",
    "SELECT dataset, model, horizon, p, CASE WHEN p IS NOT NULL THEN least(1.0, min(p * m / r) OVER (PARTITION BY dataset ORDER BY r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS p_bh FROM ("
    "SELECT *, count(p) OVER (PARTITION BY dataset) AS m, row_number() OVER (PARTITION BY dataset ORDER BY p ASC NULLS LAST, model, horizon) AS r FROM ("
    "SELECT dataset, model, horizon, CASE WHEN skill <> 0 THEN least(1.0, abs(skill) / 4) END AS p FROM cell_skill))",
    "p p_bh",
)
def _bh(s, d):
    p = F.when(F.col("skill") != 0, F.least(F.lit(1.0), F.abs("skill") / 4))
    return stattests.bh_adjust(metrics.skill_matched(T.predictions(s, d)).select(*metrics.CELL, p.alias("p")), "p", "p_bh")


register(
    "murphy_decomposition", "SELECT * FROM murphy_cell", "mse:3 bias_sq:4 cond_bias_sq:3 irreducible_sq:3 rho std_pred_ug:5 std_true_ug:5 alpha",
)(lambda s, d: T.diagnostics(s, d).murphy)
register("kge_components", "SELECT dataset, model, horizon, n, r_h, alpha_h, beta_h, kge_h AS KGE_h FROM kge_part", "r_h alpha_h beta_h KGE_h")(
    lambda s, d: stattests.kge_components(T.predictions(s, d))
)
KGE_DIGITS = "r_h alpha_h phi_h beta_h KGE_h KGE_persistence_h KGE_skill_h"
register("kge_horizon_table", "SELECT * FROM kge_cell", KGE_DIGITS)(lambda s, d: T.diagnostics(s, d).kge)
register(
    "kge_skill",
    "SELECT dataset, model, horizon, KGE_skill_h AS kge_skill, (KGE_h - KGE_persistence_h) / nullif(1 - KGE_persistence_h, 0) AS kge_gain FROM kge_cell",
    "kge_skill kge_gain",
)(lambda s, d: T.diagnostics(s, d).kge.select(
    *metrics.CELL, stattests.kge_skill("KGE_h", "KGE_persistence_h").alias("kge_skill"), stattests.kge_gain("KGE_h", "KGE_persistence_h").alias("kge_gain")))
register(
    "metric_quantile_summary",
    "SELECT model, h, count(*) FILTER (coalesce(r_h, alpha_h, beta_h, KGE_h, KGE_skill_h) IS NOT NULL) AS n_stations_valid, "
    + ", ".join(f"median({m}) AS {m}_median, quantile_cont({m}, 0.75) - quantile_cont({m}, 0.25) AS {m}_iqr" for m in stattests.KGE_METRICS)
    + " FROM kge_cell GROUP BY model, h",
    " ".join(f"{m}_{x}" for m in stattests.KGE_METRICS for x in ("median", "iqr")),
)(lambda s, d: stattests.metric_quantile_summary(T.diagnostics(s, d).kge))
