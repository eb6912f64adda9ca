"""Queries over the cell tables: rankings, decisions, regimes, quality."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import functions as F

from fcverify.catalog import tables as T
from fcverify.catalog.base import cte, register
from fcverify.operators import decisions, events, metrics, quality, ranks, regimes, series, stattests, variance
from fcverify.plans import hourly
from fcverify.session import settle

# ---- rankings -------------------------------------------------------------------

cte(
    "ranked_cell",
    "SELECT k.station, k.h, k.model, s.skill AS Skill_h, k.phi_h, k.r_h, k.KGE_h, k.KGE_skill_h, "
    "coalesce(t.station_name, k.dataset) AS station_name, coalesce(t.station_type, 'Unknown') AS station_type, "
    "CASE WHEN lower(coalesce(t.station_type, 'Unknown')) LIKE '%rural%' THEN 'rural' WHEN lower(coalesce(t.station_type, 'Unknown')) LIKE '%industrial%' THEN 'industrial' ELSE 'urban' END AS station_class "
    "FROM kge_cell k JOIN cell_skill s ON s.dataset = k.dataset AND s.model = k.model AND s.horizon = k.h LEFT JOIN station t ON t.station_id = k.dataset",
)
_columns = ranks.METRICS


def _pair_sql(pairs) -> str:
    return " UNION ALL ".join(
        f"SELECT station, h, model, '{a}_vs_{b}' AS pair, {_columns[a]} AS a, {_columns[b]} AS b FROM ranked_cell WHERE {_columns[a]} IS NOT NULL AND {_columns[b]} IS NOT NULL"
        for a, b in pairs
    )


def _rho_sql(pairs) -> str:
    return (
        "SELECT station, h, pair, count(DISTINCT model) AS n_models, CASE WHEN count(DISTINCT model) >= 3 THEN covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) END AS rho FROM ("
        "SELECT station, h, pair, model, rank() OVER (PARTITION BY station, h, pair ORDER BY a DESC) + (count(*) OVER (PARTITION BY station, h, pair, a) - 1) / 2.0::DOUBLE AS ra, "
        f"rank() OVER (PARTITION BY station, h, pair ORDER BY b DESC) + (count(*) OVER (PARTITION BY station, h, pair, b) - 1) / 2.0::DOUBLE AS rb FROM ({_pair_sql(pairs)})) GROUP BY station, h, pair"
    )


cte("pair_rho", _rho_sql(ranks.PAIRS))
_tops = ", ".join(f"(list(model ORDER BY {c} DESC, model) FILTER ({c} IS NOT NULL))[1] AS top_{m}" for m, c in _columns.items())
_names = [f"{a}_vs_{b}" for a, b in ranks.PAIRS]
_low = " OR ".join(f"coalesce({n} < 0.8, false)" for n in _names)
cte(
    "reversal",
    f"SELECT *, top_skill IS DISTINCT FROM top_kge AS top_skill_differs_from_top_kge, ({_low}) OR top_skill IS DISTINCT FROM top_kge AS rank_reversal_flag FROM ("
    f"SELECT station, h, {_tops}, min(station_name) AS station_name, min(station_type) AS station_type, min(station_class) AS station_class FROM ranked_cell GROUP BY station, h) "
    f"JOIN (SELECT station, h, {', '.join(f'max(rho) FILTER (pair = {chr(39)}{n}{chr(39)}) AS {n}' for n in _names)} FROM pair_rho GROUP BY station, h) USING (station, h)",
)


def ranked(s, d):
    """KGE table joined with skill and the station attributes, in the columns of the rankings."""
    from fcverify.sources.stations import station_dimension

    diag = T.stored_diagnostics(s, d)
    skill = diag.skill.select("dataset", "model", F.col("horizon").alias("h"), F.col("skill").alias("Skill_h"))
    joined = diag.kge.drop("horizon").join(skill, ["dataset", "model", "h"])
    return settle(station_dimension(joined, T.stations(s, d)).select(
        "station", "h", "model", "Skill_h", "phi_h", "r_h", "KGE_h", "KGE_skill_h", "station_name", "station_type", "station_class"
    ))


register("rank_correlation", "SELECT * FROM pair_rho", "rho")(lambda s, d: ranks.rank_correlation(ranked(s, d)))
register("top_model", f"SELECT station, h, {_tops} FROM ranked_cell GROUP BY station, h")(lambda s, d: ranks.top_model(ranked(s, d)))
register("rank_reversal_table", "SELECT * FROM reversal", " ".join(_names))(lambda s, d: ranks.rank_reversal_table(ranked(s, d)))
register(
    "rank_reversal_summary",
    " UNION ALL ".join(
        f"SELECT '{n}' AS aggregation, {c}::VARCHAR AS key, count(*) AS n_cells, avg(rank_reversal_flag::INTEGER) AS rank_reversal_rate, "
        f"avg(top_skill_differs_from_top_kge::INTEGER) AS top_skill_top_kge_mismatch_rate FROM reversal GROUP BY {c}"
        for c, n in (("h", "horizon"), ("top_kge", "top_kge_model"), ("station_class", "station_class"))
    ),
    "rank_reversal_rate top_skill_top_kge_mismatch_rate",
)(lambda s, d: ranks.rank_reversal_summary(ranks.rank_reversal_table(ranked(s, d))))
register(
    "complementarity_rule",
    "SELECT *, coalesce(skill_vs_kge_median < 0.8, false) OR coalesce(phi_vs_r_median < 0.8, false) OR reversal_rate >= 0.2 OR mismatch_count > 0 AS complementary FROM ("
    "SELECT median(skill_vs_kge) AS skill_vs_kge_median, median(phi_vs_r) AS phi_vs_r_median, avg(rank_reversal_flag::INTEGER) AS reversal_rate, "
    "count(*) FILTER (top_skill_differs_from_top_kge) AS mismatch_count FROM reversal)",
    "skill_vs_kge_median phi_vs_r_median reversal_rate",
)(lambda s, d: ranks.complementarity_rule(ranks.rank_reversal_table(ranked(s, d))))
_all_pairs = list(combinations(_columns, 2))
_half = f"SELECT pair, median(rho) AS rho FROM ({_rho_sql(_all_pairs)}) GROUP BY pair"
register(
    "metric_corr_matrix",
    f"SELECT split_part(pair, '_vs_', 1) AS left_metric, split_part(pair, '_vs_', 2) AS right_metric, rho FROM ({_half}) UNION ALL "
    f"SELECT split_part(pair, '_vs_', 2), split_part(pair, '_vs_', 1), rho FROM ({_half}) UNION ALL "
    f"SELECT m, m, 1.0::DOUBLE FROM (SELECT unnest({list(_columns)!r}) AS m)",
    "rho",
)(lambda s, d: ranks.metric_corr_matrix(ranked(s, d)))

_spear = {"alpha_vs_skill": ("alpha", "skill"), "alpha_vs_recall_p75": ("alpha", "recall_p75"), "skill_vs_recall_p75": ("skill", "recall_p75")}


def _spearman_sql(keys: str) -> str:
    rows = " UNION ALL ".join(
        f"SELECT model, horizon, '{n}' AS comparison, {a} AS a, {b} AS b FROM master_cell WHERE {a} IS NOT NULL AND {b} IS NOT NULL" for n, (a, b) in _spear.items()
    )
    part = f"PARTITION BY {keys}comparison"
    return (
        f"SELECT {keys}comparison, count(*) AS n, covar_pop(ra, rb) / nullif(stddev_pop(ra) * stddev_pop(rb), 0) AS spearman_rho FROM ("
        f"SELECT *, rank() OVER ({part} ORDER BY a) + (count(*) OVER ({part}, a) - 1) / 2.0::DOUBLE AS ra, "
        f"rank() OVER ({part} ORDER BY b) + (count(*) OVER ({part}, b) - 1) / 2.0::DOUBLE AS rb FROM ({rows})) GROUP BY {keys}comparison HAVING count(*) >= 5"
    )


def cells_with_recall(s, d):
    """Summary and event scores only; significance is not needed for the correlations."""
    diag = T.stored_diagnostics(s, d)
    return decisions.master_table(diag.summary, exceedance=diag.exceedance, types=diag.threshold_types)


register("spearman", _spearman_sql(""), "spearman_rho")(lambda s, d: stattests.spearman(cells_with_recall(s, d), _spear, (), 5).drop("p_value"))
register("spearman_by_model", _spearman_sql("model, "), "spearman_rho")(
    lambda s, d: stattests.spearman(cells_with_recall(s, d), _spear, ("model",), 5).drop("p_value")
)
# Two-sided p-value of t with n - 2 degrees of freedom as a finite cosine series.
_spearman_p = (
    "SELECT comparison, any_value(n) AS n, any_value(spearman_rho) AS spearman_rho, CASE WHEN any_value(nu) % 2 = 1 "
    "THEN 1 - 2 / pi() * (any_value(theta) + sin(any_value(theta)) * coalesce(sum(term), 0)) "
    "ELSE 1 - sin(any_value(theta)) * coalesce(sum(term), 0) END AS p_value FROM ("
    "SELECT *, CASE WHEN nu % 2 = 1 THEN exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(theta), 2 * j + 1) "
    "ELSE exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(theta), 2 * j) END AS term FROM ("
    "SELECT *, unnest(list_prepend(CAST(NULL AS BIGINT), CASE WHEN nu % 2 = 1 THEN range(0, (nu - 1) // 2) ELSE range(0, nu // 2) END)) AS j FROM ("
    "SELECT *, n - 2 AS nu, atan(abs(spearman_rho) / sqrt(1 - spearman_rho * spearman_rho)) AS theta "
    f"FROM ({_spearman_sql('')})))) GROUP BY comparison"
)
register("spearman_p_value", _spearman_p, "spearman_rho p_value")(lambda s, d: stattests.spearman(cells_with_recall(s, d), _spear, (), 5))


@register(
    "kge_with_master",
    "SELECT k.station, k.dataset, k.model, k.h, k.n, k.r_h, k.alpha_h, k.phi_h, k.beta_h, k.KGE_h, k.KGE_persistence_h, k.KGE_skill_h, s.skill AS Skill_h, s.mae_skill, s.skill_vp, "
    "s.alpha AS alpha_source, sqrt(s.alpha) AS phi_source_sqrt_alpha, abs(k.alpha_h - sqrt(s.alpha)) AS abs_alpha_h_minus_phi_source_sqrt_alpha, 0.0::DOUBLE AS abs_alpha_h_minus_phi_h "
    "FROM kge_cell k JOIN cell_summary s ON s.dataset = k.dataset AND s.model = k.model AND s.horizon = k.h",
    "r_h alpha_h phi_h beta_h KGE_h KGE_persistence_h KGE_skill_h Skill_h mae_skill skill_vp alpha_source phi_source_sqrt_alpha abs_alpha_h_minus_phi_source_sqrt_alpha abs_alpha_h_minus_phi_h",
)
def _kge_master(s, d):
    diag = T.diagnostics(s, d)
    return stattests.kge_with_master(diag.kge, diag.summary)


# ---- decisions -------------------------------------------------------------------

_rules = "dataset, model, horizon, station_type, skill, alpha, dm_significant, recall_p75, rule_a, rule_b, decision_change, reason_change"
register("decision_rules", f"SELECT {_rules} FROM rule_cell", "skill alpha recall_p75")(
    lambda s, d: T.ruled(s, d).select(*[c.strip() for c in _rules.split(",")])
)
register(
    "change_reason",
    "SELECT dataset, model, horizon, reason_change FROM rule_cell WHERE rule_a",
)(lambda s, d: T.ruled(s, d).filter("rule_a").select("dataset", "model", "horizon", "reason_change"))


def _stack_sql(source: str, dims, counts: str, overall: bool) -> str:
    parts = [f"SELECT 'overall' AS \"group\", 'all' AS label, {counts} FROM {source}"] if overall else []
    for column, name in dims:
        label = "'h' || horizon" if column == "horizon" else column
        parts.append(f"SELECT '{name}' AS \"group\", {label} AS label, {counts} FROM {source} GROUP BY {column}")
    return " UNION ALL ".join(parts)


register(
    "decision_summary",
    _stack_sql(
        "rule_cell", (("model", "model"), ("horizon", "horizon"), ("station_type", "station_type")),
        "count(*) FILTER (rule_a) AS rule_a_n, count(*) FILTER (rule_b) AS rule_b_n, count(*) FILTER (decision_change) AS decision_change_n, "
        "round(100.0::DOUBLE * count(*) FILTER (decision_change) / nullif(count(*) FILTER (rule_a), 0), 1) AS decision_change_pct_of_ruleA",
        True,
    ),
    "decision_change_pct_of_ruleA",
)(lambda s, d: decisions.decision_summary(T.ruled(s, d)))


def _sensitivity_sql(alphas, recalls) -> str:
    return (
        "SELECT *, round(100.0::DOUBLE * decision_change_n / nullif(rule_a_n, 0), 1) AS decision_change_pct, alpha_thresh = 0.5::DOUBLE AND recall_thresh = 0.2::DOUBLE AS \"primary\" FROM ("
        "SELECT alpha_thresh, recall_thresh, count(*) AS rule_a_n, count(*) FILTER (ok) AS pass_rule_b_n, count(*) FILTER (NOT ok) AS decision_change_n, "
        "count(*) FILTER (fa AND NOT fr) AS collapse_only_n, count(*) FILTER (NOT fa AND fr) AS recall_only_n, count(*) FILTER (fa AND fr) AS both_n FROM ("
        "SELECT a.alpha_thresh, r.recall_thresh, coalesce(alpha >= alpha_thresh, false) AND coalesce(recall_p75 >= recall_thresh, false) AS ok, "
        "coalesce(alpha < alpha_thresh, false) AS fa, coalesce(recall_p75 < recall_thresh, false) AS fr FROM rule_cell "
        f"CROSS JOIN (SELECT unnest({list(alphas)})::DOUBLE AS alpha_thresh) a CROSS JOIN (SELECT unnest({list(recalls)})::DOUBLE AS recall_thresh) r WHERE rule_a) GROUP BY alpha_thresh, recall_thresh)"
    )


_A3, _R3 = (0.3, 0.5, 0.7), (0.1, 0.2, 0.3)
_A9, _R7 = (0.3, 0.35, 0.4, 0.45, 0.5, 0.55, 0.6, 0.65, 0.7), (0.05, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35)
register("decision_sensitivity", _sensitivity_sql(_A3, _R3), "alpha_thresh recall_thresh decision_change_pct")(
    lambda s, d: decisions.decision_sensitivity(T.ruled(s, d))
)
register("decision_sensitivity_wide", _sensitivity_sql(_A9, _R7), "alpha_thresh recall_thresh decision_change_pct")(
    lambda s, d: decisions.decision_sensitivity(T.ruled(s, d), _A9, _R7)
)
register(
    "decision_sensitivity_pivot",
    "SELECT alpha_thresh, max(decision_change_pct) FILTER (recall_thresh = 0.1::DOUBLE) AS recall_10, max(decision_change_pct) FILTER (recall_thresh = 0.2::DOUBLE) AS recall_20, "
    f"max(decision_change_pct) FILTER (recall_thresh = 0.3::DOUBLE) AS recall_30 FROM ({_sensitivity_sql(_A3, _R3)}) GROUP BY alpha_thresh",
    "alpha_thresh recall_10 recall_20 recall_30",
)(lambda s, d: decisions.sensitivity_pivot(decisions.decision_sensitivity(T.ruled(s, d))))
_disc = "rule_a AND recall_p75 >= 0.2 AND alpha < 0.5"
register(
    "discordant_cells", f"SELECT dataset, model, horizon, skill, alpha, recall_p75 FROM rule_cell WHERE {_disc}", "skill alpha recall_p75",
)(lambda s, d: decisions.discordant_cells(T.ruled(s, d)).select("dataset", "model", "horizon", "skill", "alpha", "recall_p75"))
register(
    "discordant_cells_any_recall",
    "SELECT dataset, model, horizon, skill, alpha, recall_p75 FROM rule_cell WHERE rule_a AND recall_p75 >= 0 AND alpha < 0.5", "skill alpha recall_p75",
)(lambda s, d: decisions.discordant_cells(T.ruled(s, d), recall_min=0.0).select("dataset", "model", "horizon", "skill", "alpha", "recall_p75"))
register(
    "discordant_summary",
    _stack_sql(
        "rule_cell", (("dataset", "dataset"), ("model", "model"), ("horizon", "horizon"), ("station_type", "station_type")),
        f"count(*) AS n_total, count(*) FILTER (rule_a) AS n_rule_a, count(*) FILTER ({_disc}) AS n_discordant, "
        f"round(100.0::DOUBLE * count(*) FILTER ({_disc}) / nullif(count(*) FILTER (rule_a), 0), 1) AS pct_of_ruleA",
        False,
    ),
    "pct_of_ruleA",
)(lambda s, d: decisions.discordant_summary(T.ruled(s, d)))
register(
    "alpha_distribution",
    'SELECT count(alpha) AS count, avg(alpha) AS mean, stddev_samp(alpha) AS std, min(alpha) AS min, max(alpha) AS max, quantile_cont(alpha, 0.25) AS q25, '
    'quantile_cont(alpha, 0.5) AS q50, quantile_cont(alpha, 0.75) AS q75 FROM cell_summary',
    "mean std min max q25 q50 q75",
)(lambda s, d: decisions.distribution(T.diagnostics(s, d).summary, "alpha"))
register("top_discordant", "SELECT dataset, model, horizon, alpha FROM cell_summary WHERE alpha < 0.5 ORDER BY alpha DESC, dataset, model, horizon LIMIT 5", "alpha")(
    lambda s, d: ranks.top_discordant(T.diagnostics(s, d).summary.filter("alpha < 0.5"), 5).select("dataset", "model", "horizon", "alpha")
)
register(
    "failure_decomposition",
    "SELECT *, pass_rule_b + fail_alpha_only + fail_recall_only + fail_both = total_rule_a AS adds_up FROM (SELECT count(*) FILTER (NOT a AND NOT r) AS pass_rule_b, count(*) FILTER (a AND NOT r) AS fail_alpha_only, "
    "count(*) FILTER (NOT a AND r) AS fail_recall_only, count(*) FILTER (a AND r) AS fail_both, count(*) AS total_rule_a FROM "
    "(SELECT coalesce(alpha < 0.5, false) AS a, coalesce(recall_p75 < 0.2, false) AS r FROM rule_cell WHERE rule_a))",
)(lambda s, d: decisions.failure_decomposition(T.ruled(s, d)))


register("incremental_auc", None, "auc_without_alpha auc_with_alpha delta_auc")(
    lambda s, d: decisions.incremental_auc(decisions.decision_rules(T.master(s, d)))
)


def _family(s, d):
    diag = T.stored_diagnostics(s, d)
    return decisions.model_family_summary(
        decisions.master_table(diag.summary, diag.dm), diag.exceedance, diag.murphy, {"smooth": "contrast", "amplified": "contrast", "seasonal_naive": "naive"}
    )


register(
    "model_family_summary",
    "SELECT m.model, CASE WHEN m.model = 'seasonal_naive' THEN 'naive' ELSE 'contrast' END AS model_family, count(*) AS n_cells, median(skill) AS median_skill, median(m.alpha) AS median_alpha, median(skill_vp) AS median_skill_vp, "
    + ", ".join(
        f"count(*) FILTER ({c}) AS {n}_cells, 100.0::DOUBLE * count(*) FILTER ({c}) / count(*) AS {r}_rate_pct"
        for n, r, c in (
            ("collapsed", "collapse", "m.alpha < 0.5"), ("retained", "retained", "m.alpha >= 0.8"), ("positive_skill", "positive_skill", "skill > 0"),
            ("near_ideal", "near_ideal", "skill > 0 AND m.alpha BETWEEN 0.8 AND 1.2"),
        )
    )
    + ", count(*) FILTER (skill > 0 AND coalesce(dm_significant, false)) AS sig_imp_cells, count(*) FILTER (skill > 0 AND NOT coalesce(dm_significant, false)) AS ns_imp_cells, "
    "count(*) FILTER (skill < 0 AND coalesce(dm_significant, false)) AS sig_deg_cells, any_value(e.recall) AS median_exceedance_recall, any_value(e.csi) AS median_csi, any_value(e.far) AS median_far, "
    "any_value(u.mse) AS median_murphy_mse, any_value(u.b) AS median_murphy_bias_sq, any_value(u.c) AS median_murphy_cond_bias_sq, any_value(u.i) AS median_murphy_irreducible_sq "
    "FROM master_cell m LEFT JOIN (SELECT model, median(recall) AS recall, median(CASE WHEN f1 IS NULL THEN NULL WHEN f1 > 0 THEN f1 / (2 - f1) ELSE 0 END) AS csi, median(1 - precision) AS far "
    "FROM exceedance_cell GROUP BY model) e ON e.model = m.model LEFT JOIN (SELECT model, median(mse) AS mse, median(bias_sq) AS b, median(cond_bias_sq) AS c, median(irreducible_sq) AS i FROM murphy_cell GROUP BY model) u "
    "ON u.model = m.model GROUP BY m.model",
    "median_skill median_alpha median_skill_vp collapse_rate_pct retained_rate_pct positive_skill_rate_pct near_ideal_rate_pct median_exceedance_recall median_csi median_far "
    "median_murphy_mse:3 median_murphy_bias_sq:4 median_murphy_cond_bias_sq:3 median_murphy_irreducible_sq:3",
)(_family)
register(
    "quadrant_counts",
    "SELECT model, count(*) FILTER (skill > 0 AND alpha >= 0.5) AS positive_retained, count(*) FILTER (skill > 0 AND alpha < 0.5) AS positive_collapsed, "
    "count(*) FILTER (skill <= 0 AND alpha >= 0.5) AS negative_retained, count(*) FILTER (skill <= 0 AND alpha < 0.5) AS negative_collapsed FROM cell_summary GROUP BY model",
)(lambda s, d: decisions.quadrant_counts(T.diagnostics(s, d).summary))
_wide = [f"{m}_{t}" for m in decisions.EXCEEDANCE_METRICS for t in ("p75", "p90", "abs_50")]
register(
    "master_table", "SELECT * EXCLUDE (alpha_ci_low, alpha_ci_high) FROM master_cell",
    "skill mae_skill alpha skill_vp dm_pval_bh dm_stat bias_sq:4 cond_bias_sq:3 irreducible_sq:3 rho std_pred_ug:5 std_true_ug:5 " + " ".join(_wide),
)(lambda s, d: T.stored_diagnostics(s, d).master.drop("alpha_ci_low", "alpha_ci_high"))
register(
    "horizon_profiles",
    "SELECT model, horizon, avg(skill) AS mean, count(skill) AS n, median(skill) AS median, quantile_cont(skill, 0.02) AS low, quantile_cont(skill, 0.98) AS high FROM cell_summary GROUP BY model, horizon",
    "mean median low high",
)(lambda s, d: decisions.horizon_profiles(T.diagnostics(s, d).summary, "skill"))

# ---- regimes ---------------------------------------------------------------------

cte(
    "covariate",
    "SELECT event_type AS dataset, date_trunc('hour', ts)::TIMESTAMP AS ts, count(*)::DOUBLE AS wind_speed_ms, max(value) AS humidity_pct, count(DISTINCT user_id)::DOUBLE AS temp_c FROM events GROUP BY 1, 2",
)
cte("covariate_grid", "SELECT g.dataset, g.pos, g.ts, c.wind_speed_ms, c.humidity_pct, c.temp_c FROM hour_grid g LEFT JOIN covariate c USING (dataset, ts)")
cte(
    "target_threshold",
    "SELECT b.dataset, b.fold, h.horizon, quantile_cont(g.y, 0.75) AS event_threshold FROM rolling_bound b CROSS JOIN hourly_horizon h "
    "JOIN hour_grid g ON g.dataset = b.dataset AND g.pos - h.horizon < b.train_end AND g.pos - h.horizon >= 0 GROUP BY b.dataset, b.fold, h.horizon",
)
cte(
    "regime_cut",
    "SELECT b.dataset, b.fold, quantile_cont(c.wind_speed_ms, 0.5) AS wind, quantile_cont(c.humidity_pct, 0.5) AS humidity FROM rolling_bound b JOIN covariate_grid c ON c.dataset = b.dataset AND c.pos < b.train_end GROUP BY b.dataset, b.fold",
)
cte(
    "regime_row",
    "SELECT p.dataset, p.fold, p.pos, p.horizon, p.model, p.y_pred, p.y_persistence AS y_persist, p.y_true, p.origin_time AS origin_ts, p.target_time AS target_ts, t.event_threshold, "
    "c.wind_speed_ms, c.humidity_pct, c.temp_c, month(p.origin_time) AS origin_month, hour(p.origin_time) AS origin_hour, "
    "CASE WHEN month(p.origin_time) IN (12, 1, 2) THEN 'winter' WHEN month(p.origin_time) IN (3, 4, 5) THEN 'spring' WHEN month(p.origin_time) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS origin_season, "
    "CASE WHEN month(p.origin_time) BETWEEN 4 AND 9 THEN 'warm_season' ELSE 'cold_season' END AS warm_cold_season, "
    "CASE WHEN c.wind_speed_ms <= k.wind THEN 'low_ventilation' ELSE 'high_ventilation' END AS physical_ventilation_regime, "
    "CASE WHEN c.humidity_pct <= k.humidity THEN 'dry' ELSE 'humid' END AS physical_moisture_regime "
    "FROM rolling_pred p JOIN target_threshold t USING (dataset, fold, horizon) JOIN covariate_grid c ON c.dataset = p.dataset AND c.pos = p.pos JOIN regime_cut k ON k.dataset = p.dataset AND k.fold = p.fold",
)


def master_rows(s, d, grid=None):
    grid = T.hourly_grid(s, d) if grid is None else grid
    bounds = hourly.fold_bounds(grid)
    made = hourly.positional(hourly.hourly_predictions(grid))
    limits = events.train_thresholds(grid, bounds, {"event_threshold": 0.75}, hourly.HORIZONS)
    return regimes.prediction_master(settle(made), grid.select("dataset", "pos", "ts", "y"), limits, T.covariates(s, d))


def covariate_grid(s, d, grid=None):
    grid = series.grid_position(series.densify(T.events_hourly(s, d))) if grid is None else grid
    return regimes.align_covariates(grid.select("dataset", "pos", "ts"), T.covariates(s, d))


def regime_rows(s, d):
    grid = T.hourly_grid(s, d)
    return regimes.physical_regimes(settle(master_rows(s, d, grid)), covariate_grid(s, d, grid), hourly.fold_bounds(grid))


_master_columns = "dataset, fold, pos, horizon, model, y_pred, y_persist, y_true, origin_ts, target_ts, event_threshold, wind_speed_ms, origin_month, origin_hour, origin_season, warm_cold_season"
register(
    "prediction_master", f"SELECT {_master_columns} FROM regime_row", "y_pred y_persist y_true event_threshold wind_speed_ms", "origin_ts target_ts",
)(lambda s, d: master_rows(s, d).select(*[c.strip() for c in _master_columns.split(",")]))
register("align_covariates", "SELECT * FROM covariate_grid", "wind_speed_ms humidity_pct temp_c", "ts")(covariate_grid)
_physical = "dataset, fold, pos, horizon, model, physical_ventilation_regime, physical_moisture_regime, warm_cold_season AS physical_season_regime"
register("physical_regimes", f"SELECT {_physical} FROM regime_row")(
    lambda s, d: regime_rows(s, d).select("dataset", "fold", "pos", "horizon", "model", "physical_ventilation_regime", "physical_moisture_regime", "physical_season_regime")
)


def _regime_sql(schemes) -> str:
    rows = " UNION ALL ".join(
        f"SELECT '{kind}' AS scheme_type, '{name}' AS scheme_name, {column} AS regime, dataset, model, horizon, y_true, y_pred, y_persist, event_threshold AS thr FROM regime_row"
        for kind, name, column in schemes
    )
    return (
        "SELECT 'rolling_origin' AS protocol, dataset AS station, scheme_type, scheme_name, regime, model, horizon, n AS sample_count, e AS event_count, "
        "CASE WHEN n >= 40 THEN rm END AS rmse, CASE WHEN n >= 40 THEN ma END AS mae, CASE WHEN n >= 40 THEN rp END AS rmse_persistence, "
        "CASE WHEN n >= 40 THEN 1 - rm / nullif(rp, 0) END AS skill_rmse, CASE WHEN n >= 40 THEN vo END AS var_obs, CASE WHEN n >= 40 THEN vp END AS var_pred, "
        "CASE WHEN n >= 40 THEN 100 * vp / nullif(vo, 0) END AS vr, CASE WHEN n >= 40 THEN (1 - rm / nullif(rp, 0)) * CASE WHEN vo > 0 THEN least(1.0, vp / vo) END END AS skill_vp, "
        "e / n::DOUBLE AS base_rate, CASE WHEN n >= 40 AND e >= 5 THEN tp / nullif(e, 0)::DOUBLE END AS event_recall, CASE WHEN n >= 40 AND e >= 5 THEN tp / nullif(f, 0)::DOUBLE END AS event_precision, "
        "f / n::DOUBLE AS flag_rate, n < 40 AS insufficient_samples, e < 5 AS insufficient_events FROM ("
        "SELECT dataset, scheme_type, scheme_name, regime, model, horizon, count(*) AS n, count(*) FILTER (y_true > thr) AS e, count(*) FILTER (y_pred > thr) AS f, count(*) FILTER (y_true > thr AND y_pred > thr) AS tp, "
        "sqrt(avg((y_true - y_pred) * (y_true - y_pred))) AS rm, avg(abs(y_true - y_pred)) AS ma, sqrt(avg((y_true - y_persist) * (y_true - y_persist))) AS rp, var_pop(y_true) AS vo, var_pop(y_pred) AS vp "
        f"FROM ({rows}) GROUP BY dataset, scheme_type, scheme_name, regime, model, horizon)"
    )


cte("regime_skill", _regime_sql((
    ("overall", "overall", "'all'"), ("physical", "ventilation", "physical_ventilation_regime"), ("physical", "moisture", "physical_moisture_regime"), ("physical", "season", "warm_cold_season"))))
cte("regime_season", _regime_sql((("seasonal", "warm_cold", "warm_cold_season"), ("seasonal", "four_seasons", "origin_season"))))
REGIME_DIGITS = "rmse mae rmse_persistence skill_rmse var_obs:4 var_pred:4 vr:4 skill_vp base_rate event_recall event_precision flag_rate"


def regime_summary(s, d):
    return regimes.regime_skill_summary(regime_rows(s, d))


register("regime_metrics", _regime_sql((("overall", "overall", "'all'"),)), REGIME_DIGITS)(lambda s, d: regimes.regime_metrics(master_rows(s, d), [regimes.OVERALL]))
register("regime_skill_summary", "SELECT * FROM regime_skill", REGIME_DIGITS)(regime_summary)
register("regime_event_summary", f"SELECT {', '.join(regimes.EVENT_COLUMNS)} FROM regime_skill", "base_rate event_recall event_precision flag_rate")(
    lambda s, d: regimes.regime_event_summary(regime_summary(s, d))
)
register("seasonal_skill_summary", "SELECT * FROM regime_season", REGIME_DIGITS)(lambda s, d: regimes.seasonal_skill_summary(master_rows(s, d)))
register(
    "support_table",
    "SELECT scheme_name, regime, horizon, max(sample_count) AS sample_count, max(CASE WHEN insufficient_samples THEN 'low_support' ELSE 'ok' END) AS support_flag FROM regime_skill "
    "WHERE scheme_type = 'physical' GROUP BY ALL",
)(lambda s, d: regimes.support_table(regime_summary(s, d)))
register(
    "regime_pivot",
    "SELECT station, scheme_name, regime, model, " + ", ".join(f"avg(vr) FILTER (horizon = {h}) AS h{h}" for h in hourly.HORIZONS) + " FROM regime_skill GROUP BY station, scheme_name, regime, model",
    " ".join(f"h{h}:4" for h in hourly.HORIZONS),
)(lambda s, d: regimes.regime_pivot(regime_summary(s, d), "vr", hourly.HORIZONS, ["station", "scheme_name", "regime", "model"]))
_worst = (
    "(SELECT '{f}' AS finding, {v} AS value, scheme_name, regime, model, horizon FROM {t} WHERE {w} ORDER BY {o}, scheme_name, regime, model, horizon LIMIT 1)"
)
register(
    "worst_case_findings",
    " UNION ALL ".join([
        _worst.format(f="min_variance_retention", v="vr", t="regime_skill", w="NOT insufficient_samples AND scheme_type <> 'overall' AND vr IS NOT NULL", o="vr"),
        _worst.format(f="max_skill_gap", v="skill_rmse - skill_vp", t="regime_skill", w="NOT insufficient_samples AND scheme_type <> 'overall' AND vr IS NOT NULL AND skill_rmse > 0 AND skill_vp IS NOT NULL", o="skill_vp - skill_rmse"),
        _worst.format(f="min_event_recall", v="event_recall", t="regime_skill", w="NOT insufficient_samples AND NOT insufficient_events AND scheme_type <> 'overall' AND event_recall IS NOT NULL", o="event_recall"),
        _worst.format(f="min_seasonal_skill_vp", v="skill_vp", t="regime_season", w="NOT insufficient_samples AND scheme_name = 'warm_cold' AND skill_vp IS NOT NULL", o="skill_vp"),
    ]),
    "value:4",
)(lambda s, d: ranks.worst_case_findings(regime_summary(s, d), regimes.seasonal_skill_summary(master_rows(s, d))))
register(
    "seasonal_rank",
    "SELECT station, regime, model, horizon, skill_vp, row_number() OVER (PARTITION BY station, model, horizon ORDER BY skill_vp, regime) AS rank FROM regime_season "
    "WHERE NOT insufficient_samples AND scheme_name = 'warm_cold' AND skill_vp IS NOT NULL",
    "skill_vp",
)(lambda s, d: ranks.seasonal_rank(regimes.seasonal_skill_summary(master_rows(s, d)), ["station", "model", "horizon"]).select("station", "regime", "model", "horizon", "skill_vp", "rank"))


def _clusters(s, d, k=3):
    grid = T.hourly_grid(s, d)
    return regimes.cluster_regimes(covariate_grid(s, d, grid), hourly.fold_bounds(grid), range(5), k, ["wind_speed_ms", "humidity_pct", "temp_c"])


register("cluster_regimes")(lambda s, d: _clusters(s, d)[0])
register(
    "cluster_label_counts",
    "SELECT g.dataset, CAST(b.fold AS INTEGER) AS fold, count(*) AS n_rows FROM hour_grid g JOIN rolling_bound b "
    "ON b.dataset = g.dataset AND g.pos >= b.train_end AND g.pos < b.test_end GROUP BY ALL",
)(lambda s, d: _clusters(s, d)[0].filter("cluster_k3_regime IS NOT NULL").groupBy("dataset", F.col("fold").cast("int").alias("fold")).agg(F.count(F.lit(1)).alias("n_rows")))

# Fixed centres: the mean covariates of each event type; fixed cuts.
_CUTS = {"wind_speed_ms": (2.0, 2.8), "humidity_pct": (100.0, 150.0), "temp_c": (2.0, 2.8)}


def _given_centres(s, d):
    return T.covariates(s, d).groupBy(F.col("dataset").alias("cluster")).agg(*[F.round(F.avg(c), 6).alias(c) for c in _CUTS])


register(
    "label_given_centres",
    "SELECT * EXCLUDE (words), 'cluster_' || cluster || '_' || CASE WHEN len(words) > 0 THEN array_to_string(words, '_') ELSE 'cluster_' || cluster END AS label FROM ("
    "SELECT *, list_filter(["
    + ", ".join(
        f"CASE WHEN {c} <= {_CUTS[c][0]} THEN '{low}' WHEN {c} >= {_CUTS[c][1]} THEN '{high}' END"
        for c, low, high in (("wind_speed_ms", "calm", "ventilated"), ("humidity_pct", "dry", "humid"), ("temp_c", "cool", "warm"))
    )
    + "], lambda x: x IS NOT NULL) AS words FROM (SELECT dataset AS cluster, round(avg(wind), 6) AS wind_speed_ms, round(avg(humid), 6) AS humidity_pct, "
    "round(avg(temp), 6) AS temp_c FROM (SELECT event_type AS dataset, count(*)::DOUBLE AS wind, max(value) AS humid, count(DISTINCT user_id)::DOUBLE AS temp "
    "FROM events GROUP BY event_type, date_trunc('hour', ts)) GROUP BY dataset))",
    "wind_speed_ms:5 humidity_pct:5 temp_c:5",
)(lambda s, d: regimes.label_clusters(_given_centres(s, d), list(_CUTS), _CUTS))
register("label_clusters", None, "wind_speed_ms humidity_pct temp_c")(lambda s, d: _clusters(s, d, 4)[1])


@register("clustered_skill_summary", None, REGIME_DIGITS)
def _clustered(s, d):
    labels, _ = _clusters(s, d)
    rows = regime_rows(s, d).join(labels, ["dataset", "fold", "pos"], "left").fillna("unavailable", ["cluster_k3_regime"])
    return regimes.regime_skill_summary(rows, (3,))


# ---- quality ---------------------------------------------------------------------

_null_columns = ("dataset", "date", "y")
register(
    "null_profile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) AS n_rows, count(*) FILTER ({c} IS NULL) AS n_null, 100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) AS null_pct, "
        f"100.0::DOUBLE * count(*) FILTER ({c} IS NULL) / count(*) > 10 AS warn FROM orders_dense" for c in _null_columns
    ),
    "null_pct",
)(lambda s, d: quality.null_profile(series.densify(T.orders_daily(s, d)), _null_columns))
register("duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")(
    lambda s, d: quality.duplicate_keys(T.table(s, d, "lineitem"), ["l_orderkey", "l_linenumber"])
)
register("assert_unique", "SELECT 0 AS n_duplicated")(lambda s, d: quality.assert_unique(T.predictions(s, d), ["dataset", "model", "horizon", "origin_date"]))
register(
    "reconcile",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(*) FILTER (a.dataset IS NOT NULL AND b.dataset IS NOT NULL) AS n_matched, count(*) FILTER (b.dataset IS NULL) AS n_only_recomputed, "
        f"count(*) FILTER (a.dataset IS NULL) AS n_only_published, max(abs(a.{c} - b.{c})) AS max_abs_diff, max(abs(a.{c} - b.{c}) / nullif(abs(b.{c}), 0)) AS max_rel_diff, "
        f"count(*) FILTER (a.dataset IS NOT NULL AND b.dataset IS NOT NULL AND NOT coalesce(abs(a.{c} - b.{c}) <= 1e-9 + 1e-9 * abs(b.{c}), false)) AS n_out_of_tolerance "
        "FROM (SELECT * FROM cell_skill WHERE horizon <= 6) a FULL JOIN (SELECT dataset, model, horizon, CASE WHEN horizon = 3 THEN skill + 0.01 ELSE skill END AS skill, mae_skill FROM cell_skill WHERE horizon >= 2) b "
        "ON a.dataset = b.dataset AND a.model = b.model AND a.horizon = b.horizon" for c in ("skill", "mae_skill")
    ),
    "max_abs_diff max_rel_diff:4",
)(lambda s, d: quality.reconcile(
    T.diagnostics(s, d).skill.filter("horizon <= 6"),
    T.diagnostics(s, d).skill.filter("horizon >= 2").withColumn("skill", F.when(F.col("horizon") == 3, F.col("skill") + 0.01).otherwise(F.col("skill"))),
    metrics.CELL, ["skill", "mae_skill"]))
register(
    "lead_time_check",
    "SELECT dataset, CAST(fold AS INTEGER) AS fold, count(*) FILTER (datediff('hour', origin_time, target_time) <> horizon) AS wrong_lead, count(DISTINCT p75_train) AS n_thresholds FROM rolling_pred GROUP BY dataset, fold",
)(lambda s, d: quality.lead_time_check(T.hourly_predictions(s, d)))
register(
    "truth_consistency",
    "SELECT dataset, count(*) AS n_dates, count(*) FILTER (spread > 0) AS n_inconsistent FROM (SELECT dataset, date, max(y_true) - min(y_true) AS spread FROM pred GROUP BY ALL) GROUP BY dataset",
)(lambda s, d: quality.truth_consistency(T.predictions(s, d)))
register(
    "length_consistency",
    "SELECT dataset, horizon, min(n) AS min_n, max(n) AS max_n, min(n) = max(n) AS equal_lengths FROM (SELECT dataset, horizon, model, count(*) AS n FROM pred GROUP BY ALL) GROUP BY dataset, horizon",
)(lambda s, d: quality.length_consistency(T.predictions(s, d)))


@register(
    "expected_counts",
    "SELECT 'All models' AS grp, count(*) FILTER (alpha < 0.5) AS collapsed_cells, count(*) AS total_cells, count(*) FILTER (alpha < 0.5) AS exp_collapsed_cells, 64 AS exp_total_cells FROM cell_summary",
)
def _expected(s, d):
    """The computed table against a copy in which the total of one group is off by one."""
    found = variance.group_collapse_rates(T.diagnostics(s, d).summary, T.GROUPS, (0.5,)).select(
        F.col("group").alias("grp"), "collapsed_cells", "total_cells"
    )
    off = F.when(F.col("grp") == "All models", 1).otherwise(0)
    copy = found.withColumn("total_cells", F.col("total_cells") + off)
    return quality.compare_expected(found, copy, ["grp"], ["collapsed_cells", "total_cells"])
