"""Series and evaluation tables built on the supplied tables, in Spark and in SQL.

Amounts are summed as integers (cents), so sums do not depend on row order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fcverify.catalog.base import cte
from fcverify.operators import decisions, forecast
from fcverify.operators.series import truncate_hour
from fcverify.plans import daily, hourly
from fcverify.session import settle
from fcverify.sources.readers import read_series
from fcverify.sources.stations import station_dimension

MODELS = ["persistence", "seasonal_naive", "smooth", "amplified"]
CONTRASTS = ["amplified", "seasonal_naive", "smooth"]
GROUPS = {"Contrasts": ["smooth", "amplified"], "Seasonal naive": ["seasonal_naive"], "All models": CONTRASTS}
# Fixed threshold of the daily exceedance table, in the units of the series.
FIXED = 200.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return read_series(spark, f"{sf_dir}/{name}.parquet")


def ship_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_returnflag").alias("dataset"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("y")
    )


def orders_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "orders")
    return rows.groupBy(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").cast("date").alias("date")).agg(
        (F.sum(F.round(F.col("o_totalprice") * 100).cast("long")) / 100000.0).alias("y")
    )


def events_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events")
    hour = truncate_hour("ts")
    return rows.groupBy(F.col("event_type").alias("dataset"), hour.alias("ts")).agg(
        (F.sum(F.round(F.col("value") * 100).cast("long")) / 100.0 / F.count(F.lit(1))).alias("y")
    )


def covariates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly covariates per event type: number of events, distinct users and the largest value."""
    rows = table(spark, sf_dir, "events")
    hour = truncate_hour("ts")
    return rows.groupBy(F.col("event_type").alias("dataset"), hour.alias("ts")).agg(
        F.count(F.lit(1)).cast("double").alias("wind_speed_ms"),
        F.max("value").alias("humidity_pct"),
        F.countDistinct("user_id").cast("double").alias("temp_c"),
    )


def stations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Station dimension from nation and region; ids are letters, as the return flags are."""
    nation, region = table(spark, sf_dir, "nation"), table(spark, sf_dir, "region")
    key = F.col("r_regionkey")
    kind = (
        F.when(key == 0, "Urban/Traffic").when(key == 1, "Rural Remote").when(key == 2, "Suburban/Industrial")
        .when(key == 3, "Rural Near-city/Industrial").otherwise("Urban/Background")
    )
    return nation.join(region, nation.n_regionkey == region.r_regionkey).select(
        F.expr("chr(65 + n_nationkey)").alias("station_id"),
        F.col("n_name").alias("station_name"),
        F.col("r_name").alias("province"),
        kind.alias("station_type"),
        (F.col("n_nationkey") * F.lit(1.5)).alias("lat"),
        (key * F.lit(10.0)).alias("lon"),
        (F.col("n_nationkey") * F.lit(10)).alias("altitude_m"),
        F.concat(F.lit("D"), F.col("n_nationkey").cast("string")).alias("dem_code"),
    )


def predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return daily.naive_predictions(settle(ship_daily(spark, sf_dir)))


def supplier_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One series per supplier: the number of series and rows grows with the tables."""
    rows = table(spark, sf_dir, "lineitem")
    return rows.groupBy(F.col("l_suppkey").cast("string").alias("dataset"), F.col("l_shipdate").cast("date").alias("date")).agg(
        F.sum("l_quantity").alias("y")
    )


SUPPLIER_HORIZONS = (1, 7)


def supplier_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = forecast.naive_wide(supplier_daily(spark, sf_dir), SUPPLIER_HORIZONS)
    y, mean = F.col("y"), F.col("mean_y")
    return forecast.stack_models(wide, {"persistence": y, "smooth": 0.3 * y + 0.7 * mean, "amplified": mean + 1.5 * (y - mean)}).filter(
        F.col("y_true").isNotNull() & F.col("y_pred").isNotNull()
    )


def diagnostics(spark: SparkSession, sf_dir: str) -> daily.DailyDiagnostics:
    return daily.DailyDiagnostics(predictions(spark, sf_dir), fixed=(("abs_50", FIXED),))


def stored_diagnostics(spark: SparkSession, sf_dir: str) -> daily.DailyDiagnostics:
    """For queries that read the predictions several times: they are written out once."""
    return daily.DailyDiagnostics(settle(predictions(spark, sf_dir)), fixed=(("abs_50", FIXED),), shared=True)


def master(spark: SparkSession, sf_dir: str) -> DataFrame:
    return settle(station_dimension(stored_diagnostics(spark, sf_dir).master, stations(spark, sf_dir)))


def ruled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decisions.decision_rules(master(spark, sf_dir))


def hourly_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hourly.prepared(events_hourly(spark, sf_dir))


def hourly_predictions(spark: SparkSession, sf_dir: str, protocol: str = "rolling_origin") -> DataFrame:
    return hourly.hourly_predictions(hourly_grid(spark, sf_dir), protocol)


def hourly_bounds(spark: SparkSession, sf_dir: str, protocol: str = "rolling_origin") -> DataFrame:
    return hourly.fold_bounds(hourly_grid(spark, sf_dir), protocol)



# ---- SQL -------------------------------------------------------------------

cte("ship", "SELECT l_returnflag AS dataset, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2")
cte(
    "orders_day",
    "SELECT o_orderpriority AS dataset, CAST(o_orderdate AS DATE) AS date, "
    "sum(CAST(round(o_totalprice * 100) AS BIGINT))::DOUBLE / 100000.0 AS y FROM orders GROUP BY 1, 2",
)
cte(
    "event_hour",
    "SELECT event_type AS dataset, date_trunc('hour', ts)::TIMESTAMP AS ts, "
    "sum(CAST(round(value * 100) AS BIGINT))::DOUBLE / 100.0 / count(*) AS y FROM events GROUP BY 1, 2",
)
cte(
    "orders_dense",
    "SELECT g.dataset, g.date, datediff('day', DATE '1970-01-01', g.date) AS idx, o.y FROM "
    "(SELECT dataset, CAST(unnest(generate_series(min(date), max(date), INTERVAL 1 DAY)) AS DATE) AS date "
    "FROM orders_day GROUP BY dataset) g LEFT JOIN orders_day o USING (dataset, date)",
)
cte(
    "hour_grid",
    "SELECT g.dataset, g.ts, datediff('hour', TIMESTAMP '1970-01-01', g.ts) AS idx, e.y, "
    "row_number() OVER (PARTITION BY g.dataset ORDER BY g.ts) - 1 AS pos, count(*) OVER (PARTITION BY g.dataset) AS n_rows FROM "
    "(SELECT dataset, unnest(generate_series(min(ts), max(ts), INTERVAL 1 HOUR)) AS ts FROM event_hour GROUP BY dataset) g "
    "LEFT JOIN event_hour e USING (dataset, ts)",
)
cte(
    "hour_fill",
    "SELECT *, last_value(y IGNORE NULLS) OVER w AS y_causal, sum(y) OVER w / count(y) OVER w AS mean_y FROM hour_grid "
    "WINDOW w AS (PARTITION BY dataset ORDER BY ts ROWS UNBOUNDED PRECEDING)",
)
cte("daily_horizon", "SELECT CAST(unnest(range(1, 8)) AS INTEGER) AS horizon")
cte("hourly_horizon", "SELECT CAST(unnest([1, 6, 24, 48]) AS INTEGER) AS horizon")
cte(
    "ship_wide",
    "SELECT o.dataset, o.date AS origin_date, o.horizon, t.date, t.y AS y_true, o.y, o.mean_y, o.seasonal FROM ("
    "SELECT s.*, h.horizon, coalesce(lag(s.y, 7 - h.horizon) OVER (PARTITION BY s.dataset, h.horizon ORDER BY s.date), s.y) AS seasonal FROM ("
    "SELECT dataset, date, y, sum(y) OVER w / count(*) OVER w AS mean_y FROM ship "
    "WINDOW w AS (PARTITION BY dataset ORDER BY date ROWS UNBOUNDED PRECEDING)) s CROSS JOIN daily_horizon h) o "
    "JOIN ship t ON t.dataset = o.dataset AND t.date = o.date + o.horizon",
)
cte(
    "pred",
    " UNION ALL ".join(
        f"SELECT dataset, '{m}' AS model, CAST(origin_date AS VARCHAR) AS fold, origin_date, horizon, date, y_true, {e} AS y_pred FROM ship_wide"
        for m, e in (
            ("persistence", "y"),
            ("seasonal_naive", "seasonal"),
            ("smooth", "0.3::DOUBLE * y + 0.7::DOUBLE * mean_y"),
            ("amplified", "mean_y + 1.5::DOUBLE * (y - mean_y)"),
        )
    ),
)
cte(
    "supplier_day",
    "SELECT CAST(l_suppkey AS VARCHAR) AS dataset, CAST(l_shipdate AS DATE) AS date, sum(l_quantity) AS y FROM lineitem GROUP BY 1, 2",
)
cte(
    "supplier_wide",
    "SELECT o.dataset, h.horizon, t.y AS y_true, o.y, o.mean_y FROM (SELECT dataset, date, y, sum(y) OVER w / count(*) OVER w AS mean_y "
    "FROM supplier_day WINDOW w AS (PARTITION BY dataset ORDER BY date ROWS UNBOUNDED PRECEDING)) o "
    "CROSS JOIN (SELECT CAST(unnest([1, 7]) AS INTEGER) AS horizon) h "
    "JOIN supplier_day t ON t.dataset = o.dataset AND t.date = o.date + h.horizon",
)
cte(
    "supplier_pred",
    " UNION ALL ".join(
        f"SELECT dataset, '{m}' AS model, horizon, y_true, {e} AS y_pred, y AS y_base FROM supplier_wide"
        for m, e in (
            ("persistence", "y"),
            ("smooth", "0.3::DOUBLE * y + 0.7::DOUBLE * mean_y"),
            ("amplified", "mean_y + 1.5::DOUBLE * (y - mean_y)"),
        )
    ),
)
cte(
    "paired",
    "SELECT * EXCLUDE (n_base) FROM (SELECT *, max(CASE WHEN model = 'persistence' THEN y_pred END) OVER w AS y_base, "
    "count(CASE WHEN model = 'persistence' THEN 1 END) OVER w AS n_base FROM pred WINDOW w AS (PARTITION BY dataset, horizon, origin_date, date)) "
    "WHERE model <> 'persistence' AND n_base > 0",
)
cte(
    "cell_skill",
    "SELECT dataset, model, horizon, count(*) AS n_pairs, "
    "1 - sqrt(avg((y_true - y_pred) * (y_true - y_pred))) / nullif(sqrt(avg((y_true - y_base) * (y_true - y_base))), 0) AS skill, "
    "1 - avg(abs(y_true - y_pred)) / nullif(avg(abs(y_true - y_base)), 0) AS mae_skill FROM paired GROUP BY ALL",
)
cte(
    "cell_alpha",
    "SELECT dataset, model, horizon, count(*) AS n, coalesce(var_pop(y_pred) / nullif(var_pop(y_true), 0), 0.0) AS alpha FROM pred GROUP BY ALL",
)
cte(
    "cell_summary",
    "SELECT a.dataset, a.model, a.horizon, a.n, s.skill, s.mae_skill, a.alpha, CAST(NULL AS DOUBLE) AS alpha_ci_low, "
    "CAST(NULL AS DOUBLE) AS alpha_ci_high, s.skill * a.alpha AS skill_vp, coalesce(a.alpha < 0.5, false) AS collapse_flag, "
    "coalesce(a.alpha > 1.5, false) AS inflation_flag, coalesce(s.skill > 0 AND a.alpha BETWEEN 0.8 AND 1.2, false) AS near_ideal_flag, "
    "a.n < 30 AS low_sample_flag FROM cell_alpha a JOIN cell_skill s USING (dataset, model, horizon)",
)
cte(
    "loss_row",
    "SELECT dataset, model, horizon, date, (y_true - y_base) * (y_true - y_base) - (y_true - y_pred) * (y_true - y_pred) AS d FROM paired",
)
cte(
    "loss_centred",
    "SELECT dataset, model, horizon, date, d - avg(d) OVER (PARTITION BY dataset, model, horizon) AS c, "
    "avg(d) OVER (PARTITION BY dataset, model, horizon) AS m FROM loss_row",
)
cte(
    "loss_autocov",
    "SELECT dataset, model, horizon, count(*) AS n, any_value(m) AS m, avg(c * c) AS g0, "
    + ", ".join(f"coalesce(avg(c * c{k}), 0) AS g{k}" for k in range(1, 7))
    + " FROM (SELECT *, "
    + ", ".join(f"lag(c, {k}) OVER w AS c{k}" for k in range(1, 7))
    + " FROM loss_centred WINDOW w AS (PARTITION BY dataset, model, horizon ORDER BY date)) GROUP BY dataset, model, horizon",
)
cte(
    "dm_stat_cell",
    "SELECT dataset, model, horizon, n AS n_pairs, CASE WHEN n > greatest(2, horizon) AND v > 0 AND k > 0 "
    "THEN m / sqrt(CASE WHEN v > 0 THEN v END) * sqrt(CASE WHEN k > 0 THEN k END) END AS dm_stat FROM (SELECT *, (g0"
    + "".join(f" + CASE WHEN horizon > {k} THEN 2 * g{k} ELSE 0 END" for k in range(1, 7))
    + ") / n AS v, (n + 1 - 2 * horizon + horizon * (horizon - 1) / n::DOUBLE) / n AS k FROM loss_autocov)",
)
# Two-sided p-value of Student's t for integer degrees of freedom as a finite cosine series.
cte(
    "dm_pval",
    "SELECT s.dataset, s.model, s.horizon, CASE WHEN any_value(nu) % 2 = 1 "
    "THEN 1 - 2 / pi() * (any_value(theta) + sin(any_value(theta)) * coalesce(sum(term), 0)) "
    "ELSE 1 - sin(any_value(theta)) * coalesce(sum(term), 0) END AS p FROM ("
    "SELECT t.*, CASE WHEN nu % 2 = 1 THEN exp(lgamma(j + 1) + lgamma(1.5) - lgamma(j + 1.5)) * pow(cos(theta), 2 * j + 1) "
    "ELSE exp(lgamma(j + 0.5) - lgamma(0.5) - lgamma(j + 1)) * pow(cos(theta), 2 * j) END AS term FROM ("
    "SELECT *, unnest(CASE WHEN nu % 2 = 1 THEN range(0, (nu - 1) // 2) ELSE range(0, nu // 2) END) AS j FROM ("
    "SELECT dataset, model, horizon, n_pairs - 1 AS nu, atan(abs(dm_stat) / sqrt((n_pairs - 1)::DOUBLE)) AS theta "
    "FROM dm_stat_cell WHERE dm_stat IS NOT NULL)) t) s GROUP BY s.dataset, s.model, s.horizon",
)
cte(
    "dm_cell",
    "SELECT dataset, model, horizon, n_pairs, dm_stat, dm_pval_raw, dm_pval_bh, coalesce(dm_pval_bh < 0.05, false) AS dm_significant FROM ("
    "SELECT *, CASE WHEN dm_pval_raw IS NOT NULL THEN least(1.0, min(dm_pval_raw * m / r) OVER (PARTITION BY dataset ORDER BY r "
    "ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)) END AS dm_pval_bh FROM ("
    "SELECT s.*, p.p AS dm_pval_raw, count(p.p) OVER (PARTITION BY dataset) AS m, "
    "row_number() OVER (PARTITION BY dataset ORDER BY p.p ASC NULLS LAST, model, horizon) AS r "
    "FROM dm_stat_cell s LEFT JOIN dm_pval p USING (dataset, model, horizon)))",
)
cte(
    "murphy_cell",
    "SELECT dataset, model, horizon, mse, (mp - mt) * (mp - mt) AS bias_sq, (sp - rho * st) * (sp - rho * st) AS cond_bias_sq, "
    "(1 - rho * rho) * vt AS irreducible_sq, rho, sp AS std_pred_ug, st AS std_true_ug, coalesce((sp / nullif(st, 0)) * (sp / nullif(st, 0)), 0) AS alpha FROM ("
    "SELECT *, coalesce(c / nullif(st * sp, 0), 0) AS rho FROM (SELECT dataset, model, horizon, avg((y_pred - y_true) * (y_pred - y_true)) AS mse, "
    "avg(y_true) AS mt, avg(y_pred) AS mp, var_pop(y_true) AS vt, stddev_pop(y_true) AS st, stddev_pop(y_pred) AS sp, "
    "covar_pop(y_pred, y_true) AS c FROM pred GROUP BY dataset, model, horizon))",
)
cte(
    "history",
    "SELECT dataset, date, quantile_cont(y, 0.75) OVER w AS p75, quantile_cont(y, 0.9) OVER w AS p90 FROM "
    "(SELECT dataset, date, min(y_true) AS y FROM pred GROUP BY dataset, date) "
    "WINDOW w AS (PARTITION BY dataset ORDER BY date ROWS UNBOUNDED PRECEDING)",
)
cte(
    "origin_threshold",
    "SELECT o.dataset, o.origin_date, h.p75, h.p90 FROM (SELECT DISTINCT dataset, origin_date FROM pred) o "
    "ASOF LEFT JOIN history h ON h.dataset = o.dataset AND h.date <= o.origin_date",
)
cte(
    "exceedance_row",
    "SELECT p.dataset, p.model, p.horizon, x.threshold_type, CASE x.threshold_type WHEN 'p75' THEN t.p75 WHEN 'p90' THEN t.p90 "
    f"ELSE {FIXED} END AS thr, p.y_true, p.y_pred FROM pred p JOIN origin_threshold t USING (dataset, origin_date) "
    "CROSS JOIN (SELECT unnest(['p75', 'p90', 'abs_50']) AS threshold_type) x",
)
cte(
    "exceedance_cell",
    "SELECT dataset, model, horizon, threshold_type, threshold_value, recall, precision, "
    "CASE WHEN precision + recall > 0 THEN 2 * precision * recall / (precision + recall) END AS f1, flag_rate, base_rate FROM ("
    "SELECT dataset, model, horizon, threshold_type, avg(thr) AS threshold_value, "
    "count(*) FILTER (y_true > thr AND y_pred > thr) / nullif(count(*) FILTER (y_true > thr), 0)::DOUBLE AS recall, "
    "count(*) FILTER (y_true > thr AND y_pred > thr) / nullif(count(*) FILTER (y_pred > thr), 0)::DOUBLE AS precision, "
    "count(*) FILTER (y_pred > thr) / count(*)::DOUBLE AS flag_rate, count(*) FILTER (y_true > thr) / count(*)::DOUBLE AS base_rate "
    "FROM exceedance_row WHERE thr IS NOT NULL GROUP BY ALL)",
)
cte(
    "kge_part",
    "SELECT dataset, model, horizon, n, r_h, alpha_h, beta_h, 1 - sqrt((r_h - 1) * (r_h - 1) + (alpha_h - 1) * (alpha_h - 1) + (beta_h - 1) * (beta_h - 1)) AS kge_h FROM ("
    "SELECT dataset, model, horizon, count(*) AS n, covar_pop(y_pred, y_true) / nullif(stddev_pop(y_pred) * stddev_pop(y_true), 0) AS r_h, "
    "stddev_pop(y_pred) / nullif(stddev_pop(y_true), 0) AS alpha_h, avg(y_pred) / nullif(avg(y_true), 0) AS beta_h "
    "FROM pred GROUP BY dataset, model, horizon)",
)
cte(
    "kge_cell",
    "SELECT k.dataset, k.dataset AS station, k.model, k.horizon AS h, k.horizon, k.n, k.r_h, k.alpha_h, k.alpha_h AS phi_h, k.beta_h, "
    "k.kge_h AS KGE_h, b.kge_h AS KGE_persistence_h, CASE WHEN abs(b.kge_h) > 1e-12 THEN 1 - k.kge_h / b.kge_h END AS KGE_skill_h "
    "FROM kge_part k LEFT JOIN kge_part b ON b.dataset = k.dataset AND b.horizon = k.horizon AND b.model = 'persistence' WHERE k.model <> 'persistence'",
)
cte(
    "station",
    "SELECT chr(65 + n_nationkey) AS station_id, n_name AS station_name, r_name AS province, CASE r_regionkey WHEN 0 THEN 'Urban/Traffic' "
    "WHEN 1 THEN 'Rural Remote' WHEN 2 THEN 'Suburban/Industrial' WHEN 3 THEN 'Rural Near-city/Industrial' ELSE 'Urban/Background' END AS station_type, "
    "n_nationkey * 1.5::DOUBLE AS lat, r_regionkey * 10.0::DOUBLE AS lon, n_nationkey * 10 AS altitude_m, 'D' || n_nationkey AS dem_code "
    "FROM nation JOIN region ON n_regionkey = r_regionkey",
)
_pivot = ", ".join(
    f"avg({m}) FILTER (threshold_type = '{t}') AS {m}_{t}"
    for m in ("recall", "precision", "f1", "flag_rate", "base_rate")
    for t in ("p75", "p90", "abs_50")
)
cte("exceedance_wide", f"SELECT dataset, model, horizon, {_pivot} FROM exceedance_cell GROUP BY ALL")
cte(
    "master_cell",
    "SELECT v.*, d.dm_pval_bh, d.dm_significant, d.dm_stat, d.n_pairs, m.bias_sq, m.cond_bias_sq, m.irreducible_sq, m.rho, m.std_pred_ug, "
    "m.std_true_ug, e.* EXCLUDE (dataset, model, horizon) FROM cell_summary v LEFT JOIN dm_cell d USING (dataset, model, horizon) "
    "LEFT JOIN murphy_cell m USING (dataset, model, horizon) LEFT JOIN exceedance_wide e USING (dataset, model, horizon)",
)
cte(
    "station_cell",
    "SELECT c.*, coalesce(s.station_name, c.dataset) AS station_name, coalesce(s.province, 'Unknown') AS province, "
    "coalesce(s.station_type, 'Unknown') AS station_type, s.lat, s.lon, s.altitude_m, coalesce(s.dem_code, 'Unknown') AS dem_code, "
    "c.dataset AS station_id, CASE WHEN lower(coalesce(s.station_type, 'Unknown')) LIKE '%rural%' THEN 'rural' "
    "WHEN lower(coalesce(s.station_type, 'Unknown')) LIKE '%industrial%' THEN 'industrial' ELSE 'urban' END AS station_class "
    "FROM master_cell c LEFT JOIN station s ON s.station_id = c.dataset",
)
cte(
    "rule_cell",
    "SELECT *, rule_a AND NOT rule_b AS decision_change, CASE WHEN NOT rule_a THEN 'n/a' WHEN alpha < 0.5 AND coalesce(recall_p75 < 0.2, false) THEN 'both' "
    "WHEN alpha < 0.5 THEN 'collapse_only' WHEN coalesce(recall_p75 < 0.2, false) THEN 'recall_only' ELSE 'no_change' END AS reason_change FROM ("
    "SELECT *, rule_a AND coalesce(alpha >= 0.5, false) AND coalesce(recall_p75 >= 0.2, false) AS rule_b FROM ("
    "SELECT *, coalesce(skill > 0 AND dm_significant, false) AS rule_a FROM station_cell))",
)
cte(
    "rolling_bound",
    "SELECT dataset, f.fold, n // 2 + f.fold * ((n - n // 2) // 5) AS train_end, n // 2 + (f.fold + 1) * ((n - n // 2) // 5) AS test_end FROM "
    "(SELECT dataset, count(*) AS n FROM hour_grid GROUP BY dataset) CROSS JOIN (SELECT CAST(unnest(range(0, 5)) AS INTEGER) AS fold) f",
)
cte(
    "holdout_bound",
    "SELECT dataset, 0 AS fold, CAST(floor(count(*) * 0.8::DOUBLE) AS BIGINT) AS train_end, count(*) AS test_end FROM hour_grid GROUP BY dataset",
)
for _p in ("rolling", "holdout"):
    cte(
        f"{_p}_threshold",
        "SELECT b.dataset, b.fold, quantile_cont(g.y, 0.75) AS p75, quantile_cont(g.y, 0.9) AS p90, quantile_cont(g.y, 0.5) AS p50 "
        f"FROM {_p}_bound b JOIN hour_grid g ON g.dataset = b.dataset AND g.pos < b.train_end GROUP BY b.dataset, b.fold",
    )
    cte(
        f"{_p}_wide",
        "SELECT f.dataset, b.fold, f.pos, f.ts AS origin_time, t.ts AS target_time, h.horizon, t.y AS y_true, f.y_causal AS y_persistence, f.mean_y "
        "FROM hour_fill f CROSS JOIN hourly_horizon h JOIN hour_fill t ON t.dataset = f.dataset AND t.pos = f.pos + h.horizon "
        f"JOIN {_p}_bound b ON b.dataset = f.dataset AND f.pos >= b.train_end AND f.pos + h.horizon < b.test_end "
        "WHERE t.y IS NOT NULL AND f.y_causal IS NOT NULL",
    )
    cte(
        f"{_p}_pred",
        " UNION ALL ".join(
            f"SELECT w.dataset, w.fold, w.pos, w.origin_time, w.target_time, w.horizon, w.y_true, w.y_persistence, '{m}' AS model, {e} AS y_pred, "
            f"t.p75 AS p75_train, '{'rolling_origin' if _p == 'rolling' else 'holdout'}' AS protocol FROM {_p}_wide w JOIN {_p}_threshold t USING (dataset, fold)"
            for m, e in (
                ("smooth", "0.3::DOUBLE * y_persistence + 0.7::DOUBLE * mean_y"),
                ("amplified", "mean_y + 1.5::DOUBLE * (y_persistence - mean_y)"),
            )
        ),
    )
