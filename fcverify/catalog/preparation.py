"""Queries over sources, series preparation, splits and forecast producers."""

from __future__ import annotations

from uuid import uuid4

import numpy as np
from pyspark.sql import functions as F

from fcverify.catalog import tables as T
from fcverify.catalog.base import cte, register
from fcverify.functions.scan import asof_join, with_position
from fcverify.operators import forecast, metrics, series, splits
from fcverify.plans import hourly
from fcverify.session import shared_dir
from fcverify.sources import readers, stations, writers


def scratch(spark, name: str) -> str:
    return f"{shared_dir(spark)}/fcverify-{uuid4().hex[:12]}/{name}"


# ---- sources and sinks --------------------------------------------------------

register("read_series", "SELECT * FROM ship", "y", "date")(T.ship_daily)


@register("write_table", "SELECT dataset, date, y FROM ship", "y", "date")
def _write_table(s, d):
    path = writers.write_table(T.ship_daily(s, d), scratch(s, "series.parquet"), ["dataset"])
    return readers.read_series(s, path).select("dataset", "date", "y")


@register("write_table_csv", "SELECT dataset, date, y FROM orders_day", "y", "date")
def _write_csv(s, d):
    path = writers.write_table(T.orders_daily(s, d), scratch(s, "series.csv"))
    return readers.read_series(s, path, "dataset string, date date, y double")


@register("write_predictions", "SELECT dataset, model, horizon, origin_date, y_true, y_pred FROM pred", "y_true y_pred", "origin_date")
def _write_predictions(s, d):
    path = writers.write_predictions(T.predictions(s, d), scratch(s, "predictions"))
    return s.read.parquet(path).select("dataset", "model", "horizon", "origin_date", "y_true", "y_pred")


@register(
    "read_series_autodetect",
    "SELECT o_orderdate::TIMESTAMP AS timestamp, CASE WHEN o_orderkey % 97 <> 0 THEN o_totalprice END AS y FROM orders",
    "y:2", "timestamp",
)
def _autodetect(s, d):
    path = scratch(s, "raw.csv")
    value = F.when(F.col("o_orderkey") % 97 == 0, "n/a").otherwise(F.col("o_totalprice").cast("string"))
    raw = T.table(s, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss").alias("order_datetime"), value.alias("value"))
    writers.write_table(raw, path)
    return readers.read_series_autodetect(s, path)


@register(
    "read_network_archive",
    "SELECT n_nationkey::VARCHAR AS PUNTO, n_name AS NOMBRE, CAST(NULL AS VARCHAR) AS REGION FROM nation "
    "UNION ALL SELECT r_regionkey::VARCHAR, r_name, 'Espa' || chr(241) || 'a' FROM region",
)
def _archive(s, d):
    first, second = scratch(s, "y1"), scratch(s, "y2")
    options = {"header": True, "sep": ";", "encoding": "ISO-8859-1"}
    T.table(s, d, "nation").select(F.col("n_nationkey").alias(" punto "), F.col("n_name").alias("Nombre")).write.options(**options).csv(first)
    T.table(s, d, "region").select(
        F.col("r_regionkey").alias("PUNTO"), F.col("r_name").alias("nombre "), F.lit("España").alias("region")
    ).write.options(**options).csv(second)
    return readers.read_network_archive(s, [first, second])


cte(
    "order_wide_day",
    "SELECT o_orderpriority AS dataset, CAST(o_orderdate AS DATE) AS date, sum(CAST(round(o_totalprice * 100) AS BIGINT)) AS cents FROM orders GROUP BY 1, 2",
)


@register(
    "unpivot_daily_wide",
    "SELECT c.dataset, CAST(c.month + (c.d - 1) * INTERVAL 1 DAY AS DATE) AS date, CASE WHEN o.cents % 7 <> 0 THEN o.cents / 100.0::DOUBLE END AS y FROM ("
    "SELECT dataset, month, unnest(range(1, 32)) AS d FROM (SELECT DISTINCT dataset, date_trunc('month', date) AS month FROM order_wide_day)) c "
    "LEFT JOIN order_wide_day o ON o.dataset = c.dataset AND o.date = CAST(c.month + (c.d - 1) * INTERVAL 1 DAY AS DATE) "
    "WHERE month(c.month + (c.d - 1) * INTERVAL 1 DAY) = month(c.month)",
    "y:2", "date",
)
def _unpivot_daily(s, d):
    cents = T.table(s, d, "orders").groupBy("o_orderpriority", F.col("o_orderdate").cast("date").alias("date")).agg(
        F.sum(F.round(F.col("o_totalprice") * 100).cast("long")).alias("cents")
    )
    amount = (F.col("cents").cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)")).cast("decimal(20,2)")
    # decimal commas; every seventh amount is written as a negative reading
    text = F.regexp_replace(F.when(F.col("cents") % 7 == 0, -amount).otherwise(amount).cast("string"), r"\.", ",")
    wide = cents.select(
        F.col("o_orderpriority").alias("PUNTO_MUESTREO"), F.year("date").alias("ANNO"), F.month("date").alias("MES"),
        F.format_string("D%02d", F.dayofmonth("date")).alias("day"), text.alias("text"),
    ).groupBy("PUNTO_MUESTREO", "ANNO", "MES").pivot("day", [f"D{i:02d}" for i in range(1, 32)]).agg(F.first("text"))
    return readers.unpivot_daily_wide(wide.withColumn("MAGNITUD", F.lit(10)))


@register(
    "unpivot_hourly_validated",
    "SELECT g.dataset, g.ts, CASE WHEN e.n % 2 = 1 THEN e.cents / 100.0::DOUBLE END AS y, coalesce(e.n % 2 = 1, false) AS is_valid FROM ("
    "SELECT dataset, unnest(generate_series(min(date_trunc('day', ts)), max(date_trunc('day', ts)) + INTERVAL 23 HOUR, INTERVAL 1 HOUR)) AS ts FROM event_hour GROUP BY dataset) g "
    "LEFT JOIN (SELECT event_type AS dataset, date_trunc('hour', ts) AS ts, count(*) AS n, sum(CAST(round(value * 100) AS BIGINT)) AS cents FROM events GROUP BY 1, 2) e USING (dataset, ts)",
    "y:2", "ts",
)
def _unpivot_hourly(s, d):
    rows = T.table(s, d, "events").select(
        "event_type", F.year("ts").alias("ANO"), F.month("ts").alias("MES"), F.dayofmonth("ts").alias("DIA"), F.hour("ts").alias("h"), "value"
    )
    hours = rows.groupBy("event_type", "ANO", "MES", "DIA").agg(
        *[
            c
            for h in range(24)
            for c in (
                (F.sum(F.when(F.col("h") == h, F.round(F.col("value") * 100).cast("long"))) / 100.0).cast("string").alias(f"H{h + 1:02d}"),
                F.when(F.count_if(F.col("h") == h) % 2 == 1, "V").otherwise("N").alias(f"V{h + 1:02d}"),
            )
        ]
    ).withColumnRenamed("event_type", "ESTACION")
    return readers.unpivot_hourly_validated(hours)


_inventory = (
    "SELECT dataset, datediff('day', min(date), max(date)) + 1 AS n_days, count(y) AS valid_days, count(DISTINCT year(date)) AS n_years, "
    "min(date) AS date_min, max(date) AS date_max, round(count(y)::DOUBLE / (datediff('day', min(date), max(date)) + 1), 3) AS coverage FROM orders_day GROUP BY dataset"
)
register("series_inventory", _inventory, "coverage", "date_min date_max")(lambda s, d: stations.series_inventory(T.orders_daily(s, d)))


@register(
    "select_series",
    f"SELECT o.* FROM orders_day o JOIN (SELECT dataset FROM ({_inventory}) WHERE coverage >= 0.3 AND n_years >= 5 AND dataset <> '1-URGENT' "
    "ORDER BY coverage DESC, dataset LIMIT 3) USING (dataset)",
    "y", "date",
)
def _select(s, d):
    daily_series = T.orders_daily(s, d)
    excluded = daily_series.filter(F.col("dataset") == "1-URGENT").select("dataset").distinct()
    chosen = stations.select_series(stations.series_inventory(daily_series), 0.3, 5, excluded, 3)
    return stations.keep_series(daily_series, chosen)


@register("union_tables", "SELECT dataset, date, y FROM ship UNION ALL SELECT dataset, date, y FROM orders_day", "y", "date")
def _union(s, d):
    return readers.union_tables([T.ship_daily(s, d), T.orders_daily(s, d)])


@register("read_union", "SELECT r_regionkey AS key, r_name AS name FROM region UNION ALL SELECT n_nationkey, n_name FROM nation")
def _read_union(s, d):
    base = scratch(s, "stations")
    for label, name, prefix in (("region", "region", "r"), ("nation", "nation", "n"), ("skip", "region", "r")):
        T.table(s, d, name).select(F.col(f"{prefix}_{name}key").alias("key"), F.col(f"{prefix}_name").alias("name"), F.lit(label).alias("part")).write.mode(
            "overwrite"
        ).parquet(f"{base}/{label}")
    return readers.read_union(s, f"{base}/*", exclude_names=["skip"]).select("key", "name")


register("require_columns", "SELECT dataset, date, y FROM ship", "y", "date")(
    lambda s, d: readers.require_columns(T.ship_daily(s, d), ["dataset", "date", "y"], "series").select("dataset", "date", "y")
)
register("to_canonical", "SELECT 'all' AS dataset, CAST(o_orderdate AS DATE) AS date, o_totalprice AS y FROM orders", "y:2", "date")(
    lambda s, d: readers.to_canonical(T.table(s, d, "orders"), "o_orderdate", "o_totalprice", "all")
)


@register("normalise_predictions", "SELECT dataset, model, fold, origin_date, horizon, date, y_true, y_pred FROM pred", "y_true y_pred", "origin_date date")
def _normalise(s, d):
    foreign = T.predictions(s, d).select(
        "dataset", "model", F.col("origin_date").cast("timestamp_ntz").alias("origin"), F.col("horizon").cast("long").alias("horizon"),
        F.col("date").cast("timestamp_ntz").alias("forecast_timestamp"), "y_true", "y_pred",
    )
    return readers.normalise_predictions(foreign, F.col("dataset"))


@register(
    "resolve_columns",
    "SELECT n_name AS station_name, n_regionkey AS horizon, n_nationkey % 2 = 0 AS flag, CAST(NULL AS VARCHAR) AS comment FROM nation",
)
def _resolve(s, d):
    flag = F.when(F.col("n_nationkey") % 4 == 0, " Yes").when(F.col("n_nationkey") % 2 == 0, "TRUE").otherwise("no")
    raw = T.table(s, d, "nation").select(F.col("n_name").alias("Station"), F.col("n_regionkey").alias("H"), flag.alias("Flag"))
    return readers.resolve_columns(raw, {"station_name": ["station"], "horizon": ["h"], "flag": []}, {"comment": ["remark"]}, ["flag"])


# The short aliases of the contract match by fragment: "t" finds Rel_Humidity and "p" finds wind_speed.
@register(
    "harmonise_covariates",
    "SELECT event_type AS dataset, ts, value AS wind_speed_ms, user_id::DOUBLE AS humidity_pct, user_id::DOUBLE AS temp_c FROM events", "wind_speed_ms humidity_pct temp_c", "ts",
)
def _harmonise(s, d):
    raw = T.table(s, d, "events").select(
        F.col("event_type").alias("dataset"), F.col("ts").alias("Timestamp_UTC"), F.col("value").cast("string").alias("VV_mean"), F.col("user_id").alias("Rel_Humidity")
    )
    return readers.harmonise_covariates(raw, ["dataset"])


@register(
    "covariate_coverage",
    "SELECT unnest(['wind_speed_ms', 'precip_mm']) AS column_name, coverage_pct FROM "
    "(SELECT 100.0::DOUBLE * avg(CASE WHEN event_id % 5 <> 0 THEN 1 ELSE 0 END) AS coverage_pct FROM events)",
    "coverage_pct",
)
def _coverage(s, d):
    raw = T.table(s, d, "events").select("ts", F.when(F.col("event_id") % 5 != 0, F.col("value")).alias("wind_speed"))
    return readers.covariate_coverage(readers.harmonise_covariates(raw.withColumnRenamed("ts", "timestamp")))


@register(
    "categorise_columns",
    "SELECT unnest(['wind', 'moisture', 'thermodynamic']) AS category, unnest(['wind_speed_ms', 'humidity_pct', 'temp_c']) AS column_name, "
    "unnest([count(n), count(v), count(u)]) AS n_values FROM (SELECT count(*) AS n, max(value) AS v, count(DISTINCT user_id) AS u "
    "FROM events GROUP BY event_type, date_trunc('hour', ts))",
)
def _categorise(s, d):
    return readers.categorise_columns(T.covariates(s, d))


register(
    "station_dimension",
    "SELECT o.*, o.dataset AS station_id, coalesce(s.station_name, o.dataset) AS station_name, coalesce(s.province, 'Unknown') AS province, "
    "coalesce(s.station_type, 'Unknown') AS station_type, s.lat, s.lon, coalesce(s.altitude_m, -1) AS altitude_m, coalesce(s.dem_code, 'Unknown') AS dem_code, "
    "CASE WHEN lower(coalesce(s.station_type, 'Unknown')) LIKE '%rural%' THEN 'rural' WHEN lower(coalesce(s.station_type, 'Unknown')) LIKE '%industrial%' THEN 'industrial' ELSE 'urban' END AS station_class "
    "FROM (SELECT * FROM ship UNION ALL SELECT * FROM orders_day) o LEFT JOIN station s ON s.station_id = o.dataset",
    "y lat lon", "date",
)(lambda s, d: stations.station_dimension(readers.union_tables([T.ship_daily(s, d), T.orders_daily(s, d)]), T.stations(s, d)).withColumn(
    "altitude_m", F.coalesce("altitude_m", F.lit(-1))))

register("combine_predictions", "SELECT dataset, model, horizon, date, y_pred FROM pred WHERE model IN ('seasonal_naive', 'smooth')", "y_pred", "date")(
    lambda s, d: readers.combine_predictions(
        T.predictions(s, d).filter(F.col("model") == "seasonal_naive"),
        T.predictions(s, d).filter(F.col("model") != "seasonal_naive"), "smooth",
    ).select("dataset", "model", "horizon", "date", "y_pred")
)


@register(
    "combine_skill",
    "SELECT dataset, model, horizon, CASE WHEN horizon <= 2 THEN skill * 2 ELSE skill END AS skill, mae_skill FROM cell_skill", "skill mae_skill",
)
def _combine_skill(s, d):
    base = metrics.skill_matched(T.predictions(s, d)).select("dataset", "model", "horizon", "skill", "mae_skill")
    later = base.filter(F.col("horizon") <= 2).withColumn("skill", F.col("skill") * 2)
    return readers.combine_skill(base, later)


register(
    "model_roles",
    "SELECT * FROM (VALUES ('persistence', 'other'), ('seasonal_naive', 'seasonal_reference'), ('smooth_direct', 'direct_ml'), ('amplified_direct', 'direct_ml')) v(model, role)",
)(lambda s, d: readers.model_roles(T.predictions(s, d).withColumn(
    "model", F.when(F.col("model").isin("smooth", "amplified"), F.concat("model", F.lit("_direct"))).otherwise(F.col("model"))), strict=True))

# ---- series preparation ---------------------------------------------------------

register("densify", "SELECT * FROM orders_dense", "y", "date")(lambda s, d: series.densify(T.orders_daily(s, d)))
register("densify_hourly", "SELECT dataset, ts, idx, y FROM hour_grid", "y", "ts")(lambda s, d: series.densify(T.events_hourly(s, d)))
register(
    "dedupe_first",
    "SELECT o_orderpriority AS dataset, CAST(o_orderdate AS DATE) AS date, o_orderkey, o_totalprice AS y FROM orders "
    "QUALIFY row_number() OVER (PARTITION BY o_orderpriority, CAST(o_orderdate AS DATE) ORDER BY o_orderkey) = 1",
    "y:2", "date",
)(lambda s, d: series.dedupe_first(
    T.table(s, d, "orders").select(F.col("o_orderpriority").alias("dataset"), F.col("o_orderdate").cast("date").alias("date"), "o_orderkey", F.col("o_totalprice").alias("y")),
    ["o_orderkey"]))


def dense(s, d):
    return series.densify(T.orders_daily(s, d))


register(
    "causal_ffill",
    "SELECT dataset, date, idx, y, last_value(y IGNORE NULLS) OVER (PARTITION BY dataset ORDER BY date ROWS UNBOUNDED PRECEDING) AS y_causal FROM orders_dense",
    "y y_causal", "date",
)(lambda s, d: series.causal_ffill(dense(s, d)))


@register(
    "zscore_train",
    "SELECT o.dataset, o.date, o.y, (o.y - m.m) / nullif(m.s, 0) AS y_z FROM orders_dense o JOIN (SELECT dataset, avg(y) AS m, stddev_samp(y) AS s FROM orders_dense "
    "WHERE date <= DATE '1998-12-31' GROUP BY dataset) m USING (dataset)",
    "y y_z", "date",
)
def _zscore(s, d):
    grid = dense(s, d)
    bounds = grid.select("dataset").distinct().withColumn("train_end", F.lit("1998-12-31").cast("date"))
    return series.zscore_train(grid, bounds).select("dataset", "date", "y", "y_z")


register(
    "add_lags",
    "SELECT dataset, date, idx, y, " + ", ".join(f"lag(y, {k}) OVER w AS lag_{k}" for k in (0, 1, 7)) + " FROM orders_dense WINDOW w AS (PARTITION BY dataset ORDER BY date)",
    "y lag_0 lag_1 lag_7", "date",
)(lambda s, d: series.add_lags(dense(s, d), [0, 1, 7]))
_roll = ", ".join(
    f"CASE WHEN count(y) OVER w{n} = {n} THEN {f}(y) OVER w{n} END AS rolling_{c}_{n}"
    for n in (3, 7) for c, f in (("mean", "avg"), ("std", "stddev_samp"), ("min", "min"), ("max", "max"))
)
register(
    "add_rolling",
    f"SELECT dataset, date, idx, y, {_roll} FROM orders_dense WINDOW w3 AS (PARTITION BY dataset ORDER BY date ROWS 2 PRECEDING), w7 AS (PARTITION BY dataset ORDER BY date ROWS 6 PRECEDING)",
    "y " + " ".join(f"rolling_{c}_{n}" for n in (3, 7) for c in ("mean", "std", "min", "max")), "date",
)(lambda s, d: series.add_rolling(dense(s, d), [3, 7]))
register(
    "add_calendar",
    "SELECT dataset, ts, y, CAST(hour(ts) AS INTEGER) AS hour, CAST(isodow(ts) - 1 AS INTEGER) AS dayofweek, CAST(month(ts) AS INTEGER) AS month FROM event_hour", "y", "ts",
)(lambda s, d: series.add_calendar(T.events_hourly(s, d)))
_cyc = ", ".join(
    f"{f}(2 * pi() * ({e})) AS target_{n}_{f}"
    for f in ("sin", "cos")
    for n, e in (("hour", "hour(t) / 24.0::DOUBLE"), ("dow", "(isodow(t) - 1) / 7.0::DOUBLE"), ("month", "(month(t) - 1) / 12.0::DOUBLE"))
)
register(
    "add_cyclic_target_time",
    f"SELECT dataset, ts, horizon, {_cyc} FROM (SELECT dataset, ts, horizon, ts + horizon * INTERVAL 1 HOUR AS t FROM event_hour CROSS JOIN hourly_horizon)",
    " ".join(f"target_{n}_{f}" for f in ("sin", "cos") for n in ("hour", "dow", "month")), "ts",
)(lambda s, d: series.add_cyclic_target_time(
    T.events_hourly(s, d).select("dataset", "ts", F.explode(F.array(*[F.lit(h) for h in hourly.HORIZONS])).alias("horizon"))))
register(
    "add_targets",
    "SELECT o.dataset, o.date, o.idx, o.y, h.horizon, t.y AS target, t.date AS target_date FROM orders_dense o CROSS JOIN daily_horizon h "
    "LEFT JOIN orders_dense t ON t.dataset = o.dataset AND t.idx = o.idx + h.horizon",
    "y target", "date target_date",
)(lambda s, d: series.add_targets(dense(s, d), range(1, 8)))
register(
    "complete_cases",
    "SELECT * FROM (SELECT dataset, date, idx, y, lag(y, 1) OVER w AS lag_1, lag(y, 7) OVER w AS lag_7 FROM orders_dense WINDOW w AS (PARTITION BY dataset ORDER BY date)) "
    "WHERE y IS NOT NULL AND lag_1 IS NOT NULL AND lag_7 IS NOT NULL",
    "y lag_1 lag_7", "date",
)(lambda s, d: series.complete_cases(series.add_lags(dense(s, d), [1, 7]), ["y", "lag_1", "lag_7"]))
register(
    "multi_horizon_targets",
    "SELECT * FROM (SELECT o.dataset, o.date, o.idx, o.y, h.horizon, t.y AS target, t.date AS target_date FROM orders_dense o CROSS JOIN daily_horizon h "
    "LEFT JOIN orders_dense t ON t.dataset = o.dataset AND t.idx = o.idx + h.horizon) QUALIFY count(target) OVER (PARTITION BY dataset, idx) = 7",
    "y target", "date target_date",
)(lambda s, d: series.multi_horizon_targets(dense(s, d), range(1, 8)))


@register(
    "context_windows",
    "SELECT dataset, end_idx, CAST(c[1] AS DOUBLE) AS first_value, CAST(c[24] AS DOUBLE) AS last_value, len(c) AS length FROM (SELECT dataset, pos AS end_idx, "
    "list(CAST(y AS FLOAT)) OVER (PARTITION BY dataset ORDER BY ts ROWS 23 PRECEDING) AS c FROM hour_grid) WHERE len(c) = 24 AND (end_idx - 23) % 6 = 0",
    "first_value:4 last_value:4",
)
def _context(s, d):
    windows = series.context_windows(series.grid_position(series.densify(T.events_hourly(s, d))), 24, 6)
    return windows.select(
        "dataset", "end_idx", F.col("context")[0].cast("double").alias("first_value"), F.col("context")[23].cast("double").alias("last_value"),
        F.size("context").alias("length"),
    )


register(
    "season_labels",
    "SELECT dataset, date, CASE WHEN month(date) IN (12, 1, 2) THEN 'winter' WHEN month(date) IN (3, 4, 5) THEN 'spring' WHEN month(date) IN (6, 7, 8) THEN 'summer' ELSE 'autumn' END AS season, "
    "CASE WHEN month(date) BETWEEN 4 AND 9 THEN 'warm_season' ELSE 'cold_season' END AS warm_cold FROM ship",
    None, "date",
)(lambda s, d: series.season_labels(T.ship_daily(s, d)).drop("y"))
register(
    "with_position",
    "SELECT dataset, date, row_number() OVER (PARTITION BY dataset ORDER BY date) - 1 AS pos FROM orders_day", None, "date",
)(lambda s, d: with_position(series.with_index(T.orders_daily(s, d)), ["dataset"], ["idx"]).select("dataset", "date", "pos"))


@register(
    "asof_join",
    "SELECT e.event_id, e.dataset, CAST(h.ts AS VARCHAR) AS seen_at, h.y FROM (SELECT event_id, event_type AS dataset, "
    "date_trunc('hour', ts)::TIMESTAMP - (1 + event_id % 5) * INTERVAL 1 HOUR AS ts FROM events) e "
    "ASOF LEFT JOIN event_hour h ON h.dataset = e.dataset AND h.ts <= e.ts",
    "y",
)
def _asof(s, d):
    """For every event the latest hourly value known one to five hours earlier."""
    right = series.with_index(T.events_hourly(s, d)).withColumn("seen_at", F.col("ts").cast("string"))
    left = T.table(s, d, "events").select(
        F.col("event_type").alias("dataset"), "event_id", (series.hour_index("ts") - 1 - F.col("event_id") % 5).alias("at")
    )
    return asof_join(left, right, ["dataset"], "at", "idx", ["seen_at", "y"]).select("event_id", "dataset", "seen_at", "y")


# ---- splits ------------------------------------------------------------------

_rolled = (
    "SELECT a.dataset, ((a.pos - 59) // {step}) * 7 + h.horizon - 1 AS fold, a.train_start, a.date AS train_end, a.date AS origin_date, h.horizon, t.date AS target_date, a.pos + h.horizon AS test_index "
    "FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY date) - 1 AS pos, count(*) OVER (PARTITION BY dataset) AS n, min(date) OVER (PARTITION BY dataset) AS train_start FROM orders_day) a "
    "CROSS JOIN daily_horizon h JOIN (SELECT dataset, date, row_number() OVER (PARTITION BY dataset ORDER BY date) - 1 AS pos FROM orders_day) t "
    "ON t.dataset = a.dataset AND t.pos = a.pos + h.horizon WHERE a.pos >= 59 AND a.pos < a.n - 7 AND (a.pos - 59) % {step} = 0"
)
register("rolling_origin_pairs", _rolled.format(step=3), None, "train_start train_end origin_date target_date")(
    lambda s, d: splits.rolling_origin_pairs(T.orders_daily(s, d), 60, 7, 3)
)


def grid_lengths(s, d):
    return splits.series_lengths(series.densify(T.events_hourly(s, d)))


register(
    "expanding_folds_pct",
    "SELECT * FROM (SELECT dataset, f.fold, CAST(floor(n * 0.5::DOUBLE) + f.fold * floor(n * 0.1::DOUBLE) AS BIGINT) AS train_end, CAST(floor(n * 0.5::DOUBLE) + (f.fold + 1) * floor(n * 0.1::DOUBLE) AS BIGINT) AS test_end, n "
    "FROM (SELECT dataset, count(*) AS n FROM hour_grid GROUP BY dataset) CROSS JOIN (SELECT CAST(unnest(range(0, 6)) AS INTEGER) AS fold) f) WHERE test_end <= n",
)(lambda s, d: splits.expanding_folds_pct(grid_lengths(s, d), n_folds=6).join(grid_lengths(s, d), "dataset").withColumnRenamed("n_rows", "n"))
register("expanding_folds", "SELECT * FROM rolling_bound")(lambda s, d: splits.expanding_folds(grid_lengths(s, d)))
register("holdout_split", "SELECT * FROM holdout_bound")(lambda s, d: splits.holdout_split(grid_lengths(s, d)))
register(
    "fold_membership",
    "SELECT g.dataset, g.pos, h.horizon, b.fold, CASE WHEN g.pos + h.horizon < b.train_end THEN 'train' ELSE 'test' END AS role FROM hour_grid g CROSS JOIN hourly_horizon h "
    "JOIN rolling_bound b ON b.dataset = g.dataset AND (g.pos + h.horizon < b.train_end OR (g.pos >= b.train_end AND g.pos + h.horizon < b.test_end))",
)(lambda s, d: splits.fold_membership(
    series.grid_position(series.densify(T.events_hourly(s, d))).select("dataset", "pos", F.explode(F.array(*[F.lit(h) for h in hourly.HORIZONS])).alias("horizon")),
    T.hourly_bounds(s, d)))
register(
    "origin_filter",
    "SELECT dataset, date, y FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY date) AS k FROM orders_dense WHERE y IS NOT NULL AND year(date) BETWEEN 1996 AND 1999) WHERE (k - 1) % 14 = 0",
    "y", "date",
)(lambda s, d: splits.origin_filter(dense(s, d), 1996, 1999, 14).select("dataset", "date", "y"))


@register(
    "train_window",
    "SELECT o.dataset, o.horizon, o.date, count(t.idx) AS n_train, o.n_observed FROM (SELECT d.dataset, h.horizon, d.date, d.idx, count(d.y) OVER (PARTITION BY d.dataset, h.horizon ORDER BY d.date ROWS UNBOUNDED PRECEDING) AS n_observed "
    "FROM orders_dense d CROSS JOIN daily_horizon h) o LEFT JOIN (SELECT a.dataset, h.horizon, a.idx + h.horizon AS idx FROM (SELECT *, lag(y, 1) OVER (PARTITION BY dataset ORDER BY date) AS lag_1 FROM orders_dense) a "
    "CROSS JOIN daily_horizon h JOIN orders_dense t ON t.dataset = a.dataset AND t.idx = a.idx + h.horizon WHERE a.y IS NOT NULL AND a.lag_1 IS NOT NULL AND t.y IS NOT NULL) t "
    "ON t.dataset = o.dataset AND t.horizon = o.horizon AND t.idx <= o.idx GROUP BY ALL HAVING count(t.idx) >= 100 AND o.n_observed >= 100",
    None, "date",
)
def _train_window(s, d):
    samples = series.add_targets(series.add_lags(dense(s, d), [0, 1]), range(1, 8))
    return splits.train_window(samples, ["lag_0", "lag_1"], 100).select("dataset", "horizon", "date", "n_train", "n_observed")


# ---- forecast producers ---------------------------------------------------------

PRED = "dataset, model, fold, origin_date, horizon, date, y_true, y_pred"
register("persistence", f"SELECT {PRED} FROM pred WHERE model = 'persistence'", "y_true y_pred", "origin_date date")(
    lambda s, d: forecast.persistence(T.ship_daily(s, d))
)
_seasonal_orders = (
    "SELECT o.dataset, 'seasonal_naive' AS model, CAST(o.date AS VARCHAR) AS fold, o.date AS origin_date, o.horizon, t.date, t.y AS y_true, o.seasonal AS y_pred FROM ("
    "SELECT s.*, h.horizon, coalesce(lag(s.y, 7 - h.horizon) OVER (PARTITION BY s.dataset, h.horizon ORDER BY s.date), s.y) AS seasonal FROM orders_day s CROSS JOIN daily_horizon h) o "
    "JOIN orders_day t ON t.dataset = o.dataset AND t.date = o.date + o.horizon"
)
register("seasonal_naive", _seasonal_orders, "y_true y_pred", "origin_date date")(lambda s, d: forecast.seasonal_naive(T.orders_daily(s, d)))
register("predictions_assembly", f"SELECT {PRED} FROM pred WHERE model IN ('persistence', 'seasonal_naive')", "y_true y_pred", "origin_date date")(
    lambda s, d: forecast.predictions_assembly([forecast.persistence(T.ship_daily(s, d)), forecast.seasonal_naive(T.ship_daily(s, d))])
)
register("naive_predictions", f"SELECT {PRED} FROM pred", "y_true y_pred", "origin_date date")(T.predictions)
register("hourly_predictions", "SELECT dataset, CAST(fold AS INTEGER) AS fold, pos, origin_time, target_time, horizon, y_true, y_persistence, model, y_pred, p75_train, protocol FROM rolling_pred",
         "y_true y_persistence y_pred p75_train", "origin_time target_time")(T.hourly_predictions)
register("ridge_direct", None, "y_true y_pred", "origin_date date")(lambda s, d: forecast.ridge_direct(series.densify(T.ship_daily(s, d))))
register("seasonal_ridge_direct", None, "y_true y_pred", "origin_date date")(lambda s, d: forecast.seasonal_ridge_direct(series.densify(T.ship_daily(s, d))))
register("seasonal_ridge_direct_seasonal", None, "y_true y_pred", "origin_date date")(
    lambda s, d: forecast.seasonal_ridge_direct(series.densify(T.ship_daily(s, d)), add_back="seasonal")
)


@register("boosted_direct", None, "target y_pred", "ts")
def _boosted(s, d):
    samples = hourly.boosted_samples(T.hourly_grid(s, d))
    made = forecast.boosted_direct(samples, forecast.feature_names(), hourly.HORIZONS, range(5))
    return made.select("dataset", "fold", "pos", "ts", "horizon", "target", "y_pred")


def _train_mean(train, values, origins, horizons):
    """Forecaster for the harness: the mean of the training values."""
    seen = train[np.isfinite(train)]
    return np.full((len(origins), len(horizons)), seen.mean())


def _grouped(s, d, forecaster):
    grid = T.hourly_grid(s, d)
    return forecast.grouped_forecast(grid, hourly.fold_bounds(grid), hourly.HORIZONS, forecaster)


def _seasonal_ar(s, d, make):
    grid = T.hourly_grid(s, d)
    return make(grid, hourly.fold_bounds(grid))


register(
    "grouped_forecast",
    "SELECT g.dataset, CAST(b.fold AS INTEGER) AS fold, g.pos, h.horizon, m.m AS y_pred FROM hour_grid g CROSS JOIN hourly_horizon h JOIN rolling_bound b "
    "ON b.dataset = g.dataset AND g.pos >= b.train_end AND g.pos + h.horizon < b.test_end "
    "JOIN (SELECT b.dataset, b.fold, avg(f.y_causal) AS m FROM rolling_bound b JOIN hour_fill f ON f.dataset = b.dataset AND f.pos < b.train_end GROUP BY ALL) m "
    "ON m.dataset = g.dataset AND m.fold = b.fold",
    "y_pred",
)(lambda s, d: _grouped(s, d, _train_mean).drop("error"))
cte(
    "ar_cell",
    "SELECT dataset, fold, n, mv - c1 * ma - c2 * mb AS c0, c1, c2 FROM ("
    "SELECT *, (av * bb - bv * ab) / (aa * bb - ab * ab) AS c1, (bv * aa - av * ab) / (aa * bb - ab * ab) AS c2 FROM ("
    "SELECT f.dataset, CAST(b.fold AS INTEGER) AS fold, count(*) AS n, avg(v) AS mv, avg(a) AS ma, avg(b24) AS mb, var_pop(a) AS aa, var_pop(b24) AS bb, "
    "covar_pop(a, b24) AS ab, covar_pop(a, v) AS av, covar_pop(b24, v) AS bv FROM ("
    "SELECT dataset, pos, y_causal AS v, lag(y_causal) OVER w AS a, lag(y_causal, 24) OVER w AS b24 FROM hour_fill WINDOW w AS (PARTITION BY dataset ORDER BY pos)) f "
    "JOIN rolling_bound b ON b.dataset = f.dataset AND f.pos < b.train_end WHERE v IS NOT NULL AND a IS NOT NULL AND b24 IS NOT NULL GROUP BY ALL))",
)
register("seasonal_ar_coefficients", "SELECT * FROM ar_cell", "c0 c1 c2")(
    lambda s, d: _seasonal_ar(s, d, forecast.seasonal_ar_coefficients).withColumn("fold", F.col("fold").cast("int"))
)
register(
    "seasonal_ar_forecast",
    "SELECT dataset, fold, pos, horizon, CASE WHEN len(list_filter(first24, lambda x: x IS NOT NULL)) = 24 THEN path[24 + horizon] END AS y_pred FROM ("
    "WITH RECURSIVE run AS ("
    "SELECT o.dataset, CAST(b.fold AS INTEGER) AS fold, o.pos, b.test_end, o.recent AS first24, o.recent AS path, c0, c1, c2, 0 AS step FROM ("
    "SELECT dataset, pos, list(y_causal) OVER (PARTITION BY dataset ORDER BY pos ROWS BETWEEN 23 PRECEDING AND CURRENT ROW) AS recent FROM hour_fill) o "
    "JOIN rolling_bound b ON b.dataset = o.dataset AND o.pos >= b.train_end AND o.pos < b.test_end "
    "LEFT JOIN ar_cell c ON c.dataset = b.dataset AND c.fold = b.fold "
    "UNION ALL SELECT dataset, fold, pos, test_end, first24, list_append(path, c0 + c1 * path[len(path)] + c2 * path[len(path) - 23]), c0, c1, c2, step + 1 "
    "FROM run WHERE step < 48) SELECT * FROM run WHERE step = 48) CROSS JOIN hourly_horizon WHERE pos + horizon < test_end",
    "y_pred",
)(
    lambda s, d: _seasonal_ar(s, d, lambda grid, bounds: forecast.seasonal_ar_direct(grid, bounds, hourly.HORIZONS))
)
