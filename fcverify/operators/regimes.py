"""Regime-conditioned evaluation of positional predictions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.quantiles import grouped_percentile, metric_percentiles
from fcverify.operators.splits import training_rows
from fcverify.session import settle

MIN_SAMPLES, MIN_EVENTS = 40, 5
# Rows that one task of a k-means round reads: every task of every round reports to the driver.
FIT_ROWS = 1 << 18
WIND_NAMES = ("wind_speed_ms", "wind_speed", "vv")
HUMIDITY_NAMES = ("humidity_pct", "humidity", "rh", "hr")
CLUSTER_COLUMNS = ("wind_speed_ms", "wind_dir_deg", "temp_c", "humidity_pct", "pressure_hpa", "solar_rad_wm2", "precip_mm",
                   "hour", "month", "dayofweek")


def pick_column(columns: Sequence[str], candidates: Sequence[str]) -> str | None:
    return next((c for want in candidates for c in columns if want in c.lower()), None)


def align_covariates(features: DataFrame, external: DataFrame, keys: Sequence[str] = ("dataset", "ts")) -> DataFrame:
    """Left join on time; columns already present are never overwritten."""
    new = [c for c in external.columns if c not in features.columns]
    return features.join(external.select(*keys, *new), list(keys), "left")


def uses_fallback(columns: Sequence[str]) -> bool:
    """True when no meteorology column is present."""
    from fcverify.sources.readers import COLUMN_CATEGORIES

    weather = ("wind", "moisture", "thermodynamic", "pressure", "precipitation")
    return not any(p in c.lower() for c in columns for k in weather for p in COLUMN_CATEGORIES[k])


def prediction_master(
    predictions: DataFrame,
    series: DataFrame,
    thresholds: DataFrame,
    covariates: DataFrame | None = None,
    baseline: str = "persistence",
    warm_months: Sequence[int] = (4, 5, 6, 7, 8, 9),
) -> DataFrame:
    """Join positional predictions with origin, target, baseline, threshold and covariates.

    ``predictions``: dataset, model, fold, pos, horizon, y_pred. ``series``: dataset,
    pos, ts, y. ``thresholds``: dataset, fold, horizon, event_threshold. Targets past
    the end or without an observation drop out; a prediction without its baseline, or
    of a fold and horizon without a threshold, raises.
    """
    keys = ["dataset", "fold", "pos", "horizon"]
    base = predictions.filter(F.col("model") == baseline).select(*keys, F.col("y_pred").alias("y_persist"), F.lit(1).alias("__has"))
    missing = F.raise_error(F.lit("prediction without a baseline row")).cast("double")
    target = series.select("dataset", F.col("pos").alias("__target"), F.col("ts").alias("target_ts"), F.col("y").alias("y_true"))
    origin = series.select("dataset", "pos", F.col("ts").alias("origin_ts"))
    joined = (
        predictions.filter(F.col("model") != baseline)
        .join(base, keys, "left")
        .withColumn("y_persist", F.when(F.col("__has").isNull(), missing).otherwise(F.col("y_persist")))
        .drop("__has")
        .withColumn("__target", F.col("pos") + F.col("horizon"))
        .join(target, ["dataset", "__target"])
        .filter(F.col("y_true").isNotNull())
        .drop("__target")
        .join(origin, ["dataset", "pos"])
        .join(thresholds.withColumn("__known", F.lit(True)), ["dataset", "fold", "horizon"], "left")
        .filter(F.coalesce("__known", F.raise_error(F.lit("fold and horizon without a training target")).cast("boolean")))
        .drop("__known")
    )
    if covariates is not None:
        joined = joined.join(covariates.withColumnRenamed("ts", "origin_ts"), ["dataset", "origin_ts"], "left")
    month = F.month(F.col("origin_ts").cast("date"))
    return joined.withColumns(
        {
            "origin_month": month,
            "origin_hour": F.hour("origin_ts"),
            "origin_season": X.season(month),
            "warm_cold_season": X.warm_cold(month, warm_months),
        }
    )


def physical_regimes(
    master: DataFrame,
    covariates: DataFrame,
    bounds: DataFrame,
    wind_level: float = 0.5,
    humidity_level: float = 0.5,
) -> DataFrame:
    """Ventilation and moisture regimes from quantiles of each fold's training covariates.

    ``covariates``: dataset, pos and columns. A missing covariate value falls into
    the upper class; an absent column makes the regime 'unavailable'.
    """
    rules = [
        ("physical_ventilation_regime", pick_column(covariates.columns, WIND_NAMES), wind_level, "low_ventilation", "high_ventilation"),
        ("physical_moisture_regime", pick_column(covariates.columns, HUMIDITY_NAMES), humidity_level, "dry", "humid"),
    ]
    out = master.withColumn("physical_season_regime", F.col("warm_cold_season"))
    for name, column, level, low, high in rules:
        if column is None:
            out = out.withColumn(name, F.lit("unavailable"))
            continue
        rows = training_rows(covariates.select("dataset", "pos", column), bounds)
        cut = grouped_percentile(rows, ["dataset", "fold"], column, {"__cut": level})
        out = (
            out.join(cut, ["dataset", "fold"], "left")
            .withColumn(name, F.when(F.col(column) <= F.col("__cut"), low).otherwise(high))
            .drop("__cut")
        )
    return out


def cluster_regimes(
    covariates: DataFrame,
    bounds: DataFrame,
    folds: Sequence[int],
    k: int = 3,
    columns: Sequence[str] | None = None,
    seed: int = 42,
    max_iter: int = 300,
) -> tuple[DataFrame, DataFrame]:
    """KMeans per fold over the pooled training covariates; returns labels and centres.

    Missing values take the training median, columns are standardised on the
    training rows. Labels: dataset, pos, fold, ``cluster_k<k>_regime`` for rows in the
    fold's test window; a fold with too few rows is 'unavailable'. The training rows are
    dealt by key into tasks of about ``FIT_ROWS`` and sorted there, so the random start
    depends on the rows, not on how they lay before, and what the rounds send to the driver
    follows the number of rows, not that of shuffle partitions.
    """
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.feature import StandardScaler, VectorAssembler

    spark = covariates.sparkSession
    covariates, bounds = settle(covariates), settle(bounds)
    names = list(columns) if columns is not None else [c for c in CLUSTER_COLUMNS if c in covariates.columns]
    label = f"cluster_k{k}_regime"
    labelled, centres = [], []
    # one row of counts and quantiles per fold
    pooled = training_rows(covariates, bounds).select("fold", *names)
    sizes_of = {r["fold"]: r for r in pooled.groupBy("fold").agg(F.count(F.lit(1)).alias("__n"), *[F.count(c).alias(c) for c in names]).collect()}
    levels = {"median": 0.5, "q33": 0.33, "q67": 0.67}
    marks_of = {r["fold"]: r for r in metric_percentiles(pooled, ["fold"], names, levels).collect()}
    for fold in folds:
        own = bounds.filter(F.col("fold") == fold).select("dataset", "train_end", "test_end")
        rows = covariates.join(own, "dataset")
        train = rows.filter(F.col("pos") < F.col("train_end"))
        test = rows.filter((F.col("pos") >= F.col("train_end")) & (F.col("pos") < F.col("test_end")))
        sizes = sizes_of.get(fold)
        usable = [] if sizes is None else [c for c in names if sizes[c] > k]
        if not usable or sizes["__n"] < max(10 * k, k + 1):
            labelled.append(test.select("dataset", "pos", F.lit(fold).alias("fold"), F.lit("unavailable").alias(label)))
            continue
        marks = marks_of[fold]
        fill = {c: marks[f"{c}_median"] for c in usable}
        doubles = [F.col(c).cast("double").alias(c) for c in usable]
        assemble = VectorAssembler(inputCols=usable, outputCol="__v")
        dealt = train.select("dataset", "pos", *doubles).fillna(fill).repartition(-(-sizes["__n"] // FIT_ROWS), "dataset", "pos")
        ready = assemble.transform(dealt.sortWithinPartitions("dataset", "pos")).persist()
        scaler = StandardScaler(inputCol="__v", outputCol="__z", withMean=True, withStd=True).fit(ready)
        model = KMeans(featuresCol="__z", predictionCol="__id", k=k, seed=seed, maxIter=max_iter).fit(scaler.transform(ready))
        ready.unpersist()
        found = model.transform(scaler.transform(assemble.transform(test.select("dataset", "pos", *doubles).fillna(fill))))
        rows_of_centres = [
            (fold, i, *[float(z * s + m) for z, s, m in zip(centre, scaler.std.toArray(), scaler.mean.toArray())])
            for i, centre in enumerate(model.clusterCenters())
        ]
        schema = "fold int, cluster int, " + ", ".join(f"`{c}` double" for c in usable)
        table = label_clusters(
            spark.createDataFrame(rows_of_centres, schema), usable,
            {c: (marks[f"{c}_q33"], marks[f"{c}_q67"]) for c in usable},
        )
        centres.append(table)
        # k rows of labels
        labelled.append(
            found.select("dataset", "pos", F.col("__id").alias("cluster"))
            .join(F.broadcast(table.select("cluster", "label")), "cluster")
            .select("dataset", "pos", F.lit(fold).alias("fold"), F.col("label").alias(label))
        )
    from fcverify.sources.readers import union_tables

    none = spark.createDataFrame([], "fold int, cluster int, label string")
    return union_tables(labelled), union_tables(centres) if centres else none


def label_clusters(centres: DataFrame, columns: Sequence[str], cuts: Mapping[str, tuple[float, float]]) -> DataFrame:
    """Readable label per centre: up to three descriptors against the training 33% and 67% quantiles."""
    words: list[Column] = []
    for column, low, high in (
        ("wind_speed_ms", "calm", "ventilated"), ("humidity_pct", "dry", "humid"), ("temp_c", "cool", "warm"),
    ):
        if column in columns:
            q33, q67 = cuts[column]
            words.append(F.when(F.col(column) <= q33, low).when(F.col(column) >= q67, high))
    if "precip_mm" in columns:
        words.append(F.when(F.col("precip_mm") > 0.1, "wet"))
    if "solar_rad_wm2" in columns:
        words.append(F.when(F.col("solar_rad_wm2") >= cuts["solar_rad_wm2"][1], "sunny"))
    name = F.concat(F.lit("cluster_"), F.col("cluster").cast("string"))
    found = F.array_compact(F.array(*words)) if words else F.array().cast("array<string>")
    kept = F.when(F.size(found) > 0, F.array_distinct(F.slice(found, 1, 3))).otherwise(F.array(name))
    return centres.withColumn("label", F.concat(name, F.lit("_"), F.array_join(kept, "_")))


OVERALL = ("overall", "overall", None)
PHYSICAL = (
    OVERALL,
    ("physical", "ventilation", "physical_ventilation_regime"),
    ("physical", "moisture", "physical_moisture_regime"),
    ("physical", "season", "physical_season_regime"),
)
SEASONAL = (("seasonal", "warm_cold", "warm_cold_season"), ("seasonal", "four_seasons", "origin_season"))


def regime_metrics(
    master: DataFrame,
    schemes: Sequence[tuple[str, str, str | None]],
    protocol: str = "rolling_origin",
    min_samples: int = MIN_SAMPLES,
    min_events: int = MIN_EVENTS,
) -> DataFrame:
    """All schemes in one aggregate: rows fan out to (scheme, regime) and are reduced map-side."""
    fan = F.array(
        *[
            F.struct(
                F.lit(kind).alias("scheme_type"), F.lit(name).alias("scheme_name"),
                (F.lit("all") if column is None else F.coalesce(F.col(column), F.lit("nan"))).alias("regime"),
            )
            for kind, name, column in schemes
        ]
    )
    rows = master.select("dataset", "model", "horizon", "y_true", "y_pred", "y_persist", "event_threshold", F.explode(fan).alias("s"))
    keys = ["dataset", "scheme_type", "scheme_name", "regime", "model", "horizon"]
    seen, flagged = F.col("y_true") > F.col("event_threshold"), F.col("y_pred") > F.col("event_threshold")
    sums = (
        rows.select("*", "s.*")
        .groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("sample_count"),
            F.count_if(seen).alias("event_count"),
            F.count_if(flagged).alias("__flagged"),
            F.count_if(seen & flagged).alias("__tp"),
            X.rmse("y_true", "y_pred").alias("__rmse"),
            X.mae("y_true", "y_pred").alias("__mae"),
            X.rmse("y_true", "y_persist").alias("__base"),
            F.var_pop("y_true").alias("__vo"),
            F.var_pop("y_pred").alias("__vp"),
        )
        .withColumns(
            {
                "insufficient_samples": F.col("sample_count") < min_samples,
                "insufficient_events": F.col("event_count") < min_events,
            }
        )
    )
    enough = ~F.col("insufficient_samples")
    events = enough & ~F.col("insufficient_events")
    skill = F.when(enough & (F.col("__base") > 0), F.lit(1.0) - X.divide("__rmse", "__base"))
    ratio = F.when(enough & (F.col("__vo") > 0), X.divide("__vp", "__vo"))
    return sums.select(
        F.lit(protocol).alias("protocol"), F.col("dataset").alias("station"),
        "scheme_type", "scheme_name", "regime", "model", "horizon", "sample_count", "event_count",
        F.when(enough, F.col("__rmse")).alias("rmse"),
        F.when(enough, F.col("__mae")).alias("mae"),
        F.when(enough, F.col("__base")).alias("rmse_persistence"),
        skill.alias("skill_rmse"),
        F.when(enough, F.col("__vo")).alias("var_obs"),
        F.when(enough, F.col("__vp")).alias("var_pred"),
        (F.lit(100.0) * ratio).alias("vr"),
        (skill * F.when(ratio.isNotNull(), F.least(F.lit(1.0), ratio))).alias("skill_vp"),
        X.divide("event_count", "sample_count").alias("base_rate"),
        F.when(events, X.divide("__tp", "event_count")).alias("event_recall"),
        F.when(events, X.divide("__tp", "__flagged")).alias("event_precision"),
        X.divide("__flagged", "sample_count").alias("flag_rate"),
        "insufficient_samples", "insufficient_events",
    )


def regime_skill_summary(master: DataFrame, cluster_sizes: Sequence[int] = (), **options) -> DataFrame:
    schemes = [*PHYSICAL, *[("clustered", f"cluster_k{k}", f"cluster_k{k}_regime") for k in cluster_sizes]]
    return regime_metrics(master, schemes, **options)


EVENT_COLUMNS = [
    "protocol", "station", "scheme_type", "scheme_name", "regime", "model", "horizon", "sample_count", "event_count",
    "base_rate", "event_recall", "event_precision", "flag_rate", "insufficient_samples", "insufficient_events",
]


def regime_event_summary(summary: DataFrame) -> DataFrame:
    return summary.select(*EVENT_COLUMNS)


def seasonal_skill_summary(master: DataFrame, **options) -> DataFrame:
    return regime_metrics(master, SEASONAL, **options)


def support_table(summary: DataFrame) -> DataFrame:
    flag = F.when(F.col("insufficient_samples"), "low_support").otherwise("ok")
    return (
        summary.filter(F.col("scheme_type").isin("physical", "clustered"))
        .groupBy("scheme_name", "regime", "horizon")
        .agg(F.max("sample_count").alias("sample_count"), F.max(flag).alias("support_flag"))
    )


def regime_pivot(summary: DataFrame, metric: str, horizons: Sequence[int], keys: Sequence[str] = ("scheme_name", "regime", "model")) -> DataFrame:
    """Row label x horizon matrix of one metric."""
    return summary.groupBy(*keys).agg(
        *[F.avg(F.when(F.col("horizon") == h, F.col(metric))).alias(f"h{h}") for h in horizons]
    )
