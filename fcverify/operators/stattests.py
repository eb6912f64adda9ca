"""Significance tests, decompositions and correlations."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.quantiles import metric_percentiles, value_ranks
from fcverify.functions.scan import CHUNK, bounded_window, running
from fcverify.functions.special import student_t_two_sided
from fcverify.operators.metrics import CELL, with_baseline
from fcverify.operators.series import day_index
from fcverify.session import settle


def autocovariance_sums(
    df: DataFrame, keys: Sequence[str], index: str, value: str, max_lag: int, lag_limit: Column | None = None, chunk: int = CHUNK
) -> DataFrame:
    """Per key: ``n``, ``mean`` and array ``autocov`` for lags 0..max_lag over the non-null sequence.

    Lag k averages over the n-k pairs and is 0 for k >= n. Positions, the mean and the
    lags come from chunked scans, so one key may span many tasks.
    """
    keys = list(keys)
    finite = df.withColumn("__x", X.no_nan(F.col(value))).filter(F.col("__x").isNotNull())
    placed = running(
        finite.select(*keys, index, "__x"), keys, [index],
        sums={"__pos": F.lit(1)}, totals={"__n": F.lit(1), "__sum": F.col("__x")}, chunk=chunk,
    ).withColumn("__d", F.col("__x") - F.col("__sum") / F.col("__n"))
    lagged = bounded_window(
        placed.select(*keys, "__pos", "__n", "__sum", "__d"), keys, "__pos",
        lambda w: {f"__lag{k}": F.lag("__d", k).over(w) for k in range(1, max_lag + 1)},
        back=max_lag, chunk=chunk,
    )
    products = [F.avg(X.square(F.col("__d")))] + [
        F.coalesce(F.avg(F.col("__d") * F.col(f"__lag{k}")), F.lit(0.0)) for k in range(1, max_lag + 1)
    ]
    return lagged.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n"),
        (F.first("__sum") / F.first("__n")).alias("mean"),
        F.array(*products).alias("autocov"),
    )


def autocovariance(df: DataFrame, keys: Sequence[str], index: str, value: str, max_lag: int, chunk: int = CHUNK) -> DataFrame:
    sums = autocovariance_sums(df, keys, index, value, max_lag, chunk=chunk)
    return sums.select(*keys, "n", F.posexplode("autocov").alias("lag", "autocov"))


def dm_hln(losses: DataFrame, index: str, max_horizon: int = 7, chunk: int = CHUNK) -> DataFrame:
    """Diebold-Mariano statistic with the small-sample correction per cell.

    ``losses`` has the cell columns, an integer ``index`` that orders the sequence and
    ``loss_diff``; lags run over the finite differences only.
    """
    sums = autocovariance_sums(losses, CELL, index, "loss_diff", max_horizon - 1, chunk=chunk)
    n, h = F.col("n").cast("double"), F.col("horizon")
    tail = F.slice("autocov", F.lit(2), F.greatest(h - 1, F.lit(0)))
    spread = F.aggregate(tail, F.try_element_at("autocov", F.lit(1)), lambda acc, g: acc + F.lit(2.0) * g)
    var = spread / n
    correction = (n + 1 - 2 * h + h * (h - 1) / n) / n
    valid = (F.col("n") > F.greatest(F.lit(2), h)) & (var > 0) & (correction > 0)
    stat = F.when(valid, X.divide(F.col("mean"), F.sqrt(F.when(var > 0, var))) * F.sqrt(F.when(correction > 0, correction)))
    return sums.select(*CELL, F.col("n").alias("n_finite"), stat.alias("dm_stat"))


def bh_adjust(df: DataFrame, p: str, output: str, keys: Sequence[str] = ("dataset",), tie: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Benjamini-Hochberg within each key; NULL p-values stay NULL and are not counted."""
    given = F.col(p).isNotNull()
    group = Window.partitionBy(*keys)
    order = group.orderBy(F.col(p).asc_nulls_last(), *tie)
    ranked = df.withColumns({"__rank": F.row_number().over(order), "__m": F.count(p).over(group)})
    raw = F.col(p) * F.col("__m") / F.col("__rank")
    tail = order.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return (
        ranked.withColumn("__raw", F.when(given, raw))
        .withColumn(output, F.when(given, F.least(F.min("__raw").over(tail), F.lit(1.0))))
        .drop("__rank", "__m", "__raw")
    )


def loss_differences(predictions: DataFrame, baseline: str = "persistence") -> DataFrame:
    """Squared loss of the baseline minus squared loss of the model on matched (fold, date) rows."""
    fold = "fold" if "fold" in predictions.columns else "origin_date"
    matched = with_baseline(predictions, baseline, ["dataset", "horizon", fold, "date"], {"y_true": "y_true_base"})
    y = F.col("y_true")
    return matched.withColumn("loss_diff", X.square(y - F.col("y_base")) - X.square(y - F.col("y_pred"))).withColumn(
        "truth_differs",
        X.truth(F.abs(y - F.col("y_true_base")) > F.lit(1e-8) + F.lit(1e-5) * F.abs("y_true_base"))
        | (y.isNull() != F.col("y_true_base").isNull()),
    )


def dm_statistics(matched: DataFrame, max_horizon: int = 7, chunk: int = CHUNK) -> DataFrame:
    """``n_pairs, dm_stat, n_finite`` per cell from ``loss_differences``; differing truths raise.

    Counts, means and lags each read the rows, so give a stored table here.
    """
    losses = matched.withColumn("__i", day_index("date"))
    pairs = losses.groupBy(*CELL).agg(F.count(F.lit(1)).alias("n_pairs"), F.count_if("truth_differs").alias("__bad"))
    checked = pairs.withColumn(
        "n_pairs",
        F.when(F.col("__bad") > 0, F.raise_error(F.lit("y_true differs between model and baseline")).cast("long")).otherwise(
            F.col("n_pairs")
        ),
    ).drop("__bad")
    return checked.join(dm_hln(losses, "__i", max_horizon, chunk), CELL, "left")


def dm_table(
    predictions: DataFrame,
    baseline: str = "persistence",
    max_horizon: int = 7,
    level: float = 0.05,
    chunk: int = CHUNK,
    matched: DataFrame | None = None,
) -> DataFrame:
    """Test per cell with p-values adjusted within each dataset.

    The join with the baseline is the costly shuffle; its narrow result is written out
    once. ``matched`` passes an already stored one.
    """
    if matched is None:
        matched = settle(loss_differences(predictions, baseline).select(*CELL, "date", "loss_diff", "truth_differs"))
    stats = dm_statistics(matched, max_horizon, chunk)
    p = student_t_two_sided(F.col("dm_stat"), (F.col("n_finite") - 1).cast("double"))
    tested = stats.withColumn("dm_pval_raw", p).drop("n_finite")
    return bh_adjust(tested, "dm_pval_raw", "dm_pval_bh").withColumn("dm_significant", X.truth(F.col("dm_pval_bh") < level))


def murphy_decomposition(predictions: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """MSE = bias^2 + conditional bias^2 + irreducible part; a broken identity raises."""
    sums = predictions.groupBy(*CELL).agg(
        F.avg(X.square(F.col("y_pred") - F.col("y_true"))).alias("mse"),
        F.avg("y_true").alias("__mt"),
        F.avg("y_pred").alias("__mp"),
        F.var_pop("y_true").alias("__vt"),
        F.stddev_pop("y_true").alias("std_true_ug"),
        F.stddev_pop("y_pred").alias("std_pred_ug"),
        F.covar_pop("y_pred", "y_true").alias("__c"),
    )
    st, sp = F.col("std_true_ug"), F.col("std_pred_ug")
    parts = sums.withColumn("rho", F.coalesce(X.divide(F.col("__c"), st * sp), F.lit(0.0))).withColumns(
        {
            "bias_sq": X.square(F.col("__mp") - F.col("__mt")),
            "cond_bias_sq": X.square(sp - F.col("rho") * st),
            "irreducible_sq": (F.lit(1.0) - X.square(F.col("rho"))) * F.col("__vt"),
            "alpha": F.coalesce(X.square(X.divide(sp, st)), F.lit(0.0)),
        }
    )
    total = F.col("bias_sq") + F.col("cond_bias_sq") + F.col("irreducible_sq")
    broken = F.abs(total - F.col("mse")) > F.lit(tolerance) * F.greatest(F.lit(1.0), F.col("mse"))
    return parts.select(
        *CELL,
        F.when(broken, F.raise_error(F.lit("decomposition does not sum to the mean squared error")).cast("double"))
        .otherwise(F.col("mse"))
        .alias("mse"),
        "bias_sq", "cond_bias_sq", "irreducible_sq", "rho", "std_pred_ug", "std_true_ug", "alpha",
    )


def kge_components(predictions: DataFrame, keys: Sequence[str] = CELL) -> DataFrame:
    """Correlation, SD ratio, mean ratio and KGE over finite pairs; undefined parts are NULL."""
    t, p = X.no_nan("y_true"), X.no_nan("y_pred")
    pairs = predictions.select(*keys, t.alias("__t"), p.alias("__p")).withColumn(
        "__ok", F.col("__t").isNotNull() & F.col("__p").isNotNull()
    )
    both_t, both_p = F.when(F.col("__ok"), F.col("__t")), F.when(F.col("__ok"), F.col("__p"))
    sums = pairs.groupBy(*keys).agg(
        F.count_if("__ok").alias("n"),
        F.avg(both_t).alias("__mt"), F.avg(both_p).alias("__mp"),
        F.stddev_pop(both_t).alias("__st"), F.stddev_pop(both_p).alias("__sp"),
        F.covar_pop(both_p, both_t).alias("__c"),
    )
    enough = F.col("n") >= 2
    st, sp = F.col("__st"), F.col("__sp")
    parts = sums.withColumns(
        {
            "r_h": F.when(enough & (st > X.TINY) & (sp > X.TINY), X.divide(F.col("__c"), st * sp)),
            "alpha_h": F.when(enough & (st > X.TINY), X.divide(sp, st)),
            "beta_h": F.when(enough & (F.abs("__mt") > X.TINY), X.divide("__mp", "__mt")),
        }
    )
    distance = F.sqrt(sum((X.square(F.col(c) - 1.0) for c in ("alpha_h", "beta_h")), X.square(F.col("r_h") - 1.0)))
    return parts.select(*keys, "n", "r_h", "alpha_h", "beta_h", (F.lit(1.0) - distance).alias("KGE_h"))


def kge_skill(model: Column | str, reference: Column | str) -> Column:
    """1 - KGE/KGE_ref, NULL for a reference near zero.

    With a positive reference a better model has a *lower* value; ``kge_gain`` is the usual skill form.
    """
    m, r = X.col(model), X.col(reference)
    return F.when(F.abs(r) > X.TINY, F.lit(1.0) - X.divide(m, r))


def kge_gain(model: Column | str, reference: Column | str) -> Column:
    m, r = X.col(model), X.col(reference)
    return X.divide(m - r, F.lit(1.0) - r)


def kge_horizon_table(predictions: DataFrame, baseline: str = "persistence") -> DataFrame:
    """Components and KGE skill per cell, baseline rows removed; predictions without any baseline row raise."""
    cells = kge_components(predictions)
    present = predictions.filter(F.col("model") == baseline).select(F.count(F.lit(1)) > 0).scalar()
    missing = F.raise_error(F.lit(f"no rows of the baseline model {baseline}")).cast("boolean")
    cells = cells.filter(F.when(present, F.lit(True)).otherwise(missing))
    base = cells.filter(F.col("model") == baseline).select("dataset", "horizon", F.col("KGE_h").alias("KGE_persistence_h"))
    return (
        cells.filter(F.col("model") != baseline)
        .join(base, ["dataset", "horizon"], "left")
        .select(
            "dataset", F.col("dataset").alias("station"), "model", F.col("horizon").alias("h"), "horizon", "n",
            "r_h", "alpha_h", F.col("alpha_h").alias("phi_h"), "beta_h", "KGE_h", "KGE_persistence_h",
            kge_skill("KGE_h", "KGE_persistence_h").alias("KGE_skill_h"),
        )
    )


def kge_with_master(kge: DataFrame, master: DataFrame) -> DataFrame:
    """Inner join with the diagnostic table and the check that alpha_h is the root of alpha."""
    wanted = ["skill", "mae_skill", "skill_vp", "alpha", "station_id", "station_name", "province", "station_type",
              "station_class", "lat", "lon", "altitude_m", "dem_code"]
    keep = [c for c in wanted if c in master.columns]
    right = master.select("dataset", "model", F.col("horizon").alias("h"), *keep)
    joined = kge.drop("horizon", "station").join(right, ["dataset", "model", "h"])
    station = F.col("station_id") if "station_id" in keep else F.col("dataset")
    out = joined.withColumn("station", station).withColumnsRenamed({"skill": "Skill_h", "alpha": "alpha_source"})
    root = F.when(F.col("alpha_source") >= 0, F.sqrt(F.col("alpha_source")))
    return out.withColumns(
        {
            "phi_source_sqrt_alpha": root,
            "abs_alpha_h_minus_phi_source_sqrt_alpha": F.abs(F.col("alpha_h") - root),
            "abs_alpha_h_minus_phi_h": F.abs(F.col("alpha_h") - F.col("phi_h")),
        }
    )


KGE_METRICS = ("r_h", "alpha_h", "beta_h", "KGE_h", "KGE_skill_h")


def metric_quantile_summary(kge: DataFrame, metrics: Sequence[str] = KGE_METRICS, keys: Sequence[str] = ("model", "h")) -> DataFrame:
    """Median and interquartile range of each metric per model and horizon."""
    quart = metric_percentiles(kge, list(keys), metrics, {"q25": 0.25, "median": 0.5, "q75": 0.75})
    any_value = F.coalesce(*[F.col(m) for m in metrics]).isNotNull()
    valid = kge.groupBy(*keys).agg(F.count_if(any_value).alias("n_stations_valid"))
    return valid.join(quart, list(keys)).select(
        *keys, "n_stations_valid",
        *[c for m in metrics for c in (F.col(f"{m}_median"), (F.col(f"{m}_q75") - F.col(f"{m}_q25")).alias(f"{m}_iqr"))],
    )


def spearman(df: DataFrame, pairs: Mapping[str, tuple[str, str]], keys: Sequence[str] = (), min_n: int = 1) -> DataFrame:
    """Rank correlation with average ties per named pair of columns (and per key), with its p-value.

    Ranks come from counted values, not from a global sort in one task. The pairs are
    written out once because both rankings read them several times.
    """
    keys = list(keys)
    fan = F.array(
        *[
            F.struct(F.lit(n).alias("comparison"), F.col(a).cast("double").alias("a"), F.col(b).cast("double").alias("b"))
            for n, (a, b) in pairs.items()
        ]
    )
    long = df.select(*keys, F.explode(fan).alias("p")).select(*keys, "p.*").filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    group = [*keys, "comparison"]
    long = settle(long)
    ranked = long.join(value_ranks(long, group, "a", "ra"), [*group, "a"]).join(value_ranks(long, group, "b", "rb"), [*group, "b"])
    sums = ranked.groupBy(*group).agg(
        F.count(F.lit(1)).alias("n"),
        F.covar_pop("ra", "rb").alias("__c"), F.stddev_pop("ra").alias("__sa"), F.stddev_pop("rb").alias("__sb"),
    )
    rho = X.divide(F.col("__c"), F.col("__sa") * F.col("__sb"))
    scored = sums.filter(F.col("n") >= min_n).select(*group, "n", rho.alias("spearman_rho"))
    r = F.col("spearman_rho")
    t = r * F.sqrt(X.divide((F.col("n") - 2).cast("double"), F.greatest(F.lit(1e-300), (F.lit(1.0) - r) * (F.lit(1.0) + r))))
    return scored.withColumn("p_value", student_t_two_sided(t, (F.col("n") - 2).cast("double")))
