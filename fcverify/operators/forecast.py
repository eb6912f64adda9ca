"""Forecast producers. Each returns rows of a predictions table."""

from __future__ import annotations

from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

from fcverify.functions import expr as X
from fcverify.functions.scan import CHUNK, bounded_window, running
from fcverify.operators import boosting
from fcverify.operators.series import KEYS, rolling_columns, with_index
from fcverify.sources.readers import union_tables

DAILY_COLUMNS = ["dataset", "model", "fold", "origin_date", "horizon", "date", "y_true", "y_pred"]
HORIZONS = tuple(range(1, 8))
SEASON = 7


def naive_wide(series: DataFrame, horizons: Sequence[int] = HORIZONS, season: int = SEASON, chunk: int = CHUNK) -> DataFrame:
    """Observed origins with, per horizon, the truth and the seasonal-naive value.

    Works on observed rows only, so no calendar has to be built: a target is looked
    up by its date among the following rows, and the seasonal value is the one
    last whole number of seasons before it (the origin itself where history is short).
    Adds ``mean_y``, the mean of the history up to the origin.
    """
    seen = with_index(series.filter(F.col("y").isNotNull()).select(*KEYS, "date", "y"))
    placed = running(seen, KEYS, ["idx"], sums={"pos": F.lit(1), "__sum": F.col("y")}, chunk=chunk).select(
        *KEYS, "date", "idx", "y", (F.col("pos") - 1).alias("pos"), (F.col("__sum") / F.col("pos")).alias("mean_y")
    )
    reach = max(horizons)
    back = [season * -(-h // season) - h for h in horizons]

    def frames(w):
        following = F.collect_list(F.struct("idx", "y")).over(w.rowsBetween(1, reach))
        return {
            "__next": F.map_from_entries(following),
            "__season": F.array(*[F.coalesce(F.lag("y", b).over(w), F.col("y")) for b in back]),
        }

    wide = bounded_window(placed, KEYS, "pos", frames, back=max(back), ahead=reach, chunk=chunk)
    per_horizon = F.array(
        *[
            F.struct(
                F.lit(h).alias("horizon"),
                F.try_element_at("__next", F.col("idx") + F.lit(h)).alias("y_true"),
                F.col("__season")[i].alias("seasonal"),
            )
            for i, h in enumerate(horizons)
        ]
    )
    return (
        wide.select(*KEYS, "date", "y", "mean_y", F.explode(per_horizon).alias("h"))
        .filter(F.col("h.y_true").isNotNull())
        .select(*KEYS, F.col("date").alias("origin_date"), "y", "mean_y", "h.*")
    )


def stack_models(wide: DataFrame, models: dict[str, Column]) -> DataFrame:
    """One row per model from a wide row; no join and no union of scans."""
    fan = F.array(*[F.struct(F.lit(n).alias("model"), c.cast("double").alias("y_pred")) for n, c in models.items()])
    return wide.select(
        *KEYS, "origin_date", "horizon", F.date_add("origin_date", F.col("horizon")).alias("date"), "y_true", F.explode(fan).alias("m")
    ).select(
        *KEYS, "m.model", F.date_format("origin_date", "yyyy-MM-dd").alias("fold"), "origin_date", "horizon", "date", "y_true", "m.y_pred"
    )


def persistence(series: DataFrame, horizons: Sequence[int] = HORIZONS, chunk: int = CHUNK) -> DataFrame:
    return stack_models(naive_wide(series, horizons, chunk=chunk), {"persistence": F.col("y")})


def seasonal_naive(series: DataFrame, horizons: Sequence[int] = HORIZONS, season: int = SEASON, chunk: int = CHUNK) -> DataFrame:
    return stack_models(naive_wide(series, horizons, season, chunk), {"seasonal_naive": F.col("seasonal")})


# ---- direct ridge from expanding moments -----------------------------------


def _moment_columns(n_lags: int) -> dict[str, Column]:
    """Moments of one training sample: features ``__tx``, target ``__ty``; NULL when incomplete."""
    def x(i):
        return F.col("__tx")[i]

    ok = F.col("__ok")
    out = {"m_n": F.when(ok, F.lit(1.0))}
    out.update({f"m_x{i}": F.when(ok, x(i)) for i in range(n_lags)})
    out.update({f"m_x{i}x{j}": F.when(ok, x(i) * x(j)) for i in range(n_lags) for j in range(i, n_lags)})
    out["m_y"] = F.when(ok, F.col("__ty"))
    out.update({f"m_x{i}y": F.when(ok, x(i) * F.col("__ty")) for i in range(n_lags)})
    return out


def ridge_from_moments(moments: np.ndarray, query: np.ndarray, penalty: float) -> np.ndarray:
    """Predictions of standardised ridge regressions, one system per row, solved as a batch."""
    rows, k = query.shape
    n = moments[:, 0]
    mean = moments[:, 1 : k + 1] / n[:, None]
    upper = np.triu_indices(k)
    gram = np.empty((rows, k, k))
    gram[:, upper[0], upper[1]] = moments[:, k + 1 : k + 1 + len(upper[0])]
    gram[:, upper[1], upper[0]] = gram[:, upper[0], upper[1]]
    at = k + 1 + len(upper[0])
    y_mean = moments[:, at] / n
    cross = moments[:, at + 1 : at + 1 + k] - n[:, None] * mean * y_mean[:, None]
    centred = gram - n[:, None, None] * mean[:, :, None] * mean[:, None, :]
    spread = np.sqrt(np.maximum(np.einsum("rii->ri", centred) / n[:, None], 0.0))
    spread = np.where(spread > 0, spread, 1.0)
    system = centred / spread[:, :, None] / spread[:, None, :] + penalty * np.eye(k)
    weights = np.linalg.solve(system, (cross / spread)[:, :, None])[:, :, 0]
    return y_mean + np.einsum("rk,rk->r", weights, (query - mean) / spread)


def _ridge_udf(penalty: float):
    @F.pandas_udf(DoubleType())
    def solve(moments: pd.Series, query: pd.Series) -> pd.Series:
        if len(moments) == 0:
            return pd.Series([], dtype=float)
        return pd.Series(ridge_from_moments(np.stack(moments.to_numpy()), np.stack(query.to_numpy()), penalty))

    return solve


def _expanding_ridge(
    dense: DataFrame, column: str, horizons: Sequence[int], n_lags: int, penalty: float, min_rows: int, season: int, chunk: int
) -> DataFrame:
    """Per (origin, horizon): truth, ridge prediction of ``column`` and ``__back`` = y(t + h - season).

    The training set of an origin is a prefix of the series, so its normal equations
    are running sums of per-day moments: each day adds the sample whose target it is.
    No model is refitted from rows.
    """
    deepest = max(horizons) + n_lags

    def frames(w):
        return {
            "__x": F.array(*[F.lag(column, k).over(w) for k in range(deepest)]),
            "__h": F.array(
                *[
                    F.struct(
                        F.lit(h).alias("horizon"),
                        F.lead("y", h).over(w).alias("y_true"),
                        F.lag("y", max(season - h, 0)).over(w).alias("__back"),
                    )
                    for h in horizons
                ]
            ),
        }

    wide = bounded_window(dense, KEYS, "idx", frames, back=max(deepest, season), ahead=max(horizons), chunk=chunk)
    long = (
        wide.select(*KEYS, "date", "idx", "y", "__x", F.explode("__h").alias("h"))
        .select(
            *KEYS, "date", "idx", "y", "h.*",
            F.slice("__x", 1, n_lags).alias("__q"),
            F.slice("__x", F.col("h.horizon") + 1, n_lags).alias("__tx"),
            F.col("__x")[0].alias("__ty"),
        )
        .withColumn("__ok", F.col("__ty").isNotNull() & ~F.exists("__tx", lambda v: v.isNull()))
    )
    moments = _moment_columns(n_lags)
    sums = {**moments, "__seen": F.when(F.col("y").isNotNull(), F.lit(1))}
    grown = running(long, [*KEYS, "horizon"], ["idx"], sums=sums, chunk=chunk)
    origins = grown.filter(
        (F.col("m_n") >= min_rows) & (F.col("__seen") >= min_rows)
        & F.col("y_true").isNotNull() & ~F.exists("__q", lambda v: v.isNull())
    )
    return origins.select(
        *KEYS, F.col("date").alias("origin_date"), "horizon", "y_true", "__back",
        _ridge_udf(penalty)(F.array(*moments), F.col("__q")).alias("__pred"),
    )


def ridge_direct(
    dense: DataFrame, horizons: Sequence[int] = HORIZONS, n_lags: int = 7, penalty: float = 1.0, min_rows: int = 365, chunk: int = CHUNK
) -> DataFrame:
    """Direct ridge on the last ``n_lags`` values, refitted at every origin on all earlier samples."""
    rows = _expanding_ridge(dense, "y", horizons, n_lags, penalty, min_rows, SEASON, chunk)
    return stack_models(rows, {"ridge_direct": F.col("__pred")})


def seasonal_ridge_direct(
    dense: DataFrame,
    horizons: Sequence[int] = HORIZONS,
    season: int = SEASON,
    n_lags: int = 7,
    penalty: float = 1.0,
    min_rows: int = 365,
    add_back: str = "raw",
    chunk: int = CHUNK,
) -> DataFrame:
    """Ridge on what remains after an expanding weekday mean.

    ``add_back='raw'`` adds the raw value one season before the target, ``'seasonal'``
    the seasonal term itself as known at the origin.
    """
    if add_back not in ("raw", "seasonal"):
        raise ValueError("add_back must be 'raw' or 'seasonal'")
    phase = dense.withColumn("__phase", F.pmod(F.col("idx"), F.lit(season)))
    seen = F.when(F.col("y").isNotNull(), F.lit(1))
    grown = running(phase, [*KEYS, "__phase"], ["idx"], sums={"__s": F.col("y"), "__c": seen}, chunk=chunk * season)
    seasonal = grown.withColumn("__term", X.divide("__s", "__c")).drop("__s", "__c", "__phase")
    rest = seasonal.withColumn("__rest", F.col("y") - F.col("__term"))
    rows = _expanding_ridge(rest, "__rest", horizons, n_lags, penalty, min_rows, season, chunk)
    if add_back == "raw":
        return stack_models(rows.filter(F.col("__back").isNotNull()), {"stl_ridge_direct": F.col("__pred") + F.col("__back")})
    terms = seasonal.select(
        *KEYS, F.explode(F.array(*[F.lit(h) for h in horizons])).alias("horizon"),
        F.col("idx").alias("__i"), F.col("__term"),
    ).withColumn("origin_date", F.date_add(F.lit("1970-01-01").cast("date"), (F.col("__i") - F.col("horizon") + season).cast("int")))
    joined = rows.join(terms.select(*KEYS, "horizon", "origin_date", "__term"), [*KEYS, "horizon", "origin_date"])
    return stack_models(joined.filter(F.col("__term").isNotNull()), {"stl_ridge_direct": F.col("__pred") + F.col("__term")})


# ---- boosted trees ----------------------------------------------------------

HOURLY_LAGS = (0, 1, 6, 24, 48, 168)
HOURLY_WINDOWS = (6, 24, 48, 168)


def hourly_features(
    filled: DataFrame, lags: Sequence[int] = HOURLY_LAGS, windows: Sequence[int] = HOURLY_WINDOWS, column: str = "y_causal", chunk: int = 4 * CHUNK
) -> DataFrame:
    """Lags and trailing means and deviations of the causally filled series in one window."""
    def frames(w):
        return {
            **{f"lag_{k}": F.lag(column, k).over(w) for k in lags},
            **rolling_columns(w, windows, column, ("mean", "std")),
        }

    return bounded_window(filled, KEYS, "idx", frames, back=max(max(lags), max(windows) - 1), chunk=chunk)


def feature_names(lags: Sequence[int] = HOURLY_LAGS, windows: Sequence[int] = HOURLY_WINDOWS) -> list[str]:
    cyclic = [f"target_{n}_{f}" for f in ("sin", "cos") for n in ("hour", "dow", "month")]
    return [f"lag_{k}" for k in lags] + [f"rolling_{s}_{w}" for w in windows for s in ("mean", "std")] + cyclic


def boosted_direct(
    samples: DataFrame,
    features: Sequence[str],
    horizons: Sequence[int],
    folds: Sequence[int],
    settings: boosting.Settings | None = None,
) -> DataFrame:
    """One boosted model per (fold, horizon), pooled over all series; all models grow together.

    ``samples`` are complete rows with ``dataset, pos, ts, fold, role, horizon, target`` and the
    features; test rows come back with ``y_pred``.
    """
    models = [(int(f), int(h)) for f in folds for h in horizons]
    return boosting.fit_predict(samples, features, models, ["fold", "horizon"], [*KEYS, "pos", "ts"], settings=settings)


# ---- seasonal autoregression from moments ------------------------------------


def _lagged(filled: DataFrame, period: int, column: str, chunk: int) -> DataFrame:
    """Values with the one before and the one a period before."""
    rows = filled.select(*KEYS, "pos", F.col(column).cast("double").alias("v"))
    return bounded_window(rows, KEYS, "pos", lambda w: {"__a": F.lag("v", 1).over(w), "__b": F.lag("v", period).over(w)}, back=period, chunk=chunk)


def seasonal_ar_coefficients(
    filled: DataFrame, bounds: DataFrame, period: int = 24, column: str = "y_causal", chunk: int = CHUNK
) -> DataFrame:
    """``n, c0, c1, c2`` per (dataset, fold): least squares of a value on the last one and the one a period back.

    Covariances of the training rows, one aggregate for all series and folds. NULL where
    the history is shorter than one period or the two regressors are collinear.
    """
    v, a, b = F.col("v"), F.col("__a"), F.col("__b")
    inside = _lagged(filled, period, column, chunk).join(bounds.select(*KEYS, "fold", "train_end"), KEYS).filter(F.col("pos") < F.col("train_end"))
    moments = inside.filter(v.isNotNull() & a.isNotNull() & b.isNotNull()).groupBy(*KEYS, "fold", "train_end").agg(
        F.count(F.lit(1)).alias("n"), F.avg("v").alias("mv"), F.avg("__a").alias("ma"), F.avg("__b").alias("mb"),
        F.var_pop("__a").alias("aa"), F.var_pop("__b").alias("bb"), F.covar_pop("__a", "__b").alias("ab"),
        F.covar_pop("__a", "v").alias("av"), F.covar_pop("__b", "v").alias("bv"),
    )
    det = F.col("aa") * F.col("bb") - F.col("ab") * F.col("ab")
    usable = (F.col("train_end") > period + 3) & (det > F.lit(X.TINY) * F.col("aa") * F.col("bb"))
    c1 = F.when(usable, X.divide(F.col("av") * F.col("bb") - F.col("bv") * F.col("ab"), det))
    c2 = F.when(usable, X.divide(F.col("bv") * F.col("aa") - F.col("av") * F.col("ab"), det))
    return moments.select(*KEYS, "fold", "n", c1.alias("c1"), c2.alias("c2"), "mv", "ma", "mb").select(
        *KEYS, "fold", "n", (F.col("mv") - F.col("c1") * F.col("ma") - F.col("c2") * F.col("mb")).alias("c0"), "c1", "c2"
    )


def seasonal_ar_direct(
    filled: DataFrame, bounds: DataFrame, horizons: Sequence[int], period: int = 24, column: str = "y_causal", chunk: int = CHUNK
) -> DataFrame:
    """Forecasts of every test origin: the autoregression run forward from its last ``period`` values.

    An origin is one row with its last values as an array; no group holds a series.
    Returns ``dataset, fold, pos, horizon, y_pred``; targets stay inside the test window.
    """
    steps = max(horizons)
    rows = filled.select(*KEYS, "pos", F.col(column).cast("double").alias("v"))
    recent = bounded_window(
        rows, KEYS, "pos", lambda w: {"__last": F.collect_list("v").over(w.rowsBetween(-(period - 1), 0))}, back=period, chunk=chunk)
    origins = recent.join(bounds.select(*KEYS, "fold", "train_end", "test_end"), KEYS).filter(
        (F.col("pos") >= F.col("train_end")) & (F.col("pos") < F.col("test_end")))
    fitted = origins.join(seasonal_ar_coefficients(filled, bounds, period, column, chunk), [*KEYS, "fold"], "left")
    path = F.aggregate(
        F.sequence(F.lit(1), F.lit(steps)), F.col("__last"),
        lambda made, _: F.concat(made, F.array(F.col("c0") + F.col("c1") * F.element_at(made, -1) + F.col("c2") * F.element_at(made, -period))))
    known = F.when((F.size("__last") == period) & F.col("c1").isNotNull(), path)
    wanted = F.explode(F.array(*[F.struct(F.lit(int(h)).alias("horizon"), F.get("__path", F.lit(period + int(h) - 1)).alias("y_pred")) for h in horizons]))
    return (
        fitted.withColumn("__path", known).select(*KEYS, "fold", "pos", "test_end", wanted.alias("h"))
        .select(*KEYS, F.col("fold").cast("int").alias("fold"), F.col("pos").cast("long").alias("pos"), "test_end", "h.*")
        .filter(F.col("pos") + F.col("horizon") < F.col("test_end")).drop("test_end")
    )


# ---- user-supplied forecasters ----------------------------------------------


def seasonal_ar(period: int = 24, order: int = 1) -> Callable[[np.ndarray, np.ndarray, np.ndarray, Sequence[int]], np.ndarray]:
    """Least-squares autoregression on the last ``order`` values and the value one period back.

    The returned function takes the training values, all causally filled values, the
    origin positions and the horizons, and gives an (origins x horizons) array.
    """
    back = [*range(1, order + 1), period]

    def design(values, ends):
        return np.column_stack([np.ones(len(ends))] + [values[ends - b + 1] for b in back])

    def forecast(train, values, origins, horizons):
        if len(train) <= period + len(back) + 1:
            raise ValueError("history is shorter than one period")
        ends = np.arange(period - 1, len(train) - 1)
        good = np.isfinite(train[ends + 1]) & np.isfinite(design(train, ends)).all(axis=1)
        coef, *_ = np.linalg.lstsq(design(train, ends)[good], train[ends + 1][good], rcond=None)
        deepest = max(period, order)
        usable = origins >= deepest - 1
        path = np.full((len(origins), deepest + max(horizons)), np.nan)
        for i in np.flatnonzero(usable):
            path[i, :deepest] = values[origins[i] - deepest + 1 : origins[i] + 1]
        for step in range(max(horizons)):
            at = deepest + step
            path[:, at] = coef[0] + sum(c * path[:, at - b] for c, b in zip(coef[1:], back))
        return path[:, [deepest + h - 1 for h in horizons]]

    return forecast


def grouped_forecast(
    filled: DataFrame,
    bounds: DataFrame,
    horizons: Sequence[int],
    forecaster: Callable[[np.ndarray, np.ndarray, np.ndarray, Sequence[int]], np.ndarray],
    column: str = "y_causal",
) -> DataFrame:
    """Fit any forecaster once per (dataset, fold) and emit test origins x horizons.

    ``filled`` has one row per grid step (``pos``, unique), so a group is at most one
    series' calendar. Targets stay inside the fold's test window. A fit that fails
    gives NULL predictions and its message in ``error``.
    """
    packed = bounds.groupBy(*KEYS).agg(F.collect_list(F.struct("fold", "train_end", "test_end")).alias("__folds"))
    inside = F.filter("__folds", lambda f: F.col("pos") < f["test_end"])
    rows = (
        filled.select(*KEYS, "pos", F.col(column).cast("double").alias("v"))
        .join(packed, KEYS)
        .select(*KEYS, "pos", "v", F.explode(inside).alias("f"))
        .select(*KEYS, "pos", "v", "f.*")
    )
    steps = [int(h) for h in horizons]

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("pos")
        first, last = int(group["train_end"].iloc[0]), int(group["test_end"].iloc[0])
        values = group["v"].to_numpy(float)
        origins = np.arange(first, min(last, len(values)))
        error = None
        try:
            made = np.asarray(forecaster(values[:first], values, origins, steps), dtype=float)
        except Exception as failure:  # a failed fit is a result, not a job failure
            made, error = np.full((len(origins), len(steps)), np.nan), f"{type(failure).__name__}: {failure}"
        out = pd.DataFrame(
            {
                "dataset": group["dataset"].iloc[0],
                "fold": int(group["fold"].iloc[0]),
                "pos": np.repeat(origins, len(steps)),
                "horizon": np.tile(steps, len(origins)),
                "y_pred": made.reshape(-1),
            }
        )
        out["error"] = error
        out["y_pred"] = out["y_pred"].astype(object).where(np.isfinite(out["y_pred"].to_numpy(float)), None)
        return out[out["pos"] + out["horizon"] < last]

    schema = "dataset string, fold int, pos long, horizon int, y_pred double, error string"
    return rows.groupBy(*KEYS, "fold").applyInPandas(run, schema)


def predictions_assembly(tables: Sequence[DataFrame], columns: Sequence[str] = DAILY_COLUMNS) -> DataFrame:
    """Stack producer outputs in contract order; ordering is left to the sink."""
    return union_tables([t.select(*columns) for t in tables])
