"""Series preparation: calendars, fills, features, targets.

Daily series are ``dataset, date, y``; hourly series are ``dataset, ts, y``. A
dense series also has ``idx``, the integer day or hour number since 1970, which
is gap-free within a dataset.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.scan import CHUNK, bounded_window, running

KEYS = ["dataset"]
MONTH_LENGTHS = "interval 1 month"


def day_index(c: Column | str) -> Column:
    return F.datediff(X.col(c), F.lit("1970-01-01").cast("date")).cast("long")


def hour_index(c: str) -> Column:
    """Hours since 1970 from calendar parts, so that no time zone rule applies."""
    return day_index(F.col(c).cast("date")) * 24 + F.hour(c)


def truncate_hour(c: str) -> Column:
    return F.col(c).cast("date").cast("timestamp_ntz") + F.make_dt_interval(F.lit(0), F.hour(c))


def time_column(df: DataFrame) -> str:
    return "date" if "date" in df.columns else "ts"


def with_index(df: DataFrame) -> DataFrame:
    time = time_column(df)
    return df.withColumn("idx", day_index(time) if time == "date" else hour_index(time))


def dedupe_first(df: DataFrame, order: Sequence[str], keys: Sequence[str] | None = None) -> DataFrame:
    """First row per key in ``order``; an aggregate, so copies are thinned before the shuffle."""
    keys = list(keys or [*KEYS, time_column(df)])
    rest = [c for c in df.columns if c not in keys]
    lead = [c for c in order if c not in keys]
    first = F.min_by(F.struct(*rest), F.struct(*lead))
    return df.groupBy(*keys).agg(first.alias("r")).select(*keys, *[F.col("r")[c].alias(c) for c in rest])


def densify(df: DataFrame) -> DataFrame:
    """Complete calendar from the first to the last row of each series; gaps are NULL.

    The grid is built in two steps, months first, so that one long span is
    expanded by many tasks.
    """
    time = time_column(df)
    step = "interval 1 day" if time == "date" else "interval 1 hour"
    span = df.groupBy(*KEYS).agg(F.min(time).alias("lo"), F.max(time).alias("hi"))
    months = span.select(
        *KEYS, "lo", "hi",
        F.explode(F.expr(f"sequence(to_date(trunc(cast(lo as date), 'MM')), cast(hi as date), {MONTH_LENGTHS})")).alias("m"),
    )
    if time == "date":
        start, stop = "greatest(lo, m)", "least(hi, last_day(m))"
    else:
        start = "greatest(lo, cast(m as timestamp_ntz))"
        stop = "least(hi, cast(last_day(m) as timestamp_ntz) + interval 23 hours)"
    grid = months.select(*KEYS, F.explode(F.expr(f"sequence({start}, {stop}, {step})")).alias(time))
    return with_index(grid.join(df, [*KEYS, time], "left"))


def causal_ffill(df: DataFrame, column: str = "y", output: str = "y_causal", method: str = "ffill", chunk: int = CHUNK) -> DataFrame:
    """Fill from the latest earlier observation; a leading gap stays NULL."""
    if method != "ffill":
        raise ValueError(f"non-causal fill refused: {method}")
    return running(df, KEYS, ["idx"], lasts={output: F.col(column)}, chunk=chunk)


def zscore_train(df: DataFrame, bounds: DataFrame, column: str = "y", output: str = "y_z") -> DataFrame:
    """(y - mean)/sd with moments of rows up to ``train_end`` only (sd with n-1)."""
    limited = df.join(bounds.select(*KEYS, "train_end"), KEYS)
    inside = F.when(F.col(time_column(df)) <= F.col("train_end"), F.col(column))
    fitted = limited.groupBy(*KEYS).agg(F.avg(inside).alias("__m"), F.stddev_samp(inside).alias("__s"))
    return (
        df.join(fitted, KEYS)
        .withColumn(output, X.divide(F.col(column) - F.col("__m"), F.col("__s")))
        .drop("__m", "__s")
    )


def add_lags(df: DataFrame, lags: Sequence[int], column: str = "y", prefix: str = "lag_", chunk: int = CHUNK) -> DataFrame:
    return bounded_window(
        df, KEYS, "idx", lambda w: {f"{prefix}{k}": F.lag(column, k).over(w) for k in lags}, back=max(lags), chunk=chunk
    )


def rolling_columns(w, windows: Sequence[int], column: str, stats: Sequence[str]) -> dict[str, Column]:
    make = {"mean": F.avg, "std": F.stddev_samp, "min": F.min, "max": F.max}
    out = {}
    for size in windows:
        frame = w.rowsBetween(-(size - 1), 0)
        full = F.count(column).over(frame) == size
        for s in stats:
            out[f"rolling_{s}_{size}"] = F.when(full, make[s](column).over(frame))
    return out


def add_rolling(df: DataFrame, windows: Sequence[int], column: str = "y", stats: Sequence[str] = ("mean", "std", "min", "max"), chunk: int = CHUNK) -> DataFrame:
    """Trailing statistics, NULL unless the window is full of values."""
    return bounded_window(df, KEYS, "idx", lambda w: rolling_columns(w, windows, column, stats), back=max(windows) - 1, chunk=chunk)


def add_calendar(df: DataFrame, time: str = "ts") -> DataFrame:
    return df.withColumns(
        {"hour": F.hour(time), "dayofweek": F.weekday(F.col(time).cast("date")), "month": F.month(F.col(time).cast("date"))}
    )


def cyclic_columns(at: Column) -> dict[str, Column]:
    day = at.cast("date")
    angle = {
        "hour": F.hour(at) / F.lit(24.0),
        "dow": F.weekday(day) / F.lit(7.0),
        "month": (F.month(day) - 1) / F.lit(12.0),
    }
    turn = F.lit(2.0) * F.pi()
    return {
        **{f"target_{n}_sin": F.sin(turn * a) for n, a in angle.items()},
        **{f"target_{n}_cos": F.cos(turn * a) for n, a in angle.items()},
    }


def add_cyclic_target_time(df: DataFrame, horizon: str = "horizon") -> DataFrame:
    """Sine and cosine of hour, weekday and month at verification time."""
    target = F.col("ts") + F.expr(f"make_dt_interval(0, {horizon})")
    return df.withColumns(cyclic_columns(target))


def add_targets(df: DataFrame, horizons: Sequence[int], chunk: int = CHUNK) -> DataFrame:
    """Long form over horizons: ``horizon, target, target_date`` (NULL past the end of the series)."""
    time = time_column(df)
    wide = bounded_window(
        df, KEYS, "idx",
        lambda w: {
            "__t": F.array(
                *[
                    F.struct(
                        F.lit(h).alias("horizon"),
                        F.lead("y", h).over(w).alias("target"),
                        F.lead(time, h).over(w).alias("target_date"),
                    )
                    for h in horizons
                ]
            )
        },
        ahead=max(horizons), chunk=chunk,
    )
    return wide.select(*df.columns, F.explode("__t").alias("t")).select(*df.columns, "t.*")


def complete_cases(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.na.drop(subset=list(columns))


def multi_horizon_targets(df: DataFrame, horizons: Sequence[int], chunk: int = CHUNK) -> DataFrame:
    """Keep only samples whose targets exist at all horizons."""
    def leads(w):
        return {
            "__t": F.array(*[F.lead("y", h).over(w) for h in horizons]),
            "__d": F.array(*[F.lead(time_column(df), h).over(w) for h in horizons]),
        }

    wide = bounded_window(df, KEYS, "idx", leads, ahead=max(horizons), chunk=chunk)
    full = wide.filter(~F.exists("__t", lambda v: v.isNull()))
    rows = F.arrays_zip(
        F.array(*[F.lit(h) for h in horizons]).alias("horizon"), F.col("__t").alias("target"), F.col("__d").alias("target_date")
    )
    return full.select(*df.columns, F.explode(rows).alias("t")).select(*df.columns, "t.*")


def context_windows(df: DataFrame, length: int, stride: int = 1, column: str = "y", chunk: int = CHUNK) -> DataFrame:
    """Arrays of ``length`` consecutive values with the position of their last row.

    Needs ``pos``, the zero-based position in the series (``with_position``).
    """
    def frames(w):
        return {"context": F.collect_list(F.coalesce(F.col(column), F.lit(float("nan")))).over(w.rowsBetween(-(length - 1), 0))}

    made = bounded_window(df, KEYS, "pos", frames, back=length - 1, chunk=max(chunk, length))
    start = F.col("pos") - F.lit(length - 1)
    return made.filter((F.size("context") == length) & (start % stride == 0)).select(
        *KEYS, F.col("pos").alias("end_idx"),
        F.transform("context", lambda v: F.when(~F.isnan(v), v).cast("float")).alias("context"),
    )


def grid_position(df: DataFrame) -> DataFrame:
    """Position on a dense grid and series length, from the first and last index."""
    span = df.groupBy(*KEYS).agg(F.min("idx").alias("__lo"), F.max("idx").alias("__hi"))
    return (
        df.join(span, KEYS)
        .withColumn("pos", F.col("idx") - F.col("__lo"))
        .withColumn("n_rows", F.col("__hi") - F.col("__lo") + 1)
        .drop("__lo", "__hi")
    )


def season_labels(df: DataFrame, time: str = "date", warm_months: Sequence[int] = (4, 5, 6, 7, 8, 9)) -> DataFrame:
    month = F.month(F.col(time).cast("date"))
    return df.withColumns({"season": X.season(month), "warm_cold": X.warm_cold(month, warm_months)})


