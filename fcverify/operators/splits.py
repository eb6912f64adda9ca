"""Chronological splits as bounds tables; no index lists are ever built."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions.scan import CHUNK, asof_join, bounded_window, running
from fcverify.operators.series import KEYS, time_column


def rolling_origin_pairs(
    df: DataFrame, min_train: int = 60, max_horizon: int = 7, step: int = 1, chunk: int = CHUNK
) -> DataFrame:
    """(origin, horizon) pairs by row position; every origin has all horizons, so folds number in closed form."""
    if max_horizon < 1 or min_train < 1 or step < 1:
        raise ValueError("max_horizon, min_train and step must be positive")
    rows = df.select(*KEYS, "date", F.datediff("date", F.lit("1970-01-01").cast("date")).cast("long").alias("idx"))
    placed = running(
        rows, KEYS, ["idx"], sums={"pos": F.lit(1)}, totals={"n_rows": F.lit(1)}, chunk=chunk
    ).withColumn("pos", F.col("pos") - 1)
    starts = df.groupBy(*KEYS).agg(F.min("date").alias("train_start"))
    ahead = bounded_window(
        placed, KEYS, "pos",
        lambda w: {
            "__t": F.array(
                *[F.struct(F.lit(h).alias("horizon"), F.lead("date", h).over(w).alias("target_date")) for h in range(1, max_horizon + 1)]
            )
        },
        ahead=max_horizon, chunk=chunk,
    )
    first = F.lit(min_train - 1)
    origins = ahead.filter(
        (F.col("pos") >= first) & (F.col("pos") < F.col("n_rows") - max_horizon) & ((F.col("pos") - first) % step == 0)
    )
    return (
        origins.join(starts, KEYS)
        .select(*KEYS, "train_start", F.col("date").alias("origin_date"), "pos", F.explode("__t").alias("t"))
        .select(
            *KEYS,
            (F.expr(f"(pos - {min_train - 1}) div {step}") * max_horizon + F.col("t.horizon") - 1).alias("fold"),
            "train_start",
            F.col("origin_date").alias("train_end"),
            "origin_date",
            "t.horizon",
            "t.target_date",
            (F.col("pos") + F.col("t.horizon")).alias("test_index"),
        )
    )


def bounds_table(lengths: DataFrame, folds: Column) -> DataFrame:
    return lengths.select(*KEYS, F.explode(folds).alias("f")).select(*KEYS, "f.fold", "f.train_end", "f.test_end")


def _fold(fold: Column | int, train_end: Column, test_end: Column) -> Column:
    f = F.lit(fold) if isinstance(fold, int) else fold
    return F.struct(f.cast("int").alias("fold"), train_end.cast("long").alias("train_end"), test_end.cast("long").alias("test_end"))


def expanding_folds_pct(lengths: DataFrame, initial: float = 0.5, test: float = 0.1, n_folds: int = 5) -> DataFrame:
    """Bounds by percentages of ``n_rows``; a fold that would pass the end is dropped."""
    n = F.col("n_rows")
    head, size = F.floor(n * F.lit(initial)), F.floor(n * F.lit(test))
    folds = F.array(*[_fold(f, head + f * size, head + (f + 1) * size) for f in range(n_folds)])
    return bounds_table(lengths, F.filter(folds, lambda f: f["test_end"] <= n))


def expanding_folds(lengths: DataFrame, n_folds: int = 5) -> DataFrame:
    """First half for training, the rest in equal tests; a remainder at the tail is unused."""
    half = F.expr("n_rows div 2")
    size = F.expr(f"(n_rows - n_rows div 2) div {n_folds}")
    return bounds_table(lengths, F.array(*[_fold(f, half + f * size, half + (f + 1) * size) for f in range(n_folds)]))


def holdout_split(lengths: DataFrame, train: float = 0.8) -> DataFrame:
    n = F.col("n_rows")
    return bounds_table(lengths, F.array(_fold(0, F.floor(n * F.lit(train)), n)))


def fold_membership(df: DataFrame, bounds: DataFrame) -> DataFrame:
    """Rows ``dataset, pos, horizon`` to their folds with ``role`` train or test; targets stay inside the window.

    The few folds of a series travel as one array, so rows join once on the
    series and fan out only to the folds they belong to.
    """
    packed = bounds.groupBy(*KEYS).agg(F.collect_list(F.struct("fold", "train_end", "test_end")).alias("__folds"))
    pos, target = F.col("pos"), F.col("pos") + F.col("horizon")
    roles = F.transform(
        "__folds",
        lambda f: F.struct(
            f["fold"].alias("fold"),
            F.when(target < f["train_end"], "train")
            .when((pos >= f["train_end"]) & (target < f["test_end"]), "test")
            .alias("role"),
        ),
    )
    member = F.filter(roles, lambda r: r["role"].isNotNull())
    return (
        df.join(packed, KEYS)
        .select(*df.columns, F.explode(member).alias("m"))
        .select(*df.columns, "m.fold", "m.role")
    )


def training_rows(df: DataFrame, bounds: DataFrame, reach: Column | None = None) -> DataFrame:
    """Each row once per fold whose training window holds it (``pos + reach < train_end``)."""
    packed = bounds.groupBy(*KEYS).agg(F.collect_list(F.struct("fold", "train_end")).alias("__folds"))
    at = F.col("pos") if reach is None else F.col("pos") + reach
    inside = F.filter("__folds", lambda f: at < f["train_end"])
    return df.join(packed, KEYS).select(*df.columns, F.explode(inside).alias("m")).select(*df.columns, "m.fold")


def origin_filter(df: DataFrame, start_year: int, end_year: int, step: int = 1, chunk: int = CHUNK) -> DataFrame:
    """Observed origins inside the years, every ``step``-th per series."""
    seen = df.filter(F.col("y").isNotNull() & F.year("date").between(start_year, end_year))
    numbered = running(seen, KEYS, ["idx"], sums={"__k": F.lit(1)}, chunk=chunk)
    return numbered.filter((F.col("__k") - 1) % step == 0).drop("__k")


def train_window(samples: DataFrame, features: Sequence[str], min_rows: int = 365, chunk: int = CHUNK) -> DataFrame:
    """Rows with enough history at their own date: complete samples whose target is known, and observed days.

    ``samples`` is the dense long table ``dataset, horizon, idx, y, target, target_date`` plus features.
    """
    whole = F.lit(True)
    for c in [*features, "target", "target_date"]:
        whole = whole & F.col(c).isNotNull()
    keys = [*KEYS, "horizon"]
    known = samples.filter(whole).select(*keys, (F.col("idx") + F.col("horizon")).alias("__known"))
    counted = running(known, keys, ["__known"], sums={"n_train": F.lit(1)}, chunk=chunk)
    seen = running(samples, keys, ["idx"], sums={"n_observed": F.col("y").isNotNull().cast("int")}, chunk=chunk)
    both = asof_join(seen, counted, keys, "idx", "__known", ["n_train"], chunk=chunk)
    return both.filter((F.col("n_train") >= min_rows) & (F.col("n_observed") >= min_rows))


def series_lengths(df: DataFrame) -> DataFrame:
    """Rows per dense series."""
    time = time_column(df)
    return df.groupBy(*KEYS).agg(F.count(time).alias("n_rows"))
