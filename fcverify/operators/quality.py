"""Data-quality and reconciliation checks; each returns a table, none collects rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.operators.series import hour_index


def null_profile(df: DataFrame, columns: Sequence[str] | None = None, warn_pct: float = 10.0) -> DataFrame:
    """Nulls per column in one scan."""
    names = list(columns or df.columns)
    wide = df.agg(F.count(F.lit(1)).alias("n_rows"), *[F.count_if(F.col(c).isNull()).alias(c) for c in names])
    return (
        wide.unpivot(["n_rows"], names, "column_name", "n_null")
        .withColumn("null_pct", X.percent(F.col("n_null"), F.col("n_rows"), None))
        .withColumn("warn", X.truth(F.col("null_pct") > warn_pct))
    )


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def assert_unique(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One row: number of duplicated keys; raises when it is not zero."""
    worst = duplicate_keys(df, keys).agg(F.count(F.lit(1)).alias("n_duplicated"))
    return worst.select(
        F.when(F.col("n_duplicated") > 0, F.raise_error(F.lit("duplicate keys")).cast("long")).otherwise(F.col("n_duplicated")).alias("n_duplicated")
    )


def reconcile(
    recomputed: DataFrame, published: DataFrame, keys: Sequence[str], columns: Sequence[str], atol: float = 1e-9, rtol: float = 1e-9
) -> DataFrame:
    """Full outer comparison: per column the largest difference and the cells out of tolerance."""
    a = recomputed.select(*keys, F.lit(True).alias("__a"), *[F.col(c).alias(f"__a_{c}") for c in columns])
    b = published.select(*keys, F.lit(True).alias("__b"), *[F.col(c).alias(f"__b_{c}") for c in columns])
    both = a.join(b, list(keys), "full")
    fan = F.array(
        *[
            F.struct(F.lit(c).alias("column_name"), F.col(f"__a_{c}").cast("double").alias("x"), F.col(f"__b_{c}").cast("double").alias("y"))
            for c in columns
        ]
    )
    rows = both.select(F.col("__a").isNull().alias("only_b"), F.col("__b").isNull().alias("only_a"), F.explode(fan).alias("p")).select(
        "only_a", "only_b", "p.*"
    )
    gap = F.abs(F.col("x") - F.col("y"))
    both_null = F.col("x").isNull() & F.col("y").isNull()
    close = X.truth(gap <= F.lit(atol) + F.lit(rtol) * F.abs("y")) | both_null
    return rows.groupBy("column_name").agg(
        F.count_if(~F.col("only_a") & ~F.col("only_b")).alias("n_matched"),
        F.count_if("only_a").alias("n_only_recomputed"),
        F.count_if("only_b").alias("n_only_published"),
        F.max(gap).alias("max_abs_diff"),
        F.max(X.divide(gap, F.abs("y"))).alias("max_rel_diff"),
        F.count_if(~close & ~F.col("only_a") & ~F.col("only_b")).alias("n_out_of_tolerance"),
    )


def lead_time_check(predictions: DataFrame, threshold: str = "p75_train") -> DataFrame:
    """Rows whose lead is not the horizon, and thresholds per fold (one expected)."""
    lead = hour_index("target_time") - hour_index("origin_time")
    return predictions.groupBy("dataset", "fold").agg(
        F.count_if(lead != F.col("horizon")).alias("wrong_lead"), F.countDistinct(threshold).alias("n_thresholds")
    )


def truth_consistency(predictions: DataFrame, tolerance: float = 0.0) -> DataFrame:
    """Dates whose truth differs between rows, per dataset."""
    days = predictions.groupBy("dataset", "date").agg((F.max("y_true") - F.min("y_true")).alias("spread"))
    return days.groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n_dates"), F.count_if(F.col("spread") > tolerance).alias("n_inconsistent")
    )


def length_consistency(predictions: DataFrame) -> DataFrame:
    """Rows per model and whether all models of a (dataset, horizon) have the same number."""
    sizes = predictions.groupBy("dataset", "horizon", "model").agg(F.count(F.lit(1)).alias("n"))
    return sizes.groupBy("dataset", "horizon").agg(
        F.min("n").alias("min_n"), F.max("n").alias("max_n"), (F.min("n") == F.max("n")).alias("equal_lengths")
    )


def expected_counts(actual: DataFrame, expected: Mapping[str, Sequence], key: str, columns: Sequence[str]) -> DataFrame:
    """Rows of a summary that differ from a fixed table of expected values; empty means verified."""
    types = ", ".join(f"`exp_{c}` double" for c in columns)
    table = actual.sparkSession.createDataFrame([(k, *map(float, v)) for k, v in expected.items()], f"`{key}` string, {types}")
    joined = table.join(actual.select(key, *columns), key, "left")
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | ~F.col(c).cast("double").eqNullSafe(F.col(f"exp_{c}"))
    return joined.filter(wrong)


def compare_expected(actual: DataFrame, expected: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """The same check against a table: keys whose values differ or are missing."""
    right = expected.select(*keys, *[F.col(c).alias(f"exp_{c}") for c in columns])
    joined = right.join(actual.select(*keys, *columns), list(keys), "left")
    wrong = F.lit(False)
    for c in columns:
        wrong = wrong | ~F.col(c).eqNullSafe(F.col(f"exp_{c}"))
    return joined.filter(wrong)
