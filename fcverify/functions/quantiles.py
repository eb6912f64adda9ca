"""Exact percentiles and ranks for groups of any size."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.functions.scan import CHUNK, running

# Most ranges that the values of one group are cut into.
RANGES = 1024


def _cumulative(df: DataFrame, keys: Sequence[str], value: str, chunk: int, ranges: int) -> DataFrame:
    """keys, value, __c (rows with it), __upto (rows up to it), __n (rows of the group).

    Values are counted first, so ties are one row whatever their number. A group of more
    than ``chunk`` distinct values is cut into ranges of about that many (at most
    ``ranges``) at sketch quantiles; a chunked running sum adds up the counts. Nothing is
    gathered: a task sorts one range of counted values and may spill.
    """
    keys = list(keys)
    counts = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("__c"))
    cuts = counts.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("__distinct"), F.percentile_approx(value, [i / ranges for i in range(1, ranges)], 4 * ranges).alias("__cuts")
    )
    # every step-th cut: ranges of about ``chunk`` distinct values
    step = F.greatest(F.lit(1), F.floor(F.lit(float(ranges * chunk)) / F.col("__distinct"))).cast("int")
    chosen = F.filter("__cuts", lambda c, i: (i + 1) % step == 0)
    cuts = cuts.select(*keys, F.when(F.col("__distinct") > chunk, chosen).otherwise(F.slice("__cuts", 1, 0)).alias("__cuts"))
    placed = counts.join(cuts, keys).withColumn("__range", F.size(F.filter("__cuts", lambda c: c < F.col(value)))).drop("__cuts")
    return running(
        placed, keys, [value], sums={"__upto": F.col("__c")}, totals={"__n": F.col("__c")}, chunk_column=F.col("__range")
    ).drop("__range")


def grouped_percentile(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    levels: Mapping[str, float],
    chunk: int = CHUNK,
    ranges: int = RANGES,
) -> DataFrame:
    """Exact linear-interpolation percentiles per group, NULL values ignored.

    The same path for groups of every size: counted values, their running count, and the
    first values whose running count passes the wanted ranks.
    """
    keys = list(keys)
    if not keys:
        raise ValueError("give at least one key; use a constant column for the whole table")
    rows = df.select(*keys, F.col(value).cast("double").alias("__v"))
    counted = _cumulative(rows, keys, "__v", chunk, ranges)

    def place(level: float):
        return (F.col("__n") - 1) * F.lit(float(level))

    found = counted.groupBy(*keys, "__n").agg(
        *[
            F.min(F.when(F.col("__upto") >= F.floor(place(p)) + ahead, F.col("__v"))).alias(f"__{name}_{ahead}")
            for name, p in levels.items()
            for ahead in (1, 2)
        ]
    )
    out = []
    for name, p in levels.items():
        low = F.col(f"__{name}_1")
        high = F.coalesce(F.col(f"__{name}_2"), low)
        out.append((low + (high - low) * (place(p) - F.floor(place(p)))).alias(name))
    return found.select(*keys, *out)


def medians(df: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Exact median of several columns per group, through one long table."""
    return metric_percentiles(df, keys, columns, {"median": 0.5}).select(
        *keys, *[F.col(f"{c}_median") for c in columns]
    )


def metric_percentiles(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], levels: Mapping[str, float]
) -> DataFrame:
    """Wide table ``<column>_<level>`` of exact percentiles of several columns."""
    long = df.select(
        *keys,
        F.explode(
            F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).cast("double").alias("value")) for c in columns])
        ).alias("m"),
    ).select(*keys, "m.metric", "m.value")
    tall = grouped_percentile(long, [*keys, "metric"], "value", levels)
    return tall.groupBy(*keys).agg(
        *[
            F.max(F.when(F.col("metric") == c, F.col(level))).alias(f"{c}_{level}")
            for c in columns
            for level in levels
        ]
    )


def value_ranks(
    df: DataFrame, keys: Sequence[str], value: str, name: str, chunk: int = CHUNK, ranges: int = RANGES
) -> DataFrame:
    """Table ``keys, value, name`` of ascending average-tie ranks over arbitrarily large groups."""
    counted = _cumulative(df.select(*keys, value), keys, value, chunk, ranges)
    return counted.select(*keys, value, (F.col("__upto") - F.col("__c") + (F.col("__c") + 1) / 2.0).alias(name))
