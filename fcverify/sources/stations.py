"""Station dimension, inventory and selection."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fcverify.functions import expr as X

DIMENSION = ["station_name", "province", "station_type", "lat", "lon", "altitude_m", "dem_code"]


def station_class(station_type: Column) -> Column:
    low = F.lower(station_type)
    return F.when(low.contains("rural"), "rural").when(low.contains("industrial"), "industrial").otherwise("urban")


def station_dimension(df: DataFrame, dimension: DataFrame, key: str = "dataset") -> DataFrame:
    """Attach station attributes; stations missing from the dimension get defaults."""
    dim = dimension.select(F.col("station_id").alias(key), *[c for c in DIMENSION if c in dimension.columns])
    out = df.join(dim, key, "left").withColumn("station_id", F.col(key))
    out = out.withColumn("station_name", F.coalesce("station_name", F.col(key)))
    for c in ("province", "station_type", "dem_code"):
        if c in dim.columns:
            out = out.withColumn(c, F.coalesce(F.col(c), F.lit("Unknown")))
    return out.withColumn("station_class", station_class(F.col("station_type")))


def series_inventory(series: DataFrame) -> DataFrame:
    """Calendar span, valid days, coverage and years per series (one row per date expected)."""
    return (
        series.groupBy("dataset")
        .agg(
            (F.datediff(F.max("date"), F.min("date")) + 1).alias("n_days"),
            F.count("y").alias("valid_days"),
            F.countDistinct(F.year("date")).alias("n_years"),
            F.min("date").alias("date_min"),
            F.max("date").alias("date_max"),
        )
        .withColumn("coverage", F.round(X.divide(F.col("valid_days"), F.col("n_days")), 3))
    )


def select_series(
    inventory: DataFrame,
    min_coverage: float = 0.75,
    min_years: int = 5,
    excluded: DataFrame | None = None,
    n: int | None = None,
) -> DataFrame:
    good = inventory.filter((F.col("coverage") >= min_coverage) & (F.col("n_years") >= min_years))
    if excluded is not None:
        good = good.join(excluded.select("dataset"), "dataset", "left_anti")
    if n is not None:
        good = good.orderBy(F.desc("coverage"), "dataset").limit(n)
    return good


def keep_series(series: DataFrame, selected: DataFrame | Sequence[str]) -> DataFrame:
    if isinstance(selected, DataFrame):
        return series.join(selected.select("dataset"), "dataset", "left_semi")
    return series.filter(F.col("dataset").isin(*selected))
