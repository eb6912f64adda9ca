"""Exact percentiles of a growing history."""

from __future__ import annotations

from bisect import insort
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.functions.scan import CHUNK, chunk_id
from fcverify.session import settle


def _chunk_percentiles(index: str, levels: Mapping[str, float], keys: Sequence[str]):
    """Percentiles inside one chunk, given the earlier values that can still be selected."""

    def run(local: pd.DataFrame, earlier: pd.DataFrame) -> pd.DataFrame:
        names = [*keys, index, *levels]
        if local.empty:
            return pd.DataFrame(columns=names)
        local = local.sort_values(index)
        values = local["__v"].to_numpy(float)
        prior = int(local["__prior"].iloc[0])
        out = {k: local[k].to_numpy() for k in [*keys, index]}
        for level, p in levels.items():
            mine = earlier[earlier["__level"] == level]
            pool = sorted(mine["__past_v"].to_numpy(float))
            below = int(mine["__below"].min()) if len(mine) else prior
            result = np.empty(len(values))
            for i, v in enumerate(values):
                if below and (not pool or v < pool[0]):
                    below += 1
                else:
                    insort(pool, v)
                at = (prior + i) * p
                k = int(at)
                low = pool[k - below]
                high = pool[k - below + 1] if at > k else low
                result[i] = low + (high - low) * (at - k)
            out[level] = result
        return pd.DataFrame(out)[names]

    return run


def expanding_percentile(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    value: str,
    levels: Mapping[str, float],
    chunk: int = CHUNK,
    buckets: int = 128,
) -> DataFrame:
    """Exact linear percentile of all values up to each row, for every row of each key.

    ``index`` is unique per key and ``value`` is not NULL. A chunk of the series
    moves an order statistic of the earlier history by at most its own length, so
    only the earlier values whose rank lies near the wanted one can be selected
    inside the chunk. A histogram over sketch quantiles finds them: each chunk
    receives those values and the number of values below them, and no task holds
    a whole history. The input (one row per key and index) is written out once.
    """
    keys, names = list(keys), list(levels)
    rows = settle(
        df.select(*keys, F.col(index).cast("long").alias(index), F.col(value).cast("double").alias("__v")).withColumn(
            "__chunk", chunk_id(F.col(index), chunk)
        )
    )
    cuts = rows.groupBy(*keys).agg(
        F.percentile_approx("__v", [i / buckets for i in range(1, buckets)], 20 * buckets).alias("__cuts")
    )
    placed = rows.join(cuts, keys).withColumn("__b", F.size(F.filter("__cuts", lambda e: e < F.col("__v")))).drop("__cuts")

    counts = placed.groupBy(*keys, "__chunk", "__b").agg(F.count(F.lit(1)).alias("__c"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    sizes = (
        counts.groupBy(*keys, "__chunk")
        .agg(F.sum("__c").alias("__own"))
        .withColumn("__prior", F.coalesce(F.sum("__own").over(before), F.lit(0)))
    )
    grid = sizes.select(*keys, "__chunk", "__own", "__prior", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))).alias("__b"))
    earlier = Window.partitionBy(*keys, "__b").orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    lower = Window.partitionBy(*keys, "__chunk").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    histogram = (
        grid.join(counts, [*keys, "__chunk", "__b"], "left")
        .withColumn("__past", F.coalesce(F.sum("__c").over(earlier), F.lit(0)))
        .withColumn("__below", F.coalesce(F.sum("__past").over(lower), F.lit(0)))
    )
    wanted = F.array(
        *[
            F.struct(
                F.lit(n).alias("level"),
                (F.floor(F.col("__prior") * F.lit(float(levels[n]))) - F.col("__own") - 1).alias("first"),
                (F.ceil((F.col("__prior") + F.col("__own")) * F.lit(float(levels[n]))) + 1).alias("last"),
            )
            for n in names
        ]
    )
    needed = (
        histogram.filter(F.col("__past") > 0)
        .select(*keys, F.col("__chunk").alias("__to"), "__b", "__past", "__below", F.explode(wanted).alias("w"))
        .filter((F.col("__below") <= F.col("w.last")) & (F.col("__below") + F.col("__past") - 1 >= F.col("w.first")))
        .select(*keys, "__to", "__b", "__below", F.col("w.level").alias("__level"))
    )
    supplied = (
        placed.join(needed, [*keys, "__b"])
        .filter(F.col("__chunk") < F.col("__to"))
        .select(
            *[F.col(k).alias(f"__of_{k}") for k in keys],
            "__to", "__level", "__below", F.col("__v").alias("__past_v"),
        )
    )
    local = rows.join(sizes.select(*keys, "__chunk", "__prior"), [*keys, "__chunk"])
    kept = [f for f in local.schema.fields if f.name in keys]
    schema = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in kept] + [f"`{index}` bigint"] + [f"`{n}` double" for n in names]
    )
    # other names on the second side: both sides descend from the same rows
    other = [*[f"__of_{k}" for k in keys], "__to"]
    return local.groupBy(*keys, "__chunk").cogroup(supplied.groupBy(*other)).applyInPandas(
        _chunk_percentiles(index, levels, keys), schema
    )
