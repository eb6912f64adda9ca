"""Ordered computations over long series without one task per series.

A plain ``Window.partitionBy(series)`` sends a whole series to one task. The
helpers here cut every series into chunks of its integer index and make
``(series, chunk)`` the unit of work:

* ``bounded_window`` serves frames of fixed reach (lags, leads, rolling
  windows). Rows near a chunk border are copied to the neighbour chunk.
* ``running`` serves unbounded-preceding frames (cumulative sums, fill-forward).
  Each chunk is scanned on its own and the state carried in from earlier chunks
  comes from a window over one summary row per chunk.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

CHUNK = 1024


def chunk_id(index: Column, size: int) -> Column:
    return F.floor(index / F.lit(size))


def bounded_window(
    df: DataFrame,
    keys: Sequence[str],
    index: str,
    build: Callable[[WindowSpec], Mapping[str, Column]],
    back: int = 0,
    ahead: int = 0,
    chunk: int = CHUNK,
) -> DataFrame:
    """Add the columns ``build(window)`` returns; frames may reach ``back``/``ahead`` rows.

    ``index`` must be gap-free within each key (a dense grid or a row position), so
    that a distance in rows equals a distance in ``index``.
    """
    i = F.col(index)
    copies = F.sequence(chunk_id(i - F.lit(ahead), chunk), chunk_id(i + F.lit(back), chunk))
    spread = df.withColumn("__home", chunk_id(i, chunk)).withColumn("__chunk", F.explode(copies))
    window = Window.partitionBy(*keys, "__chunk").orderBy(index)
    return (
        spread.withColumns(dict(build(window)))
        .filter(F.col("__home") == F.col("__chunk"))
        .drop("__home", "__chunk")
    )


def running(
    df: DataFrame,
    keys: Sequence[str],
    order: Sequence[str],
    sums: Mapping[str, Column] | None = None,
    lasts: Mapping[str, Column] | None = None,
    totals: Mapping[str, Column] | None = None,
    chunk: int = CHUNK,
    chunk_column: Column | None = None,
) -> DataFrame:
    """Add running sums and last non-null values, current row included.

    ``order[0]`` is the integer index that defines the chunks unless
    ``chunk_column`` (monotone in the order) is given. ``totals`` adds sums over
    the whole key, which come for free from the chunk summaries.
    """
    sums, lasts, totals = dict(sums or {}), dict(lasts or {}), dict(totals or {})
    part = [*keys, "__chunk"]
    base = df.withColumn("__chunk", chunk_id(F.col(order[0]), chunk) if chunk_column is None else chunk_column)

    position = F.struct(*[F.col(c) for c in order])
    summary = base.groupBy(*part).agg(
        F.count(F.lit(1)).alias("__rows"),
        *[F.sum(e).alias(f"__s_{n}") for n, e in sums.items()],
        *[F.max_by(e, F.when(e.isNotNull(), position)).alias(f"__l_{n}") for n, e in lasts.items()],
        *[F.sum(e).alias(f"__t_{n}") for n, e in totals.items()],
    )
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy(*keys)
    carry = summary.select(
        *part,
        *[F.sum(f"__s_{n}").over(before).alias(f"__s_{n}") for n in sums],
        *[F.last(f"__l_{n}", ignorenulls=True).over(before).alias(f"__l_{n}") for n in lasts],
        *[F.sum(f"__t_{n}").over(whole).alias(n) for n in totals],
    )

    local = Window.partitionBy(*part).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    scanned = base.withColumns(
        {
            **{f"__r_{n}": F.sum(e).over(local) for n, e in sums.items()},
            **{f"__f_{n}": F.last(e, ignorenulls=True).over(local) for n, e in lasts.items()},
        }
    )
    joined = scanned.join(carry, part)
    zero = F.lit(0)
    done = joined.withColumns(
        {
            **{
                n: F.when(
                    F.col(f"__r_{n}").isNotNull() | F.col(f"__s_{n}").isNotNull(),
                    F.coalesce(F.col(f"__r_{n}"), zero) + F.coalesce(F.col(f"__s_{n}"), zero),
                )
                for n in sums
            },
            **{n: F.coalesce(F.col(f"__f_{n}"), F.col(f"__l_{n}")) for n in lasts},
        }
    )
    return done.drop(
        "__chunk",
        *[f"__r_{n}" for n in sums],
        *[f"__s_{n}" for n in sums],
        *[f"__f_{n}" for n in lasts],
        *[f"__l_{n}" for n in lasts],
    )


def with_position(df: DataFrame, keys: Sequence[str], order: Sequence[str], name: str = "pos", chunk: int = CHUNK) -> DataFrame:
    """Zero-based row position within each key; ``order`` must be unique per key."""
    return running(df, keys, order, sums={name: F.lit(1)}, chunk=chunk).withColumn(name, F.col(name) - 1)


def asof_join(
    left: DataFrame,
    right: DataFrame,
    keys: Sequence[str],
    left_index: str,
    right_index: str,
    values: Sequence[str],
    chunk: int = CHUNK,
) -> DataFrame:
    """Attach to each left row the ``values`` of the latest right row with index <= its own.

    The scan runs over the distinct indexes of the left side, one row each however many rows
    share it; an equi-join, which adaptive execution splits where skewed, brings them back.
    """
    at = left.select(*keys, F.col(left_index).cast("long").alias("__i")).distinct().withColumn("__side", F.lit(1))
    packed = right.select(
        *keys, F.col(right_index).cast("long").alias("__i"), F.lit(0).alias("__side"), F.struct(*values).alias("__right")
    )
    both = at.unionByName(packed, allowMissingColumns=True)
    found = running(both, keys, ["__i", "__side"], lasts={"__seen": F.col("__right")}, chunk=chunk)
    seen = found.filter(F.col("__side") == 1).select(*keys, "__i", "__seen")
    columns = [F.col(c) for c in left.columns if c not in keys]
    rows = left.withColumn("__i", F.col(left_index).cast("long")).join(seen, [*keys, "__i"], "left")
    return rows.select(*keys, *columns, *[F.col("__seen")[v].alias(v) for v in values])
