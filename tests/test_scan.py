"""Chunked computations against the plain single-window form, with chunks far smaller than the series."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from fcverify.functions.expanding import expanding_percentile
from fcverify.functions.quantiles import _cumulative, grouped_percentile, medians, metric_percentiles, value_ranks
from fcverify.functions.scan import asof_join, bounded_window, running, with_position


@pytest.fixture(scope="module")
def table(spark):
    rng = np.random.default_rng(1)
    rows = []
    for key, n, start in (("a", 400, -120), ("b", 37, 5), ("c", 1, 0)):
        for i in range(n):
            y = None if rng.random() < 0.2 else float(np.round(rng.normal(), 1))
            rows.append((key, start + i, y))
    return spark.createDataFrame(rows, "dataset string, idx long, y double").cache()


def same(left, right, keys):
    a = left.toPandas().sort_values(keys).reset_index(drop=True)
    b = right.toPandas().sort_values(keys).reset_index(drop=True)[list(a.columns)]
    pd.testing.assert_frame_equal(a, b, check_dtype=False, rtol=1e-9)


@pytest.mark.parametrize("chunk", [8, 64, 1024])
def test_bounded_window_equals_plain_window(table, chunk):
    plain = Window.partitionBy("dataset").orderBy("idx")

    def build(w):
        return {
            "lag3": F.lag("y", 3).over(w),
            "lead5": F.lead("y", 5).over(w),
            "mean7": F.avg("y").over(w.rowsBetween(-6, 0)),
        }

    chunked = bounded_window(table, ["dataset"], "idx", build, back=6, ahead=5, chunk=chunk)
    same(chunked, table.withColumns(build(plain)), ["dataset", "idx"])


@pytest.mark.parametrize("chunk", [8, 1024])
def test_running_equals_plain_window(table, chunk):
    plain = Window.partitionBy("dataset").orderBy("idx").rowsBetween(Window.unboundedPreceding, 0)
    chunked = running(
        table, ["dataset"], ["idx"], sums={"s": F.col("y")}, lasts={"l": F.col("y")}, totals={"t": F.lit(1)}, chunk=chunk
    )
    expected = table.withColumns(
        {
            "s": F.sum("y").over(plain),
            "l": F.last("y", ignorenulls=True).over(plain),
            "t": F.count(F.lit(1)).over(Window.partitionBy("dataset")),
        }
    )
    same(chunked, expected, ["dataset", "idx"])


def test_position_is_row_number(table):
    out = with_position(table, ["dataset"], ["idx"], chunk=16).toPandas().sort_values(["dataset", "idx"])
    for _, group in out.groupby("dataset"):
        assert list(group["pos"]) == list(range(len(group)))


def test_asof_join_equals_merge_asof(spark, table):
    left = spark.createDataFrame([("a", i, f"r{i}") for i in range(-130, 290, 7)] + [("z", 1, "none")], "dataset string, at long, tag string")
    right = table.filter("idx % 5 = 0 and y is not null")
    out = asof_join(left, right, ["dataset"], "at", "idx", ["idx", "y"], chunk=16).toPandas().sort_values("at").reset_index(drop=True)
    r = right.filter("dataset = 'a'").toPandas().sort_values("idx")
    l = left.filter("dataset = 'a'").toPandas().sort_values("at")
    expected = pd.merge_asof(l, r[["idx", "y"]], left_on="at", right_on="idx")
    got = out[out["dataset"] == "a"].reset_index(drop=True)
    np.testing.assert_allclose(got["y"].astype(float), expected["y"].astype(float))
    assert out[out["dataset"] == "z"]["y"].isna().all()


def test_grouped_percentile_is_exact_on_small_groups(spark):
    rng = np.random.default_rng(2)
    frame = pd.DataFrame({"g": rng.integers(0, 3, 5000), "v": np.round(rng.normal(size=5000), 2)})
    df = spark.createDataFrame(frame)
    out = grouped_percentile(df, ["g"], "v", {"p10": 0.1, "p75": 0.75}).toPandas().set_index("g")
    for g, part in frame.groupby("g"):
        assert out.loc[g, "p75"] == pytest.approx(np.percentile(part["v"], 75), abs=1e-12)
        assert out.loc[g, "p10"] == pytest.approx(np.percentile(part["v"], 10), abs=1e-12)
    with pytest.raises(ValueError):
        grouped_percentile(df, [], "v", {"p10": 0.1})


def test_percentiles_of_mostly_tied_values(spark):
    """Four fifths of the rows are one value: it is one counted row, and no range exceeds its size."""
    df = spark.range(200_000).select(
        F.lit("hot").alias("g"), F.when(F.col("id") % 5 > 0, 0.0).otherwise((F.hash("id") % 100_003).cast("double")).alias("v"))
    values = df.select("v").toPandas()["v"]
    counted = _cumulative(df, ["g"], "v", 512, 256)
    assert counted.count() == values.nunique() and counted.filter("v = 0").first()["__c"] >= 160_000
    levels = {"p05": 0.05, "p50": 0.5, "p95": 0.95, "top": 1.0, "low": 0.0}
    out = grouped_percentile(df, ["g"], "v", levels, chunk=512, ranges=256).first()
    for name, p in levels.items():
        assert out[name] == pytest.approx(np.percentile(values, 100 * p), abs=1e-9)


def test_asof_join_with_many_rows_at_one_index(spark):
    left = spark.createDataFrame([("a", 5, i) for i in range(300)] + [("a", None, 1), ("b", 5, 2)], "k string, at long, tag int")
    right = spark.createDataFrame([("a", 3, 1.0), ("a", 6, 2.0)], "k string, at long, v double")
    out = asof_join(left, right, ["k"], "at", "at", ["v"], chunk=4).collect()
    assert sorted((r.k, r.at or -1, r.v or 0.0) for r in out) == [("a", -1, 0.0)] + [("a", 5, 1.0)] * 300 + [("b", 5, 0.0)]


def test_grouped_percentile_on_a_large_group(spark):
    df = spark.range(300_000).select(F.lit("hot").alias("g"), (F.hash("id") % 1_000_003).cast("double").alias("v"))
    out = grouped_percentile(df, ["g"], "v", {"p75": 0.75, "p90": 0.9}).first()
    values = df.select("v").toPandas()["v"]
    assert out["p75"] == pytest.approx(np.percentile(values, 75), abs=1e-9)
    assert out["p90"] == pytest.approx(np.percentile(values, 90), abs=1e-9)


def test_metric_percentiles_and_medians_ignore_nulls(spark):
    df = spark.createDataFrame([("a", 1.0, None), ("a", 2.0, 5.0), ("a", 10.0, 7.0)], "k string, x double, z double")
    assert medians(df, ["k"], ["x", "z"]).first().asDict() == {"k": "a", "x_median": 2.0, "z_median": 6.0}
    q = metric_percentiles(df, ["k"], ["x"], {"q25": 0.25}).first()
    assert q["x_q25"] == 1.5


def test_value_ranks_are_average_ranks(spark):
    rng = np.random.default_rng(3)
    frame = pd.DataFrame({"g": rng.integers(0, 2, 800), "v": rng.integers(0, 60, 800).astype(float)})
    ranks = value_ranks(spark.createDataFrame(frame), ["g"], "v", "r", chunk=8, ranges=64).toPandas()
    expected = frame.assign(r=frame.groupby("g")["v"].rank()).drop_duplicates()
    merged = expected.merge(ranks, on=["g", "v"], suffixes=("", "_got"))
    assert len(merged) == len(expected)
    np.testing.assert_allclose(merged["r"], merged["r_got"])


@pytest.mark.parametrize("chunk", [16, 64, 4096])
def test_expanding_percentile_is_exact(spark, chunk):
    rng = np.random.default_rng(4)
    values = np.concatenate([rng.normal(size=250), np.repeat(0.5, 60), rng.normal(3, 1, 200)])
    rows = [("a", int(i * 2 - 100), float(v)) for i, v in enumerate(values)] + [("b", i, float(i % 7)) for i in range(30)]
    df = spark.createDataFrame(rows, "dataset string, idx long, y double")
    levels = {"p75": 0.75, "p90": 0.9, "low": 0.0, "top": 1.0, "p33": 1 / 3}
    out = expanding_percentile(df, ["dataset"], "idx", "y", levels, chunk=chunk, buckets=16).toPandas()
    for key, group in pd.DataFrame(rows, columns=["dataset", "idx", "y"]).groupby("dataset"):
        got = out[out["dataset"] == key].sort_values("idx").reset_index(drop=True)
        assert len(got) == len(group)
        seen = group.sort_values("idx")["y"].to_numpy()
        for i in range(len(seen)):
            for name, p in levels.items():
                assert got[name][i] == pytest.approx(np.percentile(seen[: i + 1], 100 * p), abs=1e-9), (key, i, name)
