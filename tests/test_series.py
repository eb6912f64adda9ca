import datetime as dt

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fcverify.operators import boosting, forecast, series, splits
from fcverify.plans import hourly
from fcverify.sources import readers, stations

DAY0 = dt.date(2024, 1, 1)


def daily(spark, values, dataset="s", start=DAY0):
    rows = [(dataset, start + dt.timedelta(days=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, date date, y double")


def hours(spark, values, dataset="s"):
    start = dt.datetime(2023, 1, 1)
    rows = [(dataset, start + dt.timedelta(hours=i), v) for i, v in enumerate(values)]
    return spark.createDataFrame(rows, "dataset string, ts timestamp_ntz, y double")


def test_causal_fill_never_looks_ahead(spark):
    dense = series.densify(daily(spark, [None, 1.0, None, 9.0]))
    out = [r["y_causal"] for r in series.causal_ffill(dense, chunk=2).orderBy("idx").collect()]
    assert out == [None, 1.0, 1.0, 9.0]
    with pytest.raises(ValueError):
        series.causal_ffill(dense, method="bfill")


def test_zscore_uses_training_rows_only(spark):
    dense = series.causal_ffill(series.densify(daily(spark, [1.0, None, 3.0, 1000.0])))
    bounds = spark.createDataFrame([("s", DAY0 + dt.timedelta(days=2))], "dataset string, train_end date")
    z = [r["y_z"] for r in series.zscore_train(dense, bounds, "y_causal").orderBy("idx").collect()]
    assert z[-1] > 100 and abs(z[0]) < 10


def test_densify_fills_month_borders_once(spark):
    rows = [("a", dt.date(2023, 12, 30), 1.0), ("a", dt.date(2024, 3, 2), 2.0), ("b", dt.date(2024, 2, 29), 3.0)]
    out = series.densify(spark.createDataFrame(rows, "dataset string, date date, y double")).toPandas()
    a = out[out["dataset"] == "a"]
    assert len(a) == (dt.date(2024, 3, 2) - dt.date(2023, 12, 30)).days + 1 and a["date"].is_unique
    assert len(out[out["dataset"] == "b"]) == 1


def test_expanding_folds_of_a_year(spark):
    lengths = spark.createDataFrame([("s", 8760)], "dataset string, n_rows long")
    out = [tuple(r)[1:] for r in splits.expanding_folds(lengths).orderBy("fold").collect()]
    assert out[0] == (0, 4380, 5256) and out[-1] == (4, 7884, 8760)
    assert all(a[2] == b[1] for a, b in zip(out, out[1:]))


@pytest.mark.parametrize("chunk", [4, 1024])
def test_rolling_origin_pairs(spark, chunk):
    pairs = splits.rolling_origin_pairs(daily(spark, [float(i) for i in range(20)]), 5, 3, chunk=chunk).toPandas()
    assert len(pairs) == 39 and sorted(pairs["fold"]) == list(range(39))
    assert (pairs["target_date"] > pairs["train_end"]).all()
    far = splits.rolling_origin_pairs(daily(spark, [float(i) for i in range(40)]), 5, 14, chunk=chunk)
    assert far.count() == 14 * (40 - 14 - 4) and far.agg(F.max("horizon")).first()[0] == 14
    with pytest.raises(ValueError):
        splits.rolling_origin_pairs(daily(spark, [1.0]), max_horizon=0)


def test_features_do_not_change_when_the_future_does(spark):
    values = [float(i) for i in range(240)]
    changed = values[:201] + [-9999.0] * 39

    def features(v):
        grid = hourly.prepared(hours(spark, v), chunk=32)
        long = forecast.hourly_features(grid, chunk=200).withColumn("horizon", F.lit(24))
        names = forecast.feature_names()
        rows = series.add_cyclic_target_time(long).filter("pos <= 200").orderBy("pos")
        return rows.select("mean_y", *names).toPandas().astype(float)

    pd.testing.assert_frame_equal(features(values), features(changed))


def test_naive_forecasts_do_not_change_when_the_future_does(spark):
    values = [float((i * 37) % 11) for i in range(60)]
    changed = values[:40] + [1e6] * 20

    def made(v):
        wide = forecast.naive_wide(daily(spark, v), chunk=8).filter(F.col("origin_date") < DAY0 + dt.timedelta(days=40))
        return wide.select("origin_date", "horizon", "y", "mean_y", "seasonal").toPandas().sort_values(["origin_date", "horizon"]).reset_index(drop=True)

    pd.testing.assert_frame_equal(made(values), made(changed))


def test_seasonal_naive_on_short_history(spark):
    out = forecast.seasonal_naive(daily(spark, [10.0, 20.0, None, 40.0]), horizons=[1, 7]).toPandas()
    # fewer than seven observations: the origin itself
    assert set(out[out["horizon"] == 1]["y_pred"]) == {10.0}
    seasonal = forecast.seasonal_naive(daily(spark, [float(i) for i in range(1, 12)]), horizons=[1]).toPandas().sort_values("origin_date")
    assert list(seasonal["y_pred"])[6:] == [1.0, 2.0, 3.0, 4.0]


def ridge_by_hand(x, y, q, alpha=1.0):
    mean, sd = x.mean(axis=0), x.std(axis=0)
    sd[sd == 0] = 1.0
    z = (x - mean) / sd
    w = np.linalg.solve(z.T @ z + alpha * np.eye(x.shape[1]), z.T @ (y - y.mean()))
    return y.mean() + ((q - mean) / sd) @ w


@pytest.mark.parametrize("chunk", [16, 1024])
def test_expanding_ridge_equals_refits(spark, chunk):
    rng = np.random.default_rng(0)
    y = np.cumsum(rng.normal(size=90)) + 20
    values = [None if i in (11, 40, 41) else float(v) for i, v in enumerate(y)]
    out = forecast.ridge_direct(series.densify(daily(spark, values)), horizons=[1, 3], n_lags=3, min_rows=30, chunk=chunk).toPandas()
    s = pd.Series(values, dtype=float)
    for h in (1, 3):
        frame = pd.DataFrame({f"l{k}": s.shift(k) for k in range(3)})
        frame["t"] = s.shift(-h)
        ok = frame.dropna()
        expected = {}
        for o in ok.index:
            train = ok[ok.index + h <= o]
            if len(train) >= 30 and s[: o + 1].notna().sum() >= 30:
                cols = ["l0", "l1", "l2"]
                expected[DAY0 + dt.timedelta(days=int(o))] = ridge_by_hand(train[cols].to_numpy(), train["t"].to_numpy(), ok.loc[o, cols].to_numpy(dtype=float))
        got = out[out["horizon"] == h].set_index("origin_date")["y_pred"].to_dict()
        assert set(got) == set(expected) and len(got) > 20
        for o, v in expected.items():
            assert got[o] == pytest.approx(v, rel=1e-8)


def test_grouped_forecast_reports_failures(spark):
    grid = hourly.prepared(hours(spark, [float(i % 5) for i in range(60)]))
    bounds = hourly.fold_bounds(grid)

    def fails(train, values, origins, horizons):
        raise RuntimeError("no fit")

    out = forecast.grouped_forecast(grid, bounds, (1, 6), fails).toPandas()
    assert out["y_pred"].isna().all() and out["error"].eq("RuntimeError: no fit").all() and len(out) > 0
    good = forecast.grouped_forecast(grid, bounds, (1,), forecast.seasonal_ar(5)).toPandas()
    truth = (good["pos"] + 1) % 5
    assert np.allclose(good["y_pred"], truth, atol=1e-6)


def test_boosted_direct_has_no_leak_and_learns(spark):
    grid = hourly.prepared(hours(spark, [float(10 + i % 24) for i in range(420)]))
    samples = hourly.boosted_samples(grid, "holdout", (1,))
    roles = {r["role"]: r for r in samples.groupBy("role").agg(F.min("pos").alias("lo"), F.max(F.col("pos") + F.col("horizon")).alias("hi")).collect()}
    assert roles["train"]["hi"] < 336 <= roles["test"]["lo"]
    settings = boosting.Settings(trees=40, rate=0.2, least_rows=4, together=2)
    out = forecast.boosted_direct(samples, forecast.feature_names(), (1,), (0,), settings).toPandas()
    assert len(out) == samples.filter("role = 'test'").count() and out["pos"].min() >= 336
    assert np.sqrt(((out["y_pred"] - out["target"]) ** 2).mean()) < 2 < out["target"].std()


def grown(x, y, splits_left, depth, least, rate):
    """Brute force: a tree by best gain level by level, as predictions of its own rows."""
    out, open_ = np.zeros(len(y)), [np.arange(len(y))]
    for _ in range(depth):
        found = []
        for own in open_:
            best = (1e-12, None, None)
            for f in range(x.shape[1]):
                for c in np.unique(x[own, f]):
                    left, right = own[x[own, f] <= c], own[x[own, f] > c]
                    if min(len(left), len(right)) >= least:
                        gain = y[left].sum() ** 2 / len(left) + y[right].sum() ** 2 / len(right) - y[own].sum() ** 2 / len(own)
                        if gain > best[0] + 1e-9:
                            best = (gain, left, right)
            if best[1] is not None:
                found.append(best)
        open_ = []
        for _, left, right in sorted(found, key=lambda b: -b[0]):
            if splits_left > 0:
                splits_left -= 1
                out[left], out[right] = rate * y[left].mean(), rate * y[right].mean()
                open_ += [left, right]
    return out


@pytest.mark.parametrize("block_rows", [10_000, 60, 1])
def test_trees_of_many_models_equal_brute_force(spark, monkeypatch, block_rows):
    monkeypatch.setattr(boosting, "BLOCK_ROWS", block_rows)
    rng = np.random.default_rng(3)
    rows = [(m, "train" if i < 130 else "test", i, *map(float, rng.integers(0, 9, 3)), 0.0) for m in (0, 1) for i in range(150)]
    rows = [(*r[:6], r[3] * (r[0] + 1) + (r[4] > 4) * 3 + 0.1 * r[5]) for r in rows]
    samples = spark.createDataFrame(rows, "fold int, role string, pos int, a double, b double, c double, target double").repartition(4)
    s = boosting.Settings(trees=4, leaves=6, depth=3, rate=0.5, row_share=1.0, feature_share=1.0, least_rows=5, together=1, settle_every=2)
    found = {(r.fold, r.pos): r.y_pred for r in boosting.fit_predict(samples, ["a", "b", "c"], [(0,), (1,), (7,)], ["fold"], ["pos"], settings=s).collect()}
    assert len(found) == 40
    for m in (0, 1):
        x = np.array([r[3:6] for r in rows if r[0] == m])
        y = np.array([r[6] for r in rows if r[0] == m])
        train = np.arange(130)
        made = np.full(150, y[train].mean())
        for _ in range(4):
            step = grown(x[train], (y - made)[train], 5, 3, 5, 0.5)
            same = {}  # rows with equal features end in the same leaf
            for i, v in zip(train, step, strict=True):
                same[tuple(x[i])] = v
            known = [i for i in range(150) if tuple(x[i]) in same]
            made[known] += [same[tuple(x[i])] for i in known]
            made[[i for i in range(150) if i not in known]] = np.nan
        checked = [i for i in range(130, 150) if not np.isnan(made[i])]
        assert checked and [found[m, i] for i in checked] == pytest.approx(made[checked])


def test_registered_boosted_direct_is_whole(spark, sf_dir, monkeypatch):
    from fcverify.catalog import ENTRIES

    fit = forecast.boosted_direct
    asked = []

    def small(samples, features, horizons, folds, **more):
        asked.append(more)
        return fit(samples, features, horizons, folds, boosting.Settings(trees=1, depth=1))

    monkeypatch.setattr(forecast, "boosted_direct", small)
    found = ENTRIES["boosted_direct"].spark(spark, sf_dir).select("fold", "horizon").distinct().collect()
    assert asked == [{}] and {(r.fold, r.horizon) for r in found} == {(f, h) for f in range(5) for h in (1, 6, 24, 48)}


def test_hourly_wide_file(spark):
    row = {"ESTACION": 24, "MAGNITUD": 10, "ANO": 2023, "MES": 1, "DIA": 1}
    row.update({f"H{h:02d}": h for h in range(1, 25)})
    row.update({f"V{h:02d}": "N" if h == 2 else "V" for h in range(1, 25)})
    df = spark.createDataFrame([row])
    out = readers.unpivot_hourly_validated(df, 24, 10, grid=("2023-01-01 00:00:00", "2023-12-31 23:00:00")).orderBy("ts").limit(30).collect()
    full = readers.unpivot_hourly_validated(df, 24, 10, grid=("2023-01-01 00:00:00", "2023-12-31 23:00:00"))
    assert full.count() == 8760
    assert out[0]["y"] == 1.0 and out[1]["y"] is None and not out[1]["is_valid"] and out[24]["y"] is None
    with pytest.raises(Exception, match="duplicate hourly record"):
        readers.unpivot_hourly_validated(df.union(df), 24, 10).collect()


def test_daily_wide_dates_and_commas(spark):
    df = spark.createDataFrame([("p ", 10, 2023, 2, "1,5", "-3", "x")], "PUNTO_MUESTREO string, MAGNITUD int, ANNO int, MES int, D01 string, D02 string, D30 string")
    out = readers.unpivot_daily_wide(df).orderBy("date").collect()
    assert [(r["dataset"], r["date"].day, r["y"]) for r in out] == [("p", 1, 1.5), ("p", 2, None)]


def test_readers_reject_bad_input(spark):
    df = spark.createDataFrame([(1, 2)], "a int, b int")
    with pytest.raises(ValueError):
        readers.require_columns(df, ["a", "c"])
    with pytest.raises(ValueError):
        readers.resolve_columns(df, {"z": ["y"]})
    with pytest.raises(ValueError):
        readers.read_series(spark, "/tmp/x.json")
    with pytest.raises(Exception, match="model roles"):
        readers.model_roles(spark.createDataFrame([("persistence",)], "model string"), strict=True).collect()


def test_station_class_precedence(spark):
    df = spark.createDataFrame([("Rural Near-city/Industrial",), ("Suburban/Industrial",), ("Urban/Traffic",)], "t string")
    assert [r[0] for r in df.select(stations.station_class(F.col("t"))).collect()] == ["rural", "industrial", "urban"]


def test_context_windows_keep_gaps(spark):
    grid = series.grid_position(series.densify(daily(spark, [1.0, None, 3.0, 4.0, 5.0])))
    out = {r["end_idx"]: list(r["context"]) for r in series.context_windows(grid, 3, 2, chunk=4).collect()}
    assert out == {2: [1.0, None, 3.0], 4: [3.0, 4.0, 5.0]}


def test_seasonal_autoregression_from_moments_equals_the_least_squares_fit(spark):
    rng = np.random.default_rng(6)
    rows = [(k, i, float(50 + 10 * np.sin(i / 24 * 2 * np.pi) + rng.normal())) for k in "ab" for i in range(300)]
    grid = spark.createDataFrame(rows, "dataset string, pos long, y_causal double")
    bounds = spark.createDataFrame([(k, f, 100 + 50 * f, 150 + 50 * f) for k in "ab" for f in range(3)], "dataset string, fold int, train_end long, test_end long")
    keys = ["dataset", "fold", "pos", "horizon"]
    made = forecast.seasonal_ar_direct(grid, bounds, (1, 6, 30), chunk=64).toPandas().sort_values(keys).reset_index(drop=True)
    plain = forecast.grouped_forecast(grid, bounds, (1, 6, 30), forecast.seasonal_ar(24)).toPandas().sort_values(keys).reset_index(drop=True)
    assert (made[keys] == plain[keys]).all().all()
    np.testing.assert_allclose(made["y_pred"].astype(float), plain["y_pred"].astype(float), rtol=1e-8)
