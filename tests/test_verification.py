import datetime as dt
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.special import incomplete_beta, student_t_two_sided
from fcverify.operators import decisions, events, metrics, quality, ranks, regimes, stattests, variance

CELL = "dataset string, model string, horizon int, origin_date date, date date, y_true double, y_pred double"
DAY0 = dt.date(2024, 1, 1)


def cell(spark, y, p, model="m", dataset="d", h=1):
    rows = [(dataset, model, h, DAY0 + dt.timedelta(days=i), DAY0 + dt.timedelta(days=i + h), a, b) for i, (a, b) in enumerate(zip(y, p))]
    return spark.createDataFrame(rows, CELL)


@pytest.mark.parametrize(
    "y, p, expected",
    [
        ([0, 1, 2, 3], [0, 2, 4, 6], 4.0),
        ([1, 2, 3, 4], [1, 2, 3, 4], 1.0),
        ([-2, -1, 1, 2], [-1, -0.5, 0.5, 1], 0.25),
        ([-1, -0.5, 0.5, 1], [-2, -1, 1, 2], 4.0),
        ([1, 2, 3, 4], [11, 12, 13, 14], 1.0),
        ([5, 5, 5, 5], [1, 2, 3, 4], 0.0),
        ([1, 2, 3, 4], [7, 7, 7, 7], 0.0),
        ([0, 4], [0, 2], 0.25),
        ([0, 1, 2, 3, 4], [0, 2, 4, 6, 8], 4.0),
    ],
)
def test_alpha_is_a_variance_ratio(spark, y, p, expected):
    out = variance.alpha_table(cell(spark, map(float, y), map(float, p))).first()
    assert out["alpha"] == pytest.approx(expected, abs=1e-12)


@pytest.mark.parametrize(
    "p, skill, flag",
    [([1, 2, 3, 4], 0.2, "near_ideal_flag"), ([2, 2, 2, 2], 0.2, "collapse_flag"), ([-2, 1, 5, 9], 0.2, "inflation_flag"), ([1.1, 1.9, 3.1, 3.9], 0.25, "near_ideal_flag")],
)
def test_summary_flags_and_columns(spark, p, skill, flag):
    rows = cell(spark, [1.0, 2.0, 3.0, 4.0], map(float, p))
    skills = spark.createDataFrame([("d", "m", 1, skill)], "dataset string, model string, horizon int, skill double")
    out = variance.variance_retention_summary(rows, skills, variance.bootstrap_alpha_ci(rows, n_boot=50))
    assert out.columns == variance.SUMMARY_COLUMNS
    row = out.first()
    assert row[flag] and row["low_sample_flag"] and row["mae_skill"] is None
    assert row["alpha_ci_low"] is not None and row["alpha_ci_low"] <= row["alpha_ci_high"]


def test_bootstrap_is_independent_of_partitioning_and_near_plain_resampling(spark):
    rng = np.random.default_rng(5)
    y = rng.normal(50, 10, 300)
    rows = cell(spark, map(float, y), map(float, 25 + 0.5 * y + rng.normal(0, 2, 300)))
    a = variance.bootstrap_alpha_ci(rows.repartition(1), n_boot=300).first()
    b = variance.bootstrap_alpha_ci(rows.repartition(7), n_boot=300).first()
    assert a["alpha_ci_low"] == pytest.approx(b["alpha_ci_low"], rel=1e-9)
    t, p = (rows.toPandas()[c].to_numpy() for c in ("y_true", "y_pred"))
    picks = [rng.integers(0, len(t), len(t)) for _ in range(1000)]
    low, high = np.percentile([p[i].var() / t[i].var() for i in picks], [2.5, 97.5])
    assert a["alpha_ci_low"] == pytest.approx(low, abs=0.02) and a["alpha_ci_high"] == pytest.approx(high, abs=0.02)


def test_poisson_weights_have_unit_mean_and_variance():
    w = variance.poisson_weights(np.arange(20000), np.arange(20), 42)
    assert abs(w.mean() - 1) < 0.01 and abs(w.var() - 1) < 0.02


def test_relative_skill_modes(spark):
    df = spark.createDataFrame([(8.0, 10.0), (1.0, 0.0)], "m double, b double")
    out = df.select(X.relative_skill("m", "b").alias("n"), X.relative_skill("m", "b", "zero").alias("z")).collect()
    assert out[0]["n"] == pytest.approx(0.2) and out[1]["n"] is None and out[1]["z"] == 0.0
    with pytest.raises(Exception, match="baseline error must be positive"):
        df.select(X.relative_skill("m", "b", "raise")).collect()


def test_student_t_against_known_values(spark):
    df = spark.createDataFrame([(2.228138851964939, 10.0, 0.05), (0.0, 5.0, 1.0), (12.706204736432095, 1.0, 0.05), (-1.96, 1e6, 0.0499961)], "t double, nu double, p double")
    for r in df.select("p", student_t_two_sided("t", "nu").alias("got")).collect():
        assert r["got"] == pytest.approx(r["p"], abs=1e-6)
    assert spark.range(1).select(student_t_two_sided(F.lit(None).cast("double"), F.lit(3.0)).alias("g")).first()["g"] is None
    assert float(incomplete_beta(np.array([2.0]), np.array([3.0]), np.array([0.4]))[0]) == pytest.approx(0.5248, abs=1e-9)


def dm_by_hand(d, h):
    d = np.asarray(d, float)
    n, c = len(d), d - d.mean()
    total = np.mean(c * c) + 2 * sum(np.mean(c[k:] * c[:-k]) for k in range(1, h) if k < n)
    var = total / n
    k = (n + 1 - 2 * h + h * (h - 1) / n) / n
    if n <= max(2, h) or var <= 0 or k <= 0:
        return None
    return d.mean() / math.sqrt(var) * math.sqrt(k)


@pytest.mark.parametrize("h, n", [(1, 40), (4, 40), (7, 7), (3, 9)])
def test_dm_statistic_with_gaps(spark, h, n):
    rng = np.random.default_rng(h)
    d = rng.normal(0.3, 1, n)
    values = [None if i == 2 and n > 9 else float(v) for i, v in enumerate(d)]
    rows = [("d", "m", h, i * 3, v) for i, v in enumerate(values)]
    losses = spark.createDataFrame(rows, "dataset string, model string, horizon int, i long, loss_diff double")
    got = stattests.dm_hln(losses, "i", chunk=8).first()["dm_stat"]
    expected = dm_by_hand([v for v in values if v is not None], h)
    assert (got is None and expected is None) or got == pytest.approx(expected, rel=1e-9)


def test_dm_of_equal_forecasts_is_null_and_truth_mismatch_raises(spark):
    y = [float(i % 5) for i in range(30)]
    both = cell(spark, y, [v + 1 for v in y], "persistence").union(cell(spark, y, [v + 1 for v in y], "m"))
    row = stattests.dm_table(both).first()
    assert row["dm_stat"] is None and row["dm_pval_bh"] is None and row["dm_significant"] is False and row["n_pairs"] == 30
    wrong = cell(spark, y, y, "persistence").union(cell(spark, [v + 1 for v in y], y, "m"))
    with pytest.raises(Exception, match="y_true differs"):
        stattests.dm_table(wrong).collect()


def test_bh_with_ties_nulls_and_single(spark):
    p = [0.01, 0.04, 0.04, None, 0.9]
    df = spark.createDataFrame([("d", "m", i, v) for i, v in enumerate(p)] + [("e", "m", 0, 0.3)], "dataset string, model string, horizon int, p double")
    out = {(r["dataset"], r["horizon"]): r["q"] for r in stattests.bh_adjust(df, "p", "q").collect()}
    assert out[("d", 0)] == pytest.approx(0.04) and out[("d", 1)] == pytest.approx(0.16 / 3) and out[("d", 2)] == pytest.approx(0.16 / 3)
    assert out[("d", 3)] is None and out[("d", 4)] == pytest.approx(0.9) and out[("e", 0)] == pytest.approx(0.3)


def test_murphy_terms_sum_and_constant_forecast(spark):
    rng = np.random.default_rng(7)
    y = list(map(float, rng.normal(20, 5, 50)))
    out = stattests.murphy_decomposition(cell(spark, y, [0.5 * v + 3 for v in y]).union(cell(spark, y, [9.0] * 50, "c"))).toPandas()
    total = out["bias_sq"] + out["cond_bias_sq"] + out["irreducible_sq"]
    np.testing.assert_allclose(total, out["mse"], rtol=1e-9)
    assert out.set_index("model").loc["c", "rho"] == 0.0


def test_kge(spark):
    y = [10.0, 12.0, 14.0, 16.0, 18.0]
    rows = cell(spark, y, [9.0, 11.0, 13.0, 15.0, 17.0], "persistence").union(cell(spark, y, [10.1, 11.8, 14.2, 15.9, 18.1], "ridge_direct"))
    out = stattests.kge_horizon_table(rows).toPandas()
    assert len(out) == 1 and not out.isna().any().any()
    perfect = stattests.kge_components(cell(spark, [1.0, 2.0, 3.0, 4.0], [1.0, 2.0, 3.0, 4.0])).first()
    assert all(perfect[c] == pytest.approx(1.0) for c in ("r_h", "alpha_h", "beta_h", "KGE_h"))
    ratio = stattests.kge_components(cell(spark, [1.0, 2.0, 4.0, 8.0], [1.0, 3.0, 5.0, 7.0])).first()
    assert ratio["alpha_h"] == pytest.approx(np.std([1, 3, 5, 7]) / np.std([1, 2, 4, 8]))
    flat = stattests.kge_components(cell(spark, [5.0, 5.0], [1.0, float("nan")])).first()
    assert flat["n"] == 1 and flat["KGE_h"] is None


def test_event_modes_for_empty_cells(spark):
    rows = cell(spark, [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])
    none = events.event_counts(rows, F.lit(10.0)).first()
    zero = events.event_counts(rows, F.lit(10.0), zero_division=0.0).first()
    assert none["recall"] is None and none["f1"] is None and none["base_rate"] == 0.0
    assert zero["recall"] == zero["precision"] == zero["f1"] == 0.0


@pytest.mark.parametrize("chunk", [8, 1024])
def test_exceedance_thresholds_use_the_past_only(spark, chunk):
    rng = np.random.default_rng(8)
    y = list(map(float, np.round(rng.normal(40, 15, 60), 1)))
    rows = cell(spark, y, [v * 0.9 for v in y], h=2)
    got = events.expanding_thresholds(rows, {"p75": 0.75}, {"abs_50": 50.0}, chunk=chunk).toPandas().sort_values("origin_date").reset_index(drop=True)
    for i in range(60):
        past = y[: max(0, i - 1)]
        if past:
            assert got["p75"][i] == pytest.approx(np.percentile(past, 75))
        else:
            assert pd.isna(got["p75"][i])
    table = events.exceedance_table(rows, {"p75": 0.75}, {"abs_50": 50.0}, chunk=chunk).toPandas()
    assert set(table["threshold_type"]) == {"p75", "abs_50"}


CASES = [(0.9, 0.6, 0.5, True), (0.1, 0.3, 0.1, True), (0.2, 0.3, 0.5, True), (0.2, 0.9, 0.1, True), (0.2, 0.9, None, True), (0.2, 0.9, 0.9, None), (-0.1, 0.9, 0.9, True)]


def ruled(spark):
    rows = [("d", "m", i + 1, "t", *c) for i, c in enumerate(CASES)]
    return decisions.decision_rules(
        spark.createDataFrame(rows, "dataset string, model string, horizon int, station_type string, skill double, alpha double, recall_p75 double, dm_significant boolean")
    )


def test_decision_rules_and_reasons(spark):
    out = ruled(spark).orderBy("horizon").collect()
    assert [r["reason_change"] for r in out] == ["no_change", "both", "collapse_only", "recall_only", "no_change", "n/a", "n/a"]
    assert [r["decision_change"] for r in out] == [False, True, True, True, True, False, False]
    assert decisions.failure_decomposition(ruled(spark)).first()["adds_up"]
    assert [r["horizon"] for r in decisions.discordant_cells(ruled(spark)).collect()] == [3]


def test_sensitivity_and_summary_agree(spark):
    grid = decisions.decision_sensitivity(ruled(spark))
    primary = grid.filter("primary").first()
    overall = decisions.decision_summary(ruled(spark)).filter(F.col("group") == "overall").first()
    assert primary["decision_change_n"] == overall["decision_change_n"] == 4 and primary["rule_a_n"] == 5
    assert decisions.sensitivity_pivot(grid).count() == 3


def test_incremental_auc(spark):
    rng = np.random.default_rng(9)
    rows = [("d", "m", 1, "t", 0.5, float(a), float(r), True) for a, r in zip(rng.uniform(0, 1, 60), rng.uniform(0.1, 0.9, 60))]
    cells = spark.createDataFrame(rows, "dataset string, model string, horizon int, station_type string, skill double, alpha double, recall_p75 double, dm_significant boolean")
    out = decisions.incremental_auc(decisions.decision_rules(cells)).first()
    assert out["auc_with_alpha"] > out["auc_without_alpha"] and out["n"] == 60
    assert decisions.incremental_auc(ruled(spark)).count() == 0


def test_rank_correlation_ties_and_few_models(spark):
    rows = [("s", 1, m, a, b) for m, a, b in (("x", 1.0, 2.0), ("y", 1.0, 1.0), ("z", 3.0, 3.0), ("w", 0.5, 0.1))] + [("s", 2, "x", 1.0, 1.0), ("s", 2, "y", 2.0, 2.0)]
    df = spark.createDataFrame(rows, "station string, h int, model string, p double, q double")
    out = {r["h"]: r["rho"] for r in ranks.rank_correlation(df, [("p", "q")], {"p": "p", "q": "q"}).collect()}
    first = pd.DataFrame(rows[:4], columns=["s", "h", "m", "p", "q"])
    assert out[1] == pytest.approx(first["p"].rank().corr(first["q"].rank())) and out[2] is None
    top = ranks.top_model(df, {"p": "p"}).filter("h = 1").first()
    assert top["top_p"] == "z"


def test_spearman_matches_pandas(spark):
    rng = np.random.default_rng(10)
    frame = pd.DataFrame({"a": rng.integers(0, 20, 200).astype(float), "b": rng.normal(size=200)})
    out = stattests.spearman(spark.createDataFrame(frame), {"ab": ("a", "b")}).first()
    assert out["spearman_rho"] == pytest.approx(frame["a"].rank().corr(frame["b"].rank()), abs=1e-12) and 0 <= out["p_value"] <= 1


def test_regime_support_rules_and_null_regime(spark):
    rows = [("d", "m", 1, float(i), float(i), float(i) + 1, 30.0, "x" if i < 45 else None) for i in range(50)]
    df = spark.createDataFrame(rows, "dataset string, model string, horizon int, y_true double, y_pred double, y_persist double, event_threshold double, r string")
    out = {x["regime"]: x for x in regimes.regime_metrics(df, [("k", "n", "r")]).collect()}
    assert out["x"]["sample_count"] == 45 and out["x"]["rmse"] == 0.0 and out["x"]["skill_rmse"] == 1.0
    assert out["nan"]["insufficient_samples"] and out["nan"]["rmse"] is None and out["nan"]["flag_rate"] == 1.0


def test_missing_baseline_raises(spark):
    preds = spark.createDataFrame([("d", "m", 0, 1, 1, 2.0)], "dataset string, model string, fold int, pos long, horizon int, y_pred double")
    rows = spark.createDataFrame([("d", i, dt.datetime(2024, 1, 1, i), 1.0) for i in range(4)], "dataset string, pos long, ts timestamp_ntz, y double")
    limits = spark.createDataFrame([("d", 0, 1, 0.5)], "dataset string, fold int, horizon int, event_threshold double")
    with pytest.raises(Exception, match="without a baseline"):
        regimes.prediction_master(preds, rows, limits).collect()


def test_quality_checks(spark):
    df = spark.createDataFrame([(1, None), (1, 2.0), (2, 3.0)], "k int, v double")
    profile = {r["column_name"]: r["n_null"] for r in quality.null_profile(df).collect()}
    assert profile == {"k": 0, "v": 1}
    with pytest.raises(Exception, match="duplicate keys"):
        quality.assert_unique(df, ["k"]).collect()
    found = spark.createDataFrame([("a", 1, 2)], "g string, x long, y long")
    assert quality.expected_counts(found, {"a": (1, 2)}, "g", ["x", "y"]).count() == 0
    assert quality.expected_counts(found, {"a": (1, 3), "b": (0, 0)}, "g", ["x", "y"]).count() == 2


def test_matched_and_unmatched_skill_differ_on_sparse_origins(spark):
    y = [float(i) for i in range(20)]
    base = cell(spark, y, [v + (1 if i % 2 else 3) for i, v in enumerate(y)], "persistence")
    sparse = cell(spark, y, [v + 1 for v in y], "m").filter(F.dayofmonth("date") % 2 == 0)
    both = base.union(sparse)
    matched, unmatched = metrics.skill_matched(both).first(), metrics.skill_unmatched(both).first()
    assert matched["n_pairs"] == 10 and matched["skill"] != pytest.approx(unmatched["skill"])


def test_horizon_table_without_a_baseline_raises(spark):
    rows = cell(spark, [1.0, 2.0, 4.0], [1.0, 2.5, 3.0])
    with pytest.raises(Exception, match="baseline"):
        stattests.kge_horizon_table(rows).collect()


def test_clusters_are_fitted_in_tasks_by_rows_whatever_the_layout(spark, monkeypatch):
    from pyspark.ml.clustering import KMeans

    tasks, fit = [], KMeans.fit
    monkeypatch.setattr(KMeans, "fit", lambda self, rows, *a: tasks.append(rows.rdd.getNumPartitions()) or fit(self, rows, *a))
    rng = np.random.default_rng(7)
    rows = [("d", i, *map(float, rng.normal(size=2)), float(i % 24)) for i in range(600)]
    bounds = spark.createDataFrame([("d", 0, 400, 500), ("d", 1, 500, 600)], "dataset string, fold int, train_end long, test_end long")
    found = []
    for order, parts in ((rows, 60), (rows[::-1], 7)):
        table = spark.createDataFrame(spark.sparkContext.parallelize(order, parts), "dataset string, pos long, temp_c double, humidity_pct double, hour double")
        labels, _ = regimes.cluster_regimes(table, bounds, (0, 1), 4)
        found.append(sorted(map(tuple, labels.collect())))
    assert tasks == [1] * 4 and len(found[0]) == 200 and found[0] == found[1]
