"""Model rankings, rank correlations and reversals."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import combinations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fcverify.functions import expr as X
from fcverify.functions.quantiles import grouped_percentile

# Short metric names, their columns and the compared pairs.
METRICS = {"skill": "Skill_h", "phi": "phi_h", "r": "r_h", "kge": "KGE_h", "kge_skill": "KGE_skill_h"}
PAIRS = (("skill", "kge"), ("skill", "kge_skill"), ("skill", "phi"), ("phi", "r"), ("phi", "kge"), ("r", "kge"))
CASE = ["station", "h"]


def _pair_rows(df: DataFrame, pairs: Sequence[tuple[str, str]], metrics: Mapping[str, str], keys: Sequence[str]) -> DataFrame:
    fan = F.array(
        *[
            F.struct(F.lit(f"{a}_vs_{b}").alias("pair"), F.col(metrics[a]).alias("a"), F.col(metrics[b]).alias("b"))
            for a, b in pairs
        ]
    )
    return (
        df.select(*keys, "model", F.explode(fan).alias("p"))
        .select(*keys, "model", "p.*")
        .filter(F.col("a").isNotNull() & F.col("b").isNotNull())
    )


def rank_correlation(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]] = PAIRS,
    metrics: Mapping[str, str] = METRICS,
    keys: Sequence[str] = CASE,
    min_models: int = 3,
) -> DataFrame:
    """Spearman over the models of each case and pair; NULL below ``min_models`` models.

    A case holds one row per model, so its window stays small however many cases there are.
    """
    group = [*keys, "pair"]
    rows = _pair_rows(df, pairs, metrics, keys)

    def average_rank(c):
        best = Window.partitionBy(*group).orderBy(F.desc(c))
        return F.rank().over(best) + (F.count(F.lit(1)).over(Window.partitionBy(*group, c)) - 1) / 2.0

    ranked = rows.withColumns({"ra": average_rank("a"), "rb": average_rank("b")})
    sums = ranked.groupBy(*group).agg(
        F.countDistinct("model").alias("n_models"),
        F.covar_pop("ra", "rb").alias("c"), F.stddev_pop("ra").alias("sa"), F.stddev_pop("rb").alias("sb"),
    )
    rho = F.when(F.col("n_models") >= min_models, X.divide(F.col("c"), F.col("sa") * F.col("sb")))
    return sums.select(*group, "n_models", rho.alias("rho"))


def top_model(df: DataFrame, metrics: Mapping[str, str] = METRICS, keys: Sequence[str] = CASE) -> DataFrame:
    """Best model per metric; ties go to the first name. One aggregate over all metrics."""
    best = [
        F.min_by("model", F.when(F.col(c).isNotNull(), F.struct(-F.col(c), F.col("model")))).alias(f"top_{m}")
        for m, c in metrics.items()
    ]
    return df.groupBy(*keys).agg(*best)


def rank_reversal_table(
    df: DataFrame,
    pairs: Sequence[tuple[str, str]] = PAIRS,
    metrics: Mapping[str, str] = METRICS,
    cutoff: float = 0.8,
    keys: Sequence[str] = CASE,
) -> DataFrame:
    """Pair correlations, best models and the reversal flags per case."""
    names = [f"{a}_vs_{b}" for a, b in pairs]
    wide = rank_correlation(df, pairs, metrics, keys).groupBy(*keys).agg(
        *[F.max(F.when(F.col("pair") == n, F.col("rho"))).alias(n) for n in names]
    )
    optional = [c for c in ("station_id", "station_name", "station_type", "station_class") if c in df.columns]
    # one pass for the best models and the station attributes
    tops = top_model(df, metrics, keys)
    if optional:
        attributes = df.groupBy(*keys).agg(*[F.min(c).alias(c) for c in optional])
        tops = tops.join(attributes, list(keys))
    low = F.lit(False)
    for n in names:
        low = low | X.truth(F.col(n) < cutoff)
    differs = ~F.col("top_skill").eqNullSafe(F.col("top_kge"))
    return (
        tops.join(wide, list(keys), "left")
        .withColumn("top_skill_differs_from_top_kge", differs)
        .withColumn("rank_reversal_flag", low | differs)
    )


def rank_reversal_summary(ranks: DataFrame) -> DataFrame:
    """Rates by horizon, by best KGE model and by station class in one GROUPING SETS aggregate."""
    dims = ["h", "top_kge"] + (["station_class"] if "station_class" in ranks.columns else [])
    names = {"h": "horizon", "top_kge": "top_kge_model", "station_class": "station_class"}
    grouped = ranks.groupingSets([[F.col(d)] for d in dims], *[F.col(d) for d in dims]).agg(
        *[F.grouping(d).alias(f"__g_{d}") for d in dims],
        F.count(F.lit(1)).alias("n_cells"),
        F.avg(F.col("rank_reversal_flag").cast("double")).alias("rank_reversal_rate"),
        F.avg(F.col("top_skill_differs_from_top_kge").cast("double")).alias("top_skill_top_kge_mismatch_rate"),
    )
    aggregation, key = F.lit(None).cast("string"), F.lit(None).cast("string")
    for d in dims:
        here = F.col(f"__g_{d}") == 0
        aggregation = F.when(here, names[d]).otherwise(aggregation)
        key = F.when(here, F.col(d).cast("string")).otherwise(key)
    return grouped.select(
        aggregation.alias("aggregation"), key.alias("key"), "n_cells", "rank_reversal_rate", "top_skill_top_kge_mismatch_rate"
    )


def complementarity_rule(ranks: DataFrame, cutoff: float = 0.8, min_rate: float = 0.2) -> DataFrame:
    """One row: median correlations, reversal rate and the conclusion."""
    tall = ranks.select(F.explode(F.array(
        F.struct(F.lit("skill_vs_kge").alias("m"), F.col("skill_vs_kge").alias("v")),
        F.struct(F.lit("phi_vs_r").alias("m"), F.col("phi_vs_r").alias("v")),
    )).alias("x")).select("x.*")
    medians = grouped_percentile(tall, ["m"], "v", {"median": 0.5}).agg(
        F.max(F.when(F.col("m") == "skill_vs_kge", F.col("median"))).alias("skill_vs_kge_median"),
        F.max(F.when(F.col("m") == "phi_vs_r", F.col("median"))).alias("phi_vs_r_median"),
    )
    rates = ranks.agg(
        F.avg(F.col("rank_reversal_flag").cast("double")).alias("reversal_rate"),
        F.count_if("top_skill_differs_from_top_kge").alias("mismatch_count"),
    )
    # both sides are single rows
    one = medians.withColumn("__one", F.lit(1)).join(F.broadcast(rates.withColumn("__one", F.lit(1))), "__one").drop("__one")
    return one.withColumn(
        "complementary",
        X.truth(F.col("skill_vs_kge_median") < cutoff)
        | X.truth(F.col("phi_vs_r_median") < cutoff)
        | X.truth(F.col("reversal_rate") >= min_rate)
        | (F.col("mismatch_count") > 0),
    )


def metric_corr_matrix(df: DataFrame, metrics: Mapping[str, str] = METRICS, keys: Sequence[str] = CASE) -> DataFrame:
    """Median rank correlation over the cases for every metric pair: symmetric, unit diagonal."""
    names = list(metrics)
    half = rank_correlation(df, list(combinations(names, 2)), metrics, keys)
    medians = grouped_percentile(half, ["pair"], "rho", {"rho": 0.5}).select(
        F.substring_index("pair", "_vs_", 1).alias("left_metric"), F.substring_index("pair", "_vs_", -1).alias("right_metric"), "rho"
    )
    mirrored = medians.select(F.col("right_metric").alias("left_metric"), F.col("left_metric").alias("right_metric"), "rho")
    unit = df.sparkSession.createDataFrame([(n, n, 1.0) for n in names], "left_metric string, right_metric string, rho double")
    return medians.unionByName(mirrored).unionByName(unit)


def worst_case_findings(regime_skill: DataFrame, seasonal_skill: DataFrame | None = None) -> DataFrame:
    """The weakest regime cell per finding within the support filters, as rows of one table."""
    cell = ["scheme_name", "regime", "model", "horizon"]
    reliable = regime_skill.filter(
        ~F.col("insufficient_samples") & (F.col("scheme_type") != "overall") & F.col("vr").isNotNull()
    )
    gap = reliable.filter((F.col("skill_rmse") > 0) & F.col("skill_vp").isNotNull()).withColumn(
        "value", F.col("skill_vp") - F.col("skill_rmse")
    )
    recall = regime_skill.filter(
        ~F.col("insufficient_samples") & ~F.col("insufficient_events")
        & (F.col("scheme_type") != "overall") & F.col("event_recall").isNotNull()
    )
    views = [
        ("min_variance_retention", reliable.withColumn("value", F.col("vr"))),
        ("max_skill_gap", gap),
        ("min_event_recall", recall.withColumn("value", F.col("event_recall"))),
    ]
    if seasonal_skill is not None:
        seasonal = seasonal_skill.filter(
            ~F.col("insufficient_samples") & (F.col("scheme_name") == "warm_cold") & F.col("skill_vp").isNotNull()
        )
        views.append(("min_seasonal_skill_vp", seasonal.withColumn("value", F.col("skill_vp"))))
    found = None
    for name, view in views:
        worst = view.agg(F.min(F.struct("value", *cell)).alias("w")).filter(F.col("w").isNotNull()).select(F.lit(name).alias("finding"), "w.*")
        found = worst if found is None else found.unionByName(worst)
    return found.withColumn("value", F.when(F.col("finding") == "max_skill_gap", -F.col("value")).otherwise(F.col("value")))


def seasonal_rank(seasonal_skill: DataFrame, keys: Sequence[str] = ("model", "horizon")) -> DataFrame:
    """Rank of each season's skill_vp within the keys, lowest first."""
    rows = seasonal_skill.filter(
        ~F.col("insufficient_samples") & (F.col("scheme_name") == "warm_cold") & F.col("skill_vp").isNotNull()
    )
    order = Window.partitionBy(*keys).orderBy("skill_vp", "regime")
    return rows.withColumn("rank", F.row_number().over(order))


def top_discordant(cells: DataFrame, n: int = 5) -> DataFrame:
    return cells.orderBy(F.desc("alpha"), "dataset", "model", "horizon").limit(n)
