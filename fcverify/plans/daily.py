"""Daily evaluation: series -> forecasts -> diagnostics -> master table."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from fcverify.functions.scan import CHUNK
from fcverify.operators import decisions, events, forecast, metrics, stattests, variance
from fcverify.session import settle


def naive_predictions(
    series: DataFrame, horizons: Sequence[int] = forecast.HORIZONS, contrasts: bool = True, chunk: int = CHUNK
) -> DataFrame:
    """Persistence and seasonal naive; with ``contrasts`` also a shrunken and an amplified forecast.

    The contrasts have a known variance ratio (below and above one), which exercises
    the collapse and inflation flags.
    """
    wide = forecast.naive_wide(series, horizons, chunk=chunk)
    y, mean = F.col("y"), F.col("mean_y")
    models = {"persistence": y, "seasonal_naive": F.col("seasonal")}
    if contrasts:
        models["smooth"] = F.lit(0.3) * y + F.lit(0.7) * mean
        models["amplified"] = mean + F.lit(1.5) * (y - mean)
    return forecast.stack_models(wide, models)


@dataclass
class DailyDiagnostics:
    """All cell tables of one predictions table, each a lazy DataFrame.

    ``shared`` writes the baseline join out once for all tables that need it; leave it
    off when only one of them is used.
    """

    predictions: DataFrame
    baseline: str = "persistence"
    levels: tuple[tuple[str, float], ...] = (("p75", 0.75), ("p90", 0.90))
    fixed: tuple[tuple[str, float], ...] = (("abs_50", 50.0),)
    chunk: int = CHUNK
    shared: bool = False

    @property
    def threshold_types(self) -> list[str]:
        return [n for n, _ in (*self.levels, *self.fixed)]

    @cached_property
    def matched(self) -> DataFrame:
        """Model rows with their baseline, joined and written out once for skill and significance."""
        rows = stattests.loss_differences(self.predictions, self.baseline)
        return settle(rows.select(*metrics.CELL, "date", "y_true", "y_pred", "y_base", "loss_diff", "truth_differs"))

    @cached_property
    def skill(self) -> DataFrame:
        return metrics.skill_of_matched(self.matched) if self.shared else metrics.skill_matched(self.predictions, self.baseline)

    @cached_property
    def summary(self) -> DataFrame:
        return variance.variance_retention_summary(self.predictions, self.skill)

    @cached_property
    def dm(self) -> DataFrame:
        return stattests.dm_table(self.predictions, self.baseline, chunk=self.chunk, matched=self.matched if self.shared else None)

    @cached_property
    def murphy(self) -> DataFrame:
        return stattests.murphy_decomposition(self.predictions)

    @cached_property
    def exceedance(self) -> DataFrame:
        return events.exceedance_table(self.predictions, dict(self.levels), dict(self.fixed), self.chunk)

    @cached_property
    def kge(self) -> DataFrame:
        return stattests.kge_horizon_table(self.predictions, self.baseline)

    @cached_property
    def master(self) -> DataFrame:
        return decisions.master_table(self.summary, self.dm, self.murphy, self.exceedance, types=self.threshold_types)
