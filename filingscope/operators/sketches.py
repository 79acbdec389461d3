"""Stored sketches: distinct counts and quantiles a day, rolled up to longer periods without reading rows again.

Distinct counts are HyperLogLog sketches (relative standard error 1.04 / sqrt(2^HLL_BITS), 1.6 %), quantiles are KLL sketches
(rank error below 0.5 % with 99 % confidence for KLL_K = 800).  Both merge, and a sketch has bounded size however many rows it saw.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

HLL_BITS = 12
KLL_K = 800


def daily_sketches(rows: DataFrame, by: Sequence[str], item: str, value: str) -> DataFrame:
    """Per group ``n`` (rows), ``items`` (sketch of distinct ``item``) and ``amounts`` (sketch of ``value``); NULLs count in ``n`` alone.

    Sketches are built map-side, so a hot group sends one sketch a task.
    """
    return rows.groupBy(*by).agg(
        F.count("*").alias("n"), F.hll_sketch_agg(item, HLL_BITS).alias("items"),
        F.kll_sketch_agg_double(F.col(value).cast("double"), KLL_K).alias("amounts"))


def roll_up(stored: DataFrame, by: Sequence[str | Column]) -> DataFrame:
    """Sketches of longer periods or coarser groups from stored ones; ``n`` stays exact."""
    return stored.groupBy(*by).agg(
        F.sum("n").alias("n"), F.hll_union_agg("items").alias("items"), F.kll_merge_agg_double("amounts", KLL_K).alias("amounts"))


def read_sketches(sketched: DataFrame, quantiles: Sequence[float] = (0.25, 0.5, 0.75)) -> DataFrame:
    """Estimates in place of sketches: ``n_items`` and one value per quantile (``amounts``, NULL without a value)."""
    some = F.kll_sketch_get_n_double("amounts") > 0
    found = F.array(*[F.kll_sketch_get_quantile_double("amounts", F.lit(float(q))) for q in quantiles])
    return sketched.withColumns({"n_items": F.hll_sketch_estimate("items"), "amounts": F.when(some, found)}).drop("items")
