"""Positions open at each day, by a sweep over opening and closing events."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Days of a slice of the sweep.
SLICE_DAYS = 64


def open_positions(positions: DataFrame, by: str | None = "ticker", slice_days: int = SLICE_DAYS) -> DataFrame:
    """(key, day, n_open, exposure) for every day on which a key's open positions change.

    ``positions`` has ``by``, opens, closes (last open day, NULL for ever) and weight.  Each position is two events; a day's
    events are added up first, each slice of days is summed on its own, and the totals of the slices before it are
    carried in.  No position meets another, and a key with very many positions is dealt over its slices.  Without ``by`` all
    positions have the key ``*``.
    """
    key = F.lit("*") if by is None else F.col(by)
    event = lambda day, sign: F.struct(day.alias("day"), F.lit(sign).alias("n"), (sign * F.col("weight")).alias("w"))
    events = positions.filter("opens IS NOT NULL").select(
        key.alias("key"), F.explode(F.array(event(F.col("opens"), 1), event(F.date_add("closes", 1), -1))).alias("e")).select("key", "e.*")
    daily = events.filter("day IS NOT NULL").groupBy("key", "day").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).withColumn(
        "slice", F.floor(F.unix_date("day") / slice_days))
    earlier = Window.partitionBy("key").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carry = daily.groupBy("key", "slice").agg(F.sum("n").alias("n"), F.sum("w").alias("w")).select(
        "key", "slice", *[F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"before_{c}") for c in ("n", "w")])
    within = Window.partitionBy("key", "slice").orderBy("day").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return daily.select("key", "slice", "day", F.sum("n").over(within).alias("n"), F.sum("w").over(within).alias("w")).join(
        carry, ["key", "slice"]).select(
        "key", "day", (F.col("n") + F.col("before_n")).alias("n_open"), (F.col("w") + F.col("before_w")).alias("exposure"))
