"""Date-keyed market features from a fixed, short list of series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.prices import _carry_forward

LOOKBACKS = (7, 30, 90)
MA_ROWS = 200

# Sector name -> series symbol.
SECTOR_SERIES = {
    "Technology": "XLK",
    "Healthcare": "XLV",
    "Financial Services": "XLF",
    "Energy": "XLE",
    "Consumer Cyclical": "XLY",
    "Consumer Defensive": "XLP",
    "Industrials": "XLI",
    "Basic Materials": "XLB",
    "Real Estate": "XLRE",
    "Utilities": "XLU",
    "Communication Services": "XLC",
}


def target_dates(trades: DataFrame, existing: DataFrame | None = None) -> DataFrame:
    """Disclosure dates of compliant stock buys that have no feature row yet."""
    dates = trades.filter(
        "transaction_type = 'buy' AND filing_violation = 'compliant' AND asset_type = 'stock' AND disclosure_date IS NOT NULL"
    ).select(F.col("disclosure_date").alias("date")).distinct()
    return dates if existing is None else dates.join(existing.select("date").distinct(), "date", "left_anti")


def market_returns(
    dates: DataFrame, prices: DataFrame, symbols: Sequence[str], lookbacks: Sequence[int] = LOOKBACKS,
) -> DataFrame:
    """One row per (date, symbol): as-of level and % return over each calendar lookback."""
    offsets = [0, *lookbacks]
    legs = dates.select(
        "date", F.explode(F.array(*[F.lit(s) for s in symbols])).alias("symbol")
    ).select("date", "symbol", F.explode(F.array(*[F.lit(o) for o in offsets])).alias("back")).withColumn(
        "at", F.date_sub("date", F.col("back"))
    )
    events = prices.filter(F.col("symbol").isin(*symbols) & F.col("close").isNotNull()).select(
        "symbol", "date", F.col("close").alias("payload")
    )
    found = _carry_forward(legs.select("symbol", F.col("at").alias("date")).distinct(), events).select(
        "symbol", F.col("date").alias("at"), "payload"
    )
    wide = legs.join(found, ["symbol", "at"]).groupBy("date", "symbol").agg(
        *[F.max(F.when(F.col("back") == o, F.col("payload"))).alias(f"p{o}") for o in offsets]
    )
    now = F.col("p0")
    return wide.select("date", "symbol", now.alias("level"), *[
        F.when(F.col(f"p{o}") != 0, stable_round((now - F.col(f"p{o}")) / F.col(f"p{o}") * 100, 4)).alias(f"ret_{o}d")
        for o in lookbacks
    ])


def above_ma(prices: DataFrame, rows: int = MA_ROWS) -> DataFrame:
    """Per price day: 1 if the close is above the mean of its last ``rows`` closes, NULL below ``rows`` rows."""
    last = Window.partitionBy("symbol").orderBy("date").rowsBetween(-(rows - 1), 0)
    return prices.filter("close IS NOT NULL").select(
        "symbol", "date", "close", F.avg("close").over(last).alias("_ma"), F.count("close").over(last).alias("_n")
    ).select(
        "symbol", "date",
        F.when(F.col("_n") >= rows, (F.col("close") > F.col("_ma")).cast("int")).alias("above_ma"),
    )


def market_regime(dates: DataFrame, prices: DataFrame, symbol: str, rows: int = MA_ROWS) -> DataFrame:
    """``above_ma`` of the index as of each date."""
    flags = above_ma(prices.filter(F.col("symbol") == symbol), rows)
    # -1 stands for "too few rows" so that the as-of step does not skip back over it.
    events = flags.select("symbol", "date", F.coalesce("above_ma", F.lit(-1)).alias("payload"))
    keys = dates.select(F.lit(symbol).alias("symbol"), "date").distinct()
    return _carry_forward(keys, events).select(
        "date", F.when(F.col("payload") >= 0, F.col("payload")).alias("index_above_ma")
    )


def market_features(
    dates: DataFrame, prices: DataFrame, *, index: str, volatility: str, sectors: Mapping[str, str],
    existing: DataFrame | None = None,
) -> DataFrame:
    """One wide row per date.  ``sectors`` maps output prefixes to symbols."""
    if existing is not None:
        dates = dates.join(existing.select("date").distinct(), "date", "left_anti")
    returns = market_returns(dates, prices, [index, volatility, *sectors.values()])
    pick = lambda sym, col: F.max(F.when(F.col("symbol") == sym, F.col(col)))
    wide = returns.groupBy("date").agg(
        pick(volatility, "level").alias("vix_close"),
        pick(index, "ret_7d").alias("spy_1w_ret"), pick(index, "ret_30d").alias("spy_1m_ret"),
        pick(index, "ret_90d").alias("spy_3m_ret"),
        *[pick(sym, "ret_30d").alias(f"{name}_1m_ret") for name, sym in sectors.items()],
    )
    regime = market_regime(dates, prices, index).withColumnRenamed("index_above_ma", "spy_above_200ma")
    return wide.join(regime, "date", "left")


def with_sector_excess(
    trades: DataFrame, market: DataFrame, sector_columns: Mapping[str, str], on: str = "disclosure_date",
) -> DataFrame:
    """1-month return of the trade's sector series minus the index.

    ``sector_columns`` maps sector names to columns of the wide market table, which is unpivoted
    so that each trade meets one row.
    """
    long = market.select(
        F.col("date").alias(on), "spy_1m_ret",
        F.explode(F.map_from_arrays(
            F.array(*[F.lit(s) for s in sector_columns]), F.array(*[F.col(c) for c in sector_columns.values()])
        )).alias("sector", "sector_ret"),
    ).select(on, "sector", stable_round(F.col("sector_ret") - F.col("spy_1m_ret"), 4).alias("sector_excess"))
    return trades.join(long, [on, "sector"], "left")
