"""Filer scores: outcome -> baskets and repeats out -> filings collapsed -> score."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.flags import exclude_baskets, is_compliant_buy, qualifying_buys


@dataclass(frozen=True)
class ScoreParams:
    """Fixed values of the composite score."""

    min_trades: int = 5
    large_trade: int = 50_000
    min_large: int = 5
    w_win_rate: float = 0.50
    w_drawdown: float = 0.30
    w_large: float = 0.20
    low_confidence: int = 10
    basket_trade: int = 10
    basket_disclosure: int = 20


DEFAULTS = ScoreParams()


def win_rate_points(rate: Column) -> Column:
    """50 % or less -> 0, 70 % or more -> 100, linear between."""
    return F.when(rate <= 0.50, 0.0).when(rate >= 0.70, 100.0).otherwise((rate - 0.50) / (0.70 - 0.50) * 100)


def drawdown_points(dd: Column) -> Column:
    """0 % -> 100, -10 % -> 0, linear between; 50 without data."""
    return F.when(dd.isNull(), 50.0).when(dd >= 0, 100.0).when(dd <= -10, 0.0).otherwise((dd + 10.0) / 10.0 * 100)


def collapse_filings(df: DataFrame, *extra: str) -> DataFrame:
    """One row per (filer, ticker, disclosure date, price): amended filings collapse to the smallest id."""
    first = lambda c: F.min_by(c, "trade_id").alias(c)
    return df.groupBy("filer_id", "ticker", "disclosure_date", "price_at_disclosure_date", *extra).agg(
        F.min("trade_id").alias("trade_id"), F.max("size_midpoint").alias("size_midpoint"),
        F.avg("max_drawdown_disc").alias("max_drawdown_disc"), first("outcome"), first("entry_price"),
        first("has_path"), first("days_to_exit_disc"), first("close_date_disc"),
    )


def scoreable(labelled: DataFrame, trades: DataFrame, asset_types: Sequence[str], params: ScoreParams = DEFAULTS) -> DataFrame:
    """Collapsed positions of one asset class after the basket and repeat filters."""
    rows = qualifying_buys(labelled, asset_types, exclude_repeats="repeat_before_close" in labelled.columns)
    rows = exclude_baskets(rows, trades, asset_types, params.basket_trade, params.basket_disclosure)
    return collapse_filings(rows)


def score_filers(positions: DataFrame, params: ScoreParams = DEFAULTS) -> DataFrame:
    """Composite score per filer; no row below the minimum or without a decided position.

    All components come from one aggregate, so partial aggregation absorbs very active filers.
    """
    dd = F.col("max_drawdown_disc")
    win, large = F.col("outcome") == "win", F.col("size_midpoint") >= params.large_trade
    g = positions.filter("has_path AND entry_price > 0").groupBy("filer_id").agg(
        F.count("*").alias("total_trades"), F.count_if(win).alias("wins"),
        F.count_if(F.col("outcome") == "loss").alias("losses"), F.count_if(F.col("outcome") == "open").alias("opens"),
        F.avg(F.when((dd > -10) & (dd < 0), dd)).alias("dd"),
        F.count_if(large).alias("large_trade_count"), F.count_if(large & win).alias("large_wins"),
    ).filter((F.col("total_trades") >= params.min_trades) & (F.col("wins") + F.col("losses") > 0))
    has_large = F.col("large_trade_count") >= params.min_large
    g = g.withColumns({
        "wr": F.col("wins") / F.col("total_trades"),
        "lwr": F.when(has_large, F.col("large_wins") / F.col("large_trade_count")),
    }).withColumns({
        "ws": win_rate_points(F.col("wr")), "ds": drawdown_points(F.col("dd")),
        "ls": F.when(has_large, win_rate_points(F.col("lwr"))),
    })
    composite = F.when(
        has_large, F.col("ws") * params.w_win_rate + F.col("ds") * params.w_drawdown + F.col("ls") * params.w_large
    ).otherwise(F.col("ws") * (params.w_win_rate + params.w_large) + F.col("ds") * params.w_drawdown)
    return g.select(
        "filer_id", stable_round(composite, 2).alias("score"), stable_round(F.col("wr") * 100, 2).alias("win_rate"),
        stable_round("ws", 2).alias("win_rate_score"), stable_round("dd", 4).alias("avg_drawdown"),
        stable_round("ds", 2).alias("drawdown_score"), stable_round(F.col("lwr") * 100, 2).alias("large_win_rate"),
        stable_round("ls", 2).alias("large_score"), "total_trades", "wins", "losses", "opens", "large_trade_count",
        (F.col("total_trades") < params.low_confidence).alias("low_confidence"),
    )


STOCK = ("stock",)
FUNDS = ("etf", "fund")


def score_by_asset(labelled: DataFrame, trades: DataFrame, params: ScoreParams = DEFAULTS) -> DataFrame:
    """Stock and ETF/fund scores side by side."""
    stock = score_filers(scoreable(labelled, trades, STOCK, params), params).select(
        "filer_id", "score", "win_rate", "total_trades", F.col("avg_drawdown").alias("avg_dd"),
        F.col("large_win_rate").alias("large_trade_wr"), "wins", "losses", "opens",
    )
    funds = score_filers(scoreable(labelled, trades, FUNDS, params), params).select(
        "filer_id", F.col("score").alias("score_etf"), F.col("win_rate").alias("win_rate_etf"),
        F.col("total_trades").alias("etf_trade_count"),
    )
    return stock.join(funds, "filer_id", "full")


def publish_scores(filers: DataFrame, scores: DataFrame, as_of: Column | None = None) -> DataFrame:
    """All filers with their scores; NULL for filers that no longer qualify."""
    out = filers.join(scores, "filer_id", "left")
    if as_of is not None:
        scored = F.col("score").isNotNull() | F.col("score_etf").isNotNull()
        out = out.withColumn("last_updated", F.when(scored, as_of))
    return out


def filing_stats(trades: DataFrame) -> DataFrame:
    """Per filer: collapsed compliant buys, mean lag of those within 45 days, committee-aligned count."""
    groups = trades.filter(
        is_compliant_buy() & F.col("price_at_disclosure_date").isNotNull() & F.col("disclosure_date").isNotNull()
    ).groupBy("filer_id", "ticker", "disclosure_date", "price_at_disclosure_date").agg(
        F.max("filing_lag_days").alias("lag"), F.max(F.col("committee_relevance").isNotNull().cast("int")).alias("aligned"),
    )
    return groups.groupBy("filer_id").agg(
        F.count("*").alias("compliant_trades_all"),
        stable_round(F.avg(F.when(F.col("lag") <= 45, F.col("lag"))), 1).alias("avg_filing_lag"),
        F.sum("aligned").alias("comm_aligned"),
    )


def late_filings(trades: DataFrame) -> DataFrame:
    return trades.filter("transaction_type = 'buy' AND filing_violation <> 'compliant'").groupBy("filer_id").agg(
        F.count("*").alias("late_filings")
    )


def outcome_totals(filers: DataFrame, scores: DataFrame, positions: DataFrame) -> DataFrame:
    """Totals over scored filers, both win rates, filers below the minimum and without positions."""
    have = positions.select("filer_id").distinct().withColumn("_has", F.lit(1))
    rows = filers.select("filer_id").join(scores, "filer_id", "left").join(have, "filer_id", "left")
    scored = F.col("score").isNotNull() | F.col("score_etf").isNotNull()
    w, l, o = (F.coalesce(F.sum(c), F.lit(0)) for c in ("wins", "losses", "opens"))
    pct = lambda a, b: stable_round(F.when(b > 0, 100.0 * a / b), 1)
    return rows.agg(
        F.count("score").alias("stock_scored"), F.count("score_etf").alias("etf_scored"),
        F.count_if(~scored & F.col("_has").isNotNull()).alias("below_min"),
        F.count_if(~scored & F.col("_has").isNull()).alias("no_trades"),
        w.alias("wins"), l.alias("losses"), o.alias("opens"),
        pct(w, w + l + o).alias("win_rate_all"), pct(w, w + l).alias("win_rate_decided"),
    )


def drawdown_summary(trades: DataFrame) -> DataFrame:
    """Mean drawdown in (-10, 0) and hit counts for both anchors."""
    mid = lambda c: stable_round(F.avg(F.when((F.col(c) < 0) & (F.col(c) > -10), F.col(c))), 2)
    return trades.filter("transaction_type = 'buy' AND max_drawdown_before_profit IS NOT NULL").agg(
        mid("max_drawdown_before_profit").alias("avg_dd_trade"), mid("max_drawdown_disc").alias("avg_dd_disc"),
        F.sum("drawdown_trade_5pct").alias("hit5_trade"), F.sum("drawdown_disc_5pct").alias("hit5_disc"),
        F.sum("drawdown_trade_10pct").alias("hit10_trade"), F.sum("drawdown_disc_10pct").alias("hit10_disc"),
    )
