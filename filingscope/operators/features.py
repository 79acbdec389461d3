"""Point-in-time features: what was known strictly before each trade date.

Rows are reduced to one per (key, trade date) before any window; every frame ends one day before
the current date, so same-day trades share features and never see each other.  A filer holding a
large share of all trades costs its number of trading days.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.flags import OPEN_POSITION_DAYS

LARGE_TRADE = 50_000
ROUTINE_MIN_PRIOR = 3
ROUTINE_MAX_GAP = 92
LATE_LAG = 30


def _prior(*keys: str, since: int = Window.unboundedPreceding):
    return Window.partitionBy(*keys).orderBy(F.unix_date("trade_date")).rangeBetween(since, -1)


def _by_day(*keys: str):
    return Window.partitionBy(*keys).orderBy("trade_date")


def _dated(df: DataFrame) -> DataFrame:
    return df.filter("transaction_type = 'buy' AND trade_date IS NOT NULL AND ticker IS NOT NULL")


def repeat_features(df: DataFrame, cap_days: int = OPEN_POSITION_DAYS) -> DataFrame:
    """Position in the (filer, ticker) sequence, gaps, open predecessor and routine-buyer flag."""
    pair = ["filer_id", "ticker"]
    rows = _dated(df)
    days = rows.groupBy(*pair, "trade_date").agg(
        F.count("*").alias("n"),
        F.max(F.struct("disclosure_date", "trade_id", "close_date_disc")).alias("last"),
    )
    step = _by_day(*pair)
    days = days.withColumns({
        "prev": F.lag(F.struct("trade_date", "last")).over(step),
        "day_gap": F.datediff("trade_date", F.lag("trade_date").over(step)),
    })
    # Gaps between consecutive trades: one per new day, and n - 1 zeros inside a day.
    entries = days.select("*", F.explode(F.array(
        F.struct(F.lit(1).alias("is_day"), F.col("day_gap").alias("gap"), F.lit(1).cast("bigint").alias("times")),
        F.struct(F.lit(0).alias("is_day"), F.lit(0).alias("gap"), (F.col("n") - 1).alias("times")),
    )).alias("e")).select("*", "e.*").drop("e").filter("is_day = 1 OR times > 0")
    prior = _prior(*pair)
    known = entries.withColumns({
        "prior_buy_count": F.coalesce(F.sum(F.when(F.col("is_day") == 1, F.col("n"))).over(prior), F.lit(0)),
        "prior_median_gap": F.expr("percentile(gap, 0.5, times)").over(prior),
    }).filter("is_day = 1").select(*pair, "trade_date", "prior_buy_count", "prior_median_gap", "prev")
    prev_close = F.coalesce("prev.last.close_date_disc", F.date_add("prev.last.disclosure_date", cap_days))
    return rows.join(known, [*pair, "trade_date"]).select(
        "trade_id",
        (F.col("prior_buy_count") + 1).cast("int").alias("seq_position"),
        F.datediff("trade_date", "prev.trade_date").alias("gap_since_prev_buy"),
        F.when(F.col("prev").isNull(), 0).otherwise((prev_close >= F.col("disclosure_date")).cast("int")).alias("prev_trade_open"),
        F.col("prior_buy_count").cast("int").alias("prior_buy_count"),
        "prior_median_gap",
        F.when(
            (F.col("prior_buy_count") >= ROUTINE_MIN_PRIOR) & (F.col("prior_median_gap") <= ROUTINE_MAX_GAP), 1
        ).otherwise(0).alias("is_routine_buyer"),
    )


def _attach(rows: DataFrame, known: DataFrame, columns: list[str]) -> DataFrame:
    return rows.select("trade_id", "filer_id", "trade_date").join(known, ["filer_id", "trade_date"]).select("trade_id", *columns)


def pit_recency(df: DataFrame) -> DataFrame:
    """Days since the first and the previous buy, buys in the last 90 / 365 days, buys per year."""
    rows = _dated(df)
    days = rows.groupBy("filer_id", "trade_date").agg(F.count("*").alias("n"))
    step = _by_day("filer_id")
    count = lambda w: F.coalesce(F.sum("n").over(w), F.lit(0))
    known = days.select(
        "filer_id", "trade_date",
        F.datediff("trade_date", F.first("trade_date").over(step)).alias("pol_age_days"),
        F.datediff("trade_date", F.lag("trade_date").over(step)).alias("days_since_last_buy"),
        count(_prior("filer_id", since=-90)).cast("int").alias("trades_last_90d"),
        count(_prior("filer_id", since=-365)).cast("int").alias("trades_last_365d"),
        F.sum("n").over(_prior("filer_id")).alias("total"),
    ).withColumn(
        "pit_trade_frequency",
        F.when(F.col("pol_age_days") > 0, stable_round(F.col("total") / (F.col("pol_age_days") / F.lit(365.25)), 4)),
    )
    return _attach(rows, known, [
        "pol_age_days", "days_since_last_buy", "trades_last_90d", "trades_last_365d", "pit_trade_frequency",
    ])


def pit_concentration(df: DataFrame) -> DataFrame:
    """Share of the most bought ticker and HHI over strictly earlier buys.

    The k-th buy of a ticker raises the sum of squared counts by k^2 - (k-1)^2, so the running HHI
    is a running sum of per-day increments.
    """
    rows = _dated(df)
    upto = Window.partitionBy("filer_id", "ticker").orderBy("trade_date").rowsBetween(Window.unboundedPreceding, 0)
    per_ticker = (
        rows.groupBy("filer_id", "ticker", "trade_date").agg(F.count("*").alias("n"))
        .withColumn("k", F.sum("n").over(upto))
        .withColumn("gain", F.col("k") * F.col("k") - (F.col("k") - F.col("n")) * (F.col("k") - F.col("n")))
    )
    days = per_ticker.groupBy("filer_id", "trade_date").agg(
        F.sum("n").alias("n"), F.sum("gain").alias("gain"), F.max("k").alias("top")
    )
    prior = _prior("filer_id")
    known = days.select(
        "filer_id", "trade_date", F.sum("n").over(prior).alias("total"),
        F.sum("gain").over(prior).alias("squares"), F.max("top").over(prior).alias("top_n"),
    ).withColumns({
        "pit_ticker_conc_pct": stable_round(F.col("top_n") / F.col("total") * 100, 4),
        "pit_ticker_hhi": stable_round(F.col("squares") / (F.col("total") * F.col("total")), 6),
    })
    return _attach(rows, known, ["pit_ticker_conc_pct", "pit_ticker_hhi"])


def pit_quality(df: DataFrame) -> DataFrame:
    """Repeat rate, mean filing lag and share of late filings over earlier buys."""
    rows = _dated(df)
    days = rows.groupBy("filer_id", "trade_date").agg(
        F.count("*").alias("n"), F.count_if(F.col("repeat_before_close") == 1).alias("repeats"),
        F.sum("filing_lag_days").alias("lag_sum"), F.count("filing_lag_days").alias("lag_n"),
        F.count_if(F.col("filing_lag_days") > LATE_LAG).alias("late"),
    )
    total = lambda c: F.sum(c).over(_prior("filer_id"))
    share = lambda a, b: stable_round(F.when(total(b) > 0, total(a) / total(b)) * 100, 4)
    known = days.select(
        "filer_id", "trade_date", share("repeats", "n").alias("pit_repeat_rate"),
        stable_round(F.when(total("lag_n") > 0, total("lag_sum") / total("lag_n")), 4).alias("pit_avg_filing_lag"),
        share("late", "lag_n").alias("pit_late_filing_rate"),
    )
    return _attach(rows, known, ["pit_repeat_rate", "pit_avg_filing_lag", "pit_late_filing_rate"])


def pit_performance(df: DataFrame, resolved: str = "reference", as_of_exit: bool = False) -> DataFrame:
    """Win rate, mean drawdown and large-trade win rate over earlier resolved buys.

    ``resolved="reference"`` counts any labelled buy and reads hit_10pct = 0 as a win, so open
    trades above the stop count as wins; ``"exited"`` counts only buys that left the market.
    By default priors are selected by trade date even if they exit later; ``as_of_exit=True``
    requires the exit to lie before the current trade date instead.
    """
    rows = _dated(df)
    is_resolved: Column = F.col("drawdown_disc_10pct").isNotNull()
    if resolved == "exited":
        is_resolved &= F.col("close_date_disc").isNotNull()
    won = F.col("drawdown_disc_10pct") == 0
    large = F.col("size_midpoint") >= LARGE_TRADE
    event = F.col("close_date_disc") if as_of_exit else F.col("trade_date")
    outcomes = (
        rows.filter(is_resolved).withColumn("event_date", event).filter("event_date IS NOT NULL")
        .groupBy("filer_id", F.col("event_date").alias("trade_date")).agg(
            F.count("*").alias("n"), F.count_if(won).alias("wins"), F.sum("max_drawdown_disc").alias("dd_sum"),
            F.count("max_drawdown_disc").alias("dd_n"), F.count_if(large).alias("large_n"), F.count_if(large & won).alias("large_wins"),
        )
    )
    parts = ["n", "wins", "dd_sum", "dd_n", "large_n", "large_wins"]
    days = rows.groupBy("filer_id", "trade_date").agg(F.lit(1).alias("is_day"))
    both = days.join(outcomes, ["filer_id", "trade_date"], "full")
    totals = both.select("filer_id", "trade_date", "is_day", *[F.sum(p).over(_prior("filer_id")).alias(p) for p in parts])
    ratio = lambda a, b, k: stable_round(F.when(F.col(b) > 0, F.col(a) / F.col(b)) * k, 4)
    known = totals.filter("is_day = 1").select(
        "filer_id", "trade_date", ratio("wins", "n", 100).alias("pit_win_rate"),
        ratio("dd_sum", "dd_n", 1).alias("pit_avg_dd"), ratio("large_wins", "large_n", 100).alias("pit_large_trade_wr"),
    )
    return _attach(rows, known, ["pit_win_rate", "pit_avg_dd", "pit_large_trade_wr"])


def routine_buyers(df: DataFrame) -> DataFrame:
    """(filer, ticker) pairs with at least 3 buys whose upper-median gap is at most 92 days."""
    pair = ["filer_id", "ticker"]
    days = _dated(df).groupBy(*pair, "trade_date").agg(F.count("*").alias("n"))
    gaps = days.withColumn("gap", F.datediff("trade_date", F.lag("trade_date").over(_by_day(*pair))))
    # Gaps sorted ascending are all same-day zeros first, then the day gaps.
    stats = gaps.groupBy(*pair).agg(
        F.sum("n").alias("n_buys"), F.sum(F.col("n") - 1).alias("zeros"), F.sum("gap").alias("span"),
        F.sort_array(F.collect_list("gap")).alias("sorted"),  # bounded by calendar days of one pair
    ).filter("n_buys >= 3")
    at = F.floor((F.col("n_buys") - 1) / 2) - F.col("zeros")
    median = F.when(at < 0, 0).otherwise(F.element_at("sorted", (at + 1).cast("int")))
    return stats.withColumn("median_gap", median).filter(F.col("median_gap") <= ROUTINE_MAX_GAP).select(
        *pair, F.col("n_buys").alias("routine_count"),
        F.floor(F.coalesce(F.col("span"), F.lit(0)) / (F.col("n_buys") - 1)).cast("int").alias("routine_avg_gap"),
    )


def latest_per_group(df: DataFrame, key: str, order: list[str], columns: list[str]) -> DataFrame:
    """The newest row per key by ``order`` (a total order)."""
    return df.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(*order)).alias("r")).select(key, "r.*")


def repeat_analysis(df: DataFrame) -> DataFrame:
    """Decided win rate by sequence position, by open / closed predecessor and by gap to it.

    Published result without published code; buckets: position 1, 2, 3+; predecessor open or closed;
    gap < 30, 30-90, 90-180, > 180 days (repeat buys only for the last two).
    """
    gap, seq = F.col("gap_since_prev_buy"), F.col("seq_position")
    views = F.array(
        F.struct(F.lit("position").alias("view"), F.when(seq == 1, "1").when(seq == 2, "2").otherwise("3+").alias("bucket")),
        F.struct(F.lit("predecessor").alias("view"), F.when(seq > 1, F.when(F.col("prev_trade_open") == 1, "open").when(F.col("prev_trade_open") == 0, "closed")).alias("bucket")),
        F.struct(F.lit("gap").alias("view"), F.when(seq > 1, F.when(gap < 30, "<30").when(gap < 90, "30-90").when(gap <= 180, "90-180").otherwise(">180")).alias("bucket")),
    )
    return (
        df.filter("outcome IN ('win', 'loss')").select("outcome", F.explode(views).alias("v"))
        .filter("v.bucket IS NOT NULL").groupBy("v.view", "v.bucket")
        .agg(F.count("*").alias("n"), stable_round(100.0 * F.count_if(F.col("outcome") == "win") / F.count("*"), 4).alias("win_rate"))
    )
