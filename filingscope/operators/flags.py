"""Qualifying predicate, basket days, overlapping repeats, filing lag and signals."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.session import materialize

TRADE_DATE_BASKET = 10
DISCLOSURE_BASKET = 20
OPEN_POSITION_DAYS = 180
LAG_LIMIT = 45
CLUSTER_MIN = 2
ABS_MOVE_MIN = 15


def is_compliant_buy() -> Column:
    return (F.col("transaction_type") == "buy") & (F.col("filing_violation") == "compliant")


def fetch_ok(df: DataFrame) -> Column:
    return F.coalesce(F.col("price_fetch_failed"), F.lit(0)) == 0 if "price_fetch_failed" in df.columns else F.lit(True)


def qualifying(df: DataFrame) -> Column:
    """A compliant, priced, dated buy whose price fetch did not fail."""
    return (
        is_compliant_buy() & F.col("price_at_disclosure_date").isNotNull()
        & F.col("disclosure_date").isNotNull() & F.col("trade_date").isNotNull() & fetch_ok(df)
    )


def qualifying_buys(
    df: DataFrame, asset_types: Sequence[str] | None = None, exclude_repeats: bool = False,
) -> DataFrame:
    """The ``qualifying`` rows."""
    keep = qualifying(df)
    if asset_types is not None:
        keep &= F.col("asset_type").isin(*asset_types)
    if exclude_repeats:
        keep &= F.coalesce(F.col("repeat_before_close"), F.lit(0)) == 0
    return df.filter(keep)


def basket_groups(
    trades: DataFrame, date_col: str, min_tickers: int, scope: Sequence[str] | None = None,
) -> DataFrame:
    """(filer_id, date) groups of compliant buys naming at least ``min_tickers`` distinct tickers."""
    rows = trades.filter(is_compliant_buy() & F.col(date_col).isNotNull())
    if scope is not None:
        rows = rows.filter(F.col("asset_type").isin(*scope))
    return (
        rows.groupBy("filer_id", date_col).agg(F.count_distinct("ticker").alias("n_tickers"))
        .filter(F.col("n_tickers") >= min_tickers)
    )


def exclude_baskets(
    df: DataFrame, trades: DataFrame, scope: Sequence[str] | None = None,
    by_trade: int = TRADE_DATE_BASKET, by_disclosure: int = DISCLOSURE_BASKET,
) -> DataFrame:
    """Drop rows in either kind of basket: two equi anti joins."""
    return outside_baskets(
        df, basket_groups(trades, "trade_date", by_trade, scope), basket_groups(trades, "disclosure_date", by_disclosure, scope))


def outside_baskets(df: DataFrame, td: DataFrame, dd: DataFrame) -> DataFrame:
    """Rows in no group of ``td`` (by trade date) or ``dd`` (by disclosure date), as ``basket_groups`` has them."""
    return df.join(td.drop("n_tickers"), ["filer_id", "trade_date"], "left_anti").join(
        dd.drop("n_tickers"), ["filer_id", "disclosure_date"], "left_anti")


def with_basket_flag(
    df: DataFrame, trades: DataFrame, scope: Sequence[str] | None = None,
    by_trade: int = TRADE_DATE_BASKET, by_disclosure: int = DISCLOSURE_BASKET,
) -> DataFrame:
    # Written, so that their size is known before rows are dealt out for them.
    td = materialize(basket_groups(trades, "trade_date", by_trade, scope).select("filer_id", "trade_date")).withColumn("_td", F.lit(1))
    dd = materialize(basket_groups(trades, "disclosure_date", by_disclosure, scope).select("filer_id", "disclosure_date")).withColumn("_dd", F.lit(1))
    return (
        df.join(td, ["filer_id", "trade_date"], "left").join(dd, ["filer_id", "disclosure_date"], "left")
        .withColumn("basket_day", F.coalesce("_td", "_dd", F.lit(0))).drop("_td", "_dd")
    )


def occupancy(df: DataFrame, cap_days: int = OPEN_POSITION_DAYS, held: DataFrame | None = None) -> DataFrame:
    """Per (filer, ticker) the buys that open a position (ids), the last close and the last day seen, as day numbers.

    ``held`` (filer_id, ticker, closes) continues from earlier rows.

    A buy disclosed on or before the close of the last opener is a repeat and moves nothing; an
    open position is capped at disclosure + ``cap_days``.  Closes lie after their disclosure, so
    only the first buy of a (filer, ticker, day) can open: rows are reduced to days before the
    fold, whose input is therefore bounded by the calendar.
    """
    pair = ["filer_id", "ticker"]
    close = F.coalesce("close_date_disc", F.date_add("disclosure_date", cap_days))
    days = df.groupBy(*pair, "disclosure_date").agg(
        F.min(F.struct("trade_id", F.unix_date(close).alias("close_day"))).alias("first")
    )
    sequence = days.groupBy(*pair).agg(
        F.sort_array(F.collect_list(F.struct(
            F.unix_date("disclosure_date").alias("day"), F.col("first.close_day").alias("close_day"),
            F.col("first.trade_id").alias("trade_id"),
        ))).alias("days")
    )
    first = F.lit(-(2**31)).cast("int")
    if held is not None:
        sequence = sequence.join(held.select(*pair, F.col("closes").cast("int").alias("_held")), pair, "left")
        first = F.coalesce(F.col("_held"), first)
    start = F.struct(first.alias("closes"), F.array().cast("array<string>").alias("ids"))
    opened = F.aggregate(
        "days", start,
        lambda acc, d: F.when(
            d["day"] > acc["closes"],
            F.struct(d["close_day"].alias("closes"), F.concat(acc["ids"], F.array(d["trade_id"])).alias("ids")),
        ).otherwise(acc),
    )
    return sequence.select(*pair, opened.alias("r"), F.element_at("days", -1)["day"].alias("seen")).select(*pair, "r.ids", "r.closes", "seen")


def position_openers(df: DataFrame, cap_days: int = OPEN_POSITION_DAYS) -> DataFrame:
    """trade_id of the buys that open a position under ``occupancy``."""
    return occupancy(df, cap_days).select(F.explode("ids").alias("trade_id"))


def flag_repeats(df: DataFrame, cap_days: int = OPEN_POSITION_DAYS) -> DataFrame:
    """``repeat_before_close``: 1 when an earlier position of the same filer and ticker is still open."""
    openers = position_openers(df, cap_days).withColumn("_opens", F.lit(1))
    return (
        df.join(openers, "trade_id", "left")
        .withColumn("repeat_before_close", F.when(F.col("_opens").isNull(), 1).otherwise(0)).drop("_opens")
    )


def shared_ids(df: DataFrame) -> DataFrame:
    """Hashes (``_id``) of the trade ids that several rows have, a written table."""
    return materialize(df.groupBy(F.xxhash64("trade_id").alias("_id")).agg(F.count("*").alias("_n")).filter("_n > 1").select("_id"))


def with_buy_columns(trades: DataFrame, buys: DataFrame, cols: Sequence[str]) -> DataFrame:
    """``trades`` with the columns ``cols`` of ``buys``, which are its buys, as by a left join on ``trade_id``.

    A buy whose id no other trade has meets only itself: it stands for its trade and stays where it is.  Just the rows of ids
    that several trades share are joined.  Ids are counted by their hashes, so that those of equal hashes are joined too.
    """
    shared = shared_ids(trades)
    alone = lambda df: df.withColumn("_id", F.xxhash64("trade_id")).join(shared, "_id", "left_anti")
    some = lambda df: df.withColumn("_id", F.xxhash64("trade_id")).join(shared, "_id", "left_semi")
    kinds = {f.name: f.dataType for f in buys.schema.fields}
    # A buy without an id meets none.
    own = alone(buys).select(*trades.columns, *[F.when(F.col("trade_id").isNotNull(), F.col(c)).alias(c) for c in cols])
    others = alone(trades.filter(~F.coalesce(F.col("transaction_type") == "buy", F.lit(False)))).select(
        *trades.columns, *[F.lit(None).cast(kinds[c]).alias(c) for c in cols])
    joined = some(trades).join(some(buys).select("trade_id", *cols), "trade_id", "left").select(*trades.columns, *cols)
    return own.unionByName(others).unionByName(joined)


def with_filing_lag(df: DataFrame, limit: int = LAG_LIMIT, scraped: str | None = None) -> DataFrame:
    """Calendar-day lag (scraped value only where a date is missing) and violation iff lag > limit."""
    lag = F.datediff("disclosure_date", "trade_date")
    lag = F.coalesce(lag, F.col(scraped).cast("int")) if scraped else lag
    return df.withColumn("filing_lag_days", lag).withColumn(
        "filing_violation", F.when(F.col("filing_lag_days") > limit, "violation").otherwise("compliant")
    )


def flag_signals(df: DataFrame, cluster_min: int = CLUSTER_MIN, move_min: float = ABS_MOVE_MIN) -> DataFrame:
    """Compliant stock buy with enough other buyers and a large enough move; NULL inputs give 0."""
    hit = (
        is_compliant_buy() & (F.col("asset_type") == "stock") & (F.col("cluster_count_td") >= cluster_min)
        & (F.col("abs_pct_move_before_disclosure") >= move_min)
    )
    return df.withColumn("signal_flag", F.when(hit, 1).otherwise(0))


def new_signals(flagged: DataFrame, filers: DataFrame, ledger: DataFrame) -> DataFrame:
    """Flagged trades absent from the ledger.

    ``report`` is 0 on a first run (empty ledger): everything is recorded, nothing is announced.
    """
    has_entries = ledger.limit(1).agg((F.count("*") > 0).cast("int").alias("report"))
    fresh = (
        flagged.filter("signal_flag = 1").join(ledger.select("trade_id").distinct(), "trade_id", "left_anti")
        .join(filers.select("filer_id", "name"), "filer_id")
        .select("trade_id", "ticker", "name", "disclosure_date", "cluster_count_td", "abs_pct_move_before_disclosure")
    )
    return fresh.join(F.broadcast(has_entries))  # the flag is exactly one row


def with_order_levels(df: DataFrame, stop: float = 10.0, target: float = 10.0, gap: float = 5.0) -> DataFrame:
    """Stop and target price from the entry; limit above which a gap-up entry is skipped."""
    return (
        df.withColumn("stop_price", stable_round(F.col("entry_price") * (1 - stop / 100), 2))
        .withColumn("target_price", stable_round(F.col("entry_price") * (1 + target / 100), 2))
        .withColumn("limit_price", stable_round(F.col("price_at_disclosure_date") * (1 + gap / 100), 4))
    )


def executable(df: DataFrame, gap: float = 5.0) -> DataFrame:
    """Signal met or no basket day, and the day-1 open within the gap limit (unknown opens pass)."""
    within = F.col("day1_open").isNull() | (F.col("day1_open") <= F.col("price_at_disclosure_date") * (1 + gap / 100))
    return df.filter(((F.col("signal_flag") == 1) | (F.col("basket_day") == 0)) & within)
