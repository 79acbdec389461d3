"""Price lookups: as-of, nearest and forward joins, paths and market features.

Every lookup first reduces the left side to its distinct (symbol, date) pairs.  A symbol then
contributes at most one row per calendar day to any window, however many trades name it, and the
trades themselves are only touched by one equi join on (symbol, date).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.scan import scan_nearest
from filingscope.session import materialize

EPOCH_START = "0001-01-01"


def index_prices(prices: DataFrame) -> DataFrame:
    """Number each symbol's price days 1..n and carry the following day's open."""
    by_day = Window.partitionBy("symbol").orderBy("date")
    return prices.select(
        "symbol", "date", "open", "high", "low", "close",
        F.row_number().over(by_day).alias("idx"),
        F.lead("open").over(by_day).alias("next_open"),
    )


def _carry_forward(keys: DataFrame, events: DataFrame, by: str = "symbol") -> DataFrame:
    """Latest non-null ``payload`` of ``events`` on or before each distinct (by, date) of ``keys``."""
    none = F.lit(None).cast(events.schema["payload"].dataType).alias("payload")
    both = events.select(by, "date", "payload", F.lit(0).alias("is_key")).unionByName(
        keys.select(by, "date", none, F.lit(1).alias("is_key"))
    )
    so_far = (
        Window.partitionBy(by).orderBy("date", "is_key")
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    return (
        both.withColumn("payload", F.last("payload", ignorenulls=True).over(so_far))
        .filter("is_key = 1").drop("is_key")
    )


def asof_join(
    left: DataFrame, prices: DataFrame, on: str, by: str = "ticker", out: str = "asof_close",
) -> DataFrame:
    """Close on or before ``left[on]``; NULL when the symbol has no earlier price."""
    return left.join(asof_closes(left, prices, on, by, out), [by, on], "left")


def asof_closes(
    left: DataFrame, prices: DataFrame, on: str, by: str = "ticker", out: str = "asof_close",
) -> DataFrame:
    """The close on or before each distinct (``by``, ``on``) of ``left``."""
    keys = (
        left.select(F.col(by).alias("symbol"), F.col(on).alias("date"))
        .filter("symbol IS NOT NULL AND date IS NOT NULL").distinct()
    )
    events = prices.filter("close IS NOT NULL").select("symbol", "date", F.col("close").alias("payload"))
    return _carry_forward(keys, events).select(
        F.col("symbol").alias(by), F.col("date").alias(on), F.col("payload").alias(out)
    )


def anchor_entries(keys: DataFrame, indexed: DataFrame) -> DataFrame:
    """Entry price per (symbol, anchor_date).

    ``anchor_close`` is the close on or before the anchor, ``start_idx`` the index of that price
    day (0 when the anchor precedes the series), ``day1_open`` the open of the next price day and
    ``entry_price`` the day-1 open if positive, else the anchor close.
    """
    row = F.struct(
        "date", F.struct("idx", "close", F.col("next_open").alias("day1_open")).alias("payload")
    )
    before_first = F.struct(
        F.lit(EPOCH_START).cast("date").alias("date"),
        F.struct(
            F.lit(0).alias("idx"), F.lit(None).cast("double").alias("close"),
            F.col("open").alias("day1_open"),
        ).alias("payload"),
    )
    events = indexed.select(
        "symbol", F.explode(F.when(F.col("idx") == 1, F.array(before_first, row)).otherwise(F.array(row))).alias("e")
    ).select("symbol", "e.date", "e.payload")
    found = _carry_forward(keys.select("symbol", F.col("anchor_date").alias("date")).distinct(), events)
    return found.select(
        "symbol", F.col("date").alias("anchor_date"),
        F.col("payload.idx").alias("start_idx"),
        F.col("payload.close").alias("anchor_close"),
        F.col("payload.day1_open").alias("day1_open"),
        F.coalesce(
            F.when(F.col("payload.day1_open") > 0, F.col("payload.day1_open")), F.col("payload.close")
        ).alias("entry_price"),
    )


def path_rows(anchors: DataFrame, indexed: DataFrame, horizon_days: int) -> DataFrame:
    """Price days strictly after each anchor, up to ``horizon_days`` calendar days later.

    A range join on equi keys (symbol, bucket).  The price rows are the replicated side, twice
    each, and the anchors keep one bucket, so all rows of an anchor meet in one shuffle partition:
    later windows and aggregates on the anchor need no exchange of the exploded pairs.
    """
    width = max(horizon_days, 16)
    left = anchors.withColumn("bucket", F.floor(F.unix_date("anchor_date") / width))
    own = F.floor(F.unix_date("date") / width)
    right = indexed.select(
        F.col("symbol").alias("p_symbol"), "date", "open", "high", "low", "close", "idx",
        F.explode(F.array(own, own - 1)).alias("p_bucket"),
    )
    return left.join(
        right,
        (F.col("symbol") == F.col("p_symbol")) & (F.col("bucket") == F.col("p_bucket"))
        & (F.col("date") > F.col("anchor_date"))
        & (F.col("date") <= F.date_add("anchor_date", horizon_days)),
        "left",
    ).drop("p_symbol", "p_bucket")


#: Days of a bucket of an open-ended path: a symbol's paths are dealt over its buckets, a trade enters all from its own on.
PATH_BUCKET = 1024


def with_last_bucket(anchors: DataFrame, indexed: DataFrame) -> DataFrame:
    """Anchors of a symbol with prices, with the symbol's last bucket (``last``)."""
    ends = indexed.groupBy("symbol").agg(F.max(F.floor(F.unix_date("date") / PATH_BUCKET)).alias("last"))
    return anchors.join(ends, "symbol")


def later_days(started: DataFrame, indexed: DataFrame) -> DataFrame:
    """All price days after the anchor of each row (symbol, anchor_date, start_idx, and ``last`` if known), without an end.

    A range join on (symbol, bucket): rows enter every bucket from their own to the symbol's last, price rows one each,
    so that the paths of one symbol are dealt over its buckets.  Rows bring what is wanted beside the days; join them to their
    anchors before, as the days found are many and should not be shuffled.
    """
    own = F.floor(F.unix_date("date") / PATH_BUCKET)
    right = indexed.select(F.col("symbol").alias("p_symbol"), "date", "open", "high", "low", "close", "idx", own.alias("p_bucket"))
    first = F.floor(F.unix_date("anchor_date") / PATH_BUCKET)
    ended = started if "last" in started.columns else with_last_bucket(started, indexed)
    left = ended.filter(F.col("last") >= first).withColumn("bucket", F.explode(F.sequence(first, F.col("last")))).drop("last")
    return left.join(
        right, (F.col("symbol") == F.col("p_symbol")) & (F.col("bucket") == F.col("p_bucket")) & (F.col("idx") > F.col("start_idx")),
    ).drop("p_symbol", "p_bucket", "bucket")


def build_paths(
    trades: DataFrame, prices: DataFrame, anchor: str = "disc", horizon_days: int | None = None, keep: Sequence[str] = (),
) -> DataFrame:
    """Materialised path per trade: day 1..n, OHLC and % change of close from the anchor close, and the columns ``keep`` of the trade.

    Prefer the label plans, which never write one copy of the prices per trade.
    """
    on = {"disc": "disclosure_date", "trade": "trade_date"}[anchor]
    keyed = trades.filter(F.col(on).isNotNull()).select(
        "trade_id", F.col("ticker").alias("symbol"), F.col(on).alias("anchor_date"), *keep
    )
    indexed = index_prices(prices)
    anchors = anchor_entries(keyed.select("symbol", "anchor_date"), indexed)
    # Trades meet their anchors first, so that the days found stay where the range join put them.
    if horizon_days is None:
        starts = with_last_bucket(anchors.filter("start_idx IS NOT NULL").select("symbol", "anchor_date", "start_idx", "anchor_close"), indexed)
        days = later_days(keyed.join(starts, ["symbol", "anchor_date"]), indexed)
    else:
        starts = anchors.select("symbol", "anchor_date", "start_idx", "anchor_close")
        days = path_rows(keyed.join(starts, ["symbol", "anchor_date"]), indexed, horizon_days).filter("idx IS NOT NULL")
    pct = F.when(
        F.col("anchor_close") > 0,
        stable_round((F.col("close") - F.col("anchor_close")) / F.col("anchor_close") * 100, 4),
    )
    return days.select(
        "trade_id", F.lit(anchor).alias("anchor"), (F.col("idx") - F.col("start_idx")).cast("int").alias("day"),
        "date", "open", "high", "low", "close", pct.alias("pct_change"), *keep,
    )


def extend_paths(
    paths: DataFrame, trades: DataFrame, prices: DataFrame, as_of: Column,
) -> DataFrame:
    """Rows to append: later price days of still-open trades, continuing the day numbers.

    ``trades`` needs trade_id, ticker, price_at_disclosure_date, days_to_exit_disc.
    """
    last = (
        paths.filter("anchor = 'disc'").groupBy("trade_id")
        .agg(F.max("day").alias("last_day"), F.max("date").alias("last_date"))
        .filter(F.col("last_date") < as_of)
    )
    openings = (
        trades.filter("days_to_exit_disc IS NULL AND coalesce(price_fetch_failed, 0) = 0")
        .select("trade_id", F.col("ticker").alias("symbol"), "price_at_disclosure_date")
        .join(last, "trade_id")
    )
    ends = (
        openings.select("symbol", F.col("last_date").alias("anchor_date")).distinct()
    )
    indexed = index_prices(prices)
    starts = anchor_entries(ends, indexed).filter("start_idx IS NOT NULL").select("symbol", "anchor_date", "start_idx")
    starts = with_last_bucket(starts, indexed.filter(F.col("date") <= as_of))
    started = openings.withColumnRenamed("last_date", "anchor_date").join(starts, ["symbol", "anchor_date"])
    new_days = later_days(started, indexed.filter(F.col("date") <= as_of))
    base = F.col("price_at_disclosure_date")
    return new_days.select(
        "trade_id", F.lit("disc").alias("anchor"),
        (F.col("last_day") + F.col("idx") - F.col("start_idx")).cast("int").alias("day"),
        "date", "open", "high", "low", "close",
        F.when(base > 0, stable_round((F.col("close") - base) / base * 100, 4)).alias("pct_change"),
    )


def trades_without_paths(trades: DataFrame, paths: DataFrame) -> DataFrame:
    """Buys with no disclosure path yet."""
    have = paths.filter("anchor = 'disc'").select("trade_id").distinct()
    return trades.filter(
        "transaction_type = 'buy' AND ticker IS NOT NULL AND disclosure_date IS NOT NULL"
    ).join(have, "trade_id", "left_anti")


def nearest_lookup(keys: DataFrame, prices: DataFrame, fwd: int = 5, back: int = 3) -> DataFrame:
    """Close at (symbol, date), else the nearest later day within ``fwd``, else earlier within ``back``.

    Every price day also carries the following one, so one as-of pass sees both neighbours.
    """
    by_day = Window.partitionBy("symbol").orderBy("date")
    quotes = prices.filter("close IS NOT NULL").select(
        "symbol", "date", F.struct(F.col("date").alias("day"), "close").alias("here"),
        F.lead(F.struct(F.col("date").alias("day"), "close")).over(by_day).alias("ahead"),
        F.row_number().over(by_day).alias("idx"),
    )
    row = F.struct("date", F.struct("here", "ahead").alias("payload"))
    none = F.lit(None).cast("struct<day:date,close:double>")
    before_first = F.struct(
        F.lit(EPOCH_START).cast("date").alias("date"), F.struct(none.alias("here"), F.col("here").alias("ahead")).alias("payload")
    )
    events = quotes.select(
        "symbol", F.explode(F.when(F.col("idx") == 1, F.array(before_first, row)).otherwise(F.array(row))).alias("e")
    ).select("symbol", "e.date", "e.payload")
    here, ahead = F.col("payload.here"), F.col("payload.ahead")
    close = (
        F.when(here["day"] == F.col("date"), here["close"])
        .when(ahead["day"] <= F.date_add("date", fwd), ahead["close"])
        .when(here["day"] >= F.date_sub("date", back), here["close"])
    )
    return _carry_forward(keys.select("symbol", "date").distinct(), events).select("symbol", "date", close.alias("close"))


def nearest_join(
    left: DataFrame, prices: DataFrame, on: str, by: str = "ticker", out: str = "nearest_close",
    fwd: int = 5, back: int = 3,
) -> DataFrame:
    keys = left.select(F.col(by).alias("symbol"), F.col(on).alias("date")).dropna()
    found = nearest_lookup(keys, prices, fwd, back).select(
        F.col("symbol").alias(by), F.col("date").alias(on), stable_round("close", 4).alias(out)
    )
    return left.join(found, [by, on], "left")


def nearest_days(prices: DataFrame, fwd: int = 5, back: int = 3) -> DataFrame:
    """(symbol, date, close) for every calendar day that has a nearest price: the day's own, else the next within ``fwd``
    days, else the last within ``back``.

    Each price day knows its follower, so it writes the days up to that one alone: at most 1 + ``fwd`` + ``back`` rows.
    """
    by_day = Window.partitionBy("symbol").orderBy("date")
    quotes = prices.filter("close IS NOT NULL").select(
        "symbol", "date", "close", F.lead("date").over(by_day).alias("next"), F.lead("close").over(by_day).alias("next_close"),
        F.row_number().over(by_day).alias("idx"))
    day = lambda d, close: F.struct(d.alias("date"), close.alias("close"))
    none = F.array().cast("array<struct<date:date,close:double>>")
    # From here on the follower is nearer.
    ahead = F.when(F.col("next").isNotNull(), F.greatest(F.date_sub("next", fwd), F.date_add("date", 1)))
    held = F.least(F.date_add("date", back), F.coalesce(F.date_sub(ahead, 1), F.date_add("date", back)))
    parts = F.concat(
        F.transform(F.sequence("date", held), lambda d: day(d, F.col("close"))),
        F.when(F.col("next") > ahead, F.transform(F.sequence(ahead, F.date_sub("next", 1)), lambda d: day(d, F.col("next_close")))).otherwise(none),
        F.when((F.col("idx") == 1) & F.lit(fwd > 0), F.transform(F.sequence(F.date_sub("date", fwd), F.date_sub("date", 1)), lambda d: day(d, F.col("close")))).otherwise(none))
    return quotes.select("symbol", F.explode(parts).alias("q")).select("symbol", "q.date", "q.close")


FORWARD_WINDOWS = (7, 30, 60, 90, 120, 150, 180)


def forward_returns(
    trades: DataFrame, prices: DataFrame, windows: Sequence[int] = FORWARD_WINDOWS,
) -> DataFrame:
    """Price and % return ``windows`` days after the trade and the disclosure date.

    Computed once per distinct (ticker, date) of either kind, in one sorted pass over each symbol's days, written and then joined to the trades.
    """
    offsets = [0, *windows]
    leg = lambda on, traded: F.struct(F.col(on).alias("base_date"), F.lit(traded).alias("traded"))
    keys = trades.select(
        F.col("ticker").alias("symbol"), F.explode(F.array(leg("trade_date", True), leg("disclosure_date", False))).alias("k"),
    ).select("symbol", "k.*").dropna().distinct()
    found = materialize(scan_nearest(keys, prices, offsets).select(
        "symbol", "base_date", "traded", *[stable_round(f"p{o}", 4).alias(f"p{o}") for o in offsets]))
    out = trades
    for tag, on in (("trade", "trade_date"), ("disc", "disclosure_date")):
        base = F.col("p0")
        wide = found.filter(F.col("traded") if tag == "trade" else ~F.col("traded"))
        cols = [F.col("symbol").alias("ticker"), F.col("base_date").alias(on), base.alias(f"price_{tag}")]
        for w in windows:
            cols.append(F.col(f"p{w}").alias(f"price_{tag}_{w}d"))
            cols.append(
                F.when(base > 0, stable_round((F.col(f"p{w}") - base) / base * 100, 4)).alias(f"return_{tag}_{w}d")
            )
        out = out.join(wide.select(*cols), ["ticker", on], "left")
    return out


# Bucket borders of the pre-disclosure move, in percent.
MOVE_BORDERS = (-15, 0, 15)


def with_pre_disclosure_move(df: DataFrame) -> DataFrame:
    """% move from the trade-date close to the disclosure close, its size and its bucket."""
    bought, disclosed = F.col("price_at_trade_date"), F.col("price_at_disclosure_date")
    pct = F.when((bought > 0) & (disclosed > 0), stable_round((disclosed - bought) / bought * 100, 4))
    low, mid, high = MOVE_BORDERS
    return (
        df.withColumn("pct_move_before_disclosure", pct)
        .withColumn("abs_pct_move_before_disclosure", stable_round(F.abs("pct_move_before_disclosure"), 4))
        .withColumn(
            "pct_move_bucket",
            F.when(F.col("pct_move_before_disclosure") < low, "deep_dip")
            .when(F.col("pct_move_before_disclosure") < mid, "dip")
            .when(F.col("pct_move_before_disclosure") < high, "gain")
            .when(F.col("pct_move_before_disclosure").isNotNull(), "strong_gain"),
        )
    )
