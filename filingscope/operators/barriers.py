"""First-touch barrier labels.

A label depends only on (symbol, anchor date, entry price), so barriers are evaluated once per
distinct anchor and joined back to the trades: the work is bounded by symbols x calendar days and
does not grow with the number of trades that share an anchor.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.prices import anchor_entries, index_prices, path_rows
from filingscope.operators.scan import scan_touches
from filingscope.session import materialize

STOP_PCT = 10.0
TARGET_PCT = 10.0
BLOCK_DAYS = 32


def _tag(prefix: str, pct: float) -> str:
    return f"{prefix}_{str(float(pct)).replace('.', '_')}"


def _valid() -> Column:
    return F.col("high").isNotNull() & F.col("low").isNotNull()


def _hits_stop(low: str, pct: float) -> Column:
    return F.col(low) <= F.col("entry_price") * (1 - pct / 100)


def _hits_target(high: str, pct: float) -> Column:
    return F.col(high) >= F.col("entry_price") * (1 + pct / 100)


def _summarise(
    candidates: DataFrame, keys: Sequence[str], stops: Sequence[float], targets: Sequence[float],
) -> DataFrame:
    """One row per anchor: earliest touch of each barrier with the lowest low seen up to it."""
    seen = Window.partitionBy(*keys).orderBy("idx").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = candidates.withColumn("run_low", F.min(F.when(_valid(), F.col("low"))).over(seen))
    touch = F.struct("idx", "date", "run_low")
    aggs = [F.min(F.when(_valid() & _hits_stop("low", s), touch)).alias(_tag("stop", s)) for s in stops]
    aggs += [F.min(F.when(_valid() & _hits_target("high", t), touch)).alias(_tag("target", t)) for t in targets]
    return rows.groupBy(*keys).agg(
        *aggs, F.min("run_low").alias("lowest"), F.count("idx").alias("n_rows")
    )


def _open_ended(
    anchors: DataFrame, indexed: DataFrame, stops: Sequence[float], targets: Sequence[float],
) -> DataFrame:
    """First touches when paths have no end.

    A symbol's usable lows and highs form two arrays of numbers, with the extremes of every block of ``BLOCK_DAYS`` days beside
    them.  One join on the symbol brings them to each anchor.  Per barrier it looks through its head block, the blocks after it
    and the first touching one, each sliced out first; lows up to a touch are minima of slices.  Neither anchors nor days are
    multiplied, shuffled or sorted again.
    """
    def start_of(blk: Column) -> Column:
        """Day ``idx`` is the arrays' ``idx``-th element, so that block 0 lacks a day."""
        return F.greatest(blk * BLOCK_DAYS, F.lit(1))

    def per_block(extreme, days: str) -> Column:
        blocks = F.sequence(F.lit(0), F.floor(F.size("days") / BLOCK_DAYS).cast("int"))
        return F.transform(blocks, lambda b: extreme(F.slice(days, start_of(b), (b + 1) * BLOCK_DAYS - start_of(b))))

    def usable(side: str) -> Column:
        return F.transform("days", lambda d: F.when(d["high"].isNotNull() & d["low"].isNotNull(), d[side])).alias(f"{side}s")

    series = indexed.groupBy("symbol").agg(
        F.sort_array(F.collect_list(F.struct("idx", "date", "high", "low"))).alias("days")
    ).select(
        "symbol", "days", F.transform("days", lambda d: d["date"]).alias("dates"),
        usable("low"), usable("high"),
    ).select(
        "symbol", "dates", "lows", "highs", per_block(F.array_min, "lows").alias("block_lows"), per_block(F.array_max, "highs").alias("block_highs"))

    start, entry, size = F.col("start_idx"), F.col("entry_price"), F.size("dates")
    head = F.floor((start + 1) / BLOCK_DAYS).cast("int")
    # Days of the head block after the anchor.
    left = F.when(F.col("dates").isNotNull(), F.greatest(F.least(size, (head + 1) * BLOCK_DAYS - 1) - start, F.lit(0)))

    def touches(side: str, pct: float):
        return (lambda v: v <= entry * (1 - pct / 100)) if side == "low" else (lambda v: v >= entry * (1 + pct / 100))

    tests = [(_tag("stop", s), "low", touches("low", s)) for s in stops] + [(_tag("target", t), "high", touches("high", t)) for t in targets]

    def first(values: Column, test) -> Column:
        """Place of the first value that passes, from 1; 0 if none does."""
        return F.array_position(F.transform(values, test), F.lit(True)).cast("int")

    # A block after the head block is found by its extremes, then the day in it.
    later = lambda side: F.slice(f"block_{side}s", head + 2, F.greatest(F.size(f"block_{side}s") - head - 1, F.lit(0)))
    skips = {name: first(later(side), test) for name, side, test in tests}
    opened = lambda name: start_of(head + F.col(f"skip_{name}"))
    sides = {name: sorted({"low", side}) for name, side, _ in tests}
    # The long arrays end in the first projection, as each further one would copy them for every anchor.
    spans = anchors.join(series, "symbol", "left").select(
        *anchors.columns, left.alias("n_rows"), later("low").alias("later"),
        *[F.slice(days, start + 1, left).alias(f"head_{days}") for days in ("lows", "highs", "dates")],
        *[c for name, skip in skips.items() for c in (
            skip.alias(f"skip_{name}"),
            *[F.slice(f"{x}s", start_of(head + skip), BLOCK_DAYS).alias(f"{x}s_{name}") for x in (*sides[name], "date")])])

    def least(values: str, n: Column) -> Column:
        return F.array_min(F.slice(values, F.lit(1), F.greatest(n, F.lit(0))))

    # All that loops over arrays stands in projections with lambdas: in one without, it would make generated code too long to be compiled.
    nears = {name: first(F.col(f"head_{side}s"), test) for name, side, test in tests}
    fars = {name: F.when(F.col(f"skip_{name}") > 0, first(F.col(f"{side}s_{name}"), test)) for name, side, test in tests}
    found = spans.select(
        *anchors.columns, "n_rows", F.array_min("head_lows").alias("head_low"), F.array_min("later").alias("later_low"),
        *[c for name in nears for c in (
            nears[name].alias(f"near_{name}"), F.get("head_dates", nears[name] - 1).alias(f"near_date_{name}"),
            least("head_lows", nears[name]).alias(f"near_low_{name}"),
            fars[name].alias(f"far_{name}"), F.get(f"dates_{name}", fars[name] - 1).alias(f"far_date_{name}"),
            F.least(least(f"lows_{name}", fars[name]), least("later", F.col(f"skip_{name}") - 1)).alias(f"far_low_{name}"), f"skip_{name}")])

    def touch(name: str) -> Column:
        near, far = F.col(f"near_{name}"), F.col(f"far_{name}")
        at = lambda idx, kind, low: F.struct(idx.cast("int").alias("idx"), F.col(f"{kind}_date_{name}").alias("date"), low.alias("run_low"))
        return F.when(near > 0, at(start + near, "near", F.col(f"near_low_{name}"))).when(
            far > 0, at(opened(name) + far - 1, "far", F.least(f"far_low_{name}", "head_low"))).alias(name)

    return found.select(
        *anchors.columns, *[touch(name) for name, _, _ in tests], F.least("head_low", "later_low").alias("lowest"),
        F.coalesce("n_rows", F.lit(0)).alias("n_rows"),
    )


def first_touches(
    anchors: DataFrame, indexed: DataFrame, *, horizon_days: int | None = None,
    stops: Sequence[float] = (STOP_PCT,), targets: Sequence[float] = (TARGET_PCT,),
) -> DataFrame:
    """Earliest touch of every stop and target for each anchor of ``anchor_entries``."""
    if horizon_days is None:
        return _open_ended(anchors, indexed, stops, targets)
    keys = [*anchors.columns, "bucket"]
    return _summarise(path_rows(anchors, indexed, horizon_days), keys, stops, targets).drop("bucket")


def decide(touches: DataFrame, stop: float = STOP_PCT, target: float = TARGET_PCT, keep: Sequence[str] = ()) -> DataFrame:
    """Outcome, exit and drawdown columns for one stop/target pair, and the columns ``keep``.  The stop wins a same-day tie.

    A loss is stored as exactly -stop; a win keeps the lowest low up to its exit; an open path the
    lowest low overall.  Anchors without entry or path get outcome ``open`` and NULL drawdown.
    """
    s, t = F.col(_tag("stop", stop)), F.col(_tag("target", target))
    entry = F.col("entry_price")
    usable = (F.col("n_rows") > 0) & (entry > 0)
    lost = usable & s.isNotNull() & (t.isNull() | (s["idx"] <= t["idx"]))
    won = usable & t.isNotNull() & (s.isNull() | (t["idx"] < s["idx"]))
    deepest = F.when(lost, s["run_low"]).when(won, t["run_low"]).otherwise(F.col("lowest"))
    dd = F.least(F.lit(0.0), F.coalesce((deepest - entry) / entry * 100, F.lit(0.0)))
    exit_day = F.when(lost, s["idx"]).when(won, t["idx"]) - F.col("start_idx")
    flag = lambda cond: F.when(usable, cond.cast("int"))
    return touches.select(
        "symbol", "anchor_date", "anchor_close", "day1_open", "entry_price", "start_idx",
        (F.col("n_rows") > 0).alias("has_path"),
        F.when(lost, "loss").when(won, "win").otherwise("open").alias("outcome"),
        exit_day.cast("int").alias("days_to_exit"),
        F.when(lost, s["date"]).when(won, t["date"]).alias("exit_date"),
        F.when(usable, F.when(lost, F.lit(-float(stop))).otherwise(stable_round(dd, 4))).alias("max_drawdown"),
        flag(lost | (dd <= -5.0)).alias("hit_5pct"),
        flag(lost | (~won & (dd <= -10.0))).alias("hit_10pct"),
        flag(~won & (dd <= -15.0)).alias("hit_15pct"), *keep,
    )


def label_anchors(
    keys: DataFrame, prices: DataFrame, *, horizon_days: int | None = None,
    stop: float = STOP_PCT, target: float = TARGET_PCT,
) -> DataFrame:
    """Labels for distinct (symbol, anchor_date) keys; entry is the day-1 open."""
    if horizon_days is None:
        return decide(scan_touches(keys, prices, {_tag("stop", stop): stop}, {_tag("target", target): target}), stop, target)
    indexed = index_prices(prices)
    anchors = anchor_entries(keys, indexed)
    touches = first_touches(anchors, indexed, horizon_days=horizon_days, stops=[stop], targets=[target])
    return decide(touches, stop, target)


def label_disclosures(
    trades: DataFrame, prices: DataFrame, *, horizon_days: int | None = None,
    stop: float = STOP_PCT, target: float = TARGET_PCT,
) -> DataFrame:
    """Add the disclosure price, entry, outcome and drawdown columns to ``trades``."""
    keys = (
        trades.select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date"))
        .dropna().distinct()
    )
    labels = label_anchors(keys, prices, horizon_days=horizon_days, stop=stop, target=target).select(
        F.col("symbol").alias("ticker"), F.col("anchor_date").alias("disclosure_date"),
        F.col("anchor_close").alias("price_at_disclosure_date"), "day1_open", "entry_price", "has_path", "outcome",
        F.col("days_to_exit").alias("days_to_exit_disc"), F.col("exit_date").alias("close_date_disc"),
        F.col("max_drawdown").alias("max_drawdown_disc"), F.col("hit_5pct").alias("drawdown_disc_5pct"),
        F.col("hit_10pct").alias("drawdown_disc_10pct"), F.col("hit_15pct").alias("drawdown_disc_15pct"),
    )
    return trades.join(labels, ["ticker", "disclosure_date"], "left")


def label_both_anchors(
    trades: DataFrame, prices: DataFrame, *, horizon_days: int | None = None,
    stop: float = STOP_PCT, target: float = TARGET_PCT,
) -> DataFrame:
    """Labels from the trade date (entry: its close) and the disclosure date (entry: day-1 open).

    The labels of both kinds of anchors are written once, and each trade then takes two of them.
    """
    leg = lambda on, at_close: F.struct(F.col(on).alias("anchor_date"), F.lit(at_close).alias("at_close"))
    pairs = trades.select(
        F.col("ticker").alias("symbol"), F.explode(F.array(leg("trade_date", True), leg("disclosure_date", False))).alias("a"),
    ).select("symbol", "a.*").dropna().distinct()
    if horizon_days is None:
        touches = scan_touches(pairs, prices, {_tag("stop", stop): stop}, {_tag("target", target): target})
    else:
        indexed = index_prices(prices)
        entries = anchor_entries(pairs.select("symbol", "anchor_date"), indexed)
        anchors = pairs.join(entries, ["symbol", "anchor_date"]).withColumn(
            "entry_price", F.when(F.col("at_close"), F.col("anchor_close")).otherwise(F.col("entry_price")))
        touches = first_touches(anchors, indexed, horizon_days=horizon_days, stops=[stop], targets=[target])
    labels = materialize(decide(touches, stop, target, ["at_close"]).select(
        "symbol", "anchor_date", "at_close", "outcome", "days_to_exit", "max_drawdown", "hit_5pct", "hit_10pct", "hit_15pct"))
    out = trades
    for anchor, on, dd in (("trade", "trade_date", "max_drawdown_before_profit"), ("disc", "disclosure_date", "max_drawdown_disc")):
        side = labels.filter(F.col("at_close") if anchor == "trade" else ~F.col("at_close")).select(
            F.col("symbol").alias("ticker"), F.col("anchor_date").alias(on),
            F.col("outcome").alias(f"outcome_{anchor}"), F.col("days_to_exit").alias(f"days_to_exit_{anchor}"),
            F.col("max_drawdown").alias(dd), F.col("hit_5pct").alias(f"drawdown_{anchor}_5pct"),
            F.col("hit_10pct").alias(f"drawdown_{anchor}_10pct"), F.col("hit_15pct").alias(f"drawdown_{anchor}_15pct"),
        )
        out = out.join(side, ["ticker", on], "left")
    return out


def label_paths(paths: DataFrame, entries: DataFrame, stop: float = STOP_PCT, target: float = TARGET_PCT) -> DataFrame:
    """Labels over a materialised path table (trade_id, day, date, high, low) and (trade_id, entry_price)."""
    rows = entries.select(
        F.col("trade_id").alias("symbol"), F.lit(None).cast("date").alias("anchor_date"), F.lit(0).alias("start_idx"),
        F.lit(None).cast("double").alias("anchor_close"), F.lit(None).cast("double").alias("day1_open"), "entry_price",
    )
    keys = rows.columns
    days = paths.select(F.col("trade_id").alias("symbol"), F.col("day").alias("idx"), "date", "high", "low")
    touches = _summarise(rows.join(days, "symbol", "left"), keys, [stop], [target])
    return decide(touches, stop, target).withColumnRenamed("symbol", "trade_id").drop("anchor_date", "anchor_close", "day1_open", "start_idx")


def with_entry(trades: DataFrame, paths: DataFrame) -> DataFrame:
    """Entry price from a materialised path: day-1 open if positive, else the disclosure close."""
    day1 = paths.filter("anchor = 'disc' AND day = 1 AND open > 0").select("trade_id", F.col("open").alias("day1_open"))
    return trades.join(day1, "trade_id", "left").withColumn(
        "entry_price", F.coalesce("day1_open", "price_at_disclosure_date")
    )


def outcome_from_columns() -> Column:
    """Outcome from the stored drawdown and exit day."""
    dd, day = F.col("max_drawdown_disc"), F.col("days_to_exit_disc")
    return F.when(dd <= -10, "loss").when((dd > -10) & day.isNotNull(), "win").otherwise("open")
