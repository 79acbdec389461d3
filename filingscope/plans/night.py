"""A night: label what the day brought, flag repeats, score filers and rank them.

Labels are kept as first-touch summaries (``operators.touches``).  A night reads the price days since the night before;
decided anchors are not read again.  Disclosures that arrive late, for a day that earlier nights have passed, are caught up
over the earlier prices of their own symbols.  Scores and the leaderboard then equal those of one pass over everything.
"""

from __future__ import annotations

import datetime
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.operators import flags, touches
from filingscope.operators.barriers import STOP_PCT, TARGET_PCT
from filingscope.plans import reports, scoring
from filingscope.session import materialize

#: Written parts of decided anchors after which they are written as one.
PARTS = 16


@dataclass(frozen=True)
class State:
    """What a night leaves to the next: open summaries, last price days and the decided summaries, all written tables."""

    until: datetime.date | None
    open: DataFrame
    quotes: DataFrame
    decided: tuple[DataFrame, ...]

    @classmethod
    def empty(cls, spark: SparkSession) -> State:
        return cls(None, spark.createDataFrame([], touches.SUMMARY), spark.createDataFrame([], touches.QUOTES), ())

    def summaries(self) -> DataFrame:
        out = self.open
        for part in self.decided:
            out = out.unionByName(part)
        return out


@dataclass(frozen=True)
class Night:
    """The tables of a night: labelled buys with the repeat flag, all filers with their scores, the leaderboard."""

    state: State
    labelled: DataFrame
    published: DataFrame
    leaders: DataFrame


def _between(name: str, after: datetime.date | None, until: datetime.date | None) -> Column:
    out = F.col(name).isNotNull()
    if after is not None:
        out &= F.col(name) > F.lit(after)
    return out if until is None else out & (F.col(name) <= F.lit(until))


def advance(state: State, buys: DataFrame, prices: DataFrame, until: datetime.date | None = None, stop: float = STOP_PCT, target: float = TARGET_PCT) -> State:
    """The state after the price days up to ``until`` (None: all), with the anchors of all ``buys`` disclosed by then."""
    spark = buys.sparkSession
    keys = buys.select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date")).filter(
        F.col("symbol").isNotNull() & _between("anchor_date", None, until)).distinct()
    open_, decided = state.open, list(state.decided)
    if state.until is not None:
        known = state.summaries().select("symbol", "anchor_date")
        late = materialize(keys.filter(F.col("anchor_date") <= F.lit(state.until)).join(known, ["symbol", "anchor_date"], "left_anti"))
        past = prices.filter(_between("date", None, state.until)).join(late.select("symbol").distinct(), "symbol", "left_semi")
        none = State.empty(spark)
        caught = materialize(touches.fold_slice(none.open, none.quotes, late, past, stop, target))
        decided.append(caught.filter(~touches.undecided()))
        open_ = open_.unionByName(caught.filter(touches.undecided()))
    days = prices.filter(_between("date", state.until, until))
    now = materialize(touches.fold_slice(open_, state.quotes, keys.filter(_between("anchor_date", state.until, until)), days, stop, target))
    decided.append(now.filter(~touches.undecided()))
    out = State(until, now.filter(touches.undecided()), materialize(touches.last_quotes(state.quotes, days)), tuple(decided))
    if len(decided) < PARTS:
        return out
    whole = State(None, State.empty(spark).open, out.quotes, out.decided).summaries()
    return State(until, out.open, out.quotes, (materialize(whole),))


def labels(state: State, buys: DataFrame, stop: float = STOP_PCT, target: float = TARGET_PCT) -> DataFrame:
    """``buys`` with the label columns of ``label_disclosures``; those without an anchor in the state have nulls."""
    rows = touches.summary_labels(state.summaries(), stop, target).select(
        F.col("symbol").alias("ticker"), F.col("anchor_date").alias("disclosure_date"), F.col("anchor_close").alias("price_at_disclosure_date"), "day1_open",
        "entry_price", "has_path", "outcome", F.col("days_to_exit").alias("days_to_exit_disc"), F.col("exit_date").alias("close_date_disc"),
        F.col("max_drawdown").alias("max_drawdown_disc"), *[F.col(f"hit_{n}pct").alias(f"drawdown_disc_{n}pct") for n in (5, 10, 15)])
    return buys.join(rows, ["ticker", "disclosure_date"], "left")


def with_repeats(labelled: DataFrame, trades: DataFrame, params: scoring.ScoreParams = scoring.DEFAULTS) -> DataFrame:
    """Labelled buys with the repeat flag, 0 outside the qualifying buys of no basket day."""
    return join_repeats(labelled, repeats(labelled, trades, params))


def repeats(labelled: DataFrame, trades: DataFrame, params: scoring.ScoreParams = scoring.DEFAULTS) -> DataFrame:
    """The repeats among the labelled buys, a written table of ids: rows go with their keys and dates only, and the pool is written once for both sides.

    Baskets are written too: of a known size, few of them are broadcast and the rows stay where they are.
    """
    rows = flags.qualifying_buys(labelled).select("trade_id", "filer_id", "ticker", "trade_date", "disclosure_date", "close_date_disc")
    td = materialize(flags.basket_groups(trades, "trade_date", params.basket_trade))
    dd = materialize(flags.basket_groups(trades, "disclosure_date", params.basket_disclosure))
    pool = materialize(flags.outside_baskets(rows, td, dd).drop("trade_date"))
    # A pair's only buy opens its position: the others meet in the fold alone.
    pairs = pool.groupBy("filer_id", "ticker").agg(F.count("*").alias("_n")).filter("_n > 1").select(F.col("filer_id").alias("_f"), F.col("ticker").alias("_t"))
    several = materialize(pairs)
    same = F.col("filer_id").eqNullSafe(F.col("_f")) & F.col("ticker").eqNullSafe(F.col("_t"))
    found = materialize(flags.flag_repeats(pool.join(several, same, "left_semi")).filter("repeat_before_close = 1").select("trade_id", "repeat_before_close"))
    # An id that opens a position is no repeat, also if rows of another pair have it too.
    opened = pool.join(found.select("trade_id").distinct(), "trade_id", "left_semi").join(several, same, "left_anti").select("trade_id")
    return materialize(found.join(opened, "trade_id", "left_anti"))


def join_repeats(labelled: DataFrame, found: DataFrame) -> DataFrame:
    """``labelled`` with the flag of ``repeats``; few repeats are broadcast, so that the wide rows stay where they are."""
    return labelled.join(found, "trade_id", "left").withColumn("repeat_before_close", F.coalesce("repeat_before_close", F.lit(0)))


def run_night(
    state: State, trades: DataFrame, prices: DataFrame, filers: DataFrame, until: datetime.date | None = None,
    params: scoring.ScoreParams = scoring.DEFAULTS,
) -> Night:
    """Label, flag, score and rank the ``trades`` known by the night of ``until``."""
    buys = trades.filter(F.col("transaction_type") == "buy")
    after = advance(state, buys, prices, until)
    rows = materialize(with_repeats(labels(after, buys), trades, params))
    published = materialize(scoring.publish_scores(filers, scoring.score_by_asset(rows, trades, params)))
    aligned = rows if "committee_relevance" in rows.columns else rows.withColumn("committee_relevance", F.lit(None).cast("string"))
    leaders = reports.leaderboard(published, scoring.filing_stats(aligned), scoring.late_filings(trades), trades)
    return Night(after, rows, published, leaders)
