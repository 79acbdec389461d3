"""Reports over labelled trades, filers and scores."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.barriers import outcome_from_columns
from filingscope.operators.flags import basket_groups, fetch_ok, is_compliant_buy
from filingscope.session import materialize


def _pct(a: Column, b: Column, digits: int) -> Column:
    return stable_round(F.when(b > 0, 100.0 * a / b), digits)


# -- leaderboard ------------------------------------------------------------------------------

def leaderboard(published: DataFrame, stats: DataFrame, late: DataFrame, trades: DataFrame) -> DataFrame:
    """Scored filers with filing statistics and last buy, best score first."""
    last = trades.filter("transaction_type = 'buy'").groupBy("filer_id").agg(F.max("disclosure_date").alias("last_trade_date"))
    out = (
        published.filter("score IS NOT NULL OR score_etf IS NOT NULL")
        .join(stats, "filer_id", "left").join(late, "filer_id", "left").join(last, "filer_id", "left")
    )
    n, aligned = F.coalesce("compliant_trades_all", F.lit(0)), F.coalesce("comm_aligned", F.lit(0))
    return out.select(
        "filer_id", "name", "party", "chamber", "state", "score", "win_rate", "total_trades",
        "score_etf", "win_rate_etf", "etf_trade_count", "avg_dd", "large_trade_wr",
        n.alias("compliant_trades"), "avg_filing_lag", F.coalesce("late_filings", F.lit(0)).alias("late_filings"),
        aligned.alias("comm_aligned"), "last_trade_date",
        F.coalesce(_pct(aligned, n, 1), F.lit(0.0)).alias("comm_align_pct"),
    ).orderBy(
        F.coalesce("score", F.lit(0.0)).desc(), F.coalesce("score_etf", F.lit(0.0)).desc(), "filer_id"
    )


def filter_leaderboard(
    df: DataFrame, *, party: str | None = None, chamber: str | None = None, state: str | None = None,
    min_trades: int | None = None, since: Column | None = None, aligned_only: bool = False, max_lag: float | None = None,
) -> DataFrame:
    for col, value in (("party", party), ("chamber", chamber), ("state", state)):
        if value is not None:
            df = df.filter(F.col(col) == value)
    if min_trades is not None:
        df = df.filter(F.col("total_trades") >= min_trades)
    if since is not None:
        df = df.filter(F.col("last_trade_date") >= since)
    if aligned_only:
        df = df.filter("comm_aligned > 0")
    if max_lag is not None:
        df = df.filter(F.col("avg_filing_lag") <= max_lag)
    return df


def regrid(leaders: DataFrame, cell: DataFrame) -> DataFrame:
    """Overlay one grid cell: its values where present, stored values elsewhere."""
    return leaders.join(cell.select("filer_id", "combo_trades", "combo_wins", "combo_losses", "combo_wr", "combo_dd"), "filer_id", "left").withColumns({
        "win_rate": F.coalesce("combo_wr", "win_rate"), "avg_dd": F.coalesce("combo_dd", "avg_dd"),
        "compliant_trades": F.coalesce("combo_trades", "compliant_trades"),
    }).orderBy(F.col("combo_wr").desc_nulls_last(), "filer_id")


def regrid_party(regridded: DataFrame) -> DataFrame:
    """Decided win rate overall and by party from the grid's wins and losses."""
    w, l = (F.coalesce(F.sum(c), F.lit(0)) for c in ("combo_wins", "combo_losses"))
    return regridded.rollup("party").agg(w.alias("wins"), l.alias("losses"), _pct(w, w + l, 1).alias("win_rate"))


def rank_filers(scores: DataFrame) -> DataFrame:
    """Rank by score with the previous and next filer, without one global sort task.

    Rows are range-partitioned and written once; ranks and neighbours come from inside each range,
    and only one summary row per range (size, first and last name) is combined across ranges.
    """
    ranged = materialize(
        scores.select("filer_id", "name", "score").repartitionByRange(F.col("score").desc_nulls_last(), F.col("filer_id"))
        .withColumn("part", F.spark_partition_id())
    )
    order = [F.col("score").desc_nulls_last(), F.col("filer_id")]
    inside = Window.partitionBy("part").orderBy(*order)
    across = Window.orderBy("part")  # one row per range
    key = F.struct(F.coalesce(-F.col("score"), F.lit(float("inf"))).alias("k"), "filer_id")
    ranges = ranged.groupBy("part").agg(
        F.count("*").alias("n"), F.min_by("name", key).alias("first_name"), F.max_by("name", key).alias("last_name")
    ).select(
        "part", (F.sum("n").over(across) - F.col("n")).alias("before"),
        F.lag("last_name").over(across).alias("name_before"), F.lead("first_name").over(across).alias("name_after"),
    )
    return ranged.join(ranges, "part").select(
        "filer_id", "name", "score", (F.col("before") + F.row_number().over(inside)).alias("rank"),
        F.when(F.row_number().over(inside) == 1, F.col("name_before")).otherwise(F.lag("name").over(inside)).alias("prev_name"),
        F.coalesce(F.lead("name").over(inside), "name_after").alias("next_name"),
    )


def top_k(df: DataFrame, order: Sequence[Column], k: int) -> DataFrame:
    return df.orderBy(*order).limit(k)


def export_leaderboard(df: DataFrame, path: str) -> None:
    """CSV export with display headers."""
    export_columns(df).write.mode("overwrite").option("header", True).csv(path)


def export_columns(df: DataFrame) -> DataFrame:
    # Column -> header of the export.
    headers = {
        "name": "Politician", "party": "Party", "chamber": "Chamber", "state": "State", "score": "Score",
        "win_rate": "Win%", "avg_dd": "Avg DD", "large_trade_wr": "Large Win%", "compliant_trades": "Comp Buys",
        "late_filings": "Late Files", "avg_filing_lag": "Avg Lag", "comm_align_pct": "Comm Align%",
    }
    return df.select(*[F.col(c).alias(h) for c, h in headers.items()])


# -- headline numbers -------------------------------------------------------------------------

def weighted_win_rate(scores: DataFrame) -> DataFrame:
    """Trade-weighted win rate overall and by party, rebuilt from filer rates."""
    wins = F.sum(stable_round(F.col("win_rate") / 100.0 * F.col("total_trades")))
    total = F.sum("total_trades")
    return scores.filter("score IS NOT NULL AND win_rate IS NOT NULL").rollup("party").agg(
        wins.cast("bigint").alias("wins"), total.alias("total"), _pct(wins, total, 1).alias("win_rate")
    )


def summary_stats(trades: DataFrame, published: DataFrame) -> DataFrame:
    """Scored and total filers, tickers, latest disclosure, collapsed positions, mean drawdown.

    ``trades`` carries price_at_disclosure_date and max_drawdown_disc.  Three one-row aggregates.
    """
    compliant = trades.filter(is_compliant_buy())
    groups = compliant.filter("price_at_disclosure_date IS NOT NULL AND disclosure_date IS NOT NULL").groupBy(
        "filer_id", "ticker", "disclosure_date", "price_at_disclosure_date"
    ).agg(F.avg(F.when((F.col("max_drawdown_disc") > -10) & (F.col("max_drawdown_disc") < 0), F.col("max_drawdown_disc"))).alias("dd"))
    a = published.agg(F.count("score").alias("scored"), F.count("*").alias("total_filers"))
    b = trades.filter("transaction_type = 'buy'").agg(
        F.count_distinct(F.when(F.col("filing_violation") == "compliant", F.col("ticker"))).alias("tickers"),
        F.max("disclosure_date").alias("latest"),
    )
    c = groups.agg(F.count("*").alias("total_buys"), stable_round(F.avg("dd"), 4).alias("avg_dd"))
    return a.join(F.broadcast(b)).join(F.broadcast(c))  # each side is one aggregate row


def table_counts(trades: DataFrame, published: DataFrame, since: Column) -> DataFrame:
    t = trades.agg(
        F.count("*").alias("trades"), F.count_if(is_compliant_buy()).alias("compliant_buys"),
        F.max("disclosure_date").alias("latest"), F.count_if(F.col("disclosure_date") >= since).alias("since"),
    )
    return t.join(F.broadcast(published.agg(F.count("score").alias("scored"))))  # one aggregate row


def flag_rates(df: DataFrame, flag: str) -> DataFrame:
    """Rows, flagged and clean counts overall (NULL filer) and by filer."""
    hit = F.count_if(F.col(flag) == 1)
    return df.rollup("filer_id").agg(
        F.count("*").alias("total"), hit.alias("flagged"), F.count_if(F.col(flag) == 0).alias("clean"),
        _pct(hit, F.count("*"), 4).alias("flagged_pct"),
    )


def freshness(trades: DataFrame, prices: DataFrame) -> DataFrame:
    return trades.agg(F.max("disclosure_date").alias("latest_filing")).join(
        F.broadcast(prices.agg(F.max("date").alias("latest_price")))  # one aggregate row
    )


# -- funnel -----------------------------------------------------------------------------------

# Labels of the funnel's steps.
FUNNEL_STEPS = (
    "All trades", "Buy trades", "Compliant buys", "Priced at disclosure", "Price fetch not failed",
    "asset_type = stock", "Trade date not blank", "Not trade-date basket", "Not disc-date basket",
    "Not repeat within window", "Scored positions (deduped)",
)


def filter_funnel(trades: DataFrame, by_trade: int = 10, by_disclosure: int = 20) -> DataFrame:
    """Survivors of each cumulative filter with the drop from the step before.

    Filters on a row's own columns are counted where the rows are.  Only what survives them goes on, with the columns of the
    later filters, to the baskets, which are written: of a known size, few of them are broadcast.  The last step counts
    distinct position keys among full survivors.
    """
    td = materialize(basket_groups(trades, "trade_date", by_trade, ["stock"]).select("filer_id", "trade_date", F.lit(1).alias("_td")))
    dd = materialize(basket_groups(trades, "disclosure_date", by_disclosure, ["stock"]).select("filer_id", "disclosure_date", F.lit(1).alias("_dd")))
    own = [
        F.lit(True), F.col("transaction_type") == "buy", F.col("filing_violation") == "compliant",
        F.col("price_at_disclosure_date").isNotNull(), fetch_ok(trades), F.col("asset_type") == "stock",
        F.col("trade_date").isNotNull(),
    ]
    joined = [F.col("_td").isNull(), F.col("_dd").isNull(), F.coalesce("repeat_before_close", F.lit(0)) == 0]

    def cumulative(tests: list[Column]) -> list[Column]:
        return [reduce(Column.__and__, [F.coalesce(t, F.lit(False)) for t in tests[:i + 1]]) for i in range(len(tests))]

    n = len(own)
    head = trades.agg(*[F.count_if(p).alias(f"s{i}") for i, p in enumerate(cumulative(own))])
    position = ["filer_id", "ticker", "disclosure_date", "price_at_disclosure_date"]
    rest = (
        trades.filter(cumulative(own)[-1]).select(*position, "trade_date", "repeat_before_close")
        .join(td, ["filer_id", "trade_date"], "left").join(dd, ["filer_id", "disclosure_date"], "left")
    )
    passed = cumulative(joined)
    # Survivors are grouped first so that the distinct count is a plain two-level aggregate.
    grouped = rest.groupBy(F.when(passed[-1], F.struct(*position)).alias("k")).agg(*[F.count_if(p).alias(f"s{n + i}") for i, p in enumerate(passed)])
    tail = grouped.agg(
        *[F.coalesce(F.sum(f"s{n + i}"), F.lit(0)).alias(f"s{n + i}") for i in range(len(joined))], F.count("k").alias(f"s{n + len(joined)}"))
    totals = head.crossJoin(F.broadcast(tail))  # one row each
    steps = F.array(*[F.struct(F.lit(i + 1).alias("step"), F.lit(label).alias("label"), F.col(f"s{i}").alias("survivors"),
                               (F.col(f"s{i - 1}") if i else F.lit(None).cast("bigint")).alias("before")) for i, label in enumerate(FUNNEL_STEPS)])
    drop = F.coalesce(F.col("before") - F.col("survivors"), F.lit(0))
    return totals.select(F.explode(steps).alias("r")).select("r.*").select(
        "step", "label", "survivors", drop.alias("dropped"), _pct(drop, F.col("before"), 1).alias("drop_pct")
    )


def asset_breakdown(trades: DataFrame) -> DataFrame:
    return trades.filter(is_compliant_buy() & F.col("price_at_disclosure_date").isNotNull() & fetch_ok(trades)).groupBy(
        F.coalesce("asset_type", F.lit("NULL")).alias("asset_type")
    ).agg(F.count("*").alias("n"), F.count_distinct("ticker").alias("n_tickers"))


def win_by_year(positions: DataFrame) -> DataFrame:
    """Outcomes per disclosure year of filtered rows; win rate over decided ones."""
    rows = positions.filter("max_drawdown_disc IS NOT NULL").withColumn("o", outcome_from_columns())
    w, l = F.count_if(F.col("o") == "win"), F.count_if(F.col("o") == "loss")
    return rows.groupBy(F.year("disclosure_date").alias("year")).agg(
        F.count("*").alias("total"), w.alias("wins"), l.alias("losses"), F.count_if(F.col("o") == "open").alias("opens"),
        F.coalesce(_pct(w, w + l, 1), F.lit(0.0)).alias("win_rate"),
    )


# -- profiles ---------------------------------------------------------------------------------

def profile_rows(positions: DataFrame) -> DataFrame:
    return positions.filter("asset_type = 'stock' AND coalesce(repeat_before_close, 0) = 0")


def filer_profile(positions: DataFrame) -> DataFrame:
    """Per filer: outcomes, win rate of all, mean drawdown in (-10, 0), large-trade rate, mean exit day."""
    dd, won, large = F.col("max_drawdown_disc"), F.col("outcome") == "win", F.col("size_midpoint") >= 50_000
    return profile_rows(positions).groupBy("filer_id").agg(
        F.count_if(won).alias("wins"), F.count_if(F.col("outcome") == "loss").alias("losses"),
        F.count_if(F.col("outcome") == "open").alias("opens"), _pct(F.count_if(won), F.count("*"), 4).alias("win_rate"),
        stable_round(F.avg(F.when((dd > -10) & (dd < 0), dd)), 4).alias("avg_dd"),
        _pct(F.count_if(won & large), F.count_if(large), 4).alias("large_wr"),
        stable_round(F.avg("days_to_exit_disc"), 4).alias("avg_exit_day"),
    )


def ticker_stats(positions: DataFrame, k: int = 10) -> DataFrame:
    """Top ``k`` tickers of each filer by positions, with the decided win rate (0 without decided)."""
    w, l = F.count_if(F.col("outcome") == "win"), F.count_if(F.col("outcome") == "loss")
    stats = profile_rows(positions).groupBy("filer_id", "ticker").agg(
        F.count("*").alias("trades"), w.alias("wins"), l.alias("losses"),
        F.coalesce(_pct(w, w + l, 4), F.lit(0.0)).alias("win_rate"),
    )
    best = Window.partitionBy("filer_id").orderBy(F.col("trades").desc(), "ticker")
    return stats.withColumn("rn", F.row_number().over(best)).filter(F.col("rn") <= k)


def filer_trades(positions: DataFrame, newest: int | None = 25) -> DataFrame:
    """Per filer: newest positions with stop, target and shown outcome (repeats as SKIP).

    ``row_number() <= k`` lets Spark keep the top k inside each task before the shuffle
    (WindowGroupLimit), so a very active filer sends k rows per task.
    """
    rows = positions.select(
        "filer_id", "trade_id", "ticker", "disclosure_date",
        stable_round(F.col("entry_price") * 0.9, 2).alias("stop"), stable_round(F.col("entry_price") * 1.1, 2).alias("target"),
        F.when(F.coalesce("repeat_before_close", F.lit(0)) == 1, "SKIP").when(F.col("outcome") == "open", "open")
        .otherwise(F.upper("outcome")).alias("shown"),
        "close_date_disc",
    )
    if newest is None:
        return rows
    order = Window.partitionBy("filer_id").orderBy(F.col("disclosure_date").desc(), "trade_id")
    return rows.withColumn("rn", F.row_number().over(order)).filter(F.col("rn") <= newest)


def drawdown_histogram(df: DataFrame, edges: Sequence[float] = (-10, -8, -6, -4, -2, 0), *by: str) -> DataFrame:
    """Counts of drawdowns in [edge, next edge) for drawdowns in (-10, 0)."""
    dd = F.col("max_drawdown_disc")
    bins = list(zip(edges[:-1], edges[1:]))
    which = reduce(lambda acc, b: acc.when((dd >= b[0]) & (dd < b[1]), float(b[0])), bins[1:], F.when((dd >= bins[0][0]) & (dd < bins[0][1]), float(bins[0][0])))
    return df.filter((dd > -10) & (dd < 0)).groupBy(*by, which.alias("bin_from")).agg(F.count("*").alias("n"))


def distribution(df: DataFrame, col: str, k: int) -> DataFrame:
    """Value -> count for the ``k`` smallest values."""
    return df.filter(F.col(col).isNotNull()).groupBy(col).agg(F.count("*").alias("n")).orderBy(col).limit(k)


# -- feed and signals -------------------------------------------------------------------------

def enrich_filer(df: DataFrame, filers: DataFrame) -> DataFrame:
    return df.join(filers, "filer_id")


def feed(trades: DataFrame, published: DataFrame, routine: DataFrame, since: Column) -> DataFrame:
    """Buys disclosed since a date with filer, score and routine-buyer marks, newest first."""
    rows = trades.filter((F.col("transaction_type") == "buy") & F.col("ticker").isNotNull() & (F.col("disclosure_date") >= since))
    return (
        rows.join(published.select("filer_id", "name", "party", "chamber", "score"), "filer_id")
        .join(routine, ["filer_id", "ticker"], "left")
        .orderBy(F.col("disclosure_date").desc(), F.col("score").desc_nulls_last(), "trade_id")
    )


def filter_feed(
    df: DataFrame, *, party: str | None = None, chamber: str | None = None, min_score: float = 0, min_size: int = 0,
) -> DataFrame:
    for col, value in (("party", party), ("chamber", chamber)):
        if value is not None:
            df = df.filter(F.col(col) == value)
    if min_score > 0:
        df = df.filter(F.col("score") >= min_score)
    if min_size > 0:
        df = df.filter(F.col("size_midpoint") >= min_size)
    return df


def feed_stats(trades: DataFrame, published: DataFrame, since: Column, high_score: float = 70) -> DataFrame:
    """Buys and distinct filers in the window, latest buy disclosure, trades by highly scored filers."""
    recent = F.col("disclosure_date") >= since
    return trades.filter("transaction_type = 'buy'").join(published.select("filer_id", "score"), "filer_id", "left").agg(
        F.count_if(recent).alias("total_trades"), F.count_distinct(F.when(recent, F.col("filer_id"))).alias("unique_filers"),
        F.max("disclosure_date").alias("latest"), F.count_if(recent & (F.col("score") >= high_score)).alias("high_score_trades"),
    )


def signal_report(flagged: DataFrame, window_start: Column, window_end: Column) -> DataFrame:
    """Flagged trades: outcomes and decided win rate inside, outside and regardless of an event window."""
    inside = F.coalesce((F.col("trade_date") >= window_start) & (F.col("trade_date") < window_end), F.lit(False))
    w, l = F.count_if(F.col("o") == "win"), F.count_if(F.col("o") == "loss")
    return (
        flagged.filter("signal_flag = 1").withColumn("o", outcome_from_columns())
        .rollup(inside.alias("in_window")).agg(
            F.count("*").alias("flagged"), w.alias("wins"), l.alias("losses"), F.count_if(F.col("o") == "open").alias("opens"),
            F.coalesce(_pct(w, w + l, 4), F.lit(0.0)).alias("win_rate"),
        )
    )


def gap_analysis(df: DataFrame, skip: float = 5.0) -> DataFrame:
    """Decided win rate by day-1 gap from the disclosure close, and whether the gap rule skips it.

    Published result without published code; buckets in percent: < -2, -2..2, 2..5, 5..10, > 10.
    """
    gap = (F.col("day1_open") - F.col("price_at_disclosure_date")) / F.col("price_at_disclosure_date") * 100
    bucket = F.when(gap < -2, "<-2").when(gap <= 2, "-2..2").when(gap <= 5, "2..5").when(gap <= 10, "5..10").otherwise(">10")
    rows = df.filter("outcome IN ('win', 'loss') AND day1_open > 0 AND price_at_disclosure_date > 0")
    return rows.groupBy(bucket.alias("bucket"), (gap > skip).alias("skipped")).agg(
        F.count("*").alias("n"), _pct(F.count_if(F.col("outcome") == "win"), F.count("*"), 4).alias("win_rate")
    )


def equity_curve(labelled: DataFrame, fraction: float = 0.01, stop: float = 10.0, target: float = 10.0) -> DataFrame:
    """Compounded equity by exit date at a fixed fraction per trade, with the running maximum drawdown.

    Published result without published code: every exited trade returns -stop or +target percent on
    ``fraction`` of the equity.  Trades are reduced to one row per day before the running sums.
    """
    ret = F.when(F.col("outcome") == "win", target / 100).when(F.col("outcome") == "loss", -stop / 100)
    days = labelled.filter("outcome IN ('win', 'loss') AND close_date_disc IS NOT NULL").groupBy("close_date_disc").agg(
        F.count("*").alias("n_exits"), F.sum(F.log1p(fraction * ret)).alias("log_ret")
    )
    upto = Window.orderBy("close_date_disc").rowsBetween(Window.unboundedPreceding, 0)  # calendar days only
    return (
        days.withColumn("log_equity", F.sum("log_ret").over(upto))
        .withColumn("peak", F.greatest(F.lit(0.0), F.max("log_equity").over(upto)))
        .withColumn("drawdown", F.exp(F.col("log_equity") - F.col("peak")) - 1)
        .select(
            F.col("close_date_disc").alias("exit_date"), "n_exits", stable_round(F.exp("log_equity"), 6).alias("equity"),
            stable_round(F.min("drawdown").over(upto), 6).alias("max_drawdown"),
        )
    )


# -- operations -------------------------------------------------------------------------------

def run_digest(runs: DataFrame, as_of: Column, days: int = 7) -> DataFrame:
    return runs.filter((F.col("run_at") >= as_of - F.make_dt_interval(F.lit(days))) & (F.col("run_at") <= as_of)).agg(
        F.count("*").alias("runs"), F.count_if(F.coalesce("success", F.lit(0)) == 0).alias("failures"),
        F.coalesce(F.sum("new_trades"), F.lit(0)).alias("new_trades"),
    )


def scrape_alerts(history: DataFrame, order: Sequence[str], zero_runs: int = 5, ceiling: int = 500, by: Sequence[str] = ()) -> DataFrame:
    """Alert per run: count above the ceiling, else ``zero_runs`` runs in a row without new rows.

    ``history`` is the run log (one row per run); ``by`` splits it into independent logs.
    """
    recent = Window.partitionBy(*by).orderBy(*order).rowsBetween(-(zero_runs - 1), 0)
    n, quiet = F.count("*").over(recent), F.sum((F.col("new_trades") == 0).cast("int")).over(recent)
    return history.withColumn(
        "alert",
        F.when(F.col("new_trades") > ceiling, "ceiling").when((n == zero_runs) & (quiet == zero_runs), "zero_streak").otherwise("ok"),
    )


def outcome_cube(rows: DataFrame, dims: Sequence[str] = ("party", "chamber", "year")) -> DataFrame:
    """Trades, wins and distinct filers for every combination of ``dims`` and every subtotal.

    ``level`` is the grouping id: a set bit marks a dimension that was added up, so that a real NULL is told from a total.
    Filers are counted in two levels: one row per group and filer first, which bounds what a group expands to.
    """
    own = rows.groupBy(*dims, "filer_id").agg(F.count("*").alias("n"), F.sum((F.col("outcome") == "win").cast("long")).alias("wins"))
    sets = [[d for k, d in enumerate(dims) if not level >> len(dims) - 1 - k & 1] for level in range(1 << len(dims))]
    spread = own.groupingSets([[F.col(d) for d in s] + [F.col("filer_id")] for s in sets], *[F.col(d) for d in dims], F.col("filer_id")).agg(
        F.grouping_id().alias("level"), F.sum("n").alias("n"), F.sum("wins").alias("wins"))
    return spread.groupBy(F.shiftright("level", 1).alias("level"), *dims).agg(
        F.sum("n").alias("n"), F.sum("wins").alias("wins"), F.count("*").alias("filers"))
