"""Clusters, signals and point-in-time features."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from catalog import base, scoring as scoring_queries
from catalog.base import CTES, with_ctes
from filingscope.functions.rounding import stable_round
from filingscope.operators import clusters, features, flags, prices
from filingscope.plans import reports
from filingscope.session import materialize

EVENT = (datetime.date(1999, 3, 1), datetime.date(1999, 5, 1))
LEDGER_BEFORE = datetime.date(2000, 1, 1)
CLUSTERS, MOVES = [2, 3, 4], [10.0, 15.0]


def pool(s, d, rows=None):
    return flags.qualifying_buys(table(s, d) if rows is None else rows)


def table(s, d):
    """The labelled buys as a written table: most operators below read their input more than once."""
    return base.labelled(s, d)


def measured(s, d):
    """Labelled buys with both cluster counts (compliant priced buys only), moves, basket and signal flags."""
    trades = base.trade_table(s, d)
    rows = base.labelled(s, d)
    # Written, as counts and baskets are: what is shuffled for them has left the disk when the rows are dealt out.
    closes = materialize(prices.asof_closes(rows, base.prices(s, d), "trade_date", out="price_at_trade_date"))
    rows = clusters.with_cluster_count_td(rows, flags.qualifying(rows)).join(closes, ["ticker", "trade_date"], "left")
    rows = flags.with_basket_flag(rows, trades, None, scoring_queries.BASKET_TD, scoring_queries.BASKET_DD)
    return flags.flag_signals(prices.with_pre_disclosure_move(rows))


def ledger(flagged):
    """Signals disclosed before a date count as already notified."""
    return flagged.filter((F.col("signal_flag") == 1) & (F.col("disclosure_date") < F.lit(LEDGER_BEFORE))).select(
        "trade_id", F.lit("2000-01-01 00:00:00").cast("timestamp").alias("notified_at"))


def announce(s, d):
    flagged = materialize(measured(s, d))
    return flags.new_signals(flagged, base.filers(s, d), ledger(flagged))


def fetch_log(s, d):
    """Price fetch attempts derived from events: one symbol per property value, errors are failures."""
    return base.table(s, d, "events").select(
        F.get_json_object("props", "$.k").alias("symbol"), F.col("event_id").alias("attempt_no"),
        F.col("ts").cast("date").alias("attempt_date"), (~F.col("event_type").isin("error", "signup")).alias("ok"))


def run_history(s, d):
    """Daily run log per user derived from events: purchases are new rows."""
    return base.table(s, d, "events").groupBy("user_id", F.col("ts").cast("date").alias("run_date")).agg(
        F.count_if(F.col("event_type") == "purchase").cast("int").alias("new_trades"))


def runs(s, d):
    return base.table(s, d, "events").select(
        F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("run_at"),
        (F.col("event_type") != "error").cast("int").alias("success"), F.floor("value").cast("int").alias("new_trades"))


QUERIES = {
    "cluster_dd": lambda s, d: clusters.cluster_count(pool(s, d)).select("trade_id", "cluster_count"),
    "cluster_td": lambda s, d: clusters.cluster_count_td(pool(s, d)).select("trade_id", "cluster_count_td"),
    "cluster_winrate": lambda s, d: clusters.cluster_winrate(clusters.cluster_count_td(pool(s, d))),
    "value_distribution": lambda s, d: reports.distribution(clusters.cluster_count(pool(s, d)), "cluster_count", 10),
    "signal_flag": lambda s, d: measured(s, d).select("trade_id", "signal_flag"),
    "new_signals": lambda s, d: announce(s, d).select("trade_id", "ticker", "name", "disclosure_date", "cluster_count_td", "abs_pct_move_before_disclosure", "report"),
    "would_follow": lambda s, d: reports.signal_report(measured(s, d), F.lit(EVENT[0]), F.lit(EVENT[1])),
    "threshold_sweep": lambda s, d: clusters.threshold_sweep(measured(s, d), CLUSTERS, MOVES),
    "order_levels": lambda s, d: flags.with_order_levels(base.labelled(s, d)).select("trade_id", "stop_price", "target_price", "limit_price"),
    "execution_filter": lambda s, d: flags.executable(measured(s, d)).select("trade_id", "signal_flag", "basket_day"),
    "gap_buckets": lambda s, d: reports.gap_analysis(base.labelled(s, d), skip=2.0),
    "repeat_features": lambda s, d: features.repeat_features(table(s, d)),
    "pit_recency": lambda s, d: features.pit_recency(base.buys(s, d)),
    "pit_concentration": lambda s, d: features.pit_concentration(base.buys(s, d)),
    "pit_quality": lambda s, d: features.pit_quality(scoring_queries.repeated(s, d)),
    "pit_performance": lambda s, d: features.pit_performance(table(s, d)),
    "pit_performance_exit": lambda s, d: features.pit_performance(table(s, d), resolved="exited", as_of_exit=True),
    "routine_buyer": lambda s, d: features.routine_buyers(base.buys(s, d)),
    "repeat_buckets": lambda s, d: repeat_buckets(s, d),
    "latest_per_filer": lambda s, d: latest(s, d),
    "fail_streak": lambda s, d: features_fail(s, d),
    "zero_streak": lambda s, d: reports.scrape_alerts(run_history(s, d), ["run_date"], ceiling=3, by=["user_id"]).select("user_id", "run_date", "new_trades", "alert"),
    "run_digest": lambda s, d: reports.run_digest(runs(s, d), F.lit("2024-01-20 00:00:00").cast("timestamp")),
    "equity_curve": lambda s, d: reports.equity_curve(base.labelled(s, d)),
}


def repeat_buckets(s, d):
    rows = base.labelled(s, d)
    return features.repeat_analysis(rows.join(features.repeat_features(rows), "trade_id"))


def latest(s, d):
    rows = base.labelled(s, d)
    known = features.pit_performance(rows).filter("pit_win_rate IS NOT NULL")
    scored = scoring_queries.published(s, d).select("filer_id", "name", "win_rate")
    newest = features.latest_per_group(
        rows.join(known, "trade_id"), "filer_id", ["trade_date", "trade_id"], ["trade_id", "trade_date", "pit_win_rate"])
    return newest.join(scored.filter("win_rate IS NOT NULL"), "filer_id")


def features_fail(s, d):
    from filingscope.operators import quality

    return quality.failure_state(fetch_log(s, d))


# ---------------------------------------------------------------------------------------------

CTES["cl_td"] = (
    ("qualifying",),
    """SELECT a.trade_id, count(b.trade_id) AS cluster_count_td FROM qualifying a LEFT JOIN qualifying b ON b.ticker = a.ticker AND b.filer_id <> a.filer_id
         AND b.trade_date BETWEEN a.trade_date - 30 AND a.trade_date + 30 AND b.disclosure_date < a.disclosure_date GROUP BY a.trade_id""",
)
CTES["cl_dd"] = (
    ("qualifying",),
    """SELECT a.trade_id, count(b.trade_id) AS cluster_count FROM qualifying a LEFT JOIN qualifying b ON b.ticker = a.ticker AND b.filer_id <> a.filer_id
         AND b.disclosure_date >= a.disclosure_date - 30 AND b.disclosure_date < a.disclosure_date GROUP BY a.trade_id""",
)
CTES["moves"] = (
    ("priced", "prices"),
    """SELECT trade_id, price_at_trade_date, pct AS pct_move_before_disclosure, round(abs(pct), 4) AS abs_pct_move_before_disclosure,
         CASE WHEN pct IS NULL THEN NULL WHEN pct >= 15 THEN 'strong_gain' WHEN pct >= 0 THEN 'gain' WHEN pct >= -15 THEN 'dip' ELSE 'deep_dip' END AS pct_move_bucket
       FROM (SELECT b.trade_id, p.close AS price_at_trade_date, CASE WHEN p.close > 0 AND b.price_at_disclosure_date > 0 THEN round((b.price_at_disclosure_date - p.close) / p.close * 100, 4) END AS pct
         FROM priced b ASOF LEFT JOIN prices p ON b.ticker = p.symbol AND b.trade_date >= p.date)""",
)
CTES["basket_col"] = (
    ("buys", "basket_td", "basket_dd"),
    """SELECT trade_id, CASE WHEN (filer_id, trade_date) IN (SELECT filer_id, trade_date FROM basket_td)
         OR (filer_id, disclosure_date) IN (SELECT filer_id, disclosure_date FROM basket_dd) THEN 1 ELSE 0 END AS basket_day FROM buys""",
)
CTES["measured"] = (
    ("labelled", "cl_td", "moves", "basket_col"),
    """SELECT l.*, c.cluster_count_td, m.price_at_trade_date, m.pct_move_before_disclosure, m.abs_pct_move_before_disclosure, m.pct_move_bucket, b.basket_day,
         CASE WHEN l.filing_violation = 'compliant' AND l.asset_type = 'stock' AND c.cluster_count_td >= 2 AND m.abs_pct_move_before_disclosure >= 15 THEN 1 ELSE 0 END AS signal_flag
       FROM labelled l LEFT JOIN cl_td c ON c.trade_id = l.trade_id JOIN moves m ON m.trade_id = l.trade_id JOIN basket_col b ON b.trade_id = l.trade_id""",
)
# Rank buys by (trade date, disclosure date, id) for the sequence oracles.
CTES["seq"] = (
    ("labelled",),
    "SELECT *, row_number() OVER (PARTITION BY filer_id, ticker ORDER BY trade_date, disclosure_date, trade_id) AS rn FROM labelled",
)
CTES["repeat_feat"] = (
    ("seq",),
    """SELECT trade_id, CAST(n + 1 AS INT) AS seq_position, CAST(trade_date - last_td AS INT) AS gap_since_prev_buy,
         CASE WHEN n = 0 THEN 0 ELSE CAST(last_close >= disclosure_date AS INT) END AS prev_trade_open, CAST(n AS INT) AS prior_buy_count, med AS prior_median_gap,
         CASE WHEN n >= 3 AND med <= 92 THEN 1 ELSE 0 END AS is_routine_buyer, outcome
       FROM (SELECT a.trade_id, a.trade_date, a.disclosure_date, a.outcome, count(b.rn) AS n, max(b.trade_date) AS last_td,
           arg_max(coalesce(b.close_date_disc, b.disclosure_date + 180), b.rn) AS last_close,
           median(CAST(b.trade_date - b.before AS INT)) AS med
         FROM seq a LEFT JOIN (SELECT *, lag(trade_date) OVER (PARTITION BY filer_id, ticker ORDER BY rn) AS before FROM seq) b
           ON b.filer_id = a.filer_id AND b.ticker = a.ticker AND b.trade_date < a.trade_date GROUP BY a.trade_id, a.trade_date, a.disclosure_date, a.outcome)""",
)
_PRIOR = "a LEFT JOIN {src} b ON b.filer_id = a.filer_id AND b.trade_date < a.trade_date GROUP BY a.trade_id, a.filer_id, a.trade_date"
CTES["perf"] = (
    ("labelled",),
    """SELECT a.trade_id, a.filer_id, a.trade_date, round(100e0 * count(b.trade_id) FILTER (b.drawdown_disc_10pct = 0) / nullif(count(b.trade_id), 0), 4) AS pit_win_rate,
         round(avg(b.max_drawdown_disc), 4) AS pit_avg_dd,
         round(100e0 * count(b.trade_id) FILTER (b.size_midpoint >= 50000 AND b.drawdown_disc_10pct = 0) / nullif(count(b.trade_id) FILTER (b.size_midpoint >= 50000), 0), 4) AS pit_large_trade_wr
       FROM labelled a LEFT JOIN (SELECT * FROM labelled WHERE drawdown_disc_10pct IS NOT NULL) b ON b.filer_id = a.filer_id AND b.trade_date < a.trade_date
       GROUP BY a.trade_id, a.filer_id, a.trade_date""",
)

_SWEEP = " UNION ALL ".join(
    [f"SELECT 'cluster' AS kind, {c} AS cluster_min, CAST(NULL AS DOUBLE) AS move_min" for c in CLUSTERS]
    + [f"SELECT 'move', NULL, {m!r}e0" for m in MOVES] + [f"SELECT 'both', {c}, {m!r}e0" for c in CLUSTERS for m in MOVES])
_OUT = "CASE WHEN max_drawdown_disc <= -10 THEN 'loss' WHEN max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL THEN 'win' ELSE 'open' END"

ORACLES = {
    "cluster_dd": with_ctes("SELECT * FROM cl_dd", "cl_dd"),
    "cluster_td": with_ctes("SELECT * FROM cl_td", "cl_td"),
    "cluster_winrate": with_ctes(
        """SELECT CASE WHEN cluster_count_td >= 3 THEN '3+' ELSE CAST(cluster_count_td AS VARCHAR) END AS bucket, count(*) AS n,
             round(100e0 * count(*) FILTER (drawdown_disc_10pct = 0) / count(*), 1) AS win_rate
           FROM qualifying q JOIN cl_td c ON c.trade_id = q.trade_id WHERE asset_type = 'stock' AND close_date_disc IS NOT NULL GROUP BY 1""", "qualifying", "cl_td"),
    "value_distribution": with_ctes("SELECT cluster_count, count(*) AS n FROM cl_dd GROUP BY 1 ORDER BY 1 LIMIT 10", "cl_dd"),
    "signal_flag": with_ctes("SELECT trade_id, signal_flag FROM measured", "measured"),
    "new_signals": with_ctes(
        f"""SELECT trade_id, ticker, f.name, disclosure_date, cluster_count_td, abs_pct_move_before_disclosure,
             (SELECT CAST(count(*) > 0 AS INT) FROM measured WHERE signal_flag = 1 AND disclosure_date < DATE '{LEDGER_BEFORE}') AS report
           FROM measured m JOIN filers f ON f.filer_id = m.filer_id WHERE signal_flag = 1 AND disclosure_date >= DATE '{LEDGER_BEFORE}'""", "measured", "filers"),
    "would_follow": with_ctes(
        f"""SELECT in_window, count(*) AS flagged, count(*) FILTER (o = 'win') AS wins, count(*) FILTER (o = 'loss') AS losses, count(*) FILTER (o = 'open') AS opens,
             coalesce(round(100e0 * count(*) FILTER (o = 'win') / nullif(count(*) FILTER (o <> 'open'), 0), 4), 0e0) AS win_rate
           FROM (SELECT {_OUT} AS o, trade_date >= DATE '{EVENT[0]}' AND trade_date < DATE '{EVENT[1]}' AS in_window FROM measured WHERE signal_flag = 1) GROUP BY ROLLUP (in_window)""", "measured"),
    "threshold_sweep": with_ctes(
        """SELECT kind, CAST(cluster_min AS INT) AS cluster_min, move_min, count(m.trade_id) AS n, count(m.trade_id) FILTER (outcome = 'win') AS wins,
             round(100e0 * count(m.trade_id) FILTER (outcome = 'win') / nullif(count(m.trade_id), 0), 4) AS win_rate
           FROM g LEFT JOIN (SELECT * FROM measured WHERE outcome <> 'open') m ON (g.cluster_min IS NULL OR m.cluster_count_td >= g.cluster_min)
             AND (g.move_min IS NULL OR m.abs_pct_move_before_disclosure >= g.move_min) GROUP BY ALL""", "measured", extra={"g": _SWEEP}),
    "order_levels": with_ctes(
        "SELECT trade_id, round(entry_price * 0.9e0, 2) AS stop_price, round(entry_price * 1.1e0, 2) AS target_price, round(price_at_disclosure_date * 1.05e0, 4) AS limit_price FROM entries", "entries"),
    "execution_filter": with_ctes(
        "SELECT trade_id, signal_flag, basket_day FROM measured WHERE (signal_flag = 1 OR basket_day = 0) AND (day1_open IS NULL OR day1_open <= price_at_disclosure_date * 1.05e0)", "measured"),
    "gap_buckets": with_ctes(
        """SELECT CASE WHEN g > 10 THEN '>10' WHEN g > 5 THEN '5..10' WHEN g > 2 THEN '2..5' WHEN g >= -2 THEN '-2..2' ELSE '<-2' END AS bucket, g > 2 AS skipped, count(*) AS n,
             round(100e0 * count(*) FILTER (outcome = 'win') / count(*), 4) AS win_rate
           FROM (SELECT outcome, (day1_open - price_at_disclosure_date) / price_at_disclosure_date * 100 AS g FROM labelled WHERE outcome <> 'open' AND day1_open > 0 AND price_at_disclosure_date > 0) GROUP BY 1, 2""", "labelled"),
    "repeat_features": with_ctes("SELECT * EXCLUDE (outcome) FROM repeat_feat", "repeat_feat"),
    "pit_recency": with_ctes(
        """SELECT a.trade_id, CAST(a.trade_date - (SELECT min(x.trade_date) FROM buys x WHERE x.filer_id = a.filer_id) AS INT) AS pol_age_days, CAST(a.trade_date - max(b.trade_date) AS INT) AS days_since_last_buy,
             CAST(count(b.trade_id) FILTER (b.trade_date >= a.trade_date - 90) AS INT) AS trades_last_90d, CAST(count(b.trade_id) FILTER (b.trade_date >= a.trade_date - 365) AS INT) AS trades_last_365d,
             round(count(b.trade_id) / (nullif(a.trade_date - (SELECT min(x.trade_date) FROM buys x WHERE x.filer_id = a.filer_id), 0) / 365.25e0), 4) AS pit_trade_frequency
           FROM buys """ + _PRIOR.format(src="buys"), "buys"),
    "pit_concentration": with_ctes(
        """SELECT t.trade_id, round(100e0 * max(n) / sum(n), 4) AS pit_ticker_conc_pct, round(CAST(sum(n * n) AS DOUBLE) / (sum(n) * sum(n)), 6) AS pit_ticker_hhi
           FROM buys t LEFT JOIN (SELECT a.trade_id, b.ticker, count(*) AS n FROM buys a JOIN buys b ON b.filer_id = a.filer_id AND b.trade_date < a.trade_date GROUP BY ALL) c ON c.trade_id = t.trade_id GROUP BY t.trade_id""", "buys"),
    "pit_quality": with_ctes(
        """SELECT a.trade_id, round(100e0 * sum(b.repeat_before_close) / nullif(count(b.trade_id), 0), 4) AS pit_repeat_rate, round(avg(b.filing_lag_days), 4) AS pit_avg_filing_lag,
             round(100e0 * count(b.trade_id) FILTER (b.filing_lag_days > 30) / nullif(count(b.filing_lag_days), 0), 4) AS pit_late_filing_rate FROM repeated """ + _PRIOR.format(src="repeated"), "repeated"),
    "pit_performance": with_ctes("SELECT trade_id, pit_win_rate, pit_avg_dd, pit_large_trade_wr FROM perf", "perf"),
    "pit_performance_exit": with_ctes(
        """SELECT a.trade_id, round(100e0 * count(b.trade_id) FILTER (b.drawdown_disc_10pct = 0) / nullif(count(b.trade_id), 0), 4) AS pit_win_rate, round(avg(b.max_drawdown_disc), 4) AS pit_avg_dd,
             round(100e0 * count(b.trade_id) FILTER (b.size_midpoint >= 50000 AND b.drawdown_disc_10pct = 0) / nullif(count(b.trade_id) FILTER (b.size_midpoint >= 50000), 0), 4) AS pit_large_trade_wr
           FROM labelled a LEFT JOIN labelled b ON b.filer_id = a.filer_id AND b.close_date_disc < a.trade_date GROUP BY a.trade_id""", "labelled"),
    "routine_buyer": with_ctes(
        """SELECT filer_id, ticker, n AS routine_count, CAST(floor(list_sum(gaps) / (n - 1)) AS INT) AS routine_avg_gap FROM (
             SELECT filer_id, ticker, count(*) AS n, list_sort(list(g) FILTER (g IS NOT NULL)) AS gaps FROM (
               SELECT filer_id, ticker, CAST(trade_date - lag(trade_date) OVER (PARTITION BY filer_id, ticker ORDER BY trade_date, trade_id) AS INT) AS g FROM buys) GROUP BY ALL HAVING count(*) >= 3)
           WHERE gaps[CAST((n - 1) // 2 + 1 AS INT)] <= 92""", "buys"),
    "repeat_buckets": with_ctes(
        """SELECT view, bucket, count(*) AS n, round(100e0 * count(*) FILTER (outcome = 'win') / count(*), 4) AS win_rate FROM (
             SELECT outcome, 'position' AS view, CASE seq_position WHEN 1 THEN '1' WHEN 2 THEN '2' ELSE '3+' END AS bucket FROM repeat_feat
             UNION ALL SELECT outcome, 'predecessor', CASE WHEN prev_trade_open = 1 THEN 'open' ELSE 'closed' END FROM repeat_feat WHERE seq_position > 1
             UNION ALL SELECT outcome, 'gap', CASE WHEN gap_since_prev_buy < 30 THEN '<30' WHEN gap_since_prev_buy < 90 THEN '30-90' WHEN gap_since_prev_buy <= 180 THEN '90-180' ELSE '>180' END FROM repeat_feat WHERE seq_position > 1)
           WHERE outcome <> 'open' GROUP BY ALL""", "repeat_feat"),
    "latest_per_filer": with_ctes(
        """SELECT p.filer_id, p.trade_id, p.trade_date, p.pit_win_rate, x.name, x.win_rate FROM perf p JOIN published x ON x.filer_id = p.filer_id AND x.win_rate IS NOT NULL
           WHERE p.pit_win_rate IS NOT NULL QUALIFY row_number() OVER (PARTITION BY p.filer_id ORDER BY p.trade_date DESC, p.trade_id DESC) = 1""", "perf", "published"),
    "fail_streak": with_ctes(
        """SELECT symbol, CAST(coalesce(sum(CASE WHEN NOT ok AND first_of_day AND attempt_no > last_ok THEN 1 ELSE 0 END), 0) AS BIGINT) AS consecutive_fails, max(attempt_date) AS last_attempt,
             CASE WHEN sum(CASE WHEN NOT ok AND first_of_day AND attempt_no > last_ok THEN 1 ELSE 0 END) >= 3 THEN 1 ELSE 0 END AS permanently_skipped
           FROM (SELECT *, coalesce(max(CASE WHEN ok THEN attempt_no END) OVER (PARTITION BY symbol), -1) AS last_ok,
             row_number() OVER (PARTITION BY symbol, attempt_date ORDER BY attempt_no) = 1 AS first_of_day FROM lg) GROUP BY symbol""",
        extra={"lg": "SELECT json_extract_string(props, '$.k') AS symbol, event_id AS attempt_no, CAST(ts AS DATE) AS attempt_date, event_type NOT IN ('error', 'signup') AS ok FROM events"}),
    "zero_streak": with_ctes(
        """SELECT a.user_id, a.run_date, a.n AS new_trades, CASE WHEN a.n > 3 THEN 'ceiling' WHEN (SELECT count(*) = 5 AND max(x.n) = 0 FROM (
             SELECT b.n FROM r b WHERE b.user_id = a.user_id AND b.run_date <= a.run_date ORDER BY b.run_date DESC LIMIT 5) x) THEN 'zero_streak' ELSE 'ok' END AS alert FROM r a""",
        extra={"r": "SELECT user_id, CAST(ts AS DATE) AS run_date, CAST(count(*) FILTER (event_type = 'purchase') AS INT) AS n FROM events GROUP BY ALL"}),
    "run_digest": """SELECT count(*) AS runs, count(*) FILTER (event_type = 'error') AS failures, CAST(coalesce(sum(CAST(floor(value) AS INT)), 0) AS BIGINT) AS new_trades
        FROM events WHERE ts >= TIMESTAMP '2024-01-13 00:00:00' AND ts <= TIMESTAMP '2024-01-20 00:00:00'""",
    "equity_curve": with_ctes(
        """SELECT exit_date, n_exits, round(equity, 6) AS equity, round(min(equity / peak - 1) OVER (ORDER BY exit_date), 6) AS max_drawdown FROM (
             SELECT *, greatest(1e0, max(equity) OVER (ORDER BY exit_date)) AS peak FROM (
               SELECT exit_date, n_exits, exp(sum(lr) OVER (ORDER BY exit_date)) AS equity FROM (
                 SELECT close_date_disc AS exit_date, count(*) AS n_exits, sum(ln(1 + 0.01e0 * CASE outcome WHEN 'win' THEN 0.1e0 ELSE -0.1e0 END)) AS lr
                 FROM labelled WHERE outcome <> 'open' AND close_date_disc IS NOT NULL GROUP BY 1)))""", "labelled"),
}


def late_oracles() -> dict[str, str]:
    return {}
