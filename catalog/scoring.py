"""Labels, baskets, repeats, scores and the leaderboard."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import CTES, with_ctes
from filingscope.functions.rounding import stable_round
from filingscope.operators import barriers, flags, prices
from filingscope.plans import grid, night, reports, scoring
from filingscope.session import materialize

# Thresholds that populate the basket groups on the test tables (defaults are 10 and 20).
BASKET_TD, BASKET_DD = 5, 3
#: Days of the two queries that show a stated horizon; all others run on whole paths.
HORIZON = 20
PARAMS = scoring.ScoreParams(basket_trade=BASKET_TD, basket_disclosure=BASKET_DD)
PAIRS = [(5.0, 10.0), (10.0, 10.0), (10.0, 20.0), (15.0, 5.0)]


def repeat_run(spark, d):
    """Labelled buys with the repeat flag, computed here and now."""
    return night.with_repeats(base.labelled(spark, d), base.trade_table(spark, d), PARAMS)


def repeated(spark, d):
    """Labelled buys with the repeat flag: labels and repeats are written once for a batch."""
    rows = base.labelled(spark, d)
    return night.join_repeats(rows, base.written(spark, d, "repeats", lambda: night.repeats(rows, base.trade_table(spark, d), PARAMS)))


def scores(spark, d):
    """Scores of all filers: one written table for a batch."""
    return base.written(spark, d, "scores", lambda: scoring.score_by_asset(repeated(spark, d), base.trade_table(spark, d), PARAMS))


def published(spark, d):
    return scoring.publish_scores(base.filers(spark, d), scores(spark, d))


def stock_score(s, d):
    trades = base.trade_table(s, d)
    return scoring.score_filers(scoring.scoreable(repeated(s, d), trades, ["stock"], PARAMS), PARAMS)


def relevant(spark, d, rows=None):
    """Labelled buys with committee relevance (see catalog.committees)."""
    from catalog import committees

    return committees.relevant(spark, d, rows)


def leaders(s, d):
    trades = base.trade_table(s, d)
    rows = base.labelled(s, d)
    return reports.leaderboard(
        published(s, d), scoring.filing_stats(relevant(s, d, rows)), scoring.late_filings(trades), trades)


QUERIES = {
    "scan_tables": lambda s, d: base.trades(s, d).filter("transaction_type = 'buy' AND size_midpoint >= 50000").select(
        "trade_id", "filer_id", "ticker", "disclosure_date", "size_midpoint"),
    "qualifying_buys": lambda s, d: flags.qualifying_buys(base.labelled(s, d), ["stock"]).select("trade_id", "price_at_disclosure_date"),
    "build_paths": lambda s, d: prices.build_paths(base.buys(s, d), base.prices(s, d), "disc").groupBy("trade_id").agg(
        F.max("day").alias("days"), F.max("date").alias("last_date"), stable_round(F.max("close"), 4).alias("top_close"), F.min("pct_change").alias("least_change")),
    "build_paths_horizon": lambda s, d: prices.build_paths(base.buys(s, d), base.prices(s, d), "disc", HORIZON).select(
        "trade_id", "day", "date", stable_round("close", 4).alias("close"), "pct_change"),
    "barrier_horizon": lambda s, d: base.label_run(s, d, HORIZON).select("trade_id", "outcome", "days_to_exit_disc"),
    "barrier_wide": lambda s, d: base.label_run(s, d, stop=30.0, target=30.0).select(
        "trade_id", "outcome", "days_to_exit_disc"),
    "entry_price": lambda s, d: base.labelled(s, d).select("trade_id", stable_round("entry_price", 6).alias("entry_price")),
    "barrier_outcome": lambda s, d: base.label_run(s, d).select("trade_id", "outcome", "days_to_exit_disc", "close_date_disc"),
    "drawdown_metrics": lambda s, d: base.label_run(s, d).select(
        "trade_id", "max_drawdown_disc", "drawdown_disc_5pct", "drawdown_disc_10pct", "drawdown_disc_15pct"),
    "barrier_open_ended": lambda s, d: base.label_run(s, d).select("trade_id", "outcome", "days_to_exit_disc", "max_drawdown_disc"),
    "barrier_dual_anchor": lambda s, d: dual(s, d).select(
        "trade_id", "outcome_trade", "days_to_exit_trade", "max_drawdown_before_profit", "outcome_disc", "days_to_exit_disc", "max_drawdown_disc"),
    "drawdown_summary": lambda s, d: scoring.drawdown_summary(dual(s, d)),
    "barrier_grid": lambda s, d: grid.barrier_grid(base.trade_table(s, d), base.prices(s, d), PAIRS, min_size=20_000),
    "outcome_from_columns": lambda s, d: base.labelled(s, d).select("trade_id", barriers.outcome_from_columns().alias("outcome")),
    "stored_grid_cell": lambda s, d: grid.stored_grid_cell(base.labelled(s, d)),
    "basket_groups": lambda s, d: flags.basket_groups(base.trades(s, d), "trade_date", BASKET_TD).unionByName(
        flags.basket_groups(base.trades(s, d), "disclosure_date", BASKET_DD).withColumnRenamed("disclosure_date", "trade_date")),
    "basket_exclude": lambda s, d: flags.exclude_baskets(
        flags.qualifying_buys(base.labelled(s, d)), base.trades(s, d), None, BASKET_TD, BASKET_DD).select("trade_id"),
    "basket_flag": lambda s, d: flags.with_basket_flag(
        base.labelled(s, d), base.trades(s, d), None, BASKET_TD, BASKET_DD).select("trade_id", "basket_day"),
    "repeat_flag": lambda s, d: repeat_run(s, d).select("trade_id", "repeat_before_close"),
    "flag_rates": lambda s, d: reports.flag_rates(flags.qualifying_buys(repeated(s, d)), "repeat_before_close"),
    "score_dedup": lambda s, d: scoring.collapse_filings(flags.qualifying_buys(base.labelled(s, d))).select(
        "filer_id", "ticker", "disclosure_date", "trade_id", "size_midpoint", stable_round("max_drawdown_disc", 4).alias("max_drawdown_disc"), "outcome"),
    "filer_score": stock_score,
    "score_split": lambda s, d: scores(s, d).select(
        "filer_id", "score", "win_rate", "total_trades", "score_etf", "win_rate_etf", "etf_trade_count"),
    "score_publish": lambda s, d: published(s, d).select("filer_id", "name", "score", "avg_dd", "large_trade_wr", "score_etf"),
    "filing_stats": lambda s, d: scoring.filing_stats(relevant(s, d)),
    "late_filings": lambda s, d: scoring.late_filings(base.trades(s, d)),
    "outcome_totals": lambda s, d: scoring.outcome_totals(
        base.filers(s, d), scores(s, d),
        flags.qualifying_buys(base.labelled(s, d), exclude_repeats=False)),
    "leaderboard": lambda s, d: leaders(s, d),
}


def dual(s, d):
    rows = base.trade_table(s, d).filter("transaction_type = 'buy'")  # read twice: for the anchors and with their labels
    return barriers.label_both_anchors(rows, base.prices(s, d))


# ---------------------------------------------------------------------------------------------

CTES["qualifying"] = (
    ("labelled",),
    """SELECT * FROM labelled WHERE filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL
       AND disclosure_date IS NOT NULL AND trade_date IS NOT NULL""",
)


def _baskets(prefix: str, scope: str) -> None:
    CTES[f"{prefix}_td"] = (("buys",), f"""SELECT filer_id, trade_date FROM buys WHERE filing_violation = 'compliant' {scope}
        GROUP BY filer_id, trade_date HAVING count(DISTINCT ticker) >= {BASKET_TD}""")
    CTES[f"{prefix}_dd"] = (("buys",), f"""SELECT filer_id, disclosure_date FROM buys WHERE filing_violation = 'compliant' {scope}
        GROUP BY filer_id, disclosure_date HAVING count(DISTINCT ticker) >= {BASKET_DD}""")


_baskets("basket", "")
_baskets("stock_basket", "AND asset_type = 'stock'")
_baskets("fund_basket", "AND asset_type IN ('etf', 'fund')")

# The occupancy rule as a recursive walk: each step jumps to the first buy after the current close.
CTES["pool"] = (
    ("qualifying", "basket_td", "basket_dd"),
    """SELECT q.*, coalesce(q.close_date_disc, q.disclosure_date + 180) AS closes,
         row_number() OVER (PARTITION BY q.filer_id, q.ticker ORDER BY q.disclosure_date, q.trade_id) AS rn
       FROM qualifying q WHERE (filer_id, trade_date) NOT IN (SELECT filer_id, trade_date FROM basket_td)
         AND (filer_id, disclosure_date) NOT IN (SELECT filer_id, disclosure_date FROM basket_dd)""",
)
CTES["walk"] = (
    ("pool",),
    """SELECT filer_id, ticker, rn, trade_id, closes, 0 AS flag FROM pool WHERE rn = 1
       UNION ALL
       SELECT p.filer_id, p.ticker, p.rn, p.trade_id, CASE WHEN p.disclosure_date <= w.closes THEN w.closes ELSE p.closes END,
         CASE WHEN p.disclosure_date <= w.closes THEN 1 ELSE 0 END
       FROM walk w JOIN pool p ON p.filer_id = w.filer_id AND p.ticker = w.ticker AND p.rn = w.rn + 1""",
)
CTES["repeated"] = (
    ("labelled", "walk"),
    "SELECT l.*, coalesce(w.flag, 0) AS repeat_before_close FROM labelled l LEFT JOIN walk w ON w.trade_id = l.trade_id",
)


def _positions(name: str, prefix: str, assets: str) -> None:
    CTES[name] = (
        ("repeated", f"{prefix}_td", f"{prefix}_dd"),
        f"""SELECT r.filer_id, r.ticker, r.disclosure_date, min(r.trade_id) AS trade_id, max(r.size_midpoint) AS size_midpoint,
              avg(r.max_drawdown_disc) AS dd, min(r.outcome) AS outcome, bool_and(r.has_path AND r.entry_price > 0) AS usable
            FROM repeated r WHERE r.filing_violation = 'compliant' AND r.price_at_disclosure_date IS NOT NULL AND r.asset_type IN ({assets})
              AND r.repeat_before_close = 0
              AND NOT EXISTS (SELECT 1 FROM {prefix}_td x WHERE x.filer_id = r.filer_id AND x.trade_date = r.trade_date)
              AND NOT EXISTS (SELECT 1 FROM {prefix}_dd x WHERE x.filer_id = r.filer_id AND x.disclosure_date = r.disclosure_date)
            GROUP BY r.filer_id, r.ticker, r.disclosure_date, r.price_at_disclosure_date""",
    )
    rate = lambda r: f"CASE WHEN {r} <= 0.5e0 THEN 0e0 WHEN {r} >= 0.7e0 THEN 100e0 ELSE ({r} - 0.5e0) / (0.7e0 - 0.5e0) * 100 END"
    CTES[f"{name}_counts"] = (
        (name,),
        f"""SELECT filer_id, count(*) AS n, count(*) FILTER (outcome = 'win') AS w, count(*) FILTER (outcome = 'loss') AS l,
              count(*) FILTER (outcome = 'open') AS o, avg(dd) FILTER (dd > -10 AND dd < 0) AS avg_dd,
              count(*) FILTER (size_midpoint >= 50000) AS ln, count(*) FILTER (size_midpoint >= 50000 AND outcome = 'win') AS lw
            FROM {name} WHERE usable GROUP BY filer_id HAVING count(*) >= 5 AND count(*) FILTER (outcome <> 'open') > 0""",
    )
    CTES[f"{name}_score"] = (
        (f"{name}_counts",),
        f"""SELECT filer_id, round(CASE WHEN ln >= 5 THEN ws * 0.5e0 + ds * 0.3e0 + ls * 0.2e0 ELSE ws * 0.7e0 + ds * 0.3e0 END, 2) AS score,
              round(w / n * 100, 2) AS win_rate, round(ws, 2) AS win_rate_score, round(avg_dd, 4) AS avg_drawdown, round(ds, 2) AS drawdown_score,
              CASE WHEN ln >= 5 THEN round(lw / ln * 100, 2) END AS large_win_rate, CASE WHEN ln >= 5 THEN round(ls, 2) END AS large_score,
              n AS total_trades, w AS wins, l AS losses, o AS opens, ln AS large_trade_count, n < 10 AS low_confidence
            FROM (SELECT *, {rate('(w / n)')} AS ws, {rate('(lw / nullif(ln, 0))')} AS ls,
              CASE WHEN avg_dd IS NULL THEN 50e0 ELSE (avg_dd + 10) / 10 * 100 END AS ds FROM {name}_counts)""",
    )


_positions("stock_pos", "stock_basket", "'stock'")
_positions("fund_pos", "fund_basket", "'etf', 'fund'")

CTES["split"] = (
    ("stock_pos_score", "fund_pos_score"),
    """SELECT coalesce(a.filer_id, b.filer_id) AS filer_id, a.score, a.win_rate, a.total_trades, a.avg_drawdown AS avg_dd,
         a.large_win_rate AS large_trade_wr, a.wins, a.losses, a.opens, b.score AS score_etf, b.win_rate AS win_rate_etf, b.total_trades AS etf_trade_count
       FROM stock_pos_score a FULL JOIN fund_pos_score b ON a.filer_id = b.filer_id""",
)
CTES["published"] = (("filers", "split"), "SELECT f.*, s.* EXCLUDE (filer_id) FROM filers f LEFT JOIN split s ON s.filer_id = f.filer_id")
CTES["late"] = (("buys",), "SELECT filer_id, count(*) AS late_filings FROM buys WHERE filing_violation <> 'compliant' GROUP BY filer_id")
CTES["filing"] = (
    ("relevant",),
    """SELECT filer_id, count(*) AS compliant_trades_all, round(avg(lag) FILTER (lag <= 45), 1) AS avg_filing_lag, CAST(sum(al) AS BIGINT) AS comm_aligned FROM (
         SELECT filer_id, max(filing_lag_days) AS lag, max(CASE WHEN committee_relevance IS NOT NULL THEN 1 ELSE 0 END) AS al
         FROM relevant WHERE filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL
         GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date) GROUP BY filer_id""",
)
CTES["leaders"] = (
    ("published", "filing", "late", "buys"),
    """SELECT p.filer_id, p.name, p.party, p.chamber, p.state, p.score, p.win_rate, p.total_trades, p.score_etf, p.win_rate_etf, p.etf_trade_count,
         p.avg_dd, p.large_trade_wr, coalesce(g.compliant_trades_all, 0) AS compliant_trades, g.avg_filing_lag, coalesce(l.late_filings, 0) AS late_filings,
         coalesce(g.comm_aligned, 0) AS comm_aligned, (SELECT max(b.disclosure_date) FROM buys b WHERE b.filer_id = p.filer_id) AS last_trade_date,
         coalesce(round(100e0 * coalesce(g.comm_aligned, 0) / nullif(g.compliant_trades_all, 0), 1), 0e0) AS comm_align_pct
       FROM published p LEFT JOIN filing g ON g.filer_id = p.filer_id LEFT JOIN late l ON l.filer_id = p.filer_id
       WHERE p.score IS NOT NULL OR p.score_etf IS NOT NULL""",
)
CTES["trade_side"] = (
    ("buys", "pidx"),
    """SELECT b.trade_id, b.entry, p.idx - b.start AS day, p.high, p.low
       FROM (SELECT b.*, q.close AS entry, coalesce(q.idx, 0) AS start FROM buys b ASOF LEFT JOIN pidx q ON b.ticker = q.symbol AND b.trade_date >= q.date) b
       JOIN pidx p ON p.symbol = b.ticker AND p.idx > b.start""",
)
CTES["trade_exit"] = (
    ("trade_side",),
    """SELECT trade_id, entry, min(CASE WHEN low <= entry * 0.9e0 THEN day END) AS sd, min(CASE WHEN high >= entry * 1.1e0 THEN day END) AS td
       FROM trade_side GROUP BY trade_id, entry""",
)
CTES["trade_label"] = (
    ("trade_exit", "trade_side"),
    """SELECT x.trade_id, any_value(CASE WHEN x.sd IS NOT NULL AND (x.td IS NULL OR x.sd <= x.td) THEN 'loss' WHEN x.td IS NOT NULL THEN 'win' ELSE 'open' END) AS outcome_trade,
         any_value(least(x.sd, x.td)) AS days_to_exit_trade, any_value(x.entry) AS entry, min((p.low - x.entry) / x.entry * 100) AS dd
       FROM trade_exit x JOIN trade_side p ON p.trade_id = x.trade_id AND p.day <= coalesce(least(x.sd, x.td), 1000000) GROUP BY x.trade_id""",
)
CTES["dual"] = (
    ("labelled", "trade_label"),
    """SELECT l.trade_id, coalesce(t.outcome_trade, 'open') AS outcome_trade, CAST(t.days_to_exit_trade AS INT) AS days_to_exit_trade,
         CASE WHEN t.entry IS NULL THEN NULL WHEN t.outcome_trade = 'loss' THEN -10e0 ELSE round(least(0e0, t.dd), 4) END AS max_drawdown_before_profit,
         CASE WHEN t.entry IS NOT NULL THEN CAST(t.outcome_trade = 'loss' OR t.dd <= -5 AS INT) END AS h5,
         CASE WHEN t.entry IS NOT NULL THEN CAST(t.outcome_trade = 'loss' OR (t.outcome_trade = 'open' AND t.dd <= -10) AS INT) END AS h10,
         l.outcome AS outcome_disc, l.days_to_exit_disc, l.max_drawdown_disc, l.drawdown_disc_5pct, l.drawdown_disc_10pct
       FROM labelled l LEFT JOIN trade_label t ON t.trade_id = l.trade_id""",
)

_GRID = " UNION ALL ".join(f"SELECT {s!r}e0 AS s, {t!r}e0 AS t, {1 - s / 100!r}e0 AS sm, {1 + t / 100!r}e0 AS tm" for s, t in PAIRS)

ORACLES = {
    "scan_tables": with_ctes("SELECT trade_id, filer_id, ticker, disclosure_date, size_midpoint FROM trades WHERE transaction_type = 'buy' AND size_midpoint >= 50000", "trades"),
    "qualifying_buys": with_ctes("SELECT trade_id, price_at_disclosure_date FROM priced WHERE filing_violation = 'compliant' AND asset_type = 'stock' AND price_at_disclosure_date IS NOT NULL", "priced"),
    "build_paths": with_ctes(
        """SELECT p.trade_id, max(p.day) AS days, max(p.date) AS last_date, round(max(p.close), 4) AS top_close,
             min(CASE WHEN b.price_at_disclosure_date > 0 THEN round((p.close - b.price_at_disclosure_date) / b.price_at_disclosure_date * 100, 4) END) AS least_change
           FROM paths p JOIN priced b ON b.trade_id = p.trade_id GROUP BY p.trade_id""", "paths", "priced"),
    "build_paths_horizon": with_ctes(
        f"""SELECT p.trade_id, p.day, p.date, round(p.close, 4) AS close, CASE WHEN b.price_at_disclosure_date > 0 THEN round((p.close - b.price_at_disclosure_date) / b.price_at_disclosure_date * 100, 4) END AS pct_change
           FROM paths p JOIN priced b ON b.trade_id = p.trade_id WHERE p.date <= p.disclosure_date + {HORIZON}""", "paths", "priced"),
    "barrier_horizon": with_ctes(
        f"""SELECT e.trade_id, CASE WHEN sd IS NOT NULL AND (td IS NULL OR sd <= td) THEN 'loss' WHEN td IS NOT NULL THEN 'win' ELSE 'open' END AS outcome, least(sd, td) AS days_to_exit_disc
           FROM entries e LEFT JOIN (SELECT p.trade_id, min(CASE WHEN p.low <= e.entry_price * 0.9e0 THEN p.day END) AS sd, min(CASE WHEN p.high >= e.entry_price * 1.1e0 THEN p.day END) AS td
             FROM paths p JOIN entries e ON e.trade_id = p.trade_id WHERE e.entry_price > 0 AND p.date <= p.disclosure_date + {HORIZON} GROUP BY p.trade_id) x ON x.trade_id = e.trade_id""", "entries", "paths"),
    "barrier_wide": with_ctes(
        """SELECT e.trade_id, CASE WHEN sd IS NOT NULL AND (td IS NULL OR sd <= td) THEN 'loss' WHEN td IS NOT NULL THEN 'win' ELSE 'open' END AS outcome, least(sd, td) AS days_to_exit_disc
           FROM entries e LEFT JOIN (SELECT p.trade_id, min(CASE WHEN p.low <= e.entry_price * 0.7e0 THEN p.day END) AS sd, min(CASE WHEN p.high >= e.entry_price * 1.3e0 THEN p.day END) AS td
             FROM paths p JOIN entries e ON e.trade_id = p.trade_id WHERE e.entry_price > 0 GROUP BY p.trade_id) x ON x.trade_id = e.trade_id""", "entries", "paths"),
    "entry_price": with_ctes("SELECT trade_id, round(entry_price, 6) AS entry_price FROM entries", "entries"),
    "barrier_outcome": with_ctes("SELECT trade_id, outcome, days_to_exit_disc, close_date_disc FROM labelled", "labelled"),
    "drawdown_metrics": with_ctes("SELECT trade_id, max_drawdown_disc, drawdown_disc_5pct, drawdown_disc_10pct, drawdown_disc_15pct FROM labelled", "labelled"),
    "barrier_open_ended": with_ctes("SELECT trade_id, outcome, days_to_exit_disc, max_drawdown_disc FROM labelled", "labelled"),
    "barrier_dual_anchor": with_ctes("SELECT trade_id, outcome_trade, days_to_exit_trade, max_drawdown_before_profit, outcome_disc, days_to_exit_disc, max_drawdown_disc FROM dual", "dual"),
    "drawdown_summary": with_ctes(
        """SELECT round(avg(max_drawdown_before_profit) FILTER (max_drawdown_before_profit < 0 AND max_drawdown_before_profit > -10), 2) AS avg_dd_trade,
             round(avg(max_drawdown_disc) FILTER (max_drawdown_disc < 0 AND max_drawdown_disc > -10), 2) AS avg_dd_disc,
             CAST(sum(h5) AS BIGINT) AS hit5_trade, CAST(sum(drawdown_disc_5pct) AS BIGINT) AS hit5_disc,
             CAST(sum(h10) AS BIGINT) AS hit10_trade, CAST(sum(drawdown_disc_10pct) AS BIGINT) AS hit10_disc
           FROM dual WHERE max_drawdown_before_profit IS NOT NULL""", "dual"),
    "barrier_grid": with_ctes(
        """SELECT filer_id, s AS stop_pct, t AS target_pct, count(*) AS combo_trades, count(*) FILTER (o = 'win') AS combo_wins, count(*) FILTER (o = 'loss') AS combo_losses,
             round(CASE WHEN count(*) FILTER (o <> 'open') > 0 THEN 100e0 * count(*) FILTER (o = 'win') / count(*) FILTER (o <> 'open') END, 1) AS combo_wr,
             round(avg(dd) FILTER (o = 'win' AND dd < 0), 2) AS combo_dd
           FROM res GROUP BY filer_id, s, t""",
        "entries", "paths", extra={
            "g": _GRID,
            "pos": """SELECT filer_id, min(trade_id) AS trade_id, any_value(entry_price) AS entry_price FROM entries
                WHERE filing_violation = 'compliant' AND price_at_disclosure_date > 0 GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date HAVING max(size_midpoint) >= 20000""",
            "hit": """SELECT pos.filer_id, pos.trade_id, pos.entry_price, g.s, g.t, min(CASE WHEN p.low <= pos.entry_price * g.sm THEN p.day END) AS sd,
                min(CASE WHEN p.high >= pos.entry_price * g.tm THEN p.day END) AS td FROM pos CROSS JOIN g LEFT JOIN paths p ON p.trade_id = pos.trade_id GROUP BY ALL""",
            "res": """SELECT h.*, CASE WHEN sd IS NOT NULL AND (td IS NULL OR sd <= td) THEN 'loss' WHEN td IS NOT NULL THEN 'win' ELSE 'open' END AS o,
                (SELECT least(0e0, min((p.low - h.entry_price) / h.entry_price * 100)) FROM paths p WHERE p.trade_id = h.trade_id AND p.day <= h.td) AS dd FROM hit h""",
        }),
    "outcome_from_columns": with_ctes(
        "SELECT trade_id, CASE WHEN max_drawdown_disc <= -10 THEN 'loss' WHEN max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL THEN 'win' ELSE 'open' END AS outcome FROM labelled", "labelled"),
    "stored_grid_cell": with_ctes(
        """SELECT t.filer_id, count(*) AS combo_trades, count(*) FILTER (max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL) AS combo_wins,
             count(*) FILTER (max_drawdown_disc <= -10) AS combo_losses,
             round(100e0 * count(*) FILTER (max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL) / nullif(count(*) FILTER (max_drawdown_disc <= -10 OR days_to_exit_disc IS NOT NULL), 0), 1) AS combo_wr,
             round(avg(max_drawdown_disc) FILTER (max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL AND max_drawdown_disc < 0), 2) AS combo_dd
           FROM labelled t WHERE trade_id IN (SELECT min(trade_id) FROM labelled WHERE filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL AND max_drawdown_disc IS NOT NULL
             GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date) GROUP BY t.filer_id""", "labelled"),
    "basket_groups": with_ctes(
        f"""SELECT filer_id, trade_date, count(DISTINCT ticker) AS n_tickers FROM buys WHERE filing_violation = 'compliant' GROUP BY ALL HAVING count(DISTINCT ticker) >= {BASKET_TD}
           UNION ALL SELECT filer_id, disclosure_date, count(DISTINCT ticker) FROM buys WHERE filing_violation = 'compliant' GROUP BY ALL HAVING count(DISTINCT ticker) >= {BASKET_DD}""", "buys"),
    "basket_exclude": with_ctes("SELECT trade_id FROM pool", "pool"),
    "basket_flag": with_ctes(
        """SELECT trade_id, CASE WHEN (filer_id, trade_date) IN (SELECT filer_id, trade_date FROM basket_td) OR (filer_id, disclosure_date) IN (SELECT filer_id, disclosure_date FROM basket_dd)
           THEN 1 ELSE 0 END AS basket_day FROM buys""", "basket_td", "basket_dd"),
    "repeat_flag": with_ctes("SELECT trade_id, repeat_before_close FROM repeated", "repeated"),
    "flag_rates": with_ctes(
        """SELECT filer_id, count(*) AS total, CAST(sum(repeat_before_close) AS BIGINT) AS flagged, CAST(sum(1 - repeat_before_close) AS BIGINT) AS clean,
             round(100e0 * sum(repeat_before_close) / count(*), 4) AS flagged_pct FROM repeated WHERE filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL
           GROUP BY ROLLUP (filer_id)""", "repeated"),
    "score_dedup": with_ctes(
        """SELECT filer_id, ticker, disclosure_date, min(trade_id) AS trade_id, max(size_midpoint) AS size_midpoint, round(avg(max_drawdown_disc), 4) AS max_drawdown_disc, min(outcome) AS outcome
           FROM qualifying GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date""", "qualifying"),
    "filer_score": with_ctes("SELECT * FROM stock_pos_score", "stock_pos_score"),
    "score_split": with_ctes("SELECT filer_id, score, win_rate, total_trades, score_etf, win_rate_etf, etf_trade_count FROM split", "split"),
    "score_publish": with_ctes("SELECT filer_id, name, score, avg_dd, large_trade_wr, score_etf FROM published", "published"),
    "late_filings": with_ctes("SELECT * FROM late", "late"),
    "outcome_totals": with_ctes(
        """SELECT count(score) AS stock_scored, count(score_etf) AS etf_scored,
             count(*) FILTER (score IS NULL AND score_etf IS NULL AND filer_id IN (SELECT filer_id FROM qualifying)) AS below_min,
             count(*) FILTER (score IS NULL AND score_etf IS NULL AND filer_id NOT IN (SELECT filer_id FROM qualifying)) AS no_trades,
             CAST(sum(wins) AS BIGINT) AS wins, CAST(sum(losses) AS BIGINT) AS losses, CAST(sum(opens) AS BIGINT) AS opens,
             round(100e0 * sum(wins) / (sum(wins) + sum(losses) + sum(opens)), 1) AS win_rate_all,
             round(100e0 * sum(wins) / (sum(wins) + sum(losses)), 1) AS win_rate_decided FROM published""", "published", "qualifying"),
}


def late_oracles() -> dict[str, str]:
    """Oracles that read CTEs of other catalog modules."""
    return {
        "filing_stats": with_ctes("SELECT * FROM filing", "filing"),
        "leaderboard": with_ctes("SELECT * FROM leaders", "leaders"),
    }
