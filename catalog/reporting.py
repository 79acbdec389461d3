"""Leaderboard views, funnel, profiles and feed."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from catalog import base, scoring as scoring_queries
from catalog.base import CTES, with_ctes
from catalog.scoring import BASKET_DD, BASKET_TD
from filingscope.functions.rounding import stable_round
from filingscope.operators import barriers, features, flags, quality
from filingscope.plans import grid, reports, scoring
from filingscope.session import materialize, shared_folder

SINCE = datetime.date(2001, 3, 1)


def positions(s, d):
    """Collapsed positions with asset class and repeat flag after basket exclusion (all assets)."""
    trades = base.trade_table(s, d)
    rows = flags.exclude_baskets(
        flags.qualifying_buys(scoring_queries.repeated(s, d)), trades, None, BASKET_TD, BASKET_DD)
    return scoring.collapse_filings(rows, "asset_type", "repeat_before_close")


def all_repeated(s, d):
    """Every trade; buys carry price, label and repeat columns."""
    return flags.with_buy_columns(
        base.trade_table(s, d), scoring_queries.repeated(s, d),
        ["price_at_disclosure_date", "max_drawdown_disc", "days_to_exit_disc", "repeat_before_close"])


def filtered(s, d):
    trades = base.trade_table(s, d)
    rows = flags.qualifying_buys(scoring_queries.repeated(s, d), ["stock"], exclude_repeats=True)
    return flags.exclude_baskets(rows, trades, ["stock"], BASKET_TD, BASKET_DD)


def feed(s, d):
    rows = base.labelled(s, d)
    return reports.feed(rows, scoring_queries.published(s, d), features.routine_buyers(rows), F.lit(SINCE))


def regridded(s, d):
    cell = grid.barrier_grid(base.trade_table(s, d), base.prices(s, d), [(15.0, 5.0)], min_size=40_000)
    return materialize(reports.regrid(scoring_queries.leaders(s, d), cell))


def exported(s, d):
    """Round trip: the export is read back from the files it wrote."""
    path = f"{shared_folder(s).rstrip('/')}/filingscope/leaderboard-{__import__('uuid').uuid4().hex}"
    reports.export_leaderboard(scoring_queries.leaders(s, d), path)
    return s.read.option("header", True).csv(path)


QUERIES = {
    "join_filer": lambda s, d: reports.enrich_filer(base.trades(s, d), base.filers(s, d)).select("trade_id", "name", "party", "chamber", "state"),
    "leaderboard_filter": lambda s, d: reports.filter_leaderboard(
        scoring_queries.leaders(s, d), party="BUILDING", min_trades=8, since=F.lit(datetime.date(2000, 6, 1)), aligned_only=True, max_lag=25.0).select("filer_id", "score"),
    "leaderboard_regrid": lambda s, d: regridded(s, d).select("filer_id", "win_rate", "avg_dd", "compliant_trades", "combo_wr"),
    "regrid_party": lambda s, d: reports.regrid_party(regridded(s, d)),
    "export_csv": lambda s, d: exported(s, d).select("Politician", "Party", F.col("`Win%`").cast("double").alias("Win%"), F.col("`Comp Buys`").cast("bigint").alias("Comp Buys")),
    "feed": lambda s, d: feed(s, d).select("trade_id", "name", "disclosure_date", "score", "routine_count", "routine_avg_gap"),
    "feed_filter": lambda s, d: reports.filter_feed(feed(s, d), party="MACHINERY", min_score=5, min_size=20_000).select("trade_id", "score", "size_midpoint"),
    "feed_stats": lambda s, d: reports.feed_stats(base.trades(s, d), scoring_queries.published(s, d), F.lit(SINCE), 30),
    "funnel": lambda s, d: reports.filter_funnel(materialize(all_repeated(s, d).drop(
        "trade_id", "filing_lag_days", "size_midpoint", "industry", "sector", "max_drawdown_disc", "days_to_exit_disc")), BASKET_TD, BASKET_DD),
    "asset_breakdown": lambda s, d: reports.asset_breakdown(base.labelled(s, d)),
    "win_by_year": lambda s, d: reports.win_by_year(filtered(s, d)),
    "filer_profile": lambda s, d: reports.filer_profile(positions(s, d)),
    "ticker_stats": lambda s, d: reports.ticker_stats(positions(s, d)),
    "filer_trades": lambda s, d: reports.filer_trades(positions(s, d), 25),
    "drawdown_hist": lambda s, d: reports.drawdown_histogram(reports.profile_rows(positions(s, d))),
    "party_winrate": lambda s, d: reports.weighted_win_rate(scoring_queries.published(s, d)),
    "summary_stats": lambda s, d: summary(s, d),
    "table_counts": lambda s, d: reports.table_counts(base.trades(s, d), scoring_queries.published(s, d), F.lit(SINCE)),
    "rank_neighbours": lambda s, d: reports.rank_filers(scoring_queries.published(s, d).filter("score IS NOT NULL")),
    "topk_report": lambda s, d: topk(s, d),
    "feature_coverage": lambda s, d: quality.coverage(base.labelled(s, d), ["price_at_disclosure_date", "days_to_exit_disc", "close_date_disc", "max_drawdown_disc"]),
    "qa_gates": lambda s, d: gates(s, d),
    "spot_check": lambda s, d: quality.spot_check(base.trades(s, d)).select("trade_id", "filer_id", "ticker", "trade_date"),
}


def summary(s, d):
    rows = base.labelled(s, d)
    return reports.summary_stats(rows, scoring_queries.published(s, d))


def topk(s, d):
    """Four top-k reports in one frame: scores, repeat-flagged filers, committee flags, latest signals' stand-in."""
    from catalog import committees

    rows = scoring_queries.repeated(s, d)
    names = base.filers(s, d).select("filer_id", "name")
    best = reports.top_k(
        scoring_queries.published(s, d).filter("score IS NOT NULL"), [F.col("score").desc(), F.col("filer_id")], 30
    ).select(F.lit("scores").alias("report"), F.col("filer_id").alias("key"), F.col("score").alias("value"))
    flagged = reports.top_k(
        rows.filter("repeat_before_close = 1 AND filing_violation = 'compliant' AND asset_type = 'stock'").join(names, "filer_id")
        .groupBy("name").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("name")], 15
    ).select(F.lit("repeats").alias("report"), F.col("name").alias("key"), F.col("n").cast("double").alias("value"))
    marked = materialize(committees.relevant(s, d, rows).filter("committee_relevance IS NOT NULL"))
    by_committee = reports.top_k(
        marked.groupBy("committee_relevance").agg(F.count("*").alias("n")), [F.col("n").desc(), F.col("committee_relevance")], 10
    ).select(F.lit("committees").alias("report"), F.col("committee_relevance").alias("key"), F.col("n").cast("double").alias("value"))
    latest = reports.top_k(marked, [F.col("disclosure_date").desc(), F.col("trade_id")], 10).select(
        F.lit("latest").alias("report"), F.col("trade_id").alias("key"), F.col("size_midpoint").cast("double").alias("value"))
    return best.unionByName(flagged).unionByName(by_committee).unionByName(latest)


def gates(s, d):
    buys = base.labelled(s, d).select("trade_id", "price_at_disclosure_date", "max_drawdown_disc", "has_path")
    rows = materialize(base.trades(s, d).join(buys, "trade_id", "left").withColumn("price_fetch_failed", F.when(F.col("price_at_disclosure_date").isNull() & (F.col("transaction_type") == "buy"), 1).otherwise(0)))
    paths = rows.filter("has_path AND filing_violation = 'compliant'").select("trade_id")
    return quality.staging_gates(rows.drop("has_path"), base.filers(s, d), paths, F.lit(datetime.date(2001, 9, 1)))


# ---------------------------------------------------------------------------------------------

CTES["positions"] = (
    ("repeated", "basket_td", "basket_dd"),
    """SELECT filer_id, ticker, disclosure_date, asset_type, repeat_before_close, min(trade_id) AS trade_id, max(size_midpoint) AS size_midpoint, avg(max_drawdown_disc) AS dd,
         min(outcome) AS outcome, min(entry_price) AS entry_price, min(days_to_exit_disc) AS exit_day, min(close_date_disc) AS close_date_disc
       FROM repeated r WHERE filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL
         AND NOT EXISTS (SELECT 1 FROM basket_td x WHERE x.filer_id = r.filer_id AND x.trade_date = r.trade_date)
         AND NOT EXISTS (SELECT 1 FROM basket_dd x WHERE x.filer_id = r.filer_id AND x.disclosure_date = r.disclosure_date)
       GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date, asset_type, repeat_before_close""",
)
CTES["shown"] = (("positions",), "SELECT * FROM positions WHERE asset_type = 'stock' AND repeat_before_close = 0")
CTES["routine"] = (
    ("buys",),
    """SELECT filer_id, ticker, n AS routine_count, CAST(floor(list_sum(gaps) / (n - 1)) AS INT) AS routine_avg_gap FROM (
         SELECT filer_id, ticker, count(*) AS n, list_sort(list(g) FILTER (g IS NOT NULL)) AS gaps FROM (
           SELECT filer_id, ticker, CAST(trade_date - lag(trade_date) OVER (PARTITION BY filer_id, ticker ORDER BY trade_date, trade_id) AS INT) AS g FROM buys) GROUP BY ALL HAVING count(*) >= 3)
       WHERE gaps[CAST((n - 1) // 2 + 1 AS INT)] <= 92""",
)
CTES["feed"] = (
    ("buys", "published", "routine"),
    f"""SELECT b.*, p.name, p.party, p.score, r.routine_count, r.routine_avg_gap FROM buys b JOIN published p ON p.filer_id = b.filer_id
        LEFT JOIN routine r ON r.filer_id = b.filer_id AND r.ticker = b.ticker WHERE b.disclosure_date >= DATE '{SINCE}'""",
)
CTES["cell"] = (
    ("entries", "paths"),
    """SELECT filer_id, count(*) AS n, count(*) FILTER (o = 'win') AS w, count(*) FILTER (o = 'loss') AS l,
         round(100e0 * count(*) FILTER (o = 'win') / nullif(count(*) FILTER (o <> 'open'), 0), 1) AS wr, round(avg(dd) FILTER (o = 'win' AND dd < 0), 2) AS dd
       FROM (SELECT h.*, CASE WHEN sd IS NOT NULL AND (td IS NULL OR sd <= td) THEN 'loss' WHEN td IS NOT NULL THEN 'win' ELSE 'open' END AS o,
           (SELECT least(0e0, min((p.low - h.e) / h.e * 100)) FROM paths p WHERE p.trade_id = h.trade_id AND p.day <= h.td) AS dd
         FROM (SELECT x.filer_id, x.trade_id, x.e, min(CASE WHEN p.low <= x.e * 0.85e0 THEN p.day END) AS sd, min(CASE WHEN p.high >= x.e * 1.05e0 THEN p.day END) AS td
           FROM (SELECT filer_id, min(trade_id) AS trade_id, any_value(entry_price) AS e FROM entries WHERE filing_violation = 'compliant' AND price_at_disclosure_date > 0
             GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date HAVING max(size_midpoint) >= 40000) x LEFT JOIN paths p ON p.trade_id = x.trade_id GROUP BY ALL) h)
       GROUP BY filer_id""",
)
CTES["regridded"] = (
    ("leaders", "cell"),
    """SELECT p.filer_id, p.party, coalesce(c.wr, p.win_rate) AS win_rate, coalesce(c.dd, p.avg_dd) AS avg_dd, coalesce(c.n, p.compliant_trades) AS compliant_trades, c.wr AS combo_wr, c.w, c.l
       FROM leaders p LEFT JOIN cell c ON c.filer_id = p.filer_id""",
)
_STEPS = [
    "TRUE", "transaction_type = 'buy'", "filing_violation = 'compliant'", "price_at_disclosure_date IS NOT NULL", "TRUE", "asset_type = 'stock'", "trade_date IS NOT NULL",
    "NOT EXISTS (SELECT 1 FROM stock_basket_td x WHERE x.filer_id = t.filer_id AND x.trade_date = t.trade_date)",
    "NOT EXISTS (SELECT 1 FROM stock_basket_dd x WHERE x.filer_id = t.filer_id AND x.disclosure_date = t.disclosure_date)",
    "coalesce(repeat_before_close, 0) = 0",
]
CTES["all_repeated"] = (
    ("trades", "repeated"),
    "SELECT t.*, r.price_at_disclosure_date, r.max_drawdown_disc, r.days_to_exit_disc, r.has_path, r.repeat_before_close FROM trades t LEFT JOIN repeated r ON r.trade_id = t.trade_id",
)


def _funnel() -> str:
    parts = [
        f"SELECT {i + 1} AS step, '{label}' AS label, (SELECT count(*) FROM all_repeated t WHERE {' AND '.join(_STEPS[:i + 1])}) AS survivors"
        for i, label in enumerate(reports.FUNNEL_STEPS[:-1])
    ]
    parts.append(
        f"""SELECT {len(_STEPS) + 1}, '{reports.FUNNEL_STEPS[-1]}', (SELECT count(*) FROM (SELECT DISTINCT filer_id, ticker, disclosure_date, price_at_disclosure_date
            FROM all_repeated t WHERE {' AND '.join(_STEPS)}))""")
    return "SELECT *, coalesce(b - survivors, 0) AS dropped, round(100e0 * (b - survivors) / b, 1) AS drop_pct FROM (SELECT *, lag(survivors) OVER (ORDER BY step) AS b FROM (" + " UNION ALL ".join(parts) + "))"


_GATES = [
    ("total trades", "count(*)", ">", 1000, 0), ("buy trades", "count(*) FILTER (transaction_type = 'buy')", ">", 500, 0), ("filers with trades", "count(DISTINCT filer_id)", ">", 50, 0),
    ("future disclosure dates", "count(*) FILTER (disclosure_date > DATE '2001-09-01')", "=", 0, 0), ("blank disclosure dates", "count(*) FILTER (disclosure_date IS NULL)", "=", 0, 0),
    ("error class pct", "round(100e0 * count(*) FILTER (asset_type = 'error') / count(*), 4)", "<", 5, 0),
    ("priced pct", "round(100e0 * count(*) FILTER (c AND price_at_disclosure_date IS NOT NULL) / count(*) FILTER (c), 4)", ">=", 85, 0),
    ("fetch failed pct", "round(100e0 * count(*) FILTER (transaction_type = 'buy' AND price_at_disclosure_date IS NULL) / count(*) FILTER (c), 4)", "<", 15, 0),
    ("path pct", "round(100e0 * count(*) FILTER (c AND has_path) / count(*) FILTER (c), 4)", ">=", 85, 1),
    ("resolved pct", "round(100e0 * count(*) FILTER (c AND max_drawdown_disc IS NOT NULL) / count(*) FILTER (c), 4)", ">=", 85, 1),
    ("NULL violation", "count(*) FILTER (filing_violation IS NULL)", "=", 0, 1), ("NULL class", "count(*) FILTER (asset_type IS NULL)", "=", 0, 1),
]
_GATE_SQL = " UNION ALL ".join(
    f"SELECT '{m}' AS metric, CAST(v AS DOUBLE) AS value, '{op}' AS op, CAST({th} AS DOUBLE) AS threshold, {b} AS blocker, CAST(v {op} {th} AS INT) AS passed FROM (SELECT {e} AS v FROM g)"
    for m, e, op, th, b in _GATES)

ORACLES = {
    "spot_check": with_ctes("SELECT trade_id, filer_id, ticker, trade_date FROM buys ORDER BY md5(trade_id || '/7'), trade_id LIMIT 10", "buys"),
    "join_filer": with_ctes("SELECT trade_id, name, party, chamber, state FROM trades t JOIN filers f ON f.filer_id = t.filer_id", "trades", "filers"),
    "feed": with_ctes("SELECT trade_id, name, disclosure_date, score, routine_count, routine_avg_gap FROM feed", "feed"),
    "feed_filter": with_ctes("SELECT trade_id, score, size_midpoint FROM feed WHERE party = 'MACHINERY' AND score >= 5 AND size_midpoint >= 20000", "feed"),
    "feed_stats": with_ctes(
        f"""SELECT (SELECT count(*) FROM buys WHERE disclosure_date >= DATE '{SINCE}') AS total_trades, (SELECT count(DISTINCT filer_id) FROM buys WHERE disclosure_date >= DATE '{SINCE}') AS unique_filers,
             (SELECT max(disclosure_date) FROM buys) AS latest, (SELECT count(*) FROM feed WHERE score >= 30) AS high_score_trades""", "feed", "buys"),
    "funnel": with_ctes(_funnel().replace("*, coalesce", "step, label, survivors, coalesce"), "all_repeated", "stock_basket_td", "stock_basket_dd"),
    "asset_breakdown": with_ctes("SELECT asset_type, count(*) AS n, count(DISTINCT ticker) AS n_tickers FROM priced WHERE filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL GROUP BY 1", "priced"),
    "win_by_year": with_ctes(
        """SELECT CAST(year(disclosure_date) AS INT) AS year, count(*) AS total, count(*) FILTER (max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL) AS wins, count(*) FILTER (max_drawdown_disc <= -10) AS losses,
             count(*) FILTER (max_drawdown_disc > -10 AND days_to_exit_disc IS NULL) AS opens,
             coalesce(round(100e0 * count(*) FILTER (max_drawdown_disc > -10 AND days_to_exit_disc IS NOT NULL) / nullif(count(*) FILTER (max_drawdown_disc <= -10 OR days_to_exit_disc IS NOT NULL), 0), 1), 0e0) AS win_rate
           FROM all_repeated t WHERE max_drawdown_disc IS NOT NULL AND """ + " AND ".join(_STEPS) + " GROUP BY 1", "all_repeated", "stock_basket_td", "stock_basket_dd"),
    "filer_profile": with_ctes(
        """SELECT filer_id, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses, count(*) FILTER (outcome = 'open') AS opens,
             round(100e0 * count(*) FILTER (outcome = 'win') / count(*), 4) AS win_rate, round(avg(dd) FILTER (dd > -10 AND dd < 0), 4) AS avg_dd,
             round(100e0 * count(*) FILTER (outcome = 'win' AND size_midpoint >= 50000) / nullif(count(*) FILTER (size_midpoint >= 50000), 0), 4) AS large_wr, round(avg(exit_day), 4) AS avg_exit_day
           FROM shown GROUP BY filer_id""", "shown"),
    "ticker_stats": with_ctes(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY filer_id ORDER BY trades DESC, ticker) AS rn FROM (
             SELECT filer_id, ticker, count(*) AS trades, count(*) FILTER (outcome = 'win') AS wins, count(*) FILTER (outcome = 'loss') AS losses,
               coalesce(round(100e0 * count(*) FILTER (outcome = 'win') / nullif(count(*) FILTER (outcome <> 'open'), 0), 4), 0e0) AS win_rate FROM shown GROUP BY ALL)) WHERE rn <= 10""", "shown"),
    "filer_trades": with_ctes(
        """SELECT * FROM (SELECT filer_id, trade_id, ticker, disclosure_date, round(entry_price * 0.9e0, 2) AS stop, round(entry_price * 1.1e0, 2) AS target,
             CASE WHEN repeat_before_close = 1 THEN 'SKIP' WHEN outcome = 'open' THEN 'open' ELSE upper(outcome) END AS shown, close_date_disc,
             row_number() OVER (PARTITION BY filer_id ORDER BY disclosure_date DESC, trade_id) AS rn FROM positions) WHERE rn <= 25""", "positions"),
    "drawdown_hist": with_ctes("SELECT floor(dd / 2) * 2 AS bin_from, count(*) AS n FROM shown WHERE dd > -10 AND dd < 0 GROUP BY 1", "shown"),
    "party_winrate": with_ctes(
        """SELECT party, CAST(sum(w) AS BIGINT) AS wins, CAST(sum(total_trades) AS BIGINT) AS total, round(100e0 * sum(w) / sum(total_trades), 1) AS win_rate
           FROM (SELECT *, round(win_rate / 100 * total_trades, 0) AS w FROM published WHERE score IS NOT NULL AND win_rate IS NOT NULL) GROUP BY ROLLUP (party)""", "published"),
    "summary_stats": with_ctes(
        """SELECT (SELECT count(score) FROM published) AS scored, (SELECT count(*) FROM published) AS total_filers, (SELECT count(DISTINCT ticker) FROM buys WHERE filing_violation = 'compliant') AS tickers,
             (SELECT max(disclosure_date) FROM buys) AS latest, (SELECT count(*) FROM (SELECT DISTINCT filer_id, ticker, disclosure_date, price_at_disclosure_date FROM qualifying)) AS total_buys,
             (SELECT round(avg(dd), 4) FROM (SELECT avg(max_drawdown_disc) AS dd FROM qualifying WHERE max_drawdown_disc > -10 AND max_drawdown_disc < 0 GROUP BY filer_id, ticker, disclosure_date, price_at_disclosure_date)) AS avg_dd""",
        "published", "buys", "qualifying"),
    "table_counts": with_ctes(
        f"""SELECT count(*) AS trades, count(*) FILTER (transaction_type = 'buy' AND filing_violation = 'compliant') AS compliant_buys, max(disclosure_date) AS latest,
             count(*) FILTER (disclosure_date >= DATE '{SINCE}') AS since, (SELECT count(score) FROM published) AS scored FROM trades""", "trades", "published"),
    "rank_neighbours": with_ctes(
        """SELECT filer_id, name, score, row_number() OVER w AS rank, lag(name) OVER w AS prev_name, lead(name) OVER w AS next_name FROM published WHERE score IS NOT NULL WINDOW w AS (ORDER BY score DESC, filer_id)""", "published"),
    "feature_coverage": with_ctes(
        " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count({c}) AS populated, count(*) - count({c}) AS missing FROM labelled" for c in
                           ("price_at_disclosure_date", "days_to_exit_disc", "close_date_disc", "max_drawdown_disc")), "labelled"),
    "qa_gates": with_ctes(_GATE_SQL, "all_repeated", extra={"g": "SELECT *, transaction_type = 'buy' AND filing_violation = 'compliant' AS c FROM all_repeated"}),
}


def late_oracles() -> dict[str, str]:
    return {
        "leaderboard_filter": with_ctes(
            "SELECT filer_id, score FROM leaders WHERE party = 'BUILDING' AND total_trades >= 8 AND last_trade_date >= DATE '2000-06-01' AND comm_aligned > 0 AND avg_filing_lag <= 25", "leaders"),
        "leaderboard_regrid": with_ctes("SELECT filer_id, win_rate, avg_dd, compliant_trades, combo_wr FROM regridded", "regridded"),
        "regrid_party": with_ctes(
            "SELECT party, CAST(coalesce(sum(w), 0) AS BIGINT) AS wins, CAST(coalesce(sum(l), 0) AS BIGINT) AS losses, round(100e0 * sum(w) / nullif(sum(w) + sum(l), 0), 1) AS win_rate FROM regridded GROUP BY ROLLUP (party)", "regridded"),
        "export_csv": with_ctes('SELECT name AS "Politician", party AS "Party", win_rate AS "Win%", compliant_trades AS "Comp Buys" FROM leaders', "leaders"),
        "topk_report": with_ctes(
            """SELECT * FROM (SELECT 'scores' AS report, filer_id AS key, score AS value FROM published WHERE score IS NOT NULL ORDER BY score DESC, filer_id LIMIT 30)
               UNION ALL SELECT * FROM (SELECT 'repeats', f.name, CAST(count(*) AS DOUBLE) FROM repeated r JOIN filers f ON f.filer_id = r.filer_id
                 WHERE repeat_before_close = 1 AND filing_violation = 'compliant' AND asset_type = 'stock' GROUP BY f.name ORDER BY count(*) DESC, f.name LIMIT 15)
               UNION ALL SELECT * FROM (SELECT 'committees', committee_relevance, CAST(count(*) AS DOUBLE) FROM relevant WHERE committee_relevance IS NOT NULL GROUP BY 2 ORDER BY count(*) DESC, 2 LIMIT 10)
               UNION ALL SELECT * FROM (SELECT 'latest', trade_id, CAST(size_midpoint AS DOUBLE) FROM relevant WHERE committee_relevance IS NOT NULL ORDER BY disclosure_date DESC, trade_id LIMIT 10)""",
            "published", "repeated", "filers", "relevant"),
    }
