"""Mapping of the test tables onto the engine's logical tables, plus shared oracle CTEs.

The mapping texts run unchanged in Spark and DuckDB.  Everything after them is written twice:
operators on the Spark side, plain SQL in a different form on the oracle side.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from filingscope.operators.barriers import label_disclosures
from filingscope.session import materialize

TRADES_SQL = """
SELECT concat_ws('-', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING), CAST(l_partkey AS STRING), CAST(l_suppkey AS STRING), CAST(CAST(l_shipdate AS DATE) AS STRING)) AS trade_id,
  CAST(o_custkey AS STRING) AS filer_id, CAST(l_suppkey AS STRING) AS ticker,
  CAST(o_orderdate AS DATE) AS trade_date,
  CAST(o_orderdate AS DATE) + CAST((l_orderkey * 7 + l_partkey) % 60 AS INT) AS disclosure_date,
  CAST((l_orderkey * 7 + l_partkey) % 60 AS INT) AS filing_lag_days,
  CASE WHEN l_returnflag = 'R' THEN 'sell' ELSE 'buy' END AS transaction_type,
  CASE WHEN (l_orderkey * 7 + l_partkey) % 60 > 45 THEN 'violation' ELSE 'compliant' END AS filing_violation,
  CAST(floor(l_extendedprice) AS BIGINT) AS size_midpoint,
  CASE l_suppkey % 10 WHEN 0 THEN 'etf' WHEN 1 THEN 'fund' ELSE 'stock' END AS asset_type,
  n_name AS industry, r_name AS sector
FROM {lineitem} JOIN {orders} ON l_orderkey = o_orderkey
JOIN {supplier} ON l_suppkey = s_suppkey JOIN {nation} ON s_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

# Day rows first, then a 20-day mean: no window ever sees more than one row per symbol and day.
PRICES_SQL = """
WITH daily AS (SELECT CAST(l_suppkey AS STRING) AS symbol, CAST(l_shipdate AS DATE) AS date,
    sum(CAST(round(l_extendedprice / l_quantity * 100) AS BIGINT)) AS cents, count(*) AS n
  FROM {lineitem} GROUP BY l_suppkey, CAST(l_shipdate AS DATE)),
 lv AS (SELECT symbol, date, CAST(sum(cents) OVER w AS DOUBLE) / CAST(sum(n) OVER w * 100 AS DOUBLE) AS lvl
  FROM daily WINDOW w AS (PARTITION BY symbol ORDER BY date ROWS BETWEEN 19 PRECEDING AND CURRENT ROW)),
 pr AS (SELECT symbol, date, lvl, lag(lvl) OVER (PARTITION BY symbol ORDER BY date) AS prev FROM lv)
SELECT symbol, date, (coalesce(prev, lvl) + lvl) / 2 AS open,
  greatest((coalesce(prev, lvl) + lvl) / 2, lvl) AS high,
  least((coalesce(prev, lvl) + lvl) / 2, lvl) AS low, lvl AS close
FROM pr
"""

FILERS_SQL = """
SELECT CAST(c_custkey AS STRING) AS filer_id, c_name AS name, c_mktsegment AS party, r_name AS chamber, n_name AS state
FROM {customer} JOIN {nation} ON c_nationkey = n_nationkey JOIN {region} ON n_regionkey = r_regionkey
"""

MEMBERS_SQL = """
SELECT CAST(o_custkey AS STRING) AS filer_id, trim(substr(o_orderpriority, 3, 4)) AS committee_id,
  min(CAST(o_orderdate AS DATE)) AS start_date,
  CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE max(CAST(o_orderdate AS DATE)) END AS end_date,
  CASE WHEN o_custkey % 5 <> 0 THEN 'high' ELSE 'low' END AS confidence,
  CASE WHEN o_custkey % 5 <> 0 THEN 'current' ELSE 'archive' END AS source
FROM {orders} GROUP BY o_custkey, o_orderpriority
"""

_TABLES = ("lineitem", "orders", "supplier", "nation", "region", "customer")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _mapped(text: str):
    names = [t for t in _TABLES if "{" + t + "}" in text]

    def build(spark: SparkSession, d: str) -> DataFrame:
        inputs = {t: table(spark, d, t) for t in names}
        return spark.sql(text, **inputs)

    return build


#: Derived tables of this application that several queries read, by application, input folder and name.
_WRITTEN: dict[tuple[str, str, str], DataFrame] = {}


def written(spark: SparkSession, d: str, name: str, build) -> DataFrame:
    """A table derived from the inputs, computed once per application and input folder and kept in the shared folder."""
    key = (spark.sparkContext.applicationId, d, name)
    if key not in _WRITTEN:
        _WRITTEN[key] = materialize(build())
    return _WRITTEN[key]


trades = _mapped(TRADES_SQL)
price_rows = _mapped(PRICES_SQL)
filers = _mapped(FILERS_SQL)
members = _mapped(MEMBERS_SQL)


def prices(spark: SparkSession, d: str) -> DataFrame:
    """The mapped price series, one written table for all queries of a batch."""
    return written(spark, d, "prices", lambda: price_rows(spark, d))


def buys(spark: SparkSession, d: str) -> DataFrame:
    return trades(spark, d).filter("transaction_type = 'buy'")


def trade_table(spark: SparkSession, d: str) -> DataFrame:
    """The mapped trades as a written table, for queries that read them several times."""
    return written(spark, d, "trades", lambda: trades(spark, d))


def label_run(spark: SparkSession, d: str, horizon: int | None = None, **barriers: float) -> DataFrame:
    """All buys with disclosure price and labels (10/10 unless told otherwise), computed here and now."""
    rows = trade_table(spark, d).filter("transaction_type = 'buy'")  # read twice: for the anchors and with their labels
    return label_disclosures(rows, prices(spark, d), horizon_days=horizon, **barriers)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """All buys with disclosure price and 10/10 labels over their whole paths: the one label pass of a batch."""
    return written(spark, d, "labelled", lambda: label_run(spark, d))


# ---------------------------------------------------------------------------------------------
# Oracle CTEs.  Each entry names the CTEs it reads.

_PLAIN = {t: t for t in _TABLES}

CTES: dict[str, tuple[tuple[str, ...], str]] = {
    "trades": ((), TRADES_SQL.format(**_PLAIN)),
    "prices": ((), PRICES_SQL.format(**_PLAIN)),
    "filers": ((), FILERS_SQL.format(**_PLAIN)),
    "members": ((), MEMBERS_SQL.format(**_PLAIN)),
    "buys": (("trades",), "SELECT * FROM trades WHERE transaction_type = 'buy'"),
    "priced": (
        ("buys", "prices"),
        """SELECT b.*, p.close AS price_at_disclosure_date
           FROM buys b ASOF LEFT JOIN prices p ON b.ticker = p.symbol AND b.disclosure_date >= p.date""",
    ),
    "pidx": (("prices",), "SELECT *, row_number() OVER (PARTITION BY symbol ORDER BY date) AS idx FROM prices"),
    # One path row per trade and later price day: the expanded form the engine avoids.
    "paths": (
        ("buys", "pidx"),
        """SELECT b.trade_id, b.disclosure_date, CAST(p.idx - coalesce(a.idx, 0) AS INT) AS day, p.date, p.open, p.high, p.low, p.close
            FROM buys b ASOF LEFT JOIN pidx a ON b.ticker = a.symbol AND b.disclosure_date >= a.date
            JOIN pidx p ON p.symbol = b.ticker AND p.idx > coalesce(a.idx, 0)""",
    ),
    "entries": (
        ("priced", "prices"),
        """SELECT b.*, n.open AS day1_open, CASE WHEN n.open > 0 THEN n.open ELSE b.price_at_disclosure_date END AS entry_price
           FROM priced b ASOF LEFT JOIN prices n ON b.ticker = n.symbol AND b.disclosure_date < n.date""",
    ),
    "touched": (
        ("entries", "paths"),
        """SELECT e.trade_id, e.entry_price, count(p.day) AS n_path,
             min(CASE WHEN p.low <= e.entry_price * 0.9e0 THEN p.day END) AS stop_day,
             min(CASE WHEN p.high >= e.entry_price * 1.1e0 THEN p.day END) AS target_day
           FROM entries e LEFT JOIN paths p ON p.trade_id = e.trade_id GROUP BY e.trade_id, e.entry_price""",
    ),
    "exits": (
        ("touched",),
        """SELECT *, CASE WHEN n_path > 0 AND entry_price > 0 AND stop_day IS NOT NULL AND (target_day IS NULL OR stop_day <= target_day) THEN 'loss'
                  WHEN n_path > 0 AND entry_price > 0 AND target_day IS NOT NULL THEN 'win' ELSE 'open' END AS outcome,
             CASE WHEN n_path > 0 AND entry_price > 0 THEN least(stop_day, target_day) END AS exit_day FROM touched""",
    ),
    "draw": (
        ("exits", "paths"),
        """SELECT x.trade_id, min((p.low - x.entry_price) / x.entry_price * 100) AS dd, max(CASE WHEN p.day = x.exit_day THEN p.date END) AS close_date
           FROM exits x JOIN paths p ON p.trade_id = x.trade_id AND (x.exit_day IS NULL OR p.day <= x.exit_day) GROUP BY x.trade_id""",
    ),
    "labelled": (
        ("entries", "exits", "draw"),
        """SELECT e.*, x.n_path > 0 AS has_path, x.outcome, x.exit_day AS days_to_exit_disc, d.close_date AS close_date_disc,
             CASE WHEN x.n_path = 0 OR e.entry_price IS NULL THEN NULL WHEN x.outcome = 'loss' THEN -10e0 ELSE round(least(0e0, d.dd), 4) END AS max_drawdown_disc,
             CASE WHEN x.n_path > 0 AND e.entry_price > 0 THEN CAST(x.outcome = 'loss' OR d.dd <= -5 AS INT) END AS drawdown_disc_5pct,
             CASE WHEN x.n_path > 0 AND e.entry_price > 0 THEN CAST(x.outcome = 'loss' OR (x.outcome = 'open' AND d.dd <= -10) AS INT) END AS drawdown_disc_10pct,
             CASE WHEN x.n_path > 0 AND e.entry_price > 0 THEN CAST(x.outcome <> 'win' AND d.dd <= -15 AS INT) END AS drawdown_disc_15pct
           FROM entries e JOIN exits x ON x.trade_id = e.trade_id LEFT JOIN draw d ON d.trade_id = e.trade_id""",
    ),
}


def stable(sql: str) -> str:
    """Rewrite round(x, d) to decimal rounding, the oracle's form of ``stable_round``."""
    out, i = "", 0
    while (at := sql.find("round(", i)) >= 0:
        depth, comma, j = 1, None, at + 6
        while depth:
            depth += {"(": 1, ")": -1}.get(sql[j], 0)
            if sql[j] == "," and depth == 1:
                comma = j
            j += 1
        if comma is None:
            out += sql[i:at] + "round(" + stable(sql[at + 6:j - 1]) + ")"
        else:
            inner, digits = stable(sql[at + 6:comma]), sql[comma + 1:j - 1].strip()
            out += f"{sql[i:at]}CAST(round(CAST({inner} AS DECIMAL(38, 10)), {digits}) AS DOUBLE)"
        i = j
    return out + sql[i:]


#: Large intermediates that are cheaper to compute again than to hold.
STREAMED = {"paths", "trade_side"}


def with_ctes(body: str, *names: str, extra: dict[str, str] | None = None) -> str:
    """Prefix ``body`` with the named CTEs and everything they read, in dependency order."""
    order: list[str] = []

    def visit(name: str) -> None:
        for dep in CTES[name][0]:
            visit(dep)
        if name not in order:
            order.append(name)

    for name in names:
        visit(name)
    parts = [f"{n} AS {'NOT ' if n in STREAMED else ''}MATERIALIZED ({CTES[n][1]})" for n in order]
    parts += [f"{n} AS ({text})" for n, text in (extra or {}).items()]
    return stable(f"WITH RECURSIVE {', '.join(parts)} {body}" if parts else body)
