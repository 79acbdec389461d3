"""Taxonomies and committees.  Committees oversee sub-sectors S0..S4, assigned to industries by nation."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import base
from catalog.base import CTES, with_ctes
from filingscope.operators import committees

INDUSTRY_SQL = "SELECT n_name AS industry, concat('S', CAST(n_nationkey % 5 AS STRING)) AS subsector FROM {nation} WHERE n_nationkey <> 24"
OVERRIDE_SQL = "SELECT CAST(s_suppkey AS STRING) AS ticker, 'S0' AS subsector FROM {supplier} WHERE s_suppkey % 13 = 0"
COVERAGE_SQL = """SELECT * FROM (VALUES ('URGE', 'S0'), ('HIGH', 'S1'), ('MEDI', 'S2'), ('NOT', 'S3'), ('LOW', 'S4'), ('URGE', 'S1'), ('MEDI', 'S0')) AS v(committee_id, subsector)"""
NAMES_SQL = """SELECT * FROM (VALUES ('URGE', 'House Judiciary'), ('HIGH', 'Senate Finance'), ('MEDI', 'House Natural Resources'), ('LOW', 'Senate HELP')) AS v(committee_id, name)"""
RAW_SQL = """
SELECT CAST(o_custkey AS STRING) AS filer_id, trim(substr(o_orderpriority, 3, 4)) || CASE WHEN o_orderstatus = 'P' THEN '01' ELSE '' END AS committee_id,
  CASE o_custkey % 4 WHEN 0 THEN 'clerk_house_118' WHEN 1 THEN 'current' WHEN 2 THEN 'archive' END AS source,
  CASE WHEN o_custkey % 7 = 0 THEN 'low' END AS confidence, min(CAST(o_orderdate AS DATE)) AS start_date
FROM {orders} GROUP BY o_custkey, o_orderpriority, o_orderstatus
"""
industry_map = base._mapped(INDUSTRY_SQL)
overrides = base._mapped(OVERRIDE_SQL)
coverage = base._mapped(COVERAGE_SQL)
names = base._mapped(NAMES_SQL)
raw_members = base._mapped(RAW_SQL)


def classified(s, d, rows=None):
    rows = base.labelled(s, d) if rows is None else rows
    return committees.with_subsector(rows, overrides(s, d), industry_map(s, d))


def relevant(s, d, rows=None):
    return committees.flag_committee(classified(s, d, rows), base.members(s, d), coverage(s, d), names(s, d))


def corrected(s, d):
    fixes = base.table(s, d, "customer").filter("c_custkey % 11 = 0").select(
        F.col("c_custkey").cast("string").alias("filer_id"), F.array(F.lit("HIGH"), F.lit("NEW")).alias("committees"))
    return committees.apply_overrides(base.members(s, d), fixes, ["current"], {"source": "current", "confidence": "high"})


def thinned(s, d):
    """Trades whose sector is only known on every third row."""
    return base.trades(s, d).withColumn("sector", F.when(F.pmod(F.col("size_midpoint"), F.lit(3)) == 0, F.col("sector")))


QUERIES = {
    "subsector": lambda s, d: classified(s, d).select("trade_id", "subsector"),
    "propagate_ticker": lambda s, d: committees.propagate(thinned(s, d), "ticker", ["sector"]).select("trade_id", "sector"),
    "full_committees": lambda s, d: committees.prepare_memberships(raw_members(s, d)).select("filer_id", "committee_id", "source", "confidence", "start_date"),
    "active_committees": lambda s, d: committees.active_committees(base.members(s, d), names(s, d)),
    "committee_relevance": lambda s, d: relevant(s, d).filter("committee_relevance IS NOT NULL").select("trade_id", "committee_relevance"),
    "committee_stats": lambda s, d: committees.committee_stats(relevant(s, d)),
    "committee_tier": lambda s, d: committees.with_tier(relevant(s, d)).groupBy("committee_tier").agg(F.count("*").alias("n")),
    "apply_corrections": lambda s, d: corrected(s, d).select("filer_id", "committee_id", "start_date", "end_date", "source", "confidence"),
    "reconcile_sets": lambda s, d: committees.reconcile(
        base.members(s, d).filter("source = 'current'"), raw_members(s, d), "filer_id", "committee_id"),
    "membership_counts": lambda s, d: committees.membership_counts(raw_members(s, d)),
    "industry_breakdown": lambda s, d: committees.industry_breakdown(
        base.trades(s, d), ["NATION_1", "NATION_7", "NATION_12"], "asset_type"),
}

CTES["industry_map"] = ((), INDUSTRY_SQL.format(nation="nation"))
CTES["overrides"] = ((), OVERRIDE_SQL.format(supplier="supplier"))
CTES["coverage"] = ((), COVERAGE_SQL)
CTES["names"] = ((), NAMES_SQL)
CTES["raw_members"] = ((), RAW_SQL.format(orders="orders"))
CTES["classified"] = (
    ("labelled", "industry_map", "overrides"),
    """SELECT l.*, coalesce((SELECT o.subsector FROM overrides o WHERE o.ticker = l.ticker), (SELECT i.subsector FROM industry_map i WHERE i.industry = l.industry)) AS subsector FROM labelled l""",
)
CTES["relevant"] = (
    ("classified", "members", "coverage", "names"),
    """SELECT c.*, r.committee_relevance FROM classified c LEFT JOIN (
         SELECT trade_id, string_agg(name, ' | ' ORDER BY committee_id) AS committee_relevance FROM (
           SELECT x.trade_id, coalesce(n.name, m.committee_id) AS name, min(m.committee_id) AS committee_id
           FROM classified x JOIN members m ON m.filer_id = x.filer_id AND m.confidence = 'high' AND x.disclosure_date BETWEEN m.start_date AND coalesce(m.end_date, DATE '9999-12-31')
           JOIN coverage v ON v.committee_id = m.committee_id AND v.subsector = x.subsector LEFT JOIN names n ON n.committee_id = m.committee_id GROUP BY ALL)
         GROUP BY trade_id) r ON r.trade_id = c.trade_id""",
)
_TIER = {
    "STRONG": "('House Natural Resources')",
    "WEAK": "('House Judiciary', 'Senate HELP')",
}

ORACLES = {
    "subsector": with_ctes("SELECT trade_id, subsector FROM classified", "classified"),
    "propagate_ticker": with_ctes(
        "SELECT trade_id, CASE WHEN size_midpoint % 3 = 0 THEN sector ELSE (SELECT max(x.sector) FROM trades x WHERE x.ticker = t.ticker AND x.size_midpoint % 3 = 0) END AS sector FROM trades t", "trades"),
    "full_committees": with_ctes(
        """SELECT filer_id, committee_id, source, start_date, CASE WHEN confidence IS NOT NULL THEN confidence WHEN source IN ('clerk_house_118', 'current') THEN 'high' ELSE 'low' END AS confidence
           FROM raw_members WHERE NOT regexp_matches(committee_id, '[0-9]')""", "raw_members"),
    "active_committees": with_ctes(
        "SELECT DISTINCT m.filer_id, m.committee_id, coalesce(n.name, m.committee_id) AS name FROM members m LEFT JOIN names n ON n.committee_id = m.committee_id WHERE confidence = 'high' AND end_date IS NULL", "members", "names"),
    "committee_relevance": with_ctes("SELECT trade_id, committee_relevance FROM relevant WHERE committee_relevance IS NOT NULL", "relevant"),
    "committee_stats": with_ctes(
        f"""SELECT committee, count(*) AS n, count(*) FILTER (o = 'win') AS wins, count(*) FILTER (o = 'loss') AS losses, count(*) FILTER (o = 'open') AS opens,
             round(100e0 * count(*) FILTER (o = 'win') / count(*), 1) AS win_pct, round(avg(dd) FILTER (dd > -10 AND dd < 0), 2) AS avg_dd,
             CASE WHEN committee IN {_TIER['STRONG']} THEN 'STRONG' WHEN committee IN {_TIER['WEAK']} THEN 'WEAK' ELSE 'NEUTRAL' END AS tier
           FROM (SELECT unnest(string_split(committee_relevance, ' | ')) AS committee, max_drawdown_disc AS dd,
             CASE WHEN max_drawdown_disc <= -10 THEN 'loss' WHEN days_to_exit_disc IS NOT NULL THEN 'win' ELSE 'open' END AS o
             FROM relevant WHERE committee_relevance IS NOT NULL AND filing_violation = 'compliant' AND price_at_disclosure_date IS NOT NULL AND max_drawdown_disc IS NOT NULL)
           GROUP BY committee""", "relevant"),
    "committee_tier": with_ctes(
        """SELECT CASE WHEN committee_relevance IS NULL THEN NULL WHEN contains(committee_relevance, 'House Natural Resources') THEN 'STRONG'
             WHEN contains(committee_relevance, 'House Judiciary') OR contains(committee_relevance, 'Senate HELP') THEN 'WEAK' ELSE 'NEUTRAL' END AS committee_tier, count(*) AS n
           FROM relevant GROUP BY 1""", "relevant"),
    "apply_corrections": with_ctes(
        """SELECT filer_id, committee_id, start_date, end_date, source, confidence FROM members WHERE NOT (source = 'current' AND CAST(filer_id AS BIGINT) % 11 = 0)
           UNION ALL SELECT CAST(c_custkey AS VARCHAR), v.c, NULL, NULL, 'current', 'high' FROM customer CROSS JOIN (VALUES ('HIGH'), ('NEW')) AS v(c) WHERE c_custkey % 11 = 0""", "members"),
    "reconcile_sets": with_ctes(
        """SELECT filer_id, committee_id, 'missing' AS status FROM (SELECT filer_id, committee_id FROM raw_members WHERE filer_id IN (SELECT filer_id FROM ours) EXCEPT SELECT * FROM ours)
           UNION ALL SELECT filer_id, committee_id, 'extra' FROM (SELECT * FROM ours WHERE filer_id IN (SELECT filer_id FROM raw_members) EXCEPT SELECT filer_id, committee_id FROM raw_members)""",
        "members", "raw_members", extra={"ours": "SELECT filer_id, committee_id FROM members WHERE source = 'current'"}),
    "membership_counts": with_ctes(
        """SELECT 'source' AS view, source AS value, count(*) AS n_memberships, count(DISTINCT filer_id) AS n_filers FROM raw_members GROUP BY source
           UNION ALL SELECT 'committee', committee_id, count(*), count(DISTINCT filer_id) FROM raw_members GROUP BY committee_id
           UNION ALL SELECT 'all', 'all', count(*), count(DISTINCT filer_id) FROM raw_members""", "raw_members"),
    "industry_breakdown": with_ctes(
        "SELECT industry, asset_type, count(DISTINCT ticker) AS n_tickers FROM trades WHERE industry IN ('NATION_1', 'NATION_7', 'NATION_12') GROUP BY ALL", "trades"),
}


def late_oracles() -> dict[str, str]:
    return {}
