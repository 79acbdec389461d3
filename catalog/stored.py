"""Stored forms and shipped values: bucketed prices, sketches, counts observed while writing, SQL functions, partitions, taxonomies."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from catalog import base, committees as committee_queries, records, signals
from catalog.base import CTES, with_ctes
from filingscope.functions import sql
from filingscope.operators import committees, flags, sketches
from filingscope.plans import reports
from filingscope.session import materialize
from filingscope.sources import ingest, pricebook, tables, taxonomy

COUNT_BOUND, RANK_BOUND, QUARTERS = 0.065, 0.02, (0.25, 0.5, 0.75)
_BOOKS: dict[tuple[str, str], pricebook.PriceBook] = {}


def price_book(s, d):
    """The mapped prices as a bucketed table, stored once per application and input folder."""
    key = (s.sparkContext.applicationId, d)
    if key not in _BOOKS:
        _BOOKS[key] = pricebook.save_price_book(base.prices(s, d), f"price_book_{uuid.uuid4().hex}", records.folder(s, "price-book"))
    return _BOOKS[key]


def book_entries(s, d):
    keys = base.buys(s, d).select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date"))
    return pricebook.entries_in_book(keys, price_book(s, d)).drop("start_idx")


def sketched(s, d):
    """Months and years from daily sketches: exact rows, and whether the estimates keep their bounds against an exact pass."""
    rows = base.trades(s, d).select("filer_id", "trade_date", "size_midpoint")
    stored = materialize(sketches.daily_sketches(rows, ["trade_date"], "filer_id", "size_midpoint"))
    out = None
    for unit in ("month", "year"):
        begins = F.trunc("trade_date", unit).alias("begins")
        rolled = sketches.read_sketches(sketches.roll_up(stored, [begins]), QUARTERS)
        exact = rows.withColumn("begins", begins).join(rolled.select("begins", "amounts"), "begins").groupBy("begins").agg(
            F.count_distinct("filer_id").alias("filers"),
            *[F.avg((F.col("size_midpoint") < F.col("amounts")[i]).cast("double")).alias(f"below_{i}") for i in range(len(QUARTERS))],
            *[F.avg((F.col("size_midpoint") <= F.col("amounts")[i]).cast("double")).alias(f"upto_{i}") for i in range(len(QUARTERS))])
        close = [(F.col(f"below_{i}") <= q + RANK_BOUND) & (F.col(f"upto_{i}") >= q - RANK_BOUND) for i, q in enumerate(QUARTERS)]
        part = rolled.join(exact, "begins").select(
            F.lit(unit).alias("unit"), "begins", "n", "filers", (F.abs(F.col("n_items") - F.col("filers")) <= F.col("filers") * COUNT_BOUND).alias("filers_close"),
            (close[0] & close[1] & close[2]).alias("quarters_close"))
        out = part if out is None else out.unionByName(part)
    return out


def _counted(s, counts: dict[str, int], label: str):
    return s.createDataFrame([(k, n) for k, n in counts.items() if n], f"{label} string, n bigint")


def observed_drops(s, d):
    path = records.folder(s, "memberships")
    counts = ingest.land_assignments(records.assignment_table(s, d), records.codes(s, d), records.crosswalk(s, d), "assign_", path)
    written = s.read.parquet(path).agg(F.lit("written").alias("status"), F.count("*").alias("n"))
    return _counted(s, counts, "status").unionByName(written)


def observed_rejects(s, d):
    path = records.folder(s, "accepted")
    counts = ingest.land_accepted(ingest.normalise_disclosures(records.raw(s, d), "House"), F.lit(records.CUTOFF), path)
    written = s.read.parquet(path).agg(F.lit("written").alias("reject_reason"), F.count("*").alias("n"))
    return _counted(s, counts, "reject_reason").unionByName(written)


def filed_by_sql(s, d):
    """The normalisers called from SQL, with a table function over LATERAL."""
    sql.register(s)
    return s.sql(f"""SELECT {', '.join(records.KEY)}, f.*, fs_party(owner) AS party, fs_filer_id(assetDescription, owner) AS slug
        FROM {{raw}} r, LATERAL fs_filing(r.amount, r.type, r.transactionDate, r.disclosureDate) f""", raw=records.raw(s, d))


def replaced_sources(s, d):
    """Memberships stored by source; one source is replaced by its new rows and the table is loaded again."""
    root, columns = records.folder(s, "tables"), ["filer_id", "committee_id", "start_date", "source"]
    path = f"{root}/committee_memberships"
    tables.save_by_source(base.members(s, d).select(columns), path)
    tables.save_by_source(committee_queries.raw_members(s, d).filter("source = 'current'").select(columns), path)
    return tables.load(s, root, ("committee_memberships",))["committee_memberships"].select(columns)


# Test keys dealt onto the shipped taxonomies, by one text for both engines.

def _numbered(values, column: str) -> str:
    return "SELECT * FROM (VALUES " + ", ".join(f"({i}, '{v}')" for i, v in enumerate(values)) + f") AS v(pos, {column})"


_INDUSTRIES, _TICKERS, _SEATS = list(taxonomy.INDUSTRY_SUBSECTORS), list(taxonomy.TICKER_SUBSECTORS), list(taxonomy.COMMITTEE_SUBSECTORS)
INDUSTRIES_SQL, TICKERS_SQL, SEATS_SQL = _numbered(_INDUSTRIES, "industry"), _numbered(_TICKERS, "ticker"), _numbered(_SEATS, "committee_id")
HOUSE = [*taxonomy.HOUSE_CODES, 999]
# Every fourth supplier is a ticker with a sub-sector of its own; two industries are unknown.
DEALT_SQL = f"""
SELECT l.trade_id, l.filer_id, l.transaction_type, l.disclosure_date, coalesce(t.ticker, l.ticker) AS ticker, i.industry
FROM {{rows}} l LEFT JOIN ({TICKERS_SQL}) t ON CAST(l.ticker AS INT) = 4 * t.pos + 1
LEFT JOIN ({INDUSTRIES_SQL}) i ON CAST(l.ticker AS INT) % {len(_INDUSTRIES) + 2} = i.pos
"""
SEATED_SQL = f"""
SELECT m.filer_id, s.committee_id, m.start_date, m.end_date, m.confidence FROM {{members}} m
JOIN ({SEATS_SQL}) s ON (CAST(m.filer_id AS INT) * 7 + ascii(m.committee_id)) % {len(_SEATS)} = s.pos
"""
CODED_SQL = f"""
SELECT congress, {{pick}} AS committee_code, person_code, party_code, start, {{end}}, rank FROM {{assigned}}
"""
_PLACE = f"(person_code * 3 + committee_code) % {len(HOUSE)}"


def shipped(s, d):
    rows = s.sql(DEALT_SQL, rows=base.buys(s, d))
    return committees.with_subsector(rows, taxonomy.ticker_subsector(s), taxonomy.industry_subsector(s))


def shipped_relevance(s, d):
    seated = s.sql(SEATED_SQL, members=base.members(s, d))
    return committees.flag_committee(shipped(s, d), seated, taxonomy.committee_subsector(s), taxonomy.committee_name(s))


def shipped_assignments(s, d):
    pick = f"element_at(array({', '.join(map(str, HOUSE))}), CAST({_PLACE} AS INT) + 1)"
    rows = s.sql(CODED_SQL.format(pick=pick, end="`end`", assigned="{assigned}"), assigned=records.assignments(s, d))
    return ingest.load_assignments(rows, taxonomy.committee_codes(s, "house"), records.crosswalk(s, d), "house_")


def long_baskets(s, d):
    """Baskets with the default bounds, on trade quarters and disclosure years, which the test tables fill."""
    rows = base.trades(s, d).withColumns({"trade_date": F.trunc("trade_date", "quarter"), "disclosure_date": F.trunc("disclosure_date", "year")})
    return flags.basket_groups(rows, "trade_date", flags.TRADE_DATE_BASKET).unionByName(
        flags.basket_groups(rows, "disclosure_date", flags.DISCLOSURE_BASKET).withColumnRenamed("disclosure_date", "trade_date"))


QUERIES = {
    "book_asof": lambda s, d: pricebook.asof_in_book(base.buys(s, d), price_book(s, d), "disclosure_date", out="price_at_disclosure_date").select("trade_id", "price_at_disclosure_date"),
    "book_entries": book_entries,
    "sketch_rollup": sketched,
    "observed_drops": observed_drops,
    "observed_rejects": observed_rejects,
    "sql_functions": filed_by_sql,
    "replaced_sources": replaced_sources,
    "shipped_subsector": lambda s, d: shipped(s, d).select("trade_id", "subsector"),
    "shipped_relevance": lambda s, d: shipped_relevance(s, d).filter("committee_relevance IS NOT NULL").select("trade_id", "committee_relevance"),
    "shipped_assignments": shipped_assignments,
    "basket_groups_10_20": long_baskets,
    "gap_buckets_5": lambda s, d: reports.gap_analysis(base.labelled(s, d)),
}


def _pairs(rows, columns: str) -> str:
    quote = lambda v: str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(quote, r)) + ")" for r in rows) + f") AS v({columns})"


CTES["dealt"] = (("buys",), DEALT_SQL.format(rows="buys"))
CTES["seated"] = (("members",), SEATED_SQL.format(members="members"))
CTES["of_industry"] = ((), _pairs(taxonomy.INDUSTRY_SUBSECTORS.items(), "industry, subsector"))
CTES["of_ticker"] = ((), _pairs(taxonomy.TICKER_SUBSECTORS.items(), "ticker, subsector"))
CTES["covers"] = ((), _pairs([(c, x) for c, xs in taxonomy.COMMITTEE_SUBSECTORS.items() for x in xs], "committee_id, subsector"))
CTES["called"] = ((), _pairs(taxonomy.COMMITTEE_NAMES.items(), "committee_id, name"))
CTES["shipped"] = (
    ("dealt", "of_industry", "of_ticker"),
    "SELECT x.*, coalesce(t.subsector, i.subsector) AS subsector FROM dealt x LEFT JOIN of_ticker t ON t.ticker = x.ticker LEFT JOIN of_industry i ON i.industry = x.industry",
)
_PERIODS = """SELECT '{u}' AS unit, CAST(date_trunc('{u}', trade_date) AS DATE) AS begins, count(*) AS n, count(DISTINCT filer_id) AS filers, TRUE AS filers_close, TRUE AS quarters_close
FROM trades GROUP BY ALL"""

ORACLES = {
    "book_asof": with_ctes("SELECT trade_id, price_at_disclosure_date FROM priced", "priced"),
    "book_entries": with_ctes(
        """SELECT DISTINCT ticker AS symbol, disclosure_date AS anchor_date, price_at_disclosure_date AS anchor_close, day1_open, entry_price FROM entries WHERE disclosure_date IS NOT NULL""", "entries"),
    "sketch_rollup": with_ctes(_PERIODS.format(u="month") + " UNION ALL " + _PERIODS.format(u="year"), "trades"),
    "observed_drops": with_ctes(
        """SELECT status, count(*) AS n FROM marked GROUP BY status UNION ALL SELECT 'written', count(*) FILTER (status = 'loaded') FROM marked""", "assigned", "codes", "crosswalk", extra={
            "marked": """SELECT CASE WHEN committee_code NOT IN (SELECT committee_code FROM codes) THEN 'no_committee' WHEN person_code NOT IN (SELECT person_code FROM crosswalk) THEN 'no_person' ELSE 'loaded' END AS status
                FROM assigned"""}),
    "observed_rejects": with_ctes(
        """SELECT reject_reason, count(*) AS n FROM marked GROUP BY 1 UNION ALL SELECT 'written', count(*) FILTER (reject_reason = 'accepted') FROM marked""", "normed_lag", extra={
            "marked": f"""SELECT CASE WHEN trade_date IS NULL THEN 'missing_date' WHEN disclosure_date < DATE '{records.CUTOFF}' THEN 'before_cutoff' WHEN ticker IS NULL THEN 'blank_ticker'
                WHEN transaction_type = 'receive' THEN 'receipt' ELSE 'accepted' END AS reject_reason FROM normed_lag"""}),
    "sql_functions": with_ctes(
        f"""SELECT {records._K}, size_min, size_max, CAST((size_min + size_max) // 2 AS BIGINT) AS size_midpoint, transaction_type, trade_date, disclosure_date,
              CAST(disclosure_date - trade_date AS INT) AS filing_lag_days, CASE WHEN disclosure_date - trade_date > 45 THEN 'violation' ELSE 'compliant' END AS filing_violation,
              CASE owner WHEN 'Spouse' THEN 'Spouse' WHEN ' JOINT ' THEN 'Joint' END AS party, 'FS_' || replace(lower(assetDescription), ' ', '-') AS slug
            FROM (SELECT r.*, a.size_min, a.size_max, {records._parsed('r.transactionDate')} AS trade_date, {records._parsed('r.disclosureDate')} AS disclosure_date,
                CASE trim(lower(r.type)) WHEN 'purchase' THEN 'buy' WHEN 'partial sale' THEN 'sell' WHEN 'stock option' THEN 'option' ELSE trim(lower(r.type)) END AS transaction_type
              FROM raw r JOIN amounts a USING ({records._K}))""", "raw", "amounts"),
    "replaced_sources": with_ctes(
        """SELECT filer_id, committee_id, start_date, source FROM members WHERE source <> 'current' UNION ALL SELECT filer_id, committee_id, start_date, source FROM raw_members WHERE source = 'current'""",
        "members", "raw_members"),
    "shipped_subsector": with_ctes("SELECT trade_id, subsector FROM shipped", "shipped"),
    "shipped_relevance": with_ctes(
        """SELECT trade_id, string_agg(name, ' | ' ORDER BY committee_id) AS committee_relevance FROM (
             SELECT x.trade_id, coalesce(n.name, m.committee_id) AS name, min(m.committee_id) AS committee_id
             FROM shipped x JOIN seated m ON m.filer_id = x.filer_id AND m.confidence = 'high' AND x.disclosure_date >= m.start_date AND x.disclosure_date <= coalesce(m.end_date, DATE '9999-12-31')
             JOIN covers v ON v.committee_id = m.committee_id AND v.subsector = x.subsector LEFT JOIN called n ON n.committee_id = m.committee_id GROUP BY ALL)
           GROUP BY trade_id""", "shipped", "seated", "covers", "called"),
    "shipped_assignments": with_ctes(
        """SELECT x.filer_id, c.committee_id, CASE party_code WHEN '100' THEN 'Democrat' WHEN '200' THEN 'Republican' END AS party, CAST(rank AS INT) AS rank, CAST(start AS DATE) AS start_date,
             CAST(nullif("end", '') AS DATE) AS end_date, 'house_' || congress AS source FROM coded a JOIN house c ON c.committee_code = a.committee_code JOIN crosswalk x ON x.person_code = a.person_code""",
        "assigned", "crosswalk", extra={
            "coded": CODED_SQL.format(pick=f"({HOUSE})[CAST({_PLACE} AS INT) + 1]", end='"end"', assigned="assigned"),
            "house": _pairs(taxonomy.HOUSE_CODES.items(), "committee_code, committee_id")}),
    "basket_groups_10_20": with_ctes(
        """SELECT filer_id, CAST(date_trunc('quarter', trade_date) AS DATE) AS trade_date, count(DISTINCT ticker) AS n_tickers FROM buys WHERE filing_violation = 'compliant' GROUP BY ALL HAVING count(DISTINCT ticker) >= 10
           UNION ALL SELECT filer_id, CAST(date_trunc('year', disclosure_date) AS DATE), count(DISTINCT ticker) FROM buys WHERE filing_violation = 'compliant' GROUP BY ALL HAVING count(DISTINCT ticker) >= 20""", "buys"),
    "gap_buckets_5": signals.ORACLES["gap_buckets"].replace("g > 2 AS skipped", "g > 5 AS skipped"),
}


def late_oracles() -> dict[str, str]:
    return {}
