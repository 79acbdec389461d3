"""Landed records: normalisation, ingest formats, rejects and ids.

Raw disclosure strings are derived from the order lines: mixed date formats, amounts, types,
owners and districts.  One mapping text serves both engines.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from catalog import base
from catalog.base import CTES, with_ctes
from filingscope.functions import normalise as N
from filingscope.operators import flags
from filingscope.session import shared_folder
from filingscope.sources import ingest

CUTOFF = datetime.date(1996, 1, 1)
AS_OF = datetime.date(2001, 1, 31)


def _date_text(day: str, style: str) -> str:
    y, m, d = (f"substr(CAST({day} AS STRING), {a}, {b})" for a, b in ((1, 4), (6, 2), (9, 2)))
    return f"""CASE {style} WHEN 0 THEN CAST({day} AS STRING) WHEN 1 THEN {m} || '/' || {d} || '/' || {y} WHEN 2 THEN {y} || '/' || {m} || '/' || {d}
      WHEN 3 THEN ' ' || CAST({day} AS STRING) || ' ' WHEN 4 THEN '25/' || {m} || '/' || {y} WHEN 5 THEN 'n/a' ELSE '' END"""


_DD = "(CAST(o_orderdate AS DATE) + CAST((l_orderkey * 7 + l_partkey) % 60 AS INT))"
_N = "CAST(CAST(floor(l_extendedprice) AS BIGINT) AS STRING)"
_T = "CAST(CAST(floor(l_extendedprice / 1000) AS BIGINT) AS STRING)"

RAW_SQL = f"""
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS shipped,
  CASE WHEN l_partkey % 29 = 0 THEN '' ELSE ' ' || substr(c_name, 1, 8) || ' ' END AS firstName,
  CASE WHEN l_partkey % 29 = 0 THEN NULL ELSE substr(c_name, 10) END AS lastName,
  CASE WHEN l_suppkey % 17 = 0 THEN '  ' ELSE ' s' || CAST(l_suppkey AS STRING) END AS symbol,
  CASE WHEN l_linenumber = 3 THEN '' ELSE 'Asset ' || CAST(l_suppkey AS STRING) END AS assetDescription,
  CASE l_partkey % 9 WHEN 0 THEN 'Purchase' WHEN 1 THEN ' PARTIAL SALE ' WHEN 2 THEN 'Exchange' WHEN 3 THEN 'Stock Option' WHEN 4 THEN 'Receive' WHEN 5 THEN 'Gift' WHEN 6 THEN 'sell' WHEN 7 THEN 'buy' ELSE '' END AS type,
  CASE l_partkey % 6 WHEN 0 THEN '$' || {_T} || ',000 - $' || {_N} || '000' WHEN 1 THEN 'Over $' || {_T} || ',001' WHEN 2 THEN '' WHEN 3 THEN '$' || {_N} WHEN 4 THEN {_T} || ' to ' || {_N} ELSE 'unknown' END AS amount,
  CASE l_linenumber WHEN 1 THEN 'Spouse' WHEN 2 THEN NULL WHEN 3 THEN '' ELSE ' JOINT ' END AS owner,
  CASE WHEN l_linenumber = 7 THEN NULL ELSE lower(substr(n_name, 1, 2)) || CAST(n_nationkey AS STRING) END AS district,
  {_date_text(_DD, '(l_orderkey % 7)')} AS disclosureDate,
  {_date_text('CAST(o_orderdate AS DATE)', '(l_partkey % 7)')} AS transactionDate
FROM {{lineitem}} JOIN {{orders}} ON l_orderkey = o_orderkey JOIN {{customer}} ON o_custkey = c_custkey JOIN {{nation}} ON c_nationkey = n_nationkey
"""
KEY = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "shipped"]
raw = base._mapped(RAW_SQL)
RECORD = [f.name for f in ingest.schemas.DISCLOSURE_RAW]

# Size labels and page dates are cut from the same lines.
PAGE_SQL = """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_shipdate AS DATE) AS shipped,
  CASE l_partkey % 9 WHEN 0 THEN '1K–15K' WHEN 1 THEN '$15K - 50K' WHEN 2 THEN ' 50k—100k' WHEN 3 THEN '100K–250K' WHEN 4 THEN '250K-500K' WHEN 5 THEN '500K–1M' WHEN 6 THEN '1M–5M' WHEN 7 THEN '5M+' ELSE 'n/a' END AS size_label,
  CASE l_orderkey % 6 WHEN 0 THEN '14:01Today' WHEN 1 THEN 'Yesterday' WHEN 2 THEN substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 9, 2) || ' Feb' || substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 4)
    WHEN 3 THEN '09:15  7 Mar ' || substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 1, 4) WHEN 4 THEN substr(CAST(CAST(l_shipdate AS DATE) AS STRING), 9, 2) || '/05/1999' ELSE 'soon' END AS page_date
FROM {lineitem}
"""
pages = base._mapped(PAGE_SQL)


def folder(s, kind):
    return f"{shared_folder(s).rstrip('/')}/filingscope/{kind}-{uuid.uuid4().hex}"


def api_pages(s, d):
    """The raw lines landed as JSON pages: bare lists and the three envelopes, one page per order, and broken pages."""
    page = raw(s, d).groupBy("l_orderkey").agg(F.collect_list(F.struct(*RECORD)).alias("recs"))
    line = F.to_json("recs", {"ignoreNullFields": "false"})
    boxed = lambda k: F.concat(F.lit('{"' + k + '": '), line, F.lit("}"))
    kind = F.pmod("l_orderkey", F.lit(4))
    path = folder(s, "pages")
    broken = page.filter("l_orderkey % 5 = 0").select(F.concat(F.lit('{"error": "'), F.col("l_orderkey"), F.lit('"}')).alias("value")).unionByName(
        page.filter("l_orderkey % 7 = 0").select(F.lit("<html>").alias("value")))
    broken.write.text(path)
    page.select(
        F.when(kind == 0, line).when(kind == 1, boxed("data")).when(kind == 2, boxed("results")).otherwise(boxed("trades")).alias("value")
    ).write.mode("append").text(path)
    return path


XML_CODES = {"URGE": "HSAG", "HIGH": "HSAP", "MEDI": "HSAS", "LOW": "HSBA"}


def member_file(s, d):
    """Committee memberships landed as a member snapshot in XML."""
    rows = base.members(s, d).groupBy("filer_id").agg(F.sort_array(F.collect_list("committee_id")).alias("codes"))
    tree = rows.select(
        F.lit(" ca12").alias("statedistrict"),
        F.struct(
            F.col("filer_id").alias("bioguideID"), F.lit("First").alias("firstname"), F.concat(F.lit("L"), F.col("filer_id")).alias("lastname"),
            F.lit("").alias("official-name"), F.when(F.col("filer_id").endswith("1"), "R").otherwise("D").alias("party"),
        ).alias("member-info"),
        F.struct(F.transform("codes", lambda c: F.struct(c.alias("_comcode"), F.length(c).cast("string").alias("_rank"))).alias("committee")).alias("committee-assignments"),
    )
    path = folder(s, "members")
    tree.write.format("xml").option("rowTag", "member").option("rootTag", "MemberData").save(path)
    return path


ASSIGN_SQL = """
SELECT 100 + o_custkey % 20 AS congress, CAST(substr(o_orderpriority, 1, 1) AS INT) AS committee_code, o_custkey AS person_code,
  CASE o_custkey % 3 WHEN 0 THEN '100' WHEN 1 THEN '200' ELSE '328' END AS party_code,
  CAST(min(CAST(o_orderdate AS DATE)) AS STRING) AS start, CASE WHEN o_custkey % 2 = 0 THEN CAST(max(CAST(o_orderdate AS DATE)) AS STRING) ELSE '' END AS "end", CAST(count(*) AS STRING) AS rank
FROM {orders} GROUP BY o_custkey, o_orderpriority
"""
CODES_SQL = "SELECT * FROM (VALUES (1, 'URGE'), (2, 'HIGH'), (3, 'MEDI'), (5, 'LOW')) AS v(committee_code, committee_id)"
CROSS_SQL = "SELECT c_custkey AS person_code, CAST(c_custkey AS STRING) AS filer_id FROM {customer} WHERE c_custkey % 10 <> 0"
assignments = base._mapped(ASSIGN_SQL.replace('"end"', "`end`"))
codes = base._mapped(CODES_SQL)
crosswalk = base._mapped(CROSS_SQL)


def assignment_table(s, d):
    """The assignment table landed as CSV and read back with a declared schema."""
    path = folder(s, "assignments")
    assignments(s, d).write.option("header", True).csv(path)
    schema = "congress INT, committee_code INT, person_code BIGINT, party_code STRING, start STRING, `end` STRING, rank STRING"
    return s.read.schema(schema).option("header", True).csv(path)


def _split(df, parsed, *extra):
    return df.select(*KEY, parsed.alias("p")).select(*KEY, "p.*", *extra)


QUERIES = {
    "ingest_json": lambda s, d: ingest.read_disclosures_json(s, api_pages(s, d)).select(*RECORD),
    "ingest_rejects": lambda s, d: ingest.rejected_pages(s, api_pages(s, d)),
    "ingest_members_xml": lambda s, d: ingest.read_members_xml(s, member_file(s, d), 118, XML_CODES),
    "ingest_assignments": lambda s, d: ingest.load_assignments(assignment_table(s, d), codes(s, d), crosswalk(s, d), "assign_"),
    "assignment_drops": lambda s, d: ingest.assignment_drops(assignment_table(s, d), codes(s, d), crosswalk(s, d)),
    "norm_record": lambda s, d: ingest.normalise_disclosures(raw(s, d), "House"),
    "norm_size": lambda s, d: _split(pages(s, d), N.parse_size(F.col("size_label"))),
    "norm_amount": lambda s, d: _split(raw(s, d), N.parse_amount(F.col("amount"))),
    "norm_date": lambda s, d: raw(s, d).select(*KEY, N.parse_date(F.col("disclosureDate")).alias("d")),
    "norm_page_date": lambda s, d: pages(s, d).select(*KEY, N.parse_date(F.col("page_date"), N.PAGE_DATE_FORMATS, F.lit(AS_OF)).alias("d")),
    "norm_tx_type": lambda s, d: raw(s, d).groupBy(N.norm_tx_type(F.col("type")).alias("kind")).agg(F.count("*").alias("n")),
    "norm_party": lambda s, d: base.table(s, d, "customer").select(
        "c_custkey", N.norm_party(F.concat(F.lit(" "), F.substring("c_mktsegment", 2, 20))).alias("party"), N.norm_party(F.when(F.col("c_custkey") % 2 == 0, F.lit("gop")).otherwise(F.lit(" d "))).alias("code")),
    "filing_lag": lambda s, d: flags.with_filing_lag(
        base.trades(s, d).drop("filing_violation").withColumnRenamed("filing_lag_days", "scraped").withColumn(
            "trade_date", F.when(F.pmod("size_midpoint", F.lit(5)) > 0, F.col("trade_date"))), scraped="scraped").select("trade_id", "filing_lag_days", "filing_violation"),
    "make_ids": lambda s, d: ids(s, d),
    "reject_rows": lambda s, d: ingest.split_rejects(ingest.normalise_disclosures(raw(s, d), "House"), F.lit(CUTOFF))[1].unionByName(
        ingest.split_rejects(ingest.normalise_disclosures(raw(s, d), "House"), F.lit(CUTOFF))[0].agg(F.lit("accepted").alias("reject_reason"), F.count("*").alias("n"))),
}


def ids(s, d):
    rows = base.trades(s, d).join(base.filers(s, d), "filer_id")
    who = N.synthetic_filer_id(F.concat("name", F.lit(". Jr!")), F.when(F.col("chamber") == "ASIA", "US House").otherwise("Senate"))
    return rows.withColumn("who", who).select(
        "trade_id", F.col("who").alias("synthetic_id"),
        N.make_trade_id(F.col("who"), F.col("ticker"), F.col("trade_date"), F.col("transaction_type"), F.lit("House")).alias("new_id"))


# ---------------------------------------------------------------------------------------------

_TABLES = {t: t for t in base._TABLES}
CTES["raw"] = ((), RAW_SQL.format(**_TABLES))
CTES["pagerows"] = ((), PAGE_SQL.format(**_TABLES))
CTES["assigned"] = ((), ASSIGN_SQL.format(**_TABLES))
CTES["codes"] = ((), CODES_SQL)
CTES["crosswalk"] = ((), CROSS_SQL.format(**_TABLES))
_K = ", ".join(KEY)


def _parsed(c: str) -> str:
    return (f"CAST(coalesce(try_strptime(trim({c}), '%Y-%m-%d'), try_strptime(trim({c}), '%m/%d/%Y'), try_strptime(trim({c}), '%d/%m/%Y'), try_strptime(trim({c}), '%Y/%m/%d')) AS DATE)")


_NUMS = "list_filter(list_transform(string_split_regex(lower(replace(replace(amount, '$', ''), ',', '')), '[-–to]+'), lambda x: regexp_replace(x, '[^0-9]', '', 'g')), lambda x: x <> '')"
CTES["amounts"] = (
    ("raw",),
    f"""SELECT {_K}, CASE WHEN lower(amount) LIKE 'over%' THEN nums[1] ELSE nums[1] END AS size_min, CASE WHEN len(nums) >= 2 AND lower(amount) NOT LIKE 'over%' THEN nums[2] ELSE nums[1] END AS size_max
        FROM (SELECT *, list_transform({_NUMS}, lambda x: CAST(x AS BIGINT)) AS nums FROM raw)""",
)
CTES["normed"] = (
    ("raw", "amounts"),
    f"""SELECT nullif(trim(concat_ws(' ', trim(firstName), trim(coalesce(lastName, '')))), '') AS name, 'House' AS chamber, upper(substr(trim(district), 1, 2)) AS state, nullif(trim(upper(symbol)), '') AS ticker,
          nullif(trim(assetDescription), '') AS company, {_parsed('transactionDate')} AS trade_date, {_parsed('disclosureDate')} AS disclosure_date,
          CASE trim(lower(type)) WHEN 'purchase' THEN 'buy' WHEN 'partial sale' THEN 'sell' WHEN 'stock option' THEN 'option' ELSE trim(lower(type)) END AS transaction_type,
          coalesce(nullif(trim(lower(owner)), ''), 'self') AS owner, a.size_min, a.size_max, CAST((a.size_min + a.size_max) // 2 AS BIGINT) AS size_midpoint
        FROM raw r JOIN amounts a USING ({_K})""",
)
CTES["normed_lag"] = (
    ("normed",),
    """SELECT *, CAST(disclosure_date - trade_date AS INT) AS filing_lag_days, CASE WHEN disclosure_date - trade_date > 45 THEN 'violation' ELSE 'compliant' END AS filing_violation
       FROM normed WHERE name IS NOT NULL AND disclosure_date IS NOT NULL""",
)
_SIZES = "CASE l_partkey % 9 " + " ".join(
    f"WHEN {i} THEN {{v{i}}}" for i in range(8)) + " END"


def _size_case(pick) -> str:
    values = list(N.SIZE_LABELS.values())
    return "CAST(" + _SIZES.format(**{f"v{i}": pick(values[i]) for i in range(8)}) + " AS BIGINT)"


_Y = "CAST(substr(CAST(shipped AS VARCHAR), 1, 4) AS INT)"
ORACLES = {
    "ingest_json": with_ctes(f"SELECT {', '.join(RECORD)} FROM raw", "raw"),
    "ingest_rejects": with_ctes(
        """SELECT count(DISTINCT l_orderkey) FILTER (l_orderkey % 5 = 0) + count(DISTINCT l_orderkey) FILTER (l_orderkey % 7 = 0) AS n,
             count(DISTINCT l_orderkey) FILTER (l_orderkey % 5 = 0) + count(DISTINCT l_orderkey) FILTER (l_orderkey % 7 = 0) + count(DISTINCT l_orderkey) AS pages FROM raw""", "raw"),
    "ingest_members_xml": with_ctes(
        """SELECT filer_id, CASE committee_id WHEN 'URGE' THEN 'HSAG' WHEN 'HIGH' THEN 'HSAP' WHEN 'MEDI' THEN 'HSAS' WHEN 'LOW' THEN 'HSBA' END AS committee_id,
             CASE WHEN filer_id LIKE '%1' THEN 'Republican' ELSE 'Democrat' END AS party, CAST(length(committee_id) AS INT) AS rank, DATE '2023-01-03' AS start_date, DATE '2025-01-03' AS end_date, 'clerk_house_118' AS source
           FROM members WHERE committee_id <> 'NOT'""", "members"),
    "ingest_assignments": with_ctes(
        """SELECT x.filer_id, c.committee_id, CASE party_code WHEN '100' THEN 'Democrat' WHEN '200' THEN 'Republican' END AS party, CAST(rank AS INT) AS rank, CAST(start AS DATE) AS start_date,
             CAST(nullif("end", '') AS DATE) AS end_date, 'assign_' || congress AS source FROM assigned a JOIN codes c ON c.committee_code = a.committee_code JOIN crosswalk x ON x.person_code = a.person_code""",
        "assigned", "codes", "crosswalk"),
    "assignment_drops": with_ctes(
        """SELECT CASE WHEN committee_code NOT IN (SELECT committee_code FROM codes) THEN 'no_committee' WHEN person_code NOT IN (SELECT person_code FROM crosswalk) THEN 'no_person' ELSE 'loaded' END AS status, count(*) AS n
           FROM assigned GROUP BY 1""", "assigned", "codes", "crosswalk"),
    "norm_record": with_ctes("SELECT * FROM normed_lag", "normed_lag"),
    "norm_size": with_ctes(
        f"SELECT {_K}, {_size_case(lambda v: v[0])} AS size_min, {_size_case(lambda v: v[1])} AS size_max, {_size_case(lambda v: (v[0] + v[1]) // 2)} AS size_midpoint FROM pagerows", "pagerows"),
    "norm_amount": with_ctes(f"SELECT {_K}, size_min, size_max, CAST((size_min + size_max) // 2 AS BIGINT) AS size_midpoint FROM amounts", "amounts"),
    "norm_date": with_ctes(f"SELECT {_K}, {_parsed('disclosureDate')} AS d FROM raw", "raw"),
    "norm_page_date": with_ctes(
        f"""SELECT {_K}, CASE l_orderkey % 6 WHEN 0 THEN DATE '{AS_OF}' WHEN 1 THEN DATE '{AS_OF}' - 1 WHEN 2 THEN CAST(try_strptime({_Y} || '-02-' || day(shipped), '%Y-%m-%d') AS DATE)
             WHEN 3 THEN make_date({_Y}, 3, 7) WHEN 4 THEN make_date(1999, 5, CAST(day(shipped) AS INT)) END AS d FROM pagerows""", "pagerows"),
    "norm_tx_type": with_ctes(
        "SELECT CASE trim(lower(type)) WHEN 'purchase' THEN 'buy' WHEN 'partial sale' THEN 'sell' WHEN 'stock option' THEN 'option' ELSE trim(lower(type)) END AS kind, count(*) AS n FROM raw GROUP BY 1", "raw"),
    "norm_party": """SELECT c_custkey, CASE substr(c_mktsegment, 2) WHEN 'UILDING' THEN 'Uilding' WHEN 'UTOMOBILE' THEN 'Utomobile' WHEN 'ACHINERY' THEN 'Achinery' WHEN 'OUSEHOLD' THEN 'Ousehold'
        WHEN 'URNITURE' THEN 'Urniture' END AS party, CASE WHEN c_custkey % 2 = 0 THEN 'Republican' ELSE 'Democrat' END AS code FROM customer""",
    "filing_lag": with_ctes("SELECT trade_id, filing_lag_days, filing_violation FROM trades", "trades"),
    "make_ids": with_ctes(
        """SELECT trade_id, who AS synthetic_id, 'fmph_' || who || '_' || ticker || '_' || strftime(trade_date, '%Y%m%d') || '_' || transaction_type[1] AS new_id
           FROM (SELECT t.*, CASE WHEN f.chamber = 'ASIA' THEN 'FH_' ELSE 'FS_' END || lower(replace(f.name, '#', '-')) || '-jr' AS who FROM trades t JOIN filers f ON f.filer_id = t.filer_id)""", "trades", "filers"),
    "reject_rows": with_ctes(
        f"""SELECT CASE WHEN trade_date IS NULL THEN 'missing_date' WHEN disclosure_date < DATE '{CUTOFF}' THEN 'before_cutoff' WHEN ticker IS NULL THEN 'blank_ticker' WHEN transaction_type = 'receive' THEN 'receipt'
             ELSE 'accepted' END AS reject_reason, count(*) AS n FROM normed_lag GROUP BY 1""", "normed_lag"),
}


def late_oracles() -> dict[str, str]:
    return {}
