"""Readers for landed records: API pages, member snapshots, assignment tables."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from filingscope import schemas
from filingscope.functions import normalise as N
from filingscope.operators.flags import with_filing_lag

# Keys under which a page envelope may hold its records.
ENVELOPE_KEYS = ("data", "results", "trades")

# Clerk committee code -> committee id.
CLERK_CODES = {
    "AG00": "HSAG", "AP00": "HSAP", "AS00": "HSAS", "BA00": "HSBA", "BO00": "HSBU", "BU00": "HSBU", "ED00": "HSED",
    "EL00": "HSED", "FA00": "HSFA", "GO00": "HSGO", "HA00": "HSHA", "HM00": "HSHM", "IF00": "HSIF", "II00": "HSII",
    "JU00": "HSJU", "PW00": "HSPW", "RU00": "HSRU", "SC00": "HSSY", "SY00": "HSSY", "SM00": "HSSM", "SO00": "HSSO",
    "VR00": "HSVR", "WM00": "HSWM", "LG00": "HLIG", "IG00": "HLIG", "PI00": "HLIG", "SL00": "HLIG",
}

# Congress -> term start and end (NULL while sitting).
CONGRESS_TERMS = {
    116: ("2019-01-03", "2021-01-03"),
    117: ("2021-01-03", "2023-01-03"),
    118: ("2023-01-03", "2025-01-03"),
    119: ("2025-01-03", None),
}


def _pages(spark: SparkSession, path: str) -> DataFrame:
    """Landed lines with ``records``: the line's own list, else the first list an envelope holds, else NULL.

    An object without a list and a line that is no JSON hold no records.
    """
    record = schemas.DISCLOSURE_RAW
    envelope = T.StructType([T.StructField(k, T.ArrayType(record)) for k in ENVELOPE_KEYS])
    listed = F.when(F.ltrim("value").startswith("["), F.from_json("value", T.ArrayType(record)))
    boxed = F.when(F.ltrim("value").startswith("{"), F.from_json("value", envelope))
    return spark.read.text(path).filter(F.trim("value") != "").select(
        "value", F.coalesce(listed, *[boxed[k] for k in ENVELOPE_KEYS]).alias("records"))


def read_disclosures_json(spark: SparkSession, path: str) -> DataFrame:
    """Records of landed pages: each line is a record list or an object holding one; other lines give nothing."""
    return _pages(spark, path).select(F.explode("records").alias("r")).filter("r IS NOT NULL").select("r.*")


def rejected_pages(spark: SparkSession, path: str) -> DataFrame:
    """How many landed pages hold no record list (n), and how many pages there are (pages)."""
    return _pages(spark, path).agg(F.count_if(F.col("records").isNull()).alias("n"), F.count("*").alias("pages"))


def normalise_disclosures(df: DataFrame, chamber: str) -> DataFrame:
    """Raw records -> canonical disclosures; rows without name or disclosure date are dropped."""
    text = lambda c: F.coalesce(F.trim(F.col(c)), F.lit(""))
    amount = N.parse_amount(F.col("amount"))
    district = text("district")
    parsed = df.select(
        N.blank_to_null(F.concat_ws(" ", text("firstName"), text("lastName"))).alias("name"), F.lit(chamber).alias("chamber"),
        F.when(district != "", F.upper(F.substring(district, 1, 2))).alias("state"),
        N.blank_to_null(F.upper("symbol")).alias("ticker"), N.blank_to_null(F.col("assetDescription")).alias("company"),
        N.parse_date(F.col("transactionDate")).alias("traded"), N.parse_date(F.col("disclosureDate")).alias("disclosed"),
        N.norm_tx_type(F.col("type")).alias("transaction_type"), amount.alias("size"),
        F.coalesce(F.trim(F.lower(F.when(F.col("owner") != "", F.col("owner")))), F.lit("self")).alias("owner"),
    )
    # Filters on the dates aren't pushed below a generator, where every filter would parse them again.
    dates = F.inline(F.array(F.struct(F.col("traded").alias("trade_date"), F.col("disclosed").alias("disclosure_date"))))
    out = parsed.select("*", dates).drop("traded", "disclosed").filter("name IS NOT NULL AND disclosure_date IS NOT NULL")
    return with_filing_lag(out.select("*", "size.*").drop("size"))


REJECT_REASONS = ("missing_date", "before_cutoff", "blank_ticker", "receipt")


def _reject_reason(cutoff: Column) -> Column:
    missing, before, blank, receipt = REJECT_REASONS
    return (
        F.when(F.col("trade_date").isNull() | F.col("disclosure_date").isNull(), missing)
        .when(F.col("disclosure_date") < cutoff, before).when(F.col("ticker").isNull() | (F.trim("ticker") == ""), blank)
        .when(F.col("transaction_type") == "receive", receipt)
    )


def split_rejects(df: DataFrame, cutoff: Column) -> tuple[DataFrame, DataFrame]:
    """(accepted rows, reject counts by reason)."""
    tagged = df.withColumn("reject_reason", _reject_reason(cutoff))
    return (
        tagged.filter("reject_reason IS NULL").drop("reject_reason"),
        tagged.filter("reject_reason IS NOT NULL").groupBy("reject_reason").agg(F.count("*").alias("n")),
    )


def _land(tagged: DataFrame, column: str, kept: str, others: tuple[str, ...], out: list, path: str) -> dict[str, int]:
    """Write the rows tagged ``kept`` and count every tag in the pass that writes.

    The counts are taken in the writing stage itself, above all exchanges, so a stage that runs again for a lost executor doesn't
    count twice.
    """
    seen = Observation()
    counts = [F.count_if(F.col(column) == tag).alias(tag) for tag in (kept, *others)]
    tagged.observe(seen, *counts).filter(F.col(column) == kept).select(*out).write.parquet(path)
    return seen.get


def land_accepted(df: DataFrame, cutoff: Column, path: str) -> dict[str, int]:
    """``split_rejects`` in one pass: accepted rows are written to ``path``; returns counts by reason and ``accepted``."""
    tagged = df.withColumn("reject_reason", F.coalesce(_reject_reason(cutoff), F.lit("accepted")))
    return _land(tagged, "reject_reason", "accepted", REJECT_REASONS, df.columns, path)


MEMBER_XML = T.StructType([
    T.StructField("statedistrict", T.StringType()),
    T.StructField("member-info", T.StructType([
        T.StructField("bioguideID", T.StringType()), T.StructField("firstname", T.StringType()),
        T.StructField("lastname", T.StringType()), T.StructField("official-name", T.StringType()),
        T.StructField("party", T.StringType()),
    ])),
    T.StructField("committee-assignments", T.StructType([
        T.StructField("committee", T.ArrayType(T.StructType([
            T.StructField("_comcode", T.StringType()), T.StructField("_rank", T.StringType()),
        ]))),
    ])),
])


def read_member_snapshot(spark: SparkSession, path: str) -> DataFrame:
    """Members of one snapshot; rows without id or last name are dropped."""
    rows = spark.read.format("xml").option("rowTag", "member").schema(MEMBER_XML).load(path)
    info = F.col("member-info")
    return rows.select(
        N.blank_to_null(info["bioguideID"]).alias("filer_id"), N.blank_to_null(info["lastname"]).alias("lastname"),
        F.coalesce(
            N.blank_to_null(info["official-name"]), N.blank_to_null(F.concat_ws(" ", F.trim(info["firstname"]), F.trim(info["lastname"])))
        ).alias("name"),
        N.party_from_code(info["party"]).alias("party"),
        F.when(F.length(F.trim("statedistrict")) >= 2, F.upper(F.substring(F.trim("statedistrict"), 1, 2))).alias("state"),
        F.col("committee-assignments.committee").alias("assignments"),
    ).filter("filer_id IS NOT NULL AND lastname IS NOT NULL")


def read_members_xml(
    spark: SparkSession, path: str, congress: int, codes: Mapping[str, str] | None = None,
    term: tuple[str, str | None] | None = None,
) -> DataFrame:
    """Committee memberships of one snapshot with the term bounds of its congress; unmapped codes drop out."""
    start, end = term or CONGRESS_TERMS[congress]
    lookup = F.create_map(*[F.lit(x) for pair in (codes or CLERK_CODES).items() for x in pair])
    rows = read_member_snapshot(spark, path).select("filer_id", "party", F.explode("assignments").alias("a"))
    return rows.select(
        "filer_id", F.try_element_at(lookup, F.col("a._comcode")).alias("committee_id"), "party",
        F.when(F.col("a._rank").rlike("^[0-9]+$"), F.col("a._rank").try_cast("int")).alias("rank"),
        F.lit(start).cast("date").alias("start_date"), F.lit(end).cast("date").alias("end_date"),
        F.lit(f"clerk_house_{congress}").alias("source"),
    ).filter("committee_id IS NOT NULL")


def load_assignments(df: DataFrame, code_map: DataFrame, crosswalk: DataFrame, source_prefix: str) -> DataFrame:
    """Tabular assignments (congress, committee_code, person_code, party_code, start, end, rank) -> memberships.

    ``code_map``: committee_code -> committee_id, ``crosswalk``: person_code -> filer_id; both small
    lookups (Spark broadcasts them when their size allows).  Unmapped rows drop out, see
    ``assignment_drops``.
    """
    rows = df.filter("committee_code IS NOT NULL AND person_code IS NOT NULL")
    return rows.join(code_map, "committee_code").join(crosswalk, "person_code").select(*_membership(source_prefix))


def _membership(source_prefix: str) -> list[Column]:
    return [
        F.col("filer_id"), F.col("committee_id"), N.party_from_code(F.col("party_code")).alias("party"), F.col("rank").try_cast("int").alias("rank"),
        N.parse_date(F.col("start")).alias("start_date"), N.parse_date(F.col("end")).alias("end_date"),
        F.concat(F.lit(source_prefix), F.col("congress")).alias("source"),
    ]


def land_assignments(df: DataFrame, code_map: DataFrame, crosswalk: DataFrame, source_prefix: str, path: str) -> dict[str, int]:
    """``load_assignments`` and ``assignment_drops`` in one pass: memberships are written to ``path``, counts returned.

    Both lookups are expected to name each code once.
    """
    rows = df.filter("committee_code IS NOT NULL AND person_code IS NOT NULL").join(code_map, "committee_code", "left").join(crosswalk, "person_code", "left")
    status = F.when(F.col("committee_id").isNull(), "no_committee").when(F.col("filer_id").isNull(), "no_person").otherwise("loaded")
    return _land(rows.withColumn("status", status), "status", "loaded", ("no_committee", "no_person"), _membership(source_prefix), path)


def assignment_drops(df: DataFrame, code_map: DataFrame, crosswalk: DataFrame) -> DataFrame:
    """Loaded rows and drops by reason."""
    t = (
        df.filter("committee_code IS NOT NULL AND person_code IS NOT NULL")
        .join(code_map.select("committee_code", F.lit(1).alias("_c")).distinct(), "committee_code", "left")
        .join(crosswalk.select("person_code", F.lit(1).alias("_p")).distinct(), "person_code", "left")
    )
    why = F.when(F.col("_c").isNull(), "no_committee").when(F.col("_p").isNull(), "no_person").otherwise("loaded")
    return t.groupBy(why.alias("status")).agg(F.count("*").alias("n"))
