"""Taxonomies, committee memberships and committee relevance."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round

# Membership sources trusted for flagging.
TRUSTED_SOURCES = ("clerk_house_116", "clerk_house_117", "clerk_house_118", "clerk_house_119", "current")

# Committee -> confidence tier; every other committee is NEUTRAL.
COMMITTEE_TIERS = {
    "House Natural Resources": "STRONG",
    "House Ways & Means": "STRONG",
    "House Intelligence (Permanent Select)": "STRONG",
    "Senate Intelligence (Select)": "STRONG",
    "House Foreign Affairs": "STRONG",
    "Senate Foreign Relations": "STRONG",
    "Senate HELP": "WEAK",
    "House Homeland Security": "WEAK",
    "House Judiciary": "WEAK",
    "Senate Judiciary": "WEAK",
}


def with_subsector(df: DataFrame, overrides: DataFrame, industry_map: DataFrame) -> DataFrame:
    """Sub-sector by ticker override, else by industry, else NULL."""
    by_ticker = overrides.select("ticker", F.col("subsector").alias("_by_ticker"))
    by_industry = industry_map.select("industry", F.col("subsector").alias("_by_industry"))
    return (
        df.join(by_ticker, "ticker", "left").join(by_industry, "industry", "left")
        .withColumn("subsector", F.coalesce("_by_ticker", "_by_industry")).drop("_by_ticker", "_by_industry")
    )


def propagate(df: DataFrame, by: str, cols: Sequence[str]) -> DataFrame:
    """Fill missing values from other rows of the same key (largest value where rows disagree)."""
    known = df.filter(F.col(by).isNotNull()).groupBy(by).agg(*[F.max(c).alias(f"_{c}") for c in cols])
    out = df.join(known, by, "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols])


def is_full_committee(col: str = "committee_id") -> Column:
    return F.col(col).isNotNull() & ~F.col(col).rlike("[0-9]") & (F.col(col) != "")


def prepare_memberships(df: DataFrame, trusted: Sequence[str] = TRUSTED_SOURCES) -> DataFrame:
    """Full committees only; confidence kept if set, else high for trusted sources and low otherwise."""
    confidence = F.when(F.col("source").isin(*trusted), "high").otherwise("low")
    if "confidence" in df.columns:
        confidence = F.coalesce("confidence", confidence)
    return df.filter(is_full_committee()).withColumn("confidence", confidence)


def active_committees(memberships: DataFrame, names: DataFrame) -> DataFrame:
    """Distinct current high-confidence committees per filer with display names."""
    return (
        memberships.filter("confidence = 'high' AND end_date IS NULL").select("filer_id", "committee_id").distinct()
        .join(names.select("committee_id", "name"), "committee_id", "left")
        .withColumn("name", F.coalesce("name", "committee_id"))
    )


def flag_committee(
    trades: DataFrame, memberships: DataFrame, coverage: DataFrame, names: DataFrame,
) -> DataFrame:
    """``committee_relevance``: committees the filer sat on at disclosure that cover the sub-sector.

    Memberships are folded to one short array per (filer, sub-sector), at most one entry per
    committee term, so trades need one equi join and no second shuffle.  Bounds are inclusive and
    NULL bounds are open; names are distinct, in order of committee id.
    """
    terms = (
        memberships.filter("confidence = 'high'").filter(F.col("committee_id").isNotNull())
        .join(coverage.select("committee_id", "subsector").distinct(), "committee_id")
        .join(names.select("committee_id", "name"), "committee_id", "left")
        .groupBy("filer_id", "subsector")
        .agg(F.sort_array(F.collect_set(F.struct(
            "committee_id", F.coalesce("name", "committee_id").alias("name"), "start_date", "end_date",
        ))).alias("terms"))
    )
    at = F.col("disclosure_date")
    active = F.filter("terms", lambda t: (t["start_date"].isNull() | (at >= t["start_date"])) & (t["end_date"].isNull() | (at <= t["end_date"])))
    found = F.array_distinct(F.transform(active, lambda t: t["name"]))
    return (
        trades.join(terms, ["filer_id", "subsector"], "left")
        .withColumn("committees", F.when((F.col("transaction_type") == "buy") & (F.size(found) > 0), found))
        .withColumn("committee_relevance", F.array_join("committees", " | ")).drop("terms")
    )


def tier_of(names: Column, tiers: dict[str, str] | None = None) -> Column:
    """Best tier over an array of committee names; NULL for NULL or empty."""
    tiers = COMMITTEE_TIERS if tiers is None else tiers
    strong = F.array(*[F.lit(n) for n, t in tiers.items() if t == "STRONG"]).cast("array<string>")
    weak = F.array(*[F.lit(n) for n, t in tiers.items() if t == "WEAK"]).cast("array<string>")
    return (
        F.when(names.isNull() | (F.size(names) == 0), F.lit(None).cast("string"))
        .when(F.arrays_overlap(names, strong), "STRONG").when(F.arrays_overlap(names, weak), "WEAK").otherwise("NEUTRAL")
    )


def with_tier(df: DataFrame, col: str = "committee_relevance", tiers: dict[str, str] | None = None) -> DataFrame:
    names = F.when(F.col(col) != "", F.transform(F.split(col, r" \| "), lambda n: F.trim(n)))
    return df.withColumn("committee_tier", tier_of(names, tiers))


def committee_stats(df: DataFrame, tiers: dict[str, str] | None = None) -> DataFrame:
    """Per committee: n, wins, losses, opens, win % of n, mean drawdown in (-10, 0), tier."""
    dd = F.col("max_drawdown_disc")
    rows = df.filter(
        "committee_relevance IS NOT NULL AND transaction_type = 'buy' AND filing_violation = 'compliant'"
        " AND price_at_disclosure_date IS NOT NULL AND disclosure_date IS NOT NULL AND max_drawdown_disc IS NOT NULL"
    ).select(
        dd, "days_to_exit_disc", F.explode(F.split("committee_relevance", r"\s*\|\s*")).alias("raw")
    ).withColumn("committee", F.trim("raw"))
    lost, exited = dd <= -10, F.col("days_to_exit_disc").isNotNull()
    stats = rows.groupBy("committee").agg(
        F.count("*").alias("n"), F.count_if(~lost & exited).alias("wins"), F.count_if(lost).alias("losses"),
        F.count_if(~lost & ~exited).alias("opens"),
        stable_round(100.0 * F.count_if(~lost & exited) / F.count("*"), 1).alias("win_pct"),
        stable_round(F.avg(F.when((dd > -10) & (dd < 0), dd)), 2).alias("avg_dd"),
    )
    return stats.withColumn("tier", tier_of(F.array("committee"), tiers))


def apply_overrides(memberships: DataFrame, corrections: DataFrame, sources: Sequence[str], template: dict) -> DataFrame:
    """Replace all rows of the listed filers from ``sources`` by the corrected committees.

    ``corrections``: filer_id, committees ARRAY<STRING>; ``template``: constant columns of new rows.
    """
    listed = corrections.select("filer_id").distinct()
    replaced = memberships.filter(F.col("source").isin(*sources)).join(listed, "filer_id", "left_anti")
    kept = memberships.filter(~F.col("source").isin(*sources) | F.col("source").isNull())
    fresh = corrections.select("filer_id", F.explode("committees").alias("committee_id")).distinct()
    types = {f.name: f.dataType for f in memberships.schema}
    fresh = fresh.select("filer_id", "committee_id", *[
        F.lit(template.get(c)).cast(types[c]).alias(c) for c in memberships.columns if c not in ("filer_id", "committee_id")
    ])
    return kept.unionByName(replaced).unionByName(fresh)


def reconcile(ours: DataFrame, authority: DataFrame, key: str, value: str) -> DataFrame:
    """Values missing from ours and extra in ours, for keys both sides know."""
    a = ours.select(key, value).distinct().withColumn("_ours", F.lit(1))
    b = authority.select(key, value).distinct().withColumn("_auth", F.lit(1))
    both = a.select(key).distinct().join(b.select(key).distinct(), key, "left_semi")
    return (
        a.join(b, [key, value], "full").join(both, key, "left_semi")
        .withColumn("status", F.when(F.col("_ours").isNull(), "missing").when(F.col("_auth").isNull(), "extra"))
        .filter("status IS NOT NULL").select(key, value, "status")
    )


def membership_counts(memberships: DataFrame) -> DataFrame:
    """Rows and distinct filers per source, per committee and overall."""
    views = F.explode(F.array(
        F.struct(F.lit("source").alias("view"), F.col("source").alias("value")),
        F.struct(F.lit("committee").alias("view"), F.col("committee_id").alias("value")),
        F.struct(F.lit("all").alias("view"), F.lit("all").alias("value")),
    ))
    return memberships.select("filer_id", views.alias("v")).groupBy("v.view", "v.value").agg(
        F.count("*").alias("n_memberships"), F.count_distinct("filer_id").alias("n_filers")
    )


def industry_breakdown(trades: DataFrame, industries: Sequence[str], code: str) -> DataFrame:
    """Distinct tickers per (industry, code) for the chosen industries."""
    return trades.filter(F.col("industry").isin(*industries) & F.col(code).isNotNull()).groupBy("industry", code).agg(
        F.count_distinct("ticker").alias("n_tickers")
    )


def advance_history(history: DataFrame, snapshot: DataFrame, on: Column, keys: Sequence[str]) -> DataFrame:
    """``history`` (``keys``, valid_from, valid_to) after one more full snapshot of the keys, taken ``on``.

    Rows that only the snapshot has open an interval, rows that only the open intervals have end theirs (valid_to is the first
    day without them); a key that comes back opens a new one.  Closed intervals are not read by the comparison.
    """
    now = snapshot.select(*keys).distinct()
    open_ = history.filter("valid_to IS NULL").select(*keys)
    gained = now.exceptAll(open_).select(*keys, on.alias("valid_from"), F.lit(None).cast("date").alias("valid_to"))
    lost = open_.exceptAll(now).withColumn("_lost", F.lit(True))
    same = F.lit(True)
    for k in keys:  # null keys match themselves, as in set operations
        same = same & F.col(f"h.{k}").eqNullSafe(F.col(f"l.{k}"))
    ended = history.alias("h").join(lost.alias("l"), same & F.col("h.valid_to").isNull(), "left").select(
        *[F.col(f"h.{k}") for k in keys], F.col("h.valid_from"), F.when(F.col("_lost"), on).otherwise(F.col("h.valid_to")).alias("valid_to"))
    return ended.unionByName(gained)
