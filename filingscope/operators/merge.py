"""Upserts, deduplication and merging of a staged source into the main tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MERGE_DAYS = 3


def first_per_key(df: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    """One row per key, smallest by ``order``; an aggregate, so map-side combine absorbs hot keys."""
    rest = [c for c in df.columns if c not in keys]
    return df.groupBy(*keys).agg(F.min_by(F.struct(*rest), F.struct(*order)).alias("_r")).select(*keys, "_r.*").select(*df.columns)


def upsert(target: DataFrame, src: DataFrame, keys: Sequence[str], order: Sequence, mode: str = "ignore") -> DataFrame:
    """``ignore``: existing keys win; ``replace``: source keys win.  ``order`` picks among source duplicates.

    NULL keys never collide, as in a SQL unique index.
    """
    complete = " AND ".join(f"{k} IS NOT NULL" for k in keys)
    keyed = src.filter(complete)
    fresh = first_per_key(keyed, keys, order).unionByName(src.filter(f"NOT ({complete})"))
    if mode == "ignore":
        return target.unionByName(fresh.join(target.select(*keys), list(keys), "left_anti").select(*target.columns))
    if mode == "replace":
        return target.join(fresh.select(*keys), list(keys), "left_anti").select(*target.columns).unionByName(fresh)
    raise ValueError(f"unknown mode {mode!r}")


def fill_missing(target: DataFrame, src: DataFrame, keys: Sequence[str], cols: Sequence[str]) -> DataFrame:
    """Fill only NULLs; ``src`` has one row per key."""
    new = src.select(*keys, *[F.col(c).alias(f"_{c}") for c in cols])
    out = target.join(new, list(keys), "left")
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in cols}).drop(*[f"_{c}" for c in cols]).select(*target.columns)


def replace_partition(target: DataFrame, src: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Drop all rows of the given tags and load their new snapshot."""
    return target.filter(F.col(column).isNull() | ~F.col(column).isin(*values)).unionByName(src.filter(F.col(column).isin(*values)))


# Quote type -> asset class, and symbols that are no tickers.
QUOTE_TYPES = {"EQUITY": "stock", "ETF": "etf", "MUTUALFUND": "fund"}
INVALID_SYMBOLS = ("--", "N/A", "NA")


def classify_assets(trades: DataFrame, quotes: DataFrame) -> DataFrame:
    """Fill NULL asset types from landed quotes (ticker, quote_type; no row = failed lookup)."""
    kinds = F.create_map(*[F.lit(x) for pair in QUOTE_TYPES.items() for x in pair])
    q = quotes.select("ticker", F.coalesce("quote_type", F.lit("")).alias("_quote"))
    kind = F.when(F.col("ticker").isin(*INVALID_SYMBOLS), "other").when(F.col("_quote").isNull(), "error").otherwise(
        F.coalesce(F.try_element_at(kinds, F.col("_quote")), F.lit("other"))
    )
    known = F.col("ticker").isNotNull() & (F.col("ticker") != "")
    return trades.join(q, "ticker", "left").withColumn("asset_type", F.coalesce("asset_type", F.when(known, kind))).drop("_quote")


def drop_known(src: DataFrame, main: DataFrame) -> DataFrame:
    """Incoming rows not yet present by (filer, ticker, trade date, type)."""
    keys = ["filer_id", "ticker", "trade_date", "transaction_type"]
    return src.join(main.select(*keys), keys, "left_anti")


def dedup_best(df: DataFrame) -> DataFrame:
    """One row per (filer, ticker, type, dd, td): priced first, then lower repeat flag, then smallest id."""
    keys = ["filer_id", "ticker", "transaction_type", "disclosure_date", "trade_date"]
    rows = df.filter("ticker IS NOT NULL AND trim(ticker) <> ''")
    order = [F.col("price_at_disclosure_date").isNull(), F.coalesce("repeat_before_close", F.lit(0)), F.col("trade_id")]
    return first_per_key(rows, keys, order)


def dedup_earliest(df: DataFrame) -> DataFrame:
    """One row per (filer, ticker, type, td): earliest disclosure, then priced, then smallest id."""
    keys = ["filer_id", "ticker", "transaction_type", "trade_date"]
    return first_per_key(df, keys, [F.col("disclosure_date"), F.col("price_at_disclosure_date").isNull(), F.col("trade_id")])


def merge_eligible(staged: DataFrame) -> DataFrame:
    """Compliant buys need a known outcome; everything else passes."""
    return staged.filter(
        "max_drawdown_disc IS NOT NULL OR NOT (transaction_type = 'buy' AND filing_violation = 'compliant')"
    )


_SAME = ["filer_id", "ticker", "transaction_type"]


#: Days of a bucket at least; a main key enters each bucket that its days reach into, mostly one.
NEAR_BUCKET = 32


def _near(main: DataFrame, days: int) -> tuple[DataFrame, Column]:
    """Main keys (filer, ticker, type, date) with their count, and the condition on which a staged row is near.

    Turns |date difference| <= days into equality of buckets: a staged row meets the distinct dates of its bucket alone, and
    a main key is not written once for each date that it can collide with.
    """
    width = max(NEAR_BUCKET, 2 * days + 1)
    bucket = lambda day: F.floor(F.unix_date(day) / width)
    reach = F.sequence(bucket(F.date_sub("trade_date", days)), bucket(F.date_add("trade_date", days)))
    keys = main.filter("trade_date IS NOT NULL").groupBy(*_SAME, "trade_date").agg(F.count("*").alias("m")).select(
        *[F.col(c).alias(f"_{c}") for c in (*_SAME, "trade_date")], "m", F.explode(reach).alias("_bucket"))
    on = bucket(F.col("trade_date")) == F.col("_bucket")
    for c in _SAME:
        on = on & (F.col(c) == F.col(f"_{c}"))
    return keys, on & (F.abs(F.datediff("trade_date", "_trade_date")) <= days)


def merge_new_rows(main: DataFrame, staged: DataFrame, days: int = MERGE_DAYS) -> DataFrame:
    """Eligible staged rows without a main row of the same filer, ticker and type within ``days``."""
    return merge_eligible(staged).join(*_near(main, days), "left_anti")


def merge_staging(main: DataFrame, staged: DataFrame, days: int = MERGE_DAYS) -> DataFrame:
    fresh = merge_new_rows(main, staged, days)
    return upsert(main, fresh.select(*main.columns), ["trade_id"], [F.col("trade_date")], "ignore")


def merge_conflicts(main: DataFrame, staged: DataFrame, days: int = MERGE_DAYS) -> DataFrame:
    """Colliding staged rows and (staged, main) pairs, counted without forming the pairs."""
    at = staged.groupBy(*_SAME, "trade_date").agg(F.count("*").alias("n"))
    found = at.join(*_near(main, days)).groupBy(*_SAME, "trade_date", "n").agg(F.sum("m").alias("m"))
    return found.agg(
        F.coalesce(F.sum("n"), F.lit(0)).alias("colliding_rows"), F.coalesce(F.sum(F.col("n") * F.col("m")), F.lit(0)).alias("colliding_pairs")
    )


def colliding_rows(main: DataFrame, staged: DataFrame, days: int = MERGE_DAYS) -> DataFrame:
    return staged.join(*_near(main, days), "left_semi")


def restrict_children(paths: DataFrame, trades: DataFrame, how: str = "keep") -> DataFrame:
    """Child rows of surviving parents (``keep``) or orphans (``orphans``)."""
    kind = {"keep": "left_semi", "orphans": "left_anti"}[how]
    return paths.join(trades.select("trade_id"), "trade_id", kind)


def mark_children(paths: DataFrame, trades: DataFrame) -> DataFrame:
    """Child rows with ``side``: ``keep`` where the parent survives, else ``orphans``; one join for both."""
    alive = trades.select("trade_id").distinct().withColumn("_alive", F.lit(True))
    return paths.join(alive, "trade_id", "left").withColumn("side", F.when(F.col("_alive"), "keep").otherwise("orphans")).drop("_alive")
