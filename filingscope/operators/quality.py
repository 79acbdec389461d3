"""Data-quality gates, coverage, fetch failures and spot checks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from filingscope.functions.rounding import stable_round
from filingscope.operators.flags import is_compliant_buy

MAX_FAILS = 3


def failure_state(log: DataFrame, limit: int = MAX_FAILS) -> DataFrame:
    """Current fetch-failure state per symbol from an attempt log.

    Only the first attempt of a day can add a failure, any success resets the streak, and a symbol
    is skipped from ``limit`` consecutive failing days on.  The log is reduced to one row per
    (symbol, day) before the last success is looked up.
    """
    days = log.groupBy("symbol", "attempt_date").agg(
        F.max(F.when(F.col("ok"), F.col("attempt_no"))).alias("day_ok"),
        F.min(F.struct("attempt_no", "ok")).alias("first"), F.count("*").alias("n"),
    )
    whole = Window.partitionBy("symbol")
    last_ok = F.max("day_ok").over(whole)
    counted = days.withColumn("last_ok", last_ok).withColumn(
        "fail", (~F.col("first.ok") & (F.col("last_ok").isNull() | (F.col("first.attempt_no") > F.col("last_ok")))).cast("int")
    )
    return counted.groupBy("symbol").agg(
        F.sum("fail").alias("consecutive_fails"), F.max("attempt_date").alias("last_attempt")
    ).withColumn("permanently_skipped", F.when(F.col("consecutive_fails") >= limit, 1).otherwise(0))


def coverage(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Populated and NULL counts of columns, one row each, from one aggregate."""
    row = df.agg(F.count("*").alias("_n"), *[F.count(c).alias(c) for c in cols])
    cells = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("populated"), (F.col("_n") - F.col(c)).alias("missing")) for c in cols])
    return row.select(F.explode(cells).alias("r")).select("r.*")


def staging_gates(trades: DataFrame, filers: DataFrame, path_ids: DataFrame, as_of: Column, coverage_pct: float = 85.0) -> DataFrame:
    """Metric, value, threshold, pass and merge blocker, computed in one pass over the trades.

    ``path_ids``: trade_id of trades with a disclosure path.
    """
    t = trades.join(path_ids.select("trade_id", F.lit(1).alias("_path")).distinct(), "trade_id", "left").join(
        filers.select("filer_id", F.col("chamber").alias("_chamber")), "filer_id", "left")
    n = t.agg(
        F.count("*").alias("total"), F.count_if(F.col("transaction_type") == "buy").alias("buys"),
        F.count_distinct("filer_id").alias("filers"), F.count_if(is_compliant_buy()).alias("compliant"),
        F.count_if(F.col("disclosure_date") > as_of).alias("future"), F.count_if(F.col("disclosure_date").isNull()).alias("null_disc"),
        F.count_if(F.coalesce(F.col("asset_type") == "error", F.lit(False))).alias("error_class"),
        F.count_if(is_compliant_buy() & F.col("price_at_disclosure_date").isNotNull()).alias("priced"),
        F.count_if(F.coalesce(F.col("price_fetch_failed"), F.lit(0)) == 1).alias("fetch_failed"),
        F.count_if(F.col("_path") == 1).alias("with_path"),
        F.count_if(is_compliant_buy() & F.col("max_drawdown_disc").isNotNull()).alias("resolved"),
        F.count_if(F.col("filing_violation").isNull()).alias("null_violation"), F.count_if(F.col("asset_type").isNull()).alias("null_class"),
    )
    share = lambda c: F.coalesce(stable_round(F.when(F.col("compliant") > 0, F.col(c) * 100.0 / F.col("compliant")), 4), F.lit(0.0))
    num = lambda c: F.col(c).cast("double")
    # Metric, value, comparison, threshold, blocks the merge.
    gates = [
        ("total trades", num("total"), ">", 1000.0, 0), ("buy trades", num("buys"), ">", 500.0, 0),
        ("filers with trades", num("filers"), ">", 50.0, 0), ("future disclosure dates", num("future"), "=", 0.0, 0),
        ("blank disclosure dates", num("null_disc"), "=", 0.0, 0),
        ("error class pct", stable_round(F.when(F.col("total") > 0, F.col("error_class") * 100.0 / F.col("total")), 4), "<", 5.0, 0),
        ("priced pct", share("priced"), ">=", coverage_pct, 0), ("fetch failed pct", share("fetch_failed"), "<", 15.0, 0),
        ("path pct", share("with_path"), ">=", coverage_pct, 1), ("resolved pct", share("resolved"), ">=", coverage_pct, 1),
        ("NULL violation", num("null_violation"), "=", 0.0, 1), ("NULL class", num("null_class"), "=", 0.0, 1),
    ]
    rows = F.array(*[
        F.struct(F.lit(m).alias("metric"), v.alias("value"), F.lit(op).alias("op"), F.lit(th).alias("threshold"), F.lit(b).alias("blocker"))
        for m, v, op, th, b in gates
    ])
    value, th, op = F.col("value"), F.col("threshold"), F.col("op")
    passed = F.when(op == ">", value > th).when(op == ">=", value >= th).when(op == "<", value < th).otherwise(value == th)
    return n.select(F.explode(rows).alias("g")).select("g.*").withColumn("passed", F.coalesce(passed, F.lit(False)).cast("int"))


def audit_paths(labelled: DataFrame, day1: DataFrame, gap_pct: float = 5.0, barrier: float = 10.0) -> DataFrame:
    """Per disclosure year: day-1 rows already beyond a barrier and day-1 opens above the gap limit.

    ``day1``: ticker, disclosure_date, open, high, low of the first path day.
    """
    close = F.col("price_at_disclosure_date")
    gap = (F.col("open") - close) / close * 100
    wide = F.col("open") > close * (1 + gap_pct / 100)
    return (
        labelled.filter(close > 0).join(day1, ["ticker", "disclosure_date"]).groupBy(F.year("disclosure_date").alias("year")).agg(
            F.count("*").alias("n"),
            F.count_if((F.col("high") >= close * (1 + barrier / 100)) | (F.col("low") <= close * (1 - barrier / 100))).alias("day1_hits"),
            F.count_if(wide).alias("bad_gaps"), stable_round(F.max(F.when(wide, gap)), 2).alias("max_gap_pct"),
        )
    )


def spot_check(trades: DataFrame, n: int = 10, seed: int = 7) -> DataFrame:
    """Reproducible random sample of ``n`` dated buys: the smallest seeded hashes of the id."""
    return trades.filter("transaction_type = 'buy' AND ticker IS NOT NULL AND trade_date IS NOT NULL").orderBy(
        F.md5(F.concat(F.col("trade_id"), F.lit(f"/{seed}"))), "trade_id"
    ).limit(n)


def synthetic_filers(trades: DataFrame, filers: DataFrame, prefixes: Sequence[str] = ("FH_", "FS_")) -> DataFrame:
    """Unmatched filers (synthetic id) with their trade counts."""
    is_synthetic = F.lit(False)
    for p in prefixes:
        is_synthetic = is_synthetic | F.col("filer_id").startswith(p)
    counts = trades.groupBy("filer_id").agg(F.count("*").alias("n_trades"))
    return filers.filter(is_synthetic).join(counts, "filer_id").select("filer_id", "name", "chamber", "n_trades")


def match_totals(trades: DataFrame, filers: DataFrame, prefixes: Sequence[str] = ("FH_", "FS_")) -> DataFrame:
    """Filers and trades by matched / synthetic id."""
    kind = F.lit("matched")
    for p in prefixes:
        kind = F.when(F.col("filer_id").startswith(p), "synthetic").otherwise(kind)
    counts = trades.groupBy("filer_id").agg(F.count("*").alias("n"))
    return filers.select("filer_id").join(counts, "filer_id").groupBy(kind.alias("kind")).agg(
        F.count("*").alias("n_filers"), F.sum("n").alias("n_trades")
    )
