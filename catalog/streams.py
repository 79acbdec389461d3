"""Streaming jobs over landed slices, each equal to its batch operator.

Rows are landed in time order, a few files a slice, and read one slice per micro-batch.
"""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import functions as F

from catalog import base, signals as signal_queries
from catalog.base import CTES, with_ctes
from filingscope.operators import flags, prices
from filingscope.session import materialize, shared_folder
from filingscope.streaming import jobs

START, DAYS, SLICES = datetime.datetime(2024, 1, 1), 6, 5
#: Files that a slice is landed as.
FILES = 4


def root(s):
    return f"{shared_folder(s).rstrip('/')}/filingscope/stream-{uuid.uuid4().hex}"


def landed(s, rows, parts, folder):
    """Write the given predicates' rows one after the other and stream them slice by slice."""
    for part in parts:
        rows.filter(part).repartition(FILES).write.mode("append").parquet(folder)
    return s.readStream.schema(rows.schema).option("maxFilesPerTrigger", FILES).parquet(folder)


def event_slices(overlap_days=0):
    """Slices of DAYS days; the first has no beginning and the last no end."""
    at = lambda days: F.lit(START + datetime.timedelta(days=days)).cast("timestamp")
    begins = lambda i: F.col("ts") >= at(i * DAYS) if i else F.lit(True)
    ends = lambda i: F.col("ts") < at((i + 1) * DAYS + overlap_days) if i < SLICES - 1 else F.lit(True)
    return [begins(i) & ends(i) for i in range(SLICES)]


def events(s, d):
    return base.table(s, d, "events").withColumn("ts", F.col("ts").cast("timestamp"))


def drain(s, sdf, where):
    query = sdf.writeStream.format("parquet").option("checkpointLocation", f"{where}/checkpoint").trigger(availableNow=True).start(f"{where}/out")
    query.awaitTermination()
    return s.read.schema(sdf.schema).parquet(f"{where}/out")


def dedup(s, d):
    where = root(s)
    sdf = landed(s, events(s, d).select("event_id", "ts", "event_type"), event_slices(1), f"{where}/in")
    return drain(s, jobs.stream_dedup(sdf, "ts", "event_id", "2 days"), where).select("event_id", "event_type")


def daily(s, d):
    where = root(s)
    sdf = landed(s, events(s, d).select("event_id", "ts", "event_type"), event_slices(), f"{where}/in")
    return drain(s, jobs.stream_daily_counts(sdf, "ts", "event_type", "1 day"), where)


def purchases(s, d):
    v = F.floor("value")
    day = F.col("ts").cast("date")
    return events(s, d).filter("event_type = 'purchase'").select(
        F.col("event_id").cast("string").alias("trade_id"), F.col("user_id").cast("string").alias("filer_id"),
        (F.get_json_object("props", "$.k").cast("int") % 5).cast("string").alias("ticker"), day.alias("disclosure_date"),
        F.when(v % 5 > 0, F.date_add(day, (v % 12 + 1).cast("int"))).alias("close_date_disc"), "ts")


def repeats(s, d):
    where = root(s)
    sdf = landed(s, purchases(s, d), event_slices(), f"{where}/in")
    query = jobs.start_repeat_stream(sdf, rows=f"{where}/rows", state=f"{where}/state", out=f"{where}/out", checkpoint=f"{where}/checkpoint", cap_days=10)
    query.awaitTermination()
    return s.read.parquet(f"{where}/out").select("trade_id", "repeat_before_close", "late")


def signal_rows(s, d):
    rows = flags.qualifying_buys(base.labelled(s, d), ["stock"])
    rows = prices.with_pre_disclosure_move(prices.asof_join(rows, base.prices(s, d), "trade_date", out="price_at_trade_date"))
    return materialize(rows.select(
        "trade_id", "filer_id", "ticker", "trade_date", "disclosure_date", "transaction_type", "filing_violation", "asset_type", "abs_pct_move_before_disclosure"))


def signals(s, d):
    where = root(s)
    years = [F.year("disclosure_date") < 1997, *[F.year("disclosure_date") == y for y in (1997, 1998, 1999, 2000)], F.year("disclosure_date") > 2000]
    sdf = landed(s, signal_rows(s, d), years, f"{where}/in")
    query = jobs.start_signal_stream(
        sdf, base.filers(s, d), history=f"{where}/history", ledger=f"{where}/ledger", out=f"{where}/signals", checkpoint=f"{where}/checkpoint")
    query.awaitTermination()
    return s.read.parquet(f"{where}/signals").select("trade_id", "name", "cluster_count_td", "report")


QUERIES = {
    "stream_dedup": dedup,
    "stream_daily_counts": daily,
    "stream_repeat": repeats,
    "stream_signals": signals,
}

CTES["purchases"] = (
    (),
    """SELECT CAST(event_id AS VARCHAR) AS trade_id, CAST(user_id AS VARCHAR) AS filer_id, CAST(CAST(json_extract_string(props, '$.k') AS INT) % 5 AS VARCHAR) AS ticker, CAST(ts AS DATE) AS dd,
         CASE WHEN CAST(floor(value) AS BIGINT) % 5 > 0 THEN CAST(ts AS DATE) + CAST(CAST(floor(value) AS BIGINT) % 12 + 1 AS INT) ELSE CAST(ts AS DATE) + 10 END AS closes,
         row_number() OVER (PARTITION BY user_id, CAST(json_extract_string(props, '$.k') AS INT) % 5 ORDER BY CAST(ts AS DATE), CAST(event_id AS VARCHAR)) AS rn
       FROM events WHERE event_type = 'purchase'""",
)
CTES["p_walk"] = (
    ("purchases",),
    """SELECT filer_id, ticker, rn, trade_id, closes, 0 AS flag FROM purchases WHERE rn = 1
       UNION ALL SELECT p.filer_id, p.ticker, p.rn, p.trade_id, CASE WHEN p.dd <= w.closes THEN w.closes ELSE p.closes END, CASE WHEN p.dd <= w.closes THEN 1 ELSE 0 END
       FROM p_walk w JOIN purchases p ON p.filer_id = w.filer_id AND p.ticker = w.ticker AND p.rn = w.rn + 1""",
)

ORACLES = {
    "stream_dedup": "SELECT event_id, event_type FROM events",
    "stream_daily_counts": """SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n FROM events
        WHERE CAST(CAST(ts AS DATE) + 1 AS TIMESTAMP) <= (SELECT max(ts) - INTERVAL 1 DAY FROM events) GROUP BY 1, 2""",
    "stream_repeat": with_ctes("SELECT trade_id, flag AS repeat_before_close, 0 AS late FROM p_walk", "p_walk"),
}


def late_oracles() -> dict[str, str]:
    return {
        "stream_signals": with_ctes(
            """SELECT m.trade_id, f.name, s.cluster_count_td, CAST(year(m.disclosure_date) > (SELECT min(greatest(year(disclosure_date), 1996)) FROM flagged) AS INT) AS report
               FROM flagged s JOIN qualifying m ON m.trade_id = s.trade_id JOIN filers f ON f.filer_id = m.filer_id""",
            "qualifying", "moves", "filers", extra={
                "flagged": """SELECT a.trade_id, any_value(a.disclosure_date) AS disclosure_date, count(b.trade_id) AS cluster_count_td
                    FROM (SELECT q.* FROM qualifying q JOIN moves v ON v.trade_id = q.trade_id WHERE q.asset_type = 'stock' AND v.abs_pct_move_before_disclosure >= 15) a
                    JOIN qualifying b ON b.asset_type = 'stock' AND b.ticker = a.ticker AND b.filer_id <> a.filer_id AND b.trade_date BETWEEN a.trade_date - 30 AND a.trade_date + 30
                      AND b.disclosure_date < a.disclosure_date GROUP BY a.trade_id HAVING count(b.trade_id) >= 2"""}),
    }
