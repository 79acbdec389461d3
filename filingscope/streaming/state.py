"""Keyed streaming state: one value and one timer for each open (filer, ticker) pair."""

from __future__ import annotations

import datetime

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from filingscope.operators.flags import OPEN_POSITION_DAYS

#: Keyed state with timers needs this store.
STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")

FLAGS = T.StructType([T.StructField("trade_id", T.StringType()), T.StructField("repeat_before_close", T.IntegerType()), T.StructField("late", T.IntegerType())])
_EPOCH, _DAY_MS = datetime.date(1970, 1, 1), 86_400_000


class RepeatProcessor(StatefulProcessor):
    """The occupancy rule of one pair: a disclosure repeats if it falls in the position of the last opener.

    State: last day of that position and last disclosure seen.  A timer at the end of the position clears it; a disclosure
    after that opens a new one with or without the state, so only open pairs are held.
    """

    def __init__(self, cap_days: int) -> None:
        self.cap_days = cap_days

    def init(self, handle) -> None:
        self.handle = handle
        self.position = handle.getValueState("position", "closes int, seen int")

    def handleInputRows(self, key, rows, timerValues):
        closes, seen = self.position.get() if self.position.exists() else (None, None)
        before, known = closes, seen
        held = sorted(
            ((d - _EPOCH).days, i, None if c is None or c is pd.NaT else (c - _EPOCH).days)
            for part in rows for i, d, c in zip(part["trade_id"], part["disclosure_date"], part["close_date_disc"]))
        out = []
        for day, trade, close in held:
            if known is not None and day < known:
                out.append((trade, None, 1))
                continue
            repeats = closes is not None and day <= closes
            if not repeats:
                closes = close if close is not None else day + self.cap_days
            seen = day
            out.append((trade, int(repeats), 0))
        if seen is not None:
            self.position.update((closes, seen))
        if closes is not None and closes != before:
            self.handle.registerTimer((closes + 1) * _DAY_MS)
        yield pd.DataFrame({
            "trade_id": [r[0] for r in out], "repeat_before_close": pd.array([r[1] for r in out], "Int32"), "late": pd.array([r[2] for r in out], "Int32")})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        if self.position.exists() and (self.position.get()[0] + 1) * _DAY_MS <= expiredTimerInfo.getExpiryTimeInMs():
            self.position.clear()
        return iter([])

    def close(self) -> None:
        pass


def repeat_flags(sdf: DataFrame, event_time: str, watermark: str, cap_days: int = OPEN_POSITION_DAYS) -> DataFrame:
    """trade_id, repeat_before_close, late of a stream of buys (trade_id, filer_id, ticker, disclosure_date, close_date_disc).

    Equal to the batch fold for rows that arrive in time; rows older than the watermark are dropped by Spark, rows older than
    one already seen of their pair come back ``late`` without a flag.  A micro-batch holds its rows of one pair together, so
    the slices that the source hands out bound the memory.  The session needs the store of ``STORE``.
    """
    rows = sdf.withWatermark(event_time, watermark).select("trade_id", "filer_id", "ticker", "disclosure_date", "close_date_disc", F.col(event_time).alias("at"))
    return rows.groupBy("filer_id", "ticker").transformWithStateInPandas(RepeatProcessor(cap_days), FLAGS, "Append", "EventTime")


def sessions(df: DataFrame, event_time: str, by: str, gap: str, watermark: str | None = None) -> DataFrame:
    """Bursts of a key: events not more than ``gap`` apart, with their number, begin and end (last event plus gap).

    On a stream a burst is emitted once, when the watermark has passed its end; late rows within the watermark still join
    and merge bursts.
    """
    rows = df.withWatermark(event_time, watermark) if watermark else df
    found = rows.groupBy(F.session_window(event_time, gap).alias("burst"), by).agg(F.count("*").alias("n"))
    return found.select(by, F.col("burst.start").alias("begins"), F.col("burst.end").alias("ends"), "n")


def matched(left: DataFrame, right: DataFrame, by: str, minutes: int, watermark: str) -> DataFrame:
    """Rows of ``left`` (``by``, id, at) with each row of ``right`` (``by``, other, seen) up to ``minutes`` later, else NULL.

    On streams both sides are held until the watermark passes their time bound; then rows of ``left`` without a match come out.
    """
    a, b = left, right
    if left.isStreaming:
        a, b = left.withWatermark("at", watermark), right.withWatermark("seen", watermark)
    b = b.withColumnRenamed(by, "_by")
    near = (F.col("seen") >= F.col("at")) & (F.col("seen") <= F.col("at") + F.expr(f"INTERVAL {minutes} MINUTES"))
    return a.join(b, (F.col(by) == F.col("_by")) & near, "left_outer").select("id", by, "other")
