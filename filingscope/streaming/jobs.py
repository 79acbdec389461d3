"""Structured Streaming forms of the incremental steps.

Each job gives the result of its batch operator on the same rows; sinks are idempotent per micro-batch,
so a replay after a lost executor or a restart changes nothing.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from filingscope.operators.clusters import WINDOW_DAYS, cluster_count_td
from filingscope.operators.flags import OPEN_POSITION_DAYS, flag_signals, new_signals, occupancy
from filingscope import schemas


def stream_dedup(sdf: DataFrame, event_time: str, key: str, watermark: str) -> DataFrame:
    """First arrival per id; state is dropped once ids are older than the watermark."""
    return sdf.withWatermark(event_time, watermark).dropDuplicatesWithinWatermark([key])


def stream_daily_counts(sdf: DataFrame, event_time: str, by: str, watermark: str) -> DataFrame:
    """Arrivals per day and type; a day is emitted once, when the watermark has passed its end."""
    return sdf.withWatermark(event_time, watermark).groupBy(F.window(event_time, "1 day"), by).agg(
        F.count("*").alias("n")
    ).select(F.col("window.start").cast("date").alias("day"), by, "n")


REPEAT_STATE = T.StructType([
    T.StructField("filer_id", T.StringType()), T.StructField("ticker", T.StringType()),
    T.StructField("closes", T.IntegerType()), T.StructField("seen", T.IntegerType()),
])


def start_repeat_stream(
    sdf: DataFrame, *, rows: str, state: str, out: str, checkpoint: str, cap_days: int = OPEN_POSITION_DAYS,
) -> StreamingQuery:
    """Occupancy rule per micro-batch: each (filer, ticker) continues from the close of its last opener.

    Rows are flagged in disclosure order within a micro-batch; rows older than an already processed disclosure of their
    pair come back with ``late`` = 1 and no flag.  ``rows``, ``state`` and ``out`` are tables partitioned by batch id; a
    batch overwrites only its own partition and reads only earlier states, so replays are exact.  Input: trade_id,
    filer_id, ticker, disclosure_date, close_date_disc.
    """
    spark, schema = sdf.sparkSession, sdf.schema
    spark.createDataFrame([], REPEAT_STATE).write.mode("ignore").parquet(f"{state}/batch_id=-1")

    def step(batch: DataFrame, batch_id: int) -> None:
        session = batch.sparkSession
        batch.write.mode("overwrite").parquet(f"{rows}/batch_id={batch_id}")
        fresh = session.read.schema(schema).parquet(f"{rows}/batch_id={batch_id}")
        known = _batch_table(session, state, REPEAT_STATE).filter(F.col("batch_id") < batch_id)
        known = known.groupBy("filer_id", "ticker").agg(F.max_by(F.struct("closes", "seen"), "batch_id").alias("s")).select("filer_id", "ticker", "s.*")
        timed = fresh.join(known, ["filer_id", "ticker"], "left").withColumn("late", F.coalesce(F.unix_date("disclosure_date") < F.col("seen"), F.lit(False)).cast("int"))
        on_time = timed.filter("late = 0").select(*fresh.columns)
        occupied = occupancy(on_time, cap_days, known)
        opens = occupied.select(F.explode("ids").alias("trade_id"), F.lit(0).alias("repeat_before_close"))
        flagged = on_time.join(opens, "trade_id", "left").select("trade_id", F.coalesce("repeat_before_close", F.lit(1)).alias("repeat_before_close"), F.lit(0).alias("late"))
        behind = timed.filter("late = 1").select("trade_id", F.lit(None).cast("int").alias("repeat_before_close"), "late")
        flagged.unionByName(behind).write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        occupied.select("filer_id", "ticker", "closes", "seen").write.mode("overwrite").parquet(f"{state}/batch_id={batch_id}")

    return sdf.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def _batch_table(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(T.StructType([*schema.fields, T.StructField("batch_id", T.LongType())])).parquet(path)


def start_signal_stream(
    sdf: DataFrame, filers: DataFrame, *, history: str, ledger: str, out: str, checkpoint: str,
    days: int = WINDOW_DAYS,
) -> StreamingQuery:
    """Flag new disclosures per micro-batch and announce each signal once.

    ``history``, ``ledger`` and ``out`` are tables partitioned by batch id; a batch overwrites only
    its own partition and reads only earlier ones, so replays are exact.  The history read back is
    limited to trade dates the cluster window can reach.  Input: qualifying buys with trade columns
    and abs_pct_move_before_disclosure.
    """
    spark, schema = sdf.sparkSession, sdf.schema
    spark.createDataFrame([], schema).write.mode("ignore").parquet(f"{history}/batch_id=-1")
    spark.createDataFrame([], schemas.SIGNAL_LEDGER).write.mode("ignore").parquet(f"{ledger}/batch_id=-1")

    def step(rows: DataFrame, batch_id: int) -> None:
        session = rows.sparkSession
        rows.write.mode("overwrite").parquet(f"{history}/batch_id={batch_id}")
        known = _batch_table(session, history, schema).filter(F.col("batch_id") <= batch_id)
        fresh = known.filter(F.col("batch_id") == batch_id)
        span = fresh.agg(F.min("trade_date"), F.max("trade_date")).first()
        if span[0] is None:
            return
        near = known.filter(
            (F.col("trade_date") >= F.date_sub(F.lit(span[0]), days)) & (F.col("trade_date") <= F.date_add(F.lit(span[1]), days))
        ).drop("batch_id")
        counted = cluster_count_td(near, days).join(fresh.select("trade_id"), "trade_id", "left_semi")
        noted = _batch_table(session, ledger, schemas.SIGNAL_LEDGER).filter(F.col("batch_id") < batch_id)
        signals = new_signals(flag_signals(counted), filers, noted)
        signals.write.mode("overwrite").parquet(f"{out}/batch_id={batch_id}")
        session.read.parquet(f"{out}/batch_id={batch_id}").select("trade_id", F.current_timestamp().alias("notified_at")).write.mode(
            "overwrite").parquet(f"{ledger}/batch_id={batch_id}")

    return sdf.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
