"""Prices stored for look-ups: bucketed by (symbol, block of days), so that as-of joins move only their own keys.

A row says what holds from one price day until the next.  It is stored in every block that this span touches, and spans
reach from the first to the last block of the book: each (symbol, day) meets exactly one row of its own block.  A hot symbol
is dealt over its blocks, and a block holds at most ``BLOCK_DAYS`` rows and the one carried into it.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BLOCK_DAYS = 32


@dataclass(frozen=True)
class PriceBook:
    """Name of the stored table and the blocks that it spans; days outside meet its first or last block."""

    table: str
    first_block: int
    last_block: int

    def block_of(self, day: Column) -> Column:
        return F.least(F.greatest(_block(day), F.lit(self.first_block)), F.lit(self.last_block))


def _block(day: Column) -> Column:
    return F.floor(F.unix_date(day) / BLOCK_DAYS).cast("int")


def spans(prices: DataFrame, first_block: int, last_block: int) -> DataFrame:
    """One row per price day and block: its number ``idx``, ``close``, the last known close and the next open.

    Before the first day idx is 0, the closes are NULL and ``next_open`` is the first open.  Rows without symbol or date are left
    out; of rows with one symbol and day the last counts.
    """
    by_day = Window.partitionBy("symbol").orderBy("date")
    rows = prices.filter("symbol IS NOT NULL AND date IS NOT NULL").select(
        "symbol", F.col("date").alias("valid_from"), F.lead("date").over(by_day).alias("valid_until"), F.row_number().over(by_day).alias("idx"),
        "close", F.last("close", ignorenulls=True).over(by_day).alias("asof_close"), F.lead("open").over(by_day).alias("next_open"), "open")
    none = F.lit(None).cast("double")
    before = F.struct(
        F.lit(None).cast("date").alias("valid_from"), F.col("valid_from").alias("valid_until"), F.lit(0).alias("idx"),
        none.alias("close"), none.alias("asof_close"), F.col("open").alias("next_open"))
    own = F.struct("valid_from", "valid_until", "idx", "close", "asof_close", "next_open")
    each = rows.select("symbol", F.explode(F.when(F.col("idx") == 1, F.array(before, own)).otherwise(F.array(own))).alias("r")).select("symbol", "r.*")
    begin = F.coalesce(_block(F.col("valid_from")), F.lit(first_block))
    end = F.coalesce(_block(F.date_sub("valid_until", 1)), F.lit(last_block))
    kept = each.filter("valid_from IS NULL OR valid_until IS NULL OR valid_from < valid_until")
    return kept.withColumn("block", F.explode(F.sequence(begin, F.greatest(begin, end))))


def save_price_book(prices: DataFrame, table: str, path: str, buckets: int | None = None) -> PriceBook:
    """Write ``prices`` as the bucketed table ``table`` under ``path``, one sorted file a bucket.

    ``buckets`` defaults to the session's shuffle partitions; with fewer Spark may rather shuffle both sides.
    An empty price table gives an empty book.
    """
    spark = prices.sparkSession
    buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
    first, last = prices.agg(F.min(_block(F.col("date"))), F.max(_block(F.col("date")))).first()
    book = PriceBook(table, first or 0, last or 0)
    rows = spans(prices, book.first_block, book.last_block).repartition(buckets, "symbol", "block")
    rows.write.bucketBy(buckets, "symbol", "block").sortBy("symbol", "block", "idx").option("path", path).saveAsTable(table)
    return book


def _looked_up(keys: DataFrame, book: PriceBook) -> DataFrame:
    """Distinct (symbol, date) keys with the row of the book that holds on that day, if the symbol is known."""
    rows = keys.sparkSession.table(book.table).alias("b")
    wanted = keys.withColumn("block", book.block_of(F.col("date"))).alias("k")
    holds = (
        (F.col("k.symbol") == F.col("b.symbol")) & (F.col("k.block") == F.col("b.block"))
        & (F.col("b.valid_from").isNull() | (F.col("b.valid_from") <= F.col("k.date")))
        & (F.col("b.valid_until").isNull() | (F.col("k.date") < F.col("b.valid_until")))
    )
    return wanted.join(rows, holds, "left").select("k.symbol", "k.date", "b.idx", "b.close", "b.asof_close", "b.next_open")


def asof_in_book(left: DataFrame, book: PriceBook, on: str, by: str = "ticker", out: str = "asof_close") -> DataFrame:
    """Last known close on or before ``left[on]``; NULL without an earlier one, or without symbol or date."""
    keys = left.select(F.col(by).alias("symbol"), F.col(on).alias("date")).dropna().distinct()
    found = _looked_up(keys, book).select(F.col("symbol").alias(by), F.col("date").alias(on), F.col("asof_close").alias(out))
    return left.join(found, [by, on], "left")


def entries_in_book(keys: DataFrame, book: PriceBook) -> DataFrame:
    """Entry price per distinct (symbol, anchor_date): ``prices.anchor_entries`` without a pass over the prices."""
    found = _looked_up(keys.select("symbol", F.col("anchor_date").alias("date")).dropna().distinct(), book)
    return found.select(
        "symbol", F.col("date").alias("anchor_date"), F.col("idx").alias("start_idx"), F.col("close").alias("anchor_close"),
        F.col("next_open").alias("day1_open"), F.coalesce(F.when(F.col("next_open") > 0, F.col("next_open")), F.col("close")).alias("entry_price"))
