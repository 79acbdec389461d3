"""Inputs, written intermediates and checked broadcasts shared by the operators."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.session import shared_folder

#: A side of a join is broadcast only when it was counted and has at most this many narrow rows.
BROADCAST_ROWS = 200_000


#: Rows of an Arrow batch, where the session has Spark's default: texts may be long.
BATCH_ROWS = 2000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh_folder(spark: SparkSession, name: str) -> str:
    """A folder that no other run uses, below the one all executors share."""
    return f"{shared_folder(spark).rstrip('/')}/llm/{name}-{uuid.uuid4().hex}"


def save(df: DataFrame, name: str, by: list[str] | None = None) -> DataFrame:
    """Write ``df`` once and read it again: lineage ends here and lost executors lose nothing."""
    path = fresh_folder(df.sparkSession, name)
    writer = df.write.partitionBy(*by) if by else df.write
    writer.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def narrow(side: DataFrame, rows: int | None = None) -> DataFrame:
    """``side`` marked for a broadcast if it is small enough; otherwise left to a shuffle join."""
    n = side.count() if rows is None else rows
    return F.broadcast(side) if n <= BROADCAST_ROWS else side


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until no column of ``df`` has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def row_text(batch, name: str = "text"):
    """Text column of an Arrow batch with nulls as empty texts."""
    import pyarrow.compute as pc

    return pc.fill_null(batch.column(name), "")
