"""Session defaults.  A cluster's own settings always win; these only fill gaps."""

from __future__ import annotations

import contextlib
import tempfile
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

DEFAULTS = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}


def build_session(app: str = "filingscope", master: str | None = None, **conf: str) -> SparkSession:
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    for key, value in {**DEFAULTS, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """Folder all executors can reach; a scratch folder only in local mode without a setting."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder all executors share")
        folder = tempfile.mkdtemp(prefix="filingscope-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


#: Spark removes the shuffle files of an execution that begins under this setting when it ends.
FREED = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextlib.contextmanager
def freeing_shuffles(spark: SparkSession) -> Iterator[None]:
    before = spark.conf.get(FREED, None)
    if before is None:
        spark.conf.set(FREED, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(FREED)


def materialize(df: DataFrame) -> DataFrame:
    """Write an intermediate used by several consumers once, as a table in the shared folder.

    Unlike an RDD checkpoint the result keeps column pruning, filter pushdown and size statistics.  What was shuffled for it is
    needed by nothing else and leaves the disk when it is written, so that a chain of tables holds one step's shuffles at a time.
    """
    path = f"{shared_folder(df.sparkSession).rstrip('/')}/filingscope/{uuid.uuid4().hex}"
    with freeing_shuffles(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
