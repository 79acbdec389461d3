"""The occupancy stream against the batch operator, with several micro-batches and late rows."""

import datetime

from filingscope.operators.flags import flag_repeats
from filingscope.streaming.jobs import start_repeat_stream

SCHEMA = "trade_id string, filer_id string, ticker string, disclosure_date date, close_date_disc date"


def _day(n):
    return datetime.date(2024, 1, 1) + datetime.timedelta(days=n)


def _run(spark, tmp_path, batches):
    source = str(tmp_path / "in")
    for rows in batches:
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(source)
    sdf = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(source)
    where = {k: str(tmp_path / k) for k in ("rows", "state", "out", "checkpoint")}
    start_repeat_stream(sdf, **where, cap_days=10).awaitTermination()
    return {r.trade_id: (r.repeat_before_close, r.late) for r in spark.read.parquet(where["out"]).collect()}


def test_occupancy_across_batches(spark, tmp_path):
    rows = [(f"t{k:02d}", "f", "ab"[k % 2], _day(k * 2), _day(k * 2 + 1 + k % 9) if k % 4 else None) for k in range(30)]
    got = _run(spark, tmp_path, [rows[:7], rows[7:8], rows[8:21], rows[21:]])
    want = {r.trade_id: (r.repeat_before_close, 0) for r in flag_repeats(spark.createDataFrame(rows, SCHEMA), 10).collect()}
    assert got == want and {f for f, _ in got.values()} == {0, 1}


def test_late_rows_get_no_flag(spark, tmp_path):
    got = _run(spark, tmp_path, [[("a", "f", "x", _day(20), _day(25))], [("b", "f", "x", _day(5), _day(6)), ("c", "f", "x", _day(22), None), ("d", "g", "x", _day(1), None)]])
    assert got == {"a": (0, 0), "b": (None, 1), "c": (1, 0), "d": (0, 0)}
