"""Folded price slices, sweeps, snapshot histories, id chains, cubes and keyed streams against plain versions."""

import datetime
import os
import random
import shutil
import subprocess
import sys
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from filingscope.operators import barriers, committees, positions, prices, resolve, touches
from filingscope.plans import night, reports
from filingscope.streaming import state

D0 = datetime.date(2020, 1, 1)


def day(k):
    return D0 + datetime.timedelta(days=k)


@pytest.fixture(scope="module")
def market(spark):
    r = random.Random(8)
    rows = []
    for symbol in "abc":
        close = 100.0
        for k in range(5, 160):
            if r.random() < 0.6:
                open_, close = close * r.uniform(0.97, 1.03), close * r.uniform(0.96, 1.045)
                hole = r.random() < 0.1
                rows.append((symbol, day(k), open_, None if hole else max(open_, close) * 1.01, None if hole else min(open_, close) * 0.99, close))
    keys = [(s, day(k)) for s in "abcd" for k in range(0, 165, 3)]
    return (spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double").cache(),
            spark.createDataFrame(keys, "symbol string, anchor_date date").cache())


@pytest.mark.parametrize("cuts", [[], [60], [3, 4, 40, 41, 90]])
def test_folded_slices_equal_one_pass(spark, market, cuts):
    quotes_of, keys = market
    open_, quotes, done = spark.createDataFrame([], touches.SUMMARY), spark.createDataFrame([], touches.QUOTES), []
    for begin, end in zip([None, *cuts], [*cuts, None]):
        cut = lambda c: (F.lit(True) if begin is None else F.col(c) > F.lit(day(begin))) & (F.lit(True) if end is None else F.col(c) <= F.lit(day(end)))  # noqa: E731,B023
        now = touches.fold_slice(open_, quotes, keys.filter(cut("anchor_date")), quotes_of.filter(cut("date")))
        found = now.collect()
        quotes = spark.createDataFrame(touches.last_quotes(quotes, quotes_of.filter(cut("date"))).collect(), touches.QUOTES)
        done += [x for x in found if x.stop is not None or x.target is not None]
        open_ = spark.createDataFrame([x for x in found if x.stop is None and x.target is None], touches.SUMMARY)
    whole = open_.unionByName(spark.createDataFrame(done, touches.SUMMARY))
    columns = ["symbol", "anchor_date", "entry_price", "outcome", "days_to_exit", "exit_date", "max_drawdown", "hit_5pct"]
    got = sorted(map(tuple, touches.summary_labels(whole).select(*columns).collect()), key=str)
    want = sorted(map(tuple, barriers.label_anchors(keys, quotes_of).select(*columns).collect()), key=str)
    assert got == want and {x[3] for x in want} == {"win", "loss", "open"}


def test_nights_catch_up_late_disclosures(spark, market, monkeypatch):
    """Disclosures in any order of arrival, some of them nights late or twice, end with the labels of one pass."""
    monkeypatch.setattr(night, "PARTS", 2)
    quotes_of, keys = market
    buys = keys.select(F.monotonically_increasing_id().alias("trade_id"), F.col("symbol").alias("ticker"), F.col("anchor_date").alias("disclosure_date"))
    buys = spark.createDataFrame([*buys.collect(), (9000, "a", None), (9001, None, day(9)), (9002, "b", day(30))], "trade_id long, ticker string, disclosure_date date")
    state = night.State.empty(spark)
    for k, end in enumerate([day(20), day(21), day(90)]):
        seen = buys.filter(F.col("disclosure_date") <= F.date_sub(F.lit(end), 1)).filter(f"(trade_id + {k}) % 3 <> 0")
        state = night.advance(state, seen, quotes_of, end)
    state = night.advance(state, buys, quotes_of)
    columns = ["trade_id", "price_at_disclosure_date", "day1_open", "entry_price", "outcome", "days_to_exit_disc", "close_date_disc", "max_drawdown_disc", "drawdown_disc_5pct"]
    got = sorted(map(tuple, night.labels(state, buys).select(*columns).collect()))
    want = sorted(map(tuple, barriers.label_disclosures(buys, quotes_of).select(*columns).collect()))
    assert got == want and {x[4] for x in want} == {"win", "loss", "open", None}


def test_nearest_price_of_each_day(market):
    quotes_of, _ = market
    own = {}
    for q in quotes_of.collect():
        own.setdefault(q.symbol, {})[q.date] = q.close
    want = {}
    for s, days in own.items():
        for k in range(-10, 200):
            at = day(k)
            later = [d for d in sorted(days) if 0 <= (d - at).days <= 5]
            earlier = [d for d in sorted(days) if 0 < (at - d).days <= 3]
            if later or earlier:
                want[s, at] = days[later[0] if later else earlier[-1]]
    rows = prices.nearest_days(quotes_of).collect()
    assert len(rows) == len(want) and {(x.symbol, x.date): x.close for x in rows} == want


def test_later_days_deal_a_symbol_over_buckets(market, monkeypatch):
    quotes_of, keys = market
    indexed = prices.index_prices(quotes_of)
    anchors = prices.anchor_entries(keys, indexed).filter("start_idx IS NOT NULL")
    want = anchors.join(indexed.withColumnRenamed("symbol", "p"), (F.col("symbol") == F.col("p")) & (F.col("idx") > F.col("start_idx"))).count()
    monkeypatch.setattr(prices, "PATH_BUCKET", 20)
    got = prices.later_days(anchors, indexed)
    assert got.count() == want == got.dropDuplicates(["symbol", "anchor_date", "idx"]).count()
    assert "p_bucket" in got._jdf.queryExecution().executedPlan().toString()


def test_open_positions(spark):
    r = random.Random(2)
    rows = [("hot" if r.random() < 0.7 else "x", day(a := r.randrange(300)), None if r.random() < 0.2 else day(a + r.randrange(90)), r.randrange(1, 9)) for _ in range(400)]
    df = spark.createDataFrame([*rows, ("x", None, None, 5)], "ticker string, opens date, closes date, weight long")
    for by in ("ticker", None):
        got = {(x.key, x.day): (x.n_open, x.exposure) for x in positions.open_positions(df, by, 16).collect()}
        key = lambda t: t if by else "*"
        days = {(key(t), d) for t, a, b, _ in rows for d in (a, b and b + datetime.timedelta(days=1)) if d}
        assert set(got) == days
        for k, d in days:
            own = [w for t, a, b, w in rows if key(t) == k and a <= d and (b is None or b >= d)]
            assert got[k, d] == (len(own), sum(own))


def test_snapshot_history(spark):
    shots = [{("a", "x"), ("b", None)}, {("a", "x")}, {("b", None), ("c", "y")}, {("a", "x"), ("b", None)}, set()]
    history = spark.createDataFrame([], "f string, c string, valid_from date, valid_to date")
    for k, rows in enumerate(shots):
        snap = spark.createDataFrame([*rows, *rows], "f string, c string")
        history = spark.createDataFrame(committees.advance_history(history, snap, F.lit(day(k)), ["f", "c"]).collect(), history.schema)
    assert sorted(map(tuple, history.collect()), key=str) == sorted([
        ("a", "x", day(0), day(2)), ("a", "x", day(3), day(4)), ("b", None, day(0), day(1)), ("b", None, day(2), day(4)), ("c", "y", day(2), day(3))], key=str)


def test_chains_of_ids(spark):
    rows = [(k, k + 1) for k in range(1000)] + [(2000, 2001), (2001, 2002), (2002, 2000), (1999, 2000), (3000, 3000), (4000, 4002), (4000, 4001), (None, 1), (5, None)]
    got = {x.old_id: tuple(x)[1:] for x in resolve.resolve_chains(spark.createDataFrame(rows, "old_id long, new_id long")).collect()}
    want = {k: (1000, 1000 - k, False) for k in range(1000)} | {k: (None, None, True) for k in (1999, 2000, 2001, 2002, 3000)} | {4000: (4001, 1, False)}
    assert got == want
    assert resolve.resolve_chains(spark.createDataFrame([], "old_id long, new_id long")).collect() == []


def test_cube_tells_nulls_from_totals(spark):
    rows = [("1", "R", "H", 2020, "win"), ("1", "R", "H", 2020, "loss"), ("2", None, "H", 2021, "win"), ("3", None, "S", 2021, "open")]
    cube = reports.outcome_cube(spark.createDataFrame(rows, "filer_id string, party string, chamber string, year int, outcome string"))
    got = {(x.level, x.party, x.chamber, x.year): (x.n, x.wins, x.filers) for x in cube.collect()}
    assert got[7, None, None, None] == (4, 2, 3) and got[3, None, None, None] == (2, 1, 2) and got[3, "R", None, None] == (2, 1, 1)
    assert got[0, "R", "H", 2020] == (2, 1, 1) and got[5, None, "H", None] == (3, 2, 2) and len({k[0] for k in got}) == 8


def test_keyed_state_survives_a_restart_and_is_dropped(spark, tmp_path):
    spark.conf.set(*state.STORE)
    at = lambda k: datetime.datetime(2020, 1, 1, 12) + datetime.timedelta(days=k)
    schema = "trade_id string, filer_id string, ticker string, disclosure_date date, close_date_disc date, ts timestamp"
    rows = [(str(i), f"f{i // 30 * 9 + i % 9}", "t", day(i // 2), None if i % 3 else day(i // 2 + 4), at(i // 2)) for i in range(240)]
    held = []
    for part in (rows[:100], rows[100:180], rows[180:]):
        spark.createDataFrame(part, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        sdf = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
        q = state.repeat_flags(sdf, "ts", "1 day", 10).writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
        q.awaitTermination()
        held.append(q.lastProgress)
    want, closes = {}, {}
    for i, f, _, d, c, _ in rows:
        repeats = f in closes and d <= closes[f]
        if not repeats:
            closes[f] = c or d + datetime.timedelta(days=10)
        want[i] = (int(repeats), 0)
    assert {x.trade_id: (x.repeat_before_close, x.late) for x in spark.read.schema(state.FLAGS).parquet(f"{tmp_path}/out").collect()} == want
    assert {v[0] for v in want.values()} == {0, 1}
    # Positions that ended before the watermark hold no state: fewer pairs than ever came.
    pairs = spark.read.format("statestore").option("stateVarName", "position").load(f"{tmp_path}/c").count()
    assert 0 < pairs < len(closes) / 2


def test_sessions_on_a_stream_equal_the_batch(spark, tmp_path):
    r = random.Random(6)
    at = lambda m: datetime.datetime(2020, 1, 1) + datetime.timedelta(minutes=m)
    rows = [(f"u{r.randrange(5)}", at(r.randrange(4000))) for _ in range(300)]
    end = [("u9", at(20_000))]
    for k, part in enumerate((rows[::2], rows[1::2], end)):  # the second file is late as a whole
        spark.createDataFrame(part, "u string, ts timestamp").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    sdf = spark.readStream.schema("u string, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    found = state.sessions(sdf, "ts", "u", "60 minutes", "5 days")
    q = found.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start(f"{tmp_path}/out")
    q.awaitTermination()
    batch = state.sessions(spark.createDataFrame(rows, "u string, ts timestamp"), "ts", "u", "60 minutes").collect()
    assert sorted(map(tuple, spark.read.schema(found.schema).parquet(f"{tmp_path}/out").collect())) == sorted(map(tuple, batch))


def test_the_rest_imports_without_the_training_data_folders(tmp_path):
    root = Path(__file__).resolve().parent.parent
    names = ("llm", ".git", "__pycache__", "corpus_pipeline.py")
    for keep_pipeline in (False, True):
        copy = tmp_path / f"copy{keep_pipeline}"
        shutil.copytree(root, copy, ignore=shutil.ignore_patterns(*(n for n in names if not (keep_pipeline and n == "corpus_pipeline.py"))))
        code = "import __spark_entry__ as e; q = e.queries(); assert 'leaderboard' in q and not any(k.startswith('op1_') or k == 'pipeline' for k in q)"
        subprocess.run([sys.executable, "-c", code], cwd=copy, check=True, env={**os.environ, "PYTHONPATH": str(copy)})
