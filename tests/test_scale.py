"""What is shuffled, and what is counted, as tables grow."""

import datetime

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from catalog import base
from filingscope.operators import barriers, clusters, prices

SMALL = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def tree(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_open_ended_labels_open_blocks_in_the_symbol_join(spark, no_broadcast):
    """Anchors meet their symbol's days in one join and are neither multiplied nor shuffled after it."""
    keys = base.buys(spark, SMALL).select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date")).distinct()
    indexed = prices.index_prices(base.prices(spark, SMALL))
    text = tree(barriers.first_touches(prices.anchor_entries(keys, indexed), indexed))
    above = text[: text.index("SortMergeJoin")]
    assert "Exchange" not in above and "Generate" not in above and "Sort" not in above


@pytest.mark.parametrize("horizon", [None, 20])
def test_days_of_a_path_stay_where_they_were_found(spark, no_broadcast, horizon):
    """The range join is the last one; trades have met their anchors before."""
    text = tree(prices.build_paths(base.buys(spark, SMALL), base.prices(spark, SMALL), "disc", horizon))
    last = next(line for line in text.splitlines() if "SortMergeJoin" in line)
    assert "p_bucket" in last
    assert "Exchange" not in text[: text.index("SortMergeJoin")]


@pytest.mark.parametrize("name", ["cascade_children", "extend_paths"])
def test_rows_of_paths_are_not_joined_again(spark, no_broadcast, name):
    text = tree(entry.queries()[name](spark, SMALL))
    assert "p_bucket" in next(line for line in text.splitlines() if "SortMergeJoin" in line)


def test_paths_keep_columns_of_their_trade(rows):
    trades = rows("trade_id STRING, ticker STRING, disclosure_date DATE, side STRING", [("a", "X", "2024-01-02", "keep"), ("b", "X", "2024-01-02", None)])
    quotes = rows("symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", [("X", f"2024-01-{k:02d}", 1.0, 1.0, 1.0, float(k)) for k in (1, 3, 4)])
    for horizon in (None, 30):
        got = prices.build_paths(trades, quotes, "disc", horizon, keep=["side"])
        assert sorted((r.trade_id, r.day, r.side) for r in got.collect()) == [("a", 1, "keep"), ("a", 2, "keep"), ("b", 1, None), ("b", 2, None)]


def test_blocks_of_cluster_counts_stay_with_their_key(spark, no_broadcast):
    """Cells become many rows only behind the exchange by their key: nothing above the rows of blocks is shuffled."""
    cells = base.buys(spark, SMALL).groupBy("ticker", "trade_date", "disclosure_date").agg(F.count("*").alias("n"))
    text = tree(clusters._earlier_disclosed(cells, ["ticker"], 30))
    assert "Window" in text and "Exchange" not in text[: text.index("Generate")]


def test_paths_are_extended_from_the_earlier_day(spark):
    got = entry.queries()["extend_paths"](spark, SMALL).agg(F.min("date").alias("first")).first()
    assert datetime.date(1996, 6, 30) < got["first"] < datetime.date(1998, 12, 31)


def test_loops_over_days_stay_out_of_long_generated_code(spark, no_broadcast):
    """Minima and look-ups in arrays are in projections with lambdas, whose code is cut into methods that the JVM compiles."""
    indexed = prices.index_prices(base.prices(spark, SMALL))
    keys = base.buys(spark, SMALL).select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date")).distinct()
    touches = barriers.first_touches(prices.anchor_entries(keys, indexed), indexed)
    lines = [x for x in tree(barriers.decide(touches)).splitlines() if "Project" in x and ("array_min" in x or "slice(" in x)]
    assert lines and not [x for x in lines if "*(" in x.split("Project")[0]]


def test_touches_equal_a_walk_over_the_days(spark, rows):
    """Random series with gaps, over many blocks, against a plain loop."""
    import random

    rnd, day0 = random.Random(3), datetime.date(2020, 1, 1)
    quotes, levels = [], {}
    for symbol, n in (("A", 31), ("B", 32), ("C", 33), ("D", 200), ("E", 1)):
        p = 100.0
        for k in range(n):
            p *= 1 + rnd.uniform(-0.02, 0.02)
            low, high = (p - 1, p + 1) if rnd.random() > 0.1 else rnd.choice([(None, p + 9), (p - 9, None), (None, None)])
            levels.setdefault(symbol, []).append((day0 + datetime.timedelta(k), p, low, high))
            quotes.append((symbol, day0 + datetime.timedelta(k), p, high, low, p))
    anchors = [(s, day0 + datetime.timedelta(k - 2)) for s, days in levels.items() for k in range(0, len(days) + 3)] + [("none", day0)]
    indexed = prices.index_prices(rows("symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", quotes))
    entries = prices.anchor_entries(rows("symbol STRING, anchor_date DATE", anchors), indexed)
    got = barriers.first_touches(entries, indexed, stops=[3.0, 10.0], targets=[3.0, 10.0]).collect()
    assert len(got) == len(anchors)
    for r in got:
        path = [(i, *x) for i, x in enumerate(levels.get(r.symbol, []), 1) if x[0] > r.anchor_date]
        good = [x for x in path if x[3] is not None and x[4] is not None]
        assert (r.n_rows > 0) == bool(path) and r.lowest == min((x[3] for x in good), default=None)
        for name, hit in [(f"stop_{s}_0", lambda x, s=s: x[3] <= r.entry_price * (1 - s / 100)) for s in (3, 10)] + [
                (f"target_{s}_0", lambda x, s=s: x[4] >= r.entry_price * (1 + s / 100)) for s in (3, 10)]:
            at = next((x for x in good if hit(x)), None)
            want = None if at is None else (at[0], at[1], min(x[3] for x in good if x[0] <= at[0]))
            assert (None if r[name] is None else tuple(r[name])) == want, (r, name)


def test_few_repeats_leave_the_labelled_rows_where_they_are(spark):
    """Labels and repeats are written; only the short list of repeats travels."""
    from catalog import scoring

    text = tree(scoring.repeated(spark, SMALL))
    assert "BroadcastHashJoin" in text and "hashpartitioning" not in text and "SortMergeJoin" not in text


@pytest.mark.parametrize("days", [0, 3, 20])
def test_main_keys_are_not_written_once_for_each_near_date(rows, day, days):
    import random

    from filingscope.operators import merge

    rnd = random.Random(5)
    some = lambda tag, n: [(f"{tag}{i}", rnd.choice(["1", "2", None]), rnd.choice("XY"), "buy", rnd.choice(["compliant", "violation"]),
                            None if rnd.random() < 0.05 else day("2024-01-01") + datetime.timedelta(rnd.randrange(400)), 1.0) for i in range(n)]
    schema = "trade_id STRING, filer_id STRING, ticker STRING, transaction_type STRING, filing_violation STRING, trade_date DATE, max_drawdown_disc DOUBLE"
    main, staged = some("m", 60), some("s", 60)
    m, s = rows(schema, main), rows(schema, staged)
    keys, _ = merge._near(m, days)
    assert keys.count() <= 2 * len({x[1:4] + x[5:6] for x in main if x[5]})
    near = {x[0]: sum(None not in (x[1], x[5], y[1], y[5]) and x[1:4] == y[1:4] and abs((x[5] - y[5]).days) <= days for y in main) for x in staged}
    assert {r[0] for r in merge.merge_new_rows(m, s, days).select("trade_id").collect()} == {k for k, n in near.items() if not n}
    assert {r[0] for r in merge.colliding_rows(m, s, days).select("trade_id").collect()} == {k for k, n in near.items() if n}
    assert tuple(merge.merge_conflicts(m, s, days).first()) == (sum(n > 0 for n in near.values()), sum(near.values()))


def test_scanned_touches_equal_windows_and_arrays(spark, rows, monkeypatch):
    """Entries and touches of one sorted pass against the windows and the join, with gaps, NaN, days without a date and small batches."""
    import random

    from filingscope.operators import scan

    rnd, day0, nan = random.Random(7), datetime.date(2020, 1, 1), float("nan")
    quotes, anchors = [], [("none", day0)]
    for symbol, n in [("A", 1), ("B", 31), ("C", 64), ("D", 300)] + [(f"S{k}", k) for k in range(1, 20)]:
        p, at = 100.0, sorted(rnd.sample(range(2 * n), n))
        for k in at:
            p *= 1 + rnd.uniform(-0.04, 0.04)
            high, low = (p + 1, p - 1) if rnd.random() > 0.1 else rnd.choice([(None, p), (p, None), (nan, p - 1), (p + 1, nan)])
            quotes.append((symbol, day0 + datetime.timedelta(k), rnd.choice([p, p, p, None, 0.0, nan]), high, low, rnd.choice([p, p, p, None])))
        anchors += [(symbol, day0 + datetime.timedelta(k)) for k in range(-2, 2 * n + 3)]
    # A symbol in Z has a first day without a date, one in Y only such a day.
    quotes += [("Z", None, 5.0, 6.0, 4.0, 5.5), ("Z", day0, 5.0, 6.0, 4.0, 5.0), ("Y", None, 5.0, 6.0, 4.0, 5.5), (None, day0, 1.0, 1.0, 1.0, 1.0)]
    anchors += [(s, day0 + datetime.timedelta(k)) for s in "YZ" for k in (-1, 0, 1)]
    table = rows("symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", quotes)
    keys = rows("symbol STRING, anchor_date DATE", anchors)
    indexed = prices.index_prices(table)
    want = barriers.first_touches(prices.anchor_entries(keys, indexed), indexed, stops=[3.0, 10.0], targets=[3.0, 10.0])
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "37")
    try:
        monkeypatch.setattr(scan, "ROWS", 50)
        got = scan.scan_touches(keys, table, {"stop_3_0": 3.0, "stop_10_0": 10.0}, {"target_3_0": 3.0, "target_10_0": 10.0})
        pairs = [{(r.symbol, r.anchor_date): str(tuple(r[:-1])) + str(r.n_rows > 0) for r in df.collect()} for df in (want.select(*got.columns), got)]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert pairs[0] == pairs[1] and len(pairs[0]) == len(anchors)


def test_labels_shuffle_price_days_once(spark, no_broadcast):
    """Price days meet their anchors in one exchange by symbol, without a window or a join."""
    keys = base.buys(spark, SMALL).select(F.col("ticker").alias("symbol"), F.col("disclosure_date").alias("anchor_date")).distinct()
    text = tree(barriers.label_anchors(keys, base.prices(spark, SMALL)))
    assert "Window" not in text and "hashpartitioning(symbol" in text[: text.index("Union")]
    assert text[: text.index("Union")].count("Exchange") == 1


def test_only_pairs_with_several_buys_are_folded(spark, rows, monkeypatch):
    """A pair's only buy stays out of the fold; null filers are a pair, and an id that opens elsewhere is no repeat."""
    from filingscope.operators import flags
    from filingscope.plans import night

    data = [("a", "f", "X", "2024-01-02", "2024-02-02"), ("b", "f", "X", "2024-01-05", "2024-02-05"), ("c", "f", "Y", "2024-01-02", None), ("d", None, "X", "2024-01-02", None),
            ("e", None, "X", "2024-01-03", None), ("t", "f", "X", "2024-01-06", None), ("t", "g", "X", "2024-01-06", None), ("u", "f", "X", "2024-01-07", None)]
    bought = [(i, f, x, "2024-01-01", d, c, "buy", "compliant", "stock", 1.0) for i, f, x, d, c in data]
    labelled = rows("trade_id STRING, filer_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE, close_date_disc DATE, transaction_type STRING, "
                    "filing_violation STRING, asset_type STRING, price_at_disclosure_date DOUBLE", bought)
    folded, fold = [], flags.flag_repeats
    monkeypatch.setattr(flags, "flag_repeats", lambda df: folded.append({r.trade_id for r in df.collect()}) or fold(df))
    got = sorted(r.trade_id for r in night.repeats(labelled, labelled).collect())
    assert folded == [{"a", "b", "d", "e", "t", "u"}] and got == ["b", "e", "u"]
    want = fold(flags.qualifying_buys(labelled)).filter("repeat_before_close = 1")
    assert got == sorted(r.trade_id for r in want.collect())


def test_a_trade_with_an_id_of_its_own_is_not_joined_to_find_its_label(spark, rows, no_broadcast):
    """The plain join moves all trades by id; here only hashes of ids and the rows of shared ids move.  Rows are those of the join."""
    from filingscope.operators import flags

    schema = "trade_id STRING, filer_id STRING, transaction_type STRING"
    trades = rows(schema, [("a", "1", "buy"), ("b", "1", "sell"), ("c", "1", "buy"), ("c", "2", "buy"), ("d", "1", "buy"), ("d", "1", "sell"),
                           ("e", "3", None), ("f", "3", "sell"), ("f", "4", "sell"), (None, "5", "buy"), (None, "6", "sell")])
    one = rows(schema, [("a", "1", "buy"), (None, "5", "buy"), ("b", "1", "sell")])
    for table in (trades, one, trades.limit(0)):
        buys = table.filter("transaction_type = 'buy'").withColumn("price", F.col("filer_id").cast("double")).withColumn("flag", F.lit(1))
        out = flags.with_buy_columns(table, buys, ["price", "flag"])
        want = table.join(buys.select("trade_id", "price", "flag"), "trade_id", "left").select(out.columns)
        assert sorted(map(str, out.collect())) == sorted(map(str, want.collect()))
    text = tree(out)
    assert not [line for line in text.splitlines() if "hashpartitioning(trade_id" in line and "Left" in line]


def test_funnel_moves_only_rows_that_pass_the_filters_on_their_own_columns(spark, rows, no_broadcast):
    from filingscope.plans import reports

    schema = ("filer_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE, transaction_type STRING, filing_violation STRING, asset_type STRING, "
              "price_at_disclosure_date DOUBLE, repeat_before_close INT")
    good = ("1", "A", "2024-01-01", "2024-01-05", "buy", "compliant", "stock", 1.0, 0)
    change = lambda **new: tuple(new.get(f.split()[0], v) for f, v in zip(schema.split(", "), good))
    table = rows(schema, [
        good, good, change(filer_id=None), change(transaction_type="sell"), change(transaction_type=None), change(filing_violation="violation"),
        change(price_at_disclosure_date=None), change(asset_type="etf"), change(trade_date=None), change(disclosure_date=None), change(repeat_before_close=1),
        *[change(filer_id="2", ticker=t, disclosure_date=f"2024-02-0{i}") for i, t in enumerate("ABC", 1)],
        *[change(filer_id="3", ticker=t, trade_date=f"2024-02-0{i}") for i, t in enumerate("ABC", 1)]])
    out = reports.filter_funnel(table, 3, 3)
    assert [r.survivors for r in out.orderBy("step").collect()] == [17, 15, 14, 13, 13, 12, 11, 8, 5, 4, 3]
    assert not [line for line in tree(out).splitlines() if "Project" in line and "asset_type" in line and "ticker" in line]
    assert [r.survivors for r in reports.filter_funnel(table.limit(0), 3, 3).orderBy("step").collect()] == [0] * 11
    assert [r.survivors for r in reports.filter_funnel(table.filter("transaction_type = 'sell'"), 3, 3).orderBy("step").collect()] == [1] + [0] * 10


def test_few_baskets_leave_the_pool_of_repeats_where_it_is(spark, monkeypatch):
    """Baskets are written, so that their size is known before rows are dealt out for them."""
    from catalog import scoring
    from filingscope.plans import night

    plans = []
    keep = night.materialize
    monkeypatch.setattr(night, "materialize", lambda df: plans.append(tree(df)) or keep(df))
    night.repeats(base.labelled(spark, SMALL), base.trade_table(spark, SMALL), scoring.PARAMS)
    pool = next(text for text in plans if "LeftAnti" in text)
    assert "BroadcastHashJoin" in pool and "hashpartitioning" not in pool


def test_a_positions_trade_ids_are_moved_once(spark, rows):
    from filingscope.plans import grid

    schema = ("trade_id STRING, filer_id STRING, ticker STRING, disclosure_date DATE, transaction_type STRING, filing_violation STRING, size_midpoint BIGINT, "
              "price_at_disclosure_date DOUBLE, max_drawdown_disc DOUBLE, days_to_exit_disc INT")
    row = lambda tid, filer, ticker, dd, days: (tid, filer, ticker, "2024-01-05", "buy", "compliant", 1, 1.0, dd, days)
    table = rows(schema, [
        row("b", "1", "A", -10.0, 3), row("a", "1", "A", -2.0, None), row("c", "1", "B", -4.0, 3), row(None, "1", "C", -4.0, 3),
        row(None, "2", "A", -10.0, 3), row("z", "2", "A", -3.0, 2)])
    out = grid.stored_grid_cell(table)
    assert {r.filer_id: tuple(r)[1:] for r in out.collect()} == {"1": (3, 1, 0, 100.0, -4.0), "2": (1, 1, 0, 100.0, -3.0)}
    assert tree(grid.stored_grid_cell(table)).count("partial_min_by") == 1


def test_written_tables_are_compressed_with_zstd(spark, tmp_path):
    import pathlib

    import pyarrow.parquet as pq

    from filingscope.session import materialize

    path = materialize(spark.range(1000)).inputFiles()[0].removeprefix("file:")
    assert pq.ParquetFile(pathlib.Path(path)).metadata.row_group(0).column(0).compression == "ZSTD"


def test_labels_of_both_anchors_come_from_one_scan(spark, rows, no_broadcast, monkeypatch):
    """Price days meet the anchors of both kinds in one pass; trades take written labels, without windows or arrays of days.  Entry at the close or the next open."""
    plans, keep = [], barriers.materialize
    monkeypatch.setattr(barriers, "materialize", lambda df: plans.append(tree(df)) or keep(df))
    trades = rows("trade_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE", [
        ("a", "X", "2024-01-01", "2024-01-01"), ("b", "X", "2024-01-02", None), ("c", "none", "2024-01-01", "2024-01-02"), ("d", None, "2024-01-01", "2024-01-02"),
        ("a", "X", "2024-01-01", "2024-01-01"), ("e", "X", "2023-12-31", "2024-01-03")])
    quotes = rows("symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", [
        ("X", "2024-01-01", 100.0, 100.0, 100.0, 100.0), ("X", "2024-01-02", 104.0, 111.0, 96.0, 105.0), ("X", "2024-01-03", 105.0, 105.0, 93.0, 94.0)])
    out = barriers.label_both_anchors(trades, quotes)
    cols = ("outcome_trade", "days_to_exit_trade", "max_drawdown_before_profit", "drawdown_trade_5pct", "outcome_disc", "days_to_exit_disc", "max_drawdown_disc")
    got = sorted((r.trade_id, *[r[c] for c in cols]) for r in out.collect())
    nothing = ("open", None, None, None)
    a = ("a", "win", 1, -4.0, 0, "loss", 2, -10.0)
    assert got == [a, a, ("b", "loss", 1, -10.0, 1, None, None, None), ("c", *nothing, *nothing[:3]), ("d", *[None] * 7), ("e", *nothing, *nothing[:3])]
    assert len(plans) == 1 and plans[0].count("MapInArrow") == 1 and "Window" not in plans[0]
    assert "Window" not in tree(out) and "MapInArrow" not in tree(out)


def test_a_grid_reads_price_days_once_and_only_for_positions_of_the_size(spark, rows, no_broadcast, monkeypatch):
    from filingscope.plans import grid

    asked, scan = [], grid.scan_touches
    monkeypatch.setattr(grid, "scan_touches", lambda keys, *a: asked.append({r.symbol for r in keys.collect()}) or scan(keys, *a))
    trades = rows("filer_id STRING, ticker STRING, disclosure_date DATE, transaction_type STRING, filing_violation STRING, size_midpoint BIGINT", [
        ("1", "X", "2024-01-01", "buy", "compliant", 5), ("1", "X", "2024-01-01", "buy", "compliant", 20), ("2", "Y", "2024-01-01", "buy", "compliant", 5)])
    quotes = rows("symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE", [
        (s, f"2024-01-0{k}", 100.0, high, low, 100.0) for s in "XY" for k, high, low in ((1, 100.0, 100.0), (2, 104.0, 96.0), (3, 112.0, 89.0))])
    out = grid.barrier_grid(trades, quotes, [(5.0, 10.0), (20.0, 10.0)], min_size=10)
    text = tree(out)
    assert sorted(map(tuple, out.collect())) == [("1", 5.0, 10.0, 1, 0, 1, 0.0, None), ("1", 20.0, 10.0, 1, 1, 0, 100.0, -11.0)]
    assert asked == [{"X"}]
    assert "Window" not in text and text.count("MapInArrow") == 1


def test_shuffles_of_a_written_table_leave_the_disk(spark):
    import pathlib
    import time

    from filingscope.session import FREED, materialize

    folder = pathlib.Path(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirsString()[0])
    files = lambda: {f.name for f in folder.rglob("shuffle_*.data")}
    df, before = spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), files()
    table = materialize(df)
    until = time.time() + 20
    while files() - before and time.time() < until:
        time.sleep(0.2)
    assert not files() - before
    assert spark.conf.get(FREED, None) is None
    # The frame itself may still be read: what it needs is computed again.
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, table.collect()))


def test_forward_returns_multiply_neither_days_nor_keys(spark, rows, no_broadcast, monkeypatch):
    """Nearest closes of one sorted pass against the table of all days with a price; the plan has no rows for each offset or day."""
    import random

    rnd, day0, plans, keep = random.Random(11), datetime.date(2024, 1, 1), [], prices.materialize
    at = lambda k: day0 + datetime.timedelta(k)
    quotes = [(s, at(k), rnd.choice([None, 10.0, 20.5, 30.12346])) for s in "ABCD" for k in range(40) if rnd.random() < 0.3]
    quotes += [("D", None, 5.0), ("E", None, 5.0), (None, at(3), 7.0)]
    table = rows("symbol STRING, date DATE, close DOUBLE", quotes)
    dates = [(s, at(k)) for s in ["A", "B", "C", "D", "E", "none", None] for k in range(-12, 45)]
    trades = rows("trade_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE", [
        (f"{i}", s, d, None if i % 9 == 0 else d + datetime.timedelta(i % 5)) for i, (s, d) in enumerate(dates + dates[:5])])
    monkeypatch.setattr(prices, "materialize", lambda df: plans.append(tree(df)) or keep(df))
    got = prices.forward_returns(trades, table, (3, 7)).collect()
    near = {(r.symbol, r.date): round(r.close, 4) for r in prices.nearest_days(table).collect()}
    assert len(got) == len(trades.collect()) and len({r.price_trade for r in got}) > 3
    for r in got:
        for tag, on in (("trade", r.trade_date), ("disc", r.disclosure_date)):
            p = [None if None in (on, r.ticker) else near.get((r.ticker, on + datetime.timedelta(o))) for o in (0, 3, 7)]
            assert [r[f"price_{tag}"], r[f"price_{tag}_3d"], r[f"price_{tag}_7d"]] == p
            assert (r[f"return_{tag}_7d"] is None) == (not p[0] or p[2] is None)
    assert len(plans) == 1 and plans[0].count("Generate") == 1 and "Window" not in plans[0] and "MapInArrow" in plans[0]


def test_signals_move_rows_once_for_their_cluster_count(spark, rows, no_broadcast, monkeypatch):
    """Counts of cells are written; a row whose id no other has takes its cell's count where it is asked for, the others still meet by id.  Rows are those of the join."""
    from filingscope.operators import flags

    cols = "trade_id STRING, filer_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE, transaction_type STRING, filing_violation STRING, price_at_disclosure_date DOUBLE"
    some = [("a", "1", "X", 1, 5), ("b", "2", "X", 2, 6), ("c", "3", "X", 3, 7), ("d", None, "X", 3, 7), ("e", "1", "Y", 3, 7), (None, "4", "X", 3, 8), (None, "5", "X", 3, 8), ("f", "6", None, 3, 8),
            ("t", "7", "X", 3, 9), ("t", "7", "X", 3, 9), ("t", "8", "X", 4, 10)]
    data = [(i, f, x, day(t), day(u), "buy", "compliant", 1.0) for i, f, x, t, u in some] + [
        ("t", "9", "X", day(4), day(20), "buy", "violation", 1.0), ("g", "9", "X", day(4), day(20), "buy", "violation", 1.0), ("h", "9", "X", None, day(20), "buy", "compliant", 1.0)]
    for part in (data, data[:5], data[5:6] + data[:2]):
        table = rows(cols, part)
        counted = clusters.cluster_count_td(flags.qualifying_buys(table)).select("trade_id", "cluster_count_td")
        want = table.join(counted, "trade_id", "left")
        got = clusters.with_cluster_count_td(table, flags.qualifying(table))
        assert sorted(map(str, got.select(want.columns).collect())) == sorted(map(str, want.collect()))
    # Only rows of shared ids are dealt out by id, and no window is left to be run with the rows.
    text = tree(clusters.with_cluster_count_td(table, flags.qualifying(table)))
    assert "Window" not in text and not [x for x in text.splitlines() if "SortMergeJoin [trade_id" in x and "LeftOuter" in x and "cluster" in x]


def day(k):
    return datetime.date(2024, 1, k)
