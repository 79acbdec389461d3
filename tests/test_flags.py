import datetime
import random

from pyspark.sql import functions as F

from filingscope.operators import clusters as C
from filingscope.operators import features as X
from filingscope.operators import flags as G

BUY = "trade_id STRING, filer_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE, close_date_disc DATE"


def test_repeat_chain_and_boundary(rows, got):
    df = rows(BUY, [
        ("a", "f", "X", None, "2024-01-01", "2024-01-20"), ("b", "f", "X", None, "2024-01-10", "2024-03-01"), ("c", "f", "X", None, "2024-02-01", "2024-02-05"),
        ("d", "f", "X", None, "2024-02-05", "2024-02-20"), ("e", "f", "X", None, "2024-02-06", None), ("g", "f", "X", None, "2024-08-04", None),
        ("h", "f", "X", None, "2024-08-05", None), ("i", "f", "X", None, "2024-08-05", "2024-08-06"), ("z", "q", "X", None, "2024-01-10", None)])
    assert got(G.flag_repeats(df), "trade_id", "repeat_before_close") == {
        "a": 0, "b": 1, "c": 0, "d": 1, "e": 0, "g": 1, "h": 0, "i": 1, "z": 0}


def random_buys(n, seed, filers=4, tickers=3, days=200):
    rng, out = random.Random(seed), []
    for i in range(n):
        td = datetime.date(2023, 1, 1) + datetime.timedelta(days=rng.randrange(days))
        dd = td + datetime.timedelta(days=rng.randrange(46))
        close = dd + datetime.timedelta(days=rng.randrange(1, 40)) if rng.random() < 0.7 else None
        out.append((f"t{i:04d}", f"f{rng.randrange(filers)}", f"x{rng.randrange(tickers)}", td, dd, close))
    return out


def test_clusters_equal_brute_force(rows, got):
    data = random_buys(300, 4)
    df = rows(BUY, data)
    for days in (0, 5, 30, 31):
        by_td = got(C.cluster_count_td(df, days), "trade_id", "cluster_count_td")
        for t, f, x, td, dd, _ in data:
            assert by_td[t] == sum(o[2] == x and o[1] != f and abs((o[3] - td).days) <= days and o[4] < dd for o in data)
    by_dd = got(C.cluster_count(df), "trade_id", "cluster_count")
    for t, f, x, td, dd, _ in data:
        assert by_dd[t] == sum(o[2] == x and o[1] != f and 1 <= (dd - o[4]).days <= 30 for o in data)


def test_cluster_edges(rows, got):
    df = rows(BUY, [
        ("me", "f", "X", "2024-03-01", "2024-03-31", None), ("edge", "g", "X", "2024-03-01", "2024-03-01", None), ("same", "g", "X", "2024-03-01", "2024-03-31", None),
        ("own", "f", "X", "2024-03-01", "2024-03-15", None), ("far", "g", "X", "2024-01-30", "2024-02-29", None), ("td30", "h", "X", "2024-01-31", "2024-03-02", None)])
    assert got(C.cluster_count(df), "trade_id", "cluster_count")["me"] == 2  # edge and td30; rows, not filers
    assert got(C.cluster_count_td(df), "trade_id", "cluster_count_td")["me"] == 2  # edge and td30


def test_repeats_equal_sequential_pass(rows, got):
    data = random_buys(400, 9)
    want = {}
    for pair in {(r[1], r[2]) for r in data}:
        closes = None
        for r in sorted((r for r in data if (r[1], r[2]) == pair), key=lambda r: (r[4], r[0])):
            want[r[0]] = int(closes is not None and r[4] <= closes)
            if not want[r[0]]:
                closes = r[5] or r[4] + datetime.timedelta(days=180)
    assert got(G.flag_repeats(rows(BUY, data)), "trade_id", "repeat_before_close") == want


TRADE = "trade_id STRING, filer_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE, transaction_type STRING, filing_violation STRING, asset_type STRING"


def test_basket_thresholds(rows):
    many = [(f"a{i}", "f", f"t{i % 10}", "2024-01-01", f"2024-02-{i + 1:02d}", "buy", "compliant", "stock") for i in range(12)]
    nine = [(f"b{i}", "g", f"t{i}", "2024-01-01", "2024-02-01", "buy", "compliant", "stock") for i in range(9)]
    twenty = [(f"c{i}", "h", f"t{i}", f"2024-01-{i + 1:02d}", "2024-02-01", "buy", "compliant", "etf") for i in range(20)]
    df = rows(TRADE, many + nine + twenty)
    assert {r.trade_id[0] for r in G.exclude_baskets(df, df).collect()} == {"b"}
    assert {r.trade_id[0] for r in G.exclude_baskets(df, df, ["stock"]).collect()} == {"b", "c"}
    flags = {r.trade_id: r.basket_day for r in G.with_basket_flag(df, df).collect()}
    assert len(flags) == 41 and flags["a0"] == 1 and flags["b0"] == 0 and flags["c0"] == 1


def test_signals_and_ledger(rows):
    df = rows("trade_id STRING, filer_id STRING, ticker STRING, disclosure_date DATE, transaction_type STRING, filing_violation STRING, asset_type STRING, cluster_count_td BIGINT, abs_pct_move_before_disclosure DOUBLE", [
        ("a", "f", "X", "2024-01-01", "buy", "compliant", "stock", 2, 15.0), ("b", "f", "X", "2024-01-01", "buy", "compliant", "stock", 2, 14.9),
        ("c", "f", "X", "2024-01-01", "buy", "compliant", "stock", None, 20.0), ("d", "f", "X", "2024-01-02", "buy", "compliant", "stock", 5, 50.0)])
    flagged = G.flag_signals(df)
    assert {r.trade_id: r.signal_flag for r in flagged.collect()} == {"a": 1, "b": 0, "c": 0, "d": 1}
    filers = rows("filer_id STRING, name STRING", [("f", "F")])
    ledger = lambda *ids: rows("trade_id STRING", [(i,) for i in ids])
    assert {(r.trade_id, r.report) for r in G.new_signals(flagged, filers, ledger()).collect()} == {("a", 0), ("d", 0)}
    assert {(r.trade_id, r.report) for r in G.new_signals(flagged, filers, ledger("a")).collect()} == {("d", 1)}


FEATURE = BUY + ", transaction_type STRING, filing_lag_days INT, repeat_before_close INT, size_midpoint BIGINT, drawdown_disc_10pct INT, max_drawdown_disc DOUBLE"


def feature_rows(rows, dated):
    return rows(FEATURE, [(t, "f", x, td, td, None, "buy", 10 + i, 0, 60000, i % 2, -1.0 * i) for i, (t, x, td) in enumerate(dated)])


def test_median_and_routine_edges(rows, got):
    df = feature_rows(rows, [("a", "X", "2024-01-01"), ("b", "X", "2024-01-11"), ("c", "X", "2024-01-31"), ("d", "X", "2024-06-01")])
    out = got(X.repeat_features(df), "trade_id", "seq_position", "gap_since_prev_buy", "prior_buy_count", "prior_median_gap", "is_routine_buyer", "prev_trade_open")
    assert out["a"] == (1, None, 0, None, 0, 0)
    assert out["d"] == (4, 122, 3, 15.0, 1, 1)  # gaps 10 and 20; the open predecessor is capped at 180 days
    # upper median of 10, 20, 122 is 20 for the feed
    assert [(r.routine_count, r.routine_avg_gap) for r in X.routine_buyers(df).collect()] == [(4, 50)]
    for gap, flag in ((92, 1), (93, 0)):
        start = datetime.date(2023, 1, 1)
        spaced = feature_rows(rows, [(f"t{k}", "X", (start + datetime.timedelta(days=gap * k)).isoformat()) for k in range(4)])
        assert got(X.repeat_features(spaced), "trade_id", "is_routine_buyer")["t3"] == flag
        assert got(X.repeat_features(spaced), "trade_id", "is_routine_buyer")["t2"] == 0


def test_same_day_rows_do_not_see_each_other(rows, got):
    df = feature_rows(rows, [("a", "X", "2024-01-01"), ("b", "X", "2024-05-01"), ("c", "Y", "2024-05-01"), ("d", "X", "2024-05-01"), ("e", "X", "2024-07-30"), ("g", "Y", "2025-05-01")])
    rec = got(X.pit_recency(df), "trade_id", "pol_age_days", "days_since_last_buy", "trades_last_90d", "trades_last_365d")
    assert rec["b"] == rec["c"] == rec["d"] == (121, 121, 0, 1)
    assert rec["e"] == (211, 90, 3, 4)  # exactly 90 days back counts
    assert rec["g"][3] == 4  # 365 days back counts, the first buy no longer
    conc = got(X.pit_concentration(df), "trade_id", "pit_ticker_conc_pct", "pit_ticker_hhi")
    assert conc["a"] == (None, None) and conc["b"] == (100.0, 1.0) and conc["e"] == (75.0, 0.625)
    perf = got(X.pit_performance(df), "trade_id", "pit_win_rate", "pit_avg_dd", "pit_large_trade_wr")
    assert perf["e"] == (50.0, -1.5, 50.0) and perf["a"] == (None, None, None)
    qual = got(X.pit_quality(df), "trade_id", "pit_repeat_rate", "pit_avg_filing_lag", "pit_late_filing_rate")
    assert qual["e"] == (0.0, 11.5, 0.0)


def test_features_ignore_the_future(rows):
    data = [(t, f, x, td, dd, c, "buy", 5, 0, 60000, 1 if c else 0, -3.0) for t, f, x, td, dd, c in random_buys(200, 3)]
    cut = datetime.date(2023, 4, 1)
    for op in (X.repeat_features, X.pit_recency, X.pit_concentration, X.pit_quality, X.pit_performance):
        full = {r.trade_id: tuple(r) for r in op(rows(FEATURE, data)).collect()}
        past = {r.trade_id: tuple(r) for r in op(rows(FEATURE, [r for r in data if r[3] <= cut])).collect()}
        assert past == {k: full[k] for k in past}


def test_filing_lag_and_levels(rows, got):
    df = rows("trade_id STRING, trade_date DATE, disclosure_date DATE, scraped INT", [
        ("a", "2024-01-01", "2024-02-15", 1), ("b", "2024-01-01", "2024-02-16", 1), ("c", None, "2024-02-16", 50), ("d", None, "2024-02-16", None)])
    assert got(G.with_filing_lag(df, scraped="scraped"), "trade_id", "filing_lag_days", "filing_violation") == {
        "a": (45, "compliant"), "b": (46, "violation"), "c": (50, "violation"), "d": (None, "compliant")}
    o = rows("trade_id STRING, entry_price DOUBLE, price_at_disclosure_date DOUBLE, day1_open DOUBLE, signal_flag INT, basket_day INT", [
        ("a", 100.0, 100.0, 104.9, 0, 0), ("b", 100.0, 100.0, 105.1, 1, 0), ("c", 100.0, 100.0, None, 0, 1), ("d", 100.0, 100.0, 100.0, 1, 1)])
    assert {r.trade_id for r in G.executable(o).collect()} == {"a", "d"}
    assert got(G.with_order_levels(o), "trade_id", "stop_price", "target_price", "limit_price")["a"] == (90.0, 110.0, 105.0)
