import datetime

from pyspark.sql import functions as F

from filingscope.operators import market as M
from filingscope.operators import prices as P

PRICES = "symbol STRING, date DATE, open DOUBLE, high DOUBLE, low DOUBLE, close DOUBLE"


def quotes(rows, *pairs, symbol="X"):
    return rows(PRICES, [(symbol, d, c, c, c, c) for d, c in pairs])


def test_asof_and_nearest(rows, got):
    px = quotes(rows, ("2024-01-05", 10.0), ("2024-01-09", 12.0))
    left = rows("trade_id STRING, ticker STRING, trade_date DATE", [
        ("sunday", "X", "2024-01-07"), ("exact", "X", "2024-01-09"), ("before", "X", "2024-01-01"), ("late", "X", "2024-01-12"), ("later", "X", "2024-01-13"), ("none", "Y", "2024-01-09")])
    assert got(P.asof_join(left, px, "trade_date"), "trade_id", "asof_close") == {
        "sunday": 10.0, "exact": 12.0, "before": None, "late": 12.0, "later": 12.0, "none": None}
    assert got(P.nearest_join(left, px, "trade_date"), "trade_id", "nearest_close") == {
        "sunday": 12.0, "exact": 12.0, "before": 10.0, "late": 12.0, "later": None, "none": None}


def test_move_buckets(rows, got):
    df = rows("trade_id STRING, price_at_trade_date DOUBLE, price_at_disclosure_date DOUBLE", [
        ("a", 100.0, 85.0), ("b", 100.0, 84.9999), ("c", 100.0, 100.0), ("d", 100.0, 115.0), ("e", 0.0, 10.0), ("f", 100.0, None)])
    assert got(P.with_pre_disclosure_move(df), "trade_id", "pct_move_bucket") == {
        "a": "dip", "b": "deep_dip", "c": "gain", "d": "strong_gain", "e": None, "f": None}


def test_moving_average_needs_full_window(rows, got):
    start = datetime.date(2023, 1, 1)
    px = quotes(rows, *[((start + datetime.timedelta(days=i)).isoformat(), 5.0) for i in range(201)])
    out = got(M.above_ma(px), "date", "above_ma")
    assert out[start + datetime.timedelta(days=198)] is None
    assert out[start + datetime.timedelta(days=199)] == 0  # equal is not above
    dates = rows("date DATE", [("2023-02-01",), ("2023-07-19",), ("2024-07-01",)])
    assert got(M.market_regime(dates, px, "X"), "date", "index_above_ma") == {
        datetime.date(2023, 2, 1): None, datetime.date(2023, 7, 19): 0, datetime.date(2024, 7, 1): 0}


def test_market_returns(rows, got):
    px = quotes(rows, ("2024-01-01", 100.0), ("2024-01-31", 110.0), ("2024-02-10", 121.0))
    out = got(M.market_returns(rows("date DATE", [("2024-02-11",)]), px, ["X", "N"]), "symbol", "level", "ret_7d", "ret_30d", "ret_90d")
    assert out == {"X": (121.0, 10.0, 21.0, None), "N": (None, None, None, None)}


def test_market_features_build_only_missing_dates(rows):
    px = quotes(rows, ("2024-01-01", 100.0), ("2024-01-31", 110.0))
    dates = rows("date DATE", [("2024-01-31",), ("2024-02-01",)])
    out = M.market_features(dates, px, index="X", volatility="X", sectors={"tech": "X"}, existing=rows("date DATE", [("2024-01-31",)])).collect()
    assert [(r.date.isoformat(), r.vix_close, r.spy_1m_ret, r.tech_1m_ret) for r in out] == [("2024-02-01", 110.0, 10.0, 10.0)]


def test_forward_returns(rows):
    px = quotes(rows, ("2024-01-02", 100.0), ("2024-01-12", 90.0), ("2024-02-01", 130.0))
    t = rows("trade_id STRING, ticker STRING, trade_date DATE, disclosure_date DATE", [("a", "X", "2024-01-01", "2024-01-12")])
    r = P.forward_returns(t, px, [7, 30]).collect()[0]
    assert (r.price_trade, r.return_trade_7d, r.return_trade_30d) == (100.0, -10.0, 30.0)
    assert (r.price_disc, r.return_disc_7d, r.return_disc_30d) == (90.0, None, None)
