import datetime
import json

import pytest
from pyspark.sql import functions as F

from filingscope.plans import reports as R
from filingscope.plans import scoring as S

POS = "filer_id STRING, ticker STRING, outcome STRING, size_midpoint BIGINT, max_drawdown_disc DOUBLE, has_path BOOLEAN, entry_price DOUBLE"


def positions(rows, filer, outcomes, size=1000, dd=-5.0):
    return [(filer, f"t{i}", o, size, dd if o != "loss" else -10.0, True, 1.0) for i, o in enumerate(outcomes)]


def test_score_thresholds(rows, got):
    w, l, o = "win", "loss", "open"
    data = (
        positions(rows, "four", [w] * 4) + positions(rows, "five", [w] * 5) + positions(rows, "undecided", [o] * 6)
        + positions(rows, "small", [w, w, w, l, l], 60000)[:4] + positions(rows, "small2", [w, w, w, l, l], 1000)
        + positions(rows, "large", [w, w, w, l, l], 60000)
    )
    out = got(S.score_filers(rows(POS, data)), "filer_id", "score", "win_rate", "large_win_rate", "low_confidence")
    assert set(out) == {"five", "small2", "large"}
    assert out["five"] == (85.0, 100.0, None, True)  # 70 % x 100 + 30 % x 50
    assert out["small2"][0] == pytest.approx(0.7 * 50 + 0.3 * 50)
    assert out["large"][:3] == (50.0, 60.0, 60.0)


def test_points(spark):
    row = spark.range(1).select(
        *[S.win_rate_points(F.lit(v)).alias(f"w{i}") for i, v in enumerate((0.5, 0.6, 0.7, 0.45))],
        *[S.drawdown_points(F.lit(v).cast("double")).alias(f"d{i}") for i, v in enumerate((None, 0.0, -5.0, -10.0))]).first()
    assert [round(x, 9) for x in row] == [0.0, 50.0, 100.0, 0.0, 50.0, 100.0, 50.0, 0.0]


def test_stale_scores_disappear(rows):
    filers = rows("filer_id STRING, name STRING", [("a", "A"), ("b", "B")])
    scores = rows("filer_id STRING, score DOUBLE, score_etf DOUBLE", [("a", 10.0, None)])
    out = {r.filer_id: (r.score, r.last_updated) for r in S.publish_scores(filers, scores, F.lit(datetime.date(2024, 1, 1))).collect()}
    assert out == {"a": (10.0, datetime.date(2024, 1, 1)), "b": (None, None)}


def test_alerts(rows, got):
    def last(*counts):
        h = rows("id BIGINT, new_trades INT", [(i, n) for i, n in enumerate(counts)])
        return got(R.scrape_alerts(h, ["id"]), "id", "alert")[len(counts) - 1]

    assert last(0, 0, 0, 0, 0) == "zero_streak"
    assert last(0, 0, 0, 0) == "ok"
    assert last(0, 0, 0, 0, 501) == "ceiling"
    assert last(0, 0, 1, 0, 0) == "ok"


def test_equity_curve(rows):
    df = rows("trade_id STRING, outcome STRING, close_date_disc DATE", [
        ("a", "win", "2024-01-01"), ("b", "loss", "2024-01-02"), ("c", "loss", "2024-01-02"), ("d", "open", None)])
    out = [(r.n_exits, r.equity, r.max_drawdown) for r in R.equity_curve(df).orderBy("exit_date").collect()]
    assert out == [(1, 1.001, 0.0), (2, round(1.001 * 0.999**2, 6), round(0.999**2 - 1, 6))]


def test_export_round_trip(rows, spark, tmp_path):
    cols = ["name", "party", "chamber", "state", "score", "win_rate", "avg_dd", "large_trade_wr", "compliant_trades", "late_filings", "avg_filing_lag", "comm_align_pct"]
    df = rows(", ".join(f"{c} STRING" for c in cols), [tuple(c.upper() for c in cols)])
    R.export_leaderboard(df, str(tmp_path / "out"))
    back = spark.read.option("header", True).csv(str(tmp_path / "out"))
    assert back.columns[5] == "Win%" and back.first()[0] == "NAME"


def test_rank_across_ranges(rows):
    data = [(f"f{i:03d}", f"n{i:03d}", float(i % 7) if i % 5 else None) for i in range(200)]
    out = {r.filer_id: (r.rank, r.prev_name, r.next_name) for r in R.rank_filers(rows("filer_id STRING, name STRING, score DOUBLE", data)).collect()}
    ranked = sorted(data, key=lambda r: (r[2] is None, -(r[2] or 0.0), r[0]))
    for i, r in enumerate(ranked):
        assert out[r[0]] == (i + 1, ranked[i - 1][1] if i else None, ranked[i + 1][1] if i + 1 < len(ranked) else None)
