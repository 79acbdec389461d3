"""Bucketed prices, stored sketches, counts observed while writing, SQL functions and partitions against the plain forms."""

import contextlib
import datetime
import io
import random

import pytest
from pyspark.sql import functions as F

from filingscope.functions import normalise as N
from filingscope.functions import sql
from filingscope.operators import prices, sketches
from filingscope.sources import ingest, pricebook, tables

D0 = datetime.date(2020, 1, 1)


def day(k):
    return D0 + datetime.timedelta(days=k)


def plan(df) -> str:
    out = io.StringIO()
    with contextlib.redirect_stdout(out):
        df.explain("simple")
    return out.getvalue()


@pytest.fixture(scope="module")
def market(spark):
    """Daily, sparse (gaps of many blocks), early ending, late starting and hot symbols, with holes in close and open."""
    r = random.Random(5)
    rows = []
    for symbol, begin, end, step in [("daily", 40, 300, 1), ("sparse", 3, 600, 90), ("early", 0, 20, 1), ("late", 590, 601, 2), ("one", 320, 321, 1)]:
        for k in range(begin, end, step):
            rows.append((symbol, day(k), None if r.random() < 0.1 else r.uniform(-1, 5), 1.0, 1.0, None if r.random() < 0.2 else r.uniform(1, 9)))
    keys = [(s, day(k), 7) for s in ("daily", "sparse", "early", "late", "one", "none") for k in range(-80, 700, 3)]
    keys += [(None, day(3), 7), ("daily", None, 7), ("daily", day(41), 7), ("daily", day(41), 7)]
    return (spark.createDataFrame(rows, "symbol string, date date, open double, high double, low double, close double").cache(),
            spark.createDataFrame(keys, "symbol string, anchor_date date, block int").cache())


@pytest.fixture(scope="module")
def book(spark, market, tmp_path_factory):
    return pricebook.save_price_book(market[0], "book_of_tests", str(tmp_path_factory.mktemp("book") / "t"))


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_book_equals_the_plain_lookups(market, book):
    quotes, keys = market
    columns = ["symbol", "anchor_date", "start_idx", "anchor_close", "day1_open", "entry_price"]
    want = prices.anchor_entries(keys.dropna(), prices.index_prices(quotes)).select(columns)
    assert rows_of(pricebook.entries_in_book(keys, book).select(columns)) == rows_of(want)
    columns = ["symbol", "anchor_date", "block", "asof_close"]
    want = prices.asof_join(keys, quotes, "anchor_date", "symbol").select(columns)
    assert rows_of(pricebook.asof_in_book(keys, book, "anchor_date", "symbol").select(columns)) == rows_of(want)


def test_book_is_not_shuffled(spark, market, book):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        text = plan(pricebook.entries_in_book(market[1], book))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    # The keys are made distinct and dealt to their blocks; the book is read bucket by bucket.
    assert "SortMergeJoin" in text and "Bucketed: true" in text and text.count("Exchange hashpartitioning") == 2


def test_empty_book(spark, market, tmp_path):
    book = pricebook.save_price_book(market[0].limit(0), "empty_book_of_tests", str(tmp_path / "t"))
    found = pricebook.asof_in_book(market[1], book, "anchor_date", "symbol")
    assert found.count() == market[1].count() and found.filter("asof_close IS NOT NULL").count() == 0


def test_rolled_sketches_are_exact_in_rows_and_near_in_the_rest(spark):
    rows = spark.range(60_000).select(
        (F.col("id") % 60).alias("day"), F.pmod(F.hash("id"), F.lit(9000)).alias("who"), F.pmod(F.xxhash64("id"), F.lit(1000)).alias("size"))
    rows = rows.unionByName(spark.sql("SELECT bigint(60) AS day, int(null) AS who, bigint(null) AS size"))
    stored = sketches.daily_sketches(rows, ["day"], "who", "size")
    found = {r.part: r for r in sketches.read_sketches(sketches.roll_up(stored, [F.floor(F.col("day") / 30).alias("part")])).collect()}
    exact = {r.part: r for r in rows.groupBy(F.floor(F.col("day") / 30).alias("part")).agg(F.count("*").alias("n"), F.count_distinct("who").alias("who")).collect()}
    assert {k: r.n for k, r in found.items()} == {k: r.n for k, r in exact.items()}
    assert all(abs(found[k].n_items - exact[k].who) <= 0.065 * exact[k].who for k in exact)
    assert all(abs(v - q) <= 20 for k in (0, 1) for v, q in zip(found[k].amounts, (250, 500, 750)))
    assert found[2].amounts is None and found[2].n_items == 0


def test_counts_of_the_writing_pass(spark, rows, tmp_path):
    raw = rows("congress INT, committee_code INT, person_code BIGINT, party_code STRING, start STRING, end STRING, rank STRING", [
        (118, 1, 7, "100", "2023-01-03", "", "2"), (118, 1, 8, "200", "2023-01-03", "2025-01-03", "x"), (118, 9, 7, None, None, None, None),
        (118, 9, 8, None, None, None, None), (118, None, 7, None, None, None, None), (118, 1, 7, "100", "2023-01-03", "", "2")])
    codes, people = rows("committee_code INT, committee_id STRING", [(1, "HSAG")]), rows("person_code BIGINT, filer_id STRING", [(7, "f")])
    path = str(tmp_path / "m")
    assert ingest.land_assignments(raw, codes, people, "h_", path) == {"loaded": 2, "no_committee": 2, "no_person": 1}
    assert rows_of(spark.read.parquet(path)) == rows_of(ingest.load_assignments(raw, codes, people, "h_"))
    df = rows("ticker STRING, trade_date DATE, disclosure_date DATE, transaction_type STRING", [
        ("a", "2020-01-01", "2020-01-02", "buy"), ("a", None, "2020-01-02", "buy"), (" ", "2020-01-01", "2020-01-02", "buy"),
        ("a", "2020-01-01", "2019-01-02", "buy"), ("a", "2020-01-01", "2020-01-02", "receive"), ("a", "2020-01-01", "2020-01-02", None)])
    path = str(tmp_path / "a")
    assert ingest.land_accepted(df, F.lit(D0), path) == {"accepted": 2, "missing_date": 1, "before_cutoff": 1, "blank_ticker": 1, "receipt": 1}
    assert rows_of(spark.read.parquet(path)) == rows_of(ingest.split_rejects(df, F.lit(D0))[0])
    assert set(ingest.land_accepted(df.limit(0), F.lit(D0), str(tmp_path / "e")).values()) == {0}


def test_sql_functions_equal_the_column_forms(spark):
    texts = [
        None, "", "  ", "gop", " R", "democrat", "independent", "green party", "Purchase", "PARTIAL SALE", "Receive", "stock option", "$1,001 - $15,000",
        "Over $5,000,000", "over", "1000 to 2000", "$15", "15–50", "99999999999999999999", "2024-02-30", "2024-2-9", "02/09/2024", "25/12/2023", "2023/12/5",
        "1K–15K", "$5M+", "50k—100k", "Ann O'Neil--Jr.", "n/a"]
    df = spark.createDataFrame([(t,) for t in texts], "x string")
    sql.register(spark)
    forms = {
        "fs_party(x)": N.norm_party(F.col("x")), "fs_tx_type(x)": N.norm_tx_type(F.col("x")), "fs_date(x)": N.parse_date(F.col("x")),
        "fs_size(x)": N.parse_size(F.col("x")), "fs_amount(x)": N.parse_amount(F.col("x")), "fs_slug(x)": N.slug(F.col("x")),
        "fs_filer_id(x, 'US House')": N.synthetic_filer_id(F.col("x"), F.lit("US House")),
        "fs_trade_id(x, x, DATE '2024-02-09', 'buy', null)": N.make_trade_id(F.col("x"), F.col("x"), F.lit(datetime.date(2024, 2, 9)), F.lit("buy"), F.lit(None).cast("string")),
    }
    for call, form in forms.items():
        assert rows_of(df.selectExpr("x", f"{call} AS y")) == rows_of(df.select("x", form.alias("y"))), call
    joined = spark.sql("SELECT x, f.* FROM {df}, LATERAL fs_filing(x, x, x, x) f", df=df)
    text = plan(joined)
    assert joined.count() == len(texts) and "Python" not in text and "Join" not in text


def test_one_source_is_replaced(spark, rows, tmp_path):
    schema = "filer_id STRING, committee_id STRING, source STRING"
    path = str(tmp_path / "committee_memberships")
    tables.save_by_source(rows(schema, [("a", "X", "old"), ("b", "X", "new"), ("c", "Y", "new")]), path)
    tables.save_by_source(rows(schema, [("d", "Z", "new")]), path)
    loaded = tables.load(spark, str(tmp_path), ("committee_memberships",))["committee_memberships"]
    assert rows_of(loaded.select("filer_id", "committee_id", "source")) == [("a", "X", "old"), ("d", "Z", "new")]
