import datetime
import json
from difflib import SequenceMatcher

from pyspark.sql import functions as F

from filingscope.functions import normalise as N
from filingscope.operators import committees as K
from filingscope.operators import merge as M
from filingscope.operators import quality as Q
from filingscope.operators import resolve as R
from filingscope.sources import ingest


def column(rows, got, expr, values):
    df = rows("v STRING", [(v,) for v in values])
    return got(df, "v", expr.alias("r"))


def test_amounts_and_sizes(rows, got):
    out = column(rows, got, N.parse_amount(F.col("v")), ["$1,001 - $15,000", "Over $5,000,000", "", "$250", "1,001 to 2,000", "none", None])
    assert {k: v and tuple(v) for k, v in out.items()} == {
        "$1,001 - $15,000": (1001, 15000, 8000), "Over $5,000,000": (5000000,) * 3, "": (None,) * 3, "$250": (250,) * 3,
        "1,001 to 2,000": (1001, 2000, 1500), "none": (None,) * 3, None: (None,) * 3}
    out = column(rows, got, N.parse_size(F.col("v")), ["1K–15K", "$15K - 50K", "5M+", "huge", None])
    assert [tuple(out[k]) for k in ("1K–15K", "$15K - 50K", "5M+", "huge", None)] == [
        (1000, 15000, 8000), (15000, 50000, 32500), (5000000,) * 3, (None,) * 3, (None,) * 3]


def test_dates(rows, got):
    as_of = datetime.date(2026, 3, 1)
    page = column(rows, got, N.parse_date(F.col("v"), N.PAGE_DATE_FORMATS, F.lit(as_of)),
                  ["9 Feb2026", "24 Feb 2026", "14:01Today", "Yesterday", "16:15  24 Feb 2026", "9Feb 2026", "junk", "", None])
    assert page == {
        "9 Feb2026": datetime.date(2026, 2, 9), "24 Feb 2026": datetime.date(2026, 2, 24), "14:01Today": as_of, "Yesterday": datetime.date(2026, 2, 28),
        "16:15  24 Feb 2026": datetime.date(2026, 2, 24), "9Feb 2026": datetime.date(2026, 2, 9), "junk": None, "": None, None: None}
    api = column(rows, got, N.parse_date(F.col("v")), ["02/09/2026", "25/02/2026", "2026/02/09", "2026-02-09", "2026-13-09", " 2/9/2026 "])
    assert api == {
        "02/09/2026": datetime.date(2026, 2, 9), "25/02/2026": datetime.date(2026, 2, 25), "2026/02/09": datetime.date(2026, 2, 9),
        "2026-02-09": datetime.date(2026, 2, 9), "2026-13-09": None, " 2/9/2026 ": datetime.date(2026, 2, 9)}


def test_types_parties_ids(rows, got):
    assert column(rows, got, N.norm_tx_type(F.col("v")), ["Purchase", "buy", "Sale (Full)", "SELL", "Exchange", "stock option", "Received", "Gift"]) == {
        "Purchase": "buy", "buy": "buy", "Sale (Full)": "sell", "SELL": "sell", "Exchange": "exchange", "stock option": "option", "Received": "receive", "Gift": "gift"}
    assert column(rows, got, N.norm_party(F.col("v")), ["R", "gop", "dem", "Ind.", "green", " "]) == {
        "R": "Republican", "gop": "Republican", "dem": "Democrat", "Ind.": "Independent", "green": "Green", " ": None}
    assert column(rows, got, N.synthetic_filer_id(F.col("v"), F.lit("House")), ["Ann  O'Neil, Jr."]) == {"Ann  O'Neil, Jr.": "FH_ann-o-neil-jr"}
    assert column(rows, got, N.fold_name(F.col("v")), ["José  Núñez-O'Hara 3"]) == {"José  Núñez-O'Hara 3": "jose  nunez-o'hara "}


def test_json_envelopes(spark, tmp_path):
    rec = lambda s: {"firstName": "A", "lastName": "B", "symbol": s, "disclosureDate": "2024-01-02", "type": "Purchase", "amount": "$5", "extra": 1}
    (tmp_path / "p").mkdir()
    lines = [[rec("l1"), rec("l2")], {"data": [rec("d")]}, {"results": [rec("r")]}, {"trades": [rec("t")]}]
    (tmp_path / "p" / "x.json").write_text("\n".join(json.dumps(x) for x in lines))
    df = ingest.normalise_disclosures(ingest.read_disclosures_json(spark, str(tmp_path / "p")), "House")
    assert {r.ticker for r in df.collect()} == {"L1", "L2", "D", "R", "T"}


def test_pages_without_records(spark, tmp_path):
    (tmp_path / "p").mkdir()
    (tmp_path / "p" / "x.json").write_text('{"error": "limit"}\n<html>\n[]\n\n{"data": [{"lastName": "B"}, null]}\n[{"lastName": "C"}]\n{"data": 5}\n')
    assert {r.lastName for r in ingest.read_disclosures_json(spark, str(tmp_path / "p")).collect()} == {"B", "C"}
    assert tuple(ingest.rejected_pages(spark, str(tmp_path / "p")).first()) == (3, 6)


def test_accents_of_all_latin_letters(rows, got):
    assert column(rows, got, N.fold_name(F.col("v")), ["Čapek Őry Şahin Žižka Nguyễn"]) == {"Čapek Őry Şahin Žižka Nguyễn": "capek ory sahin zizka nguyen"}


def test_members_xml(spark, tmp_path):
    (tmp_path / "m.xml").write_text("""<?xml version="1.0"?><MemberData><members>
      <member><statedistrict>ca12</statedistrict><member-info><bioguideID>A1</bioguideID><lastname>L</lastname><firstname>F</firstname><party>R</party></member-info>
        <committee-assignments><committee comcode="AG00" rank="3"/><committee comcode="ZZ00" rank="1"/></committee-assignments></member>
      <member><statedistrict>tx01</statedistrict><member-info><bioguideID></bioguideID><lastname>Q</lastname></member-info></member>
      <member><statedistrict>ny</statedistrict><member-info><bioguideID>B2</bioguideID><lastname>M</lastname><official-name>Mx M</official-name><party>D</party></member-info></member>
    </members></MemberData>""")
    rows = ingest.read_members_xml(spark, str(tmp_path / "m.xml"), 119).collect()
    assert [(r.filer_id, r.committee_id, r.party, r.rank, r.start_date.isoformat(), r.end_date, r.source) for r in rows] == [
        ("A1", "HSAG", "Republican", 3, "2025-01-03", None, "clerk_house_119")]
    people = {r.filer_id: (r.name, r.state) for r in ingest.read_member_snapshot(spark, str(tmp_path / "m.xml")).collect()}
    assert people == {"A1": ("F L", "CA"), "B2": ("Mx M", "NY")}


T = "trade_id STRING, filer_id STRING, ticker STRING, transaction_type STRING, filing_violation STRING, trade_date DATE, max_drawdown_disc DOUBLE"


def test_fuzzy_merge(rows):
    main = rows(T, [("m", "f", "X", "buy", "compliant", "2024-01-10", None)])
    staged = rows(T, [
        ("near", "f", "X", "buy", "compliant", "2024-01-13", -1.0), ("far", "f", "X", "buy", "compliant", "2024-01-14", -1.0), ("nodate", "f", "X", "buy", "compliant", None, -1.0),
        ("open", "f", "Y", "buy", "compliant", "2024-01-14", None), ("sell", "f", "Y", "sell", "compliant", "2024-01-14", None), ("late", "f", "Y", "buy", "violation", "2024-01-14", None)])
    assert {r.trade_id for r in M.merge_staging(main, staged).collect()} == {"m", "far", "nodate", "sell", "late"}
    assert tuple(M.merge_conflicts(main, staged).first()) == (1, 1)


def test_dedup_best_order(rows):
    D = "trade_id STRING, filer_id STRING, ticker STRING, transaction_type STRING, disclosure_date DATE, trade_date DATE, price_at_disclosure_date DOUBLE, repeat_before_close INT"
    row = lambda t, x, price, rep: (t, "f", x, "buy", "2024-01-02", "2024-01-01", price, rep)
    df = rows(D, [row("a", "X", None, 0), row("b", "X", 1.0, 1), row("c", "X", 1.0, 0), row("d", "X", 1.0, 0), row("e", " ", 1.0, 0)])
    assert [r.trade_id for r in M.dedup_best(df).collect()] == ["c"]


def test_upsert_is_idempotent(rows):
    a = rows("k INT, v STRING", [(1, "old"), (2, "old")])
    b = rows("k INT, v STRING", [(2, "new"), (2, "newer"), (3, "new"), (None, "x")])
    for mode, want in (("ignore", {(1, "old"), (2, "old"), (3, "new"), (None, "x")}), ("replace", {(1, "old"), (2, "new"), (3, "new"), (None, "x")})):
        once = M.upsert(a, b, ["k"], [F.col("v")], mode)
        assert {tuple(r) for r in once.collect()} == want
        again = M.upsert(once, b.filter("k IS NOT NULL"), ["k"], [F.col("v")], mode)
        assert {tuple(r) for r in again.collect()} == want


def score(a, b):
    def parts(n):
        t = n.lower().split()
        first = R.NICKNAMES.get(t[0], t[0])
        while t and t[-1] in R.SUFFIXES:
            t.pop()
        return first, t[-1] if t else ""

    ratio = lambda x, y: SequenceMatcher(None, x, y).ratio()
    (fa, la), (fb, lb) = parts(a), parts(b)
    return max(ratio(a.lower(), b.lower()), 0.6 * ratio(la, lb) + 0.4 * ratio(fa, fb))


def test_entity_match_equals_brute_force(rows):
    people = [("p1", "William Smith", "House"), ("p2", "Robert Jones", "Senate"), ("p3", "Jo Li", "House"), ("p4", "Ana Lu", "House"), ("p5", "Catherine Johnson", "Senate"),
              ("p6", "Roberto Jonas", "House"), ("p7", "Al Wu", "Senate"), ("p8", "James O'Neil", "House"), ("p9", "Edward Markham", "Senate")]
    names = [("Bill Smith Jr", "House"), ("bob jones", "Senate"), ("Joe Li", "House"), ("Anna Lu", "House"), ("Katherine Johnston", "Senate"), ("Robert Jonas", "House"),
             ("Albert Wu", "House"), ("Jim ONeil", "House"), ("Ted Markam", None), ("Zed Quux", "House"), ("ROBERT JONES", "House"), ("W Smith", "House")]
    src = rows("name STRING, chamber STRING", names)
    filers = rows("filer_id STRING, name STRING, chamber STRING", people)
    out = {(r.name, r.chamber): r.filer_id for r in R.resolve_names(src, filers).collect()}
    for name, chamber in names:
        exact = [p for p, n, _ in people if n.lower() == name.lower()]
        best, who = max((round(min(score(name, n) + (0.04 if chamber and c == chamber else 0), 1.0), 12), p) for p, n, c in people)
        want = exact[0] if exact else (who if best >= 0.82 else None)
        assert out.get((name, chamber)) == want, name
    assert out[("Bill Smith Jr", "House")] == "p1"


def test_spot_check_is_reproducible(rows):
    df = rows("trade_id STRING, ticker STRING, transaction_type STRING, trade_date DATE", [(f"t{i}", "X", "buy", "2024-01-01") for i in range(200)])
    one = [r.trade_id for r in Q.spot_check(df).collect()]
    assert len(one) == 10 and one == [r.trade_id for r in Q.spot_check(df.repartition(7)).collect()]
    assert one != [r.trade_id for r in Q.spot_check(df, seed=8).collect()]


def test_fail_streak(rows, got):
    log = [
        ("three", 1, "2024-01-01", False), ("three", 2, "2024-01-02", False), ("three", 3, "2024-01-03", False),
        ("twice", 4, "2024-01-01", False), ("twice", 5, "2024-01-01", False), ("twice", 6, "2024-01-02", False),
        ("reset", 7, "2024-01-01", False), ("reset", 8, "2024-01-02", True), ("reset", 9, "2024-01-02", False), ("reset", 10, "2024-01-03", False),
    ]
    df = rows("symbol STRING, attempt_no BIGINT, attempt_date DATE, ok BOOLEAN", log)
    assert got(Q.failure_state(df), "symbol", "consecutive_fails", "permanently_skipped") == {"three": (3, 1), "twice": (2, 0), "reset": (1, 0)}


def test_committee_intervals(rows, got):
    trades = rows("trade_id STRING, filer_id STRING, transaction_type STRING, disclosure_date DATE, subsector STRING", [
        (f"t{i}", "f", "buy", d, "Banks") for i, d in enumerate(("2023-12-31", "2024-01-01", "2024-06-30", "2024-07-01"))] + [("n", "f", "buy", "2024-02-01", None)])
    members = rows("filer_id STRING, committee_id STRING, start_date DATE, end_date DATE, confidence STRING", [
        ("f", "B", "2024-01-01", "2024-06-30", "high"), ("f", "A", None, None, "high"), ("f", "C", None, None, "low"), ("f", "D", None, None, "high")])
    cover = rows("committee_id STRING, subsector STRING", [(c, "Banks") for c in "ABC"])
    names = rows("committee_id STRING, name STRING", [("A", "Alpha"), ("B", "Beta")])
    out = got(K.flag_committee(trades, members, cover, names), "trade_id", "committee_relevance")
    assert out == {"t0": "Alpha", "t1": "Alpha | Beta", "t2": "Alpha | Beta", "t3": "Alpha", "n": None}


def test_subsector_and_tier(rows, got):
    df = rows("trade_id STRING, ticker STRING, industry STRING, committee_relevance STRING", [
        ("a", "CRWD", "Software", "House Judiciary | House Ways & Means"), ("b", "MSFT", "Software", "Senate HELP"), ("c", "ZZZ", "Other", "Else"), ("d", "ZZZ", None, None)])
    out = K.with_subsector(df, rows("ticker STRING, subsector STRING", [("CRWD", "Cyber")]), rows("industry STRING, subsector STRING", [("Software", "Cloud")]))
    assert got(out, "trade_id", "subsector") == {"a": "Cyber", "b": "Cloud", "c": None, "d": None}
    assert got(K.with_tier(df), "trade_id", "committee_tier") == {"a": "STRONG", "b": "WEAK", "c": "NEUTRAL", "d": None}


def test_names_are_resolved_by_built_in_functions_by_default(spark):
    src = spark.createDataFrame([("Jonathan Smithson", "house")], "name string, chamber string")
    filers = spark.createDataFrame([("F1", "Jonathan Smithsen", "house")], "filer_id string, name string, chamber string")
    out = R.resolve_names(src, filers)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    assert [r.filer_id for r in out.collect()] == ["F1"]
    assert [r.filer_id for r in R.resolve_names(src, filers, exact_ratio=True).collect()] == ["F1"]


def test_pairs_that_are_not_near_stay_in_the_join(spark, rows):
    """Names that meet under a key are scored where they meet; no pair is joined to its names again."""
    people = rows("filer_id STRING, name STRING, chamber STRING", [(f"p{i}", f"Michael {a}{b}son", "H") for i, (a, b) in enumerate((a, b) for a in "bcdfg" for b in "aeiou")] + [
        (None, "Michael Bensons", "H"), ("q", None, "H")])
    src = rows("name STRING, chamber STRING", [("Mike Banson", "H"), ("Mike Zzyzx", "H"), ("Michael Gosun", None)])
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = R.resolve_names(src, people)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "SortMergeJoin [key#" in plan and "SortMergeJoin [filer_id#" not in plan
        got = {r.name: r.filer_id for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert got == {"Mike Banson": "p0", "Michael Gosun": "p23"}
    names = R._name_parts(src, "name", "s")
    held = R._name_parts(people.select("filer_id", F.col("name").alias("f_name"), F.col("chamber").alias("f_chamber")), "f_name", "f")
    near = R.levenshtein_ratio(F.col("s_full"), F.col("f_full")) > 0.9
    assert {(r.name, r.filer_id) for r in R.candidate_pairs(names, held, 0.82, False, near).collect()} == {("Michael Gosun", "p23")}
