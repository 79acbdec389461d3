"""Jaccard join, components, decontamination, line dedup."""

import random

import numpy as np
import pyarrow as pa
import pytest

from filingscope.llm import decontaminate, jaccard, line_dedup
from filingscope.llm.cuckoo import Cuckoo
from filingscope.llm.graph import components
from filingscope.llm.words import NOT_SPACE, pieces, words
from tests.llm import brute


@pytest.mark.parametrize(("size", "percent"), [(4, 85), (5, 80), (2, 50)])
def test_groups_match_all_pairs(docs, texts, size, percent):
    got = {r[0]: tuple(r)[1:] for r in jaccard.jaccard_groups(docs, size, percent).collect()}
    assert got == brute.groups(texts, size, percent)


def test_groups_edge_cases(spark, no_docs):
    assert jaccard.jaccard_groups(no_docs).collect() == []
    rows = spark.createDataFrame([(3, "a b c d e f"), (3, "a b c d e f"), (None, "a b c d e f"), (9, "A b  c d e f"), (4, None)], "doc_id long, text string")
    got = sorted(jaccard.jaccard_groups(rows).collect(), key=str)
    assert sorted(map(tuple, got), key=str) == sorted([(3, 2, 3), (3, 2, 3), (None, 2, None), (9, 2, 3), (4, 0, 4)], key=str)


def test_one_row_of_each_group(spark, no_docs):
    """Repeated and null ids: a row goes only for its own text, and each group keeps one row."""
    near, other = "a b c d e f", "p q r s t u v"
    rows = [
        (3, near, 1), (3, near, 2), (None, near, 3), (9, "A b  c d e f", 4), (4, None, 5), (4, "", 6), (None, None, 7),
        (9, other, 8),  # shares its id with a near copy and stays
        (7, "x y z x y w", 9), (None, "x y z x y w", 10), (None, "only null ids here now", 11), (None, "only null ids here now", 12)]
    docs = spark.createDataFrame([(t, i, k, 0) for i, t, k in rows], "text string, doc_id long, __row int, __row_ int")
    kept = jaccard.one_of_each(docs)
    assert kept.columns == docs.columns
    stay = {r["__row"] for r in kept.collect()}
    assert stay - {1, 2, 11, 12} == {5, 6, 7, 8, 9} and len(stay & {1, 2}) == 1 and len(stay & {11, 12}) == 1
    assert jaccard.one_of_each(no_docs).collect() == []


def test_words_with_equal_power_sums_differ(spark):
    """Thue-Morse words have equal sums of powers modulo 2 ** 64 under any odd base."""
    bits = [bin(k).count("1") % 2 for k in range(1024)]
    one, two = "".join("ab"[b] for b in bits), "".join("ba"[b] for b in bits)
    long, tail = one * 40, " then words that follow here"
    rows = [(1, one), (2, two), (3, f"{one} {two}"), (4, f"{one} {one}"), (5, long + tail), (6, two * 40 + tail), (7, long.upper() + tail), (8, one[:60]), (9, two[:60])]
    got = {r[0]: tuple(r)[1:] for r in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.groups(rows, 4, 85)


def test_word_hashes():
    r = random.Random(4)
    made = ["".join(r.choice("abé") for _ in range(r.randint(1, 300))) for _ in range(3000)] + ["a" * k for k in range(1, 200)]
    distinct = sorted(set(made))
    texts = pa.array([" ".join(distinct), *distinct, " ".join(distinct).upper().replace("É", "é")])
    found = [(words(raw, offsets, NOT_SPACE), offsets) for _, raw, offsets in pieces(texts)]
    hashes = np.concatenate([w[2] for w, _ in found])
    n = len(distinct)
    assert len(hashes) == 3 * n and len(np.unique(hashes)) == n
    assert (hashes[:n] == hashes[n:2 * n]).all() and (hashes[:n] == hashes[2 * n:]).all()


def test_large_family_in_several_blocks(spark, monkeypatch):
    monkeypatch.setattr(jaccard, "BLOCK_ROWS", 20)
    monkeypatch.setattr(jaccard, "TILE_ROWS", 7)
    monkeypatch.setattr(jaccard, "TILE_GRAMS", 16)
    r = random.Random(1)
    base, rows = [f"w{k}" for k in range(60)], []
    for i in range(90):
        own = list(base)
        for _ in range(r.choice([0, 1, 2, 6])):
            own[r.randrange(60)] = f"x{r.randrange(1000)}"
        rows.append((i, " ".join(own)))
    got = {x[0]: tuple(x)[1:] for x in jaccard.jaccard_groups(spark.createDataFrame(rows, "doc_id long, text string"), 4, 85).collect()}
    assert got == brute.groups(rows, 4, 85)


def test_signatures_never_miss_a_pair():
    """Any two sets at or above the threshold share a signature of a scheme."""
    rng, sizes = np.random.default_rng(3), jaccard.Sizes(85)
    for n in [*range(1, 40), 100, 333]:
        for _ in range(20):
            a = np.unique(rng.integers(0, 2**64, n, np.uint64))
            gone = rng.integers(0, max(1, n * 15 // 100 + 1))
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 2**64, rng.integers(0, n * 15 // 100 + 1), np.uint64)]))
            o = len(np.intersect1d(a, b))
            if 100 * o >= 85 * (len(a) + len(b) - o) and len(b) and not np.array_equal(a, b):
                for share in (0, 0.1, 0.5, 1):
                    common = np.unique(rng.permutation(np.union1d(a, b))[:int(share * len(a))])
                    own = [{(s, int(x)) for s, v in jaccard.signatures(y, sizes, common) for x in v} for y in (a, b)]
                    assert own[0] & own[1]


def test_common_grams_are_bounded(spark, monkeypatch):
    rows = spark.createDataFrame([(k, f"a b c d e {k} {k + 1} {k + 2}" + " u v w x y" * (k % 2)) for k in range(60)], "doc_id long, text string")
    some = jaccard.common_grams(rows, 5)
    assert 2 <= len(some) < 20
    monkeypatch.setattr(jaccard, "COMMON", 1)
    assert len(jaccard.common_grams(rows, 5)) <= 1


def test_a_signature_of_many_classes_enters_once(monkeypatch):
    sig, own = np.array([5, 7, 5, 5, 9], np.uint64), np.array([4, 1, 2, 8, 3])
    s, o, e = jaccard._leaders(sig, own)
    assert s.tolist() == [5, 7, 9] and o.tolist() == [2, 1, 3] and sorted(map(tuple, e.tolist())) == [(4, 2), (8, 2)]


@pytest.mark.parametrize("rows", [200_000, 0])
def test_components_with_a_hub(spark, monkeypatch, rows):
    """Both joins: broadcast and shuffled."""
    monkeypatch.setattr("filingscope.llm.store.BROADCAST_ROWS", rows)
    edges = [(1000, k) for k in range(50)] + [(k, 2000 + k) for k in range(0, 50, 2)] + [(3000, 3001), (3001, 3002)]
    got = {r[0]: r[1] for r in components(spark.createDataFrame(edges, "a long, b long"), "hub").collect()}
    want = {x: 0 for e in edges[:-2] for x in e if x} | {3001: 3000, 3002: 3000}
    assert got == want


def test_components_of_a_long_path(spark):
    edges = spark.range(200).selectExpr("id AS a", "id + 1 AS b").unionByName(spark.createDataFrame([(500, 400), (500, 500)], "a long, b long"))
    got = {r[0]: r[1] for r in components(edges, "path").collect()}
    assert got == {**{k: 0 for k in range(1, 201)}, 500: 400}


BENCH = [(1, "the quick brown fox jumps over the lazy dog and then sleeps for a day"), (2, "Short item"), (3, None), (4, ""), (5, "the quick brown fox jumps over the lazy dog and"), (10, "!!!")]
HOLDERS = [
    (1, "Well: the QUICK brown fox; jumps over the lazy dog and then sleeps for an hour"), (2, "a short item, indeed"), (3, None), (4, ""), (5, "short"),
    (6, "item short"), (7, "the quick brown fox jumps over the lazy dog"), (8, "x " * 3000 + "short item " + "y " * 3000), (8, "short ITEM short item"), (None, "short item")]


def test_contamination(spark):
    docs, bench = spark.createDataFrame(HOLDERS, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    want = sorted(brute.contamination(HOLDERS, BENCH), key=str)
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str) == want
    kept = decontaminate.without_contaminated(docs, bench).collect()
    assert sorted(r[0] for r in kept) == [3, 4, 5, 6, 7]
    cut = {r[0]: r[1] for r in decontaminate.without_passages(docs, bench).collect()}
    assert cut[2] == "a , indeed" and cut[3] is None and cut[1] == "Well:  an hour" and cut[7] == HOLDERS[6][1]


def test_contamination_by_join(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BROADCAST_CHARS", 0)
    rows = [h for h in HOLDERS if h[0] is not None and h[1] != "short ITEM short item"]
    docs, bench = spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(BENCH, "item_id long, text string")
    assert sorted(map(tuple, decontaminate.contamination(docs, bench).collect()), key=str) == sorted(brute.contamination(rows, BENCH), key=str)
    assert sorted(r[0] for r in decontaminate.without_contaminated(docs, bench).collect()) == [3, 4, 5, 6, 7]


@pytest.mark.parametrize("bound", ["BROADCAST_CHARS", "BROADCAST_BYTES"])
def test_both_contamination_paths_return_equal_rows(spark, monkeypatch, bound):
    """Null and repeated ids of documents and items; rows that share an id are clean or not on their own."""
    rows = [*HOLDERS, (None, "clean without an id"), (8, "a clean row of a repeated id"), (8, "a clean row of a repeated id")]
    docs = spark.createDataFrame([(t, i, "x") for i, t in rows], "text string, doc_id long, id string")
    bench = spark.createDataFrame([*BENCH, (None, "short item"), (None, "an hour"), (2, "short item")], "item_id long, text string")

    def results():
        some = [f(docs, bench) for f in (decontaminate.contamination, decontaminate.without_contaminated, decontaminate.without_passages)]
        return [(x.columns, sorted(map(tuple, x.collect()), key=str)) for x in some]

    scanned = results()
    far = [(99 if i is None else i, t) for i, t in bench.collect()]
    want = [(i, n, h, [None if x == 99 else x for x in own]) for i, n, h, own in brute.contamination(rows, far)]
    assert scanned[0][1] == sorted(want, key=str)
    assert [r[1] for r in scanned[1][1]].count(8) == 2 and ("clean without an id", None, "x") in scanned[1][1]
    monkeypatch.setattr(decontaminate, bound, 0)
    assert decontaminate._load(bench, decontaminate.WINDOW) is None
    assert results() == scanned


def test_contamination_of_nothing(spark, no_docs, docs):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.contamination(no_docs, bench).collect() == []
    assert decontaminate.without_contaminated(docs, bench).count() == docs.count()


def test_lines(docs, texts):
    got = sorted(map(tuple, line_dedup.line_report(docs).collect()))
    assert got == sorted(brute.line_drops(texts))
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    want = {i: (None if dict(texts)[i] is None else t) for i, t, _, _ in brute.line_drops(texts)}
    assert {r.doc_id: r.text for r in kept.collect()} == want


def test_lines_edge_cases(spark, no_docs):
    assert line_dedup.line_report(no_docs).collect() == []
    line = "a line that is long enough to be a key of its own"
    rows = spark.createDataFrame([(1, line), (1, line), (2, line), (None, line), (3, line)], "doc_id long, text string")
    assert {(r.doc_id, r.n_dropped) for r in line_dedup.line_report(rows, min_docs=3).collect()} == {(1, 1), (2, 1), (None, 0), (3, 0)}
    assert {r.n_dropped for r in line_dedup.line_report(rows, min_docs=4).collect()} == {0}


def _state(index):
    return (
        sorted(map(tuple, index.drops().collect())), sorted(map(tuple, index.counts.collect())),
        sorted(map(tuple, index.postings.select("k1", "k2", "doc_id", "refs").collect())))


def test_line_index_is_reversible(docs):
    first, second = docs.filter("doc_id % 2 = 0"), docs.filter("doc_id % 2 = 1")
    one = line_dedup.LineIndex.of(first, 3)
    both = one.insert(second)
    assert _state(both) == _state(line_dedup.LineIndex.of(docs, 3))
    assert _state(both.delete(second)) == _state(one)
    assert _state(both.insert(second)) == _state(both)
    cells = [Cuckoo.load(bytes(r[1])) for r in both.delete(docs).filters.collect()]
    assert all(not c.cells.any() for c in cells)


def test_line_index_grows_from_nothing(spark, docs, no_docs, monkeypatch):
    """An index started empty gets more shards; many changes, the last of which write it anew, equal one pass."""
    monkeypatch.setattr(line_dedup, "SHARD_KEYS", 2)
    monkeypatch.setattr(line_dedup, "CHANGES", 3)
    lines = [f"line number {k} that is long enough to be a key of its own" for k in range(24)]
    many = docs.select("doc_id", "text").unionByName(spark.createDataFrame([(2000 + k, "\n".join(lines[k % 5:k % 5 + 12])) for k in range(20)], "doc_id long, text string"))
    index = line_dedup.LineIndex.of(no_docs, 3)
    assert index.shards == 1 and index.drops().collect() == []
    for k in range(4):
        index = index.insert(many.filter(f"doc_id % 4 = {k}"))
    whole = line_dedup.LineIndex.of(many, 3)
    assert index.shards == whole.shards > 2 and index.keys == whole.keys and _state(index) == _state(whole)
    assert _state(index.insert(many.filter("doc_id % 4 = 1"))) == _state(whole)
    few = index.delete(many.filter("doc_id % 3 = 0"))
    assert _state(few) == _state(line_dedup.LineIndex.of(many.filter("doc_id % 3 <> 0"), 3))


def test_filters_decide_at_any_size(docs):
    """Filters too large for a broadcast meet the postings shard by shard, with equal results."""
    index = line_dedup.LineIndex.of(docs, 3)
    rows = index.postings.select("doc_id", "k1", "k2")
    want = sorted(map(tuple, index.drops().collect()))
    assert want and sorted(map(tuple, index.drops(filter_bytes=-1).collect())) == want
    kept = index._probed_by_shard(rows, group=7)
    assert kept.count() < rows.count() and kept.select("k1", "k2").distinct().count() >= index.keys
    assert sorted(map(tuple, kept.join(index.counts.filter("docs >= 3"), ["k1", "k2"]).filter("doc_id < last").select("doc_id", "k1", "k2").collect())) == want


def test_lines_of_long_texts_and_clashing_columns(spark):
    shared = "a line that five documents share, long enough to count"
    rows = [(k, "\n".join([f"own {k} {j}" for j in range(60_000)] + [shared])) for k in range(5)]
    docs = spark.createDataFrame([(*r, 7) for r in rows], "doc_id long, text string, __drops int")
    kept = line_dedup.dedup_lines(docs)
    assert kept.columns == docs.columns and {r.doc_id: r.text.count(shared) for r in kept.collect()} == {0: 0, 1: 0, 2: 0, 3: 0, 4: 1}
    assert all(r.text == dict(rows)[r.doc_id].removesuffix("\n" + shared) for r in kept.filter("doc_id < 4").collect())


def test_cuckoo_filter():
    rng = np.random.default_rng(0)
    k1, k2 = rng.integers(0, 2**64, (2, 20_000), np.uint64)
    f = Cuckoo.sized(20_000)
    assert f.add(k1, k2) and f.has(k1, k2).all()
    o1, o2 = rng.integers(0, 2**64, (2, 20_000), np.uint64)
    assert f.has(o1, o2).mean() < 0.001
    f = Cuckoo.load(f.dump())
    f.discard(k1[:10_000], k2[:10_000])
    assert f.has(k1[10_000:], k2[10_000:]).all() and f.has(k1[:10_000], k2[:10_000]).mean() < 0.001
    f.discard(k1[10_000:], k2[10_000:])
    assert not f.cells.any()
    assert not Cuckoo.sized(100).add(k1, k2)
