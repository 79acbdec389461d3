"""Packing, token counts, surrogates, quality vote, quality rules."""

import re
import zlib

import numpy as np
import pytest

from filingscope.llm import packing, pii, quality, rules, token_count
from tests.llm import brute

ODD = ["<|endoftext|> x", "<|ENDOFTEXT|>", "don't can't we'll 'S", "ÉCOLE. Straße, ½ 2³ x²", "İstanbul ΟΔΟΣ", "éte", "a b\x1cc", "4a. !!word. word.,", "4.0. x", "日本語 テキスト", "\U0001f600 ok"]


def _ids(text):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(packing.tokenizer_path()).encode(text or "", add_special_tokens=False).ids + [0]


def test_pieces_and_places(spark, texts):
    rows = texts + [(1000 + k, t) for k, t in enumerate(ODD)] + [(5, "again"), (5, "again"), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = packing.pack(docs, capacity=256).collect()
    want = []
    for doc, text in rows:
        ids = _ids(text)
        want += [(doc, k // 256, k, len(ids[k:k + 256]), zlib.crc32(np.array(ids[k:k + 256], "<u4").tobytes())) for k in range(0, len(ids), 256)]
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(want, key=str)
    sequences = {}
    for r in got:
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 256
    rooms = []
    for length in sorted((r.length for r in got), reverse=True):  # plain best-fit, longest first
        room = min((x for x in rooms if x >= length), default=None)
        if room is None:
            rooms.append(256 - length)
        else:
            rooms[rooms.index(room)] -= length
    assert -(-sum(r.length for r in got) // 256) <= len(sequences) <= len(rooms)
    assert packing.pack(docs.limit(0)).collect() == []


@pytest.mark.parametrize("histogram", [{}, {2048: 7}, {1025: 5}, {1: 5000}, {700: 10, 1400: 10, 648: 9}, {k: 1 + k % 7 for k in range(1, 2049, 3)}])
def test_plan_holds_everything(histogram):
    groups = packing.plan(dict(histogram))
    held = {}
    for lengths, n in groups:
        assert n > 0 and sum(lengths) <= 2048
        for x in lengths:
            held[x] = held.get(x, 0) + n
    assert held == {k: v for k, v in histogram.items() if v}
    least = max(-(-sum(k * v for k, v in histogram.items()) // 2048), sum(v for k, v in histogram.items() if k > 1024))
    assert sum(n for _, n in groups) <= least * 1.02 + 1


def test_pricing_is_exact():
    rng = np.random.default_rng(2)
    for _ in range(20):
        size = np.unique(rng.integers(1, 20, 5))
        value = rng.random(len(size))
        best = np.zeros(31)
        for c in range(1, 31):
            best[c] = max([best[c - 1], *(best[c - s] + v for s, v in zip(size, value) if s <= c)])
        own = packing._price(value, size, 30)
        assert sum(size[k] * n for k, n in own.items()) <= 30
        assert abs(sum(value[k] * n for k, n in own.items()) - best[30]) < 1e-9


def test_counts_match_the_tokenizer(spark, texts):
    from tokenizers import Tokenizer, models

    own = token_count.vocabulary(token_count.vocabulary_path())
    model = Tokenizer(models.Unigram([("<unk>", 0.0), *[(f"<0x{i:02X}>", 0.0) for i in range(256)], *own], unk_id=0, byte_fallback=True))
    rows = texts + [(1000 + k, t) for k, t in enumerate(ODD[2:])] + [(5, "a  b   c\n\n d"), (None, "x")]
    got = token_count.count_tokens(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    want = [(d, len(model.encode("▁" + t.replace(" ", "▁")).ids) if t else 0) for d, t in rows]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)


def test_ties_keep_the_first_start():
    count = token_count.Counter([("▁", -1.0), ("a", -1.0), ("b", -1.0), ("aa", -2.0), ("▁aa", -3.0), ("ab", -3.0)])
    assert count.text("aa") == (1, -3.0)
    assert count.text("ab") == (3, -3.0)
    assert count.text("aé") == (4, -2.0 + count.unknown)
    with pytest.raises(ValueError):
        token_count.Counter([("a▁b", 1.0)])


PERSONAL = [
    (1, "Write to Anna.Lee@mail3.example.com or +1 (632) 555-4827; Mrs. Anna Lee and Mrs. Lee agree."), (2, "ANNA.LEE@MAIL3.EXAMPLE.COM, 10.20.30.40, 4111 1111 1111 1111, 4111-1111-1111-1111"),
    (3, 'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" password: hunter2hunter2'), (4, "Госпожа Анна Петрова, Κυρία Ελένη, Herr Schmidt-Meier"), (5, None), (6, ""), (7, "Nothing here, 12 of 34 times 5.6.7"),
    (8, "+16325554827"), (8, "+16325554827"), (9, "DE44 5001 0517 5407 3249 31 or DE44500105175407324931; 123-45-6789.")]


def test_surrogates(spark):
    docs = spark.createDataFrame([(*r, "k") for r in PERSONAL], "doc_id long, text string, kind string")
    got = {r.doc_id: r for r in pii.with_surrogates(docs, b"key").collect()}
    for doc, text in PERSONAL:
        for start, end, _, _ in pii.mentions(text or ""):
            assert text[start:end].lower() not in got[doc].text.lower()
    assert (got[5].text, got[6].text, got[7].text, got[7].n_entities) == (None, "", PERSONAL[6][1], 0)
    mail = re.search(r"\S+@\S+", got[1].text)[0]
    assert mail.upper() == re.search(r"[^ ,]+@[^ ,]+", got[2].text)[0]
    phone = re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", got[1].text)[0]
    assert got[8].text == "+" + re.sub(r"\D", "", phone)
    name = re.search(r"Mrs\. (\w+) (\w+) and Mrs\. (\w+) agree", got[1].text)
    assert name[2] == name[3] and name[1].endswith("a")
    a, b = re.search(r"(\d{4} \d{4} \d{4} \d{4}), (\d{4}-\d{4}-\d{4}-\d{4})", got[2].text).groups()
    assert a.replace(" ", "") == b.replace("-", "") and pii._luhn(a.replace(" ", "")) == 0
    assert re.fullmatch(r"Госпожа [А-Я][а-я]+ [А-Я][а-я]+, Κυρία [Α-Ω][α-ως]+, Herr [A-Z][a-z]+", got[4].text)
    assert re.search(r'"[0-9a-f]{40}"', got[3].text)
    iban = re.fullmatch(r"(DE\d\d(?: \d{4}){4} \d\d) or (DE\d{20}); \d{3}-\d{2}-\d{4}\.", got[9].text)
    assert iban[1].replace(" ", "") == iban[2]
    assert pii.with_surrogates(docs.limit(0), b"key").collect() == []
    other = {r.doc_id: r.text for r in pii.with_surrogates(docs, b"other").collect()}
    assert other[1] != got[1].text


def test_names_without_a_title_and_one_gender(spark):
    """Later mentions of a titled name go too; a given name has one surrogate whatever title each document gives."""
    rows = [
        (1, "Dr. Anna Lee and Mrs. Anna Lee met. Anna Lee spoke; Lee's paper, ANNA's and Lee-led work. Fleet and lee stay, and Annabel."),
        (2, "Dr. Anna Petrov came, Anna said."), (2, "Frau Dr. Anna Petrov came."), (3, "Mr. Kim Olsen, Kim Olsen"), (4, "Ms. Kim Olsen"), (5, "Dr. Kim Olsen, Mr. Kim"),
        (None, "Lee and Anna without any title stay."), (6, "Mr. Lee Brown met Mrs. Lee. Lee Brown and Lee."), (7, "Госпожа Анна Петрова. Анна Петрова, Петрова")]
    got = {}
    for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect():
        got.setdefault(r.doc_id, []).append((r.text, r.n_entities))
    text, n = got[1][0]
    m = re.fullmatch(r"Dr\. (\w+) (\w+) and Mrs\. (\w+) (\w+) met\. (\w+) (\w+) spoke; (\w+)'s paper, (\w+)'s and (\w+)-led work\. Fleet and lee stay, and Annabel\.", text)
    assert {m[k].lower() for k in (1, 3, 5, 8)} == {m[1].lower()} and {m[k] for k in (2, 4, 6, 7, 9)} == {m[2]} and n == 9
    assert m[1] != "Anna" and m[1].endswith("a") and m[2] != "Lee" and m[8].isupper()
    for a, _ in got[2]:
        assert a.split()[a.split().index("came,") - 2 if "said" in a else 2] == m[1] and "Petrov" not in a
    assert sorted(a.endswith(f"{m[1]} said.") for a, _ in got[2]) == [False, True]
    kim = re.fullmatch(r"Mr\. (\w+) (\w+), (\w+) (\w+)", got[3][0][0])
    assert kim.group(1, 2) == kim.group(3, 4) and got[4][0][0] == f"Ms. {kim[1]} {kim[2]}" and got[5][0][0] == f"Dr. {kim[1]} {kim[2]}, Mr. {kim[1]}"
    assert got[None] == [(rows[6][1], 0)]
    b = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs\. (\w+)\. (\w+) (\w+) and (\w+)\.", got[6][0][0])
    assert b.group(1, 2) == b.group(4, 5) and b[3] == b[6] == m[2]
    assert re.fullmatch(r"Госпожа (\w+) (\w+)\. \1 \2, \2", got[7][0][0]) and "Анна" not in got[7][0][0]


def test_names_of_other_scripts_keep_them(spark):
    texts = ["Dr. 王伟 came, and 王伟 said.", "Mr. محمد علي, علي", "Mrs. שרה כהן met שרה", "Dr. 김민수, 김민수", "Mrs. अनिता शर्मा", "Dr. Łukasz Żak"]
    rows = [(k % 2 or None, t) for k, t in enumerate(texts)] * 2
    got = sorted({r.text for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()})
    assert len(got) == len(texts)
    patterns = [
        r"Dr\. ([一-龥]{2}) came, and \1 said\.", r"Mr\. [\u0600-\u06ff]{4} ([\u0600-\u06ff]{3}), \1", r"Mrs\. ([\u05d0-\u05f2]{3}) [\u05d0-\u05f2]{3} met \1",
        r"Dr\. ([가-힣]{3}), \1", r"Mrs\. [\u0900-\u0963\u0971-\u097f]{5} [\u0900-\u0963\u0971-\u097f]{5}", r"Dr\. [A-Z][a-z]+ [A-Z][a-z]+"]
    for pattern, text in zip(patterns, texts):
        assert sum(re.fullmatch(pattern, t) is not None for t in got) == 1 and text not in got


def test_a_small_space_of_surrogates_grows(spark, monkeypatch):
    """More entities than surrogates of their length: all get one, none are equal or real; rows without an id and long texts too."""
    plain = pii.surrogate
    monkeypatch.setattr(pii, "_SAME_LENGTH", 2)
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt=0: plain(key, kind, value, attempt)[:1] * 6 + plain(key, kind, value, attempt)[6:])
    own = [f"+1632555{k:04d}" for k in range(0, 600, 20)]
    rows = [(None, f"call {x}") for x in own] + [(None, f"call {own[0]}"), (1, "pad " * 200_000 + own[1])]
    got = [(r.doc_id, r.text) for r in pii.with_surrogates(spark.createDataFrame(rows, "doc_id long, text string"), b"key").collect()]
    numbers = [t.split("+")[1] for _, t in got]
    assert len(set(numbers)) == len(own) and not {f"+{n}" for n in numbers} & set(own)
    assert numbers.count(dict(zip([t for _, t in rows], numbers))["call " + own[0]]) == 2
    assert [t for d, t in got if d == 1] == ["pad " * 200_000 + "+" + dict(zip([t for _, t in rows], numbers))["call " + own[1]]]


def test_colliding_surrogates_are_told_apart(spark, monkeypatch):
    monkeypatch.setattr(pii, "surrogate", lambda key, kind, value, attempt=0: str((int(value) + attempt * 7) % 5 + 100 * attempt))
    entities = spark.createDataFrame([("ip", str(k)) for k in range(40)], "kind string, value string")
    rows = pii.assign(entities, b"").collect()
    made = [r.surrogate for r in rows]
    assert len(rows) == 40 and len(set(made)) == 40 and not set(made) & {str(k) for k in range(40)}


def test_quality_vote(spark, sf):
    docs, labels = spark.read.parquet(f"{sf}/../sf0.01/documents.parquet"), spark.read.parquet(f"{sf}/../sf0.01/labels.parquet")
    rows = quality.quality_report(docs, labels).join(labels, "doc_id").filter("held_out").collect()
    assert len(rows) > 50 and sum(r.predicted == r.quality for r in rows) >= 0.93 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)


def test_vote_edge_cases(spark, docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (2, None), (None, 1), (4, 1), (7, 0)], "doc_id long, quality int")
    rows = quality.quality_report(docs, labels).collect()
    assert len(rows) == docs.count() and all(r.predicted == int(r.score >= 0.7) for r in rows)
    assert quality.quality_report(no_docs, labels).collect() == []
    assert {r.score for r in quality.quality_report(docs, labels.limit(0)).collect()} == {1.0}
    assert quality.accepted(docs, docs, labels.limit(0)).count() == docs.count()


def test_blocked_scores_equal_single_products():
    rng = np.random.default_rng(0)
    space = quality.Space(rng.random((50, quality.TERMS)).astype(np.float32), rng.integers(0, 2, 50))
    terms = rng.random((600, quality.TERMS)).astype(np.float32)
    assert (space.scores(terms) == np.concatenate([space.scores(terms[k:k + 1]) for k in range(600)])).all()


def test_votes_against_plain_integers():
    """Exact products by Python integers; equal neighbours, of which the first ones vote; repeated documents score alike."""
    rng = np.random.default_rng(4)
    few = (rng.random((12, quality.TERMS)) * (rng.random((12, quality.TERMS)) < 0.02)).astype(np.float32)
    known, labels = few[rng.integers(0, 12, 60)], rng.integers(0, 2, 60)
    space = quality.Space(known, labels)
    asked = np.concatenate([few, (rng.random((20, quality.TERMS)) < 0.01).astype(np.float32), np.zeros((1, quality.TERMS), np.float32)])
    got = space.scores(np.concatenate([asked, asked[::-1]]))
    assert (got[:33] == got[33:][::-1]).all()
    own, tied = [[int(x) for x in v] for v in space.vectors], 0
    for terms, score in zip(asked, got):
        v = [int(x) for x in space.unit(terms[None])[0]]
        near = [sum(a * b for a, b in zip(v, w)) for w in own]
        order = sorted(range(60), key=lambda i: (-near[i], i))
        tied += near[order[quality.NEIGHBOURS - 1]] == near[order[quality.NEIGHBOURS]]
        weight = {i: max(near[i] / quality.VECTOR_UNIT**2, 0) ** 4 + 1e-6 for i in order[:quality.NEIGHBOURS]}
        assert abs(score - sum(w * labels[i] for i, w in weight.items()) / sum(weight.values())) < 1e-12
    assert tied > 5


def test_rule_statistics(docs, texts, no_docs):
    got = {r[0]: tuple(r)[1:6] for r in rules.statistics(docs).collect()}
    assert got == {i: brute.base_statistics(t) for i, t in texts}
    assert rules.statistics(no_docs).collect() == []


def test_learned_rules(spark):
    good, bad = "plain words in a long enough line of text number", "more ### words $$$ with && marks %% and | so on ||"
    rows = [(k, f"{good} {k} {k + 1} {k * 7}" if k % 4 else f"{bad} {k} {k + 1}") for k in range(400)] + [(900, None), (901, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 4 > 0)) for k in range(400)] + [(900, None), (None, 0)], "doc_id long, quality int")
    got = {r.doc_id: r for r in rules.judged(docs, labels).collect()}
    assert all(got[k].kept == (k % 4 > 0) for k in range(400))
    assert got[900].base_failed and not got[901].kept
    assert str(rules.learn(rules.statistics(docs), labels)).startswith("1. reject if ")
    assert str(rules.learn(rules.statistics(docs), labels.limit(0))) == "keep all"
    plan = rules.judged(docs, labels)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_covering_has_no_cap(spark):
    """Twelve kinds of junk, each with its own value of a measure, are all covered, by however many rules it takes."""
    rows, labels, n = [], [], 0
    for kind in range(25):
        for _ in range(60):
            # Kinds differ in characters per word; every second kind is junk.
            rows.append((n, 100, 100 * (5 + 2 * kind), 0, 0, 0, 80, 0))
            labels.append((n, kind % 2 ^ 1))
            n += 1
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_upper long"
    found = rules.learn(spark.createDataFrame(rows, names), spark.createDataFrame(labels, "doc_id long, quality int"))
    assert len(found.rules) > 10
    fired = spark.createDataFrame(rows, names).withColumn("rule", found.fired()).collect()
    junk = {i for i, q in labels if q == 0}
    assert sum(x.rule > 0 for x in fired if x.doc_id in junk) >= 0.9 * len(junk)
    assert sum(x.rule > 0 for x in fired if x.doc_id not in junk) <= 0.05 * (n - len(junk))


def test_program_makes_most_sequences():
    """Most sequences come from the linear program, and there are no more than best-fit alone makes."""
    rng = np.random.default_rng(5)
    lengths, counts = np.unique(np.clip(rng.lognormal(6.3, 0.8, 20_000).astype(int), 1, 2048), return_counts=True)
    histogram = dict(zip(lengths.tolist(), counts.tolist()))
    groups, share = packing.planned(histogram)
    left = np.zeros(2049, np.int64)
    for k, n in histogram.items():
        left[k] = n
    alone = sum(n for _, n in packing.best_fit(left, 2048))
    assert sum(n for _, n in groups) <= alone and share > 0.5


def test_knapsack_prefers_long_pieces_and_fills():
    fit = packing._fitting([(9, 1), (7, 1), (5, 1), (2, 1), (2, 2)], 14)
    assert dict(fit) == {9: 1, 5: 1}
    assert dict(packing._fitting([(9, 1), (2, 1)], 8)) == {2: 1} and not packing._fitting([], 5)
