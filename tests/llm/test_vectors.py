"""Pivot-table clustering, language mixtures and the fill-in-middle transformation against plain versions."""

import hashlib
import math
import random
import re
from fractions import Fraction

import numpy as np
import pytest

from filingscope.llm import fill_middle, laesa, language


def vectors_of(spark, rows):
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>, cluster int, v string")


def plain_clusters(rows, size, k, rounds):
    kept = [(i, [math.floor(64 * x) for x in v]) for i, v in rows if v is not None and len(v) == size and all(x is not None and abs(x) < 2**21 for x in v)]
    order = sorted(kept, key=lambda r: ((1, "") if r[0] is None else (0, hashlib.sha256(f"1:{r[0]}".encode()).hexdigest()), r[1]))
    centroids = [list(v) for _, v in order[:k]]

    def nearest(v):
        return min((sum((a - b) ** 2 for a, b in zip(v, c)), n) for n, c in enumerate(centroids))

    for _ in range(rounds):
        held = {}
        for _, v in kept:
            held.setdefault(nearest(v)[1], []).append(v)
        for n, own in held.items():
            centroids[n] = [math.floor(Fraction(sum(c), len(own))) for c in zip(*own)]
    out = []
    for i, v in kept:
        d, n = nearest(v)
        out.append((i, n, d, hashlib.sha256(",".join(map(str, centroids[n])).encode()).hexdigest()))
    inertia = {n: sum(r[2] for r in out if r[1] == n) for n in {r[1] for r in out}}
    return sorted(((i, n, d, inertia[n], sum(inertia.values()), sha) for i, n, d, sha in out), key=repr)


@pytest.mark.parametrize("k", [1, 4, 16])
def test_clusters_equal_every_distance(spark, k):
    r = random.Random(k)
    rows = [(i, [r.gauss(i % 5, 1) for _ in range(6)]) for i in range(120)]
    rows += [(200 + i, [0.5] * 6) for i in range(60)]  # one common vector: ties between equal centroids
    rows += [(0, rows[0][1]), (None, rows[3][1]), (None, [2.0] * 6)]  # repeated and null ids
    rows += [(300, None), (301, []), (302, [1.0] * 5), (303, [1.0] * 7), (304, [1.0] * 5 + [None]), (305, [float("nan")] * 6), (306, [float("inf")] * 6)]
    rows += [(307, [1e6, -1e6, 0.0, -0.001, 2.0**-60, -(2.0**-60)]), (308, [2.0**21] + [0.0] * 5)]
    got = laesa.cluster_report(vectors_of(spark, [(i, v, 1, "x") for i, v in rows]).repartition(5), k, 3, 6)
    assert got.columns == ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 6, k, 3)


def test_no_vectors(spark):
    assert laesa.cluster_report(vectors_of(spark, []), 16, 3, 6).collect() == []
    assert laesa.cluster_report(vectors_of(spark, [(1, [1.0], 0, "")]), 16, 3, 6).collect() == []


def test_pivots_spare_distances():
    r = np.random.default_rng(1)
    centres = r.integers(-4000, 4000, (16, 8))
    v = centres[r.integers(0, 16, 2000)] + r.integers(-50, 50, (2000, 8))
    pivots = laesa.farthest(v[:100], 8)
    squares = np.stack([laesa.squares(v, p) for p in pivots], 1)
    cluster, distance, exact = laesa.nearest(v, squares, centres, pivots)
    every = np.stack([laesa.squares(v, c) for c in centres], 1)
    assert (distance == every.min(1)).all() and (cluster == every.argmin(1)).all()
    assert exact < 1.5 * len(v)


def plain_transform(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[8 * k:8 * k + 8], 16) for k in range(4))
    tokens = re.findall(r"[A-Za-z]+|[^A-Za-z]", text, re.S)
    n = len(tokens)
    if not text or any(m in text for m in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return n, "plain", None, None, text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = "".join(tokens[:a]), "".join(tokens[a:b]), "".join(tokens[b:])
    out = f"<S>{s}<P>{p}<M>{m}" if h4 % 100 < 20 else f"<P>{p}<S>{s}<M>{m}"
    return n, "spm" if h4 % 100 < 20 else "psm", len(p), len(m), out


def test_fill_middle_equals_plain(spark, texts):
    more = ["<P>", "a<S>b", "<M", "<", "<P", ">", "\U0001f600é\x00a\r\n中文 abc", "z" * 100_000, "é1" * 50_000, "a b\n" * 30_000, "<<P >S><M<"]
    rows = texts + [(1000 + 7 * k + j, t) for k, t in enumerate(more) for j in range(7)] + [(None, "null id"), (3, "again"), (3, "again"), (-5, "negative id")]
    docs = spark.createDataFrame([(i, t, 1, "x") for i, t in rows], "doc_id long, text string, n int, form string")
    out = fill_middle.transform(docs).withColumn("back", fill_middle.restored())
    got = sorted(map(tuple, out.collect()), key=repr)
    assert got == sorted(((i, *plain_transform(i, t), t or "") for i, t in rows), key=repr)
    assert {r[2] for r in got} == {"plain", "psm", "spm"}


def test_fill_middle_empty(spark, no_docs):
    assert fill_middle.transform(no_docs).collect() == []


def test_skip_list_places_every_rank():
    r = random.Random(2)
    for n in (0, 1, 2, 3, 5, 17, 300):
        widths = np.array([r.randint(1, 9) for _ in range(n)], np.int64)
        tokens = fill_middle.SkipList(widths)
        assert [tokens.place(k) for k in range(n + 1)] == [0, *np.cumsum(widths).tolist()]
        for rank in (-1, n + 1):
            with pytest.raises(IndexError):
                tokens.place(rank)
    wide = fill_middle.SkipList(np.ones(100_000, np.int64))
    assert len(wide.lanes) > 5 and len(wide.lanes[0][0]) < 20


WORDS = {
    "en": "the of and that with house water through which would there people small green evening",
    "de": "der die das und nicht haus wasser durch welche würde leute klein grün abend straße",
    "fr": "les des une avec maison eau travers laquelle serait gens petit verte soirée école où",
}


def sentences(lang, n, seed):
    r = random.Random(f"{lang}{seed}")
    return " ".join(r.choice(WORDS[lang].split()) for _ in range(n))


@pytest.fixture(scope="module")
def learned(spark):
    rows = [(i, sentences(lang, 60, i), lang) for i in range(40) for lang in WORDS] + [(None, "zzz", "xx"), (1, None, "yy"), (1, "unlabelled", None)]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string")


def trigrams(text):
    """Byte trigrams of each word, as a plain loop."""
    out = []
    for w in re.findall(rb"[a-z\x80-\xff]+", text.lower().encode()):
        b = b" " + w + b" "
        out.append([((b[i - 1] << 16 | b[i] << 8 | b[i + 1]) * 2654435761 % 2**32) >> 16 for i in range(1, len(b) - 1)])
    return out


def plain_share(words, logs, subset):
    """Proportions and log-likelihood by expectation-maximisation over lists."""
    like = [[sum(logs[k][g] for g in w) for k in subset] for w in words]
    share, total = [1 / len(subset)] * len(subset), 0
    for _ in range(language.STEPS):
        held, total = [0.0] * len(subset), 0.0
        for row in like:
            top = max(row)
            p = [s * math.exp(x - top) for s, x in zip(share, row)]
            total += math.log(sum(p)) + top
            held = [h + x / sum(p) for h, x in zip(held, p)]
        if len(subset) == 1:
            break
        new = [max(h / len(words), 1e-12) for h in held]
        new = [x / sum(new) for x in new]
        done = max(abs(a - b) for a, b in zip(new, share)) < language.SETTLED
        share = new
        if done:
            break
    return share, total


def plain_languages(text, langs, logs):
    words = trigrams(text)
    if not words:
        return []
    share, _ = plain_share(words, logs, range(len(langs)))
    order = sorted(range(len(langs)), key=lambda k: (-share[k], langs[k]))
    chosen = order[:1]
    share, best = plain_share(words, logs, chosen)
    for k in order[1:]:
        more, total = plain_share(words, logs, [*chosen, k])
        if total - best <= language.PENALTY * (math.log(len(words)) / 2 + math.log(len(langs))):
            break
        chosen, share, best = [*chosen, k], more, total
    return sorted(((langs[k], (s * len(words) + 1 / len(langs)) / (len(words) + 1)) for k, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))


def test_language_counts_and_mixture_equal_plain(spark, learned):
    model = language.fit(learned.repartition(7))
    known = [r for r in learned.collect() if r.text is not None and r.lang is not None]
    assert model.langs == sorted({r.lang for r in known})
    logs = []
    for lang in model.langs:
        n = np.full(language.BUCKETS, language.ADDED)
        for r in known:
            if r.lang == lang:
                for w in trigrams(r.text):
                    np.add.at(n, w, 1)
        logs.append(np.log(n / n.sum()).astype(np.float32).astype(float))
    assert np.array_equal(model.logs, np.stack(logs, 1).astype(np.float32))
    texts = [sentences("en", 40, 99), sentences("de", 30, 99) + " " + sentences("fr", 25, 98), "haus", "HAUS Straße", "qqq", "x1y2", sentences("fr", 200, 7) + " water people"]
    for t in texts:
        got, want = model.languages(t), plain_languages(t, model.langs, logs)
        assert [g[0] for g in got] == [w[0] for w in want]
        assert np.allclose([g[1] for g in got], [w[1] for w in want], atol=1e-6)
    assert {lang for lang, _ in model.languages(texts[1])} == {"de", "fr"}


def test_long_texts_in_blocks_agree(learned, monkeypatch):
    model = language.fit(learned)
    text = sentences("en", 3000, 1) + " " + sentences("de", 2000, 2)
    whole = model.languages(text)
    monkeypatch.setattr(language, "HELD_VALUES", 4096 * len(model.langs))
    parts = model.languages(text)
    assert [a for a, _ in whole] == [a for a, _ in parts] and np.allclose([s for _, s in whole], [s for _, s in parts])


def test_language_cases(spark, learned):
    model = language.fit(learned)
    rows = [(1, None), (2, ""), (3, "123 !? \n"), (4, "中文"), (5, sentences("de", 9, 1)), (5, sentences("de", 9, 1)), (None, sentences("fr", 9, 1)), (6, "der " * 300_000), (7, "a" * 500_000)]
    docs = spark.createDataFrame([(i, t, 0.5, "x") for i, t in rows], "doc_id long, text string, score double, lang_pred string")
    got = [tuple(r)[:3] for r in language.identify(docs, model).collect()]
    assert len(got) == len(rows)
    by = {r[0]: r for r in got}
    assert all(by[k][1:] == ("und", 0.0) for k in (1, 2, 3))
    assert by[4][1] in model.langs and by[7][1] in model.langs
    assert by[5][1] == "de" and by[6][1] == "de" and by[None][1] == "fr"
    assert sorted(got, key=repr).count(by[5]) == 2 and all(0 <= r[2] <= 1 for r in got)


def test_nothing_learned(spark, no_docs):
    model = language.fit(spark.createDataFrame([], "text string, lang string"))
    assert language.identify(spark.createDataFrame([(1, "the text")], "doc_id long, text string"), model).first().lang_pred == "und"
    assert language.identify(no_docs, model).collect() == []


def test_held_out_languages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    rows = language.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").filter("held_out").collect()
    assert rows and sum(r.lang == r.lang_pred for r in rows) >= 0.97 * len(rows)
