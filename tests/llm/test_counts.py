"""The rule learner counts a document again only on the smaller side of a condition."""

from filingscope.llm import rules


def test_counts_are_taken_off_instead_of_counted_again(spark, monkeypatch):
    names = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_distinct long, n_upper long"
    rows = [(k, 100, 100 * (5 + 2 * (k // 60)), k % 7, 0, 0, 80 - k % 3, 0) for k in range(900)]
    labels = [(k, (k // 60) % 2 ^ (k % 41 == 0)) for k, *_ in rows]
    stats, known = spark.createDataFrame(rows, names), spark.createDataFrame(labels, "doc_id long, quality int")
    counted, sizes = rules._counted, []

    def noted(part):
        out = counted(part)
        sizes.append(sum(n for k, n in out.items() if k[0] == 0))
        return out

    monkeypatch.setattr(rules, "_counted", noted)
    found, here = str(rules.learn(stats, known)), list(sizes)
    assert found.count("reject if") > 3 and sum(size == max(here) for size in here) == 1
    monkeypatch.setattr(rules, "_meeting", lambda part, counts, condition, meets: noted(part.filter(condition)))
    sizes.clear()
    assert str(rules.learn(stats, known)) == found
    assert sum(here) < sum(sizes)
