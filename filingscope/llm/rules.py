"""Quality rules: text statistics and decision lists learned from them by sequential covering.

Statistics, learning and verdicts are DataFrame operations; the driver sees counts by statistic and threshold only.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from math import log2

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import save

#: Thresholds of a statistic.
THRESHOLDS = 24
#: Share of rejected documents that a rule must have among those it covers when pruned, and how many it must cover.
PRECISION, SUPPORT = 0.97, 8

_SPACE = r"\\x20\\x09-\\x0D"
_WORDS = f"filter(split(text, '[{_SPACE}]+'), x -> x <> '')"
_LINES = f"filter(split(text, '\\n'), x -> x rlike '[^{_SPACE}]')"
# Each step binds its result to a lambda's argument, so that it is computed once.
_COVERED = """transform(array(sort_array(transform(h, (x, i) -> struct(x AS x, i AS i)))), s ->
  transform(array(sort_array(transform(filter(s, (d, k) -> (k > 0 AND s[greatest(k - 1, 0)].x = d.x) OR (k < size(s) - 1 AND s[least(k + 1, size(s) - 1)].x = d.x)), d -> d.i))), p ->
    aggregate(transform(p, (x, k) -> if(k < size(p) - 1, least(5, p[least(k + 1, size(p) - 1)] - x), 5)), 0, (a, x) -> a + x))[0])[0]"""
_REPEATED = f"""if(size(w) < 5, 0, transform(array(transform(sequence(0, greatest(size(w) - 5, 0)), i -> xxhash64(w[i], w[i + 1], w[i + 2], w[i + 3], w[i + 4]))), h ->
  if(size(array_distinct(h)) = size(h), 0, {_COVERED}))[0])"""
_BOUND = f"""transform(array({_WORDS}), w -> named_struct('n', size(w), 'chars', length(array_join(w, '')), 'distinct', size(array_distinct(w)), 'repeated', {_REPEATED}))[0]"""
_LINED = f"transform(array({_LINES}), l -> size(l) - size(array_distinct(l)))[0]"


def statistics(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text), as a written table: doc_id and counts over the whole text.

    n_words, word_chars (code points in words), n_symbols, n_dup_lines (lines with a word equal to an earlier one),
    n_repeat_words (words inside five-word windows that occur again), n_distinct (different words), n_upper (A-Z).
    Null and empty texts have zeros.  Whole texts count, however long; repeated rows are counted alike; extra columns are ignored.
    """
    own = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select(
        "doc_id", F.expr(_BOUND).alias("w"), F.expr("regexp_count(text, '[#*$%&|<>]')").alias("n_symbols"), F.expr(_LINED).alias("n_dup_lines"),
        F.expr("regexp_count(text, '[A-Z]')").alias("n_upper"))
    long = lambda c: F.col(c).cast("long")
    return save(own.select(
        "doc_id", long("w.n").alias("n_words"), long("w.chars").alias("word_chars"), long("n_symbols").alias("n_symbols"), long("n_dup_lines").alias("n_dup_lines"),
        long("w.repeated").alias("n_repeat_words"), long("w.distinct").alias("n_distinct"), long("n_upper").alias("n_upper")), "statistics")


def measures() -> dict[str, Column]:
    """What conditions compare: shares that don't depend on a text's length, and the length itself."""
    words, chars = F.greatest(F.col("n_words"), F.lit(1)), F.greatest(F.col("word_chars"), F.lit(1))
    return {
        "words": F.col("n_words").cast("double"), "chars_per_word": F.col("word_chars") / words, "symbols_per_word": F.col("n_symbols") / words,
        "dup_lines_per_word": F.col("n_dup_lines") / words, "repeated_share": F.col("n_repeat_words") / words, "distinct_share": F.col("n_distinct") / words,
        "upper_share": F.col("n_upper") / chars}


def base_failed() -> Column:
    return (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))


@dataclass(frozen=True)
class Condition:
    measure: str
    above: bool
    threshold: float

    def column(self) -> Column:
        m = measures()[self.measure]
        return m >= self.threshold if self.above else m < self.threshold

    def __str__(self) -> str:
        return f"{self.measure} {'>=' if self.above else '<'} {self.threshold:g}"


def _all(conditions: list[Condition]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c.column()
    return out


class DecisionList:
    """Ordered rules; a document takes the number of the first that covers it, 0 if none does."""

    def __init__(self, rules: list[list[Condition]]) -> None:
        self.rules = rules

    def fired(self) -> Column:
        if not self.rules:
            return F.lit(0)
        out = F.when(_all(self.rules[0]), F.lit(1))
        for k, rule in enumerate(self.rules[1:], 2):
            out = out.when(_all(rule), F.lit(k))
        return out.otherwise(F.lit(0))

    def __str__(self) -> str:
        return "\n".join(f"{k}. reject if {' and '.join(map(str, r))}" for k, r in enumerate(self.rules, 1)) or "keep all"


def _place(measure: Column, thresholds: list[float]) -> Column:
    """How many of the thresholds the measure reaches."""
    return F.size(F.filter(F.array(*[F.lit(float(t)) for t in thresholds]), lambda t: t <= measure)) if thresholds else F.lit(0)


def _gain(p0: int, n0: int, p1: int, n1: int) -> float:
    return p1 * (log2(p1 / (p1 + n1)) - log2(p0 / (p0 + n0))) if p1 else 0.0


def _counted(rows: DataFrame) -> Counter:
    """Documents by (measure, place, bad) of the growing part."""
    cells = rows.filter("grows").select("bad", F.posexplode("places")).groupBy("pos", "col", "bad").agg(F.count("*").alias("n")).collect()
    return Counter({(r["pos"], r["col"], r["bad"]): r["n"] for r in cells})


def _meeting(rows: DataFrame, counts: Counter, condition: Column, meets: int) -> Counter:
    """Counts of those of ``rows`` (counted by ``counts``) that meet a condition, as ``meets`` of the growing ones do.

    Only the smaller side is counted again; the other is the difference.
    """
    if 2 * meets <= sum(n for k, n in counts.items() if k[0] == 0):
        return _counted(rows.filter(condition))
    return counts - _counted(rows.filter(~condition))


def learn(stats: DataFrame, labels: DataFrame) -> DecisionList:
    """Sequential covering of the documents with quality 0.

    Two thirds of the labelled documents grow a rule, condition by condition of the highest information gain; the last
    third prunes it to the prefix with the best margin and decides whether it stands.  What a rule covers leaves both
    parts.  A rule grows for as long as a condition gains, and a rule that doesn't stand bars its first measure and direction
    until one stands; the search ends where none is left to begin with or nothing is left to cover.  Each rule that stands
    takes documents out of both parts, so the list stays finite.  A document with several labels counts with the
    lowest; null labels don't count; without labels the list is empty.
    """
    known = labels.filter("quality IS NOT NULL AND doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    named = measures()
    rows = stats.filter(~base_failed()).join(known, "doc_id").select(*stats.columns, (F.col("quality") == 0).cast("int").alias("bad"), (F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(3)) > 0).alias("grows"))
    rows = save(rows, "labelled")
    points = [(k + 0.5) / THRESHOLDS for k in range(THRESHOLDS)]
    quantiles = rows.groupBy("bad").agg(*[F.percentile_approx(c, points, 1000).alias(m) for m, c in named.items()]).collect()
    thresholds = {m: sorted({x for r in quantiles for x in (r[m] or [])}) for m in named}
    order = list(named)
    # The place of each measure among its thresholds, so that one grouping counts all conditions.
    places = F.array(*[_place(named[m], thresholds[m]) for m in order])
    rows = save(rows.withColumn("places", places), "labelled")
    rules: list[list[Condition]] = []
    barred: set[tuple[str, bool]] = set()
    # Documents that no rule covers are counted once; what a rule covers is taken off.
    uncovered = _counted(rows)
    while True:
        left = rows.filter(DecisionList(rules).fired() == 0)
        rule: list[Condition] = []
        cells, passed = uncovered, [uncovered]
        while True:
            p0, n0 = (sum(n for k, n in cells.items() if k[0] == 0 and k[2] == i) for i in (1, 0))
            if not p0 or not n0:
                break
            best: tuple[float, Condition] | None = None
            for f, m in enumerate(order):
                below = [0, 0]
                for j, t in enumerate(thresholds[m]):
                    b, g = cells[f, j, 1], cells[f, j, 0]
                    below = [below[0] + b, below[1] + g]
                    for above, (p, n) in ((True, (p0 - below[0], n0 - below[1])), (False, tuple(below))):
                        if not rule and (m, above) in barred:
                            continue
                        if p >= SUPPORT and (best is None or _gain(p0, n0, p, n) > best[0]):
                            best = (_gain(p0, n0, p, n), Condition(m, above, float(t)))
                            meets = p + n
            if best is None or best[0] <= 0.01 * p0:
                break
            cells = _meeting(left.filter(_all(rule)), cells, best[1].column(), meets)
            rule.append(best[1])
            passed.append(cells)
        if not rule:
            break
        prefixes = [_all(rule[:k]).cast("int") for k in range(1, len(rule) + 1)]
        counts = left.filter(~F.col("grows")).agg(*[F.sum(x * F.col("bad")) for x in prefixes], *[F.sum(x * (1 - F.col("bad"))) for x in prefixes]).first()
        k = len(rule)
        margins = [((counts[i] or 0) - (counts[k + i] or 0)) / max(1, (counts[i] or 0) + (counts[k + i] or 0)) for i in range(k)]
        i = max(range(k), key=lambda j: (margins[j], -j))
        p, n = counts[i] or 0, counts[k + i] or 0
        if p < SUPPORT // 2 or p < PRECISION * (p + n):
            barred.add((rule[0].measure, rule[0].above))  # the next rule begins elsewhere
            continue
        rules.append(rule[:i + 1])
        uncovered = uncovered - passed[i + 1]
        barred.clear()
    return DecisionList(rules)


def judged(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Statistics of every row with base_failed, rule (number of the first rule that rejects it) and kept."""
    stats = statistics(docs)
    out = stats.withColumn("base_failed", base_failed()).withColumn("rule", learn(stats, labels).fired())
    return out.withColumn("kept", ~F.col("base_failed") & (F.col("rule") == 0))
