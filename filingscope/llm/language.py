"""Languages of texts that may mix several: proportions by expectation-maximisation, the set by penalised likelihood.

A language is a distribution over hashed byte trigrams of lower-cased words, counted over all learned texts.  A text is a
mixture: each of its words comes from one language, with the product of its trigrams' probabilities as likelihood.
Expectation-maximisation finds the proportions.  Languages then enter in the order of their proportions for as long as
the log-likelihood gains more than the penalty of a further one.
"""

from __future__ import annotations

from collections.abc import Iterator
from math import log

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import row_text

#: Trigram buckets, added count of each, and languages whose counts a task holds before it passes them on.
BUCKETS, ADDED, HELD = 1 << 16, 0.5, 32
#: Steps of expectation-maximisation and the largest change of a share at which they end.
STEPS, SETTLED = 60, 1e-4
#: Factor of the penalty (half the logarithm of the words plus that of the languages) of a further language.
PENALTY = 3.0
#: Least ratio of a word's likelihoods under two languages.
LEAST = 1e-300
#: Values of word likelihoods held at once; longer texts are read block by block in each step.
HELD_VALUES = 1 << 22

UNDETERMINED = "und"

_LETTER = np.zeros(256, bool)
_LETTER[97:123] = True
_LETTER[128:] = True


def blocks(text: str, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(trigram buckets, first trigram of each word) of a lower-cased text, in blocks of about ``size`` bytes.

    Letters are a-z and all bytes beyond ASCII; each letter gives the trigram around it, with a blank beyond its word.
    A word longer than a block counts as several.
    """
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    at = 0
    while at < len(raw):
        end = min(len(raw), at + size)
        if end < len(raw):
            gaps = np.flatnonzero(~_LETTER[raw[at:end]])
            end = at + int(gaps[-1]) + 1 if len(gaps) else end
        letter = np.zeros(end - at + 2, bool)
        letter[1:-1] = _LETTER[raw[at:end]]
        b = np.zeros(end - at + 2, np.uint32)
        b[1:-1] = raw[at:end]
        b[~letter] = 32
        mid = np.flatnonzero(letter)
        code = (b[mid - 1] << np.uint32(16)) | (b[mid] << np.uint32(8)) | b[mid + 1]
        first = np.flatnonzero(~letter[mid - 1])
        if len(mid):
            yield (code * np.uint32(2654435761)) >> np.uint32(16), first
        at = end


def _count(batches):
    """(lang, bucket, n) of a task; not more than HELD languages are held."""
    held: dict[str, np.ndarray] = {}

    def counted():
        for lang, n in held.items():
            b = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(b), pa.string()), pa.array(b.astype(np.int32)), pa.array(n[b])], ["lang", "bucket", "n"])
        held.clear()

    for batch in batches:
        for text, lang in zip(row_text(batch).to_pylist(), batch.column("lang").to_pylist()):
            if lang not in held:
                if len(held) == HELD:
                    yield from counted()
                held[lang] = np.zeros(BUCKETS, np.int64)
            for codes, _ in blocks(text, HELD_VALUES):
                held[lang] += np.bincount(codes, minlength=BUCKETS)
    yield from counted()


def _logs(group: pa.Table) -> pa.Table:
    """Logarithms of a language's smoothed trigram shares; the group has a row for each bucket at most."""
    n = np.full(BUCKETS, ADDED)
    n[group.column("bucket").to_numpy()] += group.column("n").to_numpy()
    return pa.table({"lang": group.column("lang")[:1], "logs": pa.array([np.log(n / n.sum()).astype(np.float32).tobytes()], pa.binary())})


class Model:
    """Log-probabilities (buckets x languages) of the learned languages, in the order of their names."""

    def __init__(self, langs: list[str], logs: np.ndarray) -> None:
        self.langs, self.logs = langs, logs

    def words(self, text: str) -> Iterator[tuple[np.ndarray, float]]:
        """Likelihoods (words x languages) divided by the largest of each word, and the sum of these largest ones' logarithms, in blocks."""
        for codes, first in blocks(text, max(1024, HELD_VALUES // max(1, len(self.langs)))):
            logs = np.add.reduceat(self.logs[codes].astype(np.float64), first, axis=0)
            top = logs.max(1, keepdims=True)
            yield np.maximum(np.exp(logs - top), LEAST), float(top.sum())

    def _blocks(self, text: str):
        """The word blocks again and again: held if there is one, else read anew each time."""
        words = self.words(text)
        head = next(words, None)
        second = next(words, None)
        if second is None:
            return lambda: [] if head is None else [head]
        return lambda: self.words(text)

    def mixture(self, again, subset: list[int]) -> tuple[np.ndarray, float, int]:
        """(proportions, log-likelihood, words) of the languages ``subset`` after expectation-maximisation."""
        share, total, n = np.full(len(subset), 1 / len(subset)), 0.0, 0
        for _ in range(STEPS):
            held, total, n = np.zeros(len(subset)), 0.0, 0
            for likely, top in again():
                own = likely[:, subset]
                whole = own @ share
                held += share * (own.T @ (1 / whole))
                total += float(np.log(whole).sum()) + top
                n += len(own)
            if not n or len(subset) == 1:
                break
            new = np.maximum(held / n, 1e-12)
            new /= new.sum()
            done = np.abs(new - share).max() < SETTLED
            share = new
            if done:
                break
        return share, total, n

    def languages(self, text: str) -> list[tuple[str, float]]:
        """(language, proportion) of the chosen set, largest first; ties by name.  Nothing without a word."""
        if not self.langs:
            return []
        again = self._blocks(text)
        share, _, n = self.mixture(again, list(range(len(self.langs))))
        if not n:
            return []
        order = sorted(range(len(self.langs)), key=lambda k: (-share[k], self.langs[k]))
        penalty = PENALTY * (log(n) / 2 + log(len(self.langs)))
        chosen = order[:1]
        share, best, _ = self.mixture(again, chosen)
        for k in order[1:]:
            more, total, _ = self.mixture(again, [*chosen, k])
            if total - best <= penalty:
                break
            chosen, share, best = [*chosen, k], more, total
        return sorted(((self.langs[k], (float(s) * n + 1 / len(self.langs)) / (n + 1)) for k, s in zip(chosen, share)), key=lambda x: (-x[1], x[0]))


def fit(docs: DataFrame) -> Model:
    """Trigram counts of every language over all rows of ``docs`` (text, lang); rows without text or lang don't count.

    The driver gets one vector of BUCKETS numbers for each language.
    """
    known = docs.select("text", F.col("lang").cast("string").alias("lang")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = known.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    rows = sorted(counts.groupBy("lang").applyInArrow(_logs, "lang string, logs binary").collect())
    logs = np.stack([np.frombuffer(r.logs, np.float32) for r in rows], 1) if rows else np.zeros((BUCKETS, 0), np.float32)
    return Model([r.lang for r in rows], np.ascontiguousarray(logs))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score, languages of each row of ``docs`` (doc_id, text).

    lang_pred is the language with the largest proportion in the chosen set, score its proportion with one more word spread
    over all languages, languages all of the set.  Null texts, texts without a letter and all texts under a model without
    languages are ``und`` with score 0.  A text with letters none of which was learned ties; the first name stands.
    Whole texts of any length are read; rows are judged one by one, so repeated rows and ids agree; extra columns are ignored.
    """

    def run(batches):
        for batch in batches:
            texts = row_text(batch)
            lettered = pc.match_substring_regex(texts, r"\p{L}").to_pylist()
            found = [model.languages(t) if ok else [] for t, ok in zip(texts.to_pylist(), lettered)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([f[0][0] if f else UNDETERMINED for f in found]), pa.array([f[0][1] if f else 0.0 for f in found], pa.float64()),
                 pa.array([[{"lang": a, "share": s} for a, s in f] for f in found], pa.list_(pa.struct([("lang", pa.string()), ("share", pa.float64())])))],
                ["doc_id", "lang_pred", "score", "languages"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, lang_pred string, score double, languages array<struct<lang:string,share:double>>")


def fold(name: str = "doc_id"):
    """Whether a row is held out: crc32 of the id as text leaves 1 modulo 3; null for a null id, which isn't learned from either."""
    return F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(3)) == 1


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, languages; learned from the rows of ``docs`` that aren't held out."""
    return identify(docs, fit(docs.filter(~fold()))).select(
        "doc_id", F.coalesce(fold(), F.lit(False)).alias("held_out"), "lang_pred", "score", "languages")
