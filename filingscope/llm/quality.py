"""Quality by a vote of the nearest labelled documents in a latent-semantic space.

Terms are pairs of neighbouring character classes plus repeated words and word windows of the whole text; a truncated
singular value decomposition of the labelled documents' term matrix gives the space.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import row_text
from filingscope.llm.words import NOT_SPACE, pieces, runs, words

#: Labelled documents that the vote knows (the bound of what is broadcast), latent dimensions, neighbours.
LABELLED, DIMENSIONS, NEIGHBOURS = 2500, 40, 15
#: Documents whose products are computed at once; score from which a document is accepted.
BLOCK, ACCEPT = 256, 0.7
#: Units of terms, axes and vectors.  Products stay under 2^53 in double precision, those of vectors under 2^24 in single.
TERM_UNIT, AXIS_UNIT, VECTOR_UNIT = 1 << 12, 1 << 20, 4000

_CLASSES = 64
_SINGLE = b" \n.,!?#*$%&|<>-_'\"()/:;@+=~\\[]{}"


def _class_table() -> np.ndarray:
    """a-z one by one, A-Z together, digits together, common marks one by one, other ASCII, lead and following bytes."""
    out = np.full(256, 61, np.int64)
    out[97:123] = np.arange(26)
    out[65:91], out[48:58] = 26, 27
    for k, b in enumerate(_SINGLE):
        out[b] = 28 + k
    out[128:192], out[192:] = 63, 62
    return out


_TABLE = _class_table()
#: Weights of the terms that count repeats: words equal to the one before, repeated words, repeated windows of five.
_REPEATS = np.array([1.0, 0.5, 1.0], np.float32)
TERMS = _CLASSES * _CLASSES + len(_REPEATS)


def term_rows(texts: pa.Array) -> np.ndarray:
    """Square roots of term shares, a row for each text; an empty text has no terms."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for at, raw, offsets in pieces(texts):
        codes = _TABLE[raw]
        _, _, hashes, first = words(raw, offsets, NOT_SPACE)
        for k in range(len(offsets) - 1):
            own = codes[offsets[k]:offsets[k + 1]]
            if len(own) > 1:
                out[at + k, :-3] = np.sqrt(np.bincount(own[:-1] * _CLASSES + own[1:], minlength=_CLASSES * _CLASSES) / (len(own) - 1))
            h = hashes[first[k]:first[k + 1]]
            if len(h) > 1:
                five = runs(h, 5)
                repeated = [(h[1:] == h[:-1]).mean(), 1 - len(np.unique(h)) / len(h), 1 - len(np.unique(five)) / len(five) if len(five) else 0.0]
                out[at + k, -3:] = np.sqrt(repeated) * _REPEATS
    return out


def _terms(batches):
    for batch in batches:
        rows = term_rows(row_text(batch)).astype(np.float16)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), batch.column("quality"), pa.array([r.tobytes() for r in rows], pa.binary())], ["doc_id", "quality", "terms"])


def _whole(x: np.ndarray, unit: int) -> np.ndarray:
    return np.rint(np.asarray(x, np.float64) * unit)


class Space:
    """Centre and axes of the latent space with the labelled documents in it.

    Terms, axes and vectors are rounded to whole numbers of small units, so that every product and sum is exact: a score
    depends neither on the batch a document comes in nor on the order of additions.
    """

    def __init__(self, terms: np.ndarray, labels: np.ndarray, dimensions: int = DIMENSIONS) -> None:
        self.labels = labels.astype(np.float64)
        centre = terms.mean(0) if len(terms) else np.zeros(TERMS, np.float32)
        x = terms - centre
        k = min(dimensions + 8, *x.shape)
        basis = x.T @ np.random.default_rng(0).standard_normal((len(x), k)).astype(np.float32)
        for _ in range(4):  # subspace iteration
            basis, _ = np.linalg.qr(basis)
            basis = x.T @ (x @ basis)
        basis, _ = np.linalg.qr(basis)
        _, _, v = np.linalg.svd(x @ basis, full_matrices=False) if len(x) else (0, 0, np.zeros((0, 0), np.float32))
        self.axes = _whole((basis @ v.T)[:, :dimensions], AXIS_UNIT)
        self.centre = _whole(centre, TERM_UNIT) @ self.axes
        del x  # the driver holds one copy of the terms at a time beside the rows
        self.vectors = np.concatenate([self.unit(terms[i:i + BLOCK]) for i in range(0, max(1, len(terms)), BLOCK)])

    def unit(self, terms: np.ndarray) -> np.ndarray:
        """Vectors of length ``VECTOR_UNIT``, but for rounding; none of them is longer than 4000 and half the root of the dimensions."""
        v = _whole(terms, TERM_UNIT) @ self.axes - self.centre
        return _whole(v / np.maximum(np.sqrt((v * v).sum(1, keepdims=True)), 1.0), VECTOR_UNIT).astype(np.float32)

    def scores(self, terms: np.ndarray) -> np.ndarray:
        """Similarity-weighted label shares among the nearest, from exact products of blocks.

        Of equally similar documents the first ones (smaller doc_id) are the neighbours.
        """
        out, n = np.empty(len(terms)), len(self.labels)
        k = min(NEIGHBOURS, n)
        for at in range(0, len(terms), BLOCK):
            near = (self.unit(terms[at:at + BLOCK]) @ self.vectors.T).astype(np.int64)
            order = np.argpartition(np.arange(n) - near * n, k - 1, axis=1)[:, :k]  # all different
            best = np.sort(order, axis=1)
            weight = np.maximum(np.take_along_axis(near, best, 1) / VECTOR_UNIT**2, 0) ** 4 + 1e-6
            out[at:at + BLOCK] = (weight * self.labels[best]).sum(1) / weight.sum(1)
        return np.clip(out, 0, 1)


def _held_out(name: str = "doc_id"):
    return (F.pmod(F.crc32(F.col(name).cast("string").cast("binary")), F.lit(4)) == 2)


def fit(docs: DataFrame, labels: DataFrame, most: int = LABELLED) -> Space | None:
    """The space of at most ``most`` labelled documents outside the held-out fold, taken by a hash of their ids.

    A document with several labels counts with the lowest; null labels don't count.  None if nothing is labelled.
    """
    known = labels.filter(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & ~_held_out()).groupBy("doc_id").agg(F.min("quality").alias("quality"))
    chosen = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").mapInArrow(_terms, "doc_id long, quality int, terms binary")
    rows = rows.orderBy("doc_id").limit(most).toArrow()
    if not rows.num_rows:
        return None
    terms = np.empty((rows.num_rows, TERMS), np.float32)
    for i, own in enumerate(rows.column("terms")):
        terms[i] = np.frombuffer(own.as_buffer(), np.float16)
    return Space(terms, rows.column("quality").to_numpy())


def _scores_of(space: Space | None, batch) -> np.ndarray:
    texts = row_text(batch)
    if space is None:
        return np.ones(len(texts))
    return np.concatenate([np.empty(0), *(space.scores(term_rows(texts[i:i + BLOCK])) for i in range(0, len(texts), BLOCK))])


def scored(docs: DataFrame, space: Space | None) -> DataFrame:
    """doc_id, score of each row of ``docs``; without labelled documents every score is 1."""

    def run(batches):
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(_scores_of(space, batch))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, score double")


def accepted(docs: DataFrame, labelled: DataFrame, labels: DataFrame, least: float = ACCEPT) -> DataFrame:
    """Rows of ``docs`` (all columns) with a score of at least ``least`` under the labels of ``labelled``."""
    space = fit(labelled, labels)

    def run(batches):
        for batch in batches:
            yield batch.filter(pa.array(_scores_of(space, batch) >= least))

    return docs.mapInArrow(run, docs.schema)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score, predicted of every row.

    Null and empty texts are scored as texts without terms, equal texts alike whatever their id, very long ones as a whole.
    """
    return scored(docs, fit(docs, labels)).select(
        "doc_id", F.coalesce(_held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))
