"""Exact Jaccard join of texts on word n-grams.

Documents with equal n-gram sets form one class.  Classes are brought together by signatures that no pair at or above
the threshold can miss; each family of classes found that way is a block of rows of the incidence matrix (documents by
n-grams), which is multiplied with its transpose in tiles.  Overlap counts accumulate over tiles of n-grams, pairs
whose remaining n-grams can't lift them to the bound that follows from their sizes are discarded, and of the links of a
tile only a spanning forest leaves the task.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from functools import cache
from math import ceil, exp, factorial, sqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.graph import components
from filingscope.llm.store import fresh_name, narrow, row_text, save
from filingscope.llm.words import NOT_SPACE, mix, pieces, runs, words

#: Parts with at most so many n-grams say little; the most of these that is affordable is taken.
LITTLE = (2, 1, 0)
#: N-grams counted at once, occurrences among them from which one may be common, and the most common ones broadcast.
COUNTED, OFTEN, COMMON = 2_000_000, 3, 500_000
#: Signatures of a column block, with which the number of blocks follows the input, and signatures that a task holds.
BLOCK_SIGNATURES, HELD_SIGNATURES = 1_000_000, 400_000
#: Rows and n-grams of one block of a family; rows and n-grams of one side of a tile, and n-grams multiplied at once.
BLOCK_ROWS, BLOCK_GRAMS, TILE_ROWS, TILE_SIZE, TILE_GRAMS = 1024, 2_000_000, 256, 400_000, 4096


_NONE = np.empty(0, np.uint64)


class Sizes:
    """Size classes for a threshold: a pair at or above it lies in one class or in two neighbours."""

    def __init__(self, percent: int) -> None:
        self.percent = percent
        self.top = [0]
        self.differ = [0]

    def _grow(self, n: int) -> None:
        while self.top[-1] < n:
            top = max(self.top[-1] + 1, (self.top[-1] + 1) * 100 // self.percent)
            self.top.append(top)
            # The smaller set has top n-grams at most, the union at most 100 / percent as many.
            self.differ.append(int(Fraction(100 - self.percent, self.percent) * top))

    def schemes(self, n: int) -> list[tuple[int, int, int, int]]:
        """(class, parts, spare parts, little) under which a set of ``n`` is entered: as a member of its class, and as one larger.

        Where linked sets can't differ at all, different sets have no link and none is entered.
        """
        self._grow(n)
        c = int(np.searchsorted(self.top, n))
        return [(k, *_cut_for(self.differ[k], self.top[k - 1] + 1)) for k in (c, c - 1) if k > 0 and self.differ[k]]


@cache
def _cut_for(differ: int, n: int) -> tuple[int, int, int]:
    """(parts, spare, little): spare is what few sets of ``n`` have more parts of at most ``little`` n-grams than."""
    for little in LITTLE:
        spare = 1
        while spare <= 0.4 * (differ + 1) + 1:
            parts = differ + 1 + spare
            rate = n / parts
            share = exp(-rate) * sum(rate**k / factorial(k) for k in range(little + 1))
            need = ceil(parts * share + 2.5 * sqrt(parts * share * (1 - share)))
            if need <= spare:
                return parts, spare, little
            spare = need
    return differ + 2, 1, 0


def node(digest: int, scheme: int) -> int:
    """A class under a scheme: families are found scheme by scheme, so that sizes far apart never chain."""
    return int(mix(np.array([(digest + (scheme << 40)) & (2**64 - 1)], np.uint64)).view(np.int64)[0])


def signatures(grams: np.ndarray, sizes: Sizes, common: np.ndarray = _NONE) -> list[tuple[int, np.ndarray]]:
    """(scheme, signatures) of a sorted set.

    The hash range is cut into more parts than two linked sets can have differences, so that at least ``spare`` + 1
    parts hold the same n-grams in both.  Parts with few n-grams or with ``common`` ones alone, which passages shared
    by many texts can fill, say little.  A set with at most ``spare`` such parts doesn't enter them, as one of the equal
    parts is another; else one with at most ``spare`` parts with few n-grams doesn't enter those; else it enters all.
    What is left out depends on a part's content alone, so any set of common n-grams keeps this complete.
    """
    out = []
    rare = np.ones(len(grams), np.int64)
    if len(common):
        rare[common[np.minimum(np.searchsorted(common, grams), len(common) - 1)] == grams] = 0
    for scheme, parts, spare, little in sizes.schemes(len(grams)):
        part = ((grams >> np.uint64(32)) * np.uint64(parts)) >> np.uint64(32)
        first = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1]]))
        sums = np.add.reduceat(mix(grams ^ np.uint64(0xA5A5A5A5)), first)
        ids, held = part[first], np.diff(np.append(first, len(grams)))
        much = held > little
        telling = much & (np.add.reduceat(rare, first) > 0)
        kept = telling if parts - int(telling.sum()) <= spare else much if parts - int(much.sum()) <= spare else None
        if kept is None:
            empty = np.setdiff1d(np.arange(parts, dtype=np.uint64), ids)
            ids, sums = np.concatenate([ids, empty]), np.concatenate([sums, np.zeros(len(empty), np.uint64)])
        else:
            ids, sums = ids[kept], sums[kept]
        out.append((scheme, mix(sums + mix(ids + np.uint64(scheme << 32)))))
    return out


def gram_sets(texts: pa.Array, size: int) -> Iterator[tuple[int, np.ndarray]]:
    """(row, sorted distinct n-gram hashes) of each text; fewer words than ``size`` count as one n-gram."""
    for at, raw, offsets in pieces(texts):
        _, _, hashes, first = words(raw, offsets, NOT_SPACE)
        for i in range(len(offsets) - 1):
            own = hashes[first[i]:first[i + 1]]
            yield at + i, np.unique(runs(own, min(size, len(own)))) if len(own) else np.empty(0, np.uint64)
    pa.default_memory_pool().release_unused()


def _digest(grams: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set."""
    a = mix(grams + np.uint64(0x1234567)).sum(dtype=np.uint64)
    b = mix(grams ^ np.uint64(0xFEDCBA9876543210)).sum(dtype=np.uint64)
    return int(a.astype(np.int64)), int(b.astype(np.int64))


_FACTS = "doc_id long, n long, d1 long, d2 long, nodes array<long>"


def _describe(size: int, percent: int):
    def run(batches):
        sizes = Sizes(percent)
        for batch in batches:
            rows = [(len(g), *_digest(g)) for _, g in gram_sets(row_text(batch), size)]
            n, a, b = (pa.array([r[k] for r in rows], pa.int64()) for k in range(3))
            nodes = pa.array([[node(r[1], s) for s, *_ in sizes.schemes(r[0])] for r in rows], pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), n, a, b, nodes], ["doc_id", "n", "d1", "d2", "nodes"])

    return run


def _often(size: int):
    """(gram, n): n-grams that several of a few thousand texts in a row have, with the number of texts."""

    def run(batches):
        held: list[np.ndarray] = []

        def counted():
            if not held:
                return
            grams, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            keep = n >= OFTEN
            yield pa.RecordBatch.from_arrays([pa.array(grams[keep].view(np.int64)), pa.array(n[keep].astype(np.int64))], ["gram", "n"])

        total = 0
        for batch in batches:
            for _, grams in gram_sets(row_text(batch), size):
                held.append(grams)
                total += len(grams)
                if total > COUNTED:
                    yield from counted()
                    total = 0
        yield from counted()

    return run


def common_grams(docs: DataFrame, size: int) -> np.ndarray:
    """Sorted hashes of the n-grams that the largest shares of texts have, at most COMMON.

    A text has a bounded mean number of n-grams, so that few can have a given share of all texts, whatever their number.
    """
    counts = save(docs.mapInArrow(_often(size), "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")), "often")
    levels = counts.groupBy(F.floor(F.log2("n")).alias("level")).agg(F.count("*").alias("grams")).orderBy(F.desc("level")).collect()
    least, room = None, COMMON
    for level, grams in levels:
        if grams > room:
            break
        least, room = level, room - grams
    if least is None:
        return _NONE
    found = counts.filter(F.floor(F.log2("n")) >= least).select("gram").toPandas()["gram"].to_numpy(np.int64)
    return np.sort(found.view(np.uint64))


def _leaders(sig: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct signatures, the smallest class of each, and (class, smallest class) of the others."""
    order = np.argsort(sig, kind="stable")
    sig, own = sig[order], own[order]
    first = np.flatnonzero(np.concatenate([[True], sig[1:] != sig[:-1]]))
    least = np.minimum.reduceat(own, first)
    leader = np.repeat(least, np.diff(np.append(first, len(sig))))
    return sig[first], least, np.unique(np.stack([own, leader], 1)[own != leader], axis=0)


def _enter(size: int, percent: int, blocks: int, common: np.ndarray):
    """Packed (signature, class) arrays by column block; a class already entered by this task is not entered again.

    Of the classes a task holds with one signature, the smallest enters its block; the others come as edges to it, so
    that a signature of very many classes reaches its block only once per few hundred thousand signatures.
    """

    def run(batches):
        sizes, seen = Sizes(percent), set()
        for batch in batches:
            found: list[np.ndarray] = []
            owners: list[np.ndarray] = []

            def flush():
                if not found:
                    return
                sig, own, edges = _leaders(np.concatenate(found), np.concatenate(owners))
                found.clear()
                owners.clear()
                block = (sig % np.uint64(blocks)).astype(np.int64)
                order = np.argsort(block, kind="stable")
                sig, own, block = sig[order], own[order], block[order]
                cut = np.flatnonzero(np.concatenate([[True], block[1:] != block[:-1]]))
                ends = np.append(cut[1:], len(block))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(block[cut].astype(np.int32)), pa.array([sig[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()),
                     pa.array([own[i:j].tobytes() for i, j in zip(cut, ends)], pa.binary()),
                     pa.array([edges.tobytes(), *[b""] * (len(cut) - 1)], pa.binary())], ["block", "sigs", "owners", "edges"])

            held = 0
            for _, grams in gram_sets(row_text(batch), size):
                if not len(grams):
                    continue
                key = _digest(grams)
                if key in seen:
                    continue
                if len(seen) < 1_000_000:  # memory only: a class entered twice is the same class
                    seen.add(key)
                for scheme, s in signatures(grams, sizes, common):
                    found.append(s)
                    owners.append(np.full(len(s), node(key[0], scheme), np.int64))
                    held += len(s)
                if held > HELD_SIGNATURES:
                    yield from flush()
                    held = 0
            yield from flush()

    return run


def _stars(batches):
    """Each class beside the smallest class with the same signature, once per column block."""
    sig, own, edges = [], [], []
    for batch in batches:
        sig += [np.frombuffer(x, np.uint64) for x in batch.column("sigs").to_pylist()]
        own += [np.frombuffer(x, np.int64) for x in batch.column("owners").to_pylist()]
        edges += [np.frombuffer(x, np.int64).reshape(-1, 2) for x in batch.column("edges").to_pylist()]
    pairs = np.unique(np.concatenate([*edges, _leaders(np.concatenate(sig), np.concatenate(own))[2]]), axis=0)
    yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])


def _sets(size: int):
    def run(batches):
        for batch in batches:
            packed, n = [], []
            for _, g in gram_sets(row_text(batch), size):
                packed.append(g.tobytes())
                n.append(len(g))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("families"), pa.array(n, pa.int64()), pa.array(packed, pa.binary())],
                ["doc_id", "families", "n", "grams"])

    return run


class Forest:
    def __init__(self, n: int) -> None:
        self.up = list(range(n))

    def root(self, x: int) -> int:
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, x: int, y: int) -> bool:
        x, y = self.root(x), self.root(y)
        self.up[max(x, y)] = min(x, y)
        return x != y


def tile_links(left: list[np.ndarray], right: list[np.ndarray], percent: int) -> np.ndarray:
    """Index pairs of linked sets, by a product of the two incidence tiles accumulated over tiles of n-grams."""
    na, nb = np.array([len(x) for x in left]), np.array([len(x) for x in right])
    total = na[:, None] + nb[None, :]
    need = -(-percent * total // (100 + percent))  # 100 * o >= percent * (total - o)
    open_ = np.minimum(na[:, None], nb[None, :]) >= need
    if not open_.any():
        return np.empty((0, 2), np.int64)
    la, lb = np.concatenate(left), np.concatenate(right)
    ra, rb = np.repeat(np.arange(len(left)), na), np.repeat(np.arange(len(right)), nb)
    shared = np.intersect1d(np.unique(la), np.unique(lb), assume_unique=True)
    if not len(shared):
        return np.empty((0, 2), np.int64)
    ca, cb = np.searchsorted(shared, la), np.searchsorted(shared, lb)
    keep = shared[np.minimum(ca, len(shared) - 1)] == la
    ca, ra = ca[keep], ra[keep]
    keep = shared[np.minimum(cb, len(shared) - 1)] == lb
    cb, rb = cb[keep], rb[keep]
    rest = np.minimum(np.bincount(ra, minlength=len(left))[:, None], np.bincount(rb, minlength=len(right))[None, :])
    open_ &= rest >= need
    counts = np.zeros((len(left), len(right)), np.int64)
    for at in range(0, len(shared), TILE_GRAMS):
        if not open_.any():
            break
        width = min(TILE_GRAMS, len(shared) - at)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        k = (ca >= at) & (ca < at + width)
        a[ra[k], ca[k] - at] = 1
        k = (cb >= at) & (cb < at + width)
        b[rb[k], cb[k] - at] = 1
        counts += (a @ b.T).astype(np.int64)
        left_over = len(shared) - at - width
        open_ &= counts + left_over >= need
    return np.argwhere(open_ & (counts >= need))


def _tiles(rows: list[int], grams: list[np.ndarray]) -> list[list[int]]:
    """Rows in order, cut into tiles."""
    out: list[list[int]] = []
    room = 0
    for k in rows:
        if not out or len(out[-1]) == TILE_ROWS or room < len(grams[k]):
            out.append([])
            room = TILE_SIZE
        out[-1].append(k)
        room -= len(grams[k])
    return out


def _multiply(percent: int):
    """Links of one pair of row blocks of a family, thinned to a forest."""

    def run(batches):
        ids, grams, side, i, j = [], [], [], 0, 0
        for batch in batches:
            ids += batch.column("doc_id").to_pylist()
            grams += [np.frombuffer(x, np.uint64) for x in batch.column("grams").to_pylist()]
            side += batch.column("part").to_pylist()
            i, j = batch.column("i")[0].as_py(), batch.column("j")[0].as_py()
        order = sorted(range(len(ids)), key=lambda k: (len(grams[k]), ids[k]))  # near sizes meet in the same tiles
        rows, columns = [k for k in order if side[k] == i], [k for k in order if side[k] == j]
        forest, out = Forest(len(ids)), []
        rows, columns = _tiles(rows, grams), _tiles(columns, grams)
        for r, left in enumerate(rows):
            for right in columns[r if i == j else 0:]:
                lo, hi = len(grams[left[0]]), len(grams[left[-1]])
                if len(grams[right[0]]) * percent > hi * 100 or len(grams[right[-1]]) * 100 < lo * percent:
                    continue
                for x, y in tile_links([grams[k] for k in left], [grams[k] for k in right], percent).tolist():
                    if left[x] != right[y] and forest.join(left[x], right[y]):
                        out.append((ids[left[x]], ids[right[y]]))
        yield pa.RecordBatch.from_arrays([pa.array([p[k] for p in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def jaccard_groups(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): doc_id, n_shingles, component_id.

    Two texts link when their sets of word n-grams have a Jaccard index of at least ``percent`` / 100;
    component_id is the smallest doc_id reachable over links.  Null, empty and wordless texts have no n-grams and
    their own component.  Rows with a null doc_id are described but link with nothing (component_id null).
    Repeated rows and ids are kept as they are; rows that share an id share the id's smallest component.
    """
    docs = docs.select("doc_id", "text")
    facts = save(docs.mapInArrow(_describe(size, percent), _FACTS), "sets")
    known = facts.filter("n > 0 AND doc_id IS NOT NULL")
    classes = known.groupBy("d1", "d2", "n").agg(F.min("doc_id").alias("rep"), F.first("nodes").alias("nodes"))
    grams = facts.agg(F.sum("n")).first()[0] or 0
    blocks = max(docs.sparkSession.sparkContext.defaultParallelism, int(grams * 0.4) // BLOCK_SIGNATURES + 1)
    entered = docs.filter("doc_id IS NOT NULL").mapInArrow(_enter(size, percent, blocks, common_grams(docs, size)), "block int, sigs binary, owners binary, edges binary")
    stars = entered.groupBy("block").applyInArrow(_packed(_stars), "a long, b long")
    found = components(stars, "families")
    families = save(found.unionByName(found.select(F.col("root").alias("node"), "root").distinct()), "family")
    members = classes.select("rep", F.explode("nodes").alias("node")).join(families, "node")
    members = save(members.groupBy(F.col("rep").alias("doc_id")).agg(F.collect_set("root").alias("families")), "members")
    # A repeated id may carry several texts: each is a row of its own.
    sets = save(docs.join(narrow(members), "doc_id").mapInArrow(_sets(size), "doc_id long, families array<long>, n long, grams binary"), "grams")
    sets = sets.withColumn("family", F.explode("families")).drop("families")
    per_family = sets.groupBy("family").agg(F.count("*").alias("rows"), F.sum("n").alias("grams")).filter("rows > 1").withColumn(
        "parts", F.ceil(F.greatest(F.col("rows") / BLOCK_ROWS, F.col("grams") / BLOCK_GRAMS)).cast("int"))
    placed = sets.join(narrow(per_family.select("family", "parts")), "family").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")).cast("int"))
    pairs = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select(
        "family", F.least("part", "other").alias("i"), F.greatest("part", "other").alias("j"), "part", "doc_id", "grams")
    links = pairs.groupBy("family", "i", "j").applyInArrow(_packed(_multiply(percent)), "a long, b long")
    # Equal sets, links between classes, and rows of one id.
    class_of = known.join(classes, ["d1", "d2", "n"]).select(F.col("doc_id").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    roots = components(links.unionByName(class_of), "links")
    return facts.join(roots, facts.doc_id == roots.node, "left").select(
        "doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))


def _packed(batches_of):
    """A group function for applyInArrow out of a function of batches."""

    def run(group: pa.Table) -> pa.Table:
        return pa.Table.from_batches(list(batches_of(group.to_batches())))

    return run


def one_of_each(docs: DataFrame, size: int = 5, percent: int = 80) -> DataFrame:
    """Rows of ``docs`` (all columns), one of each group of linked texts: the one with the smallest doc_id.

    A null id comes last, and among rows of one id the first as written stays.  Rows are linked by a written key of their
    own, so that a row whose id another row shares goes only if its own text is linked.  Texts without words all stay.
    """
    row = fresh_name(docs, "__row")
    keyed = save(docs.withColumn(row, F.monotonically_increasing_id()), "rows")
    groups = save(jaccard_groups(keyed.select(F.col(row).alias("doc_id"), "text"), size, percent).select(
        F.col("doc_id").alias(row), F.col("component_id").alias("__group")), "groups")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", row)
    first = groups.join(keyed.select("doc_id", row), row).groupBy("__group").agg(F.min(order).alias("first"), F.count("*").alias("n"))
    first = save(first.filter("n > 1").select("__group", F.col("first")[row].alias("__first")), "first")
    gone = save(groups.join(narrow(first), "__group").filter(F.col(row) != F.col("__first")).select(row), "gone")
    return keyed.join(narrow(gone), row, "left_anti").select(docs.columns)
