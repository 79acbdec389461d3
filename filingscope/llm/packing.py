"""Packing of documents into training sequences by a configuration linear program over the length histogram.

Tokenizing, ranking and placing are distributed; the driver sees only the histogram, which has a row for each length up
to the sequence length, whatever the corpus.
"""

from __future__ import annotations

import os
import re
import zlib
from array import array
from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from filingscope.llm.store import narrow, row_text, save

CAPACITY, TOKENIZER = 2048, "word_bpe_49k.json"
#: Lengths are rounded up to this grid in the linear program only; coverage at which the weights of a pass stop, and their step.
GRID, COVER, STEP = 4, 4.0, 0.5
#: The program ends when its value is within this share of its lower bound, after so many passes over what is left at most.
GAP, PASSES = 0.01, 6
#: Pieces under this share of a sequence are left to fill room; how far lengths that are exchanged to fill a sequence lie apart.
SMALL, REACH = 0.1, 128
#: Shares of the program that are tried until one needs no more sequences than the tokens do.
SHARES = (1.0, 0.9, 0.75)
#: Coverage of a pass that counts: the volume-weighted quantile of its classes.
QUANTILE = 0.8
#: Words kept with their ids by a Python worker, rows of a ranking group.
CACHED_WORDS, RANK_ROWS = 200_000, 5_000

#: Characters whose lower case, composition and class don't depend on their neighbours; other texts are encoded whole.
_PLAIN = re.compile(r"[^\t\n\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-įı-ňŊ-ſ]|<\|")


def _byte_letters() -> dict[int, int]:
    """The printable stand-ins that byte-level vocabularies have for bytes."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {**{b: b for b in own}, **{b: 256 + k for k, b in enumerate(rest)}}


_LETTERS = _byte_letters()


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class WordIds(dict):
    """Token ids of white-space chunks as packed unsigned 32-bit integers, found when first asked for.

    The tokenizer drops white space and never merges across it, so a text's ids are those of its chunks in order.
    Letters alone are one word, and a final full stop or comma after them is another; these go to the merges directly.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tokenizer = Tokenizer.from_file(path)
        self.merges = self.tokenizer.model

    def __missing__(self, chunk: str) -> bytes:
        if chunk.isalpha():
            word = chunk if chunk.isascii() else chunk.encode().decode("latin-1").translate(_LETTERS)
            out = array("I", [t.id for t in self.merges.tokenize(word)]).tobytes()
        elif chunk[-1] in ".," and chunk[:-1].isalpha():
            out = self[chunk[:-1]] + self[chunk[-1]]
        else:
            out = array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()
        self[chunk] = out
        return out

    def ids(self, text: str) -> bytes:
        if _PLAIN.search(text):
            return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()
        if len(self) > CACHED_WORDS:
            self.clear()
        return b"".join(map(self.__getitem__, text.lower().split()))


#: One for each Python worker, which serves many tasks.
_workers: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    if path not in _workers:
        _workers[path] = WordIds(path)
    return _workers[path]


_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def _cut(path: str, capacity: int):
    def run(batches):
        words = word_ids(path)
        for batch in batches:
            out: list[tuple] = []
            for doc, text in zip(batch.column("doc_id").to_pylist(), row_text(batch)):
                data = words.ids(text.as_py()) + b"\0\0\0\0"
                for k, at in enumerate(range(0, len(data), 4 * capacity)):
                    own = data[at:at + 4 * capacity]
                    out.append((doc, k, at // 4, len(own) // 4, zlib.crc32(own)))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], t) for k, t in enumerate(kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every row's tokens and closing id 0; only longer rows are cut."""
    return docs.select("doc_id", "text").mapInArrow(_cut(path, capacity), _PIECES)


def _price(value: np.ndarray, size: np.ndarray, room: int) -> dict[int, int]:
    """The most valuable multiset of classes that fits, by dynamic programming over the room."""
    best, taken = np.zeros(room + 1), np.full(room + 1, -1)
    for c in range(1, room + 1):
        fits = np.searchsorted(size, c, "right")
        best[c] = best[c - 1]
        if fits:
            gain = best[c - size[:fits]] + value[:fits]
            k = int(gain.argmax())
            if gain[k] > best[c]:
                best[c], taken[c] = gain[k], k
    out: Counter = Counter()
    c = room
    while c > 0:
        if taken[c] < 0:
            c -= 1
        else:
            out[int(taken[c])] += 1
            c -= int(size[taken[c]])
    return dict(out)


Config = tuple[tuple[int, int], ...]


def _weighted(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[dict[Config, float], np.ndarray, float]:
    """One pass of multiplicative weights: configurations with their counts, coverage of each class, a lower bound.

    Each class has a price that falls exponentially with its coverage; the configuration worth most at these prices
    enters as often as its scarcest class allows.  Prices over the worth of that configuration are a dual solution.
    """
    covered, used, bound = np.zeros(len(size)), Counter(), 0.0
    while covered.min() < COVER:
        # Prices by size are the dual solution when nothing is wasted.
        prices = size * np.exp(-STEP * (covered - covered.min()))
        config = _price(prices, size, room)
        keys, counts = np.array(list(config)), np.array(list(config.values()))
        bound = max(bound, float(prices @ demand / (prices[keys] @ counts)))
        times = float((demand[keys] / counts).min())
        covered[keys] += counts * times / demand[keys]
        used[tuple(sorted(config.items()))] += times
    return used, covered, bound


def configurations(size: np.ndarray, demand: np.ndarray, room: int) -> tuple[list[tuple[dict[int, int], float]], float]:
    """Approximate solution of min sum x_p, sum_p a_lp x_p >= demand_l: [(multiset of classes, x)] and a lower bound.

    A pass covers some classes more often than others.  It counts at a high quantile of its coverage, and the next pass
    covers what is left, until all passes together and the whole of the last are within GAP of the bound.
    """
    found, total, left, bound = Counter(), 0.0, demand.astype(float), 0.0
    for turn in range(PASSES):
        open_ = np.flatnonzero(left > 1e-6 * demand)
        if not len(open_):
            break
        used, covered, own = _weighted(size[open_], left[open_], room)
        bound = bound or own
        value = sum(used.values())
        last = turn == PASSES - 1 or total + value / covered.min() <= (1 + GAP) * bound
        order = np.argsort(covered)
        volume = np.cumsum((left[open_] * size[open_])[order])
        scale = covered.min() if last else covered[order[np.searchsorted(volume, QUANTILE * volume[-1])]]
        for config, x in used.items():
            found[tuple((int(open_[k]), n) for k, n in config)] += x / scale
        total += value / scale
        left[open_] = np.maximum(0, left[open_] * (1 - covered / scale))
        if last:
            break
    return sorted(((dict(k), x) for k, x in found.items()), key=lambda p: -p[1]), bound


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[list[int], int]]:
    """Groups (lengths of a sequence, number of such sequences) that hold every piece once."""
    return planned(histogram, capacity)[0]


def planned(histogram: dict[int, int], capacity: int = CAPACITY) -> tuple[list[tuple[list[int], int]], float]:
    """``plan`` and the share of its sequences, those of one full piece aside, that the program made.

    The program's configurations fill first, rounded up while pieces last; knapsacks fill their room and new sequences
    with what is left, the small pieces among it.  If that takes more sequences than the tokens need, smaller shares of the
    program are tried.  Should best-fit alone ever need fewer, its result stands.
    """
    classes: dict[int, list[int]] = {}
    for length in sorted((k for k, n in histogram.items() if n and SMALL * capacity <= k < capacity), reverse=True):
        classes.setdefault(-(-length // GRID), []).append(length)
    size = np.array(sorted(classes))
    demand = np.array([sum(histogram[x] for x in classes[s]) for s in size], float)
    solved = [({int(size[k]): n for k, n in c.items()}, x) for c, x in configurations(size, demand, capacity // GRID)[0]] if classes else []
    left = np.zeros(capacity + 1, np.int64)
    for length, n in histogram.items():
        left[length] = n
    done = [([capacity], int(left[capacity]))] if left[capacity] else []
    left[capacity] = 0
    least = -(-int(left @ np.arange(capacity + 1)) // capacity)
    tries = []
    for share in SHARES:
        made = _rounded(left, classes, [(c, share * x) for c, x in solved], capacity)
        tries.append((_filled(left, made, capacity), sum(n for _, n in made)))
        if sum(n for _, n in tries[-1][0]) == least:
            break
    tries.append((best_fit(left, capacity), 0))
    groups, kept = min(tries, key=lambda t: (sum(n for _, n in t[0]), -t[1]))
    return done + groups, kept / max(1, sum(n for _, n in groups))


def _rounded(left: np.ndarray, classes: dict[int, list[int]], solved: list[tuple[dict[int, int], float]], capacity: int) -> list[tuple[list[int], int]]:
    """Sequences of the configurations, largest counts first, each rounded up while its pieces last.

    The grid leaves room: lengths give way to longer ones that fit, or two of them to two others that fill the sequence.
    """
    left, out = left.copy(), []
    for config, x in solved:
        times = int(np.ceil(x))
        while times > 0:
            chosen: Counter = Counter()
            for k, n in config.items():
                for _ in range(n):
                    found = next((y for y in classes[k] if left[y] > chosen[y]), None)
                    if found is None:
                        break
                    chosen[found] += 1
            if sum(chosen.values()) < sum(config.values()):
                break
            room = capacity - sum(y * n for y, n in chosen.items())
            for y in sorted(chosen.elements()):
                longer = next((z for z in range(y + room, y, -1) if left[z] > chosen[z]), None) if room else None
                if longer is not None:
                    chosen[y] -= 1
                    chosen[longer] += 1
                    room -= longer - y
            if room and (swap := _exchange(chosen, left, room)):
                (y1, y2), (z1, z2) = swap
                chosen.subtract((y1, y2))
                chosen.update((z1, z2))
            own = min([times, *(int(left[y]) // n for y, n in chosen.items() if n)])
            for y, n in chosen.items():
                left[y] -= own * n
            out.append((sorted(chosen.elements(), reverse=True), own))
            times -= own
    return out


def _exchange(chosen: Counter, left: np.ndarray, room: int) -> tuple[tuple[int, int], tuple[int, int]] | None:
    """Two lengths of a sequence and two that are left and take up their places and ``room`` exactly."""
    own = sorted(chosen.elements())
    for i, y1 in enumerate(own):
        for y2 in own[i + 1:]:
            whole = y1 + y2 + room
            z1 = np.arange(max(1, y1 - REACH), min(y1 + REACH, whole - 1) + 1)
            z2 = whole - z1
            fits = np.flatnonzero((left[z1] > 2) & (z2 < len(left)) & (left[np.minimum(z2, len(left) - 1)] > 2))
            for k in fits[np.argsort(np.abs(z1[fits] - y1))].tolist():
                a, b = int(z1[k]), int(z2[k])
                if left[a] > chosen[a] + (a == b) and left[b] > chosen[b] + (a == b):
                    return (y1, y2), (a, b)
    return None


def _fitting(items: Iterable[tuple[int, int]], room: int) -> Counter:
    """Copies of lengths with the largest sum that fits; of equal sums one with the longest pieces.  ``items``: (length, copies), longest first.

    A knapsack with the length as price: bit c of a row is set if some of the items so far make up c.
    """
    rows, seen, full = [1], [], (1 << room + 1) - 1
    for y, copies in items:
        rows.append((rows[-1] | rows[-1] << y * copies) & full)
        seen.append((y, copies))
        if rows[-1] >> room:
            break
    c, out = rows[-1].bit_length() - 1, Counter()
    for k in range(len(seen) - 1, -1, -1):
        if not rows[k] >> c & 1:
            y, copies = seen[k]
            out[y] += copies
            c -= y * copies
    return out


class _Remainder:
    """Pieces that are left, by length, put into sequences until none is."""

    def __init__(self, left: np.ndarray, capacity: int) -> None:
        self.left, self.capacity = left, capacity
        self.order = np.flatnonzero(left)[::-1].tolist()
        self.groups: list[tuple[list[int], int]] = []

    def _items(self, room: int, held: Counter):
        """(length, copies) that fit; copies in powers of two, so that few items make up any number."""
        for k in range(bisect_left(self.order, -room, key=lambda y: -y), len(self.order)):
            y = self.order[k]
            free, step = min(int(self.left[y]) - held[y], room // y), 1
            while free > 0:
                yield y, min(step, free)
                free, step = free - step, 2 * step

    def fill(self, fixed: list[int], own: list[int], times: int) -> int:
        """Up to ``times`` sequences of ``fixed`` (taken already), ``own`` and what fits best; their number."""
        held = Counter(own)
        room = self.capacity - sum(fixed) - sum(own)
        held.update(_fitting(self._items(room, held), room))
        alike = min([times, *(int(self.left[y]) // n for y, n in held.items())])
        for y, n in held.items():
            self.left[y] -= alike * n
        self.groups.append((sorted([*fixed, *held.elements()], reverse=True), alike))
        return alike

    def compact(self) -> None:
        self.order = [y for y in self.order if self.left[y]]


def _filled(left: np.ndarray, kept: list[tuple[list[int], int]], capacity: int) -> list[tuple[list[int], int]]:
    """The sequences ``kept``, their room and new sequences filled with all other pieces, longest first, by knapsacks."""
    left = left.copy()
    for lengths, times in kept:
        np.subtract.at(left, lengths, times)
    rest = _Remainder(left, capacity)
    for lengths, times in sorted(kept, key=lambda g: sum(g[0])):
        while times:
            times -= rest.fill(lengths, [], times)
    while rest.order:
        first = rest.order[0]
        while left[first]:
            rest.fill([], [first], int(left[first]))
        rest.compact()
    return rest.groups


def best_fit(left: np.ndarray, capacity: int) -> list[tuple[list[int], int]]:
    """All pieces best-fit, longest first."""
    open_: dict[int, list[tuple[list[int], int]]] = {}
    rooms: list[int] = []

    def put(lengths: list[int], times: int) -> None:
        room = capacity - sum(lengths)
        if room not in open_:
            open_[room] = []
            insort(rooms, room)
        open_[room].append((lengths, times))

    for length in np.flatnonzero(left)[::-1].tolist():
        n = int(left[length])
        while n:
            at = bisect_left(rooms, length)
            if at < len(rooms):
                room = rooms[at]
                lengths, bins = open_[room].pop()
                if not open_[room]:
                    del open_[room]
                    rooms.pop(at)
            else:
                room, lengths, bins = capacity, [], -(-n // (capacity // length))
            each = room // length
            full = min(bins, n // each)
            if full:
                put(lengths + [length] * each, full)
                n -= full * each
                bins -= full
            if bins and n:
                put(lengths + [length] * n, 1)
                n, bins = 0, bins - 1
            if bins and lengths:
                put(lengths, bins)
    return [g for groups in open_.values() for g in groups]


class Places:
    """For each length, its places in order: runs of sequences with the same lengths."""

    def __init__(self, groups: list[tuple[list[int], int]]) -> None:
        runs: dict[int, list[tuple[int, int, int]]] = {}
        sequence = 0
        for lengths, times in groups:
            at = 0
            for length in lengths:
                runs.setdefault(length, []).append((sequence, at, times))
                at += length
            sequence += times
        rows = [(length, *r) for length in sorted(runs) for r in runs[length]]
        table = np.array(rows, np.int64).reshape(-1, 4)
        self.sequence, self.offset = table[:, 1], table[:, 2]
        self.first = np.cumsum(table[:, 3]) - table[:, 3]
        self.sequences = sequence
        lengths, at = np.unique(table[:, 0], return_index=True)
        self.base = {int(x): int(self.first[i]) for x, i in zip(lengths, at)}


def _placed(places: Places):
    def run(batches):
        base = np.zeros(max(places.base, default=0) + 1, np.int64)
        for length, at in places.base.items():
            base[length] = at
        for batch in batches:
            place = base[batch.column("length").to_numpy()] + batch.column("rank").to_numpy()
            k = np.searchsorted(places.first, place, "right") - 1
            yield pa.RecordBatch.from_arrays(
                [*(batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(places.sequence[k] + place - places.first[k]), pa.array(places.offset[k])],
                ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return run


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Places of all rows of ``docs`` (doc_id, text) in sequences of at most ``capacity`` tokens.

    One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.  Null and empty texts are the closing
    id alone.  Rows may repeat or share ids; each is packed.  An empty table gives no rows.
    """
    cut = save(pieces(docs, path or tokenizer_path(), capacity), "pieces")
    histogram = {r[0]: r[1] for r in cut.groupBy("length").count().collect()}
    places = Places(plan(histogram, capacity))
    groups = sum(histogram.values()) // RANK_ROWS + 1
    cut = cut.withColumn("group", F.pmod(F.xxhash64("doc_id", "piece"), F.lit(groups)).cast("int"))
    # Ranks of a length by parts: ranks in a part, and how many come in the parts before it.
    before = cut.groupBy("length", "group").count().withColumn(
        "before", F.sum("count").over(Window.partitionBy("length").orderBy("group")) - F.col("count")).drop("count")
    own = F.row_number().over(Window.partitionBy("length", "group").orderBy("doc_id", "piece", "start", "ids_crc32"))
    ranked = cut.withColumn("own", own).join(narrow(before), ["length", "group"]).withColumn("rank", F.col("own") - 1 + F.col("before"))
    return ranked.mapInArrow(_placed(places), f"{_PIECES}, sequence_id long, offset long")
