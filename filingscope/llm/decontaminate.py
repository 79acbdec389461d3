"""Benchmark decontamination: hashed windows of benchmark words, looked up in every document."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import row_text, save
from filingscope.llm.words import LETTERS, LOWER, pieces, runs, words

#: Words of a window, and the most benchmark characters and bytes of held windows that are broadcast; more go through a join.
WINDOW, BROADCAST_CHARS, BROADCAST_BYTES = 10, 50_000_000, 300_000_000
#: Bytes of Python objects behind a held window (900 with its text, measured on 200,000 windows), and of an item's row.
WINDOW_BYTES, ITEM_BYTES = 850, 200
#: Column with the written key of a document row.
ROW = "__decontamination_row"


class Windows:
    """Sorted hashes of the benchmark windows by length, with the words and items behind each hash."""

    def __init__(self, items: list[tuple[int, str | None]], size: int) -> None:
        rows = [(i, t or "") for i, t in items]
        self.behind: dict[int, dict[int, list[tuple[bytes, list[int]]]]] = {}
        for at, raw, offsets in pieces(pa.array([t for _, t in rows], pa.string())):
            starts, ends, hashes, first = words(raw, offsets, LETTERS)
            low = LOWER[raw]
            for k in range(len(offsets) - 1):
                a, b = first[k], first[k + 1]
                m = min(size, b - a)
                for j, h in enumerate(runs(hashes[a:b], m).tolist() if m else ()):
                    text = _joined(low, starts, ends, a + j, m)
                    found = self.behind.setdefault(int(m), {}).setdefault(h, [])
                    for known, owners in found:
                        if known == text:
                            owners.append(rows[at + k][0])
                            break
                    else:
                        found.append((text, [rows[at + k][0]]))
        self.sorted = {m: np.array(sorted(x), np.uint64) for m, x in self.behind.items()}


def _joined(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, at: int, m: int) -> bytes:
    return b" ".join(low[s:e].tobytes() for s, e in zip(starts[at:at + m], ends[at:at + m]))


def _scan(windows: Windows, texts: pa.Array):
    """(row, words, hit mask, items, byte spans of the words) of each text."""
    for at, raw, offsets in pieces(texts):
        starts, ends, hashes, first = words(raw, offsets, LETTERS)
        hit = np.zeros(len(starts), bool)
        items: dict[int, set[int]] = {}
        low = LOWER[raw]
        for m, known in windows.sorted.items():
            own = runs(hashes, m)
            if not len(own):
                continue
            place = np.minimum(np.searchsorted(known, own), len(known) - 1)
            at_word = np.flatnonzero(known[place] == own)
            row = np.searchsorted(first, at_word, "right") - 1
            for i, r in zip(at_word.tolist(), row.tolist()):
                if i + m > first[r + 1]:  # runs into the next text
                    continue
                text = _joined(low, starts, ends, i, m)
                for same, owners in windows.behind[m][int(own[i])]:
                    if same == text:
                        hit[i:i + m] = True
                        items.setdefault(r, set()).update(owners)
        for k in range(len(offsets) - 1):
            a, b = first[k], first[k + 1]
            yield at + k, int(b - a), hit[a:b], sorted(items.get(k, ()), key=lambda x: (x is None, x)), (starts[a:b] - offsets[k], ends[a:b] - offsets[k])


def _report(windows: Windows):
    def run(batches):
        for batch in batches:
            found = [(n, int(hit.sum()), items) for _, n, hit, items, _ in _scan(windows, row_text(batch))]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in found], pa.int64()), pa.array([r[1] for r in found], pa.int64()),
                 pa.array([r[2] for r in found], pa.list_(pa.int64()))], ["doc_id", "n_words", "n_hit", "items"])

    return run


def _without_documents(windows: Windows):
    def run(batches):
        for batch in batches:
            clean = [not hit.any() for _, _, hit, _, _ in _scan(windows, row_text(batch))]
            yield batch.filter(pa.array(clean, pa.bool_()))

    return run


def _cut(text: str, hit: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> str:
    """``text`` without its runs of hit words."""
    raw, kept, at = text.encode(), [], 0
    edges = np.flatnonzero(np.diff(np.concatenate([[0], hit.view(np.int8), [0]])))
    for a, b in zip(edges[::2], edges[1::2]):
        kept.append(raw[at:starts[a]])
        at = ends[b - 1]
    return b"".join([*kept, raw[at:]]).decode()


def _with_texts(batch: pa.RecordBatch, texts: list[str | None]) -> pa.RecordBatch:
    place = batch.schema.get_field_index("text")
    return batch.set_column(place, "text", pa.array(texts, batch.schema.field(place).type))


def _without_spans(windows: Windows):
    def run(batches):
        for batch in batches:
            texts, out = batch.column("text"), []
            for r, _, hit, _, (starts, ends) in _scan(windows, row_text(batch)):
                text = texts[r].as_py()
                out.append(_cut(text, hit, starts, ends) if hit.any() else text)
            yield _with_texts(batch, out)

    return run


def _held(size: int):
    """(chars, bytes) of each batch of items: an upper bound of what their windows take in a worker."""

    def run(batches):
        for batch in batches:
            chars = held = 0
            for _, raw, offsets in pieces(row_text(batch)):
                starts, ends, _, first = words(raw, offsets, LETTERS)
                upto = np.concatenate([[0], np.cumsum(ends - starts + 1)])
                chars, held = chars + len(raw), held + len(raw) + ITEM_BYTES * (len(offsets) - 1)
                for a, b in zip(first[:-1], first[1:]):
                    if m := min(size, b - a):
                        held += WINDOW_BYTES * int(b - a - m + 1) + int((upto[a + m:b + 1] - upto[a:b - m + 1]).sum())
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.int64()) for x in (chars, held)], ["chars", "held"])

    return run


def _load(bench: DataFrame, size: int) -> Windows | None:
    """The benchmark's windows, or None if they are too many for a broadcast."""
    bench = bench.select("item_id", "text")
    chars, held = bench.mapInArrow(_held(size), "chars long, held long").agg(F.sum("chars"), F.sum("held")).first()
    if (chars or 0) > BROADCAST_CHARS or (held or 0) > BROADCAST_BYTES:
        return None
    return Windows([tuple(r) for r in bench.collect()], size)


def contamination(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, items (sorted item ids) for every row of ``docs`` (doc_id, text).

    Words are runs of ASCII letters and digits and of characters beyond ASCII, with A-Z as a-z.  A window is ``size``
    consecutive words of an item (item_id, text), or all words of a shorter one.  Hash hits are compared word by word.
    Null, empty and wordless texts, of documents as of items, have no words and hit nothing.  Every row is scanned on its
    own, also those that share an id or have none; a null item id is listed last.
    """
    docs = docs.select("doc_id", "text")
    windows = _load(bench, size)
    if windows is None:
        return _report_by_join(docs, bench, size)
    return docs.mapInArrow(_report(windows), "doc_id long, n_words long, n_hit long, items array<long>")


def without_contaminated(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """Rows of ``docs`` (all columns) without a benchmark window."""
    windows = _load(bench, size)
    if windows is None:
        keyed = _keyed(docs)
        hit = _hits(keyed, bench, size).select("id").distinct()
        return keyed.join(hit, keyed[ROW] == hit["id"], "left_anti").select(docs.columns)
    return docs.mapInArrow(_without_documents(windows), docs.schema)


def without_passages(docs: DataFrame, bench: DataFrame, size: int = WINDOW) -> DataFrame:
    """``docs`` with every benchmark passage cut out of its text, from its first to its last word."""
    windows = _load(bench, size)
    if windows is None:
        keyed = _keyed(docs)
        spans = _hits(keyed, bench, size).groupBy(F.col("id").alias("__id")).agg(F.collect_set(F.struct("at", "m")).alias("__spans"))
        wide = keyed.join(spans, F.col(ROW) == F.col("__id"), "left").select(*docs.columns, "__spans")
        return wide.mapInArrow(_without_joined_spans, docs.schema)
    return docs.mapInArrow(_without_spans(windows), docs.schema)


def _windows_of(sizes: list[int], size: int, whole: bool):
    """(id, at, m, words) of windows: of one text's own length if ``whole``, else of all ``sizes``."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for first_row, raw, offsets in pieces(row_text(batch)):
                starts, ends, _, first = words(raw, offsets, LETTERS)
                low, out = LOWER[raw], []
                for k in range(len(offsets) - 1):
                    a, b = int(first[k]), int(first[k + 1])
                    own = ids[first_row + k].as_py()
                    for m in ([min(size, b - a)] if whole else sizes):
                        out += [(own, i - a, m, _joined(low, starts, ends, i, m)) for i in range(a, b - m + 1) if m]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))], ["id", "at", "m", "words"])

    return run


def _keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with a key of each row, written so that every reader sees the same one."""
    return save(docs.withColumn(ROW, F.monotonically_increasing_id()), "rows")


def _hits(keyed: DataFrame, bench: DataFrame, size: int) -> DataFrame:
    """(id, at, m, item) of the document windows, by row key, that are benchmark windows: a shuffle join, for any size."""
    schema = "id long, at long, m long, words binary"
    items = save(bench.select("item_id", "text").mapInArrow(_windows_of([], size, True), schema).dropDuplicates(["id", "words"]), "windows")
    sizes = sorted(r[0] for r in items.select("m").distinct().collect())
    found = keyed.select(ROW, "text").mapInArrow(_windows_of(sizes, size, False), schema).alias("d").join(
        items.select(F.col("id").alias("item"), "m", "words"), ["m", "words"])
    return save(found.select("d.id", "at", "m", "item"), "hits")


def _lengths(batches):
    for batch in batches:
        n = [r[1] for r in _scan(Windows([], WINDOW), row_text(batch))]
        yield batch.drop_columns(["text"]).append_column("n_words", pa.array(n, pa.int64()))


def _report_by_join(docs: DataFrame, bench: DataFrame, size: int) -> DataFrame:
    """The report for a benchmark of any size."""
    keyed = _keyed(docs)
    found = _hits(keyed, bench, size)
    n_hit = found.select("id", F.explode(F.sequence("at", F.col("at") + F.col("m") - 1)).alias("w")).distinct().groupBy("id").agg(F.count("*").alias("n_hit"))
    # A null is no member of a set, but a struct with one is.
    owners = found.groupBy("id").agg(F.array_sort(F.transform(F.collect_set(F.struct("item")), lambda x: x["item"])).alias("items"))
    return keyed.mapInArrow(_lengths, f"doc_id long, {ROW} long, n_words long").join(
        n_hit.join(owners, "id"), F.col(ROW) == F.col("id"), "left").select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"))


def _without_joined_spans(batches):
    for batch in batches:
        texts, spans, out = batch.column("text"), batch.column("__spans").to_pylist(), []
        for r, _, hit, _, (starts, ends) in _scan(Windows([], WINDOW), row_text(batch)):
            for span in spans[r] or ():
                hit[span["at"]:span["at"] + span["m"]] = True
            text = texts[r].as_py()
            out.append(_cut(text, hit, starts, ends) if hit.any() else text)
        yield _with_texts(batch, out).drop_columns(["__spans"])
