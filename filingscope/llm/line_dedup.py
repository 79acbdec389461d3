"""Reversible line dedup: sharded cuckoo filters in front of exact reference counts.

The state of an index is three tables.  ``postings`` has one row for each line key and document, ``counts`` the exact
number of documents and the largest document of each key, ``filters`` one cuckoo filter a shard with the keys that
enough documents share.  Insertions and deletions of documents change all three; deleting what was inserted gives back
the earlier decisions, which a filter without deletion could not.
"""

from __future__ import annotations

from dataclasses import dataclass, replace
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from filingscope.llm.cuckoo import Cuckoo
from filingscope.llm.store import fresh_name, narrow, row_text, save
from filingscope.llm.words import SPACES

#: Shared keys of a shard on average, at most; bytes of filters that are broadcast; code points of an eligible key.
SHARD_KEYS, FILTER_BYTES, MIN_CHARS = 1 << 14, 64 << 20, 40
#: Changes until an index is written as a whole; postings that meet a copy of a shard's filter.
CHANGES, GROUP_ROWS = 8, 1 << 20
_KEY = "k1 long, k2 long"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128 bits of the key of a line, None if the key is too short."""
    key = line.strip(SPACES)
    if len(key) < min_chars or (not key.isascii() and len(key.decode()) < min_chars):
        return None
    return blake2b(key.lower(), digest_size=16).digest()


def _post(min_chars: int):
    def run(batches):
        for batch in batches:
            keys, docs, refs = [], [], []
            for doc, text in zip(batch.column("doc_id").to_pylist(), row_text(batch)):
                own: dict[bytes, int] = {}
                for line in text.as_buffer().to_pybytes().split(b"\n"):
                    if (key := line_key(line, min_chars)) is not None:
                        own[key] = own.get(key, 0) + 1
                keys += own
                refs += own.values()
                docs += [doc] * len(own)
            k = np.frombuffer(b"".join(keys), np.int64).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays(
                [pa.array(k[:, 0]), pa.array(k[:, 1]), pa.array(docs, pa.int64()), pa.array(refs, pa.int64())], ["k1", "k2", "doc_id", "refs"])

    return run


def _unsigned(table, name: str) -> np.ndarray:
    return table.column(name).to_numpy().astype(np.int64).view(np.uint64)


def _refilter(key, filters, changes):
    """A shard's filter after its gained and lost keys."""
    cells = filters.column("cells").to_pylist()
    k1, k2 = _unsigned(changes, "k1"), _unsigned(changes, "k2")
    gained = changes.column("gained").to_numpy(zero_copy_only=False).astype(bool)
    current = Cuckoo.load(cells[0]) if cells else Cuckoo.sized(int(gained.sum()))
    current.discard(k1[~gained], k2[~gained])
    grown = Cuckoo(current.cells.copy())
    full = not grown.add(k1[gained], k2[gained])
    return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([b"" if full else grown.dump()], pa.binary()), "full": [full]})


def _rebuild(key, keys):
    size = keys.num_rows
    while True:
        cells = Cuckoo.sized(size)
        if cells.add(_unsigned(keys, "k1"), _unsigned(keys, "k2")):
            return pa.table({"shard": pa.array([key[0].as_py()], pa.int32()), "cells": pa.array([cells.dump()], pa.binary())})
        size *= 2


def _counted(rows: DataFrame) -> DataFrame:
    return rows.groupBy("k1", "k2").agg(F.count("*").alias("docs"), F.max("doc_id").alias("last"))


@dataclass(frozen=True)
class LineIndex:
    """Line keys of a corpus.  Each change returns a new index; the old one stays valid.

    A change writes the new postings, the counts of the keys that it touches and the filters of their shards.  The rest
    is read from what earlier changes wrote; after ``CHANGES`` of them all is written anew, so that plans stay short.
    """

    spark: SparkSession
    min_docs: int
    min_chars: int
    shards: int
    postings: DataFrame
    counts: DataFrame
    filters: DataFrame
    keys: int = 0
    changes: int = 0

    @classmethod
    def of(cls, docs: DataFrame, min_docs: int = 5, min_chars: int = MIN_CHARS) -> LineIndex:
        """An index of ``docs`` (doc_id, text)."""
        spark = docs.sparkSession
        index = cls(spark, min_docs, min_chars, 1, docs, docs, docs)
        own = index._keys(docs)
        return replace(index, postings=own, counts=save(_counted(own), "counts"))._sharded()

    def _keys(self, docs: DataFrame) -> DataFrame:
        rows = docs.filter("doc_id IS NOT NULL").select("doc_id", "text").mapInArrow(_post(self.min_chars), f"{_KEY}, doc_id long, refs long")
        return save(rows.groupBy("k1", "k2", "doc_id").agg(F.sum("refs").alias("refs")), "postings")

    def _shard(self):
        return _shard_of(F.col("k2"), self.shards).alias("shard")

    def _eligible(self, counts: DataFrame) -> DataFrame:
        return counts.filter(F.col("docs") >= self.min_docs).select("k1", "k2")

    def _sharded(self) -> LineIndex:
        """All filters from the exact counts, in as many shards as their keys need."""
        eligible = self._eligible(self.counts)
        keys = eligible.count()
        own = replace(self, keys=keys, shards=1 << (keys // SHARD_KEYS).bit_length())
        rows = eligible.withColumn("shard", own._shard())
        return replace(own, filters=save(rows.groupBy("shard").applyInArrow(_rebuild, "shard int, cells binary"), "filters"))

    def insert(self, docs: DataFrame) -> LineIndex:
        """Add documents; ids that the index holds already are replaced."""
        return self._changed(docs.select("doc_id"), self._keys(docs))

    def delete(self, ids: DataFrame) -> LineIndex:
        """Take out all rows of the documents in ``ids`` (doc_id)."""
        return self._changed(ids, self.postings.limit(0))

    def _changed(self, ids: DataFrame, added: DataFrame) -> LineIndex:
        ids = narrow(save(ids.select("doc_id").filter("doc_id IS NOT NULL").distinct(), "ids"))
        rest = self.postings.join(ids, "doc_id", "left_anti").select(*self.postings.columns)
        lost = save(self.postings.join(ids, "doc_id", "left_semi").select("k1", "k2").distinct(), "lost")
        touched = narrow(save(lost.union(added.select("k1", "k2")).distinct(), "touched"))
        before = save(self.counts.join(touched, ["k1", "k2"], "left_semi"), "before")
        # A key that lost documents is counted anew from its postings, another one only grows.
        stays = before.join(narrow(lost), ["k1", "k2"], "left_anti").unionByName(_counted(rest.join(narrow(lost), ["k1", "k2"], "left_semi")))
        after = stays.unionByName(_counted(added)).groupBy("k1", "k2").agg(F.sum("docs").alias("docs"), F.max("last").alias("last"))
        after = save(after, "counts")
        counts = self.counts.join(touched, ["k1", "k2"], "left_anti").unionByName(after)
        postings, changes = rest.unionByName(added), self.changes + 1
        if changes >= CHANGES:
            postings, counts, changes = save(postings, "postings"), save(counts, "counts"), 0
        return replace(self, postings=postings, counts=counts, changes=changes)._moved(before, after)

    def _moved(self, before: DataFrame, after: DataFrame) -> LineIndex:
        """Bring the filters from the old counts of the touched keys to the new ones; too many keys get more shards."""
        old, new = self._eligible(before), self._eligible(after)
        changes = new.join(old, ["k1", "k2"], "left_anti").withColumn("gained", F.lit(True)).unionByName(
            old.join(new, ["k1", "k2"], "left_anti").withColumn("gained", F.lit(False))).withColumn("shard", self._shard())
        changes = save(changes, "changes")
        moved = narrow(save(changes.groupBy("shard").agg(F.sum(F.expr("IF(gained, 1L, -1L)")).alias("more")), "shards"))
        keys = self.keys + (moved.agg(F.sum("more")).first()[0] or 0)
        if keys // SHARD_KEYS >= self.shards:
            return self._sharded()
        mine = self.filters.join(moved, "shard", "left_semi")
        changed = save(mine.groupBy("shard").cogroup(changes.groupBy("shard")).applyInArrow(_refilter, "shard int, cells binary, full boolean"), "filters")
        outgrown = changed.filter("full").select("shard")
        anew = self._eligible(self.counts).withColumn("shard", self._shard()).join(narrow(outgrown), "shard", "left_semi").groupBy("shard").applyInArrow(_rebuild, "shard int, cells binary")
        same = self.filters.join(moved, "shard", "left_anti")
        return replace(self, keys=keys, filters=save(same.unionByName(changed.filter("NOT full").select("shard", "cells")).unionByName(anew), "filters"))

    def drops(self, filter_bytes: int = FILTER_BYTES) -> DataFrame:
        """(doc_id, k1, k2): keys whose lines go from a document, as enough documents share them and a larger id has them.

        The postings pass the filters first: these are broadcast while they take ``filter_bytes`` at most, beyond that
        each shard meets its postings in groups of bounded size.  The exact counts decide.
        """
        rows = self.postings.select("doc_id", "k1", "k2")
        size = self.filters.agg(F.sum(F.length("cells"))).first()[0] or 0
        if size <= filter_bytes:
            maybe = rows.mapInArrow(_probe({r[0]: bytes(r[1]) for r in self.filters.collect()}, self.shards), rows.schema)
        else:
            maybe = self._probed_by_shard(rows)
        shared = self.counts.filter(F.col("docs") >= self.min_docs).select("k1", "k2", "last")
        return maybe.join(narrow(shared), ["k1", "k2"]).filter("doc_id < last").select("doc_id", "k1", "k2")

    def _probed_by_shard(self, rows: DataFrame, group: int = GROUP_ROWS) -> DataFrame:
        """Postings that a filter has, a shard's filter copied to as many groups as its postings, hot keys among them, fill."""
        rows = rows.withColumn("shard", self._shard())
        sizes = save(rows.groupBy("shard").agg(F.ceil(F.count("*") / group).cast("int").alias("parts")), "parts")
        dealt = rows.join(narrow(sizes), "shard").withColumn("part", F.pmod(F.xxhash64("doc_id", "k1"), F.col("parts")).cast("int"))
        copies = self.filters.join(narrow(sizes), "shard").select("shard", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part"), "cells")
        by = ["shard", "part"]
        return copies.groupBy(*by).cogroup(dealt.select("doc_id", "k1", "k2", *by).groupBy(*by)).applyInArrow(_kept, "doc_id long, k1 long, k2 long")


def _shard_of(k2, shards: int):
    return F.pmod(F.shiftright(k2, 20), F.lit(shards)).cast("int")


def _kept(filters, rows):
    rows = rows.select(["doc_id", "k1", "k2"])
    if not filters.num_rows or not rows.num_rows:
        return rows.slice(0, 0)
    return rows.filter(pa.array(Cuckoo.load(filters.column("cells")[0].as_py()).has(_unsigned(rows, "k1"), _unsigned(rows, "k2"))))


def _probe(filters: dict[int, bytes], shards: int):
    def run(batches):
        cells = {k: Cuckoo.load(v) for k, v in filters.items()}
        for batch in batches:
            k1, k2 = (_unsigned(batch, c) for c in ("k1", "k2"))
            shard = (k2.view(np.int64) >> 20) % shards
            keep = np.zeros(len(k1), bool)
            for s in np.unique(shard).tolist():
                if s in cells:
                    own = np.flatnonzero(shard == s)
                    keep[own] = cells[s].has(k1[own], k2[own])
            yield batch.filter(pa.array(keep))

    return run


def _cut(min_chars: int, report: bool, gone_name: str):
    def run(batches):
        for batch in batches:
            texts, lines, dropped = [], [], []
            drops = batch.column(gone_name).to_pylist()
            given = batch.column("text")
            for row, (text, gone) in enumerate(zip(row_text(batch), drops)):
                raw = text.as_buffer().to_pybytes()
                if gone:
                    out, own = set(gone), raw.split(b"\n")
                    kept = [x for x in own if line_key(x, min_chars) not in out]
                    texts.append(b"\n".join(kept).decode())
                    lines.append(len(own))
                    dropped.append(len(own) - len(kept))
                else:
                    texts.append(raw.decode() if report else given[row].as_py())
                    lines.append(raw.count(b"\n") + 1)
                    dropped.append(0)
            if report:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), pa.array(texts, given.type), pa.array(lines, pa.int64()), pa.array(dropped, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])
            else:
                out = batch.set_column(batch.schema.get_field_index("text"), "text", pa.array(texts, given.type))
                yield out.drop_columns([gone_name])

    return run


def _with_drops(docs: DataFrame, index: LineIndex) -> tuple[DataFrame, str]:
    """``docs`` with the keys that each document loses, and the name of their column."""
    name = fresh_name(docs, "__drops")
    packed = index.drops().select("doc_id", F.unhex(F.concat(_hex("k1"), _hex("k2"))).alias("__key"))
    lists = save(packed.groupBy("doc_id").agg(F.collect_list("__key").alias(name)), "drops")
    rows, keys = lists.agg(F.count("*"), F.sum(F.size(name))).first()
    return docs.join(narrow(lists, max(rows, (keys or 0) // 4)), "doc_id", "left"), name  # four keys take a row's memory


def _hex(name: str):
    """The eight bytes of a long in the order the key had them."""
    h = F.lpad(F.hex(name), 16, "0")
    return F.concat(*[F.substring(h, 15 - 2 * i, 2) for i in range(8)])


def dedup_lines(docs: DataFrame, min_docs: int = 5, min_chars: int = MIN_CHARS) -> DataFrame:
    """``docs`` with the lines that ``min_docs`` documents share left only in the largest doc_id that has them.

    A line's key has ASCII white space cut at both ends and A-Z as a-z; keys under ``min_chars`` code points stay.
    All lines of a document with a dropped key go, in the keeper all stay.  Null and empty texts are one empty line
    and stay as they are, as do rows with a null id.  Rows that share an id count as one document.  Texts of any length
    are split as a whole; other columns, whatever their names, stay as they are.
    """
    index = LineIndex.of(docs, min_docs, min_chars)
    wide, name = _with_drops(docs, index)
    return wide.mapInArrow(_cut(min_chars, False, name), docs.select("doc_id", *[c for c in docs.columns if c != "doc_id"]).schema).select(*docs.columns)


def line_report(docs: DataFrame, min_docs: int = 5, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, text (what is left of it, never null), n_lines, n_dropped of each row."""
    docs = docs.select("doc_id", "text")
    wide, name = _with_drops(docs, LineIndex.of(docs, min_docs, min_chars))
    return wide.mapInArrow(_cut(min_chars, True, name), "doc_id long, text string, n_lines long, n_dropped long")
