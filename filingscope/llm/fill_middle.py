"""Fill-in-middle transformation: a text is cut at two ranks of its tokens and its middle moves to the end.

The tokens of a text form an indexable skip list.  Each link of a lane carries the tokens and the code points it skips;
a descent adds up these widths, so that it reaches the token of a rank and its place in code points together.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from filingscope.llm.store import row_text
from filingscope.llm.words import mix

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
#: Of 100 hash values, those from PLAIN on leave a text as it is, and those below SUFFIX_FIRST put the suffix first.
PLAIN, SUFFIX_FIRST = 90, 20
#: One node in 2 ** STEP of a lane is also in the lane above.
STEP = 2

_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def token_widths(text: str) -> np.ndarray:
    """Code points of each token: a run of ASCII letters, or any other single code point."""
    raw = np.frombuffer(text.encode(), np.uint8)
    begins, letter = (raw & 0xC0) != 0x80, _LETTER[raw]
    head = begins & ~letter
    if len(raw):
        head[0] |= letter[0]
        head[1:] |= letter[1:] & ~letter[:-1]
    places = np.cumsum(begins)
    starts = places[head] - 1
    return np.diff(np.append(starts, places[-1] if len(raw) else 0))


class SkipList:
    """Lanes of links over weighted units, from the sparsest to the full one.

    A node's height follows from a hash of its number, so the list of a text is always the same.  ``lanes[k]`` holds, for
    each link of lane k, the units and the code points it skips and the number, in the lane below, of the link it begins with.
    """

    def __init__(self, widths: np.ndarray, step: int = STEP) -> None:
        n = len(widths)
        bits = mix(np.arange(1, n + 1, dtype=np.uint64))
        units, points, lanes = np.ones(n, np.int64), widths.astype(np.int64), []
        lanes.append((units, points, np.zeros(n, np.int64)))
        mask = np.uint64(0)
        while len(units) > 1 << step and len(lanes) < 64 // step:
            mask = (mask << np.uint64(step)) | np.uint64((1 << step) - 1)
            tall = (bits & mask) == 0
            tall[0] = True  # the head is in every lane
            first = np.flatnonzero(tall)
            units, points, bits = np.add.reduceat(units, first), np.add.reduceat(points, first), bits[first]
            lanes.append((units, points, first))
        self.lanes = lanes[::-1]
        self.units, self.points = n, int(widths.sum())

    def place(self, rank: int) -> int:
        """Code points before the unit of this rank; the rank of the end is the number of units."""
        if not 0 <= rank <= self.units:
            raise IndexError(rank)
        node = units = points = 0
        for skips, widths, below in self.lanes:
            while node < len(skips) and units + skips[node] <= rank:
                units += int(skips[node])
                points += int(widths[node])
                node += 1
            if units == rank:
                return points
            node = int(below[node])
        return points


def _cut(batches):
    for batch in batches:
        rows = []
        for text, h1, h2, plain, suffix_first in zip(
                row_text(batch).to_pylist(), *(batch.column(c).to_pylist() for c in ("h1", "h2", "plain", "suffix_first"))):
            tokens = SkipList(token_widths(text))
            n = tokens.units
            if plain:
                rows.append((n, "plain", None, None, text))
                continue
            a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
            i, j = tokens.place(a), tokens.place(b)
            prefix, middle, suffix = text[:i], text[i:j], text[j:]
            if suffix_first:
                rows.append((n, "spm", i, j - i, SUFFIX + suffix + PREFIX + prefix + MIDDLE + middle))
            else:
                rows.append((n, "psm", i, j - i, PREFIX + prefix + SUFFIX + suffix + MIDDLE + middle))
        kinds = [pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.large_string()]
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), *(pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds))],
            ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def transform(docs: DataFrame) -> DataFrame:
    """doc_id, n, form, prefix_chars, middle_chars, output of each row of ``docs`` (doc_id, text).

    The cuts and the form follow from a SHA-256 of ``1:<doc_id>``; rows that share an id share them, a null id counts as
    an empty one.  A null text is an empty text.  Empty texts and texts with a mark of their own stay plain, at any length.
    Extra columns are ignored.
    """
    digest = F.sha2(F.concat(F.lit("1:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    h = [F.conv(F.substring("digest", 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]
    text = F.coalesce("text", F.lit(""))
    marked = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    rows = docs.select("doc_id", "text").withColumn("digest", digest).select(
        "doc_id", text.alias("text"), h[0].alias("h1"), h[1].alias("h2"),
        ((text == "") | marked | (h[2] % 100 >= PLAIN)).alias("plain"), (h[3] % 100 < SUFFIX_FIRST).alias("suffix_first"))
    return rows.mapInArrow(_cut, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form") -> Column:
    """The text an output was made of.  No part holds a mark, so each mark is found at its first place."""
    first, second, third = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    part = lambda text, mark, k: F.split_part(text, mark, F.lit(k))
    o, f = F.col(output), F.col(form)
    middle = part(o, third, 2)
    head = part(o, third, 1)
    psm = F.concat(part(part(head, second, 1), first, 2), middle, part(head, second, 2))
    spm = F.concat(part(head, first, 2), middle, part(part(head, first, 1), second, 2))
    return F.when(f == "plain", o).when(f == "psm", psm).otherwise(spm)
