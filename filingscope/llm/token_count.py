"""Token counts under a unigram vocabulary without the tokens: best score and number of pieces by dynamic programming.

Rules, as the tokenizers' unigram model has them: spaces are U+2581 and one is put before a text; every vocabulary piece
is an edge of a lattice over code points; a code point that is no piece is an edge of its own, scored ten below the
smallest score, and counts as its UTF-8 bytes; the best path has the highest sum of scores in double precision; of edges
that reach a place with equal sums the one that starts first stays.
"""

from __future__ import annotations

import re

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from filingscope.llm.store import row_text

VOCABULARY, SPACE, UNKNOWN = "piece_bpe_32k.model", "▁", 10.0
#: Segments that a Python worker remembers.
CACHED = 500_000
#: No piece reaches from one of these segments into the next.
_SEGMENT = re.compile(f"\n|{SPACE}*[^{SPACE}\n]+|{SPACE}+")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces of ordinary text with their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i) or model.is_unused(i))]


class Counter:
    """Piece counts and scores of texts under (piece, score) pairs."""

    def __init__(self, pieces: list[tuple[str, float]]) -> None:
        self.pieces = ahocorasick.Automaton()
        for piece, score in pieces:
            inner = piece.lstrip(SPACE)
            if SPACE in inner or "\n" in piece and piece != "\n":
                raise ValueError(f"{piece!r} crosses a segment")
            self.pieces.add_word(piece, (len(piece), score))
        self.pieces.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - UNKNOWN
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best path.  Matches come by end, longest first, so that ties keep the first start."""
        n = len(text)
        best, count, done = [float("-inf")] * (n + 1), [0] * (n + 1), 0
        best[0] = 0.0

        def close(end: int) -> None:
            """Nothing more ends here: the edge of an unknown code point is the last."""
            c = text[end - 1]
            if c not in self.single and best[end - 1] + self.unknown > best[end]:
                best[end], count[end] = best[end - 1] + self.unknown, count[end - 1] + len(c.encode())

        for last, (length, score) in self.pieces.iter(text):
            end = last + 1
            while done < last:
                done += 1
                close(done)
            start = end - length
            if best[start] + score > best[end]:
                best[end], count[end] = best[start] + score, count[start] + 1
        while done < n:
            done += 1
            close(done)
        return count[n], best[n]

    def text(self, text: str) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        segments = _SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        known = self.known
        if len(known) > CACHED:
            known.clear()
        n, total = 0, 0.0
        for s in segments:
            found = known.get(s)
            if found is None:
                found = self.segment(s)
                if len(s) < 64:
                    known[s] = found
            n += found[0]
            total += found[1]
        return n, total


_workers: dict[str, Counter] = {}


def counter(path: str) -> Counter:
    """One for each Python worker, which serves many tasks."""
    if path not in _workers:
        _workers[path] = Counter(vocabulary(path))
    return _workers[path]


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def count_tokens(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, score of each row of ``docs`` (doc_id, text); null and empty texts have no tokens."""
    path = path or vocabulary_path()

    def run(batches):
        count = counter(path)
        for batch in batches:
            rows = [count.text(t.as_py()) for t in row_text(batch)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), pa.array([r[0] for r in rows], pa.int64()), pa.array([r[1] for r in rows], pa.float64())], ["doc_id", "n_tokens", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, n_tokens long, score double")
