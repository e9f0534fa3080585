"""Token counts by a count-only Viterbi over a unigram vocabulary.

An Aho-Corasick automaton enumerates the pieces that end at each character. The dynamic program carries
the best score and that path's number of pieces; no path is kept. Ties are decided as unigram tokenizers
decide them: positions are filled from left to right and a later candidate must be strictly better, so of equal
scores the piece that starts first wins. A character that no piece covers alone costs the
unknown score (ten below the least score) and counts as many pieces as it has UTF-8 bytes.

Spaces become word marks and one is put before the text. No piece joins a mark to what stands before it,
so blocks (marks and what follows) are independent and their counts are remembered up to a fixed number.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import slices, worker_cache

MARK = "▁"
#: Blocks that are remembered, at most, and the characters of the longest of them.
CACHE, CACHED_LENGTH = 500_000, 64
BLOCKS = re.compile(" +[^ ]*")


def vocabulary(path: str) -> list[tuple[str, float]]:
    """Pieces and scores of a sentencepiece file, without control, unknown and byte pieces."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    skip = (model.is_control, model.is_unknown, model.is_byte, model.is_unused)
    return [(model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()) if not any(f(i) for f in skip)]


class Counts(dict):
    """Piece counts of blocks."""

    def __init__(self, pieces: list[tuple[str, float]]):
        super().__init__()
        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.single = {piece for piece, _ in pieces if len(piece) == 1}
        self.unknown = min((s for _, s in pieces), default=0.0) - 10
        if any(MARK in p.strip(MARK) or p.endswith(MARK) and p.strip(MARK) for p, _ in pieces):
            raise ValueError("a piece joins a word mark to what stands before it")

    def __missing__(self, block: str) -> int:
        count = self.viterbi(block)
        if len(block) <= CACHED_LENGTH:
            if len(self) >= CACHE:
                self.clear()
            self[block] = count
        return count

    def viterbi(self, block: str) -> int:
        """Pieces on the best path over ``block``, whose spaces stand for marks."""
        text = block.replace(" ", MARK)
        n = len(text)
        best, pieces = [0.0] + [None] * n, [0] * (n + 1)
        matches = self.automaton.iter(text)
        match = next(matches, None)
        for end in range(1, n + 1):
            top, count, longest = None, 0, 0
            while match is not None and match[0] == end - 1:
                length, score = match[1]
                score += best[end - length]
                if top is None or score > top or score == top and length > longest:
                    top, count, longest = score, pieces[end - length] + 1, length
                match = next(matches, None)
            if text[end - 1] not in self.single:
                score = best[end - 1] + self.unknown
                if top is None or score > top:
                    top, count = score, pieces[end - 1] + len(text[end - 1].encode())
            best[end], pieces[end] = top, count
        return pieces[n]

    def of(self, text: str) -> int:
        if not text:
            return 0
        if MARK in text:
            text = text.replace(MARK, " ")
        if "  " in text or text[0] == " ":
            return sum(map(self.__getitem__, BLOCKS.findall(" " + text)))
        return sum(map(self.__getitem__, [" " + x for x in text.split(" ")]))


def counts_of(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = worker_cache(("unigram", path), lambda: Counts(vocabulary(path)))
        for batch in slices(batches):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([counts.of(x or "") for x in batch.column("text").to_pylist()], pa.int64())], names=["doc_id", "n_tokens"])

    return run


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Rows (doc_id, n_tokens), one for each input row.

    Null and empty texts have 0 tokens. Null ids stay null, repeated rows stay, an empty table gives no
    rows, other columns are not read.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(counts_of(vocabulary_path), "doc_id long, n_tokens long")
