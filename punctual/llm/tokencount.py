"""Token counts without tokens: best segmentation score and its number of pieces.

An Aho-Corasick automaton lists the vocabulary's matches in a segment of text; a pass over their ends carries
the best score and the piece count. No piece spans the start of a word, so texts are counted segment by segment
(white space and the word behind it), and a task remembers the segments it has seen.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from punctual.llm.common import slices

#: Segments that a Python worker remembers before it starts afresh.
REMEMBERED = 400_000
#: What a character outside the vocabulary costs below the worst piece.
UNKNOWN_PENALTY = 10.0
#: Scores at or below this are placeholders (runs of spaces); such pieces take the worst score above it.
PLACEHOLDER = -1e8
_SPACE = "▁"
_segments = re.compile(f"{_SPACE}+[^{_SPACE}]*")


class Counter:
    """Counts of the unigram segmentation with the pieces and scores of a vocabulary file.

    Ties follow the tokenizer: of equal scores the one found first stays, and pieces are met from earlier
    starts first. A character that is no piece is one unknown, spelled as its UTF-8 bytes.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        self.automaton = ahocorasick.Automaton()
        usual = (i for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i)))
        scores = {model.id_to_piece(i): model.get_score(i) for i in usual}
        worst = min(s for s in scores.values() if s > PLACEHOLDER)
        self.single = {name for name in scores if len(name) == 1}
        for name, score in scores.items():
            if _SPACE in name.lstrip(_SPACE):
                raise ValueError("a piece of this vocabulary spans words")
            self.automaton.add_word(name, (len(name), max(score, worst)))
        self.automaton.make_automaton()
        self.unknown = worst - UNKNOWN_PENALTY
        self.known: dict[str, tuple[int, float]] = {}

    def segment(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best segmentation."""
        n = len(text)
        best, count = [0.0] + [None] * n, [0] * (n + 1)
        at = 0

        def unknowns(to: int) -> None:
            # matches end in order: characters up to an end are settled before it is used as a start
            nonlocal at
            while at < to:
                at += 1
                c = text[at - 1]
                if c not in self.single:
                    score = best[at - 1] + self.unknown
                    if best[at] is None or score > best[at]:
                        best[at], count[at] = score, count[at - 1] + len(c.encode())

        for end, (size, score) in self.automaton.iter(text):
            unknowns(end)
            end += 1
            score += best[end - size]
            if best[end] is None or score > best[end]:
                best[end], count[end] = score, count[end - size] + 1
        unknowns(n)
        return count[n], best[n]

    def text(self, text: str | None) -> tuple[int, float]:
        """Pieces and score of a whole text; a null or empty one has none."""
        if not text:
            return 0, 0.0
        if len(self.known) > REMEMBERED:
            self.known = {}
        known, n, total = self.known, 0, 0.0
        for part in _segments.findall(_SPACE + text.replace(" ", _SPACE)):
            found = known.get(part)
            if found is None:
                found = known[part] = self.segment(part)
            n += found[0]
            total += found[1]
        return n, total


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(docs: DataFrame, path: str) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, n_chars, n_tokens, score)``, a row for each row.

    Null and empty texts have no tokens and score 0. Ids may be null or repeated; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path)
        for batch in slices(batches):
            texts = batch.column("text").to_pylist()
            found = [counter.text(t) for t in texts]
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array([len(t or "") for t in texts], pa.int64()),
                    pa.array([f[0] for f in found], pa.int64()),
                    pa.array([f[1] for f in found], pa.float64()),
                ],
                ["doc_id", "n_chars", "n_tokens", "score"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {kind}, n_chars long, n_tokens long, score double")
