"""Token counts by a count-only Viterbi search over a unigram vocabulary.

The Aho-Corasick automaton names, for each place in a segment, all pieces that end there, longest
first. The search keeps two numbers for each place: the best score of any split of what comes
before, and that split's number of tokens; no path is kept. Ties follow the tokenizer: at each place
the candidate that begins first is kept unless a later one is better, and a character that is no
piece by itself may stand as unknown at ten below the lowest score, its tokens being one for each
byte where the vocabulary has byte pieces.

A text becomes segments: the mark U+2581 stands before the text and for each space, and as no piece
has a mark after another character, no piece crosses from a character into a mark. Each segment's
split is so independent, and equal segments are counted once.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evidex.llm.common import slices, small_batches, without

MARK = "▁"
#: How far below the lowest score an unknown character stands.
UNKNOWN_BELOW = 10.0
#: Most segments that a worker keeps counted between batches.
CACHED = 400_000

_SEGMENT = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+")


def vocabulary(model_file: str) -> tuple[list[tuple[str, float]], bool]:
    """((piece, score) of all normal pieces, whether there are byte pieces) of a sentencepiece model file."""
    import sentencepiece

    m = sentencepiece.SentencePieceProcessor(model_file=model_file)
    kept = [i for i in range(m.vocab_size()) if not (m.is_control(i) or m.is_unknown(i) or m.is_unused(i) or m.is_byte(i))]
    return [(m.id_to_piece(i), m.get_score(i)) for i in kept], any(m.is_byte(i) for i in range(m.vocab_size()))


class Counter(dict):
    """segment -> (tokens, score), computed when first asked for."""

    def __init__(self, pieces: list[tuple[str, float]], bytes_for_unknown: bool):
        import ahocorasick

        if any(MARK in p.lstrip(MARK) for p, _ in pieces):
            raise ValueError("a piece has a mark after another character, so texts can't be cut into segments")
        self.automaton = ahocorasick.Automaton()
        for p, s in pieces:
            self.automaton.add_word(p, (len(p), s))
        self.automaton.make_automaton()
        self.single = {p for p, _ in pieces if len(p) == 1}
        self.unknown = min(s for _, s in pieces) - UNKNOWN_BELOW
        self.bytes = bytes_for_unknown

    def __missing__(self, segment: str) -> tuple[int, float]:
        if len(self) >= CACHED:
            self.clear()
        self[segment] = found = self.count(segment)
        return found

    def count(self, segment: str) -> tuple[int, float]:
        n = len(segment)
        best, tokens, run = [0.0] + [float("-inf")] * n, [0] * (n + 1), [False] * (n + 1)
        single, unknown = self.single, self.unknown
        rare = [i for i, c in enumerate(segment, 1) if c not in single]
        ends = iter(rare)
        odd = next(ends, 0)
        for at, (size, score) in self.automaton.iter(segment):
            at += 1
            while odd and odd < at:
                self._odd(segment, odd, best, tokens, run, unknown)
                odd = next(ends, 0)
            begin = at - size
            total = best[begin] + score
            if total > best[at]:
                best[at], tokens[at], run[at] = total, tokens[begin] + 1, False
        while odd:
            self._odd(segment, odd, best, tokens, run, unknown)
            odd = next(ends, 0)
        return tokens[n], best[n]

    def _odd(self, segment: str, at: int, best: list, tokens: list, run: list, unknown: float) -> None:
        total = best[at - 1] + unknown
        if total > best[at]:  # a run of unknown characters is one token, or one for each byte
            more = len(segment[at - 1].encode()) if self.bytes else 0 if run[at - 1] else 1
            best[at], tokens[at], run[at] = total, tokens[at - 1] + more, True


def segments(text: str) -> list[str]:
    """The segments of a text; an empty text has none."""
    if not text:
        return []
    if MARK not in text and "  " not in text and text[0] != " " and text[-1] != " ":
        return [MARK + w for w in text.split(" ")]
    return _SEGMENT.findall(MARK + text.replace(" ", MARK))


def count_tokens(docs: DataFrame, pieces: list[tuple[str, float]], bytes_for_unknown: bool) -> DataFrame:
    """``docs`` with n_tokens (long) and best_score (double): of the whole text under the vocabulary.

    Null and empty texts have 0 tokens and score 0. Columns of these names are replaced; repeated rows
    each get their result. The vocabulary is sent to the executors: its size is the model's, whatever
    the documents are. A worker keeps at most ``CACHED`` segments, which bounds memory and not results.
    """
    small_batches(docs.sparkSession)
    docs = without(docs, "n_tokens", "best_score")
    sent = docs.sparkSession.sparkContext.broadcast((pieces, bytes_for_unknown))
    text = f"c{docs.columns.index('text')}"

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Counter(*sent.value)
        for batch in batches:
            for part in slices(batch, text):
                n, score = np.zeros(len(part), np.int64), np.zeros(len(part))
                for i, t in enumerate(part.column(text).to_pylist()):
                    if t:
                        found = list(map(known.__getitem__, segments(t)))
                        n[i], score[i] = sum(x[0] for x in found), sum(x[1] for x in found)
                columns = {c: part.column(c) for c in part.schema.names}
                yield pa.record_batch(columns | {"n_tokens": pa.array(n), "best_score": pa.array(score)})

    named = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    schema = named.withColumns({"n_tokens": F.lit(0).cast("long"), "best_score": F.lit(0.0)}).schema
    return named.mapInArrow(count, schema).toDF(*docs.columns, "n_tokens", "best_score")
