"""Token counts of a unigram tokenizer, without the tokens.

An Aho-Corasick automaton lists the vocabulary entries that end at each character; dynamic
programming keeps, for each position, the best score and the number of pieces of the way there.
Ties follow the tokenizer: a later way replaces an earlier one only if its score is larger, and
ways are tried in order of where their last piece starts. A character that no entry of one
character covers may stand for itself at ten below the smallest score; such a piece counts once
per byte (byte fallback).

Before counting, blanks become the word mark and one is put in front, as the tokenizer's own
normaliser does for a model without further rules. If no entry holds a word mark after another
character, the text falls into segments at those places; scores of segments add up, and the count
of a segment is kept. With whole-number scores the sums are exact, so ties are decided alike.

The vocabulary is read from a sentencepiece model file by the driver and broadcast: it is a fixed
file. Results: a null or empty text has 0 tokens; whole texts of any length are counted.
"""

from __future__ import annotations

import math
import re
from collections.abc import Iterator
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

MARK = "▁"
UNKNOWN_PENALTY = 10.0


@dataclass
class Vocabulary:
    scores: dict[str, float]  # entries that text can match
    unknown: float  # score of a character without an entry
    prefix: bool = True  # put a word mark in front

    @classmethod
    def of(cls, path: str) -> Vocabulary:
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = [i for i in range(model.get_piece_size()) if not (model.is_unknown(i) or model.is_control(i) or model.is_byte(i))]
        scores = {model.id_to_piece(i): model.get_score(i) for i in ids}
        return cls(scores, min(scores.values()) - UNKNOWN_PENALTY)


class Counter:
    MOST_SEGMENTS = 400_000

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.entries = ahocorasick.Automaton()
        for entry, score in vocabulary.scores.items():
            self.entries.add_word(entry, (len(entry), score))
        self.entries.make_automaton()
        cuts = not any(MARK in entry.lstrip(MARK) for entry in vocabulary.scores)
        whole = all(float(s).is_integer() for s in vocabulary.scores.values())
        self.segments = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+").findall if cuts and whole else lambda text: [text]
        self.seen: dict[str, tuple[int, float]] = {}

    def best(self, text: str) -> tuple[int, float]:
        """Pieces and score of the best way through ``text``."""
        size = len(text)
        starts: list[list[tuple[int, float]]] = [[] for _ in range(size)]
        for end, found in self.entries.iter(text):
            starts[end + 1 - found[0]].append(found)
        score = [-math.inf] * (size + 1)
        pieces = [0] * (size + 1)
        score[0] = 0.0
        unknown = self.vocabulary.unknown
        for at in range(size):
            here, count, single = score[at], pieces[at], False
            for length, own in starts[at]:
                single = single or length == 1
                if here + own > score[at + length]:
                    score[at + length] = here + own
                    pieces[at + length] = count + 1
            if not single and here + unknown > score[at + 1]:
                score[at + 1] = here + unknown
                pieces[at + 1] = count + len(text[at].encode())
        return pieces[size], score[size]

    def count(self, text: str | None) -> tuple[int, float]:
        if not text:
            return 0, 0.0
        marked = text.replace(" ", MARK)
        if self.vocabulary.prefix:
            marked = MARK + marked
        seen, total, points = self.seen, 0, 0.0
        for segment in self.segments(marked):
            found = seen.get(segment)
            if found is None:
                found = self.best(segment)
                if len(segment) <= 64:
                    if len(seen) >= self.MOST_SEGMENTS:
                        seen.clear()
                    seen[segment] = found
            total += found[0]
            points += found[1]
        return total, points


def token_counts(df: DataFrame, vocabulary: Vocabulary, text: str = "text") -> Column:
    """Struct column ``tokens, score`` for the text of each row of ``df``."""
    shared = df.sparkSession.sparkContext.broadcast(vocabulary)
    kind = pa.struct([("tokens", pa.int64()), ("score", pa.float64())])

    def run(batches):
        from tactile.llm.unigram import Counter

        counter = Counter(shared.value)
        for texts in batches:
            rows = [counter.count(t.as_py()) for t in texts]
            yield pa.array([{"tokens": n, "score": s} for n, s in rows], kind)

    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, "tokens long, score double")(F.col(text))
