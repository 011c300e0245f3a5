"""Byte-level BPE: encoding in linear time, and decoding.

Text is cut by the tokenizer's pattern; each piece is encoded for itself. Instead of merging, the
tokens of a piece are found from the left: the longest vocabulary entry at a position is tried
first, and a token may follow another only if the merges would leave that pair apart. A position
from which nothing goes on is marked, so it is never tried twice. An Aho-Corasick automaton over
Latin-1 (one character per byte) says how far entries reach from a position, so nothing is listed
before it is needed; the answer for a pair of tokens is kept.

The rank file is read by the driver and broadcast: it is a fixed file of some 50,000 entries.

Results: null text encodes as the empty text, to no ids; every id decodes to its bytes; texts of
any length are encoded whole. Ids outside the vocabulary fail to decode. Rows are independent of each
other: repeated rows give equal results, and an empty table gives none. Other columns are kept.
"""

from __future__ import annotations

import base64
from dataclasses import dataclass

import ahocorasick
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, types as T

from tactile.llm.common import release, slices


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}


def _last_merge(token: bytes, ranks: dict[bytes, int]) -> tuple[bytes, bytes] | None:
    """The two parts that the merges join last to make ``token``; None for a single byte, or for
    an entry that no merge reaches."""
    parts = [token[i : i + 1] for i in range(len(token))]
    own = ranks[token]
    while len(parts) > 2:
        best, at = own, -1
        for i in range(len(parts) - 1):
            rank = ranks.get(parts[i] + parts[i + 1], own)
            if rank < best:
                best, at = rank, i
        if at < 0:
            return None
        parts[at : at + 2] = [parts[at] + parts[at + 1]]
    return (parts[0], parts[1]) if len(parts) == 2 else None


@dataclass
class Vocabulary:
    """What workers need: the bytes of each id, and the two ids each one is made of last (its own
    id twice for single bytes)."""

    pieces: dict[int, bytes]
    split: dict[int, tuple[int, int]]
    pattern: str

    @classmethod
    def of(cls, ranks: dict[bytes, int], pattern: str) -> Vocabulary:
        split = {}
        for token, rank in ranks.items():
            pair = _last_merge(token, ranks)
            if pair:
                split[rank] = (ranks[pair[0]], ranks[pair[1]])
            elif len(token) == 1:
                split[rank] = (rank, rank)
        return cls({rank: token for token, rank in ranks.items()}, split, pattern)


class Encoder:
    MOST_PIECES = 250_000
    MOST_PAIRS = 250_000

    def __init__(self, vocabulary: Vocabulary):
        self.pieces = vocabulary.pieces
        self.split = vocabulary.split
        self.joined = {pair: rank for rank, pair in self.split.items() if pair[0] != rank}
        self.whole = {self.pieces[rank].decode("latin-1"): rank for rank in self.split}
        self.longest = max(map(len, self.whole), default=0)
        self.find = regex.compile(vocabulary.pattern).findall
        self.entries = ahocorasick.Automaton()
        for token, rank in self.whole.items():
            self.entries.add_word(token, rank)
        self.entries.make_automaton()
        self.apart: dict[tuple[int, int], bool] = {}
        self.seen: dict[str, tuple[int, ...]] = {}

    def forget(self) -> None:
        """Drop the memos; the vocabulary stays."""
        self.apart.clear()
        self.seen.clear()

    def _compatible(self, left: int, right: int) -> bool:
        """Whether the merges leave two neighbouring tokens as they are.

        Goes back through the merges of both, the later one first; a merge across the border
        that comes before what was undone so far would have taken place.
        """
        key = (left, right)
        if (known := self.apart.get(key)) is not None:
            return known
        bound = float("inf")
        while True:
            if self.joined.get((left, right), bound) < bound:
                answer = False
                break
            if left > right:
                bound, part = left, self.split[left][1]
                if part != left:
                    left = part
                    continue
                bound, part = right + 1, self.split[right][0]
                if part == right:
                    answer = True
                    break
                right = part
            else:
                bound, part = right + 1, self.split[right][0]
                if part != right:
                    right = part
                    continue
                bound, part = left, self.split[left][1]
                if part == left:
                    answer = True
                    break
                left = part
        if len(self.apart) >= self.MOST_PAIRS:
            self.apart.clear()
        self.apart[key] = answer
        return answer

    def encode_bytes(self, data: bytes) -> list[int]:
        text = data.decode("latin-1")
        whole, reach, longest = self.whole, self.entries.longest_prefix, self.longest
        if (rank := whole.get(text)) is not None:
            return [rank]
        size = len(text)
        tokens: list[int] = []
        back: list[tuple[int, int]] = []  # where each token starts, and its length
        dead: set[int] = set()
        apart, compatible = self.apart, self._compatible
        at, length = 0, reach(text[:longest])
        while at < size:
            while length:
                rank = whole.get(text[at : at + length])
                if rank is not None and at + length not in dead:
                    if not tokens:
                        break
                    pair = (tokens[-1], rank)
                    fits = apart.get(pair)
                    if compatible(*pair) if fits is None else fits:
                        break
                length -= 1
            else:
                dead.add(at)
                if not back:
                    raise ValueError("the vocabulary cannot encode these bytes")
                at, length = back.pop()
                length -= 1  # the next shorter entry there
                tokens.pop()
                continue
            tokens.append(rank)
            back.append((at, length))
            at += length
            length = reach(text[at : at + longest])
        return tokens

    def encode(self, text: str) -> list[int]:
        seen, out = self.seen, []
        for piece in self.find(text):
            ids = seen.get(piece)
            if ids is None:
                ids = tuple(self.encode_bytes(piece.encode()))
                if len(piece) <= 64:
                    if len(seen) >= self.MOST_PIECES:
                        seen.clear()
                    seen[piece] = ids
            out += ids
        return out

    def decode(self, ids) -> bytes:
        return b"".join(map(self.pieces.__getitem__, ids))


_VOCABULARIES: dict[tuple[str, str], Vocabulary] = {}


def vocabulary(path: str, pattern: str) -> Vocabulary:
    """The vocabulary of a rank file on the driver, kept for the next call."""
    key = (path, pattern)
    if key not in _VOCABULARIES:
        _VOCABULARIES[key] = Vocabulary.of(read_ranks(path), pattern)
    return _VOCABULARIES[key]


_WORKER: dict[int, Encoder] = {}


def _encoder(shared) -> Encoder:
    """One encoder per worker process and broadcast."""
    key = shared._jbroadcast_id if hasattr(shared, "_jbroadcast_id") else id(shared.value)
    if key not in _WORKER:
        _WORKER.clear()
        _WORKER[key] = Encoder(shared.value)
    return _WORKER[key]


def _encoded(batches, encoder: Encoder, text: str, ids: str, names: list[str], decoded: str | None = None):
    """Batches with ids, and with the bytes these stand for if ``decoded`` names their column. The
    memos end with the task: the worker lives on, and other stages come on top of what it holds."""
    try:
        yield from _encoded_batches(batches, encoder, text, ids, names, decoded)
    finally:
        encoder.forget()
        release()


def _encoded_batches(batches, encoder: Encoder, text: str, ids: str, names: list[str], decoded: str | None):
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(text)).to_pylist()
        # Some rows at a time: ids of a whole batch of long texts need not be held as objects.
        for start, stop in slices([len(t or "") for t in texts], 1 << 20):
            found = [encoder.encode(t or "") for t in texts[start:stop]]
            rows = batch.slice(start, stop - start)
            arrays = [rows.column(rows.schema.get_field_index(c)) for c in names]
            arrays.append(pa.array(found, pa.list_(pa.int32())))
            if decoded is not None:
                arrays.append(pa.array([encoder.decode(f) for f in found], pa.binary()))
            yield pa.RecordBatch.from_arrays(arrays, [*names, ids, *([decoded] if decoded is not None else [])])


def _decoded(batches, pieces: dict[int, bytes], ids: str, out: str, names: list[str]):
    piece = pieces.__getitem__
    for batch in batches:
        rows = batch.column(batch.schema.get_field_index(ids))
        column = pa.array([b"".join(map(piece, r.as_py() or ())) for r in rows], pa.binary())
        kept = [batch.column(batch.schema.get_field_index(c)) for c in names]
        yield pa.RecordBatch.from_arrays([*kept, column], [*names, out])


def _ids_schema(df: DataFrame, text: str, ids: str, keep_text: bool) -> T.StructType:
    kept = [df.schema[c] for c in df.columns if c != ids and (keep_text or c != text)]
    return T.StructType([*kept, T.StructField(ids, T.ArrayType(T.IntegerType(), False), False)])


def encode(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "ids", keep_text: bool = False) -> DataFrame:
    """``df`` with a column of token ids, without the text unless ``keep_text``."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    schema = _ids_schema(df, text, ids, keep_text)
    names = schema.names[:-1]

    def run(batches):
        from tactile.llm import bpe

        return bpe._encoded(batches, bpe._encoder(shared), text, ids, names)

    return df.mapInArrow(run, schema)


def decode(df: DataFrame, vocab: Vocabulary, ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``df`` with the bytes that the ids stand for."""
    shared = df.sparkSession.sparkContext.broadcast(vocab.pieces)
    names = [c for c in df.columns if c != out]
    schema = T.StructType([*[df.schema[c] for c in names], T.StructField(out, T.BinaryType(), False)])

    def run(batches):
        from tactile.llm import bpe

        return bpe._decoded(batches, shared.value, ids, out, names)

    return df.mapInArrow(run, schema)


def round_trip(df: DataFrame, vocab: Vocabulary, text: str = "text", ids: str = "ids", out: str = "decoded") -> DataFrame:
    """``encode``, then ``decode`` of its ids, by one worker: ids and their bytes for each row."""
    shared = df.sparkSession.sparkContext.broadcast(vocab)
    coded = _ids_schema(df.drop(out), text, ids, False)
    schema = T.StructType([*coded, T.StructField(out, T.BinaryType(), False)])
    names = coded.names[:-1]

    def run(batches):
        from tactile.llm import bpe

        return bpe._encoded(batches, bpe._encoder(shared), text, ids, names, out)

    return df.mapInArrow(run, schema)
