"""Alignment of two tokenizers over the same bytes.

Both tokenizers cut the bytes of a text; a token ends at a byte offset. Offsets at which tokens of
both end cut them into groups. Most groups are one token against one, in long stretches, and inside
a stretch the places of matching tokens differ by a constant shift. So the end arrays are compared
slice against slice at the current shift, each slice twice as long as the one before, then halved
to the exact end of the stretch. What follows is an irregular group: its tokens are walked until
both sides end together again, and the shift moves by what one side had more.

Two tokens are linked if their byte ranges overlap: the one pair of a regular group, and the steps of
the walk through an irregular one. Linked pairs of ids are counted over the corpus, once for each
document. Texts are encoded once; their distinct pairs and times are stored. Pairs in many documents,
at most ``frequent_pairs`` of them, go to the tasks as sorted arrays; the others, none of which is in
more documents than those, are joined. So no key of a join is hot. Highest counts are one row per id
of the first vocabulary.

Results: a null or empty text, and one whose tokens do not give back its bytes (as when the second
vocabulary folds its space mark), has no tokens: zeros and an empty digest. Rows that repeat are
documents each, and each counts. Special tokens are never produced. Rows without ``doc_id`` are
scored like others. An empty table gives no rows. Texts are encoded word by word, cut before single
spaces where no entry of either vocabulary reaches across, and words seen before are not encoded
again; memory follows a slice of texts, or the longest text.
"""

from __future__ import annotations

import hashlib
import json
import os
import re
from array import array
from dataclasses import dataclass
from functools import lru_cache
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from tactile.llm.common import slices, store

SPACE_MARK = "▁"
SLICE_BYTES = 1 << 20
KNOWN_WORDS = 600_000
# Single spaces between other letters: neither vocabulary reaches across, see ``may_cut``.
CUT = re.compile(r"(?<=\S) (?=\S)")
FREQUENT_PAIRS = 300_000
# A piece for one byte.
BYTE_PIECE = re.compile(r"<0x([0-9A-F]{2})>")


@dataclass(frozen=True)
class Tokenizers:
    """Contents of the two vocabulary files, as workers get them."""

    first: str
    second: bytes

    @staticmethod
    def read(first: str, second: str) -> Tokenizers:
        with open(first, encoding="utf-8") as a, open(second, "rb") as b:
            return Tokenizers(a.read(), b.read())


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: visible Latin-1 letters for
    themselves, the others numbered from 256."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def id_texts(first: int, second: int) -> list[bytes]:
    """Ids as decimal text with the mark behind them, for each id of either side: inside a side of a
    group, and at its end."""
    return [b"%d%b" % (i, mark) for n, last in ((first, b"|"), (second, b";")) for i in range(n) for mark in (b",", last)]


class Coders:
    """Both tokenizers with the bytes of their entries."""

    def __init__(self, files: Tokenizers):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import sentencepiece
        from tokenizers import Tokenizer

        self.first = Tokenizer.from_str(files.first)
        self.first.encode_special_tokens = True
        self.second = sentencepiece.SentencePieceProcessor(model_proto=files.second)
        letters = byte_letters()
        vocab = json.loads(files.first)["model"]["vocab"]
        self.bytes_first = {i: bytes(map(letters.__getitem__, entry)) for entry, i in vocab.items()}
        self.bytes_second = {i: self._piece(i) for i in range(self.second.get_piece_size())}
        inner = re.compile(f"[^{SPACE_MARK}]{SPACE_MARK}")
        self.sizes_first, self.sizes_second = (
            np.array([len(t[i]) for i in range(len(t))], np.int64) for t in (self.bytes_first, self.bytes_second)
        )
        self.entries = id_texts(len(self.bytes_first), len(self.bytes_second))
        self.forget()
        self.may_cut = not any(inner.search(self.second.id_to_piece(i)) for i in range(self.second.get_piece_size()))

    def _piece(self, i: int) -> bytes:
        piece = self.second.id_to_piece(i)
        if self.second.is_byte(i):
            return bytes([int(BYTE_PIECE.fullmatch(piece)[1], 16)])
        return piece.replace(SPACE_MARK, " ").encode()

    def words(self, text: str) -> list[str]:
        """A text with a space before it, cut before single spaces, which are left out."""
        first, *rest = CUT.split(" " + text) if self.may_cut else [" " + text]
        return [first[1:], *rest]

    def _learn(self, words: list[str]) -> None:
        """Encode words with a space before each; the second tokenizer puts it there itself."""
        self.place.update(zip(words, range(len(self.place), len(self.place) + len(words)), strict=True))
        first = self.first.encode_batch_fast([" " + w for w in words], add_special_tokens=False)
        raw = [(" " + w).encode() for w in words]
        same = [True] * len(words)
        for side, coded in ((0, [e.ids for e in first]), (1, self.second.encode(words, num_threads=1))):
            entry = (self.bytes_first, self.bytes_second)[side].__getitem__
            flat, ends = self.ids[side], self.ends[side]
            for i, ids in enumerate(coded):
                flat.extend(ids)
                ends.append(len(flat))
                if b"".join(map(entry, ids)) != raw[i]:
                    same[i] = False
        self.same.extend(same)

    def encode(self, texts: list[str]) -> list[tuple | None]:
        """For each text, ids of both and ends of both; None if its bytes do not come back."""
        if not texts:
            return []
        words = [self.words(t) for t in texts]
        if len(self.place) > KNOWN_WORDS or len(self.ids[0]) > 8 * KNOWN_WORDS:
            self.forget()
        self._learn([w for w in dict.fromkeys(chain.from_iterable(words)) if w not in self.place])
        place = np.fromiter(map(self.place.__getitem__, chain.from_iterable(words)), np.int64)
        last = np.cumsum([len(w) for w in words])
        same = np.minimum.reduceat(np.frombuffer(bytes(self.same), np.uint8)[place], last - [len(w) for w in words]).tolist()
        sides = []
        for side, sizes in ((0, self.sizes_first), (1, self.sizes_second)):
            stop = np.frombuffer(self.ends[side], np.int64)
            start, stop = stop[place], stop[place + 1]
            n = np.cumsum(stop - start)
            ids = np.frombuffer(self.ids[side], np.int32)[np.repeat(stop - n, stop - start) + np.arange(n[-1])]
            cuts = [0, *n[last - 1].tolist()]
            sides.append((ids, sizes[ids], cuts))
        out: list[tuple | None] = []
        for k, text in enumerate(texts):
            (a, ends_a), (b, ends_b) = (
                (ids[cuts[k] : cuts[k + 1]], np.cumsum(sizes[cuts[k] : cuts[k + 1]])) for ids, sizes, cuts in sides
            )
            back = bool(same[k])
            if not back:  # words that differ: the whole text decides
                raw = (" " + text).encode()
                back = all(b"".join(map(t.__getitem__, ids.tolist())) == raw for t, ids in ((self.bytes_first, a), (self.bytes_second, b)))
            out.append((a, b, ends_a, ends_b) if back else None)
        return out

    def forget(self) -> None:
        """Of words that were encoded: their number, ids of both, one word after the other, and whether
        both give back their bytes."""
        self.place: dict[str, int] = {}
        self.ids = (array("i"), array("i"))
        self.ends = (array("q", [0]), array("q", [0]))
        self.same = bytearray()


@lru_cache(maxsize=1)
def coders(files: Tokenizers) -> Coders:
    return Coders(files)


def run_length(a: list[int], b: list[int], i: int, j: int) -> int:
    """How many ends from ``a[i]`` and ``b[j]`` on are equal, place by place: slices of doubling
    length, then of halving length. Both lists end with marks that differ."""
    start, width = i, 4
    while a[i : i + width] == b[j : j + width]:
        i, j, width = i + width, j + width, 2 * width
    while width > 4:
        width //= 2
        if a[i : i + width] == b[j : j + width]:
            i, j = i + width, j + width
    while a[i] == b[j]:
        i, j = i + 1, j + 1
    return i - start


def group_ends(a: list[int], b: list[int]) -> list[int]:
    """Offsets at which tokens of both end, from the ends of both up to the same last one."""
    n, found = len(a), []
    a, b = [*a, -1], [*b, -2]
    i = j = 0
    while i < n:
        p, q = a[i], b[j]
        if p == q:
            # At the shift j - i, a stretch of one against one.
            length = run_length(a, b, i, j)
            found += a[i : i + length]
            i, j = i + length, j + length
            continue
        # An irregular group: a step to the token after the one that ends first, until both end.
        while p != q:
            if p < q:
                i += 1
                p = a[i]
            else:
                j += 1
                q = b[j]
        found.append(p)
        i, j = i + 1, j + 1
    return found


def aligned(
    first: np.ndarray, second: np.ndarray, a: np.ndarray, b: np.ndarray, entries: list[bytes], n_first: int
) -> tuple[int, bytes, np.ndarray]:
    """Of two tokenizations (ids, and ends up to the same last one): the number of groups, the groups
    as text, and a key ``id << 32 | id`` for each link. ``entries`` are as in ``id_texts``, ``n_first``
    of them (twice) for the first side."""
    ends = np.array(group_ends(a.tolist(), b.tolist()), np.int64)
    # Each token by its group, the first side's before the second's; the last ones of a side and of a
    # group carry another mark.
    marked, places = [], []
    for side, (ids, stop) in enumerate(((first, a), (second, b))):
        group = np.searchsorted(ends, stop)
        marked.append(2 * (side * n_first + ids.astype(np.int64)) + (ends[group] == stop))
        places.append(2 * group + side)
    order = np.argsort(np.concatenate(places), kind="stable")
    text = b"".join(map(entries.__getitem__, np.concatenate(marked)[order].tolist()))[:-1]
    # Between two neighbouring ends of either side lies the overlap of one token with one.
    overlaps = np.sort(np.concatenate([a, b]), kind="stable")
    overlaps = overlaps[np.append(True, overlaps[1:] != overlaps[:-1])]
    links = (first[np.searchsorted(a, overlaps)].astype(np.int64) << 32) | second[np.searchsorted(b, overlaps)]
    return len(ends), text, links


LINKED = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"
NONE = (0, 0, 0, 0, "", np.zeros(0, np.int64), np.zeros(0, np.int32))


def link_rows(texts: list[str | None], coder: Coders) -> list[tuple]:
    """A row of ``LINKED`` for each text."""
    given = [i for i, t in enumerate(texts) if t]
    rows: list[tuple] = [NONE] * len(texts)
    for i, coded in zip(given, coder.encode([texts[i] for i in given]), strict=True):
        if coded is None:
            continue
        a, b = coded[:2]
        n_groups, text, links = aligned(*coded, coder.entries, len(coder.bytes_first))
        pairs, times = np.unique(links, return_counts=True)
        digest = hashlib.sha256(text).hexdigest()
        rows[i] = (len(a), len(b), n_groups, len(links), digest, pairs, times.astype(np.int32))
    return rows


def linked(docs: DataFrame, files: Tokenizers, keep: list[str], text: str = "text") -> DataFrame:
    """``_row``, ``keep``, then ``LINKED`` for each row; stored."""
    shared = docs.sparkSession.sparkContext.broadcast(files)
    names = [part.split()[0] for part in LINKED.split(", ")]
    kinds = [pa.int64()] * 4 + [pa.string(), pa.list_(pa.int64()), pa.list_(pa.int32())]

    def run(batches):
        from tactile.llm.align import SLICE_BYTES, coders, link_rows

        coder = coders(shared.value)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index("_text"))
            sizes = [len(t) if t else 0 for t in column.to_pylist()]
            for a, b in slices(sizes, SLICE_BYTES):
                found = link_rows(column.slice(a, b - a).to_pylist(), coder)
                own = batch.slice(a, b - a)
                arrays = [own.column(own.schema.get_field_index(c)) for c in ("_row", *keep)]
                arrays += [pa.array(list(values), kind) for values, kind in zip(zip(*found, strict=True), kinds, strict=True)]
                yield pa.RecordBatch.from_arrays(arrays, ["_row", *keep, *names])

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).alias("_text"))
    kept = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return store(rows.mapInArrow(run, f"_row long, {kept}, {LINKED}"), "linked")


def pair_counts(rows: DataFrame) -> DataFrame:
    """``pair, n, best``: in how many documents a pair is linked, and whether that is the most of all
    pairs with its first id; stored."""
    counts = store(rows.select(F.explode("pairs").alias("pair")).groupBy("pair").agg(F.count(F.lit(1)).alias("n")), "pairs")
    first = F.shiftright("pair", 32)
    # One row per entry of the first vocabulary at most.
    most = store(counts.groupBy(first.alias("first")).agg(F.max("n").alias("most")), "most")
    best = counts.withColumn("first", first).join(F.broadcast(most), "first")
    return store(best.select("pair", "n", (F.col("n") == F.col("most")).alias("best")), "counts")


def _frequent_from(counts: DataFrame, most: int) -> int:
    """Smallest power of two from which on the pairs are few enough to be sent."""
    by_size = counts.groupBy(F.floor(F.log2("n")).cast("int").alias("p")).agg(F.count(F.lit(1)).alias("pairs")).collect()
    pairs, power = 0, 62
    for row in sorted(by_size, key=lambda r: -r["p"]):
        if pairs + row["pairs"] > most:
            break
        pairs, power = pairs + row["pairs"], row["p"]
    return 1 << power


def scores(rows: DataFrame, counts: DataFrame, keep: list[str], frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """``keep``, then ``n_best, count_sum``, of each row of ``linked``."""
    bound = _frequent_from(counts, frequent_pairs)
    table = counts.where(F.col("n") >= bound).toArrow().sort_by("pair")
    arrays = [table.column(c).to_numpy() for c in ("pair", "n", "best")]
    shared = rows.sparkSession.sparkContext.broadcast(arrays)
    kept_kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in keep)

    def run(batches):
        known, n, best = shared.value

        def totals(values, offsets):
            sums = np.concatenate([[0], np.cumsum(values)])
            return pa.array(sums[offsets[1:]] - sums[offsets[:-1]], pa.int64())

        for batch in batches:
            pairs, times = (batch.column(batch.schema.get_field_index(c)) for c in ("pairs", "times"))
            offsets = pairs.offsets.to_numpy() - pairs.offsets[0].as_py()
            keys, often = pairs.flatten().to_numpy(), times.flatten().to_numpy().astype(np.int64)
            at = np.minimum(np.searchsorted(known, keys), max(0, len(known) - 1))
            hit = known[at] == keys if len(known) else np.zeros(len(keys), bool)
            at = at[hit]
            n_best, count_sum = np.zeros(len(keys), np.int64), np.zeros(len(keys), np.int64)
            n_best[hit], count_sum[hit] = best[at] * often[hit], n[at] * often[hit]
            cuts = pa.array(np.concatenate([[0], np.cumsum(~hit)])[offsets], pa.int32())
            rest = [pa.ListArray.from_arrays(cuts, pa.array(x[~hit])) for x in (keys, often)]
            own = [batch.column(batch.schema.get_field_index(c)) for c in ("_row", *keep)]
            yield pa.RecordBatch.from_arrays(
                [*own, totals(n_best, offsets), totals(count_sum, offsets), *rest],
                ["_row", *keep, "n_best", "count_sum", "rare", "often"],
            )

    schema = f"_row long, {kept_kinds}, n_best long, count_sum long, rare array<long>, often array<long>"
    some = store(rows.select("_row", *keep, "pairs", "times").mapInArrow(run, schema), "scored")
    rare = some.select("_row", F.explode(F.arrays_zip("rare", "often")).alias("z")).select(
        "_row", F.col("z.rare").alias("pair"), F.col("z.often").alias("often")
    )
    more = rare.join(counts.where(F.col("n") < bound), "pair").groupBy("_row").agg(
        F.sum(F.when(F.col("best"), F.col("often")).otherwise(0)).alias("more_best"),
        F.sum(F.col("often") * F.col("n")).alias("more_sum"),
    )
    return some.drop("rare", "often").join(more, "_row", "left").select(
        *keep,
        (F.col("n_best") + F.coalesce("more_best", F.lit(0))).alias("n_best"),
        (F.col("count_sum") + F.coalesce("more_sum", F.lit(0))).alias("count_sum"),
    )


def align(docs: DataFrame, files: Tokenizers, doc_id: str = "doc_id", text: str = "text", frequent_pairs: int = FREQUENT_PAIRS) -> DataFrame:
    """``doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256`` for each row."""
    rows = linked(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), files, ["doc_id"])
    own = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]
    return scores(rows, pair_counts(rows), own, frequent_pairs)
