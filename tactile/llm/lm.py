"""Language-model scores from a log-frequency Bloom filter.

N-grams of up to ``order`` tokens are counted over all training texts. A count is quantised to a
level of a codebook that grows by ``growth``; the filter holds an n-gram once for each level up to
its own, so probing level after level until the first miss gives the quantised count, never too
small a one. Smoothed probabilities come from those probes alone:

    p(w) = (c(w) + 0.1) / (N + 0.1 (V + 1)),    p(w | h) = (c(hw) + m p(w | h')) / (c(h) + m)

The filter is built in segments by hash, each by one task from compact blocks of counted hashes.
A segment has ``bits_per_entry`` bits for each level of each n-gram it holds, whatever the corpus,
so false positives are as frequent for any number of tokens (with b bits an entry and k probes
about (1 - exp(-k/b))^k a level) and the filter grows with the corpus. Runs of segments are written
as files of about ``max_bytes``, each by a task of its own, and go to the workers
(``SparkContext.addFile``): a machine fetches them once, and its Python workers map them into
memory together. Mapped pages can be dropped at any time; a machine needs the disk for the filter,
and is faster if it has free memory for it.

The base score takes exact counts. Words that are frequent, at most ``frequent_words`` of them, go
to the workers; the counts of the others are joined. A word of more than ``LONG_WORD`` bytes is
counted by its SHA-256, so what is sent, kept and joined has a bound in bytes.

Results: a null or blank text is one end token. Rows without ``doc_id`` belong to the rows whose
remainder is 0. Without training rows N and V are 0, and every base score is 0. Repeated rows are
scored each. Texts of any length are scored whole; memory follows a slice of texts, or the longest.
"""

from __future__ import annotations

import hashlib
import math
import uuid
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyarrow import fs
from pyspark import SparkFiles
from pyspark.sql import DataFrame, functions as F, types as T

from tactile.llm.common import store, text_slices
from tactile.session import new_folder

END = b"\n"  # white space is in no word
SEGMENT_BYTES = 8 << 20
MOST_SEGMENTS = 1 << 16
ENTRIES_PER_BLOCK = 3 << 20
LONG_WORD = 64
# Words that a scoring task keeps, at most, before those of the next slice of texts.
KNOWN_WORDS = 200_000
KNOWN_BYTES = 16 << 20
END_HASH = np.uint64(xxhash.xxh64_intdigest(END))


@dataclass(frozen=True)
class Lm:
    order: int = 2
    add: float = 0.1
    mass: float = 20.0
    growth: float = 1.2
    probes: int = 5
    bits_per_entry: float = 9.0
    max_bytes: int = 256 << 20
    frequent_words: int = 200_000


DEFAULT = Lm()


def codebook(growth: float, top: int = 1 << 62) -> np.ndarray:
    """Smallest count of each level, from 1."""
    levels, x = [1], 1.0
    while levels[-1] < top:
        x = max(x * growth, levels[-1] + 1.0)
        levels.append(int(x))
    return np.array(levels, np.int64)


def middles(levels: np.ndarray) -> np.ndarray:
    """The count a level stands for; index 0 is no level."""
    upper = np.append(levels[1:] - 1, levels[-1]).astype(float)
    return np.concatenate([[0.0], np.sqrt(levels * np.maximum(levels, upper))])


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    x = x ^ (x >> np.uint64(32))
    x = x * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Hashes(dict):
    """Word hashes, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        if len(word) <= LONG_WORD:
            if len(self) >= 200_000:
                self.clear()
            self[word] = value
        return value


def tokens(text: bytes | None) -> list[bytes]:
    return [*(text.lower().split() if text else ()), END]


def short(words: list[bytes]) -> list[bytes]:
    """Words as they are counted: a long one by its digest, after white space as in no word."""
    if max(map(len, words), default=0) <= LONG_WORD:
        return words
    return [w if len(w) <= LONG_WORD else END + hashlib.sha256(w).digest() for w in words]


def ngrams(hashes: np.ndarray, starts: np.ndarray, order: int) -> list[np.ndarray]:
    """For n = 1 to ``order``, the hash of the n-gram that ends at each token. Texts follow each
    other; what is before the first token of a text is ends."""
    place = np.arange(len(hashes)) - starts
    out = [mix(hashes)]
    for n in range(2, order + 1):
        before = np.empty_like(hashes)
        before[n - 1 :] = hashes[: len(hashes) - n + 1]
        before[: n - 1] = END_HASH
        before[place < n - 1] = END_HASH
        out.append(mix(out[-1] + before * np.uint64(2 * n + 1)))
    return out


def _flat(texts: list[bytes | None], known: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Token hashes of texts, the start of each token's text, tokens per text."""
    rows = [tokens(t) for t in texts]
    lengths = np.array([len(r) for r in rows], np.int64)
    hashes = np.concatenate([np.fromiter(map(known.__getitem__, r), np.uint64, len(r)) for r in rows])
    starts = np.repeat(np.cumsum(lengths) - lengths, lengths)
    return hashes, starts, lengths


def word_counts(texts: DataFrame) -> DataFrame:
    """``word, n`` over the binary column ``text``, words as in ``short``; the end token is counted too."""

    def run(batches):
        from collections import Counter

        from tactile.llm.common import release
        from tactile.llm.lm import short, tokens

        def rows(counts):
            return pa.RecordBatch.from_pydict({"word": pa.array(list(counts), pa.binary()), "n": pa.array(list(counts.values()), pa.int64())})

        counts: Counter = Counter()
        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                for text in part.to_pylist():
                    counts.update(short(tokens(text)))
                if len(counts) > 500_000:
                    yield rows(counts)
                    counts = Counter()
        yield rows(counts)
        counts.clear()
        release()

    return texts.select("text").mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def ngram_blocks(texts: DataFrame, how: Lm, n_segments: int) -> DataFrame:
    """``segment, keys, counts``: counted n-gram hashes of a few texts, as sorted blocks."""

    def run(batches):
        from tactile.llm.common import release
        from tactile.llm.lm import ENTRIES_PER_BLOCK, Hashes, _flat, ngrams, segment_of

        known = Hashes()
        held: list[np.ndarray] = []

        def rows():
            keys = np.concatenate(held)
            held.clear()
            keys, counts = np.unique(keys, return_counts=True)
            counts = counts.astype(np.uint32)
            # Sorted keys are sorted by segment.
            cuts = np.searchsorted(segment_of(keys, n_segments), np.arange(n_segments + 1))
            used = [s for s in range(n_segments) if cuts[s] < cuts[s + 1]]
            return pa.RecordBatch.from_pydict(
                {
                    "segment": pa.array(used, pa.int32()),
                    "keys": pa.array([keys[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()),
                    "counts": pa.array([counts[cuts[s] : cuts[s + 1]].tobytes() for s in used], pa.binary()),
                }
            )

        for batch in batches:
            for _, part in text_slices(batch.column(0)):
                hashes, starts, _ = _flat(part.to_pylist(), known)
                held += ngrams(hashes, starts, how.order)
                if sum(map(len, held)) > ENTRIES_PER_BLOCK:
                    yield rows()
        if held:
            yield rows()
        known.clear()
        release()

    return texts.select("text").mapInArrow(run, "segment int, keys binary, counts binary")


def segment_of(keys: np.ndarray, n_segments: int) -> np.ndarray:
    """The leading bits of the keys; ``n_segments`` is a power of two."""
    return (keys >> np.uint64(65 - n_segments.bit_length())).astype(np.int32)


def steps(keys: np.ndarray) -> np.ndarray:
    """By how much a key moves from one probe to the next."""
    return mix(keys ^ np.uint64(0xA5A5A5A5A5A5A5A5)) | np.uint64(1)


def positions(keys: np.ndarray, step: np.ndarray, level: int, how: Lm, probe: int, sizes: np.ndarray) -> np.ndarray:
    """Bit of a segment of ``sizes`` (unsigned) bits for each key at a level."""
    return (mix(keys + step * np.uint64(level * how.probes + probe + 1)) % sizes).astype(np.int64)


def build(blocks: DataFrame, how: Lm) -> DataFrame:
    """``segment, size, bits``: the slices of the filter, one task each."""

    def one(table: pa.Table) -> pa.Table:
        from tactile.llm.common import release
        from tactile.llm.lm import codebook, positions, steps

        keys = np.concatenate([np.frombuffer(b, np.uint64) for b in table.column("keys").to_pylist()])
        counts = np.concatenate([np.frombuffer(b, np.uint32) for b in table.column("counts").to_pylist()])
        order = np.argsort(keys, kind="stable")
        keys, counts = keys[order], counts[order].astype(np.int64)
        first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
        keys, counts = keys[first], np.add.reduceat(counts, first)
        level = np.searchsorted(codebook(how.growth), counts, side="right")
        entries = int(level.sum())
        size = max(64, int(entries * how.bits_per_entry) + 63 & ~63)
        bits = np.zeros(size, bool)
        step = steps(keys)
        for j in range(int(level.max())):
            alive = level > j
            keys, step, level = keys[alive], step[alive], level[alive]
            for i in range(how.probes):
                bits[positions(keys, step, j, how, i, np.uint64(size))] = True
        packed = np.packbits(bits, bitorder="little").tobytes()
        del bits, keys, step, level, counts, first, order
        release()
        return pa.table({"segment": table.column("segment")[:1], "size": pa.array([len(packed)], pa.int64()), "bits": pa.array([packed], pa.binary())})

    return blocks.groupBy("segment").applyInArrow(one, "segment int, size long, bits binary")


def share(slices_of: DataFrame, n_segments: int, how: Lm) -> Filter:
    """Join the slices to files in the shared folder and send them to all machines."""
    spark = slices_of.sparkSession
    folder = new_folder(spark, "filter")
    kind = pa.schema([("file", pa.int32()), ("name", pa.string()), ("segment", pa.int32()), ("size", pa.int64())])

    def run(batches):
        store_fs, base = fs.FileSystem.from_uri(folder)
        store_fs.create_dir(base, recursive=True)
        file, name, out = None, "", None
        try:
            for batch in batches:
                rows = []
                for own, segment, bits in zip(*batch.columns, strict=True):
                    if own.as_py() != file:
                        if out is not None:
                            out.close()
                        file, name = own.as_py(), f"{uuid.uuid4().hex}.bits"
                        out = store_fs.open_output_stream(f"{base}/{name}", compression=None)
                    data = bits.as_buffer()
                    out.write(data)
                    rows.append({"file": file, "name": name, "segment": segment.as_py(), "size": data.size})
                yield pa.RecordBatch.from_pylist(rows, kind)
        finally:
            if out is not None:
                out.close()

    size = slices_of.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
    n_files = min(n_segments, max(1, math.ceil(size / how.max_bytes)))
    # Segments are by hash, so runs of as many segments are about as large.
    per_file = math.ceil(n_segments / n_files)
    n_files = math.ceil(n_segments / per_file)
    files = slices_of.withColumn("file", F.floor(F.col("segment") / per_file).cast("int"))
    # One file: read in order by one task, without dealing the slices out again.
    ordered = files.orderBy("segment").coalesce(1) if n_files == 1 else files.repartition(n_files, "file").sortWithinPartitions("segment")
    written = ordered.select("file", "segment", "bits").mapInArrow(run, "file int, name string, segment int, size long")
    sizes = np.zeros(n_segments, np.int64)
    names: list[str | None] = [None] * n_files
    for row in store(written, "slices").collect():
        sizes[row["segment"]] = row["size"]
        names[row["file"]] = row["name"]
    for name in names:
        if name is not None:
            spark.sparkContext.addFile(f"{folder}/{name}")
    return Filter(names, 8 * sizes, per_file, how)


class Filter:
    """The filter as workers see it. ``names`` are its files, of ``per_file`` segments each, None for
    one that holds nothing; ``sizes`` the bits of each segment."""

    def __init__(self, names: list[str | None], sizes: np.ndarray, per_file: int, how: Lm):
        self.names, self.sizes, self.per_file, self.how = names, sizes, per_file, how
        self.n_segments = len(sizes)
        ends = np.cumsum(sizes)
        first = np.arange(len(sizes)) // per_file * per_file
        self.offsets = ends - sizes - (ends - sizes)[first]  # in the segment's file
        self._bits: dict[int, np.ndarray] = {}

    def bits(self, file: int) -> np.ndarray:
        if file not in self._bits:
            self._bits[file] = np.memmap(SparkFiles.get(self.names[file]), np.uint8, mode="r")
        return self._bits[file]

    def levels(self, keys: np.ndarray, most: int) -> np.ndarray:
        """The quantised count of each key, by probes from the first level up."""
        found = np.zeros(len(keys), np.int64)
        segment = segment_of(keys, self.n_segments)
        file_of = segment // self.per_file
        order = np.argsort(file_of, kind="stable")
        cuts = np.searchsorted(file_of[order], np.arange(len(self.names) + 1))
        for file in np.flatnonzero(np.diff(cuts)):
            if self.names[file] is None:
                continue
            alive = order[cuts[file] : cuts[file + 1]]
            bits = self.bits(file)
            held = (keys[alive], steps(keys[alive]), self.sizes[segment[alive]].astype(np.uint64), self.offsets[segment[alive]])
            some = held[2] > 0
            for level in range(most):
                # A key that misses a probe is not probed again.
                for i in range(self.how.probes):
                    if not some.all():
                        alive, held = alive[some], tuple(x[some] for x in held)
                    own, step, sizes, offsets = held
                    bit = offsets + positions(own, step, level, self.how, i, sizes)
                    some = (bits[bit >> 3] >> (bit & 7).astype(np.uint8)) & 1 == 1
                found[alive[some]] += 1
                if not some.any():
                    break
        return found


class Known(dict):
    """Words of the texts of a task by number, with what scoring needs of each: hash, quantised count,
    and log10 of the exact count if the word is frequent (else not a number)."""

    def __init__(self, bloom: Filter, frequent: dict[bytes, float], count_of: np.ndarray):
        self.bloom, self.frequent, self.count_of = bloom, frequent, count_of
        self.forget()

    def forget(self) -> None:
        self.clear()
        self.size = 0
        self.hashes, self.counts, self.logs = np.zeros(0, np.uint64), np.zeros(0), np.zeros(0)

    def learn(self, rows: list[list[bytes]]) -> None:
        """Take in the words of ``rows``; those of earlier rows may be forgotten for it."""
        if len(self) > KNOWN_WORDS or self.size > KNOWN_BYTES:
            self.forget()
        fresh = [w for w in dict.fromkeys(chain.from_iterable(rows)) if w not in self]
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, fresh), np.uint64, len(fresh))
        counts = self.count_of[self.bloom.levels(mix(hashes), len(self.count_of) - 1)]
        logs = np.fromiter((self.frequent.get(w, math.nan) for w in short(fresh)), float, len(fresh))
        self.size += sum(map(len, fresh))
        self.update(zip(fresh, range(len(self), len(self) + len(fresh)), strict=True))
        self.hashes, self.counts, self.logs = (
            np.concatenate(x) for x in ((self.hashes, hashes), (self.counts, counts), (self.logs, logs))
        )


@dataclass
class Model:
    """What scoring needs of a corpus: the filter, N, V, and exact counts: of frequent words in
    memory, of all as a table."""

    how: Lm
    filter: Filter
    total: int
    distinct: int
    frequent: pa.Table
    counts: DataFrame
    frequent_from: int

    @property
    def mass_of_all(self) -> float:
        return self.total + self.how.add * (self.distinct + 1)


def train(docs: DataFrame, how: Lm = DEFAULT, text: str = "text") -> Model:
    """Count ``docs`` and build the filter."""
    texts = docs.select(F.col(text).cast("binary").alias("text"))
    counts = store(word_counts(texts), "counts")
    total, distinct = counts.agg(F.coalesce(F.sum("n"), F.lit(0)), F.count(F.lit(1))).first()
    size = docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]
    n_segments = min(MOST_SEGMENTS, 1 << max(3, math.ceil(math.log2(max(1, size) / SEGMENT_BYTES + 1))))
    built = share(store(build(ngram_blocks(texts, how, n_segments), how), "bits"), n_segments, how)

    # Smallest power of two from which on the words are few enough to be sent.
    by_size = counts.groupBy(F.floor(F.log2("n")).alias("p")).agg(F.count(F.lit(1)).alias("words")).collect()
    words, power = 0, 64
    for row in sorted(by_size, key=lambda r: -r["p"]):
        if words + row["words"] > how.frequent_words:
            break
        words, power = words + row["words"], row["p"]
    bound = 1 << power if power < 63 else (1 << 63) - 1
    frequent = counts.where(F.col("n") >= bound).select("word", "n").toArrow()
    return Model(how, built, total, distinct, frequent, counts, bound)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """``keep``, then ``n_tokens, n_known, base_score, score`` for each row of ``docs``."""
    how = model.how
    shared = docs.sparkSession.sparkContext.broadcast((model.filter, model.frequent))
    total, everything = model.total, model.mass_of_all

    def run(batches):
        from tactile.llm.common import release
        from tactile.llm.lm import Known, codebook, middles, ngrams, short, tokens

        bloom, words = shared.value
        logs = np.log10(words.column(1).to_numpy() + how.add).tolist()
        book = codebook(how.growth, max(2, total))
        count_of = middles(book)
        known = Known(bloom, dict(zip(words.column(0).to_pylist(), logs, strict=True)), count_of)
        # Before a text are ends.
        ends = ngrams(np.full(1, END_HASH, np.uint64), np.zeros(1, np.int64), how.order)
        before = [count_of[bloom.levels(keys, len(book))][0] for keys in ends]
        for batch in batches:
            for start, part in text_slices(batch.column(batch.schema.get_field_index("_text"))):
                rows = [tokens(t) for t in part.to_pylist()]
                known.learn(rows)
                lengths = np.array([len(r) for r in rows], np.int64)
                firsts = np.cumsum(lengths) - lengths
                place = np.fromiter(map(known.__getitem__, chain.from_iterable(rows)), np.int64, lengths.sum())
                grams = ngrams(known.hashes[place], np.repeat(firsts, lengths), how.order)
                counts = [known.counts[place]]
                for keys in grams[1:]:
                    distinct, inverse = np.unique(keys, return_inverse=True)
                    counts.append(count_of[bloom.levels(distinct, len(book))][inverse])
                p = (counts[0] + how.add) / everything if total else np.ones(len(place))
                for n in range(1, how.order):
                    # The history of a token is the n-gram that ends at the token before.
                    history = np.empty(len(place))
                    history[1:] = counts[n - 1][:-1]
                    history[firsts] = before[n - 1]
                    p = (np.minimum(counts[n], history) + how.mass * p) / (history + how.mass)
                scores = np.add.reduceat(np.minimum(0.0, np.log10(p)), firsts)
                terms = known.logs[place]
                other = np.isnan(terms)
                base = np.add.reduceat(np.where(other, 0.0, terms), firsts)
                n_frequent = lengths - np.add.reduceat(other.astype(np.int64), firsts)
                # Row and place of the words that are not frequent.
                left = np.flatnonzero(other)
                rare: list[list[bytes]] = [[] for _ in rows]
                for k, at in zip(np.searchsorted(firsts, left, side="right").tolist(), left.tolist(), strict=True):
                    rare[k - 1].append(rows[k - 1][at - firsts[k - 1]])
                rare = [short(r) for r in rare]
                own = batch.slice(start, len(part))
                kept = [own.column(own.schema.get_field_index(c)) for c in ("_row", *keep)]
                arrays = [pa.array(lengths), pa.array(n_frequent), pa.array(base), pa.array(scores), pa.array(rare, pa.list_(pa.binary()))]
                yield pa.RecordBatch.from_arrays([*kept, *arrays], ["_row", *keep, "n_tokens", "n_known", "base", "score", "rare"])
        known.forget()
        release()

    rows = docs.select(F.monotonically_increasing_id().alias("_row"), *keep, F.col(text).cast("binary").alias("_text"))
    kinds = {"n_tokens": "long", "n_known": "long", "base": "double", "score": "double", "rare": "array<binary>"}
    schema = T.StructType(
        [T.StructField("_row", T.LongType()), *[docs.schema[c] for c in keep]]
        + [T.StructField(name, T.DataType.fromDDL(kind)) for name, kind in kinds.items()]
    )
    scored = store(rows.mapInArrow(run, schema), "scored")

    rare = scored.select("_row", F.explode("rare").alias("word")).groupBy("_row", "word").agg(F.count(F.lit(1)).alias("times"))
    other = model.counts.where(F.col("n") < model.frequent_from).select("word", "n")
    rare = rare.join(other, "word", "left").select(
        "_row",
        F.when(F.col("n").isNotNull(), F.col("times")).otherwise(0).alias("more_known"),
        (F.col("times") * F.log10(F.coalesce("n", F.lit(0)) + how.add)).alias("more"),
    )
    rare = rare.groupBy("_row").agg(F.sum("more_known").alias("more_known"), F.sum("more").alias("more"))
    out = scored.drop("rare").join(rare, "_row", "left")
    return out.select(
        *keep,
        "n_tokens",
        (F.col("n_known") + F.coalesce("more_known", F.lit(0))).alias("n_known"),
        (F.col("base") + F.coalesce("more", F.lit(0.0)) - F.col("n_tokens") * math.log10(everything)).alias("base_score"),
        "score",
    )
