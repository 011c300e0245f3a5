"""Near-duplicate documents by bottom-k sketches.

The shingles of a text are hashed by one function; a document's set is the distinct hashes, its
sketch the ``k`` smallest of them. Inverted lists of the retained values bring documents together
that share some; the sketch of a union (the ``k`` smallest of both sketches) estimates their
similarity; the full sets decide.

How hot lists stay harmless without losing a link:

- Documents with equal sets are one node. Links are sought between nodes.
- In a sketch, values are taken from rare to frequent, and only a prefix is listed: a pair similar
  enough shares a listed value whatever the order is (small sets: by counting; large ones: but for
  the chance at ``LEAST_SHARE``). A passage that many documents repeat comes last in the order and is listed only for
  documents that consist of it.
- In each list every node is first compared with the smallest node of its list, the head. Near
  copies of one text end up in one component that way, by one link each. After that only pairs of
  different components are compared: all of them, so components are complete. Lists with the same
  head are taken together, as near copies share most of their lists. Large groups are compared in
  blocks inside tasks, where a link makes one component of two and all their pairs needless: what
  leaves a task is at most a link per node.

Results: a document without words (or with a null text) has the empty set and links with nothing;
with fewer words than a shingle the whole sequence is its one shingle. Rows without ``doc_id``
cannot name a component: ``component_id`` is null, ``kept`` true. Repeated rows are in one
component and all have its smallest ``doc_id``. Texts of any length are hashed whole.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.llm.common import free_name, small, store, text_slices
from tactile.llm.components import components

MASK = (1 << 64) - 1
SHORT = 0x9E3779B97F4A7C15
GROUP_ROWS = 64
BLOCK_ROWS = 512
# A pair at the threshold shares at least this part of its sketch, but for a chance of 6e-10 (the
# binomial tail of 24 or less of 64 at 0.75, below which neither lists nor the estimate may fall).
LEAST_SHARE = 3 / 8


@dataclass(frozen=True)
class Near:
    words: int = 5
    k: int = 64
    numerator: int = 75  # similarity of 75 of 100
    group_rows: int = GROUP_ROWS  # up to this size, pairs of a group are listed
    block_rows: int = BLOCK_ROWS


DEFAULT = Near()


class _Hashes(dict):
    """Word hashes, kept for words seen before."""

    def __missing__(self, word: bytes) -> int:
        value = xxhash.xxh64_intdigest(word)
        # Long words are rare, and would make the memory follow their bytes.
        if len(word) <= 32:
            if len(self) >= 100_000:
                self.clear()
            self[word] = value
        return value


_HASHES = _Hashes()


def _finish(h: np.ndarray) -> np.ndarray:
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def shingle_sets(texts: list[bytes | None], words: int) -> list[np.ndarray]:
    """The sorted distinct shingle hashes of each text."""
    out = []
    for text in texts:
        found = text.lower().split() if text else []
        if not found:
            out.append(np.zeros(0, np.uint64))
        elif len(found) < words:
            out.append(np.array([xxhash.xxh64_intdigest(b" ".join(found)) ^ SHORT], np.uint64))
        else:
            h = np.fromiter(map(_HASHES.__getitem__, found), np.uint64, len(found))
            n = len(h) - words + 1
            mixed = np.zeros(n, np.uint64)
            for i in range(words):
                mixed = (mixed + h[i : i + n]) * np.uint64(0x9FB21C651E98DF25)
                mixed ^= mixed >> np.uint64(29)
            out.append(np.unique(_finish(mixed)))
    return out


def digest(hashes: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(hashes.tobytes())


def similar(a: np.ndarray, b: np.ndarray, numerator: int) -> bool:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return 100 * both >= numerator * (len(a) + len(b) - both)


def union_estimate(a: np.ndarray, b: np.ndarray, k: int) -> float:
    """Similarity from the sketch of the union; exact when both sketches hold whole sets and the
    union has at most ``k`` values."""
    union = np.union1d(a, b)[:k]
    both = np.intersect1d(a, b, assume_unique=True)
    return len(np.intersect1d(union, both, assume_unique=True)) / max(1, len(union))


def sketches(docs: DataFrame, how: Near, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n, node, sketch`` of each row; ``node`` identifies the set."""
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.xxhash64(text).alias("text_key"),
        F.col(text).cast("binary").alias("text"),
    )

    def run(batches):
        from tactile.llm.common import release
        from tactile.llm.neardup import digest, shingle_sets

        for batch in batches:
            for start, texts in text_slices(batch.column(2)):
                sets = shingle_sets(texts.to_pylist(), how.words)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(start, len(sets)),
                        batch.column(1).slice(start, len(sets)),
                        pa.array([len(s) for s in sets], pa.int64()),
                        pa.array([digest(s) if len(s) else None for s in sets], pa.binary()),
                        pa.array([s[: how.k].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["doc_id", "text_key", "n", "node", "sketch"],
                )
        release()

    return rows.mapInArrow(run, "doc_id long, text_key long, n long, node binary, sketch array<long>")


def _prefix_length(n: Column, how: Near) -> Column:
    """How many values, rare ones first, must be listed so that no link is missed."""
    m = F.least(n, F.lit(how.k))
    exact = n - F.ceil(n * how.numerator / 100) + 1
    return F.when(n * 100 <= how.k * how.numerator, exact).otherwise(m - F.floor(m * LEAST_SHARE) + 1)


def _alike(a: str, b: str, how: Near) -> Column:
    """Set sizes that allow a link."""
    return (F.col(a) * 100 >= F.col(b) * how.numerator) & (F.col(b) * 100 >= F.col(a) * how.numerator)


def listed(nodes: DataFrame, how: Near) -> DataFrame:
    """``value, nid, n``: the inverted lists with at least two members."""
    entries = nodes.select("nid", "n", F.explode("sketch").alias("value"))
    shared = store(entries.groupBy("value").agg(F.count(F.lit(1)).alias("df")).where("df > 1"), "frequencies")
    rows = entries.join(shared, "value")
    of_node = Window.partitionBy("nid")
    single = F.least(F.col("n"), F.lit(how.k)) - F.count(F.lit(1)).over(of_node)
    rank = F.row_number().over(of_node.orderBy("df", "value"))
    rows = rows.withColumn("place", single + rank).where(F.col("place") <= _prefix_length(F.col("n"), how))
    return rows.select("value", "nid", "n")


def _estimated(pairs: DataFrame, nodes: DataFrame, how: Near) -> DataFrame:
    """The pairs whose union sketch allows a link."""
    side = nodes.select("nid", "sketch")
    rows = pairs.select("a", "b")
    for end in ("a", "b"):
        own = side.select(F.col("nid").alias(end), F.col("sketch").alias(f"sketch_{end}"))
        rows = rows.join(own, end)
    slack = LEAST_SHARE

    def run(batches):
        from tactile.llm.neardup import union_estimate

        for batch in batches:
            a, b = (batch.column(batch.schema.get_field_index(f"sketch_{end}")) for end in "ab")
            keep = [
                union_estimate(x.values.to_numpy().view(np.uint64), y.values.to_numpy().view(np.uint64), how.k) >= slack
                for x, y in zip(a, b, strict=True)
            ]
            ends = [batch.column(batch.schema.get_field_index(end)) for end in "ab"]
            yield pa.RecordBatch.from_arrays(ends, ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return rows.mapInArrow(run, "a long, b long")


def _texts(nids: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``nid, node, text`` of the column ``nid``; stored. A repeated ``doc_id`` may bring other
    texts along, which ``own_set`` tells by ``node``."""
    needed = store(nids.distinct().join(nodes, "nid").select("nid", "node", F.col("rep").alias("doc_id")), "needed")
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return store(whole.join(small(needed, needed.count()), "doc_id").select("nid", "node", "text"), "texts")


def own_set(text: bytes, node: bytes, words: int) -> np.ndarray | None:
    """The set of a text, None if it is not that of the node."""
    hashes = shingle_sets([text], words)[0]
    return hashes if digest(hashes) == node else None


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: Near, doc_id: str, text: str) -> DataFrame:
    """Of ``pairs`` (``a, b`` of ``nid``), those whose full sets are similar enough; stored."""
    pairs = store(_estimated(pairs, nodes, how), "candidates")
    ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid")))
    texts = _texts(ends, nodes, docs, doc_id, text)
    rows = pairs
    for end in ("a", "b"):
        own = texts.select(*[F.col(c).alias(f"{c}_{end}") for c in ("nid", "node", "text")])
        rows = rows.join(own, F.col(end) == F.col(f"nid_{end}")).drop(f"nid_{end}")

    def run(batches):
        from tactile.llm import neardup

        kept_set = lru_cache(maxsize=64)(lambda text, node: neardup.own_set(text, node, how.words))
        for batch in batches:
            column = {c: batch.column(batch.schema.get_field_index(c)) for c in batch.schema.names}
            keep = []
            for i in range(batch.num_rows):
                x, y = (kept_set(column[f"text_{end}"][i].as_py(), column[f"node_{end}"][i].as_py()) for end in "ab")
                keep.append(x is not None and y is not None and neardup.similar(x, y, how.numerator))
            rows = pa.RecordBatch.from_arrays([column["a"], column["b"]], ["a", "b"])
            yield rows.filter(pa.array(keep, pa.bool_()))

    return store(rows.mapInArrow(run, "a long, b long").distinct(), "confirmed")


def _grouped(lists: DataFrame) -> DataFrame:
    """``head, head_n, nid, n, shared``: for each node the heads of its lists, with how many lists
    lead to each; stored. Nodes of one list have its head in common."""
    heads = store(lists.groupBy("value").agg(F.min(F.struct("nid", "n")).alias("head")), "heads")
    rows = lists.join(heads, "value").groupBy(F.col("head.nid").alias("head"), F.col("head.n").alias("head_n"), "nid", "n")
    return store(rows.agg(F.count(F.lit(1)).alias("shared")), "groups")


def _pivots(groups: DataFrame, how: Near) -> DataFrame:
    """For each node, the head that it shares most lists with."""
    rows = groups.where((F.col("nid") != F.col("head")) & _alike("n", "head_n", how))
    best = rows.groupBy("nid").agg(F.max(F.struct("shared", (-F.col("head")).alias("first"))).alias("best"))
    return best.select((-F.col("best.first")).alias("a"), F.col("nid").alias("b"))


def _apart(groups: DataFrame, labels: DataFrame | None) -> DataFrame:
    """The groups that still hold nodes of more than one component, with each node's label."""
    rows = groups.select("head", "nid", "n").withColumn("label", F.col("nid"))
    if labels is not None:
        found = labels.select(F.col("node").alias("nid"), F.col("label").alias("_label"))
        rows = rows.join(found, "nid", "left").withColumn("label", F.coalesce("_label", "nid")).drop("_label")
    rows = store(rows, "labelled")
    still = rows.groupBy("head").agg(F.count(F.lit(1)).alias("size"), F.min("label").alias("lo"), F.max("label").alias("hi"))
    return store(rows.join(store(still.where("lo <> hi").select("head", "size"), "open"), "head"), "apart")


def _pairs(apart: DataFrame, how: Near) -> DataFrame:
    """All pairs of different components in small groups."""
    rows = apart.where(F.col("size") <= how.group_rows)
    left = rows.select("head", *[F.col(c).alias(f"{c}_a") for c in ("nid", "n", "label")])
    right = rows.select("head", *[F.col(c).alias(f"{c}_b") for c in ("nid", "n", "label")])
    pairs = left.join(right, "head").where(
        (F.col("nid_a") < F.col("nid_b")) & (F.col("label_a") != F.col("label_b")) & _alike("n_a", "n_b", how)
    )
    return pairs.select(F.col("nid_a").alias("a"), F.col("nid_b").alias("b")).distinct()


class Shared:
    """How many values a set shares with each of some sets."""

    def __init__(self, sets: list[np.ndarray]):
        self.n = len(sets)
        flat = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.values = flat[order]
        self.owners = np.repeat(np.arange(self.n), [len(s) for s in sets])[order]

    def counts(self, values: np.ndarray) -> np.ndarray:
        first, last = (np.searchsorted(self.values, values, side) for side in ("left", "right"))
        hit = first < last
        owners = [self.owners[a:b] for a, b in zip(first[hit], last[hit], strict=True)]
        return np.bincount(np.concatenate(owners), minlength=self.n) if owners else np.zeros(self.n, np.int64)


def joins(left: list[int], right: list[int], sets: list[np.ndarray], label: list[int], how: Near) -> list[tuple[int, int]]:
    """Links between places ``left`` and ``right`` that join components: enough of them that every
    link between the two sides is inside a component. Sets are whole, so this is exact."""
    parent = {x: x for x in label}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = x = parent[parent[x]]
        return x

    sketch = [s[: how.k] for s in sets]
    shared, found = Shared([sketch[j] for j in right]), []
    sizes = np.array([len(sets[j]) for j in right])
    labels = np.array([label[j] for j in right])
    for i in left:
        n = len(sets[i])
        fits = 100 * np.minimum(sizes, n) >= how.numerator * np.maximum(sizes, n)
        fits &= labels != label[i]
        if not fits.any():
            continue
        counts = shared.counts(sketch[i])
        # Likely ones come first; whole sets of up to k share what they must.
        least = LEAST_SHARE * len(sketch[i])
        for at in sorted(np.flatnonzero(fits & (counts >= least)), key=lambda at: -counts[at]):
            j = right[at]
            if root(label[i]) != root(label[j]) and similar(sets[i], sets[j], how.numerator):
                parent[max(root(label[i]), root(label[j]))] = min(root(label[i]), root(label[j]))
                found.append((i, j))
    return found


def _block_links(apart: DataFrame, nodes: DataFrame, docs: DataFrame, how: Near, doc_id: str, text: str) -> DataFrame:
    """Links between components (their labels) in large groups: blocks of a group meet in tasks."""
    rows = apart.where(F.col("size") > how.group_rows)
    texts = _texts(rows.select("nid"), nodes, docs, doc_id, text)
    blocks = F.ceil(F.col("size") / how.block_rows).cast("int")
    own = F.pmod(F.xxhash64("nid"), blocks).cast("int")
    rows = rows.select("head", "nid", "label", own.alias("own"), F.explode(F.sequence(F.lit(0), blocks - 1)).alias("other"))
    rows = rows.withColumns({"lo": F.least("own", "other"), "hi": F.greatest("own", "other")}).drop("other")

    def meet(table: pa.Table) -> pa.Table:
        from tactile.llm import neardup
        from tactile.llm.common import release

        label, own = (table.column(c).to_pylist() for c in ("label", "own"))
        lo, hi = table.column("lo")[0].as_py(), table.column("hi")[0].as_py()
        sets = [
            neardup.own_set(t.as_py(), n.as_py(), how.words) for t, n in zip(table.column("text"), table.column("node"), strict=True)
        ]
        left, right = ([i for i, b in enumerate(own) if b == x and sets[i] is not None] for x in (lo, hi))
        found = neardup.joins(left, right, sets, label, how)
        del sets
        release()
        # Components are named by one of their nodes: tasks that join the same two say the same.
        ends = [[f(label[i], label[j]) for i, j in found] for f in (min, max)]
        return pa.table({"a": pa.array(ends[0], pa.int64()), "b": pa.array(ends[1], pa.int64())})

    met = rows.join(texts, "nid").groupBy("head", "lo", "hi").applyInArrow(meet, "a long, b long")
    return store(met.distinct(), "met")


def near_duplicates(docs: DataFrame, how: Near = DEFAULT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, text_key, n_shingles, component_id, kept`` for every row of ``docs``."""
    sets = store(sketches(docs, how, doc_id, text), "sketches")
    named = sets.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    nodes = named.groupBy("node").agg(
        F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("sketch").alias("sketch")
    )
    nodes = store(nodes.withColumn("nid", F.monotonically_increasing_id()), "nodes")
    groups = _grouped(store(listed(nodes, how), "lists"))
    links = confirm(_pivots(groups, how), nodes, docs, how, doc_id, text)
    labels = components(links) if links.limit(1).count() else None
    apart = _apart(groups, labels)
    tried = _pairs(apart, how).join(links, ["a", "b"], "left_anti")
    more = confirm(tried, nodes, docs, how, doc_id, text)
    if apart.where(F.col("size") > how.group_rows).limit(1).count():
        more = more.unionByName(_block_links(apart, nodes, docs, how, doc_id, text))
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    named_nodes = nodes.select("node", "nid", "rep")
    if labels is None:
        ids = named_nodes.select("node", F.col("rep").alias("component_id"))
    else:
        found = labels.select(F.col("node").alias("nid"), "label")
        known = named_nodes.join(found, "nid", "left").withColumn("label", F.coalesce("label", "nid"))
        known = store(known, "members")
        first = store(known.groupBy("label").agg(F.min("rep").alias("component_id")), "components")
        ids = known.join(first, "label").select("node", "component_id")
    ids = store(ids, "ids")
    rows = sets.select("doc_id", "text_key", "n", "node").join(ids, "node", "left")
    component = F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id"))
    return rows.select(
        "doc_id",
        "text_key",
        F.col("n").alias("n_shingles"),
        component.alias("component_id"),
        F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"),
    )


def drop_copies(docs: DataFrame, how: Near = DEFAULT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One document of each component: the one with the smallest ``doc_id`` (one row of it)."""
    found = near_duplicates(docs, how, doc_id, text).where(F.col("doc_id").isNotNull())
    copies = store(found.groupBy("doc_id", "text_key").agg(F.first("kept").alias("kept"), F.count(F.lit(1)).alias("rows")), "copies")
    own, key = free_name(docs, "own"), free_name(docs, "key")
    gone = store(copies.where("not kept"), "gone").select(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    keyed = docs.withColumns({own: F.col(doc_id).cast("long"), key: F.xxhash64(text)})
    kept = keyed.join(small(gone, gone.count()), [own, key], "left_anti")
    # Of a row that comes repeatedly, one stays.
    again = copies.where("kept and rows > 1").select(F.col("doc_id").alias(own), F.col("text_key").alias(key))
    again = store(again, "again")
    if n := again.count():
        once = kept.join(small(again, n), [own, key], "left_semi").dropDuplicates([own, key])
        kept = kept.join(small(again, n), [own, key], "left_anti").unionByName(once)
    return kept.select(*docs.columns)
