"""Merkle manifest of a dataset, with inclusion proofs from incremental witnesses.

A leaf is the hash of a row. Leaves of a group, in order, are appended one after the other to open
subtrees, one run of at most ``FANOUT`` siblings a level. Each sibling carries the leaves below it
whose witnesses are still partial. When a run is complete, all of them are extended by it, and its
hash is appended a level up with all its leaves. What is left open at the end of a group is closed
from the bottom up, so a last run may be shorter, even of one.

Distributed, a task appends one aligned block of ``FANOUT ** DEPTH`` leaves and hands out its root
and a witness a leaf, which ends at that root. The roots of a group's blocks are appended in the
same way in a next round, and so on until a group has one root; the roots of the groups are
appended last. Then the witnesses of a round are extended by those of the next, from the top down.
A group may hold any share of the rows: places in it come from distributed prefix sums, and no task
sees more than a block.

A step of a witness is ``spot, run``: the digests of a complete run, and the place in it. Leaves
of a run share its bytes, which keeps stored witnesses near the size of the leaves.

Results: rows are ordered by ``doc_id`` (null first), then by leaf; rows that are equal in both are
interchangeable, and each is a leaf. Null values are hashed as ``-``, an empty text as ``0:``. Groups
are ordered by UTF-8 bytes, null first; null and empty are different groups. An empty table has no
leaves and no rows. A group of one leaf has it as subroot, one group alone its subroot as root; the
proof is then the hash of nothing. Other columns of the rows are not read.
"""

from __future__ import annotations

import hashlib
import math

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tactile.llm.common import UPPER, LOWER, prefix_sums, remainder, small, store

FANOUT = 8
DEPTH = 4
STEPS = "array<struct<spot: tinyint, run: binary>>"
DIGEST = 32


def join_hash(digests: bytes) -> bytes:
    """The parent of a run of raw digests: SHA-256 of their hexadecimal texts."""
    return hashlib.sha256(digests.hex().encode()).digest()


def height(leaves: int, fanout: int = FANOUT) -> int:
    """Levels over a number of leaves: 0 for one."""
    levels = 0
    while leaves > 1:
        leaves, levels = -(-leaves // fanout), levels + 1
    return levels


class Appender:
    """Open subtrees of ``levels`` levels over at most ``fanout ** levels`` leaves."""

    def __init__(self, levels: int, fanout: int = FANOUT):
        self.levels, self.fanout = levels, fanout
        self.siblings: list[list[bytes]] = [[] for _ in range(levels)]
        self.waiting: list[list[list[int]]] = [[] for _ in range(levels)]
        self.witnesses: list[list[tuple[int, bytes]]] = []
        self.root: bytes | None = None

    def append(self, digest: bytes) -> None:
        self.witnesses.append([])
        self._add(0, digest, [len(self.witnesses) - 1])

    def _add(self, level: int, digest: bytes, leaves: list[int]) -> None:
        if level == self.levels:
            self.root = digest
            return
        self.siblings[level].append(digest)
        self.waiting[level].append(leaves)
        if len(self.siblings[level]) == self.fanout:
            self._close(level)

    def _close(self, level: int) -> None:
        """A complete run: every witness below it grows by one step."""
        run = b"".join(self.siblings[level])
        below: list[int] = []
        for spot, leaves in enumerate(self.waiting[level]):
            for leaf in leaves:
                self.witnesses[leaf].append((spot, run))
            below += leaves
        self.siblings[level], self.waiting[level] = [], []
        self._add(level + 1, join_hash(run), below)

    def finish(self) -> bytes:
        for level in range(self.levels):
            if self.siblings[level]:
                self._close(level)
        return self.root


def fold(leaf: bytes, steps: list[tuple[int, bytes]]) -> bytes:
    """The root that a leaf and its siblings lead to."""
    for spot, run in steps:
        at = spot * DIGEST
        leaf = join_hash(run[:at] + leaf + run[at + DIGEST :])
    return leaf


def proof(steps: list[tuple[int, bytes]]) -> str:
    """Hash of all siblings, level by level."""
    found = hashlib.sha256()
    for spot, run in steps:
        at = spot * DIGEST
        found.update((run[:at] + run[at + DIGEST :]).hex().encode())
    return found.hexdigest()


def leaf(columns: list[Column]) -> Column:
    """The hash of a row, as raw bytes: each value as byte count, colon and value, null as ``-``."""
    texts = [c.cast("string") for c in columns]
    parts = [F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts]
    return F.unhex(F.sha2(F.concat(*parts).cast("binary"), 256))


def append_blocks(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, place, digest, n`` (places from 0 in each key, ``n`` of them) to ``key, place, n, steps,
    root``: the witness of each node inside its block of ``FANOUT ** depth``, and the block's root."""
    block = FANOUT**depth

    def one(table: pa.Table) -> pa.Table:
        from tactile.llm.merkle import Appender, FANOUT, height

        table = table.sort_by("place")
        n = table.column("n")[0].as_py()
        tree = Appender(min(depth, height(n)), FANOUT)
        for digest in table.column("digest").to_pylist():
            tree.append(digest)
        root = tree.finish()
        steps = [[{"spot": s, "run": r} for s, r in w] for w in tree.witnesses]
        kind = pa.list_(pa.struct([("spot", pa.int8()), ("run", pa.binary())]))
        return table.select(["key", "place", "n"]).append_column("steps", pa.array(steps, kind)).append_column(
            "root", pa.array([root] * len(table), pa.binary())
        )

    dealt = nodes.select("key", "place", "n", "digest", F.floor(F.col("place") / block).cast("long").alias("block"))
    return dealt.groupBy("key", "block").applyInArrow(one, f"key string, place long, n long, steps {STEPS}, root binary")


def witnesses(nodes: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``key, place, steps, root``: each node's whole witness in the tree of its key, and the tree's root."""
    block = FANOUT**depth
    rounds = []
    while True:
        done = store(append_blocks(nodes, depth), "appended")
        rounds.append(done)
        largest = done.agg(F.max("n")).first()[0] or 0
        if largest <= block:
            break
        # Each block's root is an append of the next round. Keys of one block are complete.
        firsts = done.where((F.col("place") % block == 0) & (F.col("n") > block))
        nodes = firsts.select(
            "key",
            F.floor(F.col("place") / block).cast("long").alias("place"),
            F.ceil(F.col("n") / block).cast("long").alias("n"),
            F.col("root").alias("digest"),
        )
    whole = rounds.pop().select("key", "place", "steps", "root")
    while rounds:
        upper = store(whole, "witnesses")
        upper = upper.select("key", F.col("place").alias("_block"), F.col("steps").alias("_steps"), F.col("root").alias("_root"))
        lower = rounds.pop().withColumn("_block", F.floor(F.col("place") / block).cast("long"))
        whole = lower.join(small(upper, upper.count(), 20_000), ["key", "_block"], "left").select(
            "key",
            "place",
            F.when(F.col("_steps").isNull(), F.col("steps")).otherwise(F.concat("steps", "_steps")).alias("steps"),
            F.coalesce("_root", "root").alias("root"),
        )
    return whole


def placed(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """``rows`` with ``place`` in the order of each key and ``n``, the key's number of rows; stored."""
    counted = store(prefix_sums(rows.withColumn("_one", F.lit(1).cast("long")), key, order, {"place": "_one"}).drop("_one"), "placed")
    sizes = store(counted.groupBy(key).agg(F.count(F.lit(1)).alias("n")), "sizes")
    return counted.join(small(sizes, sizes.count()), key)


def manifest(docs: DataFrame, group: str = "lang", depth: int = DEPTH) -> DataFrame:
    """``doc_id, leaf, subroot, root, proof_sha256, folded_root, verified`` for each row of ``docs``.

    The check folds each leaf with its siblings; where 3 divides the checksum of ``doc_id`` (null: of
    nothing), that of the row with A-Z of its text in lower case.
    """
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars")]
    own, changed = (leaf([*fields, t]) for t in (F.col("text"), F.translate("text", UPPER, LOWER)))
    leaves = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        # Null before all others, and not the same as an empty value.
        F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("")).alias("key"),
        own.alias("digest"),
        F.when(remainder(F.col("doc_id"), 3) == 0, changed).alias("tampered"),
    )
    leaves = placed(leaves, "key", ["doc_id", "digest"])
    inside = store(witnesses(leaves.select("key", "place", "n", "digest"), depth), "witnesses")

    subroots = inside.where("place = 0").select(F.lit("").alias("all"), "key", F.col("root").alias("digest"))
    groups = placed(subroots, "all", ["key"]).select("place", "n", F.col("key").alias("name"), "digest")
    above = witnesses(groups.select(F.lit("").alias("key"), "place", "n", "digest"), depth)
    above = above.join(groups.select("place", "name"), "place").select(
        F.col("name").alias("key"), F.col("steps").alias("_above"), F.col("root").alias("top")
    )
    above = store(above, "above")
    rows = leaves.select("doc_id", "key", "place", "digest", "tampered").join(inside, ["key", "place"])
    rows = rows.join(small(above, above.count(), 20_000), "key").withColumn("steps", F.concat("steps", "_above"))

    def run(batches):
        from tactile.llm.merkle import fold, proof

        for batch in batches:
            column = {c: batch.column(i).to_pylist() for i, c in enumerate(batch.schema.names)}
            proofs, folded = [], []
            for digest, tampered, steps in zip(column["digest"], column["tampered"], column["steps"], strict=True):
                steps = [(s["spot"], s["run"]) for s in steps]
                proofs.append(proof(steps))
                folded.append(fold(digest if tampered is None else tampered, steps).hex())
            hexed = [[x.hex() for x in column[c]] for c in ("digest", "root", "top")]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(x, pa.string()) for x in (*hexed, proofs, folded)]],
                ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root"],
            )

    kinds = "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string"
    found = rows.select("doc_id", "digest", "root", "top", "tampered", "steps").mapInArrow(run, kinds)
    return found.withColumn("verified", F.col("folded_root") == F.col("root"))
