"""Resharding with the fewest bytes moved.

The sizes of the old shards and the capacities of the new ones make a flow network: a byte costs
nothing where it is and one anywhere else. A minimum-cost flow says how many bytes each old shard
keeps and sends where. Only sizes of shards reach the driver. Inside an old shard the documents
have an order, large ones first, so the cuts between the blocks that go to different shards fall
between small documents; each block is a range of that order, kept as its first key, so a second
pass over the texts needs no join by document. Where a cut falls between rows of equal keys, their
number for each shard is kept, and these rows are numbered. Files of shards that lose or gain a block
are written anew.

Results: a null text has 8 bytes (the fixed part) like an empty one; a null ``doc_id`` sorts before
all others; repeated rows are documents of their own, dealt to several shards where a cut falls
between them; an empty table has no shards. A shard differs from its capacity by about a document at
each cut. Columns of any names are kept (``keyed`` has its own names beside the row, a struct).
"""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.llm.common import prefix_sums, small, store
from tactile.session import new_folder

FIXED_BYTES = 8
FILE_BYTES = 32 << 20
NO_ID = -(1 << 63)


@dataclass(frozen=True)
class Transfer:
    old: int
    new: int
    size: int


def equal_capacities(total: int, n_shards: int) -> list[int]:
    return [total // n_shards + (i < total % n_shards) for i in range(n_shards)]


def min_cost_flow(supply: list[int], capacity: list[int], cost) -> list[Transfer]:
    """Send all of ``supply`` into ``capacity`` (same sums, or more room) at the least total
    ``cost(i, j)`` a unit: shortest augmenting paths in the residual graph. Zero transfers are
    left out. The network has a node a shard."""
    n, m = len(supply), len(capacity)
    flow: dict[tuple[int, int], int] = {}
    left, room = list(supply), list(capacity)
    price = [[cost(i, j) for j in range(m)] for i in range(n)]
    while any(left):
        # Distances from all old shards with bytes left, by relaxation; arcs back undo flow.
        dist_old = [0.0 if x else math.inf for x in left]
        dist_new, from_old, from_new = [math.inf] * m, [-1] * m, [-1] * n
        changed = True
        while changed:
            changed = False
            for i in range(n):
                if dist_old[i] < math.inf:
                    for j in range(m):
                        if dist_old[i] + price[i][j] < dist_new[j]:
                            dist_new[j], from_old[j], changed = dist_old[i] + price[i][j], i, True
            for (i, j), sent in flow.items():
                if sent and dist_new[j] - price[i][j] < dist_old[i]:
                    dist_old[i], from_new[i], changed = dist_new[j] - price[i][j], j, True
        reached = [j for j in range(m) if room[j] and dist_new[j] < math.inf]
        if not reached:
            raise ValueError("the new shards have no room for all bytes")
        end = min(reached, key=lambda j: (dist_new[j], -room[j]))
        path, j = [], end
        while True:
            i = from_old[j]
            path.append((i, j, from_new[i]))
            if from_new[i] < 0:
                break
            j = from_new[i]
        amount = min(room[end], left[i], *[flow[i2, back] for i2, _, back in path if back >= 0])
        for i2, j2, back in path:
            flow[i2, j2] = flow.get((i2, j2), 0) + amount
            if back >= 0:
                flow[i2, back] -= amount
        left[i] -= amount
        room[end] -= amount
    return [Transfer(i, j, size) for (i, j), size in sorted(flow.items()) if size]


def keyed(docs: DataFrame, old: Column, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row`` (the columns of ``docs``) with ``_old``, ``_size``, ``_crc`` and ``_key``, the place in
    the old shard."""
    size = (F.coalesce(F.octet_length(text), F.lit(0)) + FIXED_BYTES).cast("long")
    crc = F.crc32(F.coalesce(F.col(text), F.lit("")).cast("binary"))
    ident = F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID))
    rows = docs.select(F.struct(*docs.columns).alias("row"), old.cast("int").alias("_old"), size.alias("_size"), crc.alias("_crc"), ident.alias("_id"))
    key = F.struct((-F.col("_size")).alias("s"), F.col("_id").alias("i"), F.col("_crc").alias("c"))
    return rows.withColumn("_key", key).drop("_id")


@dataclass(frozen=True)
class Blocks:
    """Ranges of keys, ``_old, shard, lo, hi`` (first key of a block and of the next, null: none); and
    keys whose rows are dealt to several shards, ``_old, _key, shard, first, last`` (their numbers)."""

    ranges: DataFrame
    shared: DataFrame


def plan(rows: DataFrame, capacities: list[int] | None, n_shards: int) -> tuple[list[Transfer], Blocks | None]:
    """The transfers, and the blocks they are made of."""
    narrow = store(rows.select("_old", F.col("_size").alias("size"), "_key.*"), "sizes")
    sizes = dict(narrow.groupBy("_old").agg(F.sum("size")).collect())
    if not sizes:
        return [], None
    total, n_old = sum(sizes.values()), max(sizes) + 1
    supply = [sizes.get(i, 0) for i in range(n_old)]
    transfers = min_cost_flow(supply, capacities or equal_capacities(total, n_shards), lambda i, j: int(i != j))
    bounds, done = [], [0] * n_old
    # What stays comes first, so that large documents stay.
    for t in sorted(transfers, key=lambda t: (t.old, t.new != t.old, t.new)):
        bounds.append((t.old, t.new, done[t.old], done[t.old] + t.size))
        done[t.old] += t.size
    ranges = rows.sparkSession.createDataFrame(bounds, "_old int, shard int, lo long, hi long")
    placed = prefix_sums(narrow, "_old", ["s", "i", "c"], {"before": "size"})
    middle = F.col("before") + F.floor(F.col("size") / 2)
    # As many ranges as transfers: at most old and new shards together.
    dealt = placed.join(F.broadcast(ranges), "_old").where((middle >= F.col("lo")) & (middle < F.col("hi")))
    dealt = store(dealt.select("_old", "shard", F.struct("s", "i", "c").alias("_key"), F.col("lo").alias("from")), "dealt")
    blocks = dealt.groupBy("_old", "shard").agg(F.min("_key").alias("lo"), F.first("from").alias("from"))
    along = Window.partitionBy("_old").orderBy("lo", "from")
    blocks = store(blocks.select("_old", "shard", "lo", F.lead("lo").over(along).alias("hi")), "blocks")
    # Only a key at an edge can have rows on both sides.
    edges = blocks.select("_old", F.col("lo").alias("_key")).distinct()
    counts = dealt.join(F.broadcast(edges), ["_old", "_key"]).groupBy("_old", "_key", "shard").agg(
        F.count(F.lit(1)).alias("n"), F.first("from").alias("from")
    )
    of_key = Window.partitionBy("_old", "_key")
    last = F.sum("n").over(of_key.orderBy("from").rowsBetween(Window.unboundedPreceding, 0))
    counts = counts.withColumns({"last": last, "shards": F.count(F.lit(1)).over(of_key)}).where("shards > 1")
    shared = store(counts.select("_old", "_key", "shard", (F.col("last") - F.col("n")).alias("first"), "last"), "shared")
    return transfers, Blocks(blocks, shared)


def assign(rows: DataFrame, blocks: Blocks) -> DataFrame:
    """``rows`` with their new ``shard``."""
    inside = (F.col("_key") >= F.col("lo")) & (F.col("hi").isNull() | (F.col("_key") < F.col("hi")))
    found = blocks.ranges.withColumnRenamed("_old", "_from")
    # Edges are as few as blocks.
    keys = F.broadcast(blocks.shared.select("_old", "_key").distinct())
    alone = rows.join(keys, ["_old", "_key"], "left_anti").select(*rows.columns)
    alone = alone.join(F.broadcast(found), (F.col("_old") == F.col("_from")) & inside).drop("_from", "lo", "hi")
    if not blocks.shared.limit(1).count():
        return alone
    # One key may have any share of the rows: they are numbered by distributed sums, without texts.
    equal = rows.join(keys, ["_old", "_key"], "left_semi").select(*rows.columns).withColumn("_n", F.monotonically_increasing_id())
    equal = store(equal, "equal")
    narrow = equal.select("_n", "_old", "_key", F.xxhash64("_old", "_key").cast("string").alias("_of"), F.lit(1).cast("long").alias("_one"))
    numbered = prefix_sums(narrow, "_of", ["_old", "_key", "_n"], {"_number": "_one"})
    shards = numbered.join(F.broadcast(blocks.shared), ["_old", "_key"]).where("_number >= first and _number < last").select("_n", "shard")
    shards = store(shards, "numbered")
    return alone.unionByName(equal.join(small(shards, shards.count()), "_n").select(*rows.columns, "shard"))


def affected(transfers: list[Transfer]) -> list[int]:
    """Shards whose files change."""
    moved = [t for t in transfers if t.old != t.new]
    return sorted({t.old for t in moved} | {t.new for t in moved})


def rewrite(rows: DataFrame, columns: list[str], total: int, n_shards: int, only: list[int] | None = None) -> str:
    """Write the shards (``only`` some of them) as ``shard=N`` folders of files of about
    ``FILE_BYTES``; returns the folder."""
    files = max(1, math.ceil(total / n_shards / FILE_BYTES))
    if only is not None:
        rows = rows.where(F.col("shard").isin(only))
    folder = new_folder(rows.sparkSession, "shards")
    spread = rows.withColumn("_file", F.pmod(F.xxhash64("_key"), F.lit(files)))
    spread = spread.repartition(n_shards * files, "shard", "_file").select(*[F.col("row")[c].alias(c) for c in columns], "shard")
    spread.write.partitionBy("shard").parquet(folder)
    return folder


def slots(rows: DataFrame, order: list[str]) -> DataFrame:
    """``rows`` with ``slot``: their place in their shard, from 0 without gaps."""
    return prefix_sums(rows.withColumn("_one", F.lit(1).cast("long")), "shard", order, {"slot": "_one"}).drop("_one")
