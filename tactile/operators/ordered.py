"""Ordered work inside groups, also when one group holds a large share of all rows.

``split_hot`` measures the groups. Groups of normal size take ``Windows``: plain window
functions, one shuffle by the group key. Rows of larger groups take ``Chunks``: they are
range-partitioned by group and order, written once to reliable storage, and every window becomes
a window inside a chunk plus a carry from the summaries of the other chunks of its group (one
row per chunk). Both give the same rows.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.session import cut

MAX_GROUP_ROWS = 2_000_000
CHUNK_ROWS = 500_000
BROADCAST_KEYS = 100_000
CHUNK = "_chunk"


def split_hot(
    df: DataFrame,
    group: list[str],
    max_rows: int | None = MAX_GROUP_ROWS,
    sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame | None, int]:
    """Rows of normal groups, rows of groups above ``max_rows`` (None if there are none), and
    how many rows the latter are.

    Groups are counted, unless ``sizes`` gives ``rows`` per group already (an upper bound will
    do). ``max_rows=None`` is for groups known to be small: nothing is measured. Rows to be
    counted are stored first, so whatever they come from (a recogniser, a fold) runs once.
    """
    if max_rows is None:
        return df, None, 0
    if sizes is None:
        df = cut(df)
        sizes = df.groupBy(*group).agg(F.count(F.lit(1)).alias("rows"))
    large = sizes.where(F.col("rows") > max_rows).select(*group, "rows")
    total, n_keys = large.agg(F.sum("rows"), F.count("rows")).first()
    if not n_keys:
        return df, None, 0
    keys = cut(large).select(*group)
    if n_keys <= BROADCAST_KEYS:
        keys = F.broadcast(keys)
    return df.join(keys, group, "left_anti"), df.join(keys, group, "left_semi"), total


def chunked(df: DataFrame, group: list[str], order: list[str], n_chunks: int) -> DataFrame:
    """``df`` with a chunk number that rises along (group, order), on reliable storage.

    The bounds come from sampling, so the numbers must be fixed before they are used twice.
    """
    parts = df.drop(CHUNK).repartitionByRange(n_chunks, *group, *order)
    return cut(parts.withColumn(CHUNK, F.spark_partition_id()))


@dataclass(frozen=True)
class Scan:
    """One output of an ordered pass: ``prev`` (value of the row before), ``max_before`` (rows
    before), ``min_from`` (this row and those after) or ``sum_to`` (this row and those before)."""

    kind: str
    value: Column


def _local(name: str, scan: Scan, group: list[str], order: list[str]) -> Column:
    window = Window.partitionBy(*group).orderBy(*order)
    before = Window.unboundedPreceding
    if scan.kind == "prev":
        return F.lag(scan.value).over(window)
    if scan.kind == "max_before":
        return F.max(scan.value).over(window.rowsBetween(before, -1))
    if scan.kind == "sum_to":
        return F.sum(scan.value).over(window.rowsBetween(before, 0))
    if scan.kind == "min_from":
        # Descending and growing: a frame that ends at the last row would be re-read per row.
        down = Window.partitionBy(*group).orderBy(*[F.col(c).desc() for c in order])
        return F.min(scan.value).over(down.rowsBetween(before, 0))
    raise ValueError(f"unknown scan {scan.kind!r} for {name!r}")


def _local_scans(df: DataFrame, scans: dict[str, Scan], group, order) -> DataFrame:
    """All descending scans in one pass, then all ascending ones, whose sort is left for whatever
    comes next."""
    for down in (True, False):
        part = {n: s for n, s in scans.items() if (s.kind == "min_from") == down}
        if part:
            df = df.withColumns({n: _local(n, s, group, order) for n, s in part.items()})
    return df


class Windows:
    """Groups of bounded size."""

    def scan(self, df, group, order, scans: dict[str, Scan]) -> DataFrame:
        return _local_scans(df, scans, group, order)

    def totals(self, df, group, aggs: dict[str, Column]) -> DataFrame:
        """Group aggregates on every row; a scan of the same groups before leaves them sorted."""
        whole = Window.partitionBy(*group)
        return df.withColumns({name: agg.over(whole) for name, agg in aggs.items()})

    def rank(self, df, group, members: list[str], order, name: str) -> DataFrame:
        """Rank, from 0, of the sub-group ``members`` inside ``group``; ``order`` is constant
        within a sub-group and differs between sub-groups."""
        ranked = F.dense_rank().over(Window.partitionBy(*group).orderBy(*order))
        return df.withColumn(name, ranked - 1)

    def concat(self, df, group, order, piece: Column, aggs: dict[str, Column]) -> DataFrame:
        """``text``: the pieces of a group in order; plus plain aggregates."""
        rows = F.sort_array(F.collect_list(F.struct(*order, piece.alias("_piece"))))
        text = F.array_join(F.transform(rows, lambda r: r["_piece"]), "")
        return df.groupBy(*group).agg(
            text.alias("text"), *[agg.alias(name) for name, agg in aggs.items()]
        )


class Chunks:
    """Groups too large for one task: chunk summaries first, then chunks with their carry."""

    def __init__(self, n_rows: int, chunk_rows: int = CHUNK_ROWS):
        self.n_chunks = max(1, math.ceil(n_rows / chunk_rows))

    def scan(self, df, group, order, scans: dict[str, Scan]) -> DataFrame:
        inputs = {f"_in_{name}": scan.value for name, scan in scans.items()}
        parts = chunked(df.withColumns(inputs), group, order, self.n_chunks)
        keys = [*group, CHUNK]

        last = F.struct(*order)
        summaries, carries = [], []
        along = Window.partitionBy(*group).orderBy(CHUNK)
        back = Window.partitionBy(*group).orderBy(F.col(CHUNK).desc())
        for name, scan in scans.items():
            value, summary = F.col(f"_in_{name}"), F.col(f"_sum_{name}")
            if scan.kind == "prev":
                agg, carry = F.max_by(F.struct(value.alias("v")), last), F.lag(summary).over(along)
            elif scan.kind == "max_before":
                agg = F.max(value)
                carry = F.max(summary).over(along.rowsBetween(Window.unboundedPreceding, -1))
            elif scan.kind == "min_from":
                agg = F.min(value)
                carry = F.min(summary).over(back.rowsBetween(Window.unboundedPreceding, -1))
            else:
                agg = F.sum(value)
                carry = F.sum(summary).over(along.rowsBetween(Window.unboundedPreceding, -1))
            summaries.append(agg.alias(f"_sum_{name}"))
            carries.append(carry.alias(f"_carry_{name}"))
        carry = parts.groupBy(*keys).agg(*summaries).select(*keys, *carries)

        own = {
            f"_own_{name}": Scan(
                scan.kind,
                F.struct(F.col(f"_in_{name}").alias("v")) if scan.kind == "prev" else F.col(f"_in_{name}"),
            )
            for name, scan in scans.items()
        }
        out = _local_scans(parts.join(carry, keys), own, keys, order)
        results = {}
        for name, scan in scans.items():
            here, before = F.col(f"_own_{name}"), F.col(f"_carry_{name}")
            if scan.kind == "prev":
                results[name] = F.coalesce(here, before)["v"]
            elif scan.kind == "max_before":
                results[name] = F.greatest(here, before)
            elif scan.kind == "min_from":
                results[name] = F.least(here, before)
            else:
                results[name] = here + F.coalesce(before, F.lit(0))
        out = out.withColumns(results)
        helpers = [f"{p}{name}" for name in scans for p in ("_in_", "_own_", "_carry_")]
        return out.drop(CHUNK, *helpers)

    def totals(self, df, group, aggs: dict[str, Column]) -> DataFrame:
        stats = df.groupBy(*group).agg(*[agg.alias(name) for name, agg in aggs.items()])
        return df.join(stats, group)

    def rank(self, df, group, members, order, name) -> DataFrame:
        one = df.groupBy(*members).agg(*[F.first(c).alias(c) for c in order if c not in members])
        ranks = self.scan(one, group, order, {name: Scan("sum_to", F.lit(1))})
        return df.join(ranks.select(*members, (F.col(name) - 1).alias(name)), members)

    def concat(self, df, group, order, piece: Column, aggs: dict[str, Column]) -> DataFrame:
        """Chunks are joined in parallel; only their strings meet in the group."""
        parts = chunked(df.withColumn("_piece", piece), group, order, self.n_chunks)
        strings = Windows().concat(parts, [*group, CHUNK], order, F.col("_piece"), {})
        whole = Windows().concat(strings, group, [CHUNK], F.col("text"), {})
        stats = parts.groupBy(*group).agg(
            F.count(F.lit(1)).alias("_n"), *[agg.alias(name) for name, agg in aggs.items()]
        )
        return whole.join(stats, group).select(*group, "text", *aggs)


@dataclass(frozen=True)
class Bound:
    """How large a group may be for one task, how large the chunks of a larger one become, and
    the sizes of the groups if they are known."""

    max_rows: int | None = MAX_GROUP_ROWS
    chunk_rows: int = CHUNK_ROWS
    sizes: DataFrame | None = None


DEFAULT = Bound()
SMALL = Bound(max_rows=None)


def by_size(df: DataFrame, group: list[str], work, bound: Bound = DEFAULT) -> DataFrame:
    """``work(rows, how)`` once for groups of normal size and, if there are any, once for the
    larger ones."""
    normal, hot, n_hot = split_hot(df, group, bound.max_rows, bound.sizes)
    parts = [work(normal, Windows())]
    if hot is not None:
        parts.append(work(hot, Chunks(n_hot, bound.chunk_rows)))
    return reduce(DataFrame.unionByName, parts)
