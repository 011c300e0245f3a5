"""Exact top-k search by inner product, block at a time.

Documents come in groups by ranges of ids; inside a group, similar ones are put into one block. A block keeps, for each term, its largest and its
smallest weight, so the inner product with a query is at most the sum over terms of the larger of
weight times largest and weight times smallest. A task holds some blocks (a group) and some
queries: for each query it takes the blocks from the largest bound down, scores a block through
its forward index (one matrix product), and stops at the first bound under the k-th best score.
Equal bounds go on, so ties come out by the smaller id. The best of the groups are merged.

A query meets every group, so both sides are copied: documents once per set of queries, queries
once per group. Only the best k of a query leave a task.

Results: vectors that are null or hold a null or non-finite component take no part, neither do rows
without id. Vectors of different lengths are compared over the shorter. Components are whole
numbers, taken as they are: sums are exact in doubles while they stay below 2^53, and in 64-bit
integers while below 2^63; where they could pass that, or a component does, the query fails with an
error. Rows that repeat an id are candidates each, and one query each; rows with the query's id are
not candidates.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.llm.common import store

@dataclass(frozen=True)
class Search:
    k: int = 20
    block: int = 64
    group_rows: int = 32_768
    query_rows: int = 1_024


DEFAULT = Search()


def usable(vector: Column) -> Column:
    """Vectors that take part."""
    bad = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return vector.isNotNull() & F.coalesce(~bad, F.lit(False))


def whole_terms(vector: Column, scale: int = 64) -> Column:
    """Components as whole numbers, an error if one needs more than 63 bits."""

    def whole(x: Column) -> Column:
        scaled = F.floor(x.cast("double") * scale)
        beyond = F.abs(x.cast("double") * scale) >= 2.0**63
        return F.when(beyond, F.raise_error(F.lit("a component is beyond 63 bits")).cast("long")).otherwise(scaled)

    return F.transform(vector, whole)


def _matrix(rows: pa.ChunkedArray, width: int) -> np.ndarray:
    out = np.zeros((len(rows), width), np.int64)
    for i, row in enumerate(rows):
        values = row.values.to_numpy(zero_copy_only=False)[:width]
        out[i, : len(values)] = values
    return out


def _largest(matrix: np.ndarray) -> int:
    return max(int(matrix.max(initial=0)), -int(matrix.min(initial=0)))


def near_order(d: np.ndarray, most: int) -> np.ndarray:
    """An order of rows in which runs of ``most`` are alike: cut in two at the middle of the widest
    column, again and again."""
    done, left = [], [np.arange(len(d))]
    while left:
        rows = left.pop()
        if len(rows) <= most:
            done.append(rows)
            continue
        part = d[rows]
        widest = int((part.max(axis=0).astype(float) - part.min(axis=0)).argmax())
        rows = rows[np.argsort(part[:, widest], kind="stable")]
        # Whole blocks on the left, so that blocks of the order are the parts.
        half = max(1, -(-len(rows) // most) // 2) * most
        left += [rows[half:], rows[:half]]
    return np.concatenate(done) if done else np.zeros(0, np.int64)


def best_of_group(queries: pa.Table, docs: pa.Table, how: Search) -> pa.Table:
    """The best ``k`` of these documents for each query."""
    empty = pa.table({n: pa.array([], pa.int64()) for n in ("query", "query_id", "vec_id", "score")})
    if not queries.num_rows or not docs.num_rows:
        return empty
    docs = docs.sort_by("vec_id")
    width = max(max(len(v) for v in t.column("terms")) for t in (queries, docs))
    q, d = _matrix(queries.column("terms"), width), _matrix(docs.column("terms"), width)
    order = near_order(d, how.block)
    d, ids = d[order], docs.column("vec_id").to_numpy()[order]
    own = queries.column("vec_id").to_numpy()
    largest = width * max(1, _largest(q)) * max(1, _largest(d))
    if largest >= 2**63:
        raise ValueError("scores may be beyond 63 bits")
    if largest < 2**53:
        q, d = q.astype(float), d.astype(float)
    blocks = [slice(i, i + how.block) for i in range(0, len(ids), how.block)]
    high = np.stack([d[b].max(axis=0) for b in blocks])
    low = np.stack([d[b].min(axis=0) for b in blocks])
    bounds = np.maximum(q, 0) @ high.T + np.minimum(q, 0) @ low.T
    out = []
    for i in range(len(q)):
        scores, found = np.zeros(0, d.dtype), np.zeros(0, np.int64)
        for b in np.argsort(-bounds[i], kind="stable"):
            if len(scores) >= how.k and bounds[i, b] < scores[how.k - 1]:
                break
            block = blocks[b]
            new, new_ids = d[block] @ q[i], ids[block]
            keep = new_ids != own[i]
            if len(scores) >= how.k:
                keep &= new >= scores[how.k - 1]
            scores, found = np.concatenate([scores, new[keep]]), np.concatenate([found, new_ids[keep]])
            order = np.lexsort((found, -scores))[: how.k]
            scores, found = scores[order], found[order]
        out.append((scores.astype(np.int64), found))
    sizes = [len(s) for s, _ in out]
    return pa.table(
        {
            "query": np.repeat(queries.column("query").to_numpy(), sizes),
            "query_id": np.repeat(own, sizes),
            "vec_id": np.concatenate([f for _, f in out]),
            "score": np.concatenate([s for s, _ in out]),
        }
    )


def top_k(vectors: DataFrame, is_query: Column, how: Search = DEFAULT) -> DataFrame:
    """``query_id, rank, vec_id, score`` over ``vec_id, terms`` (array of long, no nulls)."""
    rows = vectors.select("vec_id", "terms", is_query.alias("is_query")).where(F.col("vec_id").isNotNull())
    rows = store(rows, "vectors")
    n, n_queries = rows.agg(F.count(F.lit(1)), F.count_if("is_query")).first()
    n_groups, n_sets = max(1, math.ceil(n / how.group_rows)), max(1, math.ceil(n_queries / how.query_rows))
    # Ranges of ids: blocks of a group are ranges of documents.
    groups = rows.select("vec_id", "terms").repartitionByRange(n_groups, "vec_id")
    groups = store(groups.withColumn("group", F.spark_partition_id() % n_groups), "groups")
    queries = rows.where("is_query").select("vec_id", "terms", F.monotonically_increasing_id().alias("query"))
    queries = store(queries.withColumn("set", F.pmod(F.xxhash64("query"), n_sets).cast("int")), "queries")
    left = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(n_groups - 1))))
    right = groups.withColumn("set", F.explode(F.sequence(F.lit(0), F.lit(n_sets - 1))))

    def run(q: pa.Table, d: pa.Table) -> pa.Table:
        from tactile.llm.topk import best_of_group

        return best_of_group(q, d, how)

    found = left.groupBy("set", "group").cogroup(right.groupBy("set", "group")).applyInArrow(
        run, "query long, query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query").orderBy(F.col("score").desc(), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= how.k)
    return ranked.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
