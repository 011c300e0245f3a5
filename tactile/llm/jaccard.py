"""Exact Jaccard join on word n-grams by a token-group matrix.

A document's set are the distinct hashes of its shingles; documents with equal sets are one node.
Similar nodes are put into groups; the matrix holds, for each group, the union of its nodes' tokens.
How many of a query's tokens are in a group's union bounds what it can share with any node of it, so
only groups that reach the bound are opened, and only then is a query compared with nodes.

Which tokens are enough. A set of ``n`` can miss at most ``M = n - ceil(0.9 n)`` tokens of a set it
is linked with. Its pool are its ``M + r(n)`` smallest hashes (small sets: all), which hold the
``r(n)`` smallest common ones. Tokens are then ordered from rare to frequent over the corpus, and the
first ``M + e(n) + c(n)`` of the pool are taken, ``e(n)`` for pools of unlike length. Two linked sets
have at least ``min(c)`` of these in common, whatever the order. A token that only one row has is
never stored, yet takes a place. So a passage that very many documents repeat comes last, and is in
the matrix only for documents with hardly anything else. All is exact: full sets decide every link.

How hot groups stay harmless. First each node meets the node it shares most tokens with among the
most central ones of its tokens' lists (those with the fewest tokens of their own). Near copies
become one component that way, by a link each; tokens whose holders are all in one component are
done. The matrix is built for what is left: components that still share tokens. Nodes that follow
the same central node are a group, split by hash into groups of bounded size. Queries and groups of
one component do not meet. A hot group's queries come in blocks, and in a task a link makes one
component of two, so copies that are linked already are not compared again.

Results: see ``near_ngrams``. A document without words (or with a null text) has the empty set and
links with nothing; with fewer words than a shingle the whole sequence is its one shingle. Rows
without ``doc_id`` cannot name a component: ``component_id`` is null, they link with nothing. Rows that
repeat a ``doc_id`` or a text are in one component if their sets are alike. Texts of any length are
hashed whole; a hash has 64 bits. Other columns are not read. No rows give no rows.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.llm.common import small, store, text_slices
from tactile.llm.components import components
from tactile.llm.neardup import digest, shingle_sets, similar


@dataclass(frozen=True)
class Join:
    words: int = 3
    numerator: int = 90  # similarity of 90 of 100
    least_common: int = 96  # r(n) is this at least, where the set has as many
    group_rows: int = 256
    group_tokens: int = 1 << 20  # of a group's or a block's sets, unless one node has more
    query_rows: int = 512
    pair_rows: int = 256
    rounds: int = 2

    def missing(self, n):
        return n - -(-n * self.numerator // 100)

    def common(self, n):
        """r(n): how many of the smallest common tokens the pool is sure to hold."""
        m = self.missing(n)
        return np.minimum(n - m, np.maximum(self.least_common, m // 2 + 32))

    def pool(self, n):
        return self.missing(n) + self.common(n)

    def shared(self, n):
        """c(n): how many tokens of the matrix linked sets are sure to share."""
        m = self.missing(n)
        return np.minimum(n - m, 3 + m // 8)

    def taken(self, n):
        smallest = -(-n * self.numerator // 100)
        return self.missing(n) + self.common(n) - self.common(smallest) + self.shared(n)


DEFAULT = Join()


def _ceil_share(n: Column, how: Join) -> Column:
    return F.floor((n * how.numerator + 99) / 100).cast("long")


def _common(n: Column, how: Join) -> Column:
    m = n - _ceil_share(n, how)
    return F.least(n - m, F.greatest(F.lit(how.least_common), F.floor(m / 2) + 32))


def _shared(n: Column, how: Join) -> Column:
    m = n - _ceil_share(n, how)
    return F.least(n - m, F.floor(m / 8) + 3).cast("long")


def _taken(n: Column, how: Join) -> Column:
    smallest = _ceil_share(n, how)
    return (n - smallest + _common(n, how) - _common(smallest, how) + _shared(n, how)).cast("long")


def _alike(a: Column, b: Column, how: Join) -> Column:
    """Set sizes that allow a link."""
    return (a * 100 >= b * how.numerator) & (b * 100 >= a * how.numerator)


def pooled(docs: DataFrame, how: Join, doc_id: str, text: str) -> DataFrame:
    """``row, doc_id, n, node, pool`` of each row; ``node`` identifies the set. Stored."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text")
    )

    def run(batches):
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
                        pa.array([s[: int(how.pool(len(s)))].view(np.int64) for s in sets], pa.list_(pa.int64())),
                    ],
                    ["row", "doc_id", "n", "node", "pool"],
                )

    return store(rows.mapInArrow(run, "row long, doc_id long, n long, node binary, pool array<long>"), "pools")


def listed(sets: DataFrame, nodes: DataFrame, how: Join) -> DataFrame:
    """``token, nid, n, own``: the tokens that can decide, of nodes that may be linked with another
    set; ``own`` is how many of the pool no other row has. Stored."""
    able = nodes.where(F.col("n") * 100 >= (F.col("n") + 1) * how.numerator).select("row", "nid")
    tokens = sets.where(F.col("node").isNotNull() & F.col("doc_id").isNotNull()).select(F.explode("pool").alias("token"))
    frequent = tokens.groupBy("token").agg(F.count(F.lit(1)).alias("df")).where("df > 1")
    entries = sets.join(able, "row").select("nid", "n", F.size("pool").alias("size"), F.explode("pool").alias("token"))
    rows = entries.join(store(frequent, "frequent"), "token")
    of_node = Window.partitionBy("nid")
    rows = rows.withColumn("own", F.col("size") - F.count(F.lit(1)).over(of_node))
    rows = rows.withColumn("rank", F.row_number().over(of_node.orderBy("df", "token")))
    rows = rows.where(F.col("own") + F.col("rank") <= _taken(F.col("n"), how))
    return store(rows.select("token", "nid", "n", F.col("own").cast("long").alias("own")), "lists")


def homes(lists: DataFrame) -> DataFrame:
    """``nid, n, head, head_n, shared``: with which central nodes a node shares how many tokens, itself
    among them. Each token's most central node is the one with the fewest own tokens. Stored."""
    heads = lists.groupBy("token").agg(F.min(F.struct("own", "nid", "n")).alias("head"), F.count(F.lit(1)).alias("holders"))
    heads = store(heads.where("holders > 1").select("token", F.col("head.nid").alias("head"), F.col("head.n").alias("head_n")), "heads")
    rows = lists.join(heads, "token").groupBy("nid", "n", "head", "head_n").agg(F.count(F.lit(1)).alias("shared"))
    return store(rows, "homes")


def _best_head(rows: DataFrame) -> DataFrame:
    best = rows.groupBy("nid").agg(F.max(F.struct("shared", (-F.col("head")).alias("first"))).alias("best"))
    return best.select("nid", (-F.col("best.first")).alias("head"))


def with_labels(rows: DataFrame, labels: DataFrame | None, node: str = "nid", label: str = "label") -> DataFrame:
    """Adds the component of ``node``, itself if it has no links."""
    if labels is None:
        return rows.withColumn(label, F.col(node))
    found = labels.select(F.col("node").alias(node), F.col("label").alias("_label"))
    return rows.join(found, node, "left").withColumn(label, F.coalesce("_label", node)).drop("_label")


def confirm(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, how: Join, doc_id: str, text: str) -> DataFrame:
    """Of distinct ``pairs`` (``a, b`` of nodes) those that are linked, by their full sets; stored.

    A node of very many pairs comes once for each block of them, not once for each.
    """
    pairs = store(pairs.select("a", "b"), "candidates")
    ends = pairs.select(F.col("a").alias("nid")).unionByName(pairs.select(F.col("b").alias("nid"))).distinct()
    texts = texts_of(ends, nodes, docs, doc_id, text)
    sizes = pairs.groupBy("a").agg(F.ceil(F.count(F.lit(1)) / how.pair_rows).cast("int").alias("blocks"))
    dealt = pairs.join(sizes, "a").withColumn("block", F.pmod(F.xxhash64("b"), "blocks").cast("int"))
    dealt = store(dealt.select("a", "block", "b"), "dealt")
    of_head = dealt.select("a", "block").distinct().join(texts.withColumnRenamed("nid", "a"), "a").withColumn("b", F.lit(None).cast("long"))
    of_other = dealt.join(texts.withColumnRenamed("nid", "b"), "b")
    rows = of_head.select("a", "block", "b", "node", "text").unionByName(of_other.select("a", "block", "b", "node", "text"))
    rows = rows.repartition("a", "block").sortWithinPartitions("a", "block", F.col("b").asc_nulls_first())

    def run(batches):
        from tactile.llm.neardup import digest, shingle_sets, similar

        head, own = None, None
        for batch in batches:
            a, block, b, node, texts = batch.columns
            found: list[tuple[int, int]] = []
            for i in range(batch.num_rows):
                tokens = shingle_sets([texts[i].as_py()], how.words)[0]
                if digest(tokens) != node[i].as_py():
                    continue
                key = (a[i].as_py(), block[i].as_py())
                if b[i].as_py() is None:
                    head, own = key, tokens
                elif head == key and similar(own, tokens, how.numerator):
                    found.append((key[0], b[i].as_py()))
            yield pa.RecordBatch.from_arrays([pa.array([p[x] for p in found], pa.int64()) for x in (0, 1)], ["a", "b"])

    return store(rows.mapInArrow(run, "a long, b long").distinct(), "confirmed")


def _pieces(most_rows: int, how: Join) -> Column:
    """In how many pieces rows with ``n`` tokens each must be cut."""
    return F.ceil(F.greatest(F.count(F.lit(1)) / most_rows, F.sum("n") / how.group_tokens)).cast("int")


def token_group_matrix(rows: DataFrame, followed: DataFrame, how: Join) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Of open ``token, nid, n, label`` rows: the nodes with their group (``nid, n, label, gid``), the
    matrix (``token, gid``), and what bounds the nodes of a group (``gid, lo, hi, first, last``: set
    sizes and labels)."""
    nodes = store(rows.select("nid", "n", "label").distinct().join(followed, "nid"), "open_nodes")
    parts = nodes.groupBy("head").agg(_pieces(how.group_rows, how).alias("parts"))
    nodes = nodes.join(parts, "head").withColumn("gid", F.xxhash64("head", F.pmod(F.xxhash64("nid"), "parts")))
    nodes = store(nodes.select("nid", "n", "label", "gid"), "grouped")
    matrix = store(rows.join(nodes.select("nid", "gid"), "nid").select("token", "gid").distinct(), "matrix")
    bounds = nodes.groupBy("gid").agg(F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("label").alias("first"), F.max("label").alias("last"))
    return nodes, matrix, store(bounds, "bounds")


def qualifying(rows: DataFrame, nodes: DataFrame, matrix: DataFrame, bounds: DataFrame, how: Join) -> DataFrame:
    """``nid, gid``: the groups a query must open; of two groups that may meet, the first one's nodes
    are the queries. Stored."""
    queries = rows.join(nodes.select("nid", F.col("gid").alias("from")), "nid")
    hits = queries.join(matrix.join(bounds, "gid"), "token").where(
        (F.col("from") <= F.col("gid"))
        & ~((F.col("first") == F.col("label")) & (F.col("last") == F.col("label")))
        & (F.col("n") * 100 >= F.col("lo") * how.numerator)
        & (F.col("hi") * 100 >= F.col("n") * how.numerator)
    )
    hits = hits.groupBy("nid", "n", "gid", "lo").agg(F.count(F.lit(1)).alias("hits"))
    bound = F.least(_shared(F.col("n"), how), _shared(F.col("lo"), how))
    return store(hits.where(F.col("hits") >= bound).select("nid", "gid"), "qualifying")


class Union:
    def __init__(self) -> None:
        self.parent: dict[int, int] = {}

    def root(self, x: int) -> int:
        parent = self.parent
        while parent.get(x, x) != x:
            parent[x] = x = parent.get(parent[x], parent[x])
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        self.parent[max(x, y)] = min(x, y)


def open_group(members: list[tuple], queries: list[tuple], own: bool, how: Join) -> tuple[list, list]:
    """Nodes are ``nid, n, label, tokens``, the tokens a pool or a whole set. Links that these decide
    (of whole sets; components that are joined already are skipped), and the queries with which some
    node of the group may be linked, but only whole sets can tell. ``own``: queries are of the group."""
    tokens = np.concatenate([m[3] for m in members])
    order = np.argsort(tokens, kind="stable")
    holder = np.repeat(np.arange(len(members)), [len(m[3]) for m in members])[order]
    tokens = tokens[order]
    nids, sizes, labels = (np.array([m[k] for m in members], np.int64) for k in range(3))
    common, whole = how.common(sizes), sizes == np.array([len(m[3]) for m in members])
    union, links, unsure = Union(), [], []
    for nid, n, label, pool in queries:
        fits = (100 * np.minimum(sizes, n) >= how.numerator * np.maximum(sizes, n)) & (labels != label)
        if own:
            fits &= nids > nid
        if not fits.any():
            continue
        first, last = np.searchsorted(tokens, pool, "left"), np.searchsorted(tokens, pool, "right")
        spans = [holder[a:b] for a, b in zip(first[first < last], last[first < last], strict=True)]
        both = np.bincount(np.concatenate(spans), minlength=len(members)) if spans else np.zeros(len(members), np.int64)
        fits &= both >= np.minimum(common, how.common(n))
        known = fits & whole & (len(pool) == n)
        if (fits & ~known).any():
            unsure.append(nid)
        for j in np.flatnonzero(known & (100 * both >= how.numerator * (n + sizes - both))):
            if union.root(label) != union.root(int(labels[j])):
                union.join(label, int(labels[j]))
                links.append((nid, int(nids[j])))
    return links, unsure


def opened(wanted: DataFrame, nodes: DataFrame, tokens: DataFrame, how: Join) -> DataFrame:
    """Queries and the groups they open (``nid, gid``) to ``a, b, gid``: links, and with a null ``b``
    queries ``a`` that must meet the group with whole sets. ``tokens`` holds ``nid, pool``. Stored.

    Queries of a group come in blocks; its nodes meet each of them.
    """
    full = nodes.join(tokens, "nid")
    sized = wanted.join(nodes.select("nid", "n"), "nid")
    blocks = store(sized.groupBy("gid").agg(_pieces(how.query_rows, how).alias("blocks")), "blocks")
    queries = wanted.join(blocks, "gid").withColumn("block", F.pmod(F.xxhash64("nid"), "blocks").cast("int")).select("gid", "block", "nid")
    own = F.col("gid") == F.col("home")
    queries = queries.join(full.withColumnRenamed("gid", "home"), "nid")
    # Other names than those of the members, which come from the same tables.
    columns = ("gid", "block", "nid", "n", "label", "pool")
    queries = queries.select(*[F.col(c).alias(f"q_{c}") for c in columns], own.alias("own"))
    members = full.join(blocks, "gid").withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    members = members.select("gid", "block", "nid", "n", "label", "pool")

    def meet(members: pa.Table, queries: pa.Table) -> pa.Table:
        from tactile.llm.jaccard import open_group

        def rows(table, start):
            sets = [np.sort(p.values.to_numpy()) for p in table.column(f"{start}pool")]
            return list(zip(*(table.column(start + c).to_pylist() for c in ("nid", "n", "label")), sets, strict=True))

        held, asked, found = rows(members, ""), rows(queries, "q_"), []
        if held and asked:
            inside = queries.column("own").to_pylist()
            for own in (True, False):
                part = [q for q, i in zip(asked, inside, strict=True) if i == own]
                links, unsure = open_group(held, part, own, how) if part else ([], [])
                found += links + [(nid, None) for nid in unsure]
        gid = members.column("gid")[0].as_py() if held else None
        ends = [pa.array([p[x] for p in found], pa.int64()) for x in (0, 1)]
        return pa.table({"a": ends[0], "b": ends[1], "gid": pa.array([gid] * len(found), pa.int64())})

    met = members.groupBy("gid", "block").cogroup(queries.groupBy("q_gid", "q_block")).applyInArrow(meet, "a long, b long, gid long")
    return store(met, "opened")


def texts_of(nids: DataFrame, nodes: DataFrame, docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """``nid, node, text`` of distinct nodes; stored. A repeated ``doc_id`` may bring other texts along,
    which the digest of the set tells."""
    needed = store(nids.join(nodes, "nid").select("nid", "node", F.col("rep").alias("doc_id")), "needed")
    whole = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("binary").alias("text"))
    return store(whole.join(small(needed, needed.count()), "doc_id").select("nid", "node", "text"), "texts")


def whole_sets(texts: DataFrame, how: Join) -> DataFrame:
    """``nid, pool`` with all tokens of the nodes; stored."""

    def run(batches):
        from tactile.llm.neardup import digest, shingle_sets

        for batch in batches:
            for start, part in text_slices(batch.column(2)):
                sets = shingle_sets(part.to_pylist(), how.words)
                nodes = batch.column(1).slice(start, len(sets)).to_pylist()
                same = pa.array([digest(s) == n for s, n in zip(sets, nodes, strict=True)], pa.bool_())
                pools = pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(start, len(sets)), pools], ["nid", "pool"]).filter(same)

    found = texts.select("nid", "node", "text").mapInArrow(run, "nid long, pool array<long>")
    return store(found.dropDuplicates(["nid"]), "whole")


def near_ngrams(docs: DataFrame, how: Join = DEFAULT, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_shingles, component_id`` for every row of ``docs``: the size of its set, and the
    smallest ``doc_id`` that links lead to."""
    sets = pooled(docs, how, doc_id, text)
    named = sets.where(F.col("doc_id").isNotNull() & F.col("node").isNotNull())
    nodes = named.groupBy("node").agg(F.min(F.struct("doc_id", "row")).alias("rep"), F.first("n").alias("n"))
    nodes = nodes.select("node", F.col("rep.doc_id").alias("rep"), F.col("rep.row").alias("row"), "n", F.col("rep.row").alias("nid"))
    nodes = store(nodes, "nodes")
    lists = listed(sets, nodes, how)
    near = homes(lists)

    links, labels = None, None
    fits = near.where((F.col("nid") != F.col("head")) & _alike(F.col("n"), F.col("head_n"), how))
    tried = None
    for _ in range(how.rounds):
        rows = with_labels(with_labels(fits, labels), labels, "head", "head_label").where("label <> head_label")
        pairs = _best_head(rows).select(F.col("head").alias("a"), F.col("nid").alias("b"))
        if tried is not None:
            pairs = pairs.join(tried, ["a", "b"], "left_anti")
        pairs = store(pairs, "tried")
        found = confirm(pairs, nodes, docs, how, doc_id, text)
        tried = pairs if tried is None else tried.unionByName(pairs)
        links = found if links is None else links.unionByName(found)
        labels = components(links) if links.limit(1).count() else None

    rows = with_labels(lists.select("token", "nid", "n"), labels)
    rows = store(rows, "labelled")
    still = rows.groupBy("token").agg(F.min("label").alias("least"), F.max("label").alias("most")).where("least <> most")
    rows = store(rows.join(store(still.select("token"), "open_tokens"), "token"), "open")
    open_nodes, matrix, bounds = token_group_matrix(rows, _best_head(near), how)
    wanted = qualifying(rows, open_nodes, matrix, bounds, how)
    pools = sets.join(nodes.select("row", "nid"), "row").select("nid", "pool")
    met = opened(wanted, open_nodes, pools, how)
    # Groups of larger sets are opened again, with the whole sets of those that the pools let through.
    again = store(met.where("b is null").select(F.col("a").alias("nid"), "gid").distinct(), "again")
    inside = open_nodes.join(again.select("gid").distinct(), "gid").select("nid")
    texts = texts_of(again.select("nid").unionByName(inside).distinct(), nodes, docs, doc_id, text)
    met = met.unionByName(opened(again, open_nodes, whole_sets(texts, how), how))
    links = links.unionByName(met.where("b is not null").select("a", "b"))
    labels = components(links) if links.limit(1).count() else None

    known = store(with_labels(nodes.select("node", "nid", "rep"), labels), "members")
    first = store(known.groupBy("label").agg(F.min("rep").alias("component_id")), "components")
    ids = store(known.join(first, "label").select("node", "component_id"), "ids")
    rows = sets.select("doc_id", "n", "node").join(ids, "node", "left")
    return rows.select(
        "doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component_id", "doc_id")).alias("component_id")
    )
