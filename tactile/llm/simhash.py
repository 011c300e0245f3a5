"""SimHash fingerprints and permuted block tables, in DataFrame operations only.

A term is a word, A-Z lowered; its weight in the vote is the number of its characters, at most
``MOST_WEIGHT``, once per occurrence. Every bit of its hash votes for or against the same bit of
the fingerprint. Two counters of 32 bits share a long, so 32 sums make the 64 votes; a counter is
at most the number of characters of the text, which is under 2^31.

``within`` finds all fingerprints in a Hamming radius: the bits are cut into ``radius + 3`` blocks,
and two fingerprints in the radius agree in at least three of them, so they meet in one of the
tables that bring three blocks to the front as a key of some 32 bits.

Results: a null or blank text has fingerprint 0; equal texts have equal fingerprints; documents in
order of ``doc_id`` (nulls first), repeated ones in order of their text; the only document of a
table follows itself.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.llm.common import SPACE, ascii_lower, store

BITS = 64
LANES = 32
BOTH = 0x100000001
MOST_WEIGHT = 8
FAN = 64  # buckets of the order are found in two steps of so many bounds
ROWS_PER_BUCKET = 500


def fingerprints(rows: DataFrame, keys: list[str], text: Column) -> DataFrame:
    """``keys, fingerprint`` (a long) of the texts; ``keys`` identify a row. Rows that have their
    ``keys`` in one partition already are not moved."""
    terms = rows.select(*keys, F.explode(F.split(ascii_lower(text), SPACE)).alias("_term"))
    # A blank piece has no weight: the row of a text without terms stays.
    terms = terms.select(*keys, F.xxhash64("_term").alias("_h"), F.least(F.length("_term"), F.lit(MOST_WEIGHT)).cast("long").alias("_w"))
    votes = [
        F.sum(F.shiftrightunsigned("_h", j).bitwiseAND(F.lit(BOTH)) * F.col("_w")).alias(f"_v{j}") for j in range(LANES)
    ]
    sums = terms.groupBy(*keys).agg(F.sum("_w").alias("_all"), *votes)
    low = F.lit(0).cast("long")
    for j in range(LANES):
        for lane, count in ((j, F.col(f"_v{j}").bitwiseAND(F.lit(0xFFFFFFFF))), (j + 32, F.shiftrightunsigned(f"_v{j}", 32))):
            bit = F.lit(1 << lane if lane < 63 else -(1 << 63)).cast("long")
            low = low.bitwiseOR(F.when(count * 2 > F.col("_all"), bit).otherwise(F.lit(0).cast("long")))
    return sums.select(*keys, low.alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(float(BITS))


def as_text(fingerprint: Column) -> Column:
    return F.lpad(F.lower(F.hex(fingerprint)), BITS // 4, "0")


def _bucket(value: Column, bounds: list[int]) -> Column:
    """Number of ``bounds`` up to ``value``, found among every ``FAN``-th first."""
    if not bounds:
        return F.lit(0)
    groups = [bounds[i : i + FAN] for i in range(0, len(bounds), FAN)]

    def up_to(array: Column) -> Column:
        return F.size(F.filter(array, lambda b: b <= value))

    def longs(values: list[int]) -> Column:
        return F.array(*[F.lit(v).cast("long") for v in values])

    coarse = up_to(longs([g[0] for g in groups]))
    fine = up_to(F.element_at(F.array(*map(longs, groups)), F.greatest(coarse, F.lit(1))))
    return F.when(value.isNull() | (coarse == 0), 0).otherwise((coarse - 1) * FAN + fine)


def in_order(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``bucket, place, doc_id, text, next_text``: each document with the text of the next one by
    ``doc_id``; (``bucket``, ``place``) rises with it. Texts are shuffled once, by bucket."""
    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(text, F.lit("")).alias("text"))
    n = rows.select("doc_id").count()
    n_buckets = max(1, min(FAN * FAN, n // ROWS_PER_BUCKET))
    shares = [i / n_buckets for i in range(1, n_buckets)]
    found = rows.select("doc_id").approxQuantile("doc_id", shares, 0.2 / n_buckets) if shares else []
    rows = rows.withColumn("bucket", _bucket(F.col("doc_id"), sorted({int(b) for b in found})))

    # First rows of the buckets: at most FAN * FAN, and those with the same doc_id.
    first = rows.groupBy("bucket").agg(F.min(F.struct("doc_id")).alias("first"))
    first = store(first.select("bucket", F.col("first.doc_id").alias("first_id")), "first")
    heads = rows.join(
        F.broadcast(first.withColumnRenamed("bucket", "_bucket")),
        (F.col("bucket") == F.col("_bucket")) & F.col("doc_id").eqNullSafe(F.col("first_id")),
    )
    heads = store(heads.groupBy("bucket").agg(F.min("text").alias("head")), "heads")
    along = Window.orderBy("bucket")
    around = F.first("head").over(along)
    after = heads.select("bucket", F.coalesce(F.lead("head").over(along), around).alias("after"))

    in_bucket = Window.partitionBy("bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text")
    rows = rows.withColumns({"place": F.row_number().over(in_bucket), "_next": F.lead("text").over(in_bucket)})
    rows = rows.join(store(after, "after").hint("merge"), "bucket")
    return rows.select("bucket", "place", "doc_id", "text", F.coalesce("_next", "after").alias("next_text"))


def edited(text: Column, next_text: Column) -> Column:
    """The last half of the code points replaced by the first of the next text."""
    half = F.floor(F.length(text) / 2).cast("int")
    return F.concat(F.substring(text, F.lit(1), F.length(text) - half), F.substring(next_text, F.lit(1), half))


def compare(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint``, stored."""
    rows = in_order(docs, doc_id, text).select(
        "bucket",
        "place",
        "doc_id",
        F.length("text").cast("long").alias("n_chars"),
        "text",
        edited(F.col("text"), F.col("next_text")).alias("edited"),
    )
    both = rows.withColumn("edited_sha256", F.sha2(F.col("edited").cast("binary"), 256)).select(
        "bucket",
        "place",
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.posexplode(F.array("text", "edited")).alias("which", "version"),
    )
    keys = ["bucket", "place", "doc_id", "n_chars", "edited_sha256"]
    hashed = fingerprints(both, [*keys, "which"], F.col("version"))
    pick = [F.max(F.when(F.col("which") == i, F.col("fingerprint"))).alias(c) for i, c in enumerate(("fingerprint", "edited_fingerprint"))]
    hashed = store(hashed.groupBy(*keys).agg(*pick), "fingerprints")

    firsts = hashed.groupBy("bucket").agg(F.min_by("fingerprint", "place").alias("head"))
    along = Window.orderBy("bucket")
    after = firsts.select("bucket", F.coalesce(F.lead("head").over(along), F.first("head").over(along)).alias("after"))
    following = F.lead("fingerprint").over(Window.partitionBy("bucket").orderBy("place"))
    rows = hashed.withColumn("_next", following).join(F.broadcast(after), "bucket")
    return store(
        rows.select(
            "doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint",
            F.coalesce("_next", "after").alias("next_fingerprint"),
        ),
        "compared",
    )


def block_keys(fingerprint: Column, radius: int) -> list[Column]:
    """For each table, its number and the blocks that it brings to the front."""
    blocks = radius + 3
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    parts = [F.shiftrightunsigned(fingerprint, a).bitwiseAND(F.lit((1 << (b - a)) - 1)) for a, b in zip(cuts, cuts[1:], strict=False)]
    widths = [b - a for a, b in zip(cuts, cuts[1:], strict=False)]
    keys = []
    for table, chosen in enumerate(combinations(range(blocks), 3)):
        key = F.lit(0).cast("long")
        for i in chosen:
            key = F.shiftleft(key, widths[i]).bitwiseOR(parts[i])
        keys.append(F.struct(F.lit(table).alias("block_table"), key.alias("key")))
    return keys


def within(queries: DataFrame, all_rows: DataFrame, radius: int = 3) -> DataFrame:
    """Pairs ``query, fingerprint, distance`` of different longs in the radius, each once;
    both inputs have a column ``fingerprint``."""
    def tables(rows: DataFrame, name: str) -> DataFrame:
        rows = rows.select(F.col("fingerprint").alias(name)).distinct()
        keyed = rows.select(name, F.explode(F.array(*block_keys(F.col(name), radius))).alias("k"))
        return keyed.select(name, "k.block_table", "k.key")

    distance = F.bit_count(F.col("query").bitwiseXOR(F.col("fingerprint")))
    left, right = tables(queries, "query"), tables(all_rows, "fingerprint")
    same = (left.block_table == right.block_table) & (left.key == right.key)
    pairs = left.join(right, same & (distance <= radius) & (F.col("query") != F.col("fingerprint")))
    return pairs.select("query", "fingerprint", distance.alias("distance")).distinct()


def neighbours(compared: DataFrame, every: int = 20, radius: int = 3) -> DataFrame:
    """``compared`` with ``n_within``: for each row whose id ``every`` divides, how many other
    documents have a fingerprint in the radius; null for the others."""
    is_query = F.coalesce(F.col("doc_id") % every == 0, F.lit(False))
    sizes = store(compared.groupBy("fingerprint").agg(F.count(F.lit(1)).alias("rows")), "sizes")
    queries = compared.where(is_query).select("fingerprint").distinct()
    pairs = within(queries, sizes, radius).join(sizes, "fingerprint")
    others = pairs.groupBy(F.col("query").alias("fingerprint")).agg(F.sum("rows").alias("others"))
    own = sizes.join(queries, "fingerprint", "left_semi").join(others, "fingerprint", "left")
    counts = own.select(F.col("fingerprint").alias("_f"), (F.col("rows") - 1 + F.coalesce("others", F.lit(0))).alias("_n"))
    rows = compared.join(store(counts, "counts"), (F.col("fingerprint") == F.col("_f")) & is_query, "left")
    return rows.select(*compared.columns, F.col("_n").alias("n_within"))
