"""Mixing sources to target weights.

Every document has a hash-random key. Within a source the documents are range-sorted by it, and
distributed prefix sums of their sizes say where the source's budget ends: whole epochs first,
then the documents before the cut, then as many words of the document at the cut as are left.

Sources are numbered by code point, null last; the number decides the weight. A target is the
weight's part of ``share`` times all sizes, but at most ``epochs`` times the size of its source;
what is over is dealt again by weight until no source is above.

Results: null texts and blank texts have size 0 and are taken 0 times. Repeated rows are separate
documents. Null sources are one source. Reruns agree, as keys depend on ``doc_id``, text and seed
only. No table of the result is empty unless the input is. Of rows equal in id, text and source one
stands for all where texts are written. Other columns are kept, whatever their names. ``targets`` works
on one row a source in one task: sources are meant to be tens, not one for each host.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window, functions as F

from tactile.llm.common import SPACE, free_name, n_words, prefix_sums, store

WEIGHTS = (5, 2, 1)


@dataclass(frozen=True)
class Mix:
    weights: tuple[int, ...] = WEIGHTS
    share: float = 1.5
    epochs: int = 2
    seed: str = "mix"


DEFAULT = Mix()


def random_key(doc_id: Column, text: Column, seed: str) -> Column:
    parts = [F.lit(seed), doc_id.cast("string"), text]
    return F.md5(F.concat_ws(":", *[F.coalesce(p, F.lit("")) for p in parts]))


def targets(sizes: DataFrame, mix: Mix = DEFAULT) -> DataFrame:
    """``source, ordinal, source_size, target`` from ``source, source_size``: one row a source.

    With sources in order of how much a unit of weight may get (cap / weight), the ones that
    stop at their cap come first; the level is what is left by weight among the others. Prefix
    sums of that order give it without rounds.
    """
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, mix.weights)), F.col("ordinal") % len(mix.weights) + 1)
    rows = sizes.withColumn("ordinal", F.row_number().over(by_name) - 1).withColumn("w", weight)
    rows = rows.withColumn("cap", F.col("source_size") * mix.epochs)
    filled = Window.orderBy(F.col("cap") / F.col("w"), "ordinal")
    before = filled.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    rows = (
        rows.withColumn("all", F.sum("source_size").over(everything))
        .withColumn("all_w", F.sum("w").over(everything))
        .withColumn("capped", F.coalesce(F.sum("cap").over(before), F.lit(0)))
        .withColumn("capped_w", F.coalesce(F.sum("w").over(before), F.lit(0)))
        .withColumn("level", (F.col("all") * mix.share - F.col("capped")) / (F.col("all_w") - F.col("capped_w")))
        # The first source that stays under its cap fixes the level of all after it.
        .withColumn("free", F.when(F.col("level") * F.col("w") < F.col("cap"), F.col("level")))
        .withColumn("level", F.first("free", ignorenulls=True).over(filled.rowsBetween(Window.unboundedPreceding, 0)))
    )
    target = F.least(F.coalesce(F.col("level") * F.col("w"), F.col("cap").cast("double")), F.col("cap").cast("double"))
    return rows.select("source", "ordinal", "source_size", target.alias("target"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", plan: Mix = DEFAULT) -> DataFrame:
    """``doc_id, source, text_key, size, source_size, target, taken``, one row per document."""
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        F.col(source).alias("source"),
        random_key(F.col(doc_id), F.col(text), plan.seed).alias("text_key"),
        n_words(F.col(text)).alias("size"),
    )
    rows = store(rows, "mix")
    sources = store(targets(rows.groupBy("source").agg(F.sum("size").alias("source_size")), plan), "targets")
    rows = rows.join(sources.withColumnRenamed("source", "_source"), F.col("source").eqNullSafe(F.col("_source")))
    rows = prefix_sums(rows.drop("_source"), "ordinal", ["text_key", "doc_id"], {"before": "size"})
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rest = F.greatest(F.lit(0), F.least(F.col("size"), budget - whole * F.col("source_size") - F.col("before")))
    taken = (whole * F.col("size") + rest).cast("long")
    return rows.select("doc_id", "source", "text_key", "size", "source_size", "target", taken.alias("taken"))


def first_words(text: Column, n: Column) -> Column:
    """The text up to the end of its ``n``-th word."""
    pieces = F.split(text, r"(?<=[\x20\x09-\x0D])(?=[^\x20\x09-\x0D])")
    blank = F.when(F.element_at(pieces, 1).rlike(r"^[\x20\x09-\x0D]*$"), 1).otherwise(0)
    kept = F.array_join(F.slice(pieces, F.lit(1), (n + blank).cast("int")), "")
    return F.regexp_replace(kept, r"[\x20\x09-\x0D]+$", "")


def apply(docs: DataFrame, plan: Mix = DEFAULT, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed documents: a row per copy that is taken, the cut one with its first words only;
    same columns as ``docs``."""
    rows = mix(docs, doc_id, text, source, plan).where(F.col("taken") > 0)
    size, taken = F.col("size"), F.col("taken")
    # Rows equal in id, text and source are interchangeable: their copies are added up. A source is
    # cut in one row at most.
    wanted = rows.groupBy(F.col("text_key").alias("key"), _named(F.col("source")).alias("of")).agg(
        F.sum(F.floor(taken / size)).cast("int").alias("whole"), F.max(taken % size).alias("words")
    )
    own, of, cut, copy = (free_name(docs, n) for n in ("own", "of", "cut", "copy"))
    keyed = docs.withColumns({own: random_key(F.col(doc_id), F.col(text), plan.seed), of: _named(F.col(source))})
    wanted = wanted.select(F.col("key").alias(own), F.col("of").alias(of), F.struct("whole", "words").alias(cut))
    joined = keyed.dropDuplicates([own, of]).join(wanted, [own, of])
    words = F.col(cut)["words"]
    last = F.when(words > 0, F.array(first_words(F.col(text), words))).otherwise(F.array().cast("array<string>"))
    copies = F.concat(F.array_repeat(F.col(text), F.col(cut)["whole"]), last)
    out = joined.withColumn(copy, F.explode(copies)).withColumn(text, F.col(copy))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length(text).cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def _named(source: Column) -> Column:
    """A source as a key of a join: null is not empty."""
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit(""))
