"""Recognition results: choice between engines, defaults, words."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, functions as F

from tactile.functions import geometry, text as txt

# Confidence where an engine gives none.
FIRST_ENGINE_CONFIDENCE = 90.0
SECOND_ENGINE_CONFIDENCE = 85.0

WORD = (
    "struct<text:string,bbox:struct<x0:double,y0:double,x1:double,y1:double>,confidence:double>"
)
NO_WORDS = f"array<{WORD}>"


def _words(words: Column) -> Column:
    return F.coalesce(words.cast(NO_WORDS), F.array().cast(NO_WORDS))


def choose_engine(
    images: DataFrame, results: DataFrame, counted: bool = False, words: Column | None = None
) -> DataFrame:
    """J5, P4, F4. ``results``: image, engine_rank (1 or 2), text, confidence, words. The first
    engine counts if its text is not blank, then the second, blank or not, then an empty result.

    The rank is chosen on narrow rows; texts and words then follow by a hash join whose table
    holds only images and ranks, so no wide row is aggregated or sorted. There is one row per
    image and engine. Texts are cleaned up after the choice. ``counted`` gives the number of words
    instead of the words, which then do not go through the join.

    ``words``, an expression over the columns of ``results``, lists words that are no column yet. It
    is evaluated for chosen results only, behind the join, and may give them in a form of its own.
    """
    rank = F.col("engine_rank")
    if words is None:
        listed = _words(F.col("words"))
        results = results.withColumn("words", F.size(listed) if counted else listed)
        words = F.coalesce("words", F.lit(0)) if counted else _words(F.col("words"))
    else:
        words = F.coalesce(words, F.array())
        words = F.size(words) if counted else words
    both = results.where(((rank == 1) & ~txt.is_blank(F.col("text"))) | (rank == 2))
    ranks = both.groupBy("image").agg(F.min("engine_rank").alias("engine_rank"))
    winners = images.select("image").join(ranks, "image", "left")
    chosen = winners.hint("shuffle_hash").join(both, ["image", "engine_rank"], "left")
    given = F.when(F.col("confidence") != 0, geometry.round_up_half(F.col("confidence")))
    return chosen.select(
        "image",
        F.coalesce("engine_rank", F.lit(0)).alias("engine_rank"),
        F.when(rank == 1, F.col("text"))
        .otherwise(F.coalesce(txt.second_engine_cleanup(F.col("text")), F.lit("")))
        .alias("text"),
        F.when(rank == 1, F.coalesce("confidence", F.lit(FIRST_ENGINE_CONFIDENCE)))
        .when(rank == 2, F.coalesce(given.cast("double"), F.lit(SECOND_ENGINE_CONFIDENCE)))
        .otherwise(0.0)
        .alias("confidence"),
        words.alias("words"),
    )


def words_of(results: DataFrame, word: Callable[[Column, Column], Column] | None = None) -> DataFrame:
    """J6, P4, P5. One row per word, trimmed; a word without confidence takes that of the whole
    result; ``drawable`` says whether its box has an area. ``word`` makes a word of an entry of
    ``words`` in another form, and of its number: in rows of their own that runs compiled, in a list not.

    The outer form of the explosion, as the plain one brings a filter on the number of words, for
    which words that are an expression are listed once more, down to results that are not chosen."""
    overall = F.col("confidence")
    exploded = results.select("image", overall, F.posexplode_outer("words").alias("word_idx", "w"))
    exploded = exploded.where(F.col("word_idx").isNotNull())
    if word is not None:
        exploded = exploded.withColumn("w", word(F.col("w"), F.col("word_idx")))
    own = F.col("w.confidence")
    return exploded.select(
        "image",
        "word_idx",
        F.coalesce(txt.browser_trim(F.col("w.text")), F.lit("")).alias("text"),
        F.when(own.isNull() | (own == 0), overall).otherwise(own).alias("confidence"),
        geometry.drawable(*[F.col(f"w.bbox.{c}") for c in ("x0", "y0", "x1", "y1")]).alias("drawable"),
    )


def word_badges(results: DataFrame) -> DataFrame:
    """A20. Number of words and rounded overall confidence, 90 where there is none."""
    overall = F.coalesce("confidence", F.lit(FIRST_ENGINE_CONFIDENCE))
    return results.select(
        "image",
        F.size("words").alias("words"),
        geometry.round_up_half(overall).cast("int").alias("confidence"),
    )


def result_json(results: DataFrame) -> DataFrame:
    """S6. The result object as JSON text."""
    return results.select(
        "image", F.to_json(F.struct("text", "confidence", "words")).alias("json")
    )


def gate(
    results: DataFrame, text: str = "text", minimum: float = txt.MIN_CONFIDENCE
) -> DataFrame:
    """F1-F3, P6-P8. Adds the clean text, whether it is accepted, its band and its snippet."""
    clean = F.col("clean_text")
    return (
        results.withColumn("clean_text", txt.normalize(F.col(text)))
        .withColumn("accepted", txt.accepted(clean, F.col("confidence"), minimum))
        .withColumn("band", txt.confidence_band(F.col("confidence"), minimum))
        .withColumn("snippet", txt.snippet(clean))
    )
