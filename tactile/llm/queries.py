"""A query per operator over its whole table, and SQL where SQL can say the same."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from tactile.llm import align, bpe, jaccard, language, lm, merkle, mixing, neardup, reshard, simhash, topk, unigram, warc
from tactile.llm.common import remainder, table

RANKS = "byte_bpe_50k.tiktoken"
PIECES = "piece_bpe_32k.model"
BYTE_ENTRIES = "byte_bpe_50k.json"
OLD_SHARDS, NEW_SHARDS = 16, 24


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = simhash.neighbours(simhash.compare(table(spark, sf_dir, "documents")))
    own = F.col("fingerprint")
    return rows.select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        simhash.as_text(own).alias("fingerprint"),
        simhash.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"),
        simhash.likeness(own, F.col("edited_fingerprint")).alias("near_edited"),
        simhash.likeness(own, F.col("next_fingerprint")).alias("near_next"),
        "n_within",
    )


def op2_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    docs = docs.withColumn("held_out", remainder(F.col("doc_id"), 10) == 0)
    model = lm.train(docs.where("not held_out"))
    scored = lm.score(docs, model, ["doc_id", "held_out"])
    return scored.select(
        "doc_id",
        "held_out",
        "n_tokens",
        "n_known",
        F.lit(model.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op3_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(table(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


def op4_token_counts(spark: SparkSession, sf_dir: str, model: str | None = None) -> DataFrame:
    vocab = unigram.Vocabulary.of(model or public_tokenizers.path(PIECES))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    counted = docs.select("doc_id", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("n_chars"), unigram.token_counts(docs, vocab).alias("found"))
    return counted.select("doc_id", "n_chars", F.col("found.tokens").alias("n_tokens"), F.col("found.score").alias("score"))


def op5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = neardup.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id", "kept")


def op6_reshard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The old layout deals documents by a checksum of their id to 16 shards."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    old = F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % OLD_SHARDS
    rows = reshard.keyed(docs, old)
    transfers, blocks = reshard.plan(rows, None, NEW_SHARDS)
    if blocks is None:
        shards = rows.withColumn("shard", F.lit(0))
    else:
        # Only a third of the new shards did not exist; all lose or gain a block.
        folder = reshard.rewrite(reshard.assign(rows, blocks), ["doc_id", "text"], sum(t.size for t in transfers), NEW_SHARDS)
        shards = spark.read.schema("doc_id long, text string, shard int").parquet(folder)
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + reshard.FIXED_BYTES).cast("long")
    crc = F.crc32(F.coalesce(F.col("text"), F.lit("")).cast("binary"))
    found = shards.select("doc_id", size.alias("size"), crc.alias("text_crc32"), "shard")
    return reshard.slots(found, ["doc_id", "text_crc32", "size"]).select(
        "doc_id",
        "size",
        "text_crc32",
        F.lit("bytes").alias("law"),
        "shard",
        F.col("slot").cast("long").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"),
    )


def op7_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").where(topk.usable(F.col("embedding")))
    terms = rows.select(F.col("vec_id").cast("long").alias("vec_id"), topk.whole_terms(F.col("embedding")).alias("terms"))
    return topk.top_k(terms, F.col("vec_id") % 20 == 0)


def op8_byte_bpe(spark: SparkSession, sf_dir: str, ranks: str | None = None) -> DataFrame:
    vocab = bpe.vocabulary(ranks or public_tokenizers.path(RANKS), public_tokenizers.PATTERN)
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    coded = bpe.round_trip(docs, vocab)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = warc.classified(table(spark, sf_dir, "pages"))
    records = warc.read_back(warc.normalise(warc.write_archives(rows)))
    return records.drop("payload")


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = (remainder(F.col("doc_id"), 5) == 0).alias("held_out")
    model = language.fit(docs.where(~held_out))
    found = docs.select("doc_id", held_out, language.identify(docs, model).alias("found"))
    return found.select(
        "doc_id",
        "held_out",
        F.col("found.lang").alias("lang_pred"),
        F.col("found.score").alias("score"),
        F.col("found.switches").alias("switches"),
    )


def op11_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_ngrams(table(spark, sf_dir, "documents"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"))


def op13_alignment(spark: SparkSession, sf_dir: str, first: str | None = None, second: str | None = None) -> DataFrame:
    files = align.Tokenizers.read(first or public_tokenizers.path(BYTE_ENTRIES), second or public_tokenizers.path(PIECES))
    found = align.align(table(spark, sf_dir, "documents"), files)
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


QUERIES = {
    "op1_simhash": op1_simhash,
    "op2_lm_score": op2_lm_score,
    "op3_mixing": op3_mixing,
    "op4_token_counts": op4_token_counts,
    "op5_near_duplicates": op5_near_duplicates,
    "op6_reshard": op6_reshard,
    "op7_top_k": op7_top_k,
    "op8_byte_bpe": op8_byte_bpe,
    "op9_warc": op9_warc,
    "op10_language": op10_language,
    "op11_ngram_join": op11_ngram_join,
    "op12_merkle": op12_merkle,
    "op13_alignment": op13_alignment,
}

ORACLES = {
    "op12_merkle": r"""
        WITH RECURSIVE steps AS (
            -- Table of the reflected CRC-32.
            SELECT list(list_reduce([CAST(i AS UBIGINT)] || list_transform(range(8), lambda x: CAST(x AS UBIGINT)),
                lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) ORDER BY i) AS crc
            FROM range(256) t(i)
        ), d AS (
            SELECT doc_id, lang, text, translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS lower_text,
                concat_ws('', CASE WHEN doc_id IS NULL THEN '-' ELSE concat(octet_length(encode(CAST(doc_id AS VARCHAR))), ':', doc_id) END,
                    CASE WHEN source IS NULL THEN '-' ELSE concat(octet_length(encode(source)), ':', source) END,
                    CASE WHEN lang IS NULL THEN '-' ELSE concat(octet_length(encode(lang)), ':', lang) END,
                    CASE WHEN n_chars IS NULL THEN '-' ELSE concat(octet_length(encode(CAST(n_chars AS VARCHAR))), ':', n_chars) END) AS head,
                list_transform(string_split(coalesce(CAST(doc_id AS VARCHAR), ''), ''), lambda ch: CAST(ascii(ch) AS UBIGINT)) AS bytes
            FROM documents
        ), l AS (
            SELECT doc_id, coalesce('=' || lang, '') AS key,
                sha256(head || CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(text)), ':', text) END) AS leaf,
                sha256(head || CASE WHEN text IS NULL THEN '-' ELSE concat(octet_length(encode(lower_text)), ':', lower_text) END) AS changed,
                xor(list_reduce([4294967295::UBIGINT] || CASE WHEN doc_id IS NULL THEN [] ELSE bytes END,
                    lambda c, b: xor(crc[CAST(xor(c, b) & 255 AS BIGINT) + 1], c >> 8)), 4294967295::UBIGINT) % 3 = 0 AS tampered
            FROM d, steps
        ), r AS (
            SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id NULLS FIRST, leaf) - 1 AS place,
                count(*) OVER (PARTITION BY key) AS total FROM l
        ), nodes AS (
            SELECT key, 0 AS level, place, leaf AS digest, total FROM r
            UNION ALL
            SELECT key, level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(total) + 7) // 8
            FROM nodes WHERE total > 1 GROUP BY key, level, place // 8
        ), subroots AS (
            SELECT key, digest AS subroot, row_number() OVER (ORDER BY key) - 1 AS place, count(*) OVER () AS total
            FROM nodes WHERE total = 1
        ), tops AS (
            SELECT 0 AS level, place, subroot AS digest, total FROM subroots
            UNION ALL
            SELECT level + 1, place // 8, sha256(string_agg(digest, '' ORDER BY place)), (any_value(total) + 7) // 8
            FROM tops WHERE total > 1 GROUP BY level, place // 8
        ), sides AS (
            SELECT key, level, place,
                coalesce(string_agg(digest, '') OVER (PARTITION BY key, level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(digest, '') OVER (PARTITION BY key, level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM nodes WHERE total > 1
        ), top_sides AS (
            SELECT level, place,
                coalesce(string_agg(digest, '') OVER (PARTITION BY level, place // 8 ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before,
                coalesce(string_agg(digest, '') OVER (PARTITION BY level, place // 8 ORDER BY place ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
            FROM tops WHERE total > 1
        ), up AS (
            SELECT r.key, r.place AS own, 0 AS level, r.place, '' AS proof, CASE WHEN tampered THEN changed ELSE leaf END AS x, total FROM r
            UNION ALL
            SELECT up.key, own, up.level + 1, up.place // 8, proof || before || after, sha256(before || x || after), (total + 7) // 8
            FROM up JOIN sides s ON s.key = up.key AND s.level = up.level AND s.place = up.place
            WHERE total > 1
        ), rest AS (
            SELECT up.key, own, 0 AS level, s.place, proof, x, s.total FROM up JOIN subroots s ON s.key = up.key WHERE up.total = 1
            UNION ALL
            SELECT rest.key, own, rest.level + 1, rest.place // 8, proof || before || after, sha256(before || x || after), (total + 7) // 8
            FROM rest JOIN top_sides s ON s.level = rest.level AND s.place = rest.place
            WHERE total > 1
        )
        SELECT r.doc_id, r.leaf, s.subroot, t.digest AS root, sha256(rest.proof) AS proof_sha256, rest.x AS folded_root, rest.x = t.digest AS verified
        FROM r JOIN subroots s ON s.key = r.key JOIN rest ON rest.key = r.key AND rest.own = r.place AND rest.total = 1
        JOIN tops t ON t.total = 1
    """,
    "op7_top_k": """
        WITH v AS (
            SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS t
            FROM embeddings
            WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
        ), s AS (
            SELECT q.vec_id AS query_id, c.vec_id,
                CAST(list_sum(list_transform(list_zip(q.t, c.t), lambda p: p[1] * p[2])) AS BIGINT) AS score
            FROM v q JOIN v c ON q.vec_id <> c.vec_id
            WHERE q.vec_id % 20 = 0
        ), r AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank FROM s
        )
        SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
    """,
    "op9_warc": """
        WITH p AS (
            SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
        ), f AS (
            SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first FROM p
        )
        SELECT page_id, payload_bytes, payload_digest,
            CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type,
            CASE WHEN page_id > first THEN first END AS refers_to
        FROM f
    """,
    "op3_mixing": r"""
        WITH d AS (
            SELECT doc_id, source,
                md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')) AS k,
                CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
            FROM documents
        ), s AS (
            SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
                row_number() OVER (ORDER BY source NULLS LAST) - 1 AS ordinal
            FROM d GROUP BY source
        ), w AS (
            SELECT *, [5, 2, 1][CAST(ordinal % 3 + 1 AS INT)] AS w, 2 * source_size AS cap FROM s
        ), f AS (
            SELECT *, (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE)
                - CAST(coalesce(sum(cap) OVER before, 0) AS DOUBLE))
                / CAST(sum(w) OVER () - coalesce(sum(w) OVER before, 0) AS DOUBLE) AS level
            FROM w
            WINDOW before AS (ORDER BY CAST(cap AS DOUBLE) / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
        ), g AS (
            SELECT *, first_value(CASE WHEN level * w < cap THEN level END IGNORE NULLS) OVER (
                ORDER BY CAST(cap AS DOUBLE) / w, ordinal ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS free
            FROM f
        ), t AS (
            SELECT source, source_size, least(coalesce(free * w, CAST(cap AS DOUBLE)), CAST(cap AS DOUBLE)) AS target FROM g
        ), p AS (
            SELECT d.doc_id, d.size, t.source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS budget,
                CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.k, d.doc_id ROWS UNBOUNDED PRECEDING) AS BIGINT) - d.size AS before
            FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
        ), e AS (
            SELECT *, CASE WHEN source_size > 0 THEN budget // source_size ELSE 0 END AS whole FROM p
        )
        SELECT doc_id, size, source_size, target,
            CAST(whole * size + greatest(0, least(size, budget - whole * source_size - before)) AS BIGINT) AS taken
        FROM e
    """,
}
