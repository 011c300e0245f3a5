import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from edges import rows, save
from pyspark.sql import functions as F

from tactile.llm import lm, queries


def _tokens(text):
    return [*re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or "")), "\n"]


def _held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 10 == 0


def _brute(data):
    counts = Counter()
    for r in data:
        if not _held_out(r[0]):
            counts.update(_tokens(r[1]))
    n, v = sum(counts.values()), len(counts)
    out = []
    for r in data:
        t = _tokens(r[1])
        base = sum(math.log10((counts[w] + 0.1) / (n + 0.1 * (v + 1))) for w in t)
        out.append((r[0], _held_out(r[0]), len(t), sum(counts[w] > 0 for w in t), n, round(base, 6)))
    return sorted(out, key=str)


def _base(found):
    return sorted(((*[r[c] for c in ("doc_id", "held_out", "n_tokens", "n_known", "train_tokens")], round(r["base_score"], 6)) for r in found), key=str)


@pytest.mark.parametrize("frequent", [0, 5, 200_000])
def test_base_score_equals_brute_force(spark, tmp_path, frequent):
    docs = spark.read.parquet(f"{save(spark, tmp_path)}/documents.parquet").withColumn("held_out", queries.remainder(F.col("doc_id"), 10) == 0)
    model = lm.train(docs.where("not held_out"), lm.Lm(frequent_words=frequent))
    found = lm.score(docs, model, ["doc_id", "held_out"]).withColumn("train_tokens", F.lit(model.total)).collect()
    assert _base(found) == _brute(rows())


def test_words_sent_to_workers_are_short(spark):
    long = ["x" * 65, "y" * 64, "z" * 300_000, "Z" * 299_999 + "a"]
    data = [(i, " ".join(long[: 1 + i % 4]) + " end") for i in range(40)]
    docs = spark.createDataFrame(data, "doc_id long, text string").withColumn("held_out", queries.remainder(F.col("doc_id"), 10) == 0)
    model = lm.train(docs.where("not held_out"))
    assert max(map(len, model.frequent.column("word").to_pylist())) <= 64
    found = lm.score(docs, model, ["doc_id", "held_out"]).withColumn("train_tokens", F.lit(model.total)).collect()
    assert _base(found) == _brute(data)


def test_query_and_edges(spark, tmp_path):
    found = queries.op2_lm_score(spark, save(spark, tmp_path)).collect()
    assert _base(found) == _brute(rows())
    assert all(r["score"] <= 0 for r in found)
    assert queries.op2_lm_score(spark, save(spark, tmp_path / "none", [])).count() == 0
    held = [r for r in rows() if _held_out(r[0])]
    for r in queries.op2_lm_score(spark, save(spark, tmp_path / "held", held)).collect():
        assert r["base_score"] == 0 and r["score"] == 0 and r["train_tokens"] == 0


def test_filter_never_counts_too_few(spark):
    texts = [r[1] for r in rows() if r[1]]
    how = lm.Lm()
    docs = spark.createDataFrame([(t,) for t in texts], "text string")
    model = lm.train(docs, how)
    counts = Counter()
    for t in texts:
        toks = [w.encode() for w in _tokens(t)]
        counts.update((w,) for w in toks)
        counts.update(zip([lm.END, *toks], toks, strict=False))
    book = lm.codebook(how.growth)
    known = lm.Hashes()
    exact = over = 0
    for gram, n in counts.items():
        flat = np.array([known[w] for w in gram], np.uint64)
        starts = np.zeros(len(gram), np.int64)
        if gram[0] == lm.END and len(gram) == 2:
            key = lm.ngrams(flat[1:], starts[1:], 2)[1][-1:]
        else:
            key = lm.ngrams(flat, starts, len(gram))[-1][-1:]
        found, level = model.filter.levels(key, len(book))[0], int(np.searchsorted(book, n, side="right"))
        assert found >= level
        exact += found == level
        over += found > level
    assert over < 0.05 * exact
    strange = np.random.default_rng(1).integers(0, 2**63, 20000).astype(np.uint64)
    assert (model.filter.levels(strange, len(book)) > 0).mean() < 0.05


def test_filter_stays_sharp_where_it_outgrows_a_file(spark):
    how = lm.Lm(max_bytes=4096)
    texts = [(" ".join(f"w{i}x{j}" for j in range(50)),) for i in range(400)]
    model = lm.train(spark.createDataFrame(texts, "text string"), how)
    assert model.filter.sizes.sum() >= 9 * 40_000 and len(model.filter.names) > 4
    book, known = lm.codebook(how.growth), lm.Hashes()
    seen = lm.ngrams(np.array([known[w.encode()] for (t,) in texts for w in t.split()], np.uint64), np.repeat(np.arange(0, 20_000, 50), 50), 2)
    for keys in seen:
        found = model.filter.levels(keys, len(book))
        assert (found >= 1).all() and (found == 1).mean() > 0.95
    strange = np.random.default_rng(1).integers(0, 2**64, 20_000, dtype=np.uint64)
    assert (model.filter.levels(strange, len(book)) > 0).mean() < 0.05
    whole = lm.train(spark.createDataFrame(texts, "text string"))
    assert len(whole.filter.names) == 1
    for keys in (*seen, strange):
        assert (whole.filter.levels(keys, len(book)) == model.filter.levels(keys, len(book))).all()


def test_model_knows_what_it_has_read(spark):
    found = queries.op2_lm_score(spark, "/root/testdata/sf0.01")
    known, own = found.where("not held_out").agg(F.avg(F.col("score") / F.col("n_tokens")), F.avg(F.col("base_score") / F.col("n_tokens"))).first()
    held, held_base = found.where("held_out").agg(F.avg(F.col("score") / F.col("n_tokens")), F.avg(F.col("base_score") / F.col("n_tokens"))).first()
    assert known > own and held > held_base - 0.2


def test_codebook():
    book = lm.codebook(1.2, 1000)
    assert list(book[:6]) == [1, 2, 3, 4, 5, 6] and (np.diff(book) > 0).all()
    middle = lm.middles(book)
    assert middle[0] == 0 and middle[1] == 1 and (np.diff(middle) > 0).all()
