import random

import numpy as np
import pytest

from tactile.llm import queries, topk


def _brute(vectors, k=20):
    rows = [(i, [int(np.floor(64 * np.float64(np.float32(x)))) for x in v]) for i, v in vectors
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in rows:
        if q % 20 == 0:
            scored = sorted((-sum(x * y for x, y in zip(a, b, strict=False)), i) for i, b in rows if i != q)[:k]
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored)]
    return sorted(out)


def _vectors():
    rng = random.Random(3)
    rows = [(i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(300)]
    rows += [(i, rows[7][1]) for i in range(300, 340)]
    return rows + [(400, None), (401, [1.0, None]), (402, [float("nan")] * 6), (420, [float("inf")] * 6), (440, [2.0, 1.0]), (None, [1.0] * 6), (460, [])]


@pytest.mark.parametrize("how", [topk.DEFAULT, topk.Search(block=7, group_rows=50, query_rows=3)])
def test_equals_brute_force(spark, how):
    data = _vectors()
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>")
    from pyspark.sql import functions as F

    terms = df.where(topk.usable(F.col("embedding"))).select("vec_id", topk.whole_terms(F.col("embedding")).alias("terms"))
    found = topk.top_k(terms, F.col("vec_id") % 20 == 0, how).collect()
    assert sorted(map(tuple, found)) == _brute(data)


def test_query_with_few_rows(spark, tmp_path):
    for name, data in (("few", _vectors()[:4]), ("none", [])):
        spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        found = queries.op7_top_k(spark, f"{tmp_path}/{name}").collect()
        assert sorted(map(tuple, found)) == _brute(data)


def test_large_components_are_not_cut(spark, tmp_path):
    data = [(0, [3e5, 1.0]), (1, [3e5, 2.0]), (2, [4e5, 1.0])]
    spark.createDataFrame(data, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/a/embeddings.parquet")
    found = queries.op7_top_k(spark, f"{tmp_path}/a").collect()
    assert sorted(map(tuple, found)) == _brute(data) and found[0]["vec_id"] == 2
    for name, beyond in (("b", [(0, [1e9]), (1, [1e9])]), ("c", [(0, [1e30]), (1, [1.0])])):
        spark.createDataFrame(beyond, "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/{name}/embeddings.parquet")
        with pytest.raises(Exception, match="63 bits"):
            queries.op7_top_k(spark, f"{tmp_path}/{name}").collect()


def test_like_vectors_are_one_block():
    rng = np.random.default_rng(1)
    centres = rng.integers(-500, 500, (10, 8))
    d = np.concatenate([c + rng.integers(-5, 5, (64, 8)) for c in centres])[rng.permutation(640)]
    order = topk.near_order(d, 64)
    assert sorted(order) == list(range(640))
    assert max(int((p.max(axis=0) - p.min(axis=0)).max()) for p in d[order].reshape(10, 64, 8)) < 12
