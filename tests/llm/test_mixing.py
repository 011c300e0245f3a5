import hashlib
import re
from collections import Counter, defaultdict

from edges import frame, rows, save
from pyspark.sql import functions as F

from tactile.llm import mixing, queries


def _brute(data):
    words = [len(re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")) for r in data]
    sizes = defaultdict(int)
    for r, n in zip(data, words, strict=True):
        sizes[r[3]] += n
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, list(names), 1.5 * sum(words)
    while free:
        level = left / sum(weight[s] for s in free)
        full = [s for s in free if level * weight[s] >= 2 * sizes[s]]
        if not full:
            target |= {s: level * weight[s] for s in free}
            break
        for s in full:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
            free.remove(s)
    out, used = [], defaultdict(int)
    keyed = sorted(zip(data, words, strict=True), key=lambda x: hashlib.md5(f"mix:{'' if x[0][0] is None else x[0][0]}:{x[0][1] or ''}".encode()).hexdigest())
    for r, n in keyed:
        s = r[3]
        budget = int(target[s] + 0.5)
        whole = budget // sizes[s] if sizes[s] else 0
        rest = max(0, min(n, budget - whole * sizes[s] - used[s]))
        used[s] += n
        out.append((r[0], n, sizes[s], round(target[s], 6), whole * n + rest))
    return sorted(out, key=str)


def _found(df):
    return sorted(((r["doc_id"], r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in df.collect()), key=str)


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    folder = save(spark, tmp_path)
    assert _found(queries.op3_mixing(spark, folder)) == _brute(rows())
    monkeypatch.setattr("tactile.llm.common.RANGE_ROWS", 5)
    assert _found(queries.op3_mixing(spark, folder)) == _brute(rows())


def test_budgets_are_exact(spark):
    for row in mixing.mix(frame(spark)).groupBy("source", "target").agg({"taken": "sum"}).collect():
        assert abs(row["sum(taken)"] - row["target"]) <= 0.5


def test_mixed_documents_have_the_words_taken(spark):
    docs = frame(spark)
    plan = mixing.mix(docs)
    out = mixing.apply(docs)
    assert out.columns == docs.columns
    taken = Counter()
    for r in plan.collect():
        taken[r["doc_id"]] += r["taken"]
    got = Counter()
    for r in out.collect():
        got[r["doc_id"]] += len(re.findall(r"[^\x20\x09-\x0D]+", r["text"]))
        assert r["n_chars"] == len(r["text"])
    assert +got == +taken


def test_first_words(spark):
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(" a\tb  c\nd ", 2), ("a b", 1), ("\n\na b c", 3)], "t string, n int")
    assert [r[0] for r in df.select(mixing.first_words(F.col("t"), F.col("n"))).collect()] == [" a\tb", "a", "\n\na b c"]


def test_empty(spark, tmp_path):
    assert queries.op3_mixing(spark, save(spark, tmp_path / "a", [])).count() == 0
    blank = [(*r[:1], "", *r[2:]) for r in rows()]
    assert {r["taken"] for r in queries.op3_mixing(spark, save(spark, tmp_path / "b", blank)).collect()} == {0}
    assert mixing.apply(frame(spark, blank)).count() == 0


def test_one_text_in_several_sources_keeps_its_words(spark):
    """The same id and text in three sources: each source gets its words, under its name."""
    text = " ".join(f"w{i}" for i in range(100))
    docs = spark.createDataFrame([(1, text, s) for s in "abc"], "doc_id long, text string, source string")
    plan = {r["source"]: r["taken"] for r in mixing.mix(docs).collect()}
    out = mixing.apply(docs)
    words = out.groupBy("source").agg(F.sum(mixing.n_words(F.col("text"))).alias("n")).collect()
    assert {r["source"]: r["n"] for r in words} == plan and sum(plan.values()) == 450
