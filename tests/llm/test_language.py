import itertools

import numpy as np
from edges import frame, rows, save
from pyspark.sql import functions as F

from tactile.llm import language, queries

SF = "/root/testdata/sf0.01"


def test_forward_backward_equals_enumeration():
    rng = np.random.default_rng(5)
    lengths = np.array([5, 3, 1])
    scores, move, start = rng.normal(size=(5, 3, 3)), rng.normal(size=(3, 3)), rng.normal(size=3)
    posterior, expected, log_z = language.forward_backward(scores, lengths, move, start, pairs=True)
    total, counts = 0.0, np.zeros((3, 3))
    for b, n in enumerate(lengths):
        weights = {}
        for path in itertools.product(range(3), repeat=int(n)):
            s = start[path[0]] + sum(scores[t, b, y] for t, y in enumerate(path))
            weights[path] = np.exp(s + sum(move[a, c] for a, c in itertools.pairwise(path)))
        z = sum(weights.values())
        total += np.log(z)
        for t in range(n):
            for y in range(3):
                p = sum(w for path, w in weights.items() if path[t] == y) / z
                assert abs(posterior[t, b, y] - p) < 1e-9
        for path, w in weights.items():
            for a, c in itertools.pairwise(path):
                counts[a, c] += w / z
    assert np.allclose(expected, counts) and abs(log_z - total) < 1e-9


def test_held_out_accuracy(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang", "text")
    found = queries.op10_language(spark, SF).join(docs, "doc_id").where("held_out")
    right, n = found.agg(F.avg((F.col("lang") == F.col("lang_pred")).cast("double")), F.count("*")).first()
    assert n > 100 and right > 0.96


def test_code_switched_text_is_labelled_by_stretches(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, docs_per_lang=60)
    longest = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    german, french = (" ".join(longest[x].split()[:60]) for x in ("de", "fr"))
    posterior, letters = language.Labeller(model).posteriors([f"{german} {french}"])[0]
    labels = [model.langs[i] for i in posterior.argmax(axis=1)]
    n = len(language.word_list(german))
    assert labels[:n].count("de") > 0.9 * n and labels[n:].count("fr") > 0.9 * (len(labels) - n)
    assert len(letters) == len(labels) and np.allclose(posterior.sum(axis=1), 1, atol=1e-4)


def test_every_letter_of_a_long_run_counts(spark):
    assert "gxyz" in language.affixes("abcdefghijklmnopqrstuvwxyz"[2:])
    run = "".join(chr(97 + i % 26) for i in range(1003))
    words = language.word_list(f"{run} end")
    assert "".join(words) == f"{run}end" and max(map(len, words)) <= language.MOST_LETTERS and min(map(len, words[:-1])) > 20
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    model = language.fit(docs, docs_per_lang=60)
    longest = {r["lang"]: r["text"] for r in docs.groupBy("lang").agg(F.max_by("text", F.length("text")).alias("text")).collect()}
    german, french = ("".join(language.word_list(longest[x])[:200]) for x in ("de", "fr"))
    posterior, letters = language.Labeller(model).posteriors([german + french])[0]
    assert letters.sum() == len(german + french)
    labels, ends = [model.langs[i] for i in posterior.argmax(axis=1)], letters.cumsum()
    right = [x for x, end in zip(labels, ends, strict=True) if x == ("de" if end <= len(german) else "fr")]
    assert len(right) > 0.8 * len(labels) and {"de", "fr"} <= set(labels)


def test_query_on_edge_rows(spark, tmp_path):
    found = queries.op10_language(spark, save(spark, tmp_path)).collect()
    assert len(found) == len(rows())
    by_id = {}
    for r in found:
        by_id.setdefault(r["doc_id"], []).append(r)
    for i in (100, 101, 102):
        assert by_id[i][0]["lang_pred"] == "und" and by_id[i][0]["score"] == 0
    assert all(0 <= r["score"] <= 1 and r["lang_pred"] in ("und", "en", "fr") for r in found)
    assert by_id[103][0]["lang_pred"] != "und" and by_id[108][0]["lang_pred"] != "und"
    assert [r["held_out"] for r in by_id[None]] == [True, True]


def test_nothing_to_learn_from(spark, tmp_path):
    data = [(*r[:2], None, *r[3:]) for r in rows()]
    assert {r["lang_pred"] for r in queries.op10_language(spark, save(spark, tmp_path / "a", data)).collect()} == {"und"}
    assert queries.op10_language(spark, save(spark, tmp_path / "b", [])).count() == 0


def test_prediction_reads_only_the_text(spark):
    docs = frame(spark)
    model = language.fit(docs, docs_per_lang=20)
    one = docs.select("text", language.identify(docs, model).alias("p")).distinct()
    assert one.count() == docs.select("text").distinct().count()


def test_copies_and_long_texts_do_not_thin_the_sample(spark):
    texts = [(f"text number {i}", "aa") for i in range(400)] + [(f"few {i}", "bb") for i in range(5)]
    texts += [(f"short {i}", "dd") for i in range(3)] + [(f"{i} " + "lang texte " * 40, "dd") for i in range(20)]
    texts += [("ohne " * 30 + f"ende{i}", "cc") for i in range(4)]
    docs = spark.createDataFrame(texts, "text string, lang string")
    copies = docs.where("text in ('text number 7', 'few 3')").crossJoin(spark.range(20_000)).select("text", "lang")
    found = language.sample(docs.unionAll(copies), "text", "lang", 10, 100)
    by = {x: [t for t, own in found if own == x] for x in ("aa", "bb", "cc", "dd")}
    assert {x: len(t) for x, t in by.items()} == {"aa": 10, "bb": 5, "cc": 4, "dd": 10}
    assert len(set(by["aa"])) == 10 and sorted(by["bb"]) == [f"few {i}" for i in range(5)]
    assert sum(t.startswith("short") for t in by["dd"]) == 3
    assert all(len(t) <= 100 for t, _ in found) and {w for t in by["cc"] for w in t.split()[:-1]} == {"ohne"}
    assert sorted(found) == sorted(language.sample(docs, "text", "lang", 10, 100))
