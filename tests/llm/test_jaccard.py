import random
import re

import numpy as np
import pytest
from edges import rows, save

from tactile.llm import jaccard, queries


def _shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 3:
        return frozenset([tuple(words)] if words else [])
    return frozenset(tuple(words[i : i + 3]) for i in range(len(words) - 2))


def _brute(data):
    sets = [_shingles(r[1]) for r in data]
    parent = list(range(len(data)))

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and data[i][0] is not None and data[j][0] is not None and 100 * len(a & b) >= 90 * len(a | b):
                parent[max(root(i), root(j))] = min(root(i), root(j))
    members = {}
    for i in range(len(data)):
        members.setdefault(root(i), []).append(data[i][0])
    return sorted(((r[0], len(sets[i]), None if r[0] is None else min(members[root(i)])) for i, r in enumerate(data)), key=str)


def _found(df):
    return sorted((tuple(r) for r in df.select("doc_id", "n_shingles", "component_id").collect()), key=str)


def _families(seed, n_families=10, sizes=(8, 9, 12, 30, 90, 150, 300, 700), most=25):
    """Texts and edits of edits of them, on both sides of the threshold, and words before and after."""
    rng = random.Random(seed)
    vocab = [f"w{i}" for i in range(3000)]
    data = []
    for _ in range(n_families):
        words = [rng.choice(vocab) for _ in range(rng.choice(sizes))]
        for _ in range(rng.randint(1, most)):
            copy = list(words)
            for _ in range(rng.choice([0, 1, 1, 2, max(1, len(words) // 60), len(words) // 30])):
                copy[rng.randrange(len(copy))] = rng.choice(vocab)
            copy += [rng.choice(vocab) for _ in range(rng.choice([0, 0, 0, 1, len(words) // 12]))]
            if rng.random() < 0.3:
                words = copy
            data.append(" ".join(copy))
    rng.shuffle(data)
    return list(enumerate(data))


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed):
    data = _families(seed)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert _found(jaccard.near_ngrams(docs)) == _brute(data)


def test_matrix_alone_finds_all(spark):
    """Without rounds of central nodes nearly all links are left to the matrix; pools are short, and
    groups, blocks and pairs are cut."""
    data = _families(3, most=20)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    how = jaccard.Join(least_common=4, group_rows=4, query_rows=3, pair_rows=2, rounds=1)
    assert _found(jaccard.near_ngrams(docs, how)) == _brute(data)


def test_family_that_shares_a_passage(spark):
    """Very many documents share most of their words, some of them are linked, and one has many copies."""
    rng = random.Random(5)
    passage = [f"p{i}" for i in range(120)]
    data = []
    for i in range(250):
        words = list(passage)
        for _ in range(rng.choice([0, 1, 2, 4, 6, 9, 12])):
            words[rng.randrange(len(words))] = f"q{rng.randrange(5000)}"
        data.append(" ".join(words))
    data += [" ".join(passage)] * 40
    data = list(enumerate(data))
    rng.shuffle(data)
    docs = spark.createDataFrame(data, "doc_id long, text string")
    assert _found(jaccard.near_ngrams(docs, jaccard.Join(group_rows=32, query_rows=50))) == _brute(data)


def test_query_on_edge_rows(spark, tmp_path):
    assert _found(queries.op11_ngram_join(spark, save(spark, tmp_path / "a"))) == _brute(rows())
    assert queries.op11_ngram_join(spark, save(spark, tmp_path / "b", [])).count() == 0
    same = [(i, "one text for all of these rows", *r[2:]) for i, r in enumerate(rows())]
    found = queries.op11_ngram_join(spark, save(spark, tmp_path / "c", same)).collect()
    assert {r["component_id"] for r in found} == {0}


def test_sizes_of_pools_and_selections():
    """What the bound rests on: for every pair of sizes, taken tokens are sure to meet."""
    how = jaccard.DEFAULT
    n = np.arange(1, 6000)
    assert (np.diff(how.common(n)) >= 0).all() and (np.diff(how.shared(n)) >= 0).all()
    smallest = -(-n * 90 // 100)
    assert (how.common(n) <= smallest).all()
    # Tokens of the pool that are not common to both pools, and what must still be shared, fit in.
    outside = how.missing(n) + how.common(n) - how.common(smallest)
    assert (how.taken(n) == outside + how.shared(n)).all()
    assert (how.shared(n) <= how.common(smallest)).all()
