import hashlib
import random
import re

import xxhash
from edges import rows, save

from tactile.llm import queries, simhash


def _fingerprint(text):
    votes, total = [0] * 64, 0
    for word in re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text)):
        h, w = xxhash.xxh64_intdigest(word, seed=42), min(len(word), 8)
        total += w
        for j in range(64):
            votes[j] += w * (h >> j & 1)
    return sum(1 << j for j in range(64) if 2 * votes[j] > total)


def _brute(data, radius=3):
    ordered = sorted(((r[0], r[1] or "") for r in data), key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode()))
    prints = [_fingerprint(t) for _, t in ordered]
    out = []
    for i, (doc_id, text) in enumerate(ordered):
        j = (i + 1) % len(ordered)
        half = len(text) // 2
        edited = text[: len(text) - half] + ordered[j][1][:half]
        fp, ep = prints[i], _fingerprint(edited)
        near = [1 - (fp ^ other).bit_count() / 64 for other in (ep, prints[j])]
        within = sum((fp ^ p).bit_count() <= radius for p in prints) - 1 if doc_id is not None and doc_id % 20 == 0 else None
        out.append((doc_id, len(text), hashlib.sha256(edited.encode()).hexdigest(), f"{fp:016x}", f"{ep:016x}", *near, within))
    return sorted(out, key=str)


def test_query_equals_brute_force(spark, tmp_path, monkeypatch):
    folder = save(spark, tmp_path)
    assert sorted(map(tuple, queries.op1_simhash(spark, folder).collect()), key=str) == _brute(rows())
    monkeypatch.setattr(simhash, "ROWS_PER_BUCKET", 2)
    monkeypatch.setattr(simhash, "FAN", 5)
    assert sorted(map(tuple, queries.op1_simhash(spark, folder).collect()), key=str) == _brute(rows())


def test_one_row_and_none(spark, tmp_path):
    one = rows()[5:6]
    assert sorted(map(tuple, queries.op1_simhash(spark, save(spark, tmp_path / "a", one)).collect())) == _brute(one)
    assert queries.op1_simhash(spark, save(spark, tmp_path / "b", [])).count() == 0


def test_tables_find_all_in_the_radius(spark):
    rng = random.Random(8)
    base = [rng.getrandbits(64) for _ in range(40)]
    values = set(base)
    for b in base:
        for _ in range(6):
            values.add(b ^ sum(1 << i for i in rng.sample(range(64), rng.randint(1, 5))))
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    df = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    for radius in (1, 3, 5):
        found = {(r["query"], r["fingerprint"]) for r in simhash.within(df, df, radius).collect()}
        expected = {(a, b) for a in signed for b in signed if a != b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius}
        assert found == expected
