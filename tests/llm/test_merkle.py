import hashlib
import zlib

import pytest
from edges import frame, rows, save

from tactile.llm import merkle, queries


def _h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def _lower(text):
    return None if text is None else "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def _value(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def _tree(leaves):
    """All levels, from the leaves to the root."""
    levels = [leaves]
    while len(levels[-1]) > 1:
        last = levels[-1]
        levels.append([_h("".join(last[i : i + 8])) for i in range(0, len(last), 8)])
    return levels


def _up(levels, place, x):
    proof = ""
    for level in levels[:-1]:
        start = place // 8 * 8
        before, after = "".join(level[start:place]), "".join(level[place + 1 : start + 8])
        proof, x, place = proof + before + after, _h(before + x + after), place // 8
    return proof, x


def _brute(data):
    groups = {}
    for doc_id, text, lang, source, n_chars, *_ in data:
        own, changed = (_h("".join(map(_value, (doc_id, source, lang, n_chars, t)))) for t in (text, _lower(text)))
        tampered = zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 3 == 0
        groups.setdefault(lang, []).append((doc_id, own, changed if tampered else own))
    langs = sorted(groups, key=lambda x: (x is not None, (x or "").encode()))
    trees = {}
    for lang in langs:
        groups[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        trees[lang] = _tree([r[1] for r in groups[lang]])
    top = _tree([trees[lang][-1][0] for lang in langs])
    out = []
    for k, lang in enumerate(langs):
        for place, (doc_id, own, used) in enumerate(groups[lang]):
            first, x = _up(trees[lang], place, used)
            second, x = _up(top, k, x)
            root = top[-1][0]
            out.append((doc_id, own, trees[lang][-1][0], root, _h(first + second), x, x == root))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def _many():
    """Groups of one row, of a power of the fan-out and one more, and more groups than a run holds."""
    sizes = {None: 3, "": 1, "a": 8, "b": 9, "c": 64, "d": 65, "é": 130, "z": 7, "A": 1, "aa": 2, "b ": 5}
    pairs = [(lang, i) for lang, n in sizes.items() for i in range(n)]
    return [(1000 - 3 * k, f"Text {i} Of {lang}", lang, f"s{i % 3}", i, *[None] * 7) for k, (lang, i) in enumerate(pairs)]


@pytest.mark.parametrize("depth", [1, 2, 4])
def test_equals_brute_force(spark, depth):
    """Also when blocks are so small that their roots are appended in several rounds."""
    data = _many()
    assert _found(merkle.manifest(frame(spark, data), depth=depth)) == _brute(data)


def test_query_on_edge_rows(spark, tmp_path):
    assert _found(queries.op12_merkle(spark, save(spark, tmp_path / "a"))) == _brute(rows())
    assert queries.op12_merkle(spark, save(spark, tmp_path / "b", [])).count() == 0
    one = rows()[:1]
    assert _found(queries.op12_merkle(spark, save(spark, tmp_path / "c", one))) == _brute(one)
    same = [rows()[5]] * 70
    assert _found(queries.op12_merkle(spark, save(spark, tmp_path / "d", same))) == _brute(same)


@pytest.mark.parametrize("n", [1, 7, 8, 9, 63, 64, 65, 500, 513])
def test_witnesses_grow_with_appends(n):
    leaves = [hashlib.sha256(str(i).encode()).digest() for i in range(n)]
    tree = merkle.Appender(merkle.height(n))
    for i, x in enumerate(leaves):
        tree.append(x)
        # Runs are complete from the bottom up, as soon as the last sibling is there.
        assert len(tree.witnesses[0]) == sum(i + 1 >= 8**k for k in range(1, tree.levels + 1))
    assert tree.finish().hex() == _tree([x.hex() for x in leaves])[-1][0]
    assert all(merkle.fold(x, w) == tree.root for x, w in zip(leaves, tree.witnesses, strict=True))
    assert all(len(w) == tree.levels for w in tree.witnesses)
