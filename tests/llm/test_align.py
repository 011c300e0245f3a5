import hashlib
import json
import random
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from edges import frame, rows, save, text
from tokenizers import Tokenizer

from tactile.llm import align, queries

FIRST, SECOND = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
COLUMNS = ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def _brute(data):
    """By byte ranges, with whole texts given to both libraries."""
    first, second = Tokenizer.from_file(FIRST), sentencepiece.SentencePieceProcessor(model_file=SECOND)
    first.encode_special_tokens = True
    letters = align.byte_letters()
    entry = {i: bytes(letters[c] for c in e) for e, i in json.load(open(FIRST))["model"]["vocab"].items()}
    found, holders = [], defaultdict(set)
    for k, (_, t, *_) in enumerate(data):
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = second.encode(t) if t else []
        raw = [[entry[i] for i in a], [second.id_to_piece(i) for i in b]]
        raw[1] = [bytes([int(p[3:5], 16)]) if second.is_byte(i) else p.replace("▁", " ").encode() for p, i in zip(raw[1], b)]
        if not t or any(b"".join(r) != (" " + t).encode() for r in raw):
            found.append(None)
            continue
        spans = []
        for pieces in raw:
            at, own = 0, []
            for p in pieces:
                own.append((at, at + len(p)))
                at += len(p)
            spans.append(own)
        links = [(x, y) for x, p in zip(a, spans[0]) for y, q in zip(b, spans[1]) if p[0] < q[1] and q[0] < p[1]] if len(a) < 3000 else None
        both = sorted({e for _, e in spans[0]} & {e for _, e in spans[1]})
        groups, i, j = [], 0, 0
        for e in both:
            x, y = [], []
            while i < len(a) and spans[0][i][1] <= e:
                x.append(str(a[i]))
                i += 1
            while j < len(b) and spans[1][j][1] <= e:
                y.append(str(b[j]))
                j += 1
            groups.append(",".join(x) + "|" + ",".join(y))
        found.append((len(a), len(b), groups, links))
        for pair in set(links):
            holders[pair].add(k)
    best = defaultdict(int)
    for (x, _), docs in holders.items():
        best[x] = max(best[x], len(docs))
    out = []
    for (doc_id, *_), f in zip(data, found):
        if f is None:
            out.append((doc_id, 0, 0, 0, 0, 0, 0, ""))
            continue
        n_a, n_b, groups, links = f
        counts = [len(holders[p]) for p in links]
        n_best = sum(c == best[p[0]] for c, p in zip(counts, links))
        digest = hashlib.sha256(";".join(groups).encode()).hexdigest()
        out.append((doc_id, n_a, n_b, len(groups), len(links), n_best, sum(counts), digest))
    return sorted(out, key=str)


def _found(df):
    return sorted((tuple(r[c] for c in COLUMNS) for r in df.collect()), key=str)


def _data():
    extra = [
        "<|endoftext|> <s> </s> <unk> are plain text here <0x41>",
        "mark ▁ of a space",
        "x▁ y",
        "  two  blanks\n\nand lines \t tab ",
        " ",
        " no break em",
        "naïve café Ünïcödé ß ﬁ ½",
        "漢字かな交じり文 and 😀😀 mixed",
        "don't we'll I'm they're 12345 67.89",
        "é combining \x00 \x1c control",
        "a" * 3000,
        text(1, 300) + " " * 40 + text(2, 300),
    ]
    small = [r for r in rows() if r[1] is None or len(r[1]) < 10000]
    return small + [(200 + i, t, *[None] * 10) for i, t in enumerate(extra)]


@pytest.mark.parametrize("frequent", [align.FREQUENT_PAIRS, 20, 0])
def test_equals_brute_force(spark, frequent):
    """Also when few counts or none are sent and the others are joined."""
    data = _data()
    files = align.Tokenizers.read(FIRST, SECOND)
    assert _found(align.align(frame(spark, data), files, frequent_pairs=frequent)) == _brute(data)


def test_query(spark, tmp_path):
    data = _data()
    assert _found(queries.op13_alignment(spark, save(spark, tmp_path / "a", data))) == _brute(data)
    assert queries.op13_alignment(spark, save(spark, tmp_path / "b", [])).count() == 0


def test_words_are_encoded_as_in_the_whole_text():
    coder = align.Coders(align.Tokenizers.read(FIRST, SECOND))
    assert coder.may_cut
    whole = [r[1] for r in _data() if r[1]] + [text(9, 20000)]
    for t, found in zip(whole, coder.encode(whole), strict=True):
        if found:
            assert found[0].tolist() == coder.first.encode(" " + t, add_special_tokens=False).ids
            assert found[1].tolist() == coder.second.encode(t)


@pytest.mark.parametrize("seed", range(20))
def test_runs_and_groups(seed):
    """Random cuts with long common stretches, against the set of common ends."""
    rng = random.Random(seed)
    n = rng.choice([1, 2, 7, 64, 500])
    common = sorted(rng.sample(range(1, 4 * n + 1), n)) + [4 * n + 1]
    extra = [x for x in range(1, 4 * n + 1) if x not in set(common)]
    a, b = (sorted({*common, *[x for x in extra if rng.random() < rng.choice([0.02, 0.3])]}) for _ in range(2))
    ids = [np.arange(len(x), dtype=np.int32) for x in (a, b)]
    count, groups, links = align.aligned(*ids, np.array(a), np.array(b), align.id_texts(len(a), len(b)), len(a))
    groups = groups.decode()
    both = sorted(set(a) & set(b))
    assert count == len(both) == len(groups.split(";"))
    pairs = [(i, j) for i in range(len(a)) for j in range(len(b)) if max([0, *a][i], [0, *b][j]) < min(a[i], b[j])]
    assert [(int(x) >> 32, int(x) & 0xFFFFFFFF) for x in links] == pairs
