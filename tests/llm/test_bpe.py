import hashlib
import random

import public_tokenizers
import pytest
import tiktoken
from edges import frame, rows, save

from tactile.llm import bpe, queries

NAMES = ["byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken"]


def _library(name):
    ranks = bpe.read_ranks(public_tokenizers.path(name))
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


@pytest.mark.parametrize("name", NAMES)
def test_ids_equal_the_library(name):
    library = _library(name)
    encoder = bpe.Encoder(bpe.vocabulary(public_tokenizers.path(name), public_tokenizers.PATTERN))
    rng = random.Random(2)
    kinds = ["abcdefghij", "aab", "the of and", "éèüß漢字 \n\t", " \n", "😀👍a1234567890!?,."]
    texts = ["".join(rng.choice(rng.choice(kinds)) for _ in range(rng.randint(0, 50))) for _ in range(4000)]
    texts += [r[1] or "" for r in rows()] + ["a" * 5000, " " * 3000, "ab" * 4000]
    for text in texts:
        ids = encoder.encode(text)
        assert ids == library.encode_ordinary(text)
        assert encoder.decode(ids) == text.encode()


def test_every_entry_is_one_token():
    encoder = bpe.Encoder(bpe.vocabulary(public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN))
    for rank, token in encoder.pieces.items():
        assert encoder.encode_bytes(token) == [rank]


def test_query_on_edge_rows(spark, tmp_path):
    library = _library(NAMES[0])
    found = queries.op8_byte_bpe(spark, save(spark, tmp_path)).collect()
    expected = []
    for row in rows():
        ids = library.encode_ordinary(row[1] or "")
        sha = [hashlib.sha256(x).hexdigest() for x in (" ".join(map(str, ids)).encode(), (row[1] or "").encode())]
        expected.append((row[0], len(ids), *sha))
    assert sorted(map(tuple, found), key=str) == sorted(expected, key=str)


def test_other_columns_stay(spark):
    vocab = bpe.vocabulary(public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN)
    coded = bpe.encode(frame(spark), vocab)
    assert "size" in coded.columns and "text" not in coded.columns and dict(coded.dtypes)["ids"] == "array<int>"
    both = bpe.round_trip(frame(spark), vocab).select("doc_id", "ids", "decoded")
    assert sorted(map(str, both.collect())) == sorted(map(str, bpe.decode(coded, vocab).select("doc_id", "ids", "decoded").collect()))
    assert bpe.decode(bpe.encode(frame(spark).limit(0), vocab), vocab).count() == 0


def test_memos_end_with_the_task():
    import pyarrow as pa

    encoder = bpe.Encoder(bpe.vocabulary(public_tokenizers.path(NAMES[0]), public_tokenizers.PATTERN))
    texts = ["some words of a text", "wordsofatext"]
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    found = [i for b in bpe._encoded([batch], encoder, "text", "ids", []) for i in b.column(0).to_pylist()]
    assert not encoder.seen and not encoder.apart
    assert found == [encoder.encode(t) for t in texts]
