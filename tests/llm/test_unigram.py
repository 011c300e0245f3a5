import random

import public_tokenizers
import sentencepiece
from edges import frame, rows
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models

from tactile.llm import unigram

PATH = public_tokenizers.path("piece_bpe_32k.model")


def _library():
    """The same pieces in a public unigram tokenizer; pieces that no text matches get other names."""
    model = sentencepiece.SentencePieceProcessor(model_file=PATH)
    special = [model.is_control(i) or model.is_unknown(i) for i in range(model.get_piece_size())]
    vocab = [(f"\x00{i}" if s else model.id_to_piece(i), model.get_score(i)) for i, s in enumerate(special)]
    return Tokenizer(models.Unigram(vocab, 0, True))


def _expected(library, text):
    return len(library.encode("▁" + text.replace(" ", "▁"), add_special_tokens=False).ids) if text else 0


def test_counts_equal_a_public_tokenizer():
    library, counter = _library(), unigram.Counter(unigram.Vocabulary.of(PATH))
    rng = random.Random(1)
    texts = ["".join(rng.choice("aa bc  the漢字é😀\t\n▁ing") for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    texts += [r[1] for r in rows() if r[1]]
    assert [counter.count(t)[0] for t in texts] == [_expected(library, t) for t in texts]


def test_segments_change_nothing():
    vocab = unigram.Vocabulary.of(PATH)
    parts, whole = unigram.Counter(vocab), unigram.Counter(vocab)
    whole.segments = lambda text: [text]
    for text in [r[1] for r in rows()]:
        assert parts.count(text) == whole.count(text)


def test_ties_go_to_the_piece_that_starts_first():
    vocab = unigram.Vocabulary({"a": -1.0, "b": -1.0, "ab": -2.0, "c": -1.0, "bc": -2.0, "abc": -3.0}, -9.0, prefix=False)
    assert unigram.Counter(vocab).count("abc") == (1, -3.0)
    vocab.scores["abc"] = -3.5
    assert unigram.Counter(vocab).count("abc") == (2, -3.0)


def test_operator_on_edge_rows(spark):
    docs, library = frame(spark), _library()
    found = docs.select("text", unigram.token_counts(docs, unigram.Vocabulary.of(PATH)).alias("c")).collect()
    assert len(found) == docs.count()
    for row in found:
        assert row["c"]["tokens"] == _expected(library, row["text"] or "")
    empty = docs.limit(0)
    assert empty.select(unigram.token_counts(empty, unigram.Vocabulary.of(PATH))).where(F.lit(True)).count() == 0
