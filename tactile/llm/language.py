"""Language identification by a linear-chain conditional random field over the words of a text.

A word is a run of letters; a run of more than ``MOST_LETTERS`` is cut into words of about the same
length, so text without spaces is labelled by stretches too, and every letter counts once. Its
features are prefixes and suffixes of one to three letters, all letter trigrams, and a lexicon: whether it is one of the frequent words of the sample, and of
which language. Learned transitions tie neighbours together, so code-switched text gets the label
of each stretch; forward-backward gives every word its distribution over languages.

The model is fitted on a bounded sample of labelled rows: ``docs_per_lang`` different texts per
language, or all there are, the ones with the smallest hashes. Texts of more than ``max_chars``
characters are taken where shorter ones do not suffice, with a part of that length. The texts are
cut into lines that are joined across documents so that labels switch inside a sequence.
Prediction reads whole texts.

Results: a text that is null or has no letter is ``und`` with score 0; without any labelled row
all texts are. Equal texts get equal results. Only the text decides a prediction.
"""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from tactile.llm.common import store

UND = "und"
WORD = re.compile(r"[^\W\d_]+")
MOST_LETTERS = 24
RESULT = "lang string, score double, words long, switches long, sure double"


def word_list(text: str) -> list[str]:
    words = WORD.findall(text.lower())
    if max(map(len, words), default=0) > MOST_LETTERS:
        words = [piece for word in words for piece in pieces_of(word)]
    return words


def pieces_of(run: str) -> list[str]:
    n = -(-len(run) // MOST_LETTERS)
    return [run[len(run) * i // n : len(run) * (i + 1) // n] for i in range(n)]


def affixes(word: str) -> list[str]:
    """Prefixes, suffixes and trigrams of a word, as feature names."""
    edged = f"^{word}$"
    names = [f"p{word[:n]}" for n in (1, 2, 3)] + [f"s{word[-n:]}" for n in (1, 2, 3)]
    return names + [f"g{edged[i:i + 3]}" for i in range(len(edged) - 2)]


@dataclass
class Model:
    langs: list[str]
    features: dict[str, int]
    lexicon: dict[str, int]
    weights: np.ndarray  # features x languages
    transitions: np.ndarray
    start: np.ndarray

    def ids(self, word: str) -> list[int]:
        found = [self.features[f] for f in affixes(word) if f in self.features]
        if (lang := self.lexicon.get(word)) is not None:
            found += [self.features[f"x{lang}"], self.features[f"w{word}"]]
        return found

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of words, one row each."""
        found = [self.ids(word) for word in words]
        owner = np.repeat(np.arange(len(found)), [len(f) for f in found])
        flat = np.fromiter(chain.from_iterable(found), np.int64, len(owner))
        columns = [np.bincount(owner, self.weights[flat, j], len(found)) for j in range(len(self.langs))]
        return np.stack(columns, axis=1)


def forward_backward(
    scores: np.ndarray, lengths: np.ndarray, transitions: np.ndarray, start: np.ndarray, pairs: bool = False
) -> tuple[np.ndarray, np.ndarray | None, float]:
    """Posteriors of sequences (longest first) laid out as ``scores[t, b]``; with ``pairs`` also
    the expected number of transitions; and the log of all normalisers."""
    steps, n, k = scores.shape
    live = np.searchsorted(-lengths, -np.arange(1, steps + 1), side="right")  # sequences at step t
    peak = scores.max(axis=2, keepdims=True)
    emit = np.exp(scores - peak)
    move = np.exp(transitions - transitions.max()).astype(scores.dtype)
    forward = np.zeros_like(emit)
    first = np.exp(start - start.max()).astype(scores.dtype)
    log_z = 0.0
    scale = np.ones((steps, n)) if pairs else None
    now = emit[0] * first
    for t in range(steps):
        m = live[t]
        if t:
            now = (forward[t - 1, :m] @ move) * emit[t, :m]
        total = now.sum(axis=1, keepdims=True)
        forward[t, :m] = now / total
        if pairs:
            scale[t, :m] = total[:, 0]
    backward = np.ones((n, k), scores.dtype)
    posterior = forward.copy()
    expected = np.zeros((k, k)) if pairs else None
    for t in range(steps - 2, -1, -1):
        m = live[t + 1]
        ahead = backward[:m] * emit[t + 1, :m]
        if pairs:
            joint = forward[t, :m, :, None] * move[None] * ahead[:, None, :]
            expected += (joint / joint.sum(axis=(1, 2), keepdims=True)).sum(axis=0)
        backward[:m] = ahead @ move.T
        backward[:m] /= backward[:m].sum(axis=1, keepdims=True)
        joint = forward[t, :m] * backward[:m]
        posterior[t, :m] = joint / joint.sum(axis=1, keepdims=True)
    if pairs:
        mask = np.arange(steps)[:, None] < lengths[None, :]
        log_z = float((np.log(scale) * mask).sum() + (peak[:, :, 0] * mask).sum())
        log_z += float((lengths - 1).clip(0).sum() * transitions.max() + n * start.max())
    return posterior, expected, log_z


def train(
    rows: list[tuple[str, str]], lexicon_words: int = 1500, rounds: int = 160, seed: int = 7
) -> Model | None:
    """Fit on (text, language) rows by stochastic gradient on the conditional likelihood."""
    rng = np.random.default_rng(seed)
    rows = sorted(set(rows))
    lines = [(w, lang) for text, lang in rows for line in text.split("\n") if (w := word_list(line))]
    if not lines:
        return None
    langs = sorted({lang for _, lang in lines})
    index = {lang: i for i, lang in enumerate(langs)}
    by_lang = [Counter() for _ in langs]
    for words, lang in lines:
        by_lang[index[lang]].update(words)
    totals = [max(1, sum(c.values())) for c in by_lang]
    lexicon: dict[str, int] = {}
    for counts in by_lang:
        for word, _ in sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:lexicon_words]:
            lexicon[word] = int(np.argmax([c[word] / t for c, t in zip(by_lang, totals, strict=True)]))
    vocabulary = sorted(set().union(*by_lang))
    names = Counter(f for word in vocabulary for f in affixes(word))
    kept = [f for f, n in sorted(names.items()) if n > 1]
    kept += [f"x{i}" for i in range(len(langs))] + [f"w{word}" for word in sorted(lexicon)]
    model = Model(
        langs,
        {f: i for i, f in enumerate(kept)},
        lexicon,
        np.zeros((len(kept), len(langs))),
        np.zeros((len(langs), len(langs))),
        np.zeros(len(langs)),
    )
    own = [model.ids(word) for word in vocabulary]
    width = max(map(len, own))
    pad = len(kept)
    feature_ids = np.full((len(vocabulary), width), pad)
    for i, found in enumerate(own):
        feature_ids[i, : len(found)] = found
    place = {word: i for i, word in enumerate(vocabulary)}

    # Lines of about a hundred words, in random order: about half of the neighbours of a line in a
    # sequence come from another document, so labels switch.
    pieces = [
        (np.fromiter(map(place.__getitem__, words[i : i + 60]), np.int64), index[lang])
        for words, lang in lines
        for i in range(0, len(words), 60)
    ]
    order = rng.permutation(len(pieces))
    sequences = []
    for i in range(0, len(order), 3):
        group = [pieces[j] for j in order[i : i + 3]]
        sequences.append((np.concatenate([w for w, _ in group]), np.concatenate([np.full(len(w), y) for w, y in group])))
    weights = np.zeros((pad + 1, len(langs)))
    params = [weights, model.transitions, model.start]
    first = [np.zeros_like(p) for p in params]
    second = [np.zeros_like(p) for p in params]
    k = len(langs)
    for step in range(1, rounds + 1):
        chosen = rng.choice(len(sequences), size=min(192, len(sequences)), replace=False)
        batch = sorted((sequences[i] for i in chosen), key=lambda s: -len(s[0]))
        lengths = np.array([len(w) for w, _ in batch])
        steps, n = int(lengths[0]), len(batch)
        words = np.zeros((steps, n), np.int64)
        gold = np.zeros((steps, n), np.int64)
        mask = np.arange(steps)[:, None] < lengths[None, :]
        for b, (w, y) in enumerate(batch):
            words[: len(w), b], gold[: len(y), b] = w, y
        used, inverse = np.unique(words[mask], return_inverse=True)
        emissions = weights[feature_ids[used]].sum(axis=1)
        scores = np.zeros((steps, n, k))
        scores[mask] = emissions[inverse]
        posterior, expected, _ = forward_backward(scores, lengths, model.transitions, model.start, pairs=True)
        error = posterior[mask]
        error[np.arange(len(error)), gold[mask]] -= 1
        per_word = np.stack([np.bincount(inverse, error[:, j], len(used)) for j in range(k)], axis=1)
        flat = feature_ids[used].ravel()
        spread = np.repeat(per_word, width, axis=0)
        gradient = np.stack([np.bincount(flat, spread[:, j], pad + 1) for j in range(k)], axis=1)
        both = mask[1:]
        moves = np.bincount(gold[:-1][both] * k + gold[1:][both], minlength=k * k).reshape(k, k)
        opening = posterior[0].sum(axis=0) - np.bincount(gold[0], minlength=k)
        rate = 0.15 * (1 - step / (rounds + 1))
        for p, a, b, g in zip(params, first, second, (gradient, expected - moves, opening), strict=True):
            g = g / n + 1e-4 * p
            a *= 0.9
            a += 0.1 * g
            b *= 0.99
            b += 0.01 * g * g
            p -= rate * (a / (1 - 0.9**step)) / (np.sqrt(b / (1 - 0.99**step)) + 1e-6)
        weights[pad] = 0
    model.weights = weights[:pad]
    return model


class Places(dict):
    """Numbers words as they are first asked for."""

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []

    def __missing__(self, word: str) -> int:
        i = self[word] = len(self)
        self.fresh.append(word)
        return i


class Labeller:
    """Labels the words of texts; keeps the scores of words it has seen."""

    MOST_WORDS = 125_000

    def __init__(self, model: Model):
        self.model = model
        self.forget()

    def forget(self) -> None:
        self.place = Places()
        self.letters = np.zeros(0, np.int64)
        self.table = np.zeros((0, len(self.model.langs)))

    def posteriors(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray]]:
        """For each text, the distribution of each word with a letter, and its letters."""
        return [(posterior, letters) for posterior, letters, _ in self.judged(texts)]

    def judged(self, texts: list[str | None]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """``posteriors``, and whether the model knows any feature of each word."""
        if len(self.place) > self.MOST_WORDS:
            self.forget()
        ids = [np.fromiter(map(self.place.__getitem__, word_list(t or "")), np.int64) for t in texts]
        if fresh := self.place.fresh:
            self.table = np.concatenate([self.table, self.model.emissions(fresh)])
            counts = [len(w) if w.isalpha() else sum(map(str.isalpha, w)) for w in fresh]
            self.letters = np.concatenate([self.letters, np.array(counts, np.int64)])
            self.place.fresh = []
        letters = self.letters
        ids = [w[letters[w] > 0] if len(w) else w for w in ids]
        out = [(np.zeros((0, len(self.model.langs))), np.zeros(0), np.zeros(0, bool)) for _ in ids]
        order = sorted((i for i in range(len(ids)) if len(ids[i])), key=lambda i: -len(ids[i]))
        start = 0
        while start < len(order):
            longest = len(ids[order[start]])
            group = order[start : start + max(1, 100_000 // longest)]
            start += len(group)
            lengths = np.array([len(ids[i]) for i in group])
            scores = np.zeros((longest, len(group), len(self.model.langs)), np.float32)
            for b, i in enumerate(group):
                scores[: len(ids[i]), b] = self.table[ids[i]]
            posterior, _, _ = forward_backward(scores, lengths, self.model.transitions, self.model.start)
            for b, i in enumerate(group):
                out[i] = (posterior[: len(ids[i]), b], letters[ids[i]], self.table[ids[i]].any(axis=1))
        return out

    def predict(self, texts: list[str | None]) -> list[dict]:
        rows = []
        for posterior, letters, known in self.judged(texts):
            if not len(letters):
                rows.append({"lang": UND, "score": 0.0, "words": 0, "switches": 0, "sure": 0.0})
                continue
            share = (posterior * letters[:, None]).sum(axis=0) / letters.sum()
            best = int(share.argmax())
            labels = posterior.argmax(axis=1)
            rows.append(
                {
                    "lang": self.model.langs[best],
                    "score": float(min(1.0, share[best])),
                    "words": len(letters),
                    "switches": int((labels[1:] != labels[:-1]).sum()),
                    "sure": float(min(1.0, (posterior.max(axis=1) * letters * known).sum() / letters.sum())),
                }
            )
        return rows


def sample(docs: DataFrame, text: str, lang: str, docs_per_lang: int, max_chars: int) -> list[tuple[str, str]]:
    """Different labelled texts with the smallest hashes, ``docs_per_lang`` a language or all there
    are. Texts of more than ``max_chars`` fill up where others do not suffice, with a part each."""
    rows = docs.select(F.col(text).alias("text"), F.col(lang).alias("lang")).where(F.col("lang").isNotNull() & F.col("text").isNotNull())
    rows = rows.withColumns({"h": F.xxhash64("text"), "long": F.length("text") > max_chars})
    # Copies count once: without text the rows are narrow, and combine before they are dealt out.
    different = store(rows.select("lang", "long", "h").distinct(), "texts")
    sizes = {(r["lang"], r["long"]): r["count"] for r in different.groupBy("lang", "long").count().collect()}
    bounds: dict[tuple[str, bool], int] = {}
    for own, long in sorted(sizes):
        wanted = docs_per_lang - (min(docs_per_lang, sizes.get((own, False), 0)) if long else 0)
        if wanted > 0:
            # Twice the share that would do, so that chance leaves enough.
            share = min(1.0, (2.0 * wanted + 50) / sizes[own, long])
            bounds[own, long] = min(2**63 - 1, int(share * 2**64) - 2**63)
    if not bounds:
        return []
    kind = F.concat("lang", F.col("long").cast("int").cast("string"))
    bound = F.create_map(*[F.lit(x) for (own, long), most in bounds.items() for x in (f"{own}{int(long)}", most)])
    first = different.where(F.col("h") <= bound[kind]).collect()
    taken: Counter = Counter()
    chosen = []
    for row in sorted(first, key=lambda r: (r["long"], r["h"], r["lang"])):
        if taken[row["lang"]] < docs_per_lang:
            taken[row["lang"]] += 1
            chosen.append((row["lang"], row["h"]))
    # A part of a long text starts anywhere, by its hash.
    part = F.substring("text", (F.pmod("h", F.length("text") - max_chars + 1) + 1).cast("int"), F.lit(max_chars))
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(chosen, "lang string, h long")), ["lang", "h"], "left_semi")
    rows = rows.select("lang", "h", "long", F.when(F.col("long"), part).otherwise(F.col("text")).alias("text"))
    found = rows.dropDuplicates(["lang", "h"]).collect()
    return [(whole_words(r["text"]) if r["long"] else r["text"], r["lang"]) for r in sorted(found, key=lambda r: (r["h"], r["lang"]))]


def whole_words(part: str) -> str:
    """A part of a text without the pieces of words at its ends, if it has white space."""
    inside = re.search(r"\s.*\s", part, re.DOTALL)
    return inside[0] if inside and not inside[0].isspace() else part


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", docs_per_lang: int = 300, max_chars: int = 20_000) -> Model | None:
    """The model of a bounded sample of the labelled rows of ``docs``."""
    return train(sample(docs, text, lang, docs_per_lang, max_chars))


def identify(docs: DataFrame, model: Model | None, text: str = "text") -> Column:
    """Struct column ``lang, score, words, switches, sure`` for the whole text of each row."""
    if model is None:
        none = [F.lit(UND).alias("lang"), F.lit(0.0).alias("score"), F.lit(0).cast("long").alias("words"), F.lit(0).cast("long").alias("switches"), F.lit(0.0).alias("sure")]
        return F.struct(*none)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = pa.struct([("lang", pa.string()), ("score", pa.float64()), ("words", pa.int64()), ("switches", pa.int64()), ("sure", pa.float64())])

    def label(batches):
        from tactile.llm.common import release, slices

        labeller = Labeller(shared.value)
        for texts in batches:
            values = texts.to_pylist()
            rows: list[dict] = []
            for a, b in slices([len(v or "") for v in values], 8 << 20):
                rows += labeller.predict(values[a:b])
            yield pa.array(rows, kind)
        labeller.forget()
        release()

    from collections.abc import Iterator

    label.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    # Not to be run again for each use of its fields.
    return F.arrow_udf(label, RESULT).asNondeterministic()(F.col(text))
