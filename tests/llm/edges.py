"""Rows that operators must bear: nulls, empty and very long texts, ties, repeats, other columns."""

import random

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, node string, ids string, shard int, word string, n long, _id string, _key string, _own string, _words string, _text string, _found string, own string, key string, found string"


def text(seed: int, n: int, words: str = "the of and to in that with from this are ordre maison haus strasse") -> str:
    rng = random.Random(seed)
    return " ".join(rng.choice(words.split()) + rng.choice(["", "", "s", "ing", "ed", "x"]) for _ in range(n))


# Values of columns that are named like ones that operators add on their way.
MINE = ("mine",) * 9


def rows(n: int = 60) -> list[tuple]:
    out = []
    for i in range(n):
        t = text(i, 5 + i % 40)
        if i % 7 == 3:
            t = out[-1][1]
        if i % 7 == 4:
            t = (out[-1][1] or "") + " more"
        out.append((i, t, "en" if i % 3 else "fr", f"s{i % 4}", len(t or ""), 1, 0.5, "x", "y", 3, "w", 9, *MINE))
    rest = (None,) * 7 + MINE
    out += [
        (100, None, "en", "s1", None, *rest),
        (101, "", None, None, 0, *rest),
        (102, " \t\n ", "en", None, 4, *rest),
        (103, "Élan ÀB\x0bc d é", "fr", None, 14, *rest),
        (None, "no id at all here in this", "en", "s2", 25, *rest),
        (None, None, None, None, None, *rest),
        (104, text(5, 4000), "en", "s0", 0, *rest),
        (105, "word " * 3000, "en", "s0", 0, *rest),
        (106, "x" * 20000, "en", "s0", 0, *rest),
        (107, "one two", "en", "s3", 7, *rest),
        (107, "one two", "en", "s3", 7, *rest),
        (107, "one two three", "en", "s3", 7, *rest),
        (108, "漢字 😀 12 !?", "en", "\U0001f600", 7, *rest),
    ]
    return out


def frame(spark, data=None):
    data = rows() if data is None else data
    # Shorter rows may leave the last columns out.
    return spark.createDataFrame([(*r, *[None] * (21 - len(r))) for r in data], SCHEMA)


def save(spark, folder, data=None, name="documents"):
    frame(spark, data).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)
