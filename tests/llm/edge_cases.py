"""Inputs that every operator has to take, shared by the tests."""

from __future__ import annotations

import random

LONG = "lorem ipsum dolor sit amet " * 9000
NAMES = "doc_id long, text string, lang string, node string, n int, score string, kept boolean, t string, m int, payload string"


def prose(words: int, seed: int) -> str:
    r = random.Random(seed)
    syllables = ["the", "of", "an", "er", "tion", "ou", "ré", "ß", "ing", "st", "re", "heit"]
    return " ".join("".join(r.choice(syllables) for _ in range(r.randint(1, 4))) for _ in range(words))


def texts() -> list[tuple]:
    """(doc_id, text): nulls, empty and blank texts, a long one, ties, copies and near copies, repeated rows."""
    base = prose(120, 1)
    near = base.split()
    near[60] = "changed"
    rows = [(1, base), (2, " ".join(near)), (3, base), (3, base), (4, None), (5, ""), (6, " \n\t "), (7, LONG),
            (8, "a b c"), (9, "a b c"), (10, "A B c"), (11, "don't  we'll\n\n 日本語 😀 <|endoftext|> \x1c \x85 x"),
            (None, base), (None, "no id"), (12, "word " * 400), (13, "*** " * 80), (14, prose(80, 2)),
            (15, "same line here\n" * 30 + prose(60, 3)), (16, "x" * 3000), (-5, "a b c")]
    return rows


def docs(spark):
    rows = [(i, t, None, "x", 1, None, True, "t", None, "p") for i, t in texts()]
    return spark.createDataFrame(rows, NAMES)


def empty(spark):
    return spark.createDataFrame([], NAMES)
