from __future__ import annotations

import random

import pytest

ODD = [
    (1, "the same line here\nshort\nanother long line"),
    (2, "The same line here  \nshort\nsomething else"),
    (2, "The same line here  \nshort\nsomething else"),
    (3, None),
    (4, ""),
    (5, " \t\n\n "),
    (6, "\n"),
    (7, "the same line here\r\nthe same line here"),
    (8, "É à ß ñ 日本語 😀 é"),
    (9, "x" * 30_000 + " " + "y " * 5_000),
    (10, " ".join(f"w{i % 97}" for i in range(3_000))),
    (None, "the same line here\nonly without an id"),
    (None, None),
    (11, "A. <|endoftext|> \x01 ▁ it's ...")
]
"""Nulls, empty and very long texts, repeated rows, ties, and characters that tokenizers treat apart."""


@pytest.fixture(scope="module")
def odd(spark):
    """Odd documents with a column that clashes with names the operators use."""
    rows = [(i, t, "en", "s", "kept", "kept", 7) for i, t in ODD]
    return spark.createDataFrame(rows, "doc_id bigint, text string, lang string, source string, n_lines string, class string, h int").repartition(3)


@pytest.fixture(scope="module")
def empty(odd):
    return odd.filter("false")


@pytest.fixture(scope="session")
def corpus():
    """(doc_id, text): copies, near copies and shared passages among random texts."""
    draw = random.Random(3)
    vocabulary = [f"{a}{b}" for a in ("ba", "ce", "di", "fo", "gu", "ha", "je") for b in ("lm", "nt", "rs", "st", "x")]
    passage = [draw.choice(vocabulary) for _ in range(60)]
    texts = []
    for i in range(160):
        own = [draw.choice(vocabulary) + str(draw.randrange(40)) for _ in range(draw.randrange(1, 120))]
        if i % 5 == 0:
            at = draw.randrange(len(own))
            own[at:at] = passage
        if i % 7 == 0 and texts:
            own = draw.choice(texts).split()
            if i % 2:
                own[draw.randrange(len(own))] = "changed"
        texts.append(" ".join(own))
    return list(enumerate(texts))


def one_row(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]
