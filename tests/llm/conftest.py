"""Small tables with everything awkward in them."""

from __future__ import annotations

import random
import re

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, n long, score double, items string, spans string, label string"
WORDS = ["river", "Über", "the", "of", "stone", "élan", "wind", "sand", "tide", "moss"] + [f"w{i}" for i in range(400)]


def prose(rng, n):
    return " ".join(rng.choice(WORDS) for _ in range(n))


def space_words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in text or ""))


def make_docs(seed=5):
    """Prose, exact and near copies, a shared passage, nulls, blanks, one sign, control strings, a very long word and text, repeated rows."""
    rng = random.Random(seed)
    texts = [prose(rng, rng.randint(60, 200)) for _ in range(12)]
    base = prose(rng, 220).split(" ")
    for _ in range(8):
        edited = list(base)
        for _ in range(3):
            edited[rng.randrange(len(edited))] = rng.choice(WORDS)
        texts.append(" ".join(edited))
    passage = prose(rng, 60)
    texts += [f"{prose(rng, 40)} {passage} {prose(rng, 40)}" for _ in range(6)]
    texts += [texts[0], texts[0], texts[3].upper()]
    texts += [None, "", " \n\t ", "a", "...", "one two three", "one two three", "x" * 5000, prose(rng, 6000), "<|im_end|> \\ <\\| ok", "tab\tand\x0bfeed\r\nline\n\nline", "漢字 " * 60, "La " * 120]
    rows = [(i, t, rng.choice(["en", "fr", None]), "src0", len(t or ""), 1, 0.5, "i", "s", "l") for i, t in enumerate(texts)]
    return [*rows, rows[2], rows[2], (None, texts[1], "en", "src0", 1, 1, 0.5, "i", "s", "l"), (None, None, None, None, None, None, None, None, None, None)]


@pytest.fixture(scope="session")
def docs(spark):
    return spark.createDataFrame(make_docs(), DOCS).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="session")
def labels(spark):
    rows = [(i, i % 2, 0) for i in range(30)] + [(3, 1, 0), (None, 1, 0), (4, None, 0), (999, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")
