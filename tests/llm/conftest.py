"""Documents with every edge the operators name in their docstrings."""

from __future__ import annotations

import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, key string, block int, host string"


def prose(rng: random.Random, n: int) -> str:
    return " ".join("".join(rng.choice("abcdefgé") for _ in range(rng.randint(1, 7))) for _ in range(n))


def rows() -> list[tuple]:
    rng = random.Random(5)
    texts: list[tuple] = [(i, "\n".join(prose(rng, rng.randint(1, 30)) for _ in range(rng.randint(1, 12))))
                          for i in range(40)]
    base = texts[7][1]
    texts += [(100, base), (101, base.replace(" ", "  ", 1)), (102, base.upper()), (103, base + " tail")]
    texts += [(None, base), (None, prose(rng, 12)), (50, None), (51, ""), (52, " \t\n "), (53, "one"), (54, "a b c d"),
              (55, "\x1c x\x85y \U0001f600 z"), (60, prose(rng, 20_000)), (61, "word " * 300), (62, "x\n" * 200),
              (63, "<|endoftext|> a  b   c\t\td \n\n e's I'll 123 4,5!"), (64, texts[3][1]), (64, texts[3][1]), (3, texts[4][1])]
    out = []
    for i, (doc_id, text) in enumerate(texts):
        source = [None, "b", "a", "b", "é", "", "b"][i % 7]
        out.append((doc_id, text, "en" if i % 5 else None, source, len(text) if text else None, "k", 1, "h"))
    return out


@pytest.fixture(scope="session")
def edge_rows() -> list[tuple]:
    return rows()


@pytest.fixture(scope="session")
def edge_docs(spark):
    return spark.createDataFrame(rows(), DOCS).repartition(5)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
