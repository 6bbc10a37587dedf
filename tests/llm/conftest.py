import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, shard int, size string"
ODD = [None, "", " \t\n ", "x", "A b\nc", "don't stop 3.5%", "ünïcode ß é", "a " * 3000, "same text here", "same text here"]


def made(seed: int, n: int) -> list[str]:
    """Texts of random words, with exact copies and copies that differ in a word."""
    draw = random.Random(seed)
    words = ["".join(draw.choice("abcdefghij") for _ in range(draw.randrange(2, 8))) for _ in range(300)]
    out: list[str] = []
    for _ in range(n):
        if out and draw.random() < 0.3:
            text = draw.choice(out).split(" ")
            if draw.random() < 0.6:
                text[draw.randrange(len(text))] = draw.choice(words)
            out.append(" ".join(text))
        else:
            out.append("\n".join(" ".join(draw.choice(words) for _ in range(draw.randrange(3, 40))) for _ in range(draw.randrange(1, 4))))
    return out


@pytest.fixture(scope="session")
def texts():
    return ODD + made(1, 120)


@pytest.fixture(scope="session")
def docs(spark, texts):
    rows = [(i * 3, t, "en", None if i % 11 == 0 else f"s{i % 5}", len(t or ""), 0.5, 7, "clash") for i, t in enumerate(texts)]
    rows.append((None, "no id", "en", "s1", 5, 0.5, 7, "clash"))
    return spark.createDataFrame(rows, SCHEMA).repartition(5)


@pytest.fixture(scope="session")
def empty(docs):
    return docs.limit(0)
