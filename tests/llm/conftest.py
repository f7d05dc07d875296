import random

import pytest

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rank int, leaf long, fp string, n_lines string, unit string"


def word(r):
    return "".join(r.choice("abcdefghijklmnopqrstuvwxyzéü") for _ in range(r.randint(2, 9)))


def corpus(seed=5, n=60):
    """Prose of a small vocabulary with copies, near copies, shared passages and odd texts."""
    r = random.Random(seed)
    vocabulary = [word(r) for _ in range(300)]
    prose = lambda k: " ".join(r.choice(vocabulary) + r.choice(["", "", ",", ".\n"]) for _ in range(k))
    passage = prose(60)
    texts = [prose(r.randint(5, 160)) for _ in range(n)]
    for i in range(0, n, 6):
        texts[i] = texts[i] + "\n" + passage + "\n" + texts[i + 1][:80]
    for i in range(3, n, 9):
        words = texts[i - 1].split(" ")
        words[len(words) // 2] = "changed"
        texts[i] = " ".join(words)
    texts += [texts[2], texts[2], texts[4]]
    odd = ["", None, " \n\t ", "a", "\x0b\x0c\r", "1234 !!", "x" * 5000, "same word " * 400, "🙂 ümlaut　wide nbsp\x85nel", prose(20000), "Ünïcödé ÀÉ ABC abc", "\x00nul"]
    return texts + odd


@pytest.fixture(scope="session")
def texts():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, texts):
    """documents with extra columns whose names clash with inner ones."""
    rows = [(i, t, "en" if i % 3 else "fr", f"s{i % 4}" if i % 5 else None, len(t or ""), 1, 2, "x", "y", "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS).repartition(5)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], DOCS)
