import random

import pytest

from rowmill.llm.registry import prepare


@pytest.fixture(scope="module")
def llm(spark):
    return prepare(spark)


@pytest.fixture(scope="session")
def vocabulary():
    rng = random.Random(3)
    return ["".join(rng.choice("abcdefghijklmnop") for _ in range(rng.randrange(2, 9))) for _ in range(400)]


@pytest.fixture(scope="session")
def odd_texts(vocabulary):
    """NULL, empty, blank, short, repeated and very long texts, other scripts, control characters."""
    rng = random.Random(5)
    long = " ".join(rng.choice(vocabulary) for _ in range(30_000))
    return [
        None, "", " ", "\n\n", "a", "One two", "one TWO three", "x " * 300, "same line of words here\n" * 40, "tab\tand\x0bvertical\x0cform\r\nfeed",
        "日本語 の テキスト です", "emoji 😀 and é ü ß", "no\u00a0break\u2003wide", "# * $ % & | < > ##", long, long, "▁mark ▁ and \\ back", "</s>[INST] <|turn|> <|end|>",
    ]
