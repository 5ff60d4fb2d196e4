"""A small table of documents with the corner cases every operator must take."""

import pytest

KIND = "doc_id long, text string, lang string, source string, n_chars long, node string, seed int, at string"


def prose(seed: int, n: int) -> str:
    """Invented words, the same for the same arguments."""
    out = []
    x = seed * 7919 + 13
    for i in range(n):
        x = (x * 1103515245 + 12345) % 2**31
        out.append("".join("abcdefghijklmnopqrstuvwxyz"[(x >> (3 * k)) % 26] for k in range(2 + x % 7)))
        if i % 12 == 11:
            out[-1] += "."
    return " ".join(out)


def changed(text: str, every: int) -> str:
    return " ".join("changed" if i % every == every - 1 else w for i, w in enumerate(text.split(" ")))


@pytest.fixture(scope="session")
def corner_rows():
    base = prose(1, 300)
    texts = [
        None, "", " ", "\n \n", "one", "one two three four", "one two three four five", base, base, changed(base, 150),
        changed(base, 20), base.upper(), prose(2, 4000), "été 中文 😀 naïve" * 3, "x" * 30_000,
        "a  b   c\t\td \n\n e. f,g;h", "<|endoftext|> and <|endoftext|>more", "#*$ % & | < >", "same line\nsame line\nother\nsame line",
        "\x1c odd \x85 spaces   here", "0 1 2 3 4 5 6 7 8 9 10", prose(3, 60), prose(3, 60), None,
    ]
    rows = [(i, t, "en" if i % 3 else None, f"src{i % 7}" if i % 5 else None, None if t is None else len(t), "x", 1, "y") for i, t in enumerate(texts)]
    rows.append(rows[7])  # a repeated row
    rows.append((None, "a row without a key and some words", None, None, 1, "x", 1, "y"))
    rows.append((12, "another text under a key that exists", "en", "src1", 3, "x", 1, "y"))
    return rows


@pytest.fixture(scope="session")
def corner(spark, corner_rows):
    return spark.createDataFrame(corner_rows, KIND).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], KIND)
