import random
import re

import pytest

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def draw(rng: random.Random, n: int, vocabulary: int = 4000) -> list[str]:
    return [f"w{rng.randrange(vocabulary)}" for _ in range(n)]


def doc_rows(texts, source="s"):
    """Rows of DOCS: ids by place, a given id where a text comes as (id, text)."""
    out = []
    for i, t in enumerate(texts):
        i, t = t if isinstance(t, tuple) else (i, t)
        out.append((i, t, ["en", "de", None][(i or 0) % 3], f"{source}{(i or 0) % 2}", len(t or "")))
    return out


@pytest.fixture(scope="session")
def odd_texts():
    """Null, empty, blank, tiny, very long, repeated rows and ids, text of one character, other scripts."""
    rng = random.Random(11)
    long_ = " ".join(draw(rng, 60_000))
    once = " ".join(draw(rng, 80))
    return [None, "", " \n\t ", "one", "a b c d", "x" * 3000, long_, once, once, (8, once), (8, once), (None, once), (None, None),
            "日本語 のテキスト です " * 40, "É È <|endoftext|> !!\r\n\r\n", (5, "other text under the same id " * 30)]


@pytest.fixture(scope="session")
def odd_docs(spark, odd_texts):
    """The odd texts with an extra column, and one that clashes with internal names."""
    rows = [(*r, "k", i) for i, r in enumerate(doc_rows(odd_texts))]
    return spark.createDataFrame(rows, DOCS + ", key string, token long").repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], DOCS)
