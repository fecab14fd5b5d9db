import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
# extra columns whose names operators use themselves
CLASHING = ", spans string, evidence string, id long, token string, chunk int, copy_no int, component_id long, shard int, row int, host string"


def rows_of(texts):
    return [(i, t, "en", f"src{(i or 0) % 3}", len(t or "")) for i, t in texts]


@pytest.fixture(scope="session")
def make(spark):
    def build(texts, clashing=False):
        rows = rows_of(texts)
        if clashing:
            rows = [(*r, "x", "y", 5, "z", 1, 2, 3, 4, 5, "h") for r in rows]
        return spark.createDataFrame(rows, SCHEMA + (CLASHING if clashing else ""))

    return build


@pytest.fixture(scope="session")
def odd_texts():
    """Nulls, empty and blank texts, ties, repeated rows, one very long text, non-ASCII."""
    long = " ".join(f"w{i % 997}x{i % 31}" for i in range(30_000))
    base = [(0, "One two three four five six."), (1, None), (2, ""), (3, " \n\t "), (4, "One two three four five six."), (5, "Ünï cödé wörd \u0085   x"), (6, long), (None, "no id here at all"), (7, "dup row"), (7, "dup row"), (8, "a\x00b \x0b c\x0c d"), (9, "x")]
    return base


@pytest.fixture(scope="session")
def corpus():
    """Texts of a small vocabulary with copies, near copies and shared passages."""
    rng = random.Random(4)
    words = [a + b for a in ("ba", "ke", "lo", "mi", "su", "ta") for b in ("n", "r", "st", "x", "q", "")]
    passage = " ".join(rng.choice(words) for _ in range(40))
    texts = []
    for i in range(120):
        kind = i % 6
        w = [rng.choice(words) for _ in range(rng.choice([3, 4, 5, 20, 60, 120]))]
        if kind == 1 and texts:
            w = rng.choice(texts)[1].split()
        elif kind == 2 and texts:
            w = rng.choice(texts)[1].split()
            for _ in range(max(1, len(w) // 60)):
                w[rng.randrange(len(w))] = "changed"
        elif kind == 3:
            at = rng.randrange(len(w))
            w[at:at] = passage.split()
        text = " ".join(w)
        texts.append((i, text.capitalize() if i % 5 == 0 else text))
    return texts
