import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, block long, n int, ids string, score double"


def make_documents(seed: int = 3, count: int = 120) -> list[tuple]:
    """Texts with copies, near copies, shared passages and lines, junk, nulls, empties, one very long, repeated rows."""
    draw = random.Random(seed)
    words = ["".join(draw.choice(["the", "an", "re", "ou", "ché", "ing", "st", "ë"]) for _ in range(draw.randint(1, 4))) for _ in range(400)]
    passage = " ".join(draw.choice(words) for _ in range(60))
    rows: list[tuple] = []
    for i in range(count):
        kind = draw.random()
        text: str | None = " ".join(draw.choice(words) for _ in range(draw.randint(1, 200)))
        if kind < 0.15 and rows:
            text = draw.choice(rows)[1]
        elif kind < 0.35 and rows:
            parts = (draw.choice(rows)[1] or "a b c").split(" ")
            parts[draw.randrange(len(parts))] = draw.choice(words)
            text = " ".join(parts)
        elif kind < 0.45:
            text = text + "\n" + passage + "\t" + draw.choice(words)
        elif kind < 0.5:
            text = "Shared line 12 of the site.\n" + text.replace(" ", "\n", 3)
        elif kind < 0.55:
            text = " ".join(w.upper() + "!!" for w in text.split())
        elif kind < 0.6:
            text = (draw.choice(words) + " ") * draw.randint(2, 90)
        rows.append((i * 3 % count * 7, text, "en", f"src{i % 3}", 0, 1, 2, "x", 0.5))
    rows += [(10_001, None, None, None, None, None, None, None, None), (10_002, "", "en", "src0", 0, 0, 0, "", 0.0), (10_003, " \n\t ", "en", "src0", 3, 0, 0, "", 0.0), (10_004, "one two", "en", "src0", 7, 0, 0, "", 0.0)]
    rows += [(10_005, " ".join(draw.choice(words) for _ in range(30_000)), "en", "src1", 0, 0, 0, "", 0.0), (None, "a row without an id", "en", "src1", 0, 0, 0, "", 0.0), (10_006, "x" * 50_000, "en", "src1", 0, 0, 0, "", 0.0)]
    return [*rows, rows[5], rows[5]]


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def none(spark):
    return spark.createDataFrame([], SCHEMA)
