"""Small tables with the awkward cases: nulls, empty and long texts, ties, repeated rows, extra columns."""

import random

import pytest

WORDS = [f"w{i}" for i in range(300)]


@pytest.fixture(scope="session")
def odd_documents(spark):
    """Columns of documents and more, some with names that operators use inside."""
    source = random.Random(3)
    base = " ".join(source.choice(WORDS) for _ in range(120))
    rows = []
    for i in range(60):
        if i % 5 == 0:
            text = base
        elif i % 5 == 1:
            words = base.split(" ")
            for _ in range(source.choice([0, 1, 2, 3, 6])):
                words[source.randrange(len(words))] = source.choice(WORDS)
            text = " ".join(words)
        else:
            text = " ".join(source.choice(WORDS) for _ in range(source.choice([1, 3, 8, 40, 90])))
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "  \t\n"), (63, base.replace(" ", "\n", 9)), (64, base.upper()), (65, "x" * 40_000), (66, (base + " ") * 60), (67, "é" * 70), (68, "á ẛ 你好")]
    rows += [(None, base), (7, rows[7][1]), (7, rows[7][1])]
    made = [(i, t, "en" if (i or 0) % 2 else None, f"s{(i or 0) % 3}" if (i or 0) % 7 else None, len(t or ""), "part", 1.5) for i, t in rows]
    return spark.createDataFrame(made, "doc_id long, text string, lang string, source string, n_chars long, part string, size double").repartition(3)


@pytest.fixture(scope="session")
def no_documents(odd_documents):
    return odd_documents.limit(0)
