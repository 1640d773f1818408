import random

import pytest


@pytest.fixture(scope="session")
def corpus():
    """doc_id, text, lang, source, extra: nulls, empty and long texts, copies, shared passages, repeated rows, ties."""
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdeéñ", k=rng.randint(1, 7))) for _ in range(300)]
    passage = " ".join(rng.choices(vocabulary, k=60))
    rows = []
    for i in range(120):
        words = rng.choices(vocabulary, k=rng.choice([1, 2, 3, 19, 20, 21, 80, 200, 400]))
        text = "".join(w + rng.choice([" ", "\n", "  ", "\t", " ", "\x0b"]) for w in words)
        if i % 5 == 0:
            text = text + passage + " " + text[:50]
        if i % 7 == 0:
            text = text.upper()
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choice(["src0", "src0", "src1", "src10", None]), i % 3))
    for i in range(120, 150):
        source = rows[rng.randrange(120)]
        words = source[1].split(" ")
        if i % 3:
            words[rng.randrange(len(words))] = "changed"
        rows.append((i, " ".join(words), source[2], source[3], 0))
    rows += [(150, None, None, None, None), (151, "", "en", "src0", 1), (152, " \n\t ", "en", "src1", 1), (None, passage, "en", "src0", 1), (153, " ".join(["same"] * 30), "en", "src1", 2), (154, "a b c " * 15 + "d", "en", "src1", 2)]
    rows += [rows[3], rows[3], (7, rows[8][1], "en", "src0", 0)]  # repeated rows, and a doc_id with two texts
    rows.append((155, " ".join(rng.choices(vocabulary, k=20000)), "de", "src1", 0))
    return rows


SCHEMA = "doc_id long, text string, lang string, source string, size int"


@pytest.fixture(scope="session")
def docs(spark, corpus):
    """The corpus as a table; its extra column is named like an output of some operators."""
    return spark.createDataFrame(corpus, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)
