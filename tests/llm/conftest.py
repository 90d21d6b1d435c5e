import random

import pytest

#: Names that operators use inside, as extra columns of the input.
CLASHING = {"size": 1, "key": 2, "row": 3, "n": 4, "rank": 5, "h": 6, "t": 7, "s": 8, "id": 9, "doc": 10, "_id": 11, "n_words": 12, "start": 13, "spans": 14, "length": 15, "site": 16}


def prose(rng, n, vocabulary=3000):
    return " ".join(f"w{rng.randrange(vocabulary)}" for _ in range(n))


def make_documents():
    """(doc_id, text, lang, source): copies, near copies, repeats, nulls, blanks, one long text."""
    rng, rows = random.Random(7), []

    def add(text, source="a", doc_id=0):
        rows.append((len(rows) if doc_id == 0 else doc_id, text, "en", source))

    base = prose(rng, 300)
    for k in range(12):
        add(base, f"s{k % 5}")
    for k in range(10):
        words = base.split()
        words[k * 20 : k * 20 + 1] = ["changed"]
        add(" ".join(words), f"s{k % 3}")
    far = base.split()
    for i in range(0, 300, 4):
        far[i] = "far"
    add(" ".join(far), "s1")
    passage = prose(rng, 90)
    for k in range(6):
        add(prose(rng, 40) + "\n" + passage + "\n" + prose(rng, 60 + k), None if k % 2 else "s2")
    add(prose(rng, 20000), "long")
    line = "Subscribe to our newsletter now."
    for k in range(14):
        add(f"{prose(rng, 60)}\n{line}\n{prose(rng, 30)}", f"site{k}")
    for text in (None, None, "", "   ", "\n\t", "one", "two words", "four little words here", "a b c d e"):
        add(text, "s0")
    add("é" * 500 + " " + "日本語 " * 50, "s0")
    rows.append((3, base, "en", "s3"))  # a repeated row
    rows.append((None, prose(rng, 70), None, None))
    for k in range(30):
        add(prose(rng, 55 + k), f"s{k % 5}")
    return rows


@pytest.fixture(scope="session")
def rows():
    return make_documents()


@pytest.fixture(scope="session")
def documents(spark, rows):
    from pyspark.sql import functions as F

    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    return df.select("*", *[F.lit(v).alias(k) for k, v in CLASHING.items()])


@pytest.fixture(scope="session")
def empty(documents):
    return documents.filter("doc_id = -5")
