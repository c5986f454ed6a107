import random

import pytest

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
#: Columns whose names the operators use themselves.
CLASHING = ["kept", "keep_id", "size", "shard", "slot", "fp", "uid", "chk", "body", "digest", "block", "copies", "rate",
            "row", "id", "key", "n_words", "piece", "pieces", "found", "score", "row_no", "before", "total", "text_sha256"]


def corpus(seed=0, n=60):
    """Small documents with copies, near copies, shared passages, blanks, nulls, ties and one long text."""
    rng = random.Random(seed)
    vocabulary = ["".join(rng.choice("abcdefghé") for _ in range(rng.randint(1, 7))) for _ in range(300)]
    text = lambda k: " ".join(rng.choice(vocabulary) for _ in range(k))
    shared, line = text(40), "This line is common. "
    rows = []
    for d in range(n):
        body = text(rng.randint(3, 120))
        body = rng.choice([body, body + " " + shared, line + body + "\n" + line, body.replace(" ", "\n")])
        rows.append((d, body, rng.choice(["en", "fr", None]), rng.choice(["a", "a", "a", "b", "c", None]), len(body)))
    rows += [(n + k, rows[k % 3][1], "en", "b", 1) for k in range(12)]  # copies
    rows += [(n + 20 + k, rows[5][1] + " tail" * k, "en", "a", 1) for k in range(4)]  # near copies
    rows += [(n + 30, None, None, None, None), (n + 31, "", "en", "a", 0), (n + 32, " \n\t", "fr", "é", 3),
             (n + 33, "123 !?", "fr", "a", 6), (None, "a text without an id " * 5, "en", "a", 1),
             (n + 34, text(5000), "en", "a", 1), (n + 35, "x" * 5000, "en", "c", 1)]
    rows += [rows[7], rows[7], (8, "same id, other text", "en", "a", 1)]  # repeated rows, and a repeated id
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(5).persist()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def clashing(docs):
    return docs.selectExpr("*", *(f"'x' as {c}" for c in CLASHING))


def as_set(df):
    return sorted(map(str, (tuple(r) for r in df.collect())))
