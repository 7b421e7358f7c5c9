import random

import pytest
from pyspark.sql import types as T

#: Columns beside the ones that operators read, with names that they use inside.
EXTRA = ("id", "key", "row", "n", "digest", "batch", "kind", "bucket", "score", "s1", "component", "host")
SCHEMA = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType())]
    + [T.StructField(c, T.StringType()) for c in EXTRA]
)


def make_texts() -> list[str | None]:
    rng = random.Random(7)
    vocabulary = [f"{a}{b}" for a in ("the", "tion", "wo", "él", "ß") for b in ("an", "or", "ing", "zu", "que", "st")]

    def prose(n: int) -> str:
        return " ".join(rng.choice(vocabulary) + rng.choice(["", "", ",", "."]) + rng.choice(["", "\n"][: 1 + (rng.random() < 0.1)]) for _ in range(n))

    base = [prose(rng.randint(60, 200)) for _ in range(25)]
    texts: list[str | None] = [None, "", " ", "\n\n", "a", "one two three", "one two three", "12 345 !!", "日本 語 🙂", "<|endoftext|> x", "tab\tand\x0bother  white \x85 space\n"]
    texts += base + base[:5] + [base[0]] * 6
    for t in base[:12]:  # near copies: one word in forty differs
        words = t.split(" ")
        for k in range(0, len(words), 40):
            words[k] = "Changed" + str(k)
        texts.append(" ".join(words))
    line = "A common line that many documents hold"
    texts += [f"{x}\n{line}\n  {line.upper()} \nshort\nshort" for x in base[15:20]]
    texts.append(prose(20_000))
    return texts


@pytest.fixture(scope="session")
def corpus() -> list[tuple]:
    rows = [(i, t, ["en", "fr", None][i % 3], "src0", None if t is None else len(t), *EXTRA) for i, t in enumerate(make_texts())]
    return rows


@pytest.fixture(scope="session")
def docs(spark, corpus):
    return spark.createDataFrame(corpus, SCHEMA).repartition(3).cache()


@pytest.fixture(scope="session")
def no_docs(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def odd_docs(spark, corpus):
    """Null ids and repeated rows."""
    rows = [*corpus[:14], *corpus[3:8], *((None, *corpus[i][1:]) for i in (0, 1, 5, 12, 12))]
    return spark.createDataFrame(rows, SCHEMA).cache()
