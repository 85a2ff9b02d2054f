"""A small corpus with all the awkward rows, and a folder of tables made of it."""

import random

import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, size string, slot int, _row int, before string, key string, score string"
TOKEN = "ghp_9fK2xQ7vLm4Rt8Zb3Wn6Yc1Hd5Js0PqA"


def corpus():
    rng = random.Random(3)
    words = ["".join(rng.choices("abcdefghilmnoprstué", k=rng.randint(2, 9))) for _ in range(500)]
    prose = lambda n: " ".join(rng.choice(words) for _ in range(n))
    base = [prose(rng.randint(90, 200)) for _ in range(12)]
    texts = []
    for i in range(120):
        w = rng.choice(base).split()
        for _ in range(rng.randint(0, 3)):
            w[rng.randrange(len(w))] = rng.choice(words)
        cut = rng.randint(0, 20)
        texts.append("\n".join([prose(rng.randint(0, 40)), " ".join(w[cut : cut + rng.randint(40, 160)])]))
    texts += [None, "", " \n\t ", "one", "one two", "ONE Two", "x" * 399, "y" * 400, "z" * 401, "ab " * 500, prose(30000), texts[0], texts[0], texts[0]]
    texts += ["".join(f"{w}*** " for w in prose(120).split()), "\n".join(["SHOUT!! " * 12] * 9)]
    texts += ['token = "04dbebab91ab85687d33eeaaf9ac699e1188f962" é password: token: abcdefgh1', "AKIA" + "A" * 12 + " AKIA1 " + f"use {TOKEN} now", 'API_KEY=abc secret  :  "ABCDEFGH.="', "é" * 10 + "0123456789abcdef" * 4]
    texts += ["<|endoftext|> it's 'll don't. ÀÉ ﬁ q　z", "tie a b c d e f g h i j k l m n o p q r s t", "tie a b c d e f g h i j k l m n o p q r s t"]
    rows = [(i, t, "en", f"s{i % 5}" if i % 11 else None, len(t or ""), "a", 1, 2, "b", "c", "d") for i, t in enumerate(texts)]
    return [*rows, (None, "no number here", "en", "s1", 14, None, None, None, None, None, None), (None, None, None, None, None, None, None, None, None, None, None), rows[7], rows[7]]


@pytest.fixture(scope="session")
def rows():
    return corpus()


@pytest.fixture(scope="session")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="session")
def labels(spark, rows):
    marked = [(r[0], 0 if r[1] and ("***" in r[1] or "SHOUT" in r[1]) else 1, None) for r in rows if r[0] is not None]
    return spark.createDataFrame([*marked, (None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")


@pytest.fixture(scope="session")
def folder(spark, docs, labels, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("tables"))
    docs.select("doc_id", "text", "lang", "source", "n_chars").write.parquet(f"{path}/documents.parquet")
    labels.write.parquet(f"{path}/labels.parquet")
    return path
