import os
import random
import tempfile

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

from compare import TABLES

DOCUMENTS = T.StructType([
    T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()),
    T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()),
])
PLAIN = {"documents": DOCUMENTS}
WORDS = [a + b + c for a in ("ba", "ke", "lo", "mi") for b in ("na", "re", "ti", "su", "vo") for c in ("d", "l", "rs", "nt", "mes", "ka")]


def sentence(rng: random.Random, n: int) -> str:
    return " ".join(rng.choice(WORDS) for _ in range(n))


@pytest.fixture(scope="session")
def corpus():
    """Rows of documents: copies, near copies, secrets, repeated rows, NULL ids and columns, empty and very long texts."""
    rng = random.Random(4)
    texts = [sentence(rng, rng.randint(3, 90)) for _ in range(60)]
    base = sentence(rng, 60).split()
    for k in range(30):  # a group of near copies
        own = list(base)
        own[rng.randrange(60)] = f"w{k}"
        texts.append(" ".join(own))
    texts += [texts[3]] * 12 + [texts[5].upper(), "\t" + texts[5].replace(" ", "\n")]
    texts += [None, None, "", " \n\t ", "one", "one", "one two three four", "One two  three four", "été ünï code ​x"]
    texts += [
        "password = hunter2hunter2 and secret: abc token='0123456789abcdef0123456789abcdef'", "AKIA" + "A" * 11, "AKIA" + "A1" * 6 + " x", "f" * 31 + "g" + "0" * 40,
        "-----BEGIN RSA PRIVATE KEY-----\nAPI_KEY=\"deadbeefdeadbeefdeadbeefdeadbeef\"", "ünï password:secret:longenough1 é" + "a" * 33,
    ]
    texts.append(" ".join(rng.choice(WORDS) + str(k % 97) for k in range(30_000)))
    texts.append("a" * 100_000)
    rows = []
    for i, text in enumerate(texts):
        rows.append((i, text, rng.choice(["en", "de", None]), rng.choices(["web", "book", "code", None], [8, 2, 1, 1])[0], None if text is None else len(text)))
    secret = next(r for r in rows if r[1] and "hunter2" in r[1])
    rows += [secret, secret, (990, *secret[1:])]
    rows += [rows[10], rows[10], rows[95], (None, texts[7], "en", "web", 5), (None, texts[7], "en", "web", 5), (None, None, None, None, None)]
    return rows


@pytest.fixture(scope="session")
def documents(spark, corpus):
    """The corpus with further columns whose names the operators use themselves."""
    docs = spark.createDataFrame(corpus, DOCUMENTS)
    for name in ("id", "n", "key", "hash", "class", "row", "blob", "size", "host", "score", "text_hash", "_key", "_hash", "_of", "_doc"):
        docs = docs.selectExpr("*", f"7 AS `{name}`")
    return docs


@pytest.fixture(scope="session")
def no_documents(spark):
    return spark.createDataFrame([], DOCUMENTS)


@pytest.fixture(scope="session")
def folder():
    """Writes tables, given as name and arrow table, to a new folder and returns it."""

    def write(**tables) -> str:
        path = tempfile.mkdtemp(prefix="run-", dir="/tmp")
        for name, table in tables.items():
            pq.write_table(table, os.path.join(path, f"{name}.parquet"))
        return path

    return write


@pytest.fixture(scope="session")
def document_table(corpus):
    names = DOCUMENTS.names
    types = [pa.int64(), pa.string(), pa.string(), pa.string(), pa.int64()]
    return pa.table({n: pa.array([r[i] for r in corpus], t) for i, (n, t) in enumerate(zip(names, types))})
