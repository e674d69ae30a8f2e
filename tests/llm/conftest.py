import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent))
FOLDER = "/root/testdata/sf0.001"

MAIL = "Write to ann.b@mail.example.com or +44 (0)20 7946 0958, host 10.0.0.255, card 4111 1111 1111 1111."
BASE = " ".join(f"word{k} said{k % 7}" for k in range(60))
LONG = " ".join(f"long{k % 9973} text{k % 389}" for k in range(60_000))
#: id, text, lang, source, and columns whose names operators use inside.
ROWS = [
    (1, None, None, None), (2, "", "en", "a"), (3, " \n\t ", None, "a"), (4, MAIL, "en", None),
    (5, BASE, "en", "a"), (5, BASE, "en", "a"), (6, BASE.replace("word3 ", "other "), "en", "a"),
    (7, BASE.upper(), None, "b"), (None, BASE, "en", "a"), (None, "alone here", "fr", "b"),
    (8, "x", "en", "b"), (9, "x", "fr", "b"), (10, "same line\nsame line\n" * 30, "en", "b"),
    (11, LONG, "en", "a"), (12, LONG + " end", "en", "a"), (13, "Licensed under the Apache License, Version 2.0.", "en", "a"),
    (14, "çà et là, dont't 's 're x@y.z 1.2.3.4.5.6.7.8 1.2.3.999 +1(2 ++123456789 0000 0000 0000 0000", "fr", "c"),
]
EXTRA = ("th string, h string, cid string, spans string, kept string, host string, key string, words string, "
         "sig string, place string, a string, b string, n string, item_id string, name string, hashes string")


@pytest.fixture(scope="session")
def texts(spark):
    return {r["doc_id"]: r for r in spark.read.parquet(f"{FOLDER}/documents.parquet").collect()}


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls, empty and very long texts, ties, repeated rows, clashing names."""
    extra = tuple("?" for _ in EXTRA.split(","))
    rows = [(i, t, lang, source, None if t is None else len(t), *extra) for i, t, lang, source in ROWS]
    return spark.createDataFrame(rows, f"doc_id bigint, text string, lang string, source string, n_chars bigint, {EXTRA}")


@pytest.fixture(scope="session")
def none(odd):
    return odd.limit(0)
