import hashlib

import numpy as np
import pytest

from tickloom.llm import parsing
from tickloom.llm.queries import op7_document_fingerprints

SCHEMA = "doc_id bigint, text string, n_chars string"


def brute(rows):
    """By id and text, each with the next one's first code points."""
    rows = sorted(((i, t or "") for i, t in rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    out = []
    for k, (i, t) in enumerate(rows):
        after = rows[(k + 1) % len(rows)][1]
        edited = t[: len(t) - len(t) // 4] + after[: len(t) // 4]
        own, other, changed = (parsing.fingerprints([x])[0] for x in (t, after, edited))
        digest = hashlib.sha256(edited.encode()).hexdigest()
        out.append((i, len(t), digest, parsing.as_string(own), parsing.as_string(changed), parsing.likeness(own, changed), parsing.likeness(own, other)))
    return sorted(out, key=str)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op7_document_fingerprints(spark, sf).collect()
    assert sorted(map(tuple, got), key=str) == brute(rows)
    long = [r for r in got if r["n_chars"] >= 400]
    assert np.median([r["near_edited"] for r in long]) > 0.65
    assert np.median([r["near_next"] for r in long]) < 0.1
    assert all(0 <= r["near_edited"] <= 1 and 0 <= r["near_next"] <= 1 for r in got)


def test_many_ranges(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").limit(150)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for rows_a_range in (1, 7, 1000):
        assert sorted(map(tuple, parsing.fingerprint_with_next(docs, rows_a_range).collect()), key=str) == brute(rows)


@pytest.mark.parametrize("rows", [
    [(1, "alone")], [(1, None), (2, "")], [(None, "first"), (3, "x"), (3, "x"), (3, "w"), (-7, "é" * 50)], [(5, "long one " * 50_000), (4, "b"), (6, "aaaa" * 1000)],
])
def test_defined_cases(spark, rows):
    docs = spark.createDataFrame([(*r, "n") for r in rows], SCHEMA)
    assert sorted(map(tuple, parsing.fingerprint_with_next(docs, 1).collect()), key=str) == brute(rows)
    assert parsing.fingerprint_with_next(docs.where("false")).count() == 0


def test_equal_substrings_share_names():
    rng = np.random.default_rng(5)
    text = "".join(chr(97 + c) for c in rng.integers(0, 26, 4000))
    names = []
    for before in ("", "x", "another beginning ", "é" * 333):
        symbols = np.frombuffer((before + text).encode("utf-32-le"), dtype="<u4").astype(np.uint64)
        number = np.zeros(len(symbols), dtype=int)
        for _ in range(3):
            symbols, number = parsing.one_level(symbols, number)
        names.append(symbols.tolist())
    for other in names[1:]:
        shared = 0
        while names[0][-1 - shared] == other[-1 - shared]:
            shared += 1
        assert shared > len(names[0]) - 12
    assert 2 < 4000 ** (1 / 3) / len(names[0]) ** (1 / 3) < 4


def test_batching_changes_nothing(monkeypatch):
    rng = np.random.default_rng(6)
    texts = ["".join(chr(97 + c) for c in rng.integers(0, 3, n)) for n in [0, 1, 2, 3, 50, 0, 999, 5, 0]]
    alone = [parsing.as_string(parsing.fingerprints([t])[0]) for t in texts]
    for size in (1, 60, 10**6):
        monkeypatch.setattr(parsing, "AT_ONCE", size)
        assert [parsing.as_string(f) for f in parsing.fingerprints(texts)] == alone
    back = [parsing.from_string(x) for x in alone]
    assert [parsing.as_string(f) for f in back] == alone


def test_bounds(spark):
    from pyspark.sql import functions as F

    bounds = [-5, 0, 3, 10, 11, 50, 51, 52, 90, 100]
    for n in range(1, 11):
        got = spark.range(-5, 120).select("id", parsing.range_of(F.col("id"), bounds[:n]).alias("r")).collect()
        assert all(r["r"] == sum(b <= r["id"] for b in bounds[:n]) - 1 for r in got)
