"""Frames of a few rows are written as a few files, however many partitions a shuffle has, and no link is lost."""

import pytest

from tickloom.llm import similar

from .test_similar import SCHEMA, brute_set, corpus

PARTITIONS = 24


@pytest.fixture
def wide(spark):
    """As many partitions as a shuffle has by settings, none put together."""
    new = {"spark.sql.shuffle.partitions": str(PARTITIONS), "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    old = {k: spark.conf.get(k) for k in new}
    for k, v in new.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def test_files_follow_rows(spark, monkeypatch, wide):
    files, cut = [], similar.cut
    monkeypatch.setattr(similar, "cut", lambda df: files.append((out := cut(df)).rdd.getNumPartitions()) or out)
    rows = [(d, t) for d, t in corpus(40, 40, 14, 104) if t]
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    found, links = similar.similar(docs, hot=4)
    fps = {r["doc_id"]: r["fp"] for r in found.collect()}
    sets = {d: brute_set(t) for d, t in rows}
    want = set()
    for i, x in sets.items():
        for j, y in sets.items():
            if i < j and fps[i] != fps[j] and 9 * len(x & y) >= 4 * (len(x) + len(y)):
                want.add(frozenset((fps[i], fps[j])))
    got = {frozenset((r["a"], r["b"])) for r in links.collect()}
    assert want and got <= want
    # links that a centre stands for need not be listed, but join the same texts
    joined = lambda pairs: sorted(sorted(c) for c in components(pairs))
    assert joined(got) == joined(want)
    assert sum(n >= PARTITIONS for n in files) <= 9 and sum(n == 1 for n in files) >= 8, files


def components(pairs):
    out = []
    for pair in pairs:
        near = [c for c in out if c & pair]
        out = [c for c in out if not c & pair] + [set(pair).union(*near)]
    return out
