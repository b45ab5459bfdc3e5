"""corpus_pipeline, stage by stage, against brute force, and as a whole."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as p

from . import test_mixing as by_mixing
from . import test_packing as by_packing
from . import test_rules as by_rules
from . import test_simhash as by_simhash


@pytest.fixture(scope="module")
def stages(spark, sf, tmp_path_factory):
    """The rows that go into each stage, and the last one's result; each stage's output is written and read again."""
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    for n, (name, stage) in enumerate(p.STAGES):
        out.append(docs.collect())
        at = str(tmp_path_factory.mktemp("stages") / str(n))
        stage(spark, docs, sf).write.parquet(at)
        docs = spark.read.parquet(at)
        if n < 3:
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    return [*out, docs.collect()]


def test_stages_have_an_effect(stages):
    sizes = [len(s) for s in stages]
    assert sizes[0] > sizes[1] > sizes[2] > 0


def brute_kept(text):
    n, chars, symbols, dup, repeat, failed = by_rules.brute(text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, lower = len(re.findall("[A-Z]", text)), len(re.findall("[a-z]", text))
    return not (failed or 10 * symbols > n or not 2 * n <= chars <= 12 * n or 10 * dup > 3 * len(lines) or upper > 0.5 * max(1, upper + lower))


def test_quality_rules(stages):
    assert sorted(r["doc_id"] for r in stages[1]) == sorted(r["doc_id"] for r in stages[0] if brute_kept(r["text"]))


def test_near_dedup(stages):
    ids = [r["doc_id"] for r in stages[1]]
    groups = by_simhash.brute_components(ids, [by_simhash.brute_fingerprint(r["text"]) for r in stages[1]])
    assert sorted(r["doc_id"] for r in stages[2]) == sorted(set(groups))
    texts = [r["text"] for r in stages[2]]
    assert len(set(texts)) == len(texts)


def test_mixing(stages):
    size = lambda r: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or ""))
    before, most, taken = defaultdict(int), defaultdict(int), defaultdict(int)
    for r in stages[2]:
        before[r["source"]] += size(r)
        most[r["source"]] = max(most[r["source"]], size(r))
    for r in stages[3]:
        taken[r["source"]] += size(r)
    for source, target in by_mixing.brute_targets(before).items():
        assert abs(taken[source] - target) <= most[source] / 2 + 1e-6
    times = Counter(r["doc_id"] for r in stages[3])
    assert max(times.values()) == 2 and set(times) <= {r["doc_id"] for r in stages[2]}


def test_packing(stages):
    n, tokens = by_packing.check([(r["doc_id"], r["text"]) for r in stages[3]], stages[4])
    assert n <= 1.05 * tokens / 4096 + 1


def test_run(spark, sf, stages):
    got = p.run(spark, sf)
    key = lambda r: (r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, got.collect())) == sorted(map(key, stages[4]))


def test_empty(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("false")
    for _, stage in p.STAGES:
        out = stage(spark, docs, sf)
        assert out.count() == 0
        docs = docs if "piece" in out.columns else out
