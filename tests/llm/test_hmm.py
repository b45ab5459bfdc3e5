import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import hmm
from tickloom.llm.queries import op6_hmm_scoring

SCHEMA = "doc_id bigint, text string, score string, n_tokens string"


def tokens(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + [None]


def base(rows):
    docs = [(i, zlib.crc32(("" if i is None else str(i)).encode()) % 7 == 2, tokens(t)) for i, t in rows]
    c = Counter(w for _, held, ws in docs if not held for w in ws)
    n, v = sum(c.values()), len(c)
    return sorted(((i, held, len(ws), sum(c[w] > 0 for w in ws), n, round(sum(math.log10((c[w] + 1) / (n + v + 1)) for w in ws), 6)) for i, held, ws in docs), key=str)


def read(rows):
    return sorted(((*tuple(r)[:5], round(r["base_score"], 6)) for r in rows), key=str)


def test_query(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = op6_hmm_scoring(spark, sf).collect()
    assert read(got) == base(rows)
    held = [r for r in got if r["held_out"]]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)
    assert all(r["score"] < 0 for r in got)
    again = op6_hmm_scoring(spark, sf).collect()
    assert np.allclose(sorted(r["score"] for r in got), sorted(r["score"] for r in again), rtol=1e-6)


def random_model(k, c, seed=0):
    rng = np.random.default_rng(seed)
    p = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    return hmm.Model(p(k), p(k, k), p(k, c))


def test_forward_and_expected_counts_against_enumeration():
    m = random_model(3, 5)
    docs = [np.array(d) for d in ([0], [4, 1], [2, 2, 0], [1, 3, 4, 0], [0, 1, 2, 3, 4], [3])]
    starts, steps, emits = np.zeros(3), np.zeros((3, 3)), np.zeros((3, 5))
    for d, got in zip(docs, hmm.forward(docs, m)):
        paths = {}
        for path in itertools.product(range(3), repeat=len(d)):
            p = m.start[path[0]] * m.emit[path[0], d[0]]
            for t in range(1, len(d)):
                p *= m.step[path[t - 1], path[t]] * m.emit[path[t], d[t]]
            paths[path] = p
        total = sum(paths.values())
        assert math.isclose(got, math.log10(total), rel_tol=1e-12)
        for path, p in paths.items():
            starts[path[0]] += p / total
            for t in range(len(d)):
                emits[path[t], d[t]] += p / total
                if t:
                    steps[path[t - 1], path[t]] += p / total
    for a, b in zip(hmm.expected(docs, m), (starts, steps, emits)):
        assert np.allclose(a, b)


def test_groups_change_nothing(monkeypatch):
    rng, m = np.random.default_rng(1), random_model(4, 9)
    docs = [rng.integers(0, 9, n) for n in rng.integers(1, 60, 80)]
    whole, counts = hmm.forward(docs, m), hmm.expected(docs, m)
    monkeypatch.setattr(hmm.groups, "__defaults__", (50,))
    assert np.allclose(whole, hmm.forward(docs, m)) and all(np.allclose(a, b) for a, b in zip(counts, hmm.expected(docs, m)))


def test_very_long_text_does_not_underflow():
    assert np.isfinite(hmm.forward([np.zeros(50_000, dtype=int)], random_model(2, 50)))[0]


def test_training_raises_likelihood_and_model_sums_to_one():
    rng, prior = np.random.default_rng(2), np.full(6, 1 / 6)
    docs = [rng.integers(0, 3, 40) + 3 * (i % 2) for i in range(60)]
    model, last = hmm.first_model(docs[:4], prior, 2, 1), -1e9
    for _ in range(6):
        model = hmm.estimate(*hmm.expected(docs, model), prior)
        now = hmm.forward(docs, model).sum()
        assert now > last - 0.5
        last = now
    for p in (model.start, model.step, model.emit):
        assert np.allclose(p.sum(axis=-1), 1)
    assert last > 60 * 40 * math.log10(1 / 6) * 0.75


def test_blocks_and_defined_cases(spark):
    rows = [(1, None), (2, ""), (3, "A a b"), (3, "A a b"), (None, "x\x1cy \x0bz"), (16, "held or not " * 30_000), (5, "É é")]
    docs = spark.createDataFrame([(*r, "s", "n") for r in rows], SCHEMA)
    for size in (3, 10**6):
        assert read(hmm.score_documents(docs, block_tokens=size).collect()) == base(rows)
    assert hmm.score_documents(docs.where("false")).count() == 0


def test_no_training_document(spark):
    docs = spark.createDataFrame([(1, "a b", "", "")], SCHEMA)
    (r,) = hmm.score_documents(docs, is_held=lambda _: True).collect()
    assert r["train_tokens"] == 0 and r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"])


@pytest.mark.parametrize("word", [b"", b"a", b"the", b"longer"])
def test_ending(word):
    assert 0 <= hmm.ending(word) < hmm.ENDINGS
