"""Baum-Welch learns from every training document and token, until the likelihood settles."""

import numpy as np

from tickloom.llm import hmm

SCHEMA = "doc_id bigint, text string"


def test_every_round_sees_whole_documents(spark, monkeypatch):
    first = []
    monkeypatch.setattr(hmm, "first_model", lambda sample, *a, real=hmm.first_model: first.append(sample) or real(sample, *a))
    rng = np.random.default_rng(1)
    word = lambda topic: f"{'ab'[topic]}{rng.integers(20)}"
    # two topics take turns in long runs, past the first 1,024 tokens alone
    texts = ["x " * 1100 + " ".join(word(j // 50 % 2) for j in range(400)) for _ in range(30)]
    got = hmm.score_documents(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()
    assert not first[0]  # no documents are set apart to start from
    held = [r for r in got if r["held_out"]]
    assert held and sum(r["score"] - r["base_score"] for r in held) > 400 * len(held) * np.log10(2) * 0.8


def test_likelihood_of_expected_is_the_forward_one():
    rng = np.random.default_rng(2)
    p = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s))
    m, docs = hmm.Model(p(3), p(3, 3), p(3, 7)), [rng.integers(0, 7, n) for n in (1, 5, 9)]
    assert np.isclose(hmm.expected_and_likelihood(docs, m)[3], hmm.forward(docs, m).sum())
