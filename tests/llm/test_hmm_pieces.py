"""Training runs long documents piece by piece and without scaling at every place; neither changes its counts."""

import numpy as np
import pytest

from tickloom.llm import hmm


def model_of(k, c, seed, sharp=1.0):
    rng = np.random.default_rng(seed)
    p = lambda *s: (lambda x: x / x.sum(axis=-1, keepdims=True))(rng.random(s) ** sharp + 1e-9)
    return hmm.Model(p(k), p(k, k), p(k, c))


def plain(docs, model):
    """Scaled recursions, a document and a place at a time."""
    k, c = model.emit.shape
    starts, steps, emits, likelihood = np.zeros(k), np.zeros((k, k)), np.zeros((k, c)), 0.0
    for d in docs:
        alpha, scale = [], []
        for t, x in enumerate(d):
            now = model.emit[:, x] * (model.start if t == 0 else alpha[-1] @ model.step)
            scale.append(now.sum())
            alpha.append(now / scale[-1])
        likelihood += np.log10(scale).sum()
        beta = np.ones(k)
        for t in range(len(d) - 1, -1, -1):
            emits[:, d[t]] += alpha[t] * beta
            if t == 0:
                starts += alpha[t] * beta
                break
            ahead = model.emit[:, d[t]] * beta / scale[t]
            steps += np.outer(alpha[t - 1], ahead) * model.step
            beta = model.step @ ahead
    return starts, steps, emits, likelihood


@pytest.mark.parametrize("sharp", [1.0, 12.0])  # 12: some paths are next to impossible
@pytest.mark.parametrize("most", [1, 2, 7, 40, 10**9])
def test_pieces_change_nothing(most, sharp):
    rng, model = np.random.default_rng(3), model_of(4, 9, 5, sharp)
    docs = [rng.integers(0, 9, n) for n in [*range(1, 18), 40, 41, 79, 80, 81, 300, 7, 14]]
    want, got = plain(docs, model), hmm.expected_and_likelihood(docs, model, most)
    for a, b in zip(got, want):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)
    assert np.isclose(hmm.forward(docs, model).sum(), want[3], rtol=1e-12)


def test_short_and_long_groups(monkeypatch):
    rng, model = np.random.default_rng(4), model_of(3, 6, 6)
    docs = [rng.integers(0, 6, n) for n in rng.integers(1, 90, 60)]
    want = plain(docs, model)
    monkeypatch.setattr(hmm.groups, "__defaults__", (50,))
    for a, b in zip(hmm.expected_and_likelihood(docs, model, 11), want):
        assert np.allclose(a, b, rtol=1e-9)


def test_places_grow_with_the_longest_piece_not_the_longest_document(monkeypatch):
    """One long document among short ones doesn't run alone through all of its places."""
    places = []
    monkeypatch.setattr(hmm, "laid_out", lambda docs, real=hmm.laid_out: places.append(max(map(len, docs))) or real(docs))
    docs = [np.zeros(5000, dtype=int), *(np.zeros(3, dtype=int) for _ in range(20))]
    hmm.expected_and_likelihood(docs, model_of(2, 3, 7))
    assert max(places) <= hmm.PIECE_TOKENS


def test_a_round_takes_few_jobs_whatever_the_partitions(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c") for i in range(40)], "doc_id bigint, text string")
    settings = {"spark.sql.shuffle.partitions": "37", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {k: spark.conf.get(k) for k in settings}

    def jobs(rounds):
        group = f"rounds-{rounds}"
        spark.sparkContext.setJobGroup(group, group)
        try:
            hmm.score_documents(docs, rounds=rounds)
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        return len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))

    try:
        for k, v in settings.items():
            spark.conf.set(k, v)
        assert jobs(3) - jobs(1) <= 2 * 3
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
