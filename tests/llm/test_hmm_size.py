"""What scoring takes: rounds leave no files of a shuffle, long documents' products end early, words are split in Arrow."""

import numpy as np
import pyarrow as pa
import pytest

from tickloom.llm import hmm

from .test_hmm_pieces import model_of, plain


def test_rounds_shuffle_nothing(spark):
    docs = spark.createDataFrame([(i, f"a b{i % 7} c{i % 3} d") for i in range(60)], "doc_id bigint, text string")
    store = spark.sparkContext._jsc.sc().statusStore()

    def written(rounds):
        before = sum(s.shuffleWriteBytes() for s in stages())
        hmm.score_documents(docs, rounds=rounds)
        return sum(s.shuffleWriteBytes() for s in stages()) - before

    def stages():
        spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
        found = store.stageList(None, False, False, getattr(spark._jvm.scala.Array, "emptyDoubleArray")(), None)
        return [found.apply(i) for i in range(found.size())]

    written(1)
    one = written(1)
    assert one > 0 and written(5) == one


def test_partial_sums_add_up():
    m, rng = model_of(3, 6, 1), np.random.default_rng(1)
    docs = [rng.integers(0, 6, n).astype("<u2") for n in (1, 9, 30, 4)]
    batch = lambda some: pa.RecordBatch.from_arrays([pa.array([d.tobytes() for d in some])], names=["classes"])
    parts = [b for some in ([docs[:1], docs[1:2]], [docs[2:]]) for b in hmm._expect(map(batch, some), m)]
    (summed,) = hmm._sum(iter(parts))
    starts, steps, emits, likelihood = np.split(np.frombuffer(summed.column(0)[0].as_py()), np.cumsum([3, 9, 18]))
    want = plain(docs, m)
    for a, b in zip((starts, steps.reshape(3, 3), emits.reshape(3, 6), likelihood[0]), want):
        assert np.allclose(a, b, rtol=1e-9)


def sticky(k, c):
    m = model_of(k, c, 8)
    return hmm.Model(m.start, 0.02 * m.step + 0.98 * np.eye(k), m.emit)


def frozen(k, c):
    """States that hardly change and emit alike: a product of 400 places has no rank of one."""
    return hmm.Model(np.full(k, 1 / k), (1 - 1e-6) * np.eye(k) + 1e-6 / k, np.full((k, c), 1 / c))


@pytest.mark.parametrize("model", [model_of(4, 9, 5), sticky(4, 9), frozen(4, 9)])
@pytest.mark.parametrize("from_end", [True, False])
def test_products_that_end_early_are_exact(model, from_end):
    rng, ratios = np.random.default_rng(6), hmm.Ratios(model)
    docs = [rng.integers(0, 9, n) for n in (400, 0, 1, 17, 400, 33)]
    before, after = rng.random(4) + 1e-3, rng.random(4) + 1e-3
    for d, got in zip(docs, hmm.carried(docs, model, ratios, from_end=from_end)):
        over = np.eye(4)
        for x in d:
            over = over @ (model.step * model.emit[:, x])
            over /= over.sum()
        have, want = (before @ got, before @ over) if from_end else (got @ after, over @ after)
        assert np.allclose(have / have.sum(), want / want.sum(), rtol=1e-11)


@pytest.mark.parametrize("model", [model_of(4, 9, 5), sticky(4, 9), frozen(4, 9)])
def test_long_documents_in_pieces(model, monkeypatch):
    monkeypatch.setattr(hmm, "CARRIED_PIECES", 3)
    rng = np.random.default_rng(7)
    docs = [rng.integers(0, 9, n) for n in (2500, 401, 400, 3, 1, 1601)]
    for a, b in zip(hmm.expected_and_likelihood(docs, model, 400), plain(docs, model)):
        assert np.allclose(a, b, rtol=1e-9, atol=1e-12)


def test_long_documents_take_a_part_of_their_places(monkeypatch):
    """Places of products, before the other end no longer matters; a whole product would take 2,000."""
    places = []

    class Counted(np.ndarray):
        def take(self, *a, **k):
            places.append(len(a[0]))
            return np.asarray(self).take(*a, **k)

    model, rng = model_of(4, 9, 5), np.random.default_rng(9)
    ratios = hmm.Ratios(model)
    ratios.of_class = ratios.of_class.view(Counted)
    pieces = hmm.Pieces([rng.integers(0, 9, 8000)], model, ratios, 2000)
    assert len(pieces.docs) == 4 and sum(places) < 2000


def test_layout_by_place(monkeypatch):
    monkeypatch.setattr(hmm, "LAID_OUT_PLACES", 4)
    docs = [np.arange(n, dtype="<u2") + 100 * n for n in (11, 9, 9, 4, 2, 1)]
    flat, begins = hmm.laid_out(docs)
    want = [[d[t] for d in docs if len(d) > t] for t in range(11)]
    assert flat.tolist() == [x for place in want for x in place] and begins.tolist() == [0, *np.cumsum([len(p) for p in want]).tolist()]


def test_split_is_that_of_bytes():
    texts = ["  a  B ", "", None, " ", "x\x1cy \x0bz\x0c\x0d\tq\x85", "É é\xa0w K ABC", "one", "\n\n"]
    whole = pa.array(["skipped words", *texts])
    words, counts = hmm.split(whole[1:])
    want = [(t or "").encode().lower().split() for t in texts]
    assert [w.encode() for w in words.to_pylist()] == [w for ws in want for w in ws]
    assert counts.tolist() == [len(ws) for ws in want]


def test_endings_are_those_of_each_word():
    words = [b"", b"a", b"the", b"longer", b"anger", "é".encode()]
    assert hmm.endings(pa.array(words)).to_pylist() == [hmm.ending(w) for w in words]
