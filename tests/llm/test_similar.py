"""Links at a Jaccard similarity of 0.8 on five-word shingles, and the pipeline's stage with them, against all pairs."""

import random
from collections import defaultdict

import pytest

import corpus_pipeline
from tickloom.llm import similar

from .test_simhash import brute_fingerprint

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"


def brute_set(text):
    words = (text or "").lower().split()
    return {" ".join(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def brute_kept(rows):
    sets, fps = [brute_set(t) for _, t in rows], [brute_fingerprint(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    edited = 0
    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            alike = bool(shared) and 9 * shared >= 4 * (len(sets[i]) + len(sets[j]))
            near = (fps[i] ^ fps[j]).bit_count() <= 2
            edited += alike and not near
            if alike or near:
                root[find(i)] = find(j)
    least = defaultdict(list)
    for i, (d, _) in enumerate(rows):
        least[find(i)].append(d)
    return sorted(map(min, least.values())), edited


def corpus(n, group, edits, seed):
    """Texts of their own, and a group of copies with some words replaced; at some edits a pair is near 0.8."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(5000)}"
    texts = [" ".join(word() for _ in range(rng.randrange(1, 200))) for _ in range(n)]
    base = [word() for _ in range(150)]
    for _ in range(group):
        words = list(base)
        for at in rng.sample(range(len(words)), rng.randrange(edits)):
            words[at] = word()
        texts.append(" ".join(words))
    texts += ["", None, "one two", "one two", "One  two three", texts[3]]
    rng.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


@pytest.mark.parametrize("group,edits,hot", [(12, 8, 32), (90, 6, 4), (90, 14, 4)])
def test_stage_finds_edited_copies(spark, monkeypatch, group, edits, hot):
    monkeypatch.setitem(similar.similar.__kwdefaults__, "hot", hot)
    monkeypatch.setitem(similar.similar.__kwdefaults__, "salted", 16)
    rows = corpus(60, group, edits, group + edits)
    docs = spark.createDataFrame([(d, t, "en", "s", 0) for d, t in rows], SCHEMA)
    kept, edited = brute_kept(rows)
    assert edited
    got = corpus_pipeline.near_dedup(spark, docs, "")
    assert got.columns == docs.columns and sorted(r["doc_id"] for r in got.collect()) == kept
