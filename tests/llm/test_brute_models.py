"""Phrase names and HMM scores against versions written anew, symbol by symbol and document by document."""

import math
import zlib
from collections import Counter

import numpy as np
import pytest

from tickloom.llm import hmm, parsing
from tickloom.llm.queries import op6_hmm_scoring, op7_document_fingerprints

MASK = (1 << 64) - 1
STEP = 0x9E3779B97F4A7C15


def scramble(x):
    """The finalizer of splitmix64."""
    x = ((x ^ (x >> 30)) * 0xBF58476D1CE4E5B9) & MASK
    x = ((x ^ (x >> 27)) * 0x94D049BB133111EB) & MASK
    return x ^ (x >> 31)


def toss(symbol, left):
    k = 0
    while (symbol >> k) & 1 == (left >> k) & 1:
        k += 1
    return 2 * k + (symbol >> k & 1)


def next_level(symbols):
    runs = []
    for s in symbols:
        if runs and runs[-1][0] == s:
            runs[-1][1] += 1
        else:
            runs.append([s, 1])
    symbols = [s if n == 1 else scramble((s + n * STEP) & MASK) for s, n in runs]
    labels = symbols
    for _ in range(4):
        labels = [toss(s, labels[i - 1] if i else s ^ 1) for i, s in enumerate(labels)]
    n = len(labels)
    peaks = [i for i in range(n) if i == 0 or (i < n - 1 and labels[i - 1] < labels[i] > labels[i + 1])]
    names = []
    for a, b in zip(peaks, [*peaks[1:], n]):
        total = sum(scramble((s + (k + 1) * STEP) & MASK) for k, s in enumerate(symbols[a:b])) & MASK
        names.append(scramble(total))
    return names


def kept(names, n):
    seen, out = Counter(), set()
    for name in names:
        again = seen[name]
        seen[name] += 1
        out.add((scramble((name + again * STEP) & MASK) if again else name) >> 32)
    return sorted(out)[:n]


def plain_fingerprint(text):
    levels, symbols = {}, [ord(c) for c in text]
    for level in (1, 2, 3):
        symbols = levels[level] = next_level(symbols)
    found = {level: kept(levels[level], n) for level, n in ((3, 48), (2, 16))}
    found[1] = kept(levels[1], 16) if len(found[2]) < 8 else []
    return found


def as_string(found):
    return ".".join("".join(f"{x:08x}" for x in found[level]) for level in (3, 2, 1))


def plain_likeness(a, b):
    levels = [x for x in (3, 2, 1) if a[x] and b[x]]
    if not levels:
        return float(not any(a.values()) and not any(b.values()))
    level = next((x for x in levels if min(len(a[x]), len(b[x])) >= 8), levels[-1])
    full = {3: 48, 2: 16, 1: 16}[level]
    top = min([x[level][-1] for x in (a, b) if len(x[level]) == full], default=1 << 32)
    p, q = ({v for v in x[level] if v <= top} for x in (a, b))
    return 2 * len(p & q) / (len(p) + len(q)) if p & q else 0.0


def test_fingerprints_by_symbol():
    rng = np.random.default_rng(11)
    texts = ["", "a", "aa", "ab", "aaaa" * 30, "é日" * 20, "\U0001d518x\U0001d518"]
    texts += ["".join(chr(97 + c) for c in rng.integers(0, k, n)) for k, n in ((2, 300), (26, 2000), (4, 57), (3, 9))]
    texts += [texts[-3][:1500] + "tail", texts[-3][200:]]
    for text, got in zip(texts, parsing.fingerprints(texts)):
        assert parsing.as_string(got) == as_string(plain_fingerprint(text)), text[:40]


def test_query_by_symbol(spark, sf):
    rows = sorted((r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{sf}/documents.parquet").where("doc_id < 60 or doc_id is null").collect())
    texts = dict(rows)
    got = {r["doc_id"]: r for r in op7_document_fingerprints(spark, sf).where("doc_id < 59").collect()}
    for (i, text), (_, after) in zip(rows, rows[1:]):
        if len(text) > 20_000:
            continue
        cut = len(text) // 4
        own, edited, other = (plain_fingerprint(x) for x in (text, text[: len(text) - cut] + after[:cut], after))
        assert (got[i]["fingerprint"], got[i]["edited_fingerprint"]) == (as_string(own), as_string(edited))
        assert got[i]["near_edited"] == pytest.approx(plain_likeness(own, edited)) and got[i]["near_next"] == pytest.approx(plain_likeness(own, other))
    assert len(texts) > 40


def words_of(text):
    for c in "\t\n\x0b\f\r":
        text = text.replace(c, " ")
    return [w.encode() for w in "".join(c.lower() if "A" <= c <= "Z" else c for c in text).split(" ") if w] + [b""]


def plain_scores(rows, rounds, states=hmm.STATES):
    """Class model, Baum-Welch and likelihood, a document and a token at a time."""
    docs = [(i, zlib.crc32(str(i).encode()) % 7 == 2, words_of(t or "")) for i, t in rows]
    count = Counter(w for _, held, ws in docs if not held for w in ws)
    total = sum(count.values())
    own = [w for w in sorted(count, key=lambda w: (-count[w], w)) if count[w] >= max(2.0, hmm.LEAST_SHARE * total)][: hmm.OWN]
    place = {w: k for k, w in enumerate(own)}
    class_of = lambda w: place.get(w, len(own) + zlib.crc32(w[-3:]) % 2048)
    n_classes = len(own) + 2048
    tokens, members = np.zeros(n_classes), np.zeros(n_classes)
    for w, c in count.items():
        tokens[class_of(w)] += c
        members[class_of(w)] += w not in place
    prior = (tokens + 1) / (tokens.sum() + n_classes)
    model = hmm.first_model([], prior, states, 0)  # the seeded start is the operator's own
    start, step, emit = model.start, model.step, model.emit
    for _ in range(rounds):
        n_start, n_step, n_emit = np.zeros(states), np.zeros((states, states)), np.zeros((states, n_classes))
        for _, held, ws in docs:
            if held:
                continue
            seq = [class_of(w) for w in ws]
            alpha, scale = [], []
            for t, c in enumerate(seq):
                now = emit[:, c] * (start if t == 0 else alpha[-1] @ step)
                scale.append(now.sum())
                alpha.append(now / scale[-1])
            beta = np.ones(states)
            for t in range(len(seq) - 1, -1, -1):
                posterior = alpha[t] * beta
                n_emit[:, seq[t]] += posterior
                if t:
                    ahead = emit[:, seq[t]] * beta / scale[t]
                    n_step += np.outer(alpha[t - 1], ahead) * step
                    beta = step @ ahead
                else:
                    n_start += posterior
        start = (n_start + 1) / (n_start.sum() + states)
        step = (n_step + 1) / (n_step.sum(axis=1, keepdims=True) + states)
        emit = (n_emit + 5 * prior) / (n_emit.sum(axis=1, keepdims=True) + 5)
    out = []
    for i, _, ws in docs:
        log, state = 0.0, None
        for w in ws:
            c = class_of(w)
            now = emit[:, c] * (start if state is None else state @ step)
            log += math.log10(now.sum())
            state = now / now.sum()
            if w not in place:
                log += math.log10((count[w] + 1) / (tokens[c] + members[c] + 1))
        out.append((i, log))
    return out


def test_scores_by_token(spark):
    rng = np.random.default_rng(2)
    vocabulary = ["".join(chr(97 + c) for c in rng.integers(0, 26, rng.integers(1, 7))) for _ in range(300)]
    rows = [(i, " ".join(rng.choice(vocabulary[: 40 + 260 * (i % 3 == 0)], rng.integers(0, 60)))) for i in range(90)] + [(900, None), (901, "Never seen zzzz9")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r["doc_id"]: r["score"] for r in hmm.score_documents(docs, rounds=3, block_tokens=400).collect()}
    for i, score in plain_scores(rows, 3):
        assert got[i] == pytest.approx(score, rel=1e-9), i


def test_held_out_likelihood_beats_one_state(spark, sf):
    """The latent states help on documents that training hasn't seen."""
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    held = lambda df: df.where("held_out").agg({"score": "sum", "n_tokens": "sum"}).first()
    eight, one = held(op6_hmm_scoring(spark, sf)), held(hmm.score_documents(docs, states=1))
    assert eight[0] / eight[1] > one[0] / one[1] + 0.1
