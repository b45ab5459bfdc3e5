"""Scoring texts by a hidden Markov language model.

Tokens are lower-case words and an end of text. The commonest words have a class of their own, the others share classes by
their last letters; latent states emit classes, and a class its words by their smoothed counts, so that the states'
parameters have a fixed size whatever the vocabulary. Counts are those of all training documents: tasks turn their
documents into blocks of word numbers and send each block's vocabulary once, the words' counts are summed over blocks, and
go back to the blocks. Baum-Welch starts from all training documents' counts, with seeded noise for each state; each of its
rounds sums expected counts over all training documents, per partition first, until their likelihood settles. Long documents
are run piece by piece there, exactly. The score is the exact log-likelihood by the scaled forward recursion.

Defined cases. Null text: empty, the end alone. Null doc_id: split as if its text were empty. Repeated rows: each counts
and is scored. Words that training lacks: they share what is left to their class, as one more word. No training document:
one state's uniform guess. Ties among the commonest words: by bytes. An empty table gives an empty table. Other columns
are not looked at.
"""

from __future__ import annotations

import math
import uuid
import zlib
from collections.abc import Callable, Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import cut, delete, map_arrow, release, shared_dir

STATES = 8
#: Words with a class of their own, at most, and classes of other words by their last bytes.
OWN, ENDINGS, ENDING_BYTES = 4096, 2048, 3
#: A word gets a class of its own only if it makes up this share of the tokens; there are 1 / LEAST_SHARE such words at most.
LEAST_SHARE = 2e-5
#: Tokens of a block, and of what is run through the recursions at once.
BLOCK_TOKENS, GROUP_TOKENS = 2_500_000, 350_000
#: Training cuts longer sequences into pieces of so many tokens, which are run side by side; it changes the time, no result.
PIECE_TOKENS = 2048
#: Tokens whose posteriors are added to their classes at once.
COUNTED_TOKENS = 1 << 16
#: Places that are run without scaling, at most, and powers of ten that products may go through meanwhile.
MOST_UNSCALED, RANGE = 16, 200
#: Pieces that are multiplied at once, and the relative difference at which rows of a product are taken for proportional.
CARRIED_PIECES, SAME = 512, 1e-13
#: Places that are laid out at once.
LAID_OUT_PLACES = 1024
#: Tasks that sum up the partitions' counts of a round; the driver gets a row of each.
SUMMING_TASKS = 8
#: The likelihood has settled once a training token gains less (of log10) in each of so many rounds, one after another.
LEAST_GAIN, SETTLED_ROUNDS = 1e-4, 2
END = b""


def held_out(doc_id: int | None) -> bool:
    return zlib.crc32(b"" if doc_id is None else str(doc_id).encode()) % 7 == 2


def ending(word: bytes) -> int:
    return zlib.crc32(word[-ENDING_BYTES:]) % ENDINGS


# Blocks: documents as word numbers, and the block's vocabulary


#: number: a word's, and of a document how many ids it has.
BLOCKS = "block bigint, doc_id bigint, held_out boolean, ids binary, word binary, number int, n_train bigint, ending int"


def split(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Lower-case words of texts, one after another, and how many each text has."""
    lists = pc.ascii_split_whitespace(pc.ascii_lower(pc.fill_null(texts.cast(pa.string()), "")))
    words, ends = lists.flatten(), lists.offsets.to_numpy()
    there = pc.not_equal(pc.binary_length(words), 0)  # white space at a text's ends is given empty words
    before = np.concatenate([[0], np.cumsum(there.to_numpy(zero_copy_only=False))])
    return words.filter(there), np.diff(before[ends - ends[0]])


def endings(words: pa.Array) -> pa.Array:
    found = pc.binary_slice(words, -ENDING_BYTES).dictionary_encode()
    return pa.array([ending(w) for w in found.dictionary.to_pylist()], pa.int32()).take(found.indices)


def _blocks(batches: Iterator[pa.RecordBatch], is_held: Callable, block_tokens: int) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext

    block = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 24
    parts: list[pa.Array] = []
    docs: list[tuple] = []
    tokens, packing = 0, pa.Codec("zstd")
    kinds = (pa.int64(), pa.int64(), pa.bool_(), pa.binary(), pa.binary(), pa.int32(), pa.int64(), pa.int32())
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def rows(columns: dict, n: int) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(columns[c], k) if c in columns else pa.nulls(n, k) for c, k in zip(names, kinds)], names=names)

    def out() -> Iterator[pa.RecordBatch]:
        coded = pa.chunked_array(parts, pa.string()).dictionary_encode().combine_chunks()
        if isinstance(coded, pa.ChunkedArray):  # of no chunk
            coded = pa.array([], pa.string()).dictionary_encode()
        words = pa.concat_arrays([pa.array([END]), coded.dictionary.cast(pa.binary())])  # the end is number 0
        x, train, at = coded.indices.to_numpy().astype("<u4") + np.uint32(1), np.zeros(len(words), dtype=np.int64), 0
        for i in range(0, len(docs), 2000):
            part, packed, begin = docs[i : i + 2000], [], at
            for _, _, n in part:
                packed.append(packing.compress(x[at : at + n].tobytes() + bytes(4), asbytes=True))
                at += n
            ids, held, n = zip(*part)
            yield rows({"block": [block] * len(part), "doc_id": ids, "held_out": held, "ids": packed, "number": np.array(n) + 1}, len(part))
            learnt = ~np.array(held)
            train += np.bincount(x[begin:at][np.repeat(learnt, n)], minlength=len(words))
            train[0] += learnt.sum()
        ends = endings(words)
        for i in range(0, len(words), 50_000):
            part = words[i : i + 50_000]
            yield rows({"block": np.full(len(part), block), "word": part, "number": np.arange(i, i + len(part)), "n_train": train[i : i + len(part)], "ending": ends[i : i + len(part)]}, len(part))

    for batch in batches:
        words, counts = split(batch.column(1))
        at = 0
        for doc_id, n in zip(batch.column(0).to_pylist(), counts.tolist()):
            docs.append((doc_id, is_held(doc_id), n))
            at, tokens = at + n, tokens + n + 1
            if tokens >= block_tokens:
                parts.append(words[:at])
                yield from out()
                block, parts, docs, tokens, words, at = block + 1, [], [], 0, words[at:], 0
        parts.append(words[:at])
    if docs:
        yield from out()


# The latent states' recursions, over many documents at a time


class Model:
    """start (K), step (K, K), emit (K, C): probabilities."""

    def __init__(self, start: np.ndarray, step: np.ndarray, emit: np.ndarray):
        self.start, self.step, self.emit = start, step, emit


def groups(docs: list[np.ndarray], tokens: int = GROUP_TOKENS) -> Iterator[np.ndarray]:
    """Indices of documents, the longest first, so many as have about `tokens`."""
    order = np.argsort([-len(d) for d in docs], kind="stable")
    at = 0
    while at < len(order):
        end, n = at, 0
        while end < len(order) and (end == at or n + len(docs[order[end]]) <= tokens):
            n += len(docs[order[end]])
            end += 1
        yield order[at:end]
        at = end


def laid_out(docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents, the longest first: their tokens place by place, and where each place begins."""
    lengths = np.array([len(d) for d in docs])
    active = np.bincount(lengths, minlength=lengths.max() + 1)
    active = (len(docs) - np.cumsum(active))[:-1]  # documents longer than each place
    begins = np.concatenate([[0], np.cumsum(active)])
    flat = np.empty(begins[-1], dtype=np.int64)
    for t in range(0, len(active), LAID_OUT_PLACES):
        some = docs[: active[t]]
        rows = np.empty((len(some), min(LAID_OUT_PLACES, len(active) - t)), dtype=docs[0].dtype)
        for row, d in zip(rows, some):
            part = d[t : t + LAID_OUT_PLACES]
            row[: len(part)] = part
        for i, row in enumerate(np.ascontiguousarray(rows.T), t):
            flat[begins[i] : begins[i + 1]] = row[: active[i]]
    return flat, begins


class Ratios:
    """A model's emissions as ratios to the states' mean, so that products stay near 1 and needn't be scaled at every place.

    every: places after which they must be, for no path of the states to leave a double's range.
    """

    def __init__(self, model: Model):
        mean = model.emit.mean(axis=0)
        mean = np.where(mean > 0, mean, 1.0)
        self.of_class = np.ascontiguousarray((model.emit / mean).T)
        self.log_mean = np.log10(mean)
        least = min(1.0, float(self.of_class.min()) * min(float(model.step.min()), float(model.start.min())))
        reach = max(-math.log10(max(least, 1e-300)), math.log10(max(2.0, float(self.of_class.max()))))
        self.every = max(1, min(MOST_UNSCALED, int(RANGE // reach)))


def forward(docs: list[np.ndarray], model: Model) -> np.ndarray:
    """Log10 likelihood of each sequence of classes; none is empty."""
    out = np.zeros(len(docs))
    ratios, ones = Ratios(model), np.ones(len(model.start))
    for chosen in groups(docs):
        flat, begins = laid_out([docs[i] for i in chosen])
        total, cuts = np.zeros(len(chosen)), [*begins.tolist(), begins[-1]]
        means = ratios.log_mean[flat]
        for t in range(len(cuts) - 2):
            a, b = cuts[t], cuts[t + 1]
            now = ratios.of_class[flat[a:b]]
            now *= model.start if t == 0 else state[: b - a] @ model.step
            total[: b - a] += means[a:b]
            if t % ratios.every == ratios.every - 1:
                scale = now @ ones
                now /= scale[:, None]
                total[: b - a] += np.log10(scale)
            if (on := cuts[t + 2] - b) < b - a:  # the others end here
                total[on : b - a] += np.log10(now[on:] @ ones)
            state = now
        out[chosen] = total
    return out


def expected(docs: list[np.ndarray], model: Model) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Baum-Welch counts of starts, steps and emissions."""
    return expected_and_likelihood(docs, model)[:3]


class Pieces:
    """Sequences cut so that none is longer than `most`, with what the recursions bring to each piece's ends.

    Only a sequence's first piece may be shorter. The others' products of steps and emissions carry the states'
    probabilities over them from both sides, exactly; so long sequences run beside each other piece by piece.
    """

    def __init__(self, docs: list[np.ndarray], model: Model, ratios: Ratios, most: int):
        k = len(model.start)
        self.docs: list[np.ndarray] = []
        begins = []
        for d in docs:
            begins.append(len(self.docs))
            at = (len(d) - 1) % most + 1
            self.docs += [d[:at], *(d[i : i + most] for i in range(at, len(d), most))]
        n = len(self.docs)
        self.first = np.zeros(n, dtype=bool)
        self.first[begins] = True
        #: The states' probabilities before a piece, of no meaning for first ones; and what follows it, in any scale.
        self.before, self.after = np.full((n, k), 1 / k), np.ones((n, k))
        later = np.nonzero(~self.first)[0]
        for i in range(0, len(later), CARRIED_PIECES):
            some = later[i : i + CARRIED_PIECES]
            # a first piece's first place has no step before it
            ahead = carried([self.docs[j - 1][int(self.first[j - 1]) :] for j in some], model, ratios, from_end=True)
            for j, over in zip(some.tolist(), ahead):
                now = (model.start * ratios.of_class[self.docs[j - 1][0]] if self.first[j - 1] else self.before[j - 1]) @ over
                self.before[j] = now / now.sum()
        for i in range(len(later), 0, -CARRIED_PIECES):
            some = later[max(0, i - CARRIED_PIECES) : i]
            behind = carried([self.docs[j] for j in some], model, ratios, from_end=False)
            for j, over in zip(some[::-1].tolist(), behind[::-1]):
                back = over @ self.after[j]
                self.after[j - 1] = back / back.sum()


def carried(docs: list[np.ndarray], model: Model, ratios: Ratios, from_end: bool) -> np.ndarray:
    """Products of steps and emissions over sequences, a matrix each in a scale of its own: state before, state after.

    Products of many places come to have rank one: the states at one end no longer depend on those at the other. Places are
    multiplied from one end on until this holds to within rounding, or up to the other end; the end begun from is exact then,
    and the other one's states are given as equal.
    """
    n, k = len(docs), len(model.start)
    lengths = np.array([len(d) for d in docs])
    on = np.argsort(-lengths, kind="stable")
    lengths = lengths[on]
    classes = np.zeros((n, lengths[0]), dtype=np.int64)
    for row, i in zip(classes, on.tolist()):
        row[: len(docs[i])] = docs[i][::-1] if from_end else docs[i]
    classes, columns = np.ascontiguousarray(classes.T), np.arange(n)
    step = np.ascontiguousarray(model.step.T) if from_end else model.step
    out, now = np.empty((n, k, k)), np.repeat(np.eye(k)[None], n, axis=0)  # state where it begins, state where it is
    for t in range(classes.shape[0] + 1):
        if (m := int(np.searchsorted(-lengths, -t))) < len(on):  # the others end here
            out[on[m:]] = now[m:]
            on, now, lengths, columns = on[:m], now[:m], lengths[:m], columns[:m]
        if not m:
            break
        here = ratios.of_class.take(classes[t].take(columns), 0)[:, None]
        if from_end:
            now *= here
            now = (now.reshape(m * k, k) @ step).reshape(m, k, k)
        else:
            now = (now.reshape(m * k, k) @ step).reshape(m, k, k)
            now *= here
        if t % ratios.every == ratios.every - 1:
            sums = now.sum(axis=2, keepdims=True)
            shape = now / sums
            same = (np.abs(shape - shape[:, :1]) <= SAME * shape[:, :1]).all(axis=(1, 2))
            now /= sums.sum(axis=1, keepdims=True)
            if same.any():
                out[on[same]] = sums[same]
                on, now, lengths, columns = on[~same], now[~same], lengths[~same], columns[~same]
    return out.transpose(0, 2, 1) if from_end else out


def expected_and_likelihood(docs: list[np.ndarray], model: Model, most: int = PIECE_TOKENS) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    """Baum-Welch counts, and the documents' log10 likelihood."""
    likelihood = 0.0
    k, n_classes = model.emit.shape
    starts, steps, emits = np.zeros(k), np.zeros((k, k)), np.zeros((k, n_classes))
    ratios, ones, step_back = Ratios(model), np.ones(k), np.ascontiguousarray(model.step.T)
    pieces = Pieces(docs, model, ratios, most)
    room, turned = np.empty(0), np.empty((k, COUNTED_TOKENS))  # the same memory for all groups
    for chosen in groups(pieces.docs):
        flat, begins = laid_out([pieces.docs[i] for i in chosen])
        if len(room) < (n := (len(flat) + len(chosen)) * k):
            room = np.empty(n)
        alpha, seen = room[: len(flat) * k].reshape(-1, k), room[len(flat) * k : n].reshape(-1, k)
        first, before, after = pieces.first[chosen], pieces.before[chosen], pieces.after[chosen]
        cuts, scales = [*begins.tolist(), begins[-1]], {}
        for t in range(len(cuts) - 2):
            a, b = cuts[t], cuts[t + 1]
            now, here = alpha[a:b], seen[: b - a]
            ratios.of_class.take(flat[a:b], 0, here, "clip")
            if t:
                np.dot(alpha[cuts[t - 1] : cuts[t - 1] + b - a], model.step, now)
            else:
                now[:] = np.where(first[:, None], model.start, before @ model.step)
            now *= here
            if t % ratios.every == ratios.every - 1:
                scale = now @ ones
                likelihood += float(np.log10(scale).sum())
                scales[t] = scale[:, None]
                now /= scales[t]
        last = alpha[begins[[len(pieces.docs[i]) - 1 for i in chosen]] + np.arange(len(chosen))]
        likelihood += float(np.log10(last @ ones).sum())
        after /= (last * after).sum(axis=1)[:, None]
        # after is beta from here on: of a piece that ends earlier it is what follows it still
        for t in range(len(cuts) - 3, -1, -1):
            a, b = cuts[t], cuts[t + 1]
            beta, weighted = after[: b - a], seen[: b - a]
            alpha[a:b] *= beta  # from here on the posterior
            ratios.of_class.take(flat[a:b], 0, weighted, "clip")
            weighted *= beta
            if t in scales:
                weighted /= scales[t]
            if t:
                p = cuts[t - 1]
                steps += alpha[p : p + b - a].T @ weighted
                np.dot(weighted, step_back, beta)
        at_start = cuts[1]
        steps += before[~first].T @ seen[:at_start][~first]
        starts += alpha[:at_start][first].sum(axis=0)
        for a in range(0, len(flat), COUNTED_TOKENS):
            some = flat[a : a + COUNTED_TOKENS]
            for i in range(0, len(some), 2048):
                turned[:, i : i + 2048][:, : len(some) - i] = alpha[a + i : a + min(i + 2048, len(some))].T
            for s in range(k):
                emits[s] += np.bincount(some, weights=turned[s, : len(some)], minlength=n_classes)
    # posteriors add up to a class's tokens
    likelihood += float(emits.sum(axis=0) @ ratios.log_mean)
    return starts, steps * model.step, emits, likelihood


def estimate(starts: np.ndarray, steps: np.ndarray, emits: np.ndarray, prior: np.ndarray) -> Model:
    """From expected counts; prior: the classes' overall probabilities, to which a state's emissions lean."""
    k = len(starts)
    lean = 5.0
    return Model(
        (starts + 1) / (starts.sum() + k), (steps + 1) / (steps.sum(axis=1, keepdims=True) + k),
        (emits + lean * prior) / (emits.sum(axis=1, keepdims=True) + lean),
    )


def first_model(sample: list[np.ndarray], prior: np.ndarray, states: int, rounds: int, seed: int = 3) -> Model:
    """Baum-Welch on the sample, from states that stay and that lean to some of its documents each."""
    rng = np.random.default_rng(seed)
    emits = np.stack([prior * rng.gamma(2.0, 0.5, len(prior)) for _ in range(states)])
    for s in range(states):
        for i in rng.choice(len(sample), min(3, len(sample)), replace=False) if sample else []:
            emits[s] += np.bincount(sample[i], minlength=len(prior)) / max(1, len(sample[i])) / 3
    model = Model(np.full(states, 1 / states), np.full((states, states), 0.1 / states) + 0.9 * np.eye(states), emits / emits.sum(axis=1, keepdims=True))
    for _ in range(rounds if sample else 0):
        model = estimate(*expected(sample, model), prior)
    return model


# Spark


def _encode(n_tokens: int, n_distinct: int, totals: dict):
    """Of a block's documents and of its words' counts and classes: classes, and what doesn't depend on the states."""
    class_tokens, class_words, own = totals["tokens"], totals["words"], totals["own"]
    kinds = (pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.float64(), pa.float64(), pa.binary())

    def encode(docs: pa.Table, words: pa.Table) -> pa.Table:
        release()
        number = words.column("number").to_numpy()
        count, of_class = np.empty(len(number), dtype=np.int64), np.empty(len(number), dtype=np.int64)
        count[number], of_class[number] = words.column("c").to_numpy(), words.column("class").to_numpy()
        base = np.log10((count + 1) / (n_tokens + n_distinct + 1))
        within = np.where(of_class < own, 0.0, np.log10((count + 1) / (class_tokens[of_class] + class_words[of_class] + 1)))
        packed_class, out = of_class.astype("<u2"), []
        packing = pa.Codec("zstd")
        for doc_id, held, ids, n in zip(*(docs.column(c).to_pylist() for c in ("doc_id", "held_out", "ids", "number"))):
            x = np.frombuffer(packing.decompress(ids, 4 * n), dtype="<u4")
            out.append((doc_id, held, len(x), int((count[x] > 0).sum()), float(base[x].sum()), float(within[x].sum()), packed_class[x].tobytes()))
        columns = list(zip(*out)) or [()] * len(kinds)
        return pa.table([pa.array(c, k) for c, k in zip(columns, kinds)], names=[c.split()[0] for c in ENCODED.split(", ")])

    return encode


ENCODED = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, base_score double, word_score double, classes binary"


def _sequences(batch: pa.RecordBatch, column: int) -> list[np.ndarray]:
    return [np.frombuffer(b, dtype="<u2") for b in batch.column(column).to_pylist()]


def _expect(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """A partition's expected counts of starts, steps and emissions, and its likelihood: one after another, of fixed size."""
    total: np.ndarray | None = None
    for batch in batches:
        found = np.concatenate([np.ravel(x) for x in expected_and_likelihood(_sequences(batch, 0), model)])
        total = found if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.astype("<f8").tobytes()])], names=["sums"])


def _sum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total: np.ndarray | None = None
    for batch in batches:
        for sums in batch.column(0):
            found = np.frombuffer(sums.as_buffer(), dtype="<f8")
            total = found.copy() if total is None else total + found
    if total is not None:
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()])], names=["sums"])


def _score(batches: Iterator[pa.RecordBatch], model: Model, n_tokens: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        score = forward(_sequences(batch, 6), model) + batch.column(5).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([*[batch.column(i) for i in range(4)], pa.array(np.full(len(score), n_tokens)), batch.column(4), pa.array(score)], names=[c.split()[0] for c in SCORES.split(", ")])


SCORES = "doc_id bigint, held_out boolean, n_tokens bigint, n_known bigint, train_tokens bigint, base_score double, score double"


def score_documents(docs: DataFrame, *, is_held: Callable = held_out, states: int = STATES, rounds: int | None = None, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """Each document's base and model score, by a model trained on those that are not held out.

    Training goes on until the likelihood settles, or for so many rounds.
    """
    spark = docs.sparkSession
    folder = f"{shared_dir(spark)}/hmm-{uuid.uuid4().hex}"

    def stored(df: DataFrame, name: str) -> DataFrame:
        df.write.parquet(f"{folder}/{name}")
        return spark.read.schema(df.schema).parquet(f"{folder}/{name}")

    blocks = stored(map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(_blocks, is_held=is_held, block_tokens=block_tokens), BLOCKS), "blocks")
    by_word = Window.partitionBy("word")
    words = blocks.where("word is not null").select("word", "block", "number", "n_train", "ending")
    # a block has a word once, so that one sort by words is enough
    words = words.withColumns({"c": F.sum("n_train").over(by_word), "first": F.col("block") == F.min("block").over(by_word)})
    words = stored(words, "words")
    distinct = words.where(F.col("first") & (F.col("c") > 0))
    n_tokens, n_distinct = distinct.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    # 1 / LEAST_SHARE words at most can be so common
    common = distinct.where(F.col("c") >= max(2.0, LEAST_SHARE * n_tokens)).select("word", "c", "ending").collect()
    top = sorted(common, key=lambda r: (-r["c"], bytes(r["word"])))[:OWN]
    own = len(top)
    n_classes = own + ENDINGS
    tokens, in_class = np.zeros(n_classes, dtype=np.int64), np.zeros(n_classes, dtype=np.int64)
    for r in distinct.groupBy("ending").agg(F.sum("c").alias("c"), F.count("*").alias("n")).collect():
        tokens[own + r["ending"]], in_class[own + r["ending"]] = r["c"], r["n"]
    for i, r in enumerate(top):  # at most OWN
        tokens[i] = r["c"]
        tokens[own + r["ending"]] -= r["c"]
        in_class[own + r["ending"]] -= 1
    prior = (tokens + 1) / (tokens.sum() + n_classes)
    names = spark.createDataFrame([(bytes(r["word"]), i) for i, r in enumerate(top)], "word binary, own int")
    classed = words.join(F.broadcast(names), "word", "left").select("block", "number", "c", F.coalesce("own", F.col("ending") + own).alias("class"))
    encode = _encode(n_tokens, n_distinct, {"tokens": tokens, "words": in_class, "own": own})
    there = blocks.where("ids is not null").select("block", "doc_id", "held_out", "ids", "number")
    encoded = stored(there.groupBy("block").cogroup(classed.groupBy("block")).applyInArrow(encode, ENCODED), "encoded")
    for name in ("blocks", "words"):
        delete(spark, f"{folder}/{name}")
    training = encoded.where(~F.col("held_out")).select("doc_id", "classes")
    model = first_model([], prior, states, 0)
    done, small, last = 0, 0, -math.inf
    while n_tokens and (small < SETTLED_ROUNDS if rounds is None else done < rounds):
        # files of a round, as files of a shuffle would stay for all rounds; in two jobs, and a few rows for the driver
        sums = stored(map_arrow(training.select("classes"), partial(_expect, model=model), "sums binary", tidy=False), f"round-{done}")
        parts = map_arrow(sums.coalesce(SUMMING_TASKS), _sum, "sums binary", tidy=False).toArrow().column("sums")
        summed = np.sum([np.frombuffer(x.as_buffer(), dtype="<f8") for x in parts], axis=0)
        delete(spark, f"{folder}/round-{done}")
        starts, steps, emits, now = np.split(summed, np.cumsum([states, states * states, states * n_classes]))
        model = estimate(starts, steps.reshape(states, states), emits.reshape(states, n_classes), prior)
        likelihood = float(now[0])
        small = small + 1 if likelihood - last < LEAST_GAIN * n_tokens else 0
        done, last = done + 1, likelihood
    scored = cut(map_arrow(encoded, partial(_score, model=model, n_tokens=n_tokens), SCORES))
    delete(spark, folder)
    return scored
