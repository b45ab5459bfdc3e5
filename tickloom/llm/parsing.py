"""Document fingerprints by locally consistent parsing.

A text starts as the sequence of its code points. On each level runs of an equal symbol become one symbol; then
deterministic coin tossing relabels every symbol by the lowest bit in which it differs from its left neighbour and that
bit's value, four times over, until six labels are left; a phrase begins at each local maximum of the labels. As
a phrase's borders depend on a few neighbours alone, equal substrings are parsed alike, but for a few symbols at their
ends, at whatever offset they stand. A phrase's name is a hash of its symbols, and the names are the next level's symbols.
Phrases grow about threefold a level.

A fingerprint keeps, of each of two levels (and of the lowest for short texts), the names that hash lowest, repetitions
told apart by their number; the likeness of two is the share of phrases that they have in common, 2 J / (1 + J) of the Jaccard coefficient J that such samples
estimate, on the highest level on which both have enough phrases.

Pairing a document with the next one takes one shuffle of the texts, by ranges of ids: a range's first document is dealt to
the range before it as well, so that no task has to ask another.

Defined cases. Null text: empty. Empty text: a fingerprint without names, like another such one (1) and no other (0). Null
doc_id: before all others. Repeated ids: ordered by text; equal rows follow each other. One document alone: the next one
is itself. An empty table gives an empty table. Other columns are not looked at.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import map_arrow

#: Level: names kept. The lowest is kept for texts that have fewer than ENOUGH names on the next.
KEPT = {3: 48, 2: 16, 1: 16}
ENOUGH = 8
#: Code points that are parsed at once, about.
AT_ONCE = 1 << 19
#: Documents of a range, about.
RANGE_ROWS = 4096
_G = np.uint64(0x9E3779B97F4A7C15)
_LOWEST = np.array([(v & -v).bit_length() - 1 if v else 7 for v in range(256)], dtype=np.uint8)


def mix(x: np.ndarray) -> np.ndarray:
    """The finalizer of splitmix64."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def one_level(symbols: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases of many texts, and the text of each. symbols: uint64; text: its number for each symbol, rising."""
    if not len(symbols):
        return symbols, text
    first = np.ones(len(symbols), dtype=bool)
    first[1:] = text[1:] != text[:-1]
    new = first.copy()
    new[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(new)
    if len(at) < len(symbols):
        length = np.diff(at, append=len(symbols)).astype(np.uint64)
        symbols, text, first = symbols[at], text[at], first[at]
        many = length > 1
        symbols[many] = mix(symbols[many] + length[many] * _G)
    begin = np.flatnonzero(first)
    before = np.empty_like(symbols)
    before[1:] = symbols[:-1]
    before[begin] = symbols[begin] ^ np.uint64(1)
    differ = symbols ^ before
    k = np.bitwise_count((differ & (~differ + np.uint64(1))) - np.uint64(1)) & np.uint8(63)
    label = (k << np.uint8(1)) | ((symbols >> k.astype(np.uint64)) & np.uint64(1)).astype(np.uint8)
    for _ in range(3):
        left = np.empty_like(label)
        left[1:] = label[:-1]
        left[begin] = label[begin] ^ 1
        k = _LOWEST[label ^ left]
        label = (k << 1) | ((label >> k) & 1)
    higher = np.ones(len(label), dtype=bool)
    higher[1:] = label[1:] > label[:-1]
    peak = np.zeros(len(label), dtype=bool)
    peak[:-1] = higher[:-1] & (label[:-1] > label[1:])
    peak[begin[1:] - 1] = False  # a text's last symbol
    peak[begin] = True
    starts = np.flatnonzero(peak)
    lengths = np.diff(starts, append=len(symbols))
    place = (np.arange(len(symbols)) - np.repeat(starts, lengths) + 1).astype(np.uint64)
    return mix(np.add.reduceat(mix(symbols + place * _G), starts)), text[starts]


def lowest(names: np.ndarray, text: np.ndarray, n: int, kept: int) -> list[np.ndarray]:
    """Of each of n texts the `kept` lowest distinct names of 32 bits; a name found again counts as another name."""
    if not len(names):
        return [np.zeros(0, dtype=np.uint32)] * n
    order = np.lexsort((names, text))
    names, text = names[order], text[order]
    new = np.ones(len(names), dtype=bool)
    new[1:] = (names[1:] != names[:-1]) | (text[1:] != text[:-1])
    at = np.flatnonzero(new)
    again = (np.arange(len(names)) - np.repeat(at, np.diff(at, append=len(names)))).astype(np.uint64)
    names = np.where(again > 0, mix(names + again * _G), names)
    keys = np.unique((text.astype(np.uint64) << np.uint64(32)) | (names >> np.uint64(32)))
    bounds = np.searchsorted(keys, np.arange(n + 1, dtype=np.uint64) << np.uint64(32))
    low = keys.astype(np.uint32)
    return [low[a : min(b, a + kept)] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist())]


def fingerprints(texts: list[str]) -> list[dict[int, np.ndarray]]:
    """Of each text its kept names by level."""
    out: list[dict[int, np.ndarray]] = []
    at = 0
    while at < len(texts):
        end, size = at, 0
        while end < len(texts) and (end == at or size + len(texts[end]) <= AT_ONCE):
            size += len(texts[end])
            end += 1
        part = texts[at:end]
        symbols = np.frombuffer("".join(part).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        number = np.repeat(np.arange(len(part)), [len(t) for t in part])
        levels = {}
        for level in range(1, max(KEPT) + 1):
            symbols, number = levels[level] = one_level(symbols, number)
        found = {level: lowest(*levels[level], len(part), KEPT[level]) for level in (3, 2)}
        short = np.array([len(x) < ENOUGH for x in found[2]], dtype=bool)
        names, number = levels[1]
        chosen = short[number] if len(number) else np.zeros(0, dtype=bool)
        found[1] = lowest(names[chosen], number[chosen], len(part), KEPT[1])
        out += [{level: found[level][i] for level in KEPT} for i in range(len(part))]
        at = end
    return out


def as_string(fingerprint: dict[int, np.ndarray]) -> str:
    return ".".join(fingerprint[level].astype(">u4").tobytes().hex() for level in KEPT)


def from_string(value: str) -> dict[int, np.ndarray]:
    return {level: np.frombuffer(bytes.fromhex(x), dtype=">u4").astype(np.uint32) for level, x in zip(KEPT, value.split("."))}


def likeness(a: dict[int, np.ndarray], b: dict[int, np.ndarray]) -> float:
    """0 to 1: the share of phrases in common."""
    there = [level for level in KEPT if len(a[level]) and len(b[level])]
    if not there:
        return 1.0 if not any(map(len, a.values())) and not any(map(len, b.values())) else 0.0
    level = next((x for x in there if min(len(a[x]), len(b[x])) >= ENOUGH), there[-1])
    x, y = a[level].tolist(), b[level].tolist()
    # a full sample says nothing of names above its last one
    top = min([s[-1] for s in (x, y) if len(s) == KEPT[level]], default=1 << 32)
    p, q = {v for v in x if v <= top}, {v for v in y if v <= top}
    both = len(p & q)
    return 2 * both / (len(p) + len(q)) if both else 0.0


SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _paired(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (range, look-ahead, doc_id, text) in order: results of all that are no look-ahead."""
    names = [c.split()[0] for c in SCHEMA.split(", ")]
    held: list[tuple] = []  # the last row so far, with its fingerprint
    for batch in batches:
        texts = [t or "" for t in batch.column(3).to_pylist()]
        rows = held + list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), texts, fingerprints(texts)))
        pairs = [(x, y) for x, y in zip(rows, rows[1:]) if x[0] == y[0] and not x[1]]
        held = rows[-1:]
        edited = [x[3][: len(x[3]) - len(x[3]) // 4] + y[3][: len(x[3]) // 4] for x, y in pairs]
        out = []
        for (x, y), text, fp in zip(pairs, edited, fingerprints(edited)):
            digest = hashlib.sha256(text.encode("utf-8", "surrogatepass")).hexdigest()
            out.append((x[2], len(x[3]), digest, as_string(x[4]), as_string(fp), likeness(x[4], fp), likeness(x[4], y[4])))
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())
        columns = list(zip(*out)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def range_of(key: Column, bounds: list[int]) -> Column:
    """Number of bounds (sorted) that are no larger than key, less one; looked up in two steps of a square root each."""
    step = max(1, int(len(bounds) ** 0.5))
    tops, groups = bounds[::step], [bounds[i : i + step] for i in range(0, len(bounds), step)]
    lit = lambda xs: F.array(*[F.lit(x) for x in xs]).cast("array<bigint>")
    up_to = lambda xs: F.size(F.filter(xs, lambda b: b <= key))
    group = F.greatest(up_to(lit(tops)), F.lit(1))
    return (group - 1) * step + up_to(F.element_at(F.array(*[lit(g) for g in groups]), group)) - 1


def fingerprint_with_next(docs: DataFrame, range_rows: int = RANGE_ROWS) -> DataFrame:
    """doc_id, n_chars, fingerprints of the text and of its edited text, and likenesses to that and to the next document."""
    rows = docs.select(F.col("doc_id").cast("long"), "text").withColumn("_key", F.coalesce(F.col("doc_id"), F.lit(-(1 << 63))))
    n = rows.count()
    parts = max(1, min(250_000, n // range_rows))
    shares = [i / parts for i in range(1, parts)]
    lowest_id, at = rows.agg(F.min("_key"), F.percentile_approx("_key", shares or [0.5], max(10_000, 4 * parts))).first()
    bounds = sorted({lowest_id, *(at if parts > 1 else [])}) if n else [0]
    here = range_of(F.col("_key"), bounds).cast("long")
    bound = F.element_at(F.array(*[F.lit(b) for b in bounds]).cast("array<bigint>"), (here + 1).cast("int"))
    ahead = F.when(here == 0, F.lit(len(bounds) - 1)).otherwise(here - 1).cast("long")
    own = F.struct(here.alias("range"), F.lit(False).alias("ahead"))
    also = F.struct(ahead.alias("range"), F.lit(True).alias("ahead"))
    dealt = rows.withColumn("_to", F.explode(F.when(F.col("_key") == bound, F.array(own, also)).otherwise(F.array(own))))
    ordered = dealt.repartition("_to.range").sortWithinPartitions("_to.range", "_to.ahead", "_key", "text")
    return map_arrow(ordered.select("_to.range", "_to.ahead", "doc_id", "text"), _paired, SCHEMA)
