"""Links between texts whose sets of five-word shingles have a Jaccard similarity of 0.8 and more.

Candidates share a band: BANDS keys of ROWS minhashes each, so that a pair at exactly 0.8 shares none with a chance of 5e-8,
and a closer pair with less. A candidate pair goes on if four bits of each of its minhashes agree so often that it may be at
0.8 (one at 0.8 fails with a chance of 2e-11), and is then verified on the shingles themselves, so that no link is wrong.

Keys of few texts give all their pairs. In a key of many each text is compared with the centre, the text that shares the
most with others. Links to centres join whoever has them; the texts of a key that these leave apart from most of it are searched for by prefixes: in
the order of how rare shingles are, texts that are similar share one among the first of each, as many of them as the sizes
of both leave room for. So copies of a text whose edits set them too far apart don't meet pair by pair, nor do
texts that only share a passage, whose rarest shingles lie elsewhere; and no pair at 0.8 is left out.

Defined cases. Null and empty text: no links. Very long texts: read whole. Fewer words than a shingle has: one shingle of them all. Equal texts: one
text. An empty table gives empty tables. Only doc_id and text are looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, map_arrow, small_enough, words_of
from .simhash import fingerprint

WORDS, BANDS, ROWS = 5, 32, 4
#: A key of more texts is hot.
HOT = 32
#: Shingles whose frequency is known when prefixes are chosen, at most; it changes the time, no result. Ratio of size classes.
FREQUENT, SIZE_CLASS = 400_000, 1.05
#: Of the minhashes' four bits so many may differ in a pair that goes on.
MOST_DIFFER = 56
#: Frames whose rows are bounded by a count go into files of so many bytes, about. On a file system of the operating system
#: a file costs an executor two processes (chmod, of the file and of its checksums), and one that starts counts as large as the JVM.
FILE_BYTES = 2 << 20

_RNG = np.random.default_rng(5)
_XOR = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64)
_TIMES = _RNG.integers(0, 1 << 63, BANDS * ROWS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_MIX = _RNG.integers(0, 1 << 63, (BANDS, ROWS), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Distinct hashes of a text's shingles, in order."""
    found = words_of(text.lower())
    if not found:
        return np.empty(0, dtype=np.uint64)
    runs = {b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))}
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, runs), dtype=np.uint64, count=len(runs)))


def bands(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A text's keys, none of an empty set, and four bits of each of its minhashes, 16 in a long."""
    if not len(hashes):
        return np.empty(0, dtype=np.int64), np.zeros(BANDS * ROWS // 16, dtype=np.int64)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max, dtype=np.uint64)
    for i in range(0, len(hashes), 1024):
        least = np.minimum(least, ((hashes[i : i + 1024, None] ^ _XOR) * _TIMES).min(axis=0))
    least ^= least >> np.uint64(31)
    keys = (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64)
    four = ((least * _MIX.ravel()) >> np.uint64(60)).reshape(-1, 16) << (np.arange(16, dtype=np.uint64) * np.uint64(4))
    return (keys ^ (keys >> np.uint64(29))).view(np.int64), np.bitwise_or.reduce(four, axis=1).view(np.int64)


SIGNED = "doc_id bigint, fp bigint, text_hash bigint, keys array<bigint>, bits array<bigint>"


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    longs = pa.list_(pa.int64())
    for batch in batches:
        texts = [t.as_py() or b"" for t in batch.column(1).cast(pa.binary())]
        fps = np.array([fingerprint(t) for t in texts], dtype=np.uint64).view(np.int64)
        keys, bits = zip(*(bands(shingles(t)) for t in texts)) if texts else ((), ())
        columns = [batch.column(0), pa.array(fps), batch.column(2), pa.array(keys, longs), pa.array(bits, longs)]
        yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in SIGNED.split(", ")])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [shingles(t.as_py() or b"").view(np.int64) for t in batch.column(1).cast(pa.binary())]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.list_(pa.int64()))], names=["text_hash", "hashes"])


def _little(df: DataFrame, row_bytes: int) -> DataFrame:
    return F.broadcast(df) if small_enough(df, row_bytes) else df


def _files(rows: int, row_bytes: int) -> int:
    return 1 + rows * row_bytes // FILE_BYTES


def _may_be(a: str, b: str) -> Column:
    """Whether the four bits of so many minhashes agree that the pair may be similar."""
    differ = F.lit(0)
    for i in range(BANDS * ROWS // 16):
        x = F.col(a)[i].bitwiseXOR(F.col(b)[i])
        for n in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, n))
        differ += F.bit_count(x.bitwiseAND(F.lit(0x1111111111111111)))
    return differ <= MOST_DIFFER


def _verified(sets: DataFrame, pairs: DataFrame) -> DataFrame:
    """Of pairs(a, fa, b, fb) of text hashes and fingerprints, cut before, those at 0.8 and more."""
    seconds = sets.join(_little(pairs.select(F.col("b").alias("text_hash")).distinct(), 32), "text_hash", "left_semi").toDF("b", "hb")
    if (seconds.agg(F.sum(64 + 8 * F.size("hb"))).first()[0] or 0) <= BROADCAST_BYTES:  # centres, mostly
        seconds = F.broadcast(seconds)
    both = pairs.join(sets.toDF("a", "ha"), "a").join(seconds, "b")
    shared = F.size(F.array_intersect("ha", "hb"))
    found = both.where(9 * shared >= 4 * (F.size("ha") + F.size("hb"))).select("a", "fa", "b", "fb")
    return cut(found.repartition(_files(pairs.count(), 40)))  # shuffled, so that as many tasks as before compare


def _ordered(pairs: DataFrame) -> DataFrame:
    """pairs(x, fx, y, fy) once each, as a < b."""
    x, y = (F.struct(F.col(n).alias("id"), F.col(f).alias("fp")) for n, f in (("x", "fx"), ("y", "fy")))
    pairs = pairs.where("x <> y and fx <> fy").select(F.least(x, y).alias("l"), F.greatest(x, y).alias("g"))
    return pairs.select(F.col("l.id").alias("a"), F.col("l.fp").alias("fa"), F.col("g.id").alias("b"), F.col("g.fp").alias("fb")).distinct()


def size_class(size: int | np.ndarray):
    return np.floor(np.log(size) / math.log(SIZE_CLASS)).astype(np.int32)


def overlap(size: np.ndarray, other: np.ndarray) -> np.ndarray:
    """Shingles that sets of these sizes share at least if they are similar by 0.8."""
    return -(-4 * (size + other) // 9)


PREFIXES = "x bigint, fx bigint, size int, token bigint, class int, place int, searched boolean, probes boolean"


def _prefixes(batches: Iterator[pa.RecordBatch], tokens: np.ndarray, counts: np.ndarray, every: bool) -> Iterator[pa.RecordBatch]:
    """Rows (text_hash, fp, hashes, searched): the first shingles of each in order of frequency; of those that are searched for
    also in every size class in which a similar text may have them at such a place. every: tokens are all that occur twice,
    so that others lead to no text and are left out."""
    names = [c.split()[0] for c in PREFIXES.split(", ")]
    for batch in batches:
        out: list[list[np.ndarray]] = [[] for _ in names]
        for x, fx, hashes, searched in zip(*(batch.column(i).to_pylist() if i != 2 else batch.column(i) for i in range(4))):
            h = hashes.values.to_numpy(zero_copy_only=False)
            if not len(h):
                continue
            at = np.minimum(np.searchsorted(tokens, h), max(0, len(tokens) - 1))
            often = np.where(tokens[at] == h, counts[at], 0) if len(tokens) else np.zeros(len(h), dtype=np.int64)
            size = len(h)
            order = np.lexsort((h, often))[: size - -(-4 * size // 5) + 1]
            place = np.arange(len(order), dtype=np.int32)
            if every:
                place, order = place[often[order] > 0], order[often[order] > 0]
            first = h[order]
            parts = [(first, np.full(len(first), size_class(size)), place, np.zeros(len(first), dtype=bool))]
            if searched:
                others = np.arange(-(-4 * size // 5), 5 * size // 4 + 1)
                # of sizes in a class the smallest leaves the most room
                classes, smallest = np.unique(size_class(others), return_index=True)
                room = size - overlap(size, others[smallest])
                for c, n in zip(classes, room):
                    some = place <= n
                    k = int(some.sum())
                    parts.append((first[some], np.full(k, c), place[some], np.ones(k, dtype=bool)))
            for token, cls, places, probes in parts:
                n = len(token)
                for column, v in zip(out, (np.full(n, x), np.full(n, fx), np.full(n, size, dtype=np.int32), token, cls.astype(np.int32), places, np.full(n, searched), probes)):
                    column.append(v)
        kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c) if c else [], k) for c, k in zip(out, kinds)], names=names)


def _searched(sets: DataFrame, texts: DataFrame) -> DataFrame:
    """Pairs of texts(text_hash, fp, searched) that may be similar, one of them searched for."""
    # read from sets twice, not kept once more: shingles are the most that this stage has on disk
    there = sets.join(_little(cut(texts), 48), "text_hash").select("text_hash", "fp", "hashes", "searched")
    often = there.select(F.explode("hashes").alias("token")).groupBy("token").agg(F.count("*").alias("n")).where("n > 1")
    known = often.orderBy(F.desc("n"), "token").limit(FREQUENT).toArrow()  # FREQUENT rows at most
    tokens, counts = (known.column(c).to_numpy() for c in ("token", "n"))
    order = np.argsort(tokens)
    found = cut(map_arrow(there, partial(_prefixes, tokens=tokens[order], counts=counts[order], every=len(order) < FREQUENT), PREFIXES))
    probes = found.where("probes").drop("probes", "searched")
    held = found.where("not probes").select(F.col("x").alias("y"), F.col("fx").alias("fy"), F.col("size").alias("other"), "token", "class", F.col("place").alias("there"), "searched")
    need = F.ceil(4 * (F.col("size") + F.col("other")) / 9)
    room = F.least(F.col("size") - F.col("place"), F.col("other") - F.col("there"))
    once = (F.col("x") < F.col("y")) | (~F.col("searched") & (F.col("x") != F.col("y")))  # of two that are searched for one asks
    return _ordered(probes.join(held, ["token", "class"]).where(once & (room >= need)))


def _apart(many: DataFrame, central: DataFrame, centres: DataFrame, links: DataFrame, files: int) -> DataFrame:
    """text_hash of those that links to centres leave apart from most of a key.

    A text's home is the weightiest centre that it has a link to, or that this one has in turn. Texts of one home are joined;
    so of any two of a key that aren't, one is none of the key's largest home. files: of each frame, as none has more rows than many.
    """
    heads = cut(centres.select(F.col("y").alias("x")).distinct().join(central, "x").coalesce(files))
    both = links.select(F.col("a").alias("x"), F.col("b").alias("y")).unionByName(links.select(F.col("b").alias("x"), F.col("a").alias("y")))
    towards = both.join(_little(heads.withColumnRenamed("x", "y"), 32), "y").select("x", "weight", "y")
    towards = towards.unionByName(heads.select("x", "weight", F.col("x").alias("y")))
    home = cut(towards.groupBy("x").agg(F.max(F.struct("weight", "y"))["y"].alias("home")).coalesce(files))
    of_heads = home.select(F.col("x").alias("home"), F.col("home").alias("further")).join(_little(heads.select(F.col("x").alias("home")), 32), "home", "left_semi")
    home = home.join(_little(of_heads, 32), "home").select("x", F.col("further").alias("home"))
    placed = cut(many.select("key", "x").join(home, "x", "left").withColumn("home", F.coalesce("home", "x")).coalesce(files))
    sizes = placed.groupBy("key", "home").agg(F.count("*").alias("n"))
    largest = sizes.groupBy("key").agg(F.max(F.struct("n", "home"))["home"].alias("largest"))
    return cut(placed.join(_little(largest, 32), "key").where("home <> largest").select(F.col("x").alias("text_hash")).distinct().withColumn("searched", F.lit(True)).coalesce(files))


def similar(docs: DataFrame, *, hot: int = HOT) -> tuple[DataFrame, DataFrame]:
    """doc_id, fp and text_hash of every row, as simhash.fingerprints() gives them; and links a, b between fingerprints."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    signed = cut(map_arrow(rows, _signed, SIGNED))
    texts = cut(signed.groupBy("text_hash").agg(*[F.first(c).alias(c) for c in ("fp", "keys", "bits")]))
    keyed = texts.select("text_hash", "fp", "bits", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = cut(shared)
    members = cut(keyed.join(_little(shared, 48), "key").select("key", "n", F.col("text_hash").alias("x"), F.col("fp").alias("fx"), F.col("bits").alias("bx")))
    few, many = members.where(F.col("n") <= hot), members.where(F.col("n") > hot)
    other = few.select("key", F.col("x").alias("y"), F.col("fx").alias("fy"), F.col("bx").alias("by"))
    near = few.join(other, "key").where("x < y").where(_may_be("bx", "by"))
    files = _files(many.count(), 96)
    central = cut(many.groupBy("x").agg(F.sum("n").alias("weight")).coalesce(files))
    centres = many.join(central, "x").groupBy("key").agg(F.max(F.struct("weight", "x", "fx", "bx")).alias("c"))
    centres = cut(centres.select("key", F.col("c.x").alias("y"), F.col("c.fx").alias("fy"), F.col("c.bx").alias("by")).coalesce(files))
    stars = cut(many.join(_little(centres, 192), "key").where("x <> y").select("x", "fx", "y", "fy", _may_be("bx", "by").alias("may")).distinct().coalesce(files))
    pairs = cut(_ordered(near.select("x", "fx", "y", "fy").unionByName(stars.where("may").drop("may"))))
    # the shingles of every text that is compared, computed once
    named = pairs.select(F.col("a").alias("text_hash")).unionByName(pairs.select(F.col("b").alias("text_hash"))).unionByName(many.select(F.col("x").alias("text_hash")))
    there = docs.select(F.xxhash64("text").alias("text_hash"), "text").join(_little(cut(named.distinct()), 32), "text_hash", "left_semi")
    sets = cut(map_arrow(there.groupBy("text_hash").agg(F.first("text").alias("text")), _sets, "text_hash bigint, hashes array<bigint>"))
    links = _verified(sets, pairs)
    equal = stars.where("fx = fy").select(F.col("x").alias("a"), F.col("y").alias("b"))
    apart = _apart(many, central, centres, links.select("a", "b").unionByName(equal), files)
    if apart.limit(1).count():
        hot_texts = many.select(F.col("x").alias("text_hash"), F.col("fx").alias("fp")).distinct()
        marked = hot_texts.join(_little(apart, 32), "text_hash", "left").withColumn("searched", F.coalesce("searched", F.lit(False)))
        links = links.unionByName(_verified(sets, cut(_searched(sets, marked))))
    return signed.select("doc_id", "fp", "text_hash"), links.select(F.col("fa").alias("a"), F.col("fb").alias("b"))
