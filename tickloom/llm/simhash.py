"""Near-duplicates by SimHash and vantage-point trees.

A text's fingerprint has a bit set where more than half of its shingles' hashes have it. Distinct fingerprints are
dealt into shards by a vantage-point tree that is grown on a bounded sample: a node sends those within its radius of its
vantage point inside, the others outside. By the triangle inequality a fingerprint inside can have a neighbour outside
only if it is nearer to the boundary than the linking distance; such fingerprints visit the other side's shards as
queries, so every pair meets in a shard where at least one of both is at home. A shard is searched by a tree of its own,
whose branches are pruned by the same bounds down to blocks that are compared whole. Shards return spanning edges, not
pairs, and components of the whole graph come from alternating star contractions, each cut by a checkpoint.

Defined cases. Null text: as empty. No word: fingerprint 0, linked like any other. Fewer words than a shingle has: one
shingle of them all. Repeated rows and equal texts: one fingerprint, hence one component; each row is returned. Null
doc_id: returned, and no candidate for a component's smallest id, which is null if all ids are. An empty table gives an
empty table. Other columns are not looked at, or pass through one_of_each().
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, cut, map_arrow, unused, words_of

WORDS, DISTANCE, SEED = 3, 2, 42
#: Fingerprints on which the tree of shards is grown, at most, and those that a shard should hold, about.
SAMPLE, SHARD = 65_536, 8192
#: Shards at most; beyond SHARD * MOST_SHARDS fingerprints they grow, and their own trees with them.
MOST_SHARDS = 4096
#: Longs of the filter of documents to be dropped; beyond some millions of those it lets more texts move, and no result changes.
FILTER_WORDS = BROADCAST_BYTES // 48
#: A branch of so many fingerprints is compared whole.
BLOCK = 768


def fingerprint(text: bytes, words: int = WORDS, seed: int = SEED) -> int:
    """SimHash of a text in UTF-8."""
    found = words_of(text.lower())  # of bytes, lower() changes A-Z alone
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        shingles = [joined]
    else:
        ends = np.cumsum(np.fromiter(map(len, found), dtype=np.int64, count=len(found)) + 1) - 1
        starts = np.concatenate([[0], ends[:-1] + 1])[: len(found) - words + 1]
        shingles = [joined[a:b] for a, b in zip(starts.tolist(), ends[words - 1 :].tolist())]
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(seed)), dtype="<u8", count=len(shingles))
    counts = np.zeros(64, dtype=np.int64)
    for i in range(0, len(hashes), 65_536):
        part = hashes[i : i + 65_536].view(np.uint8).reshape(-1, 8)
        counts += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(counts * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprints(batches: Iterator[pa.RecordBatch], words: int, seed: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [fingerprint(t.as_py() or b"", words, seed) for t in batch.column(1).cast(pa.binary())]
        signed = np.array(found, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(signed), batch.column(2)], names=["doc_id", "fp", "text_hash"])


def fingerprints(docs: DataFrame, words: int = WORDS, seed: int = SEED) -> DataFrame:
    """doc_id, fp (the 64 bits as a signed long) and text_hash, which tells apart texts of one id."""
    rows = docs.select(F.col("doc_id").cast("long"), "text", F.xxhash64("text").alias("text_hash"))
    return map_arrow(rows, partial(_fingerprints, words=words, seed=seed), "doc_id bigint, fp bigint, text_hash bigint")


# The vantage-point tree. A node is (vantage, radius, inside, outside), a leaf its number.


def split(fps: np.ndarray, distance: int, rng: np.random.Generator) -> tuple[np.uint64, int, int] | None:
    """Vantage point and radius that leave the fewest to the larger side, boundary included, and that number."""
    best = None
    for v in rng.choice(fps, size=min(6, len(fps)), replace=False):
        n_at = np.bincount(np.bitwise_count(fps ^ v), minlength=65)
        within = np.cumsum(n_at)
        for radius in {int(np.searchsorted(within, len(fps) * q)) for q in (0.4, 0.5, 0.6)}:
            visiting = within[radius] - (within[radius - distance] if radius >= distance else 0)
            larger = max(within[radius], len(fps) - within[radius] + visiting)
            if best is None or larger < best[2]:
                best = (v, radius, int(larger))
    return best


def grow(sample: np.ndarray, leaves: int, distance: int, seed: int = 0):
    """The tree of shards, about `leaves` of them."""
    rng, size, count = np.random.default_rng(seed), max(8, len(sample) // max(1, leaves)), [0]

    def node(fps: np.ndarray):
        if leaves > 1 and len(fps) > size and (best := split(fps, distance, rng)) and best[2] < 0.9 * len(fps):
            near = np.bitwise_count(fps ^ best[0]) <= best[1]
            return (best[0], best[1], node(fps[near]), node(fps[~near]))
        count[0] += 1
        return count[0] - 1

    return node(sample), count[0]


def route(tree, fps: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Leaf, index into fps and whether it is at home there, of all visits."""
    out: list[tuple] = []

    def down(node, at: np.ndarray, home: np.ndarray) -> None:
        if not len(at):
            return
        if not isinstance(node, tuple):
            out.append((np.full(len(at), node), at, home))
            return
        vantage, radius, inside, outside = node
        d = np.bitwise_count(fps[at] ^ vantage).astype(np.int64)
        within = d <= radius
        # inside: those at home there, and visitors that come near it
        go = np.where(home, within, d <= radius + distance)
        down(inside, at[go], home[go])
        go = d > radius - distance
        down(outside, at[go], home[go] & ~within[go])

    down(tree, np.arange(len(fps)), np.ones(len(fps), dtype=bool))
    if not out:
        return np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0, bool)
    return tuple(np.concatenate(x) for x in zip(*out))


class Links:
    """Components of what has been linked so far."""

    def __init__(self, n: int):
        self.root = np.arange(n)

    def add(self, a: np.ndarray, b: np.ndarray) -> None:
        root = self.root
        while len(a):
            x, y = root[a], root[b]
            apart = x != y
            if not apart.any():
                return
            a, b, x, y = a[apart], b[apart], x[apart], y[apart]
            np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
            while True:
                up = root[root]
                if (up == root).all():
                    break
                root = up
            self.root = root


def link_within(fps: np.ndarray, home: np.ndarray, distance: int, seed: int = 0) -> np.ndarray:
    """A shard's components over all pairs at no more than `distance` of which one at least is at home: roots by index."""
    links, rng = Links(len(fps)), np.random.default_rng(seed)

    def whole(at: np.ndarray, own: np.ndarray) -> None:
        homes = at[own]
        step = max(1, BLOCK * BLOCK // max(1, len(homes)))
        for i in range(0, len(at), step):
            part = at[i : i + step]
            a, b = np.nonzero(np.bitwise_count(fps[part][:, None] ^ fps[homes][None, :]) <= distance)
            links.add(part[a], homes[b])

    todo = [(np.arange(len(fps)), home)]
    while todo:
        at, own = todo.pop()
        if not own.any():
            continue
        if len(at) > BLOCK and (best := split(fps[at], distance, rng)) and best[2] < 0.9 * len(at):
            d = np.bitwise_count(fps[at] ^ best[0]).astype(np.int64)
            within = d <= best[1]
            go = np.where(own, within, d <= best[1] + distance)
            todo.append((at[go], own[go]))
            go = d > best[1] - distance
            todo.append((at[go], own[go] & ~within[go]))
        else:
            whole(at, own)
    return links.root


def _route(batches: Iterator[pa.RecordBatch], tree, distance: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        fps = batch.column(0).to_numpy(zero_copy_only=False)
        leaf, at, home = route(tree, fps.view(np.uint64), distance)
        yield pa.RecordBatch.from_arrays([pa.array(leaf.astype(np.int64)), pa.array(fps[at]), pa.array(home)], names=["leaf", "fp", "home"])


def _leaf_links(distance: int):
    def links(rows: pa.Table) -> pa.Table:
        fps = rows.column("fp").to_numpy()
        order = np.argsort(fps, kind="stable")
        fps, home = fps[order], rows.column("home").to_numpy()[order]
        root = link_within(fps.view(np.uint64), home, distance)
        linked = root != np.arange(len(fps))
        return pa.table({"a": fps[linked], "b": fps[root[linked]]})

    return links


def components(edges: DataFrame) -> DataFrame:
    """node, root (the smallest node of its component) for every node of edges(a, b).

    Large-star and small-star contractions alternate until no edge changes.
    """
    def least(pairs: DataFrame) -> DataFrame:
        return pairs.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))

    now = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    mark = None
    while True:
        both = now.unionByName(now.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = both.join(least(both), "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        large = large.where("u <> v").distinct()
        lows = least(large)
        small = large.join(lows, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        now = cut(small.unionByName(lows.select("u", F.col("m").alias("v"))).where("u <> v").distinct())
        seen = now.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if seen == mark:
            return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
                now.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
            )
        mark = seen


def near_duplicates(
    docs: DataFrame, *, words: int = WORDS, distance: int = DISTANCE, seed: int = SEED, found: DataFrame | None = None, links: DataFrame | None = None,
) -> DataFrame:
    """doc_id, fp, component_id (the smallest doc_id that links reach, itself included), root and text_hash of every row.

    root is a component's smallest fingerprint. found: the fingerprints, where they are known; links(a, b): further links
    between fingerprints.
    """
    found = cut(fingerprints(docs, words, seed)) if found is None else found
    heads = cut(found.groupBy("fp").agg(F.min("doc_id").alias("least_id")))
    n = heads.count()
    leaves = min(MOST_SHARDS, -(-n // SHARD))
    sample = heads.select("fp") if n <= SAMPLE else heads.select("fp").sample(SAMPLE / n, seed=1)
    known = np.array([r[0] for r in sample.limit(SAMPLE).collect()], dtype=np.int64).view(np.uint64)
    tree, _ = grow(np.sort(known), leaves, distance)
    visits = map_arrow(heads.select("fp"), partial(_route, tree=tree, distance=distance), "leaf bigint, fp bigint, home boolean")
    edges = visits.groupBy("leaf").applyInArrow(_leaf_links(distance), "a bigint, b bigint")
    if links is not None:
        edges = edges.unionByName(links)
    roots = components(edges)
    rooted = heads.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    least = rooted.groupBy("root").agg(F.min("least_id").alias("component_id"))
    named = rooted.join(least, "root").select("fp", "component_id", "root")
    return found.join(named, "fp").select("doc_id", "fp", "component_id", "root", "text_hash")


def _filter_of(rows: DataFrame, text_hash: str, word: str, bits: str) -> DataFrame:
    """Adds a row's place in a Bloom filter of FILTER_WORDS longs, and its bits there; by doc_id and text_hash."""
    hashed = F.xxhash64(F.col("doc_id").cast("long"), F.col(text_hash))
    place = lambda n: F.shiftrightunsigned(hashed, 6 * n).bitwiseAND(F.lit(63)).cast("int")
    bit = lambda n: F.call_function("shiftleft", F.lit(1).cast("long"), place(n))
    return rows.withColumns({word: F.pmod(F.shiftrightunsigned(hashed, 18), F.lit(FILTER_WORDS)), bits: bit(0).bitwiseOR(bit(1)).bitwiseOR(bit(2))})


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """docs without all but the document of the smallest id of each component; rows that repeat id and text go as well."""
    found = cut(near_duplicates(docs, **options))
    first = F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "text_hash")).alias("_first")
    first = found.groupBy("root").agg(first).select("root", F.col("_first.doc_id").alias("_kept"), F.col("_first.text_hash").alias("_hash"))
    text_hash, nth = ((p := unused(docs.columns, "_sim")) + "_hash"), p + "_nth"
    hashed = docs.withColumn(text_hash, F.xxhash64("text"))
    # texts stay where they are but for those that may have to go, which a filter of bounded size marks
    others = found.join(first, "root").where(~(F.col("doc_id").eqNullSafe(F.col("_kept")) & (F.col("text_hash") == F.col("_hash"))))
    word, bits, marks = (f"{p}_{x}" for x in ("word", "bits", "marks"))
    marked = _filter_of(others, "text_hash", word, bits).groupBy(word).agg(F.bit_or(bits).alias(marks))
    looked_up = _filter_of(hashed, text_hash, word, bits).join(F.broadcast(marked), word, "left")
    may_go = F.coalesce(F.col(marks).bitwiseAND(F.col(bits)) == F.col(bits), F.lit(False))
    stay, doubtful = looked_up.where(~may_go), looked_up.where(may_go)
    same = doubtful["doc_id"].cast("long").eqNullSafe(first["_kept"]) & (doubtful[text_hash] == first["_hash"])
    there = stay.unionByName(doubtful.join(first, same, "left_semi"))
    if found.groupBy("doc_id", "text_hash").count().where("count > 1").limit(1).count():  # only then texts move once more
        again = Window.partitionBy("doc_id", text_hash).orderBy(F.lit(0))
        there = there.withColumn(nth, F.row_number().over(again)).where(F.col(nth) == 1)
    return there.select(*docs.columns)
