"""Best-fit packing of documents into fixed-length sequences, as a vector bin-packing problem.

Documents become token ids (and an end id); those longer than a sequence are cut into pieces. A bin has three
capacities: tokens, documents and attention cost (the sum of squared piece lengths). Pieces are dealt by a hash into
shards of bounded size; in a shard they are taken from the longest to the shortest, and each goes to that open bin with
room in every dimension where it fits best: the smallest weighted norm of what is then left ("norm"), or the largest
weighted dot product of piece and residual ("dot"). A piece that fits no open bin opens one. Shards hold a random mix of
lengths, so what is lost by packing them apart is a part of a bin each.

Defined cases. Null and empty text: the end id alone. Repeated rows: each is packed. Ties between bins: the one opened
first. An empty table gives an empty table. A piece that fits no empty bin (capacities below one piece) raises
ValueError. Other columns of the input are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, map_arrow

MAX_TOKENS = 4096
END_ID = 1
#: Pieces of a shard, about.
SHARD_PIECES = 16384
#: Chunks whose ids a Python worker keeps during a task; beyond that the older half goes.
CACHE_CHUNKS = 600_000
PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, row_hash bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"

_LETTER_STOP = r"(\p{L})([.,])( |\z)"
_encoders: dict[str, ChunkEncoder] = {}


class ChunkEncoder:
    """Ids of a text as little-endian uint32 bytes, from a cache of its chunks between spaces and line ends.

    Holds for tokenizers that bring texts to lower case, part at white space and drop it, as those of kind "BPE with word
    ends" do: the ids of a text are then those of its chunks in order. They also part a comma or full stop from a letter
    before it, so a blank is put there where nothing but white space follows, which leaves fewer distinct chunks.
    The tokenizer's special tokens hold no white space, so that each stays within a chunk; as they are told by their exact
    letters, texts with the like in other cases keep their case.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        if any(t.split() != [t] for t in self.special):
            raise ValueError(f"special tokens that hold white space: {self.special}")
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        vocabulary = self.tokenizer.get_vocab()
        self.is_end = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.is_end[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True

    def forget(self) -> None:
        """Empties the cache."""
        self.new, self.old = {}, {}

    def _ids(self, chunks: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast(chunks, add_special_tokens=False)
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in found]

    def _ids_of_letters(self, chunks: list[str]) -> list[bytes]:
        """Of chunks that are one word each, in one call: a word ends with a token that says so."""
        ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(chunks)], add_special_tokens=False)[0].ids, dtype="<u4")
        ends = (np.flatnonzero(self.is_end[ids]) + 1) * 4
        if len(ends) != len(chunks):  # lower case has made another sign than a letter of one
            return self._ids(chunks)
        packed, ends = ids.tobytes(), ends.tolist()
        return [packed[a:b] for a, b in zip([0, *ends], ends)]

    def of_distinct(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these chunks, which are distinct."""
        new, get, old = self.new, self.new.get, self.old.get
        found = [get(c) for c in chunks]
        words: list[str] = []
        others: list[str] = []
        later = []
        for i, ids in enumerate(found):
            if ids is None:
                c = chunks[i]
                ids = old(c)
                if ids is None:
                    later.append(i)
                    (words if c.isalpha() else others).append(c)
                else:
                    found[i] = new[c] = ids
        for group, encode in ((words, self._ids_of_letters), (others, self._ids)):
            for i in range(0, len(group), 4096):
                part = group[i : i + 4096]
                new.update(zip(part, encode(part)))
        for i in later:
            found[i] = new[chunks[i]]
        if len(new) > CACHE_CHUNKS // 2:
            self.old, self.new = new, {}
        return found

    def column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts one after the other, and where each text's begin, with the end of the last."""
        texts = pc.fill_null(texts, "")
        lower = pc.ascii_lower(texts)
        for token in self.special:
            there, exact = (pc.count_substring(x, token.lower()) for x in (lower, texts))
            lower = pc.if_else(pc.equal(there, exact), lower, texts)
        plain = pc.replace_substring(lower, "\n", " ")
        parted = pc.split_pattern(pc.replace_substring_regex(plain, _LETTER_STOP, r"\1 \2\3"), " ")
        coded = parted.flatten().dictionary_encode()
        of_chunk = self.of_distinct(coded.dictionary.to_pylist())
        known = np.frombuffer(b"".join(of_chunk), dtype="<u4")
        length = np.fromiter(map(len, of_chunk), dtype=np.int64, count=len(of_chunk)) // 4
        start = np.concatenate([[0], np.cumsum(length)[:-1]]) if len(length) else length
        index = coded.indices.to_numpy(zero_copy_only=False)
        each = length[index]
        ends = np.cumsum(each)
        place = np.repeat((start[index] - (ends - each)).astype(np.int32), each)
        place += np.arange(len(place), dtype=np.int32)
        bounds = parted.offsets.to_numpy(zero_copy_only=False)
        return known[place], np.concatenate([[0], ends])[bounds - bounds[0]]

    def __call__(self, text: str | None) -> bytes:
        return self.column(pa.array([text], pa.string()))[0].tobytes()


def encoder(path: str) -> ChunkEncoder:
    if path not in _encoders:
        _encoders[path] = ChunkEncoder(path)
    return _encoders[path]


def _cut_pieces(batches: Iterator[pa.RecordBatch], path: str, max_tokens: int, end_id: int) -> Iterator[pa.RecordBatch]:
    encode, end = encoder(path), np.uint32(end_id).astype("<u4").tobytes()
    try:
        for batch in batches:
            rows: list[list] = [[] for _ in range(5)]
            ids, bounds = encode.column(batch.column(1))
            bounds = bounds.tolist()
            for doc_id, a, b in zip(batch.column(0).to_pylist(), bounds, bounds[1:]):
                n = b - a + 1  # with the end id
                for piece, at in enumerate(range(0, n, max_tokens)):
                    length = min(max_tokens, n - at)
                    crc = zlib.crc32(ids[a + at : min(a + at + length, b)].data)
                    if at + length == n:
                        crc = zlib.crc32(end, crc)
                    for column, v in zip(rows, (doc_id, piece, at, length, crc)):
                        column.append(v)
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["doc_id", "piece", "start", "length", "ids_crc32"])
    finally:
        encode.forget()  # workers outlive their tasks, and other stages need the memory


def best_fit(lengths: np.ndarray, capacity: tuple[float, float, float], weights=(1.0, 0.05, 0.05), rule: str = "norm") -> tuple[np.ndarray, np.ndarray]:
    """Bin number and offset of each piece."""
    cap, weight = np.asarray(capacity, dtype=float), np.asarray(weights, dtype=float)
    sizes = np.stack([lengths, np.ones(len(lengths)), np.square(lengths.astype(float))], axis=1) / cap
    if len(sizes) and sizes.max() > 1:
        raise ValueError(f"a piece of {lengths.max()} tokens fits no empty bin of capacities {capacity}")
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64)
    left = np.empty((3, max(16, len(lengths))))  # of open bins
    name, used = np.empty(left.shape[1], dtype=np.int64), np.empty(left.shape[1], dtype=np.int64)
    n_open, n_bins, slack = 0, 0, 1e-12
    least = sizes.min(axis=0) + [-slack] * 3 if len(sizes) else None
    for n, i in enumerate(order):
        s = sizes[i]
        if n % 256 == 0 and n_open:  # bins that can take nothing more
            stay = np.flatnonzero((left[0, :n_open] >= least[0]) & (left[1, :n_open] >= least[1]) & (left[2, :n_open] >= least[2]))
            left[:, : len(stay)], name[: len(stay)], used[: len(stay)] = left[:, stay], name[stay], used[stay]
            n_open = len(stay)
        fits = np.flatnonzero(left[0, :n_open] >= s[0] - slack)
        if len(fits):
            fits = fits[(left[1, fits] >= s[1] - slack) & (left[2, fits] >= s[2] - slack)]
        if len(fits):
            room = left[:, fits]
            if rule == "norm":
                k = fits[np.argmin(weight @ np.square(room - s[:, None]))]
            else:
                k = fits[np.argmax((weight * s) @ room)]
        else:
            k = n_open
            left[:, k], name[k], used[k] = 1.0, n_bins, 0
            n_open, n_bins = n_open + 1, n_bins + 1
        bins[i], offsets[i] = name[k], used[k]
        used[k] += lengths[i]
        left[:, k] -= s
    return bins, offsets


def _pack_shard(capacity: tuple, weights: tuple, rule: str):
    columns = [c.split()[0] for c in PIECES.split(", ")]

    def pack(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([("length", "descending"), ("row_hash", "ascending")])
        bins, offsets = best_fit(rows.column("length").to_numpy(), capacity, weights, rule)
        of_shard = (np.int64(key[0].as_py()) << 32) + bins
        return rows.select(columns).append_column("sequence_id", pa.array(of_shard)).append_column("offset", pa.array(offsets))

    return pack


def pieces_of(docs: DataFrame, tokenizer: str, *, max_tokens: int = MAX_TOKENS, end_id: int = END_ID) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 of every piece."""
    schema = PIECES.rpartition(",")[0]
    cutter = partial(_cut_pieces, path=tokenizer, max_tokens=max_tokens, end_id=end_id)
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), cutter, schema)


def pack_documents(
    docs: DataFrame, tokenizer: str, *, max_tokens: int = MAX_TOKENS, max_documents: int = MAX_TOKENS,
    max_attention: float = MAX_TOKENS**2, end_id: int = END_ID, weights=(1.0, 0.05, 0.05), rule: str = "norm",
    shard_pieces: int = SHARD_PIECES,
) -> DataFrame:
    """Each piece's place: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    pieces = cut(pieces_of(docs, tokenizer, max_tokens=max_tokens, end_id=end_id))
    shards = max(1, -(-pieces.count() // shard_pieces))
    # the row's number in the checkpoint salts the hash, for the sake of rows that repeat
    row_hash = F.xxhash64("doc_id", "piece", "ids_crc32", F.monotonically_increasing_id())
    salted = pieces.withColumn("row_hash", row_hash).withColumn("shard", F.pmod(F.col("row_hash"), F.lit(shards)).cast("long"))
    capacity = (float(max_tokens), float(max_documents), float(max_attention))
    placed = salted.groupBy("shard").applyInArrow(_pack_shard(capacity, tuple(weights), rule), PLACED)
    return placed.drop("row_hash")
