"""Quality rules as a short-circuit cascade: the order of the rules is that of rejections per second of cost.

Every rule is a test of one document that says whether it fails. On a bounded sample each rule runs alone on every
document; its mean time and its share of rejections give the order, and the cascade stops at a document's first failed
rule. The order changes only the time: a document is kept if it passes all rules.

Defined cases. Null and empty text: no words, so it fails the rule on length. Repeated rows: each is judged. An empty
table gives an empty table. Ties in the order: by name. Other columns pass through keep_good() untouched.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator
from functools import cached_property, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, words_of

#: Documents of the sample on which costs and selectivities are measured, about.
SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
_NOT_SYMBOL = bytes(i for i in range(256) if i not in SYMBOLS)
_NOT_UPPER = bytes(i for i in range(256) if not 65 <= i <= 90)
_NOT_LOWER = bytes(i for i in range(256) if not 97 <= i <= 122)


class Document:
    """What rules ask of a text (UTF-8), each computed when first asked for."""

    def __init__(self, text: bytes):
        self.text = text

    @cached_property
    def words(self) -> list[bytes]:
        return words_of(self.text)

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        return len(b"".join(self.words).decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text.translate(None, _NOT_SYMBOL))

    @cached_property
    def lines(self) -> list[bytes]:
        """Those with a word."""
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        """Words that lie in a window of three words found twice or more."""
        if self.n_words < 4:
            return 0
        number: dict[bytes, int] = {}
        x = np.fromiter((number.setdefault(w, len(number)) for w in self.words), dtype=np.int64, count=self.n_words)
        n = len(number)
        if n < 2_000_000:
            keys = (x[:-2] * n + x[1:-1]) * n + x[2:]
        else:  # three numbers don't fit in 63 bits
            pairs = np.unique(x[:-2] * n + x[1:-1], return_inverse=True)[1]
            keys = pairs * n + x[2:]
        order = np.argsort(keys, kind="stable")
        same = np.diff(keys[order]) == 0
        twice = np.zeros(len(keys), dtype=bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        covered = np.zeros(self.n_words, dtype=bool)
        for k in range(3):
            covered[k : k + len(keys)] |= twice
        return int(covered.sum())

    @cached_property
    def upper_share(self) -> float:
        """Of the letters A-Z and a-z, those in upper case."""
        upper = len(self.text.translate(None, _NOT_UPPER))
        return upper / max(1, upper + len(self.text.translate(None, _NOT_LOWER)))


def base_failed(d: Document) -> bool:
    return too_short(d) or repetitive(d)


def too_short(d: Document) -> bool:
    return d.n_words < 50


def repetitive(d: Document) -> bool:
    return 100 * d.n_repeat_words > 50 * d.n_words


def symbol_heavy(d: Document) -> bool:
    """More than one symbol for ten words."""
    return 10 * d.n_symbols > d.n_words


def odd_word_length(d: Document) -> bool:
    """Mean word of under 2 or over 12 code points."""
    return not 2 * d.n_words <= d.word_chars <= 12 * d.n_words


def repeated_lines(d: Document) -> bool:
    """More than three lines in ten equal an earlier one."""
    return 10 * d.n_dup_lines > 3 * len(d.lines)


def shouting(d: Document) -> bool:
    """More than half of the letters in upper case."""
    return d.upper_share > 0.5


RULES: dict[str, Callable[[Document], bool]] = {
    f.__name__: f for f in (too_short, repetitive, symbol_heavy, odd_word_length, repeated_lines, shouting)
}


def _measure(batches: Iterator[pa.RecordBatch], rules: dict) -> Iterator[pa.RecordBatch]:
    spent, failed, n = dict.fromkeys(rules, 0.0), dict.fromkeys(rules, 0), 0
    for batch in batches:
        for text in batch.column(0).cast(pa.binary()):
            n += 1
            for name, rule in rules.items():
                d = Document(text.as_py() or b"")
                began = time.perf_counter()
                failed[name] += rule(d)
                spent[name] += time.perf_counter() - began
    yield pa.RecordBatch.from_arrays([pa.array(list(rules)), pa.array(list(spent.values())), pa.array([*map(int, failed.values())], pa.int64()), pa.array([n] * len(rules), pa.int64())], names=["rule", "seconds", "failed", "n"])


def plan_cascade(docs: DataFrame, rules: dict | None = None, sample_rows: int = SAMPLE_ROWS, seed: int = 7) -> list[dict]:
    """The rules in the order in which to run them, with what the sample showed: seconds a document, share rejected."""
    rules = rules or RULES
    there = docs.count()
    sample = docs.select("text")
    if there > sample_rows:
        sample = sample.sample(min(1.0, sample_rows / there), seed)
    measured = map_arrow(sample, partial(_measure, rules=rules), "rule string, seconds double, failed bigint, n bigint")
    found = {r["rule"]: r for r in measured.groupBy("rule").agg(*[F.sum(c).alias(c) for c in ("seconds", "failed", "n")]).collect()}
    plan = []
    for name in rules:
        r = found.get(name)
        n = r["n"] if r else 0
        plan.append({"rule": name, "cost": r["seconds"] / n if n else 0.0, "rejects": r["failed"] / n if n else 0.0})
    return sorted(plan, key=lambda p: (-p["rejects"] / max(p["cost"], 1e-9), p["cost"], p["rule"]))


def first_failed(d: Document, order: list[str], rules: dict) -> str | None:
    return next((name for name in order if rules[name](d)), None)


STATS = "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean, reason string"


def _judge(batches: Iterator[pa.RecordBatch], order: list[str], rules: dict) -> Iterator[pa.RecordBatch]:
    names = [c.split()[0] for c in STATS.split(", ")]
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary())):
            d = Document(text.as_py() or b"")
            failed = base_failed(d)
            reason = first_failed(d, order, rules)
            rows.append((doc_id, d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, failed, not failed and reason is None, reason))
        kinds = [pa.int64()] * 6 + [pa.bool_()] * 2 + [pa.string()]
        columns = list(zip(*rows)) or [()] * len(names)
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)


def _keep(batches: Iterator[pa.RecordBatch], order: list[str], rules: dict, column: str) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts = batch.column(batch.schema.get_field_index(column)).cast(pa.binary())
        good = [first_failed(Document(t.as_py() or b""), order, rules) is None for t in texts]
        yield batch.filter(pa.array(good, pa.bool_()))


def judge_documents(docs: DataFrame, rules: dict | None = None, sample_rows: int = SAMPLE_ROWS) -> DataFrame:
    """Each document's statistics, verdict and first failed rule."""
    rules = rules or RULES
    order = [p["rule"] for p in plan_cascade(docs, rules, sample_rows)]
    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), partial(_judge, order=order, rules=rules), STATS)


def keep_good(docs: DataFrame, rules: dict | None = None, sample_rows: int = SAMPLE_ROWS, column: str = "text") -> DataFrame:
    """The documents that pass all rules, with all their columns."""
    rules = rules or RULES
    order = [p["rule"] for p in plan_cascade(docs, rules, sample_rows)]
    return map_arrow(docs, partial(_keep, order=order, rules=rules, column=column), docs.schema)
