import re

import numpy as np

from tickloom.llm import licenses
from tickloom.llm.queries import op5_license_scan

SCHEMA = "doc_id bigint, text string, license string"
LINES = {
    "Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
    "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT",
}


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = []
    for r in spark.read.parquet(f"{sf}/documents.parquet").collect():
        for line, name in LINES.items():
            want += [(r["doc_id"], name, m.start(), m.end() - 1 if line[-1] == "." else m.end()) for m in re.finditer(re.escape(line), r["text"] or "")]
    got = [(r["doc_id"], r["license"], r["start"], r["end"]) for r in op5_license_scan(spark, sf).collect()]
    assert sorted(got) == sorted(want) and want


def brute_align(text, template):
    """Smith-Waterman over all cells: the best score."""
    best, before = 0, [0] * (len(text) + 1)
    for w in template:
        now = [0]
        for j, x in enumerate(text):
            now.append(max(0, before[j] + (licenses.MATCH if w == x else licenses.MISMATCH), before[j + 1] + licenses.GAP, now[j] + licenses.GAP))
            best = max(best, now[-1])
        before = now
    return best


def test_alignment_within_a_wide_band():
    rng = np.random.default_rng(4)
    for _ in range(40):
        text, template = rng.integers(0, 4, 25), rng.integers(0, 4, 12)
        band = 40
        padded = np.concatenate([np.full(band, -2), text])
        assert licenses.align(padded, template, band)[0] == brute_align(text.tolist(), template.tolist())


def test_every_shared_passage_is_a_candidate():
    rng = np.random.default_rng(1)
    index = licenses.Index(licenses.TEMPLATES)
    for t, template in enumerate(index.words):
        for _ in range(20):
            a = int(rng.integers(0, len(template) - 3))
            text = np.concatenate([rng.integers(-1, len(index.number), 9), template[a : a + 4], rng.integers(-1, len(index.number), 9)])
            assert any(9 <= at <= 10 and place - at == a - 9 for at, place in index.hits(text)[t])


def test_templates_find_themselves_and_edits():
    index = licenses.Index(licenses.TEMPLATES)
    for name, text in licenses.TEMPLATES:
        noisy = f"é before. {text}  and after"
        (found,) = [f for f in licenses.scan(noisy.encode(), index) if f[0] == name]
        assert found[1] == 1.0
        words = text.split()
        if len(words) > 20:
            words[7] = "else"
            del words[13]
            words.insert(3, "added")
            (found,) = licenses.scan(" ".join(words).encode(), index)
            assert found[0] == name and 0.8 <= found[1] < 1


def test_defined_cases(spark):
    mit = "Released under the MIT License."
    rows = [(1, None), (2, ""), (3, mit), (3, mit), (None, f"é {mit} x {mit}"), (5, "nothing " * 200_000 + mit), (6, "under the")]
    docs = spark.createDataFrame([(*r, "l") for r in rows], SCHEMA)
    got = sorted((str(r["doc_id"]), r["license"], r["start"], r["end"]) for r in licenses.scan_licenses(docs).collect())
    n = len(mit) - 1
    assert got == sorted([("3", "MIT", 0, n)] * 2 + [("None", "MIT", 2, 2 + n), ("None", "MIT", 5 + len(mit), 5 + len(mit) + n), ("5", "MIT", 1_600_000, 1_600_000 + n)])
    assert licenses.scan_licenses(docs.where("false")).count() == 0
