import re
from collections import Counter

from tickloom.llm import rules
from tickloom.llm.queries import op10_quality_rules

SCHEMA = "doc_id bigint, text string, kept string, n_words string"


def brute(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    n, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if n[w] > 1:
            hit |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 50 or 100 * len(hit) > 50 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(hit), failed


def test_query(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = op10_quality_rules(spark, sf).collect()
    assert {r["doc_id"]: tuple(r)[1:7] for r in got} == {k: brute(v) for k, v in texts.items()}
    assert not any(r["kept"] and r["base_failed"] for r in got)
    quality = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    for r in got:
        if r["doc_id"] in quality and not r["base_failed"]:
            assert r["kept"] == (quality[r["doc_id"]] == 1), r["doc_id"]


def test_order_does_not_matter(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    plan = rules.plan_cascade(docs)
    assert sorted(p["rule"] for p in plan) == sorted(rules.RULES)
    assert all(a["rejects"] / max(a["cost"], 1e-9) >= b["rejects"] / max(b["cost"], 1e-9) for a, b in zip(plan, plan[1:]))
    texts = [(r["text"] or "").encode() for r in docs.collect()]
    for order in (sorted(rules.RULES), sorted(rules.RULES, reverse=True)):
        kept = [rules.first_failed(rules.Document(t), order, rules.RULES) is None for t in texts]
        assert kept == [not any(f(rules.Document(t)) for f in rules.RULES.values()) for t in texts]


def test_defined_cases(spark):
    fine = " ".join(f"word{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(80))
    rows = [(1, None), (2, ""), (3, fine), (3, fine), (None, fine), (5, "same three words " * 100), (6, "\n".join(["a\tb"] * 3) + " x"), (7, fine * 3000)]
    docs = spark.createDataFrame([(*r, "k", "n") for r in rows], SCHEMA)
    got = rules.judge_documents(docs).collect()
    assert sorted((str(tuple(r)[:7]) for r in got)) == sorted(str((i, *brute(t))) for i, t in rows)
    kept = rules.keep_good(docs)
    assert kept.columns == docs.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == ["3", "3", "None"]
    assert rules.judge_documents(docs.where("false")).count() == rules.keep_good(docs.where("false")).count() == 0
