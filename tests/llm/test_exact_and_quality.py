"""Exact deduplication and quality rules against plain Python."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

from fixtures import documents, odd_rows
from pyspark.sql import functions as F

from cuemill.llm import exact, quality


def norm(t):
    return re.sub(r"[\x20\x09-\x0D]+", " ", t or "")


def test_exact_groups(spark):
    groups = defaultdict(list)
    for i, t, *_ in odd_rows():
        groups[norm(t)].append(i)
    want = Counter()
    for t, ids in groups.items():
        keep, seen = min((i for i in ids if i is not None), default=None), False
        for i in ids:
            kept = i == keep and not seen
            seen |= kept
            want[i, keep, len(ids), kept, hashlib.sha256(t.encode()).hexdigest()] += 1
    assert Counter(map(tuple, exact.exact_groups(documents(spark)).collect())) == want


def test_same_digest_different_text(spark):
    """Texts that share the grouping digest are still told apart."""
    docs = documents(spark, [(1, "a", None, None), (2, "b", None, None), (3, "a", None, None)])
    got = exact.exact_groups(docs, digest=lambda c: F.lit(b"same"))
    assert {r.doc_id: r.keep_id for r in got.collect()} == {1: 1, 2: 2, 3: 1}


def test_drop_exact(spark):
    kept = exact.drop_exact(documents(spark))
    assert kept.columns == documents(spark).columns
    assert len({norm(r.text) for r in kept.collect()}) == kept.count() == len({norm(t) for _, t, *_ in odd_rows()})


def test_drop_exact_sends_no_texts(spark):
    """The rows stay where they are read while few of them go; repeated rows are one, null ids as in the groups."""
    docs = documents(spark, [(i, f"text {i}", None, None) for i in range(50)] + [(100, "text  7", None, None), (None, "text 8", None, None), (None, "alone", None, None)])
    kept = exact.drop_exact(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "Exchange hashpartitioning" not in plan and "BroadcastHashJoin" in plan
    assert Counter(r.text for r in kept.collect()) == Counter([f"text {i}" for i in range(50)] + ["alone"])
    twice = exact.drop_exact(docs.unionByName(docs.where("doc_id is null or doc_id in (7, 9, 100)")))
    assert Counter(r.text for r in twice.collect()) == Counter([f"text {i}" for i in range(50)] + ["alone"])


def test_empty(spark):
    empty = documents(spark, [])
    assert exact.exact_groups(empty).count() == exact.drop_exact(empty).count() == quality.judge_quality(empty).count() == quality.drop_poor(empty).count() == 0


def counts(t):
    t = t or ""
    w = [x for x in re.split(r"[\x20\x09-\x0D]+", t) if x]
    wins = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
    n, covered = Counter(wins), set()
    for i, x in enumerate(wins):
        if n[x] > 1:
            covered.update(range(i, i + 8))
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), len(lines) - len(set(lines)), len(covered), failed


def failures(t):
    n, chars, symbols, lines, repeats, _ = counts(t)
    return n < 20, 100 * repeats > 30 * n, chars < 2 * n or chars > 15 * n, 100 * symbols > 10 * n, 100 * lines > 5 * n


RULES = ["short", "repeats", "word_length", "symbols", "lines"]


def verdicts(rows):
    """The rules that each host fails: beta priors by moments, and a margin of two deviations."""
    n, bad = Counter(), defaultdict(Counter)
    for _, t, _, h in rows:
        n[h] += 1
        for r, f in zip(RULES, failures(t), strict=True):
            bad[r][h] += f
    out = {h: [] for h in n}
    for r in RULES:
        raw = [bad[r][h] / n[h] for h in n]
        m = sum(raw) / len(raw)
        v = sum((x - m) ** 2 for x in raw) / (len(raw) - 1) - m * (1 - m) * sum(1 / k for k in n.values()) / len(n) if len(raw) > 1 else None
        weight = 1.0 if v is None else min(max(m * (1 - m) / v - 1, 1.0), 1000.0) if v > 0 else 1000.0
        for h in n:
            rate = (bad[r][h] + m * weight) / (n[h] + weight)
            if rate - 2 * (rate * (1 - rate) / (n[h] + weight + 1)) ** 0.5 > 0.5:
                out[h].append(r)
    return out


def check_quality(spark, rows):
    failed = verdicts(rows)
    want = Counter()
    for i, t, _, h in rows:
        c = counts(t)
        want[(i, h, *c, ",".join(failed[h]), not c[5] and not failed[h])] += 1
    got = quality.judge_quality(documents(spark, rows)).collect()
    assert Counter((r.doc_id, r.host, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed, r.host_failed_rules, r.kept) for r in got) == want
    assert all(r.host_rejected == (r.host_failed_rules != "") for r in got)
    return failed


def test_quality(spark):
    failed = check_quality(spark, odd_rows())
    assert failed["poor"] == ["short"]


def test_hosts(spark):
    """A bad host goes, with its good documents; a small unlucky one stays, and so does one with fewer failures."""
    good, bad = " ".join(f"word{i}" for i in range(30)), " ".join(f"wording{i} # % |" for i in range(30))
    rows = [(1000 * h + i, good if i % 10 else bad, "en", f"fine{h}") for h in range(12) for i in range(40)]
    rows += [(20_000 + i, bad if i % 5 else good, "en", "bad") for i in range(40)] + [(30_000 + i, bad if i < 3 else good, "en", "unlucky") for i in range(4)]
    failed = check_quality(spark, rows)
    assert failed == {f"fine{h}": [] for h in range(12)} | {"bad": ["symbols"], "unlucky": []}
    kept = Counter(r.source for r in quality.drop_poor(documents(spark, rows)).collect())
    assert kept["bad"] == 0 and kept["unlucky"] == 4 and kept["fine0"] == 40
    check_quality(spark, rows[:40])  # one host


def test_drop_poor(spark):
    docs = documents(spark)
    kept = quality.drop_poor(docs)
    assert kept.columns == docs.columns
    judged = quality.judge_quality(docs).where("kept")
    assert sorted(r.doc_id or -1 for r in kept.collect()) == sorted(r.doc_id or -1 for r in judged.collect())


def test_counts_of_driver_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.collect()}
    for r in quality.judge_quality(docs).collect():
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) == counts(texts[r.doc_id])
