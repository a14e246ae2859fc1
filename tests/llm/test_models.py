"""Language identification and language-model scoring."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from fixtures import documents, odd_rows, speech

from cuemill.llm import langid, lm, queries


def test_forward_backward():
    """Against the sum over all label sequences."""
    rng = np.random.default_rng(1)
    sizes, k = [1, 4, 3], 3
    scores, move, start = rng.normal(size=(sum(sizes), k)), rng.normal(size=(k, k)), rng.normal(size=k)
    marginals, pairs, log_z = langid._forward_backward(scores, np.cumsum(sizes), move, start)
    at, total, want_pairs = 0, 0.0, np.zeros((k, k))
    for n in sizes:
        own, z, m = scores[at : at + n], 0.0, np.zeros((n, k))
        p = np.zeros((k, k))
        for path in itertools.product(range(k), repeat=n):
            w = math.exp(start[path[0]] + sum(own[i, x] for i, x in enumerate(path)) + sum(move[a, b] for a, b in zip(path, path[1:], strict=False)))
            z += w
            for i, x in enumerate(path):
                m[i, x] += w
            for a, b in zip(path, path[1:], strict=False):
                p[a, b] += w
        assert np.allclose(marginals[at : at + n], m / z)
        total += math.log(z)
        want_pairs += p / z
        at += n
    assert np.allclose(pairs, want_pairs) and math.isclose(log_z, total)


def plain_features(word: bytes, lexicon: dict) -> list[int]:
    """Each n-gram of the word between spaces by itself, then the lexicon's feature."""
    word = word.lower().strip(langid.EDGES)
    marked, out, mask = b" " + word + b" ", [], (1 << 64) - 1
    for k, n in enumerate(langid.SIZES):
        # n-grams begin at the space before the word at first, and inside or at the end of it at last
        for i in range(len(word) + 1):
            gram = marked[i : i + n]
            if len(gram) == n:
                x = 0
                for b in gram:
                    x = (x * 257 + b) & mask
                x = x * int(langid._MUL) & mask
                x = (x ^ x >> 31) * int(langid._MUL) & mask
                out.append((x >> 50) + k * langid.BUCKETS)
    return [*out, lexicon.get(word, 0) + len(langid.SIZES) * langid.BUCKETS]


def test_features():
    """Affixes, inner n-grams and lexicon of words, one by one."""
    words = ["Haus,", "é", "x", "(the)", "...", "12", "schön!", "queue", "\U0001f600a"]
    words = [w.encode() for w in words]
    feats, firsts = langid._features(words, {b"the": 2, b"queue": 1})
    got = [sorted(x) for x in np.split(feats, firsts[1:])]
    assert got == [sorted(plain_features(w, {b"the": 2, b"queue": 1})) for w in words]


def test_prediction(spark):
    """A fitted field's predictions by a plain forward and backward pass, word by word."""
    rows = [(i, speech(k, 48, i), k, None) for i, k in enumerate(["aa", "bb", "cc"] * 12)]
    field = langid.train(documents(spark, rows), rows=10)
    asked = [(100, speech("aa", 16, 70) + " 12 -- " + speech("cc", 24, 71), None, None), (101, "Lone", None, None), (102, "!! lomi ?? schtz", None, None)]
    got = {r.doc_id: r for r in langid.identify(documents(spark, asked), field).collect()}
    move, start = np.exp(field.move), np.exp(field.start)
    for i, text, _, _ in asked:
        words = text.encode().split()
        scores = [field.weights[plain_features(w, field.lexicon)].sum(0, dtype=float) if langid._has_letter(w) else np.zeros(len(field.labels)) for w in words]
        emit = [np.exp(x - x.max()) for x in scores]
        ahead, back = [start * emit[0]], [np.ones(len(field.labels))]
        for e in emit[1:]:
            ahead.append(ahead[-1] / ahead[-1].sum() @ move * e)
        for e in emit[:0:-1]:
            back.insert(0, move @ (e * back[0] / back[0].sum()))
        p = np.array(ahead) * np.array(back)
        p = (p / p.sum(1, keepdims=True))[[langid._has_letter(w) for w in words]].mean(0)
        assert got[i].lang_pred == field.labels[int(p.argmax())] and abs(got[i].score - p.max()) < 1e-5


def test_code_switching(spark):
    """Spans of a text in two languages; the model sees only whole documents of one."""
    rows = [(i, speech(k, 80, i), k, None) for i, k in enumerate(["aa", "bb", "cc"] * 30)]
    field = langid.train(documents(spark, rows))
    mixed = [(1, speech("aa", 40, 900) + " " + speech("bb", 120, 901), None, None), (2, None, None, None), (3, "12 34 !!", None, None), (4, "", None, None)]
    got = {r.doc_id: r for r in langid.identify(documents(spark, mixed), field, spans=True).collect()}
    assert got[1].lang_pred == "bb" and 0.5 < got[1].score <= 1
    longest = {}
    for s in got[1].spans:
        longest[s.lang] = longest.get(s.lang, 0) + s.words
    assert abs(longest["aa"] - 40) <= 4 and abs(longest["bb"] - 120) <= 4
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (2, 3, 4))


def test_held_out_accuracy(spark, sf):
    out = queries.op1_language_id(spark, sf).collect()
    truth = {r.doc_id: (r.lang, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(out) == len(truth)
    for r in out:
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1
    judged = [r.lang_pred == truth[r.doc_id][0] for r in out if r.held_out and truth[r.doc_id][0] and len(truth[r.doc_id][1] or "") > 40]
    assert sum(judged) / len(judged) > 0.93


def test_nothing_is_learned_from_held_out_rows(spark):
    """Other labels for them change nothing."""
    rows = [(i, speech(k, 40, i), k, None) for i, k in enumerate(["aa", "bb"] * 20)]
    other = [(i, t, "cc" if zlib.crc32(str(i).encode()) % 5 == 0 else k, s) for i, t, k, s in rows]
    a, b = langid.train(documents(spark, rows)), langid.train(documents(spark, other))
    assert a.labels == b.labels and np.array_equal(a.weights, b.weights) and np.array_equal(a.move, b.move)


def test_no_labels(spark):
    docs = documents(spark, [(1, "text", None, None)])
    assert langid.train(docs) is None
    assert [(r.lang_pred, r.score) for r in langid.identify(docs, None).collect()] == [("und", 0.0)]


def in_models(spark, rows, good, rest=None):
    """Of each row, whether it is in the target's and in the background's model once they are matched; the sizes must be."""
    table = spark.createDataFrame([(k, i, t, i in good, i not in good if rest is None else i in rest) for k, (i, t) in enumerate(rows)], "k int, id long, text string, target boolean, background boolean")
    told = sorted(lm.matched(table).collect())
    size = [[len((r.text or "").encode().split()) + 1 for r in told if r[3 + side]] for side in (0, 1)]
    if all(size):
        assert abs(sum(size[0]) - sum(size[1])) <= 4 * math.sqrt(sum(n * n for s in size for n in s))
    smaller = min((0, 1), key=lambda s: sum(len((t or "").encode().split()) + 1 for i, t in rows if (i in good) == (s == 0)) if rest is None else 0)
    assert rest is not None or sum(r[3 + smaller] for r in told) == sum((i in good) == (smaller == 0) for i, _ in rows)  # nothing of the smaller goes
    return [tuple(r[3:]) for r in told]


def plain_scores(rows, flags, prior=lm.PRIOR):
    """(id, tokens, score) of each row, all in plain Python."""
    seqs = [["<", *(t or "").encode().lower().split(), "<"] for _, t in rows]
    wide = len({w for s in seqs for w in s})

    def model(side):
        pairs, words = Counter(), Counter()
        for s, f in zip(seqs, flags, strict=True):
            if f[side]:
                pairs.update(itertools.pairwise(s))
                words.update(s[1:])
        return pairs, words

    models = [model(side) for side in (0, 1)]
    out = []
    for s, (i, _), own in zip(seqs, rows, flags, strict=True):
        loss = []
        for (pairs, words), f in zip(models, own, strict=True):
            p, w = (pairs - Counter(itertools.pairwise(s)), words - Counter(s[1:])) if f else (pairs, words)
            total = sum(w.values())
            loss.append(-sum(math.log((p[a, b] + prior * (w[b] + 1) / (total + wide)) / (w[a] + prior)) for a, b in itertools.pairwise(s)))
        out.append((i, len(s) - 1, (loss[0] - loss[1]) / (len(s) - 1)))
    return out


def same_scores(got, want):
    key = lambda r: (r[0] is None, r[0] or 0, r[1], round(r[2], 6))
    got, want = sorted(((r.doc_id, r.n_tokens, r.score) for r in got), key=key), sorted(want, key=key)
    assert [r[:2] for r in got] == [r[:2] for r in want] and np.allclose([r[2] for r in got], [r[2] for r in want], atol=1e-9)


@pytest.mark.parametrize("block", [lm.BLOCK, 3000])
def test_difference(spark, monkeypatch, block):
    """The whole computation in plain Python, in one block and in many."""
    monkeypatch.setattr(lm, "BLOCK", block)
    rows = [r[:2] for r in odd_rows()] + [(5000, "LONG word " * 20_000), (5001, "a w b w")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    good, rest = {4, 9, 10, 5001}, {5, 6, 20, 21, 22}
    table = lambda ids: spark.createDataFrame([(i, 7) for i in ids], "doc_id long, text long")
    got = lm.score_documents(docs, table([*good, 4, None, 999]))
    assert got.columns == ["doc_id", "n_tokens", "score"]
    same_scores(got.collect(), plain_scores(rows, in_models(spark, rows, good)))
    got = lm.score_documents(docs, table(good), table(rest)).collect()
    same_scores(got, plain_scores(rows, in_models(spark, rows, good, rest)))


def test_difference_of_rare_words(spark):
    """Every word is in the vocabulary, and a text is judged without itself."""
    rows = [(i, f"a b w{i // 2} x{i // 2} w{i // 2}") for i in range(600)]
    good = {i for i in range(0, 600, 4)}
    got = {r.doc_id: r.score for r in lm.score_documents(documents(spark, [(*r, None, None) for r in rows]), spark.createDataFrame([(i,) for i in good], "doc_id long")).collect()}
    twins, alone = [got[i] for i in range(1, 600, 4)], [got[i] for i in range(2, 600, 4)]
    assert max(twins) < min(alone)  # their other copy is a target


def test_difference_of_driver_tables(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    good = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("quality = 1").collect()}
    same_scores(queries.op10_lm_scoring(spark, sf).collect(), plain_scores(rows, in_models(spark, rows, good)))


def test_empty(spark):
    empty, none = documents(spark, []), spark.createDataFrame([], "doc_id long")
    assert langid.identify(empty, langid.train(empty)).count() == 0
    assert lm.score_documents(empty, none).count() == 0
    assert lm.score_documents(documents(spark, [(1, None, None, None)]), none).first().n_tokens == 1
