"""Language identification with a linear-chain conditional random field over the words of a text."""

from __future__ import annotations

import re
from collections import Counter
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.llm.common import sliced

#: The bounded sample that the field is fitted on: rows for each language, and characters up to which a text is drawn before longer ones.
SAMPLE_ROWS, SAMPLE_CHARS = 60, 20_000
#: Hash buckets of each n-gram size; sizes; lexicon words for each language; steps and rate of the fit; ridge penalty.
BUCKETS, SIZES, LEXICON, STEPS, RATE, RIDGE = 1 << 14, (1, 2, 3, 4), 300, 30, 0.15, 1e-3
#: Chance that a sentence of a training sequence is followed by one of another language.
SWITCH = 0.3
#: ASCII characters other than letters, which say nothing at a word's ends.
EDGES = bytes(c for c in range(128) if not chr(c).isalpha())
UNKNOWN = "und"
_MUL = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """True for documents that nothing is learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").split()


def _core(word: bytes) -> bytes:
    return word.lower().strip(EDGES)


def _has_letter(word: bytes) -> bool:
    return re.search(rb"[A-Za-z]", word) is not None or any(map(str.isalpha, word.decode(errors="replace")))


def _features(words: list[bytes], lexicon: dict[bytes, int]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words one after another, and each word's first place in them.

    Words are lower-cased, lose what ``EDGES`` has at both ends, and stand between
    spaces.  Byte n-grams that begin or end at a
    space are the affixes, up to three bytes; the others are inner n-grams; the
    last feature tells which languages' lexicons have the word.
    """
    lower = [_core(w) for w in words]
    buf = np.frombuffer(b" " + b" ".join(lower) + b" " * max(SIZES), np.uint8).astype(np.uint64)
    sizes = np.array([len(w) for w in lower])
    ends = np.cumsum(sizes + 1)  # the space after each word
    begin = ends - sizes - 1  # the space before it
    owner = np.repeat(np.arange(len(words)), sizes + 1)
    place = np.arange(ends[-1])
    parts, owners = [], []
    gram = np.zeros(len(buf), np.uint64)
    for k, n in enumerate(SIZES):
        gram = (gram[: len(buf) - n + 1] * np.uint64(257)) + buf[n - 1 :]
        code = gram * _MUL
        code = (code ^ (code >> np.uint64(31))) * _MUL
        inside = place + n - 1 <= ends[owner]
        parts.append((code[: len(place)][inside] >> np.uint64(64 - 14)).astype(np.int64) + k * BUCKETS)
        owners.append(owner[inside])
    parts.append(np.array([lexicon.get(w, 0) for w in lower]) + len(SIZES) * BUCKETS)
    owners.append(np.arange(len(words)))
    feats, own = np.concatenate(parts), np.concatenate(owners)
    order = np.argsort(own, kind="stable")
    return feats[order], np.searchsorted(own[order], np.arange(len(words)))


def _forward_backward(scores: np.ndarray, ends: np.ndarray, move: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Marginals of each word's label, summed marginals of label pairs, and the log partition of all sequences.

    ``scores`` holds all words' label scores, one sequence after another;
    sequences take their steps together, the long ones going on alone.
    """
    n, labels = scores.shape
    firsts = np.append(0, ends[:-1])
    sizes = ends - firsts
    order = np.argsort(-sizes, kind="stable")
    firsts, sizes = firsts[order], sizes[order]
    active = len(sizes) - np.searchsorted(sizes[::-1], np.arange(1, sizes.max(initial=0) + 1))
    top = scores.max(1, keepdims=True)
    e = np.exp(scores - top)
    m, first = np.exp(move), np.exp(start)
    ahead, norm = np.empty_like(e), np.empty(n)
    for t, k in enumerate(active):
        at = firsts[:k] + t
        a = (first if t == 0 else ahead[at - 1] @ m) * e[at]
        norm[at] = z = a.sum(1)
        ahead[at] = a / z[:, None]
    back = np.ones_like(e)
    pairs = np.zeros((labels, labels))
    for t in range(len(active) - 1, 0, -1):
        at = firsts[: active[t]] + t
        down = e[at] * back[at] / norm[at][:, None]
        back[at - 1] = down @ m.T
        pairs += ahead[at - 1].T @ down * m
    return ahead * back, pairs, float(np.log(norm).sum() + top.sum())


@dataclass
class Field:
    labels: list[str]
    lexicon: dict[bytes, int]
    weights: np.ndarray
    move: np.ndarray
    start: np.ndarray

    def scores(self, words: list[bytes]) -> np.ndarray:
        """Label scores of different words."""
        feats, firsts = _features(words, self.lexicon)
        return np.add.reduceat(self.weights[feats], firsts).astype(np.float64)

    def marginals(self, rows: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For non-empty rows of words: every word's label marginals, whether it has a letter, and where each row ends."""
        index: dict[bytes, int] = {}
        at = np.array([index.setdefault(w, len(index)) for r in rows for w in r])
        known = list(index)
        scores, letters = self.scores(known), np.array([_has_letter(w) for w in known])
        scores[~letters] = 0  # only its neighbours label it
        ends = np.cumsum([len(r) for r in rows])
        return _forward_backward(scores[at], ends, self.move, self.start)[0], letters[at], ends


def _sequences(sample: list[tuple[bytes, int]], rng) -> list[tuple[list[bytes], list[int]]]:
    """Code-switched training rows: the sample's sentences, with the next one often taken from another language."""
    lines: dict[int, list[list[bytes]]] = {}
    for text, label in sample:
        for s in re.split(rb"(?<=[.!?\n])\s+", text):
            if ws := _words(s):
                lines.setdefault(label, []).append(ws)
    for rows in lines.values():
        rng.shuffle(rows)
    out, now = [], None
    while lines:
        words, labels = [], []
        for _ in range(6):
            if not lines:
                break
            if now not in lines or rng.random() < SWITCH:
                now = int(rng.choice(sorted(lines)))
            s = lines[now].pop()
            words += s
            labels += [now] * len(s)
            if not lines[now]:
                del lines[now]
        out.append((words, labels))
    return out


def _lexicon(sample: list[tuple[bytes, int]], count: int) -> dict[bytes, int]:
    """Word to a feature that stands for the set of languages among whose most frequent words it is."""
    sets: dict[bytes, frozenset] = {}
    for label in range(count):
        seen = Counter(_core(w) for t, k in sample if k == label for w in _words(t))
        for w, _ in sorted(seen.items(), key=lambda x: (-x[1], x[0]))[:LEXICON]:
            if w:
                sets[w] = sets.get(w, frozenset()) | {label}
    numbers = {s: i for i, s in enumerate(sorted(set(sets.values()), key=sorted), 1)}
    return {w: numbers[s] for w, s in sets.items()}


def fit_field(sample: list[tuple[bytes, str]]) -> Field:
    """Emission and transition weights by maximum likelihood with a ridge penalty (Adam over the whole sample)."""
    rng = np.random.default_rng(7)
    names = sorted({k for _, k in sample})
    coded = [(t, names.index(k)) for t, k in sample]
    lexicon = _lexicon(coded, len(names))
    rows = _sequences(coded, rng)
    index: dict[bytes, int] = {}
    at = np.array([index.setdefault(w, len(index)) for r, _ in rows for w in r])
    gold = np.array([k for _, r in rows for k in r])
    ends = np.cumsum([len(r) for r, _ in rows])
    feats, firsts = _features(list(index), lexicon)
    each = np.diff(np.append(firsts, len(feats)))
    k, wide = len(names), len(SIZES) * BUCKETS + 1 + max(lexicon.values(), default=0)
    inner = np.setdiff1d(np.arange(1, len(gold)), ends)  # places with one before in their row
    heads = np.append(0, ends[:-1])
    true_pairs = np.bincount(gold[inner - 1] * k + gold[inner], minlength=k * k).reshape(k, k)
    true_heads = np.bincount(gold[heads], minlength=k)
    hot = np.eye(k)[gold]
    shapes = [(wide, k), (k, k), (k,)]
    x, m, v = ([np.zeros(s) for s in shapes] for _ in range(3))
    for step in range(1, STEPS + 1):
        scores = np.add.reduceat(x[0][feats], firsts)[at]
        p, pairs, _ = _forward_backward(scores, ends, x[1], x[2])
        miss = p - hot
        by_word = np.stack([np.bincount(at, miss[:, j], len(index)) for j in range(k)], 1)
        spread = np.repeat(by_word, each, axis=0)
        g = [np.stack([np.bincount(feats, spread[:, j], wide) for j in range(k)], 1), pairs - true_pairs, p[heads].sum(0) - true_heads]
        for i in range(3):
            d = g[i] / len(gold) + RIDGE * x[i] / 100
            m[i] = 0.9 * m[i] + 0.1 * d
            v[i] = 0.99 * v[i] + 0.01 * d * d
            x[i] -= RATE * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.99**step)) + 1e-9)
    return Field(names, lexicon, x[0].astype(np.float32), x[1], x[2])


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", rows: int = SAMPLE_ROWS, chars: int = SAMPLE_CHARS) -> Field | None:
    """A field fitted on at most ``rows`` documents of each language, drawn by a hash of the id from those not held out.

    The draw looks at all documents and keeps the first of each language in every
    task before it shuffles ids; texts of over ``chars`` characters are drawn only
    where a language has too few others.  The drawn rows' whole texts come to the
    driver.  None if no document can be learned from.
    """
    known = docs.where(F.col(text_col).isNotNull() & F.col(lang_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(F.col(id_col)) & F.col(text_col).rlike(r"\p{L}"))
    rank = F.row_number().over(W.partitionBy("lang").orderBy("long", F.xxhash64("id"), "id"))
    drawn = known.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), (F.length(text_col) > chars).alias("long")).withColumn("n", rank).where(F.col("n") <= rows).select("id").distinct()
    sample = known.join(F.broadcast(drawn), known[id_col] == drawn["id"], "left_semi").select(F.col(text_col).alias("t"), F.col(lang_col).alias("k")).collect()
    pairs = sorted((r["t"].encode(), r["k"]) for r in sample)
    return fit_field(pairs) if pairs else None


def identify(docs: DataFrame, field: Field | None, id_col: str = "doc_id", text_col: str = "text", spans: bool = False) -> DataFrame:
    """One row per input row: id, lang_pred, score, n_switches[, spans].

    Words (runs between ASCII white space) get label marginals by
    forward-backward over the whole text.  The document's language has the
    largest mean marginal over words with a letter (the first by name of equals);
    that mean is the score.  ``n_switches`` counts changes of the likeliest label
    from word to word; ``spans`` lists the stretches between them as (first word,
    number of words, language).  A text that is null or has no letter is ``und``
    with score 0; so is every text when there is no field.  A long text is one
    sequence; rows that repeat are judged alike; other columns are ignored,
    whatever their names; an empty table gives no rows.
    """
    sent = docs.sparkSession.sparkContext.broadcast(field)
    kind = pa.list_(pa.struct([("first", pa.int32()), ("words", pa.int32()), ("lang", pa.string())]))

    def judge(texts: list[bytes | None]) -> list[tuple]:
        model, out = sent.value, [(UNKNOWN, 0.0, 0, [])] * len(texts)
        rows = [(i, ws) for i, t in enumerate(texts) if (ws := _words(t))]
        if model is None or not rows:
            return out
        p, letters, ends = model.marginals([ws for _, ws in rows])
        best = p.argmax(1)
        for (i, ws), end in zip(rows, ends, strict=True):
            own = slice(end - len(ws), end)
            use = letters[own]
            if use.any():
                mean = p[own][use].mean(0)
                k = int(mean.argmax())
                cuts = np.append(0, np.flatnonzero(np.diff(best[own])) + 1)
                runs = [dict(first=a, words=b - a, lang=model.labels[best[own][a]]) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(ws)], strict=True)] if spans else []
                out[i] = model.labels[k], min(1.0, float(mean[k])), len(cuts) - 1, runs
        return out

    def batches(parts):
        for b in sliced(parts, 1):
            lang, score, switches, runs = zip(*judge(b.column(1).cast(pa.binary()).to_pylist()), strict=True)
            cols = [b.column(0), pa.array(lang), pa.array(score, pa.float64()), pa.array(switches, pa.int64())]
            yield pa.RecordBatch.from_arrays(cols + [pa.array(runs, kind)] * spans, ["id", "lang_pred", "score", "n_switches", *["spans"] * spans])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    schema = f"id {src.schema['id'].dataType.simpleString()}, lang_pred string, score double, n_switches long" + ", spans array<struct<first:int,words:int,lang:string>>" * spans
    return src.mapInArrow(batches, schema).withColumnRenamed("id", id_col)
