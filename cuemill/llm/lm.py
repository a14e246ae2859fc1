"""Cross-entropy difference scoring with a target and a background bigram model over one vocabulary."""

from __future__ import annotations

from collections import defaultdict
from itertools import count as numbers

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import sliced, staged, with_small
from cuemill.llm.planes import counts, mixed, packed, unpacked, uncounted

#: Bytes of text in a block of documents, which sends each of its cells once.
BLOCK = 4 << 20
#: Partitions that blocks and buckets are dealt to at most; beyond it a task takes several, one after another.
PARTITIONS = 20_000
#: Tokens that the unigrams are worth after each word (a Dirichlet prior).
PRIOR = 16.0
#: The id of a text's edge: before its first word and after its last. Other words have the hash of their bytes.
EDGE = 1
#: Different words that a task counts before it passes them on.
COUNTED = 300_000
_LOW = np.uint64((1 << 48) - 1)


def _words(text: bytes | None) -> list[bytes]:
    return (text or b"").lower().split()


def _places(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of the different words (the edge first); the places in them of all texts' words, with edges around each text; and words a text."""
    local = defaultdict(numbers(1).__next__)
    place, flat, sizes = local.__getitem__, [], []
    for t in texts:
        ws = _words(t)
        flat.append(0)
        flat += map(place, ws)
        flat.append(0)
        sizes.append(len(ws))
    return np.array([EDGE, *map(xxhash.xxh64_intdigest, local)], np.uint64), np.array(flat, np.int64), np.array(sizes, np.int64)


class Block:
    """The cells (words and bigrams) of some texts, in order of bucket and key, and the cells of each token.

    A token is a word or the end of its text.  Cells depend on the set of texts
    alone, not on their order.
    """

    def __init__(self, texts: list[bytes | None], buckets: int):
        ids, flat, sizes = _places(texts)
        self.sizes = sizes + 1
        self.doc = np.repeat(np.arange(len(sizes)), self.sizes)
        second = np.arange(len(self.doc)) + self.doc + 1  # each text has one more mark than tokens
        prev, word = flat[second - 1], flat[second]
        pairs, at = np.unique(prev * len(ids) + word, return_inverse=True)
        a, b = np.divmod(pairs, len(ids))
        one = np.uint64(1)
        cells = np.concatenate([mixed(ids, 0) | one, mixed(mixed(ids[a], 1) + ids[b], 2) & ~one])  # words are odd
        key, bucket = cells & _LOW, ((mixed(cells, 3) >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
        order = np.lexsort((key, bucket))
        new = np.append(True, (key[order][1:] != key[order][:-1]) | (bucket[order][1:] != bucket[order][:-1]))[: len(order)]
        place = np.empty(len(order), np.int64)
        place[order] = np.cumsum(new) - 1
        self.key, bucket = key[order][new], bucket[order][new]
        self.bucket, starts = np.unique(bucket, return_index=True)
        self.starts = np.append(starts, len(bucket))
        self.prev, self.word, self.pair = place[prev], place[word], place[len(ids) + at]

    def parts(self):
        return zip(self.bucket.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)

    def own(self, cells: np.ndarray) -> np.ndarray:
        """How often each token's cell occurs in its own text."""
        _, at, n = np.unique(self.doc * len(self.key) + cells, return_inverse=True, return_counts=True)
        return n[at]


def matched(rows: DataFrame) -> DataFrame:
    """``rows`` (id, text, target, background), of whose larger side documents are drawn, by a hash of id and text, to about the tokens of the smaller.

    Models of one size are smoothed alike, so that their difference holds no
    trace of it.  The draw's share is made of sums over all documents.
    """
    tokens = F.size(F.filter(F.split(F.coalesce("text", F.lit("")), r"[\x20\x09-\x0D]+"), lambda w: w != "")) + 1
    sides = ("target", "background")
    sums = rows.select(*sides, tokens.alias("n")).agg(*[F.sum(F.when(F.col(s), F.col("n"))).alias(s) for s in sides]).first()
    least = min(sums[s] or 0 for s in sides)
    if not least:
        return rows
    place = F.pmod(F.xxhash64(F.lit("drawn"), "id", "text"), F.lit(1 << 30)) / (1 << 30)
    return rows.withColumns({s: F.col(s) & (place < least / sums[s]) for s in sides})


def vocabulary(docs: DataFrame) -> tuple[int, int, int, int]:
    """Of (text, target, background): different words and the edge, tokens of target and background, bytes of text."""

    def count(parts):
        def out(seen, edge, size):
            rows = [(x - (1 << 64) if x >> 63 else x, *n) for x, n in ((xxhash.xxh64_intdigest(w), n) for w, n in seen.items())]
            cols = list(zip((EDGE, *edge), *rows, strict=True))
            return pa.RecordBatch.from_arrays([*(pa.array(c, pa.int64()) for c in cols), pa.array([size] + [0] * len(rows), pa.int64())], ["word", "t", "b", "bytes"])

        seen, edge, size = defaultdict(lambda: [0, 0]), [0, 0], 0
        for b in sliced(parts, 0):
            for text, t, k in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                size += len(text or b"")
                edge[0] += t
                edge[1] += k
                for w in _words(text):
                    n = seen[w]
                    n[0] += t
                    n[1] += k
                if len(seen) > COUNTED:
                    yield out(seen, edge, size)
                    seen.clear()
                    edge, size = [0, 0], 0
        yield out(seen, edge, size)

    counted = docs.select("text", "target", "background").mapInArrow(count, "word long, t long, b long, bytes long")
    words = counted.groupBy("word").agg(*[F.sum(c).alias(c) for c in ("t", "b", "bytes")])
    return tuple(words.agg(F.count("word"), *[F.coalesce(F.sum(c), F.lit(0)) for c in ("t", "b", "bytes")]).first())


def _ask(buckets: int):
    """Of a block's documents: a row for each bucket, with the block's cells there and their counts."""

    def ask(table: pa.Table) -> pa.Table:
        block = Block(table.column("text").cast(pa.binary()).to_pylist(), buckets)
        sums = []
        for role in ("target", "background"):
            use = table.column(role).to_numpy()[block.doc]
            sums.append(np.bincount(block.word[use], minlength=len(block.key)) + np.bincount(block.pair[use], minlength=len(block.key)))
        rows = [(to, packed(block.key[a:z]), *(counts(s[a:z]) for s in sums)) for to, a, z in block.parts()]
        cols = zip(*rows, strict=True)
        return pa.table([pa.array([table.column("block")[0].as_py()] * len(rows), pa.int64()), *map(pa.array, cols, (pa.int64(), *[pa.binary()] * 3))], ["block", "bucket", "cells", "t", "b"])

    return ask


def _answer(asked: pa.Table) -> pa.Table:
    """Of a bucket's rows: the same cells' counts over all blocks, back to each block."""
    keys = [unpacked(x) for x in asked.column("cells").to_pylist()]
    sizes = [len(k) for k in keys]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    cols = []
    for name in ("t", "b"):
        own = np.concatenate([uncounted(x, n) for x, n in zip(asked.column(name).to_pylist(), sizes, strict=True)])
        total = np.bincount(at, own).astype(np.int64)[at]
        cols.append(pa.array([counts(x) for x in np.split(total, np.cumsum(sizes)[:-1])], pa.binary()))
    return pa.table([asked.column("block"), asked.column("bucket"), *cols], ["block", "bucket", "t", "b"])


def _losses(block: Block, totals: np.ndarray, in_model: np.ndarray, tokens: int, wide: int, prior: float, owns: tuple) -> np.ndarray:
    """Each token's loss under the model with these counts, of which a text's own tokens are left out."""
    own_prev, own_word, own_pair = (x * in_model for x in owns)
    rest = tokens - (block.sizes[block.doc] * in_model)
    unigram = (totals[block.word] - own_word + 1.0) / (rest + wide)
    return -np.log((totals[block.pair] - own_pair + prior * unigram) / (totals[block.prev] - own_prev + prior))


def score_documents(docs: DataFrame, targets: DataFrame, background: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", prior: float = PRIOR) -> DataFrame:
    """(id, n_tokens long, score double) for every row: the mean over its tokens (the end of the text is one) of the target's less the background's loss.

    The target model counts the documents whose ids are in ``targets``, the
    background model those in ``background``, or others if that is not given;
    the models are :func:`matched` in size.  Documents in neither are only
    scored.  Low scores are like the target.  Both models are bigrams over every word that occurs, smoothed by a
    Dirichlet prior with add-one unigrams over the shared vocabulary.  A text is
    judged without its own tokens: they are taken from the counts of the model
    that it is in, so that nothing scores well for having been counted.

    Documents are dealt by a hash of id and text into blocks of a fixed size.  A
    block sends each of its cells (words, bigrams) once, to the bucket of the
    cell's hash; the bucket sums and answers every block; the answers meet the
    block's texts.  Buckets get hashes of different cells, so no word is hot.
    Cells are told apart by 48 bits and the bucket: n different ones make about
    n^2 / (2^49 * buckets) chance pairs.  The driver gets six sums.

    Null and empty texts have the end alone; rows that repeat count and are
    scored each; null ids are not targets; an empty table gives no rows; other
    columns are ignored.  A text longer than a block is a block by itself.
    """
    ids = lambda df, name: staged(df.select(F.col(id_col).alias("id")).where("id is not null").distinct().withColumn(f"in_{name}", F.lit(True)), name)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = with_small(rows, ids(targets, "targets"), ["id"], "left").withColumn("target", F.coalesce("in_targets", F.lit(False)))
    if background is None:
        rows = rows.withColumn("background", ~F.col("target"))
    else:
        rows = with_small(rows, ids(background, "others"), ["id"], "left").withColumn("background", F.coalesce("in_others", F.lit(False)))
    rows = matched(rows.select("id", "text", "target", "background"))
    wide, n_target, n_background, size = vocabulary(rows)
    blocks = max(1, -(-size // BLOCK))
    dealt = rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.lit(blocks))).repartition(min(blocks, PARTITIONS), "block")
    asked = dealt.groupBy("block").applyInArrow(_ask(blocks), "block long, bucket long, cells binary, t binary, b binary")
    answers = asked.repartition(min(blocks, PARTITIONS), "bucket").groupBy("bucket").applyInArrow(_answer, "block long, bucket long, t binary, b binary")

    def score(texts: pa.Table, told: pa.Table) -> pa.Table:
        block = Block(texts.column("text").cast(pa.binary()).to_pylist(), blocks)
        told = {k: x for k, *x in zip(*(told.column(c).to_pylist() for c in ("bucket", "t", "b")), strict=True)}
        owns = block.own(block.prev), block.own(block.word), block.own(block.pair)
        loss = []
        for i, (role, tokens) in enumerate((("target", n_target), ("background", n_background))):
            totals = np.concatenate([uncounted(told[k][i], z - a) for k, a, z in block.parts()])
            loss.append(_losses(block, totals, texts.column(role).to_numpy()[block.doc], tokens, wide, prior, owns))
        mean = np.add.reduceat(loss[0] - loss[1], np.cumsum(block.sizes) - block.sizes) / block.sizes
        return pa.table([texts.column("id"), pa.array(block.sizes), pa.array(mean)], ["id", "n_tokens", "score"])

    kind = rows.schema["id"].dataType.simpleString()
    met = dealt.groupBy("block").cogroup(answers.repartition(min(blocks, PARTITIONS), "block").groupBy("block")).applyInArrow(score, f"id {kind}, n_tokens long, score double")
    return met.withColumnRenamed("id", id_col)
