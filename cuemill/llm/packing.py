"""Best-fit packing of tokenised documents into fixed-length sequences by minimum bin slack."""

from __future__ import annotations

import functools
import json
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cuemill.llm.common import salt_of, sliced, staged
from cuemill.llm.memo import Memo

CAPACITY, END_ID, SALTS = 4096, 1, 64
#: A text on which a model's ids are compared with those made from words.
PROBE = "It's O'Re, an e.g. (x_y)1,234.5 don't\tstop--NOW! Één ŵörd… 日本 😀 a.b,c ..".encode()


class Words:
    """Ids of whole texts from the ids of their words.

    The tokenizer lower-cases, drops white space, and parts letters from other
    characters; its tokens never span such places.  So a text's ids are those of
    its lower-cased runs between ASCII white space, with a comma or full stop
    that follows a letter a run of its own.  Each different run is tokenised
    once, many at a time.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        #: other models may have tokens that span words: they get whole texts
        self.by_words = self._parts_words()
        self.mark, self.mark_id = max(((t.content, i) for i, t in self.tokenizer.get_added_tokens_decoder().items()), default=("", -1))
        vocab, suffix = self.tokenizer.get_vocab(), self.tokenizer.model.end_of_word_suffix
        self.is_last = np.zeros(max(vocab.values()) + 1, bool)
        self.is_last[[i for t, i in vocab.items() if suffix and t.endswith(suffix)]] = True
        self.memo, self.end = Memo(self._ids), np.array([END_ID], "<u4").tobytes()
        if self.by_words:  # another pattern may part the same kinds of steps elsewhere
            self.by_words = self(PROBE).tolist() == [*self._encode(PROBE.decode()).ids, END_ID]

    def _parts_words(self) -> bool:
        """Whether the file has the normaliser, the splitting and the word ends that the short way relies on."""
        form = json.loads(self.tokenizer.to_str())
        steps = lambda x, k: [y for z in x.get(k, []) for y in steps(z, k)] if x and x["type"] == "Sequence" else [x] if x else []
        norms, splits = steps(form["normalizer"], "normalizers"), steps(form["pre_tokenizer"], "pretokenizers")
        return (
            "Lowercase" in [x["type"] for x in norms]
            and {x["type"] for x in norms} <= {"NFC", "Replace", "Lowercase"}
            and [x["type"] for x in splits] == ["Split", "ByteLevel"]
            and bool(form["model"].get("end_of_word_suffix"))
            and len(self.tokenizer.get_added_tokens_decoder()) > 0
        )

    def _ids(self, words: list[bytes]) -> list[bytes]:
        """A run of letters is one word to the tokenizer, whose last token shows that it ends there; the others are parted by the special token."""
        texts, out = [w.decode(errors="replace") for w in words], {}
        plain = [w for w in texts if w.isalpha()]
        for i in range(0, len(plain), 500):
            part = plain[i : i + 500]
            ids = np.array(self._encode(" ".join(part)).ids, "<u4")
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) == len(part):  # no run has fewer ends than one, so each has one
                out.update(zip(part, self._cut(ids, ends, 0), strict=True))
        rest, gap = [w for w in texts if w not in out], f" {self.mark} "
        for i in range(0, len(rest), 500):
            part = rest[i : i + 500]
            ids = np.array(self._encode(gap.join(part) + gap).ids, "<u4")
            out.update(zip(part, self._cut(ids, np.flatnonzero(ids == self.mark_id), 1), strict=True))
        return [out[w] for w in texts]

    def _encode(self, text: str):
        return self.tokenizer.encode_batch_fast([text], add_special_tokens=False)[0]

    @staticmethod
    def _cut(ids: np.ndarray, ends: np.ndarray, gap: int) -> list[bytes]:
        data = ids.tobytes()
        return [data[4 * a : 4 * b] for a, b in zip([0, *(ends[:-1] + gap).tolist()], ends.tolist(), strict=True)]

    def __call__(self, text: bytes) -> np.ndarray:
        if not self.by_words or b"<|" in text:  # it may hold a special token's string
            return np.array([*self._encode(text.decode(errors="replace")).ids, END_ID], "<u4")
        runs = re.sub(rb"(?<=[a-z])[.,]", rb" \g<0>", text.lower()).split()
        return np.frombuffer(b"".join([*self.memo.values(runs), self.end]), "<u4")


@functools.lru_cache(maxsize=2)
def words(path: str) -> Words:
    """One for each worker and model."""
    return Words(path)


def token_pieces(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY, keep_ids: bool = False) -> DataFrame:
    """(id, piece int, start long, length long, ids_crc32 long[, ids array<long>]) for every piece of every row.

    Each text's ids end with ``END_ID``; only longer texts are cut.  Null counts as empty.
    """

    def batches(parts):
        tok = words(model_path)
        for b in sliced(parts, 1, rows=500):
            at, rows, kept = [], [], []
            for k, t in enumerate(b.column(1).cast(pa.binary()).to_pylist()):
                ids = tok(t or b"")
                for piece, start in enumerate(range(0, len(ids), capacity)):
                    cut = ids[start : start + capacity]
                    at.append(k)
                    rows.append((piece, start, len(cut), zlib.crc32(cut.tobytes())))
                    kept.append(cut) if keep_ids else None
            cols = [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), (pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)]
            more = [pa.array(kept, pa.list_(pa.int64()))] if keep_ids else []
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), *cols, *more], ["id", "piece", "start", "length", "ids_crc32", *["ids"] * keep_ids])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    out = src.mapInArrow(batches, f"id {src.schema['id'].dataType.simpleString()}, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * keep_ids)
    return out.withColumnRenamed("id", id_col)


def fullest(counts: dict[int, int], room: int) -> dict[int, int]:
    """The multiset of available lengths with the largest sum of at most ``room``, as {length: copies}.

    Subset sums are the set bits of an integer; a length of which there are
    several goes in by halves of its number.  It ends as soon as the room can be
    filled to the last token.
    """
    sums, full, trail = 1, (1 << room + 1) - 1, []
    for length in sorted((x for x in counts if x <= room), reverse=True):
        left, step = min(counts[length], room // length), 1
        while left and not sums >> room & 1:
            step = min(step, left)
            trail.append((sums, length, step))
            sums |= sums << step * length & full
            left, step = left - step, 2 * step
        if sums >> room & 1:
            break
    at, taken = sums.bit_length() - 1, {}
    for before, length, step in reversed(trail):
        if not before >> at & 1:
            at -= step * length
            taken[length] = taken.get(length, 0) + step
    return taken


def patterns(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """(number of bins, {length: copies in each}) until no piece is left.

    Minimum bin slack: a bin takes the longest piece left and the fullest feasible
    combination for the rest of its room, which is then removed.  Taking the same
    combination again gives the same bin while its lengths last, so those bins are
    made at once and the work depends on the number of different lengths (at most
    ``capacity``), not on the number of pieces.
    """
    counts, out = {k: v for k, v in counts.items() if v}, []
    while counts:
        top = max(counts)
        rest = counts | {top: counts[top] - 1}
        bin_ = fullest({k: v for k, v in rest.items() if v}, capacity - top)
        bin_[top] = bin_.get(top, 0) + 1
        times = min(counts[k] // m for k, m in bin_.items())
        out.append((times, bin_))
        for k, m in bin_.items():
            counts[k] -= m * times
            if not counts[k]:
                del counts[k]
    return out


def pack(pieces: DataFrame, id_col: str = "doc_id", capacity: int = CAPACITY) -> DataFrame:
    """The columns of :func:`token_pieces` plus sequence_id long and offset long: gapless from 0 in each sequence.

    The driver sees the number of pieces of each length (at most ``capacity``
    rows) and plans with :func:`patterns`.  A piece finds its place by its rank
    among the pieces of its length; ranks are counted per (length, salt) and
    shifted, so a length that a third of all pieces have is not sorted in one
    task.  The shifts (capacity x salts rows) and the plan (a few rows for each
    length) are broadcast; neither grows with the corpus.
    """
    spark = pieces.sparkSession
    pieces = pieces.select(*[c for c in (id_col, "piece", "start", "length", "ids_crc32", "ids") if c in pieces.columns])
    pieces = pieces.withColumn("_salt", salt_of(F.col(id_col), SALTS))
    tally = staged(pieces.groupBy("length", "_salt").agg(F.count(F.lit(1)).alias("n")), "lengths")
    shifts = tally.withColumn("_shift", F.sum("n").over(W.partitionBy("length").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)))
    shifts = shifts.select("length", "_salt", F.coalesce("_shift", F.lit(0)).alias("_shift"))
    counts = {r["length"]: r["n"] for r in tally.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    plan, used, base = [], dict.fromkeys(counts, 0), 0
    for times, bin_ in patterns(counts, capacity):
        offset = 0
        for length, copies in sorted(bin_.items(), reverse=True):
            plan.append((length, used[length], used[length] + copies * times, copies, base, offset))
            used[length] += copies * times
            offset += copies * length
        base += times
    plan = spark.createDataFrame(plan, "length long, _from long, _to long, _copies long, _base long, _off long")
    rank = F.row_number().over(W.partitionBy("length", "_salt").orderBy(id_col, "piece")) - 1 + F.col("_shift")
    ranked = pieces.join(F.broadcast(shifts), ["length", "_salt"]).withColumn("_rank", rank)
    placed = ranked.join(F.broadcast(plan), (ranked["length"] == plan["length"]) & (F.col("_rank") >= F.col("_from")) & (F.col("_rank") < F.col("_to"))).drop(plan["length"])
    nth = F.col("_rank") - F.col("_from")
    return placed.withColumns(
        {
            "sequence_id": (F.col("_base") + F.floor(nth / F.col("_copies"))).cast("long"),
            "offset": (F.col("_off") + nth % F.col("_copies") * F.col("length")).cast("long"),
        }
    ).drop("_salt", "_shift", "_rank", "_from", "_to", "_copies", "_base", "_off")


def pack_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text", capacity: int = CAPACITY) -> DataFrame:
    """Tokenise (once; the piece table is staged) and pack every row of ``docs``.

    Null and empty texts are a piece of one token; a long text is tokenised
    whole and cut; rows that repeat are packed each; null ids are ids like
    others; other columns are ignored, whatever their names; an empty table
    gives no rows.
    """
    return pack(staged(token_pieces(docs, model_path, id_col, text_col, capacity), "pieces"), id_col, capacity).select(id_col, "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids, document_lengths) from :func:`pack`ed pieces with ids; a group has at most ``capacity`` tokens."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "length", "ids")))
    return packed.groupBy("sequence_id").agg(parts.alias("p")).select("sequence_id", F.flatten("p.ids").alias("ids"), F.col("p.length").alias("document_lengths"))
