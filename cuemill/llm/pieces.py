"""SentencePiece encoding that keeps each piece's place in the original bytes, and decoding."""

from __future__ import annotations

import functools
import struct

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import free_names, sliced

BAR = "▁"


class CharMap:
    """A compiled character map: a double-array trie of source byte strings and a block of NUL-ended replacements."""

    def __init__(self, blob: bytes):
        size = struct.unpack_from("<I", blob)[0] if blob else 0
        self.units = np.frombuffer(blob, "<u4", size // 4, 4).tolist() if size else []
        self.texts = blob[4 + size :] if size else b""
        #: bytes that can start a source string
        self.heads = {c for c in range(256) if self.units and self._step(self._child(0), c) is not None}

    def _child(self, at: int) -> int:
        unit = self.units[at]
        return at ^ ((unit >> 10) << ((unit & 0x200) >> 6))

    def _step(self, base: int, byte: int) -> int | None:
        at = base ^ byte
        return at if at < len(self.units) and self.units[at] & 0x800000FF == byte else None

    def longest(self, text: bytes, start: int) -> tuple[int, bytes] | None:
        """Length of the longest source string that ``text`` has at ``start``, and its replacement."""
        if not self.units or text[start] not in self.heads:
            return None
        base, found = self._child(0), None
        for i in range(start, len(text)):
            at = self._step(base, text[i])
            if at is None:
                break
            base = self._child(at)
            if self.units[at] >> 8 & 1:
                found = i + 1 - start, self.units[base] & 0x7FFFFFFF
        if not found:
            return None
        return found[0], self.texts[found[1] : self.texts.index(0, found[1])]


def _char_len(byte: int) -> int:
    return 1 if byte < 0xC0 else 2 if byte < 0xE0 else 3 if byte < 0xF0 else 4


class Normaliser:
    """Longest-prefix normalisation with source alignment, as a model's settings ask for it."""

    def __init__(self, spec):
        self.map = CharMap(spec.precompiled_charsmap)
        self.prefix, self.squeeze, self.escape = spec.add_dummy_prefix, spec.remove_extra_whitespaces, spec.escape_whitespaces
        self.bar = BAR.encode() if self.escape else b" "

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """The normalised bytes, and for each of them (and for the end) the offset of its source byte."""
        if not self.map.units and not self.squeeze:
            return self._plain(text)
        return self._mapped(text)

    def _plain(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Without a map only spaces change, so the alignment is a running sum."""
        if not text:
            return b"", np.zeros(1, np.int64)
        src = np.frombuffer(text, np.uint8)
        wide = np.where(src == 32, len(self.bar), 1)
        at = np.repeat(np.arange(len(src), dtype=np.int32), wide)
        head = np.zeros(len(self.bar) * self.prefix, np.int32)
        return self.bar * self.prefix + text.replace(b" ", self.bar), np.concatenate([head, at, np.array([len(src)], np.int32)])

    def _mapped(self, text: bytes) -> tuple[bytes, np.ndarray]:
        out, at, i, n = bytearray(), [], 0, len(text)
        parts = []
        while i < n:
            hit = self.map.longest(text, i)
            if hit is None:
                step = min(_char_len(text[i]), n - i)
                hit = step, text[i : i + step]
            parts.append((i, *hit))
            i += hit[0]
        if self.squeeze:
            while parts and parts[0][2] == b" ":
                parts.pop(0)
        if not parts:
            return b"", np.array([n if self.squeeze else 0])
        spaced = self.squeeze
        if self.prefix:
            out += self.bar
            at += [parts[0][0]] * len(self.bar)
        for start, _, got in parts:
            if spaced:
                got = got.lstrip(b" ")
            for c in got:
                add = self.bar if c == 32 else bytes([c])
                out += add
                at += [start] * len(add)
            if got:
                spaced = self.squeeze and got.endswith(b" ")
        end = parts[-1][0] + parts[-1][1]
        if self.squeeze:
            while out.endswith(self.bar):
                end = at[len(out) - len(self.bar)]
                del out[-len(self.bar) :], at[len(out) :]
        return bytes(out), np.array([*at, end])


def _places_before(text: bytes) -> np.ndarray:
    """For each byte of the text with its malformed parts replaced (and for the end), the byte of the text that it stands for."""
    parts, at = [], 0
    while at < len(text):
        try:
            text[at:].decode()
            good, bad = len(text) - at, 0
        except UnicodeDecodeError as e:
            good, bad = e.start, e.end - e.start
        parts += [np.arange(at, at + good), np.full(3 * bool(bad), at + good)]
        at += good + bad
    return np.concatenate([*parts, [len(text)]]).astype(np.int64)


class Encoder:
    """Ids as the library gives them for whole texts, and each piece's end in the original bytes."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2 as pb

        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        model = pb.ModelProto.FromString(open(path, "rb").read())
        self.normalise = Normaliser(model.normalizer_spec)
        kinds = pb.ModelProto.SentencePiece.Type
        self.unknown = self.sp.unk_id()
        self.width = np.array([1 if p.type == kinds.BYTE else len(p.piece.encode()) for p in model.pieces], np.int32)

    def __call__(self, text: bytes) -> tuple[np.ndarray, np.ndarray]:
        given = text.decode(errors="replace")
        clean = given.encode()
        norm, source = self.normalise(clean)
        if clean != text:
            source = _places_before(text)[source]
        text = given
        ids = np.array(self.sp.encode(text, num_threads=1), np.int32)
        wide = self.width[ids]
        if (ids == self.unknown).any():  # only without byte fallback: such a piece has the text's own characters
            wide = np.array([len(p.piece.encode()) for p in self.sp.encode(text, return_type="proto", num_threads=1).pieces])
        ends = np.cumsum(wide)
        if len(norm) != (ends[-1] if len(ends) else 0):
            raise ValueError("the pieces do not add up to the normalised text")
        return ids, source[ends].astype(np.int32)


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One for each worker and model."""
    return Encoder(path)


def _lists(rows: list[np.ndarray], kind) -> pa.Array:
    ends = np.cumsum([0, *map(len, rows)])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int32), *rows]), kind))


def _rows(col: pa.ListArray) -> list[list[int]]:
    """The lists of a column, through NumPy (Arrow's own way makes an object of each number first); null is empty."""
    flat, cuts = col.values.to_numpy(), col.offsets.to_numpy().tolist()
    return [flat[a:b].tolist() if known else [] for a, b, known in zip(cuts, cuts[1:], col.is_valid().to_pylist(), strict=False)]


def encode_documents(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, ids array<int>, ends array<int>) for every row.

    ``ids`` are those of the library's encode() without begin or end ids;
    piece ``i`` covers the original UTF-8 bytes from ``ends[i - 1]`` (0 at first)
    up to ``ends[i]``, so the spans tile the text.  A dummy prefix has no bytes.
    Null and empty texts give empty arrays; a long text is encoded whole;
    malformed bytes count as U+FFFD.  Rows are independent, so repeats, null ids
    and other columns don't matter; an empty table gives no rows.
    """

    def batches(parts):
        enc = encoder(model_path)
        for b in sliced(parts, 1, rows=500):
            got = [enc(t or b"") for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), _lists([x[0] for x in got], pa.int32()), _lists([x[1] for x in got], pa.int32())], ["id", "ids", "ends"])

    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    return src.mapInArrow(batches, f"id {src.schema['id'].dataType.simpleString()}, ids array<int>, ends array<int>").withColumnRenamed("id", id_col)


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """``encoded`` plus ``decoded``: the library's decode() of the column ``ids``; null counts as no ids.

    Where the table has a column of that name, in any case, the new one gets
    underscores in front.  Rows are independent; an empty table gives no rows.
    """
    names = encoded.columns
    (out,) = free_names(encoded, "decoded")

    def batches(parts):
        sp = encoder(model_path).sp
        for b in sliced(parts, names.index("ids"), rows=500):
            texts = sp.decode(_rows(b.column(names.index("ids"))), num_threads=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(texts, pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in encoded.schema)
    return encoded.mapInArrow(batches, f"{schema}, {out} string")
