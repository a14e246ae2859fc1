"""Removal of long repeated byte strings, by anchored buckets and a run-length index in each.

A string of ``LENGTH`` bytes is placed by its anchor: the leftmost of its
32-byte strings with the smallest hash, which depends on its content alone.
Neighbouring windows mostly share an anchor; they make a *segment* (100 to 168
bytes), and two equal windows always lie in segments of equal anchors.  So the
corpus is dealt by anchor, and each bucket finds its repeats alone:

1. documents are dealt into blocks of a fixed size; a block names the anchors of
   its segments
2. buckets of anchors answer which of them occur more than once anywhere; no
   window elsewhere can repeat
3. a block indexes its different segments of those anchors that stand there more
   than once, streams every copy through the index, and sends each different
   segment once, with the places of the copies that it found
4. a bucket does the same with the segments of all blocks: it indexes the
   different ones, streams the others through the index, and marks every window
   of which the matching statistics know an earlier one
5. blocks cut out what is marked

Segments of an anchor that very many blocks or contexts share aren't sent to one
bucket: their windows are named by content first, which spreads them, and those
that occur more than once are sent and indexed as strings of their own.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import IntegralType

from cuemill.llm.common import discard, staged
from cuemill.llm.planes import counts, mixed, packed, unpacked, uncounted

LENGTH, GRAM = 100, 32
SPAN = LENGTH - GRAM + 1
#: Bytes of text in a block of documents.
BLOCK = 8 << 20
#: Partitions that blocks and buckets are dealt to at most; beyond it a task takes several, one after another.
PARTITIONS = 20_000
#: Segments that blocks may send of one anchor; those of others are dealt again by the content of their windows.
HOT = 4096
#: Bytes of different segments in one index, or all those of an anchor if they are more.
INDEXED = 1 << 19
#: Bytes of text that are hashed at a time, and positions that are worked on at a time.
PART, STEP = 1 << 22, 1 << 16
_MIX = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB], np.uint64)
_PLACE = np.uint64((1 << 17) - 1)
_NULL = -(1 << 63)


def _grams(buf: np.ndarray) -> np.ndarray:
    """A 64-bit hash of the 32 bytes at each place."""
    words = np.ndarray((len(buf) - 7,), "<u8", buf, 0, (1,)) * _MIX[0]
    words = (words ^ (words >> np.uint64(32))) * _MIX[1]
    words ^= words >> np.uint64(29)
    n = len(buf) - GRAM + 1
    total = words[:n] * _MIX[2] + words[8 : n + 8] * _MIX[3] + words[16 : n + 16] * _MIX[4] + words[24 : n + 24] * _MIX[5]
    return mixed(total, 0)


def _anchors(buf: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of :func:`_grams`, and the place of the anchor of each window."""
    hashes = np.empty(max(0, len(buf) - GRAM + 1), np.uint64)
    at = np.empty(max(0, len(buf) - LENGTH + 1), np.int64)
    for lo in range(0, len(at), STEP):
        part = _grams(buf[lo : lo + STEP + LENGTH - 1])
        hashes[lo : lo + len(part)] = part
        least = (part & ~_PLACE) | np.arange(len(part), dtype=np.uint64)  # equal hashes: the leftmost
        wide = 1
        while 2 * wide <= SPAN:
            least, wide = np.minimum(least[:-wide], least[wide:]), 2 * wide
        if wide < SPAN:
            least = np.minimum(least[: -(SPAN - wide)], least[SPAN - wide :])
        at[lo : lo + len(least)] = (least & _PLACE).astype(np.int64) + lo
    return hashes, at


def _words(buf: np.ndarray) -> np.ndarray:
    """The eight bytes at each place."""
    return np.ndarray((max(0, len(buf) - 7),), "<u8", buf, 0, (1,))


def _contents(words: np.ndarray, at: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each string of ``size`` bytes."""
    out = size.astype(np.uint64)
    for k in range(0, int(size.max(initial=0)), 8):
        out = mixed(out ^ words[at + np.minimum(k, size - 8)], 1)
    return out


def _equal(words: np.ndarray, a: np.ndarray, b: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether the strings of ``size`` bytes at ``a`` and ``b`` are the same bytes."""
    same = np.ones(len(a), bool)
    for k in range(0, int(size.max(initial=0)), 8):
        off = np.minimum(k, size - 8)
        same &= words[a + off] == words[b + off]
    return same


def _alike(words: np.ndarray, at: np.ndarray, size: np.ndarray, key: np.ndarray, *order: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order by key, content and ``order``; and of each place in it, that of the first string with the same key and bytes."""
    content = _contents(words, at, size)
    o = np.lexsort((*order[::-1], content, key))
    content, place = content[o], np.arange(len(o))
    new = np.append(True, (key[o][1:] != key[o][:-1]) | (content[1:] != content[:-1]) | (size[o][1:] != size[o][:-1]))[: len(o)]
    head = np.maximum.accumulate(np.where(new, place, 0))
    later = np.flatnonzero(~new)
    differ = later[~_equal(words, at[o[later]], at[o[head[later]]], size[o[later]])]
    head[differ] = differ  # equal hashes of different bytes: it stands alone, and the index still sees it
    return o, head


class Block:
    """The documents of a block, in order of their ids, as one buffer."""

    def __init__(self, table: pa.Table):
        ids = table.column("id").cast(pa.int64()).to_pylist()
        texts = [t or b"" for t in table.column("text").cast(pa.binary()).to_pylist()]
        self.order = sorted(range(len(ids)), key=lambda i: (ids[i] is not None, ids[i] or 0, texts[i]))
        self.ids = np.array([ids[i] if ids[i] is not None else _NULL for i in self.order], np.int64)
        self.texts = [texts[i] for i in self.order]
        self.ends = np.cumsum([0, *map(len, self.texts)])
        self.buf = np.frombuffer(b"".join(self.texts), np.uint8)

    def doc(self, at: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.ends, at, "right") - 1

    def segments(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of each segment: its first window's place, its bytes, and its anchor's name (48 bits of a hash)."""
        parts, i = [], 0
        while i < len(self.texts):
            j = max(i + 1, int(np.searchsorted(self.ends, self.ends[i] + PART)) - 1)
            base, buf = self.ends[i], self.buf[self.ends[i] : self.ends[j]]
            if len(buf) >= LENGTH:
                hashes, at = _anchors(buf)
                inside = np.ones(len(at), bool)
                for a, b in zip(self.ends[i:j] - base, self.ends[i + 1 : j + 1] - base, strict=True):
                    inside[max(a, b - LENGTH + 1) : b] = False
                same = inside[1:] & inside[:-1] & (at[1:] == at[:-1])
                first = np.flatnonzero(inside & np.append(True, ~same))
                last = np.flatnonzero(inside & np.append(~same, True))
                parts.append((first + base, last - first + LENGTH, mixed(hashes[at[first]], 4) >> np.uint64(16)))
            i = j
        kinds = (np.int64, np.int64, np.uint64)
        return tuple(np.concatenate([np.zeros(0, t), *c]).astype(t) for t, c in zip(kinds, zip(*parts, strict=True) if parts else [()] * 3, strict=True))


class Names:
    """The different segments of a block (or windows, as strings of ``LENGTH`` bytes) by bucket and name, with their copies."""

    def __init__(self, block: Block, at: np.ndarray, size: np.ndarray, key: np.ndarray, buckets: int):
        order, head = _alike(_words(block.buf), at, size, key, at)
        self.at, self.size, self.key = at[order], size[order], key[order]
        self.head = head
        self.first = np.flatnonzero(head == np.arange(len(head)))
        #: names are sorted, and so are the buckets that their upper bits choose
        self.names, self.name_of = np.unique(self.key, return_inverse=True)
        to = ((self.names >> np.uint64(16)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.bucket, starts = np.unique(to, return_index=True)
        self.starts = np.append(starts, len(to))
        self.to = to

    def rows(self, no: int) -> list[tuple]:
        n, kinds = np.bincount(self.name_of, minlength=len(self.names)), np.bincount(self.name_of[self.first], minlength=len(self.names))
        return [(to, no, 2, packed(self.names[a:z]), counts(n[a:z]), counts(kinds[a:z]), *[b""] * 4) for to, a, z in zip(self.bucket.tolist(), self.starts[:-1].tolist(), self.starts[1:].tolist(), strict=True)]

    def codes(self, told: pa.Table) -> np.ndarray:
        """The answers for the names."""
        got = dict(zip(told.column("bucket").to_pylist(), told.column("codes").to_pylist(), strict=True))
        out = np.frombuffer(b"".join(got.get(b, b"") for b in self.bucket.tolist()), np.uint8)
        if len(out) != len(self.names):
            raise ValueError("a block's documents changed between two passes")
        return out

    def strings(self, block: Block, no: int, wanted: np.ndarray) -> list[tuple]:
        """Rows of the different strings of wanted names, with the places of their copies."""
        rows, words = [], wanted[self.name_of]
        own = self.first[words[self.first]]
        copies = np.flatnonzero(words & (self.head != np.arange(len(self.head))))
        for to, i in _split(self.to[self.name_of[own]]):
            i = own[i]
            data = b"".join(block.buf[x : x + n].tobytes() for x, n in zip(self.at[i].tolist(), self.size[i].tolist(), strict=True))
            rows.append((to, no, 1, packed(self.key[i]), counts(self.size[i]), b"", data, _bytes(block.ids[block.doc(self.at[i])]), _bytes(self.at[i]), b""))
        known = np.unique(self.head[copies])
        for index, i, k in _indexes(lambda x: (block.buf, self.at[x], self.size[x]), known, copies, self.key, self.size, self.at):
            # a copy goes if its bytes stand earlier in the block
            found, place = index.search(block.buf, self.at[k], self.size[k])
            string = index.owner[place]
            k = k[(found == self.size[k]) & (self.at[i][string] + place - index.begin(string) < self.at[k])]
            for to, x in _split(self.to[self.name_of[k]]):
                x = k[x]
                rows.append((to, no, 3, b"", counts(self.size[x] - LENGTH + 1), b"", b"", b"", _bytes(self.at[x]), b""))
        return rows


def _indexes(strings, own: np.ndarray, others: np.ndarray, key: np.ndarray, size: np.ndarray, rank: np.ndarray):
    """(index, the strings of ``own`` that it holds, those of ``others`` with the same keys), some keys at a time.

    Keys are apart, so an index holds all strings of some, in order of ``rank``.
    ``own`` is in order of keys; ``strings`` gives the bytes, places and sizes of strings.
    """
    share = np.cumsum(size[own]) // INDEXED
    new = np.append(True, key[own][1:] != key[own][:-1])[: len(own)]
    share = share[np.maximum.accumulate(np.where(new, np.arange(len(own)), 0))]
    names, first = np.unique(key[own], return_index=True)
    of = np.full(len(others), -1)
    at = np.minimum(np.searchsorted(names, key[others]), max(len(names) - 1, 0))
    if len(names):
        same = names[at] == key[others]
        of[same] = share[first[at[same]]]
    streamed = dict((k, others[x]) for k, x in _split(of))
    for no, i in _split(share):
        i = own[i]
        i = i[np.argsort(rank[i], kind="stable")]
        data, at, sizes = strings(i)
        take = np.repeat(at - np.cumsum(sizes) + sizes, sizes) + np.arange(sizes.sum())
        yield RunIndex(data[take], sizes), i, streamed.get(no, others[:0])


def _bytes(a: np.ndarray) -> bytes:
    return np.ascontiguousarray(a).tobytes()


def _split(to: np.ndarray):
    """(value, indices) for each different value of ``to``."""
    order = np.argsort(to, kind="stable")
    values, starts = np.unique(to[order], return_index=True)
    return zip(values.tolist(), np.split(order, starts[1:]), strict=True) if len(to) else ()


#: kind 1: strings for the index; 2: names to count; 3: places of copies.  n: sizes, or occurrences of names; d: different strings of them.
SENT = "bucket long, block long, kind int, keys binary, n binary, d binary, data binary, ids binary, at binary, x binary"
#: kind 2 or 4: answers for names of segments or windows; 3: windows to remove.
TOLD = "block long, bucket long, kind int, codes binary, at binary, n binary"
_ARROW = {"int": pa.int32(), "long": pa.int64(), "binary": pa.binary()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    fields = [f.split() for f in schema.split(", ")]
    cols = list(zip(*rows, strict=True)) or [()] * len(fields)
    return pa.table([pa.array(c, _ARROW[t]) for c, (_, t) in zip(cols, fields, strict=True)], names=[n for n, _ in fields])


def _of_kind(t: pa.Table, kind: int) -> pa.Table:
    return t.filter(pa.compute.equal(t.column("kind"), kind))


def _named(block: Block, buckets: int) -> Names:
    return Names(block, *block.segments(), buckets)


def _name(table: pa.Table, buckets: int) -> pa.Table:
    """Step 1."""
    return _table(_named(Block(table), buckets).rows(table.column("block")[0].as_py()), SENT)


def _counted(names: pa.Table, kind: int) -> list[tuple]:
    """Step 2, and the same for windows: for each block's names 0 if they occur once anywhere; else 1, or 2 for more than ``HOT`` different strings of blocks."""
    if not names.num_rows:
        return []
    keys = [unpacked(x) for x in names.column("keys").to_pylist()]
    sizes = [len(k) for k in keys]
    _, at = np.unique(np.concatenate(keys), return_inverse=True)
    n, kinds = (np.bincount(at, np.concatenate([uncounted(x, k) for x, k in zip(names.column(c).to_pylist(), sizes, strict=True)])) for c in ("n", "d"))
    code = np.where(n > 1, np.where((kinds > HOT) & (kind == 2), 2, 1), 0).astype(np.uint8)[at]
    parts = np.split(code, np.cumsum(sizes)[:-1])
    return [(block, bucket, kind, p.tobytes(), b"", b"") for block, bucket, p in zip(names.column("block").to_pylist(), names.column("bucket").to_pylist(), parts, strict=True)]


def _windows(block: Block, names: Names, hot: np.ndarray, buckets: int) -> Names:
    """All windows of the different segments of hot names, named by content."""
    own = names.first[hot[names.name_of[names.first]]]
    each = names.size[own] - LENGTH + 1
    at = np.repeat(names.at[own], each) + np.arange(each.sum()) - np.repeat(np.cumsum(each) - each, each)
    size = np.full(len(at), LENGTH)
    return Names(block, at, size, mixed(_contents(_words(block.buf), at, size), 5) >> np.uint64(16), buckets)


def _send(table: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """Step 3: strings of names that occur more than once; of hot names, the copies of segments and the names of windows."""
    if not table.num_rows or not told.num_rows:
        return _table([], SENT)
    no, block = table.column("block")[0].as_py(), Block(table)
    names = _named(block, buckets)
    codes = names.codes(_of_kind(told, 2))
    rows = names.strings(block, no, codes == 1)
    if (codes == 2).any():
        rows += [r for r in names.strings(block, no, codes == 2) if r[2] == 3]
        rows += _windows(block, names, codes == 2, buckets).rows(no)
    return _table(rows, SENT)


def _send_windows(table: pa.Table, told: pa.Table, buckets: int) -> pa.Table:
    """Step 3 for the windows of hot names."""
    if not table.num_rows or not told.num_rows:
        return _table([], SENT)
    no, block = table.column("block")[0].as_py(), Block(table)
    names = _named(block, buckets)
    windows = _windows(block, names, names.codes(_of_kind(told, 2)) == 2, buckets)
    return _table(windows.strings(block, no, windows.codes(_of_kind(told, 4)) == 1), SENT)


class RunIndex:
    """A run-compressed Burrows-Wheeler transform of byte strings, with the suffix array sampled where runs begin and end.

    Suffixes end at their string's end, and equal ones are in order of their
    strings.  What is kept are the runs (character and size) and, for each, the
    text places of the suffixes at its first row and at the last row of the run
    before, with the number of bytes that these two share (up to ``LENGTH`` it
    counts as none).  The suffix array and the transform itself are dropped.

    That is enough to stream a text through the index.  A string that is not in
    it goes backwards, from its end, through the runs (:meth:`search`).  Of the
    indexed strings the samples tell as much: inside a run, the suffix before a
    suffix in order moves with it, one byte to the right, and shares one byte
    less, so the last sample at or before a place tells its matching statistic,
    and where the match is (:meth:`statistics`).
    """

    def __init__(self, data: np.ndarray, sizes: np.ndarray):
        n, self.sizes = len(data) + len(sizes), sizes
        self.stops = np.cumsum(sizes + 1) - 1
        self.owner = np.repeat(np.arange(len(sizes)), sizes + 1)
        self.left = self.stops[self.owner] - np.arange(n)  # bytes up to the string's end
        code = np.zeros(n, np.int64)
        code[self.left > 0] = data.astype(np.int64) + 1
        sa = self._suffixes(code)
        before = np.where((sa == 0) | (code[sa - 1] == 0), 0, code[sa - 1])
        head = np.flatnonzero(np.append(True, before[1:] != before[:-1]) | (before == 0))
        self.raw = np.zeros(n + 8, np.uint8)
        self.raw[:n] = (np.maximum(code, 1) - 1).astype(np.uint8)
        place, match = sa[head], sa[np.maximum(head - 1, 0)]
        # the transform: its runs by character and row, where each run's rows go when they are led by it, and a sample of each
        char = before[head].astype(np.int64)
        order = np.lexsort((head, char))
        self.rows, self.run_char, self.run_row, self.run_size = n, char[order], head[order], np.diff(np.append(head, n))[order]
        self.run_key, self.run_to, self.run_place = self.run_char * (n + 1) + self.run_row, np.cumsum(self.run_size) - self.run_size, place[order]
        del sa, before
        shared = self._shared(code, place, match)
        order = np.argsort(place)
        self.place, self.match, self.shared = place[order], match[order], shared[order]

    def _suffixes(self, code: np.ndarray) -> np.ndarray:
        """The suffix array by prefix doubling, only on rows that are still tied."""
        n, wide = len(code), 7
        key = code
        for m in range(1, wide):  # nine bits a symbol, none past the end
            key = code << 9 * m | np.where(code == 0, 0, np.append(key[1:], 0))
        sa = np.argsort(key)
        s = key[sa]
        start = np.append(True, s[1:] != s[:-1])[:n]
        rank = np.empty(n, np.int64)
        rank[sa] = np.maximum.accumulate(np.where(start, np.arange(n), 0))
        while True:
            rows = np.flatnonzero(~start | np.append(~start[1:], False))  # tied with a neighbour
            at = sa[rows]
            last = wide > self.sizes.max(initial=0)  # what is tied still is equal up to the end of its string: by place
            nxt = at if last else np.where(self.left[at] >= wide, rank[np.minimum(at + wide, n - 1)] + 1, 0)
            key = rank[at] << 32 | nxt
            o = np.argsort(key)
            at, key = at[o], key[o]
            sa[rows] = at
            if last:
                return sa
            new = np.append(True, key[1:] != key[:-1])[: len(rows)]
            start[rows] = new
            rank[at] = rows[np.maximum.accumulate(np.where(new, np.arange(len(rows)), 0))]
            wide *= 2

    def _shared(self, code: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Bytes that the suffixes at ``a`` and ``b`` begin with alike, by comparing them; below ``LENGTH`` none."""
        words, most = _words(self.raw), np.minimum(self.left[a], self.left[b])
        most[a == b] = 0  # the first row has none before it
        out, alive, k = np.zeros(len(a), np.int64), np.flatnonzero(most >= LENGTH), 0
        while len(alive):
            x = words[a[alive] + k] ^ words[b[alive] + k]
            equal = k + np.where(x == 0, 8, np.bitwise_count((x & -x) - np.uint64(1)) >> 3).astype(np.int64)
            out[alive] = np.minimum(equal, most[alive])
            alive, k = alive[(x == 0) & (equal < most[alive])], k + 8
        return np.where(out >= LENGTH, out, 0)

    def begin(self, string: np.ndarray) -> np.ndarray:
        return self.stops[string] - self.sizes[string]

    def _step(self, c: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Where ``row`` goes when it is led by the character; the first run of the character at or after it; and whether that of the row itself is one."""
        after = np.searchsorted(self.run_key, c * (self.rows + 1) + row)
        last = np.maximum(after - 1, 0)
        own = (after > 0) & (self.run_char[last] == c)
        into = row - self.run_row[last]
        first = np.append(self.run_to, self.rows)[after]  # no run before the row: the character's first row
        return np.where(own, self.run_to[last] + np.minimum(into, self.run_size[last]), first), after, own & (into < self.run_size[last])

    def search(self, data: np.ndarray, at: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Streams strings of ``data`` through the transform, from their ends: the bytes that are found at the end of an indexed string, and the place where these begin.

        Each step leads all rows that match by one more byte; a sample tells the
        place of the first.  What is left once one row matches is verified by
        comparing bytes.
        """
        length, place = np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)
        alive = np.arange(len(at))
        lo, hi = np.zeros(len(at), np.int64), np.full(len(at), len(self.sizes))
        now = np.full(len(at), self.run_place[np.flatnonzero(self.run_row == 0)[0]])
        k = 0
        while len(alive):
            k += 1
            c = data[at[alive] + size[alive] - k].astype(np.int64) + 1
            low, run, own = self._step(c, lo)
            high, _, _ = self._step(c, hi)
            fine = high > low
            now = np.where(own, now, self.run_place[np.minimum(run, len(self.run_place) - 1)]) - 1
            alive, lo, hi, now = alive[fine], low[fine], high[fine], now[fine]
            length[alive], place[alive] = k, now
            ended = size[alive] == k
            one = (hi - lo == 1) & ~ended
            rest, string = alive[one], self.owner[now[one]]
            left = size[rest] - k
            fits = now[one] - left >= self.begin(string)
            rest, left = rest[fits], left[fits]
            same = self._same(data, at[rest], place[rest] - left, left)
            length[rest[same]] = size[rest[same]]
            place[rest[same]] -= left[same]
            if ended.any():  # of several strings with this end the one that is nothing but it, if there is one
                whole = np.flatnonzero(ended & (hi - lo > 1))
                _, run, _ = self._step(np.zeros(len(whole), np.int64), lo[whole])
                run = np.minimum(run, len(self.run_row) - 1)
                is_one = (self.run_char[run] == 0) & (self.run_row[run] < hi[whole])
                place[alive[whole[is_one]]] = self.run_place[run[is_one]]
            go = ~ended & (hi - lo > 1)
            alive, lo, hi, now = alive[go], lo[go], hi[go], now[go]
        return length, place

    def _same(self, data: np.ndarray, at: np.ndarray, place: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether ``size`` bytes of ``data`` and of the indexed text are the same."""
        same = np.ones(len(at), bool)
        for k in range(0, int(size.max(initial=0)), 8):
            for b in range(8):
                off = np.minimum(k + b, size - 1)
                same &= data[at + off] == self.raw[place + off]
        return same

    def statistics(self) -> tuple[np.ndarray, np.ndarray]:
        """Of each text place, streaming from left to right: the bytes that its suffix shares with the one before it in order, and that one's place."""
        n = len(self.owner)
        sample = np.zeros(n, np.int64)
        sample[self.place] = np.arange(len(self.place))
        sample = np.maximum.accumulate(sample)
        gone = np.arange(n) - self.place[sample]
        return self.shared[sample] - gone, self.match[sample] + gone

    def repeats(self) -> np.ndarray:
        """Whether each text place starts a window that an earlier string has (windows in a string are different from each other, or later ones are marked too)."""
        length, match = self.statistics()
        linked = np.flatnonzero(length >= LENGTH)
        up = np.arange(len(length))
        up[linked] = match[linked]
        while True:  # to the first suffix of those that share the window
            further = up[up[linked]]
            if (further == up[linked]).all():
                break
            up[linked] = further
        least = np.arange(len(length))
        np.minimum.at(least, up[linked], linked)
        return least[up] < np.arange(len(length))


def _match(sent: pa.Table) -> pa.Table:
    """Step 4: the windows to remove, by block; and the answers for names of windows."""
    rows = _counted(_of_kind(sent, 2), 4)
    blocks, places, runs = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    part = _of_kind(sent, 1)
    if part.num_rows:
        keys = [unpacked(x) for x in part.column("keys").to_pylist()]
        many = [len(k) for k in keys]
        size = np.concatenate([uncounted(x, n) for x, n in zip(part.column("n").to_pylist(), many, strict=True)])
        ids, at = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.int64) for c in ("ids", "at"))
        block, key = np.repeat(part.column("block").to_numpy(), many), np.concatenate(keys)
        data = np.frombuffer(b"".join(part.column("data").to_pylist()), np.uint8)
        start = np.cumsum(size) - size
        order, head = _alike(_words(data), start, size, key, ids, block, at)
        first = head == np.arange(len(head))
        own, others = order[first], order[~first]
        rank = np.empty(len(order), np.int64)
        rank[np.lexsort((at, block, ids))] = np.arange(len(order))
        for index, i, k in _indexes(lambda x: (data, start[x], size[x]), own, others, key, size, rank):
            # strings of the index: every window that an earlier one of them has
            edge = np.flatnonzero(np.diff(np.concatenate([[False], index.repeats(), [False]]).astype(np.int8)))
            a, z = edge[::2], edge[1::2]
            string = index.owner[a]
            blocks.append(block[i][string])
            places.append(at[i][string] + a - index.begin(string))
            runs.append(z - a)
            # other blocks' copies: all windows of those that the index finds earlier
            found, place = index.search(data, start[k], size[k])
            k = k[(found == size[k]) & (rank[i][index.owner[place]] < rank[k])]
            blocks.append(block[k])
            places.append(at[k])
            runs.append(size[k] - LENGTH + 1)
    blocks, places, runs = map(np.concatenate, (blocks, places, runs))
    rows += [(to, -1, 3, b"", _bytes(places[i]), counts(runs[i])) for to, i in _split(blocks)]
    part = _of_kind(sent, 3)
    rows += [(to, -1, 3, b"", at, n) for to, at, n in zip(*(part.column(c).to_pylist() for c in ("block", "at", "n")), strict=True)]
    return _table(rows, TOLD)


def _remove(block: pa.Table, marks: pa.Table) -> tuple[list, list, list]:
    """Step 5: for each row of the block, the removed spans and the kept bytes."""
    b = Block(block)
    hits = np.zeros(len(b.buf) + 1, np.int32)
    for at, n in zip(marks.column("at").to_pylist(), marks.column("n").to_pylist(), strict=True):
        at = np.frombuffer(at, np.int64)
        np.add.at(hits, at, 1)
        np.add.at(hits, at + uncounted(n, len(at)) - 1 + LENGTH, -1)
    gone = np.cumsum(hits[:-1]) > 0
    starts, stops, kept = ([None] * len(b.texts) for _ in range(3))
    for k, row in enumerate(b.order):
        own = gone[b.ends[k] : b.ends[k + 1]]
        if own.any():
            edge = np.flatnonzero(np.diff(np.concatenate([[False], own, [False]]).astype(np.int8)))
            starts[row], stops[row] = edge[::2], edge[1::2]
            kept[row] = b.buf[b.ends[k] : b.ends[k + 1]][~own].tobytes()
        else:
            starts[row] = stops[row] = np.zeros(0, np.int64)
            kept[row] = b.texts[k]
    return starts, stops, kept


def _dealt(docs: DataFrame, blocks: int) -> DataFrame:
    """``docs`` (id, text, others) by block: all rows of an id in one, rows without an id by their text."""
    key = F.xxhash64("id", F.when(F.col("id").isNull(), F.col("text")))
    return docs.withColumn("block", F.pmod(key, F.lit(blocks))).repartition(min(blocks, PARTITIONS), "block")


def _told(docs: DataFrame, blocks: int) -> DataFrame:
    """The marks of all blocks, staged."""
    given = _dealt(docs.select("id", "text"), blocks)
    by = lambda df: df.groupBy("block")
    bucketed = lambda df: df.repartition(min(blocks, PARTITIONS), "bucket").groupBy("bucket")
    names = by(given).applyInArrow(lambda t: _name(t, blocks), SENT)
    known = staged(bucketed(names).applyInArrow(lambda t: _table(_counted(t, 2), TOLD), TOLD), "names")
    sent = by(given).cogroup(by(known)).applyInArrow(lambda t, v: _send(t, v, blocks), SENT)
    told = staged(bucketed(sent).applyInArrow(_match, TOLD), "marks")
    marks = told.where("kind = 3")
    if not told.where("kind = 4").isEmpty():
        both = known.unionByName(told.where("kind = 4"))
        sent = by(given).cogroup(by(both)).applyInArrow(lambda t, v: _send_windows(t, v, blocks), SENT)
        marks = marks.unionByName(staged(bucketed(sent).applyInArrow(_match, TOLD), "windows"))
    discard(known)
    return marks


def _ready(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, dict[str, str], int]:
    """``docs`` as id, text and the other columns under plain names; those names; and the number of blocks."""
    if not isinstance(docs.schema[id_col].dataType, IntegralType):
        raise TypeError(f"{id_col} has to be a column of integers, as documents are ordered by it")
    others = {c: f"c{i}" for i, c in enumerate(docs.columns) if c not in (id_col, text_col)}
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), *[F.col(c).alias(n) for c, n in others.items()])
    return rows, others, max(1, -(-(rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0) // BLOCK))


def repeated_spans(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_bytes, starts and stops of the removed spans (arrays of byte offsets), kept (binary).

    A byte goes if a 100-byte string that covers it also starts earlier, in a
    document with a smaller id or in the same one; documents are judged as they
    come in.  Strings never span documents.  Ids are integers, else a TypeError
    is raised.  Null and empty texts have no bytes.  Rows without an id come
    first, in an order that depends on their texts alone; rows that share an id
    are in order of their texts.  A text longer than a block is one by itself.
    Other columns are ignored, whatever their names; an empty table gives no rows.
    """
    rows, _, blocks = _ready(docs, id_col, text_col)
    rows = rows.select("id", "text")
    kind = rows.schema["id"].dataType.simpleString()

    def finish(block: pa.Table, marks: pa.Table) -> pa.Table:
        starts, stops, kept = _remove(block, marks)
        sizes = [len(t or b"") for t in block.column("text").cast(pa.binary()).to_pylist()]
        cols = [block.column("id"), pa.array(sizes, pa.int64()), pa.array(starts, pa.list_(pa.int32())), pa.array(stops, pa.list_(pa.int32())), pa.array(kept, pa.binary())]
        return pa.table(cols, names=["id", "n_bytes", "starts", "stops", "kept"])

    out = _dealt(rows, blocks).groupBy("block").cogroup(_told(rows, blocks).groupBy("block")).applyInArrow(finish, f"id {kind}, n_bytes long, starts array<int>, stops array<int>, kept binary")
    return out.withColumnRenamed("id", id_col)


def drop_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str = "n_chars") -> DataFrame:
    """``docs``, all rows and columns, with the repeated spans cut from the text and ``chars_col``, if there is one, counted anew.

    Bytes of a character that was cut in part go too; a null text stays null.
    Rows are judged as by :func:`repeated_spans`.
    """
    rows, others, blocks = _ready(docs, id_col, text_col)
    names = rows.columns

    def finish(block: pa.Table, marks: pa.Table) -> pa.Table:
        _, _, kept = _remove(block, marks)
        texts = [None if old is None else new.decode(errors="ignore") for old, new in zip(block.column("text").to_pylist(), kept, strict=True)]
        return block.select(names).set_column(1, "text", pa.array(texts, pa.string()))

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    out = _dealt(rows, blocks).groupBy("block").cogroup(_told(rows, blocks).groupBy("block")).applyInArrow(finish, schema)
    back = {id_col: F.col("id"), text_col: F.col("text")} | {c: F.col(n) for c, n in others.items()}
    if chars_col in others:
        back[chars_col] = F.length("text").cast(docs.schema[chars_col].dataType)
    return out.select(*[back[c].alias(c) for c in docs.columns])
