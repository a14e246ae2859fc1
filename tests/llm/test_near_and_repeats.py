"""SimHash groups and repeated byte strings against brute force."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pyarrow.compute
import pytest
import xxhash
from fixtures import documents, odd_rows
from pyspark.sql import functions as F

from cuemill.llm import repeats, similar, simhash


def print_of(t):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
    if not words:
        return 0
    shingles = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    ones = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, 42)
        for b in range(64):
            ones[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * ones[b] > len(shingles))


def components(fps):
    """Root of each fingerprint, by comparing all pairs."""
    fps, root = sorted(set(fps)), {}
    for f in fps:
        root.setdefault(f, f)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(fps):
        for b in fps[:i]:
            if (a ^ b).bit_count() <= 3:
                root[find(a)] = find(b)
    return {f: find(f) for f in fps}


def check_groups(rows, got):
    fps = [print_of(t) for _, t in rows]
    root = components(fps)
    least = {}
    for (i, _), f in zip(rows, fps, strict=True):
        if i is not None:
            least[root[f]] = min(i, least.get(root[f], i))
    assert Counter((r.doc_id, r.fingerprint, r.component_id) for r in got) == Counter((i, f"{f:016x}", least.get(root[f])) for (i, _), f in zip(rows, fps, strict=True))


def test_near_groups(spark):
    check_groups([(i, t) for i, t, *_ in odd_rows()], simhash.near_groups(documents(spark)).collect())


def test_near_groups_of_driver_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    check_groups([(r.doc_id, r.text) for r in docs.collect()], simhash.near_groups(docs).collect())


@pytest.mark.parametrize("bucket", [20_000, 4])
def test_links_find_all_close_pairs(spark, monkeypatch, bucket):
    """Chains and clusters of fingerprints, also where buckets are split again."""
    monkeypatch.setattr(simhash, "BUCKET", bucket)
    rng, fps = random.Random(5), set()
    for _ in range(40):
        x = rng.getrandbits(64)
        for _ in range(rng.randint(1, 12)):
            fps.add(x)
            for _ in range(rng.randint(0, 4)):
                x ^= 1 << rng.randrange(64)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.links(spark.createDataFrame([(signed(x),) for x in fps], "fp long")).collect()]
    assert all((a ^ b).bit_count() <= 3 for a, b in links)
    root = {f: f for f in fps}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    want = components(fps)
    same = lambda of: {frozenset(f for f in fps if of(f) == of(g)) for g in fps}
    assert same(find) == same(lambda f: want[f])


def test_drop_near(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    groups = simhash.near_groups(docs).collect()
    assert sorted(r.doc_id for r in simhash.drop_near(docs).collect()) == sorted({r.component_id for r in groups})


def removed(rows, length=100):
    """Kept bytes and runs, by looking at every byte string; rows in order of id."""
    seen, out = set(), {}
    for i, t in rows:
        data = (t or "").encode()
        cut = np.zeros(len(data) + 1, bool)
        for k in range(len(data) - length + 1):
            s = data[k : k + length]
            if s in seen:
                cut[k : k + length] = True
            seen.add(s)
        kept = bytes(b for b, c in zip(data, cut, strict=False) if not c)
        out[i] = len(data), int(cut.sum()), int((cut[:-1] & ~np.append(False, cut[:-2])).sum()) if len(data) else 0, hashlib.sha256(kept).hexdigest()
    return out


def found(docs):
    spans = repeats.repeated_spans(docs)
    rows = spans.select("doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).cast("long").alias("n"), F.size("starts").cast("long").alias("k"), F.sha2("kept", 256).alias("s"))
    return {r.doc_id: (r.n_bytes, r.n, r.k, r.s) for r in rows.collect()}


@pytest.mark.parametrize("block", [1 << 20, 9000])
def test_repeats(spark, monkeypatch, block):
    monkeypatch.setattr(repeats, "BLOCK", block)
    rng = random.Random(8)
    text = lambda n: "".join(rng.choice("abcdefghij öß\n") for _ in range(n))
    long, shared = text(700), text(150)
    rows = [(i, t) for i, t, *_ in odd_rows() if i is not None][:-1]
    rows += [(200, long), (201, long[:99] + text(5) + long[100:]), (202, shared + text(30) + shared), (203, "x" * 99), (204, long[300:400]), (205, "ab" * 300), (206, "ab" * 60), (207, long[601:] + text(9))]
    rows += [(300 + i, text(i % 40) + shared[i % 50 :] + text(20)) for i in range(60)]
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert found(docs) == removed(sorted(rows))


def test_repeats_of_driver_tables(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert found(docs) == removed(sorted((r.doc_id, r.text) for r in docs.collect()))


@pytest.mark.parametrize("block", [1 << 20, 1500])
def test_hot_anchors(spark, monkeypatch, block):
    """Many different segments of one anchor."""
    rng = random.Random(9)
    text = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    gram = text(60)
    rows = [(i, text(80 + i % 7) + gram + text(80 + i % 5)) for i in range(60)]
    rows += [(100 + i, rows[i][1][10:]) for i in range(0, 60, 3)]
    monkeypatch.setattr(repeats, "HOT", 8)
    monkeypatch.setattr(repeats, "INDEXED", 2000)
    monkeypatch.setattr(repeats, "BLOCK", block)
    docs = documents(spark, [(i, t, None, None) for i, t in rows])
    assert found(docs) == removed(sorted(rows))


def test_run_index():
    """A repetitive collection has few runs, and the index finds the windows that plain search finds."""
    rng = random.Random(10)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(160))
    strings = [base] * 30 + [base[:70] + b"!" + base[71:], base[20:], b"ab" * 90, b"x" * 140, base[::-1]]
    index = repeats.RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    assert len(index.run_char) < sum(map(len, strings)) / 6
    length, match = index.statistics()
    text = b"\0".join(strings) + b"\0"
    seen, want = set(), []
    for i, s in enumerate(strings):
        for k in range(len(s) + 1):
            at = len(want)
            if length[at] >= 100:  # what the samples say is true of the bytes, and ends where it says or at a string's end
                n, m = int(length[at]), int(match[at])
                assert text[at : at + n] == text[m : m + n] and k + n <= len(s)
            window = s[k : k + 100]
            want.append(len(window) == 100 and window in seen)
            seen.add(window)
    assert index.repeats().tolist() == want


def test_search():
    """Backward steps find how much of a string ends an indexed one, and where; a string that is indexed is found as itself."""
    rng = random.Random(12)
    word = lambda n: bytes(rng.choice(b"ab\0c") for _ in range(n))
    strings = sorted({word(rng.randint(1, 14)) for _ in range(300)} | {b"abcabcabcabc" * 9, b"cabcabc" + b"abcabcabcabc" * 9, b"q"}, key=lambda s: rng.random())
    index = repeats.RunIndex(np.frombuffer(b"".join(strings), np.uint8), np.array([len(s) for s in strings]))
    text = b"".join(s + b"$" for s in strings)
    patterns = strings + [word(rng.randint(1, 20)) for _ in range(500)] + [b"z", b"zq", s[:-1] if len(s := strings[0]) > 1 else b"ab"]
    size = np.array([len(p) for p in patterns])
    length, place = index.search(np.frombuffer(b"".join(patterns), np.uint8), np.cumsum(size) - size, size)
    for p, n, at in zip(patterns, length.tolist(), place.tolist(), strict=True):
        whole = any(s.endswith(p) for s in strings)
        assert (n == len(p)) == whole, p
        if n:
            owner = index.owner[at]
            assert text[at : at + n] == p[len(p) - n :] and at + n == index.stops[owner]  # at a string's end
        if p in strings:
            assert strings[index.owner[at]] == p and at == index.begin(np.array([owner]))[0]
    # a byte that no string ends with is found nowhere
    assert length[-3] == 0


def test_all_marks_come_from_the_index(monkeypatch):
    """Counted: every window that goes is one of the matching statistics, or of a string that went through the transform."""
    rng = random.Random(13)
    base = bytes(rng.choice(b"abcdefgh") for _ in range(400))
    texts = [base[:300], base[50:] + b"tail", base, b"new " * 9 + base[100:350], base, base[:300]]
    blocks = [pa.table({"id": pa.array([10 * b + i for i in range(len(texts))]), "text": pa.array(texts, pa.binary()), "block": pa.array([b] * len(texts))}) for b in range(2)]
    told = {"index": 0}
    statistics, search = repeats.RunIndex.repeats, repeats.RunIndex.search

    def counted_repeats(self):
        out = statistics(self)
        told["index"] += int(out.sum())
        return out

    def counted_search(self, data, at, size):
        length, place = search(self, data, at, size)
        told["index"] += int((size - repeats.LENGTH + 1)[length == size].sum())
        return length, place

    def marked():
        named = pa.concat_tables([repeats._name(b, 1) for b in blocks])
        codes = repeats._table(repeats._counted(named, 2), repeats.TOLD)
        sent = pa.concat_tables([repeats._send(b, codes.filter(pa.compute.equal(codes.column("block"), k)), 1) for k, b in enumerate(blocks)])
        out = repeats._match(sent)
        at = [len(x) // 8 for x in out.column("at").to_pylist()]
        return sum(int(repeats.uncounted(x, k).sum()) for x, k in zip(out.column("n").to_pylist(), at, strict=True))

    monkeypatch.setattr(repeats.RunIndex, "repeats", counted_repeats)
    monkeypatch.setattr(repeats.RunIndex, "search", counted_search)
    windows = marked()
    assert windows == told["index"]
    monkeypatch.setattr(repeats.RunIndex, "search", lambda self, data, at, size: (np.zeros(len(at), np.int64), np.zeros(len(at), np.int64)))
    assert 0 < marked() < windows


def test_marks(spark):
    """A passage of 120 bytes has 21 windows, marked in all documents but the first; ids have to be integers."""
    rng = random.Random(12)
    text = lambda n: "".join(rng.choice("abcdef") for _ in range(n))
    shared = text(120)
    docs = documents(spark, [(i, text(60) + chr(65 + i) + shared + chr(65 + i) + text(60), None, None) for i in range(20)])
    told = repeats._told(docs.select(F.col("doc_id").alias("id"), "text"), 3).where("kind = 3").collect()
    assert sum(int(repeats.uncounted(r.n, len(r.at) // 8).sum()) for r in told) == 19 * 21
    with pytest.raises(TypeError, match="integers"):
        repeats.repeated_spans(docs.withColumn("doc_id", F.col("doc_id").cast("string")))


def test_empty(spark):
    empty = documents(spark, [])
    assert simhash.near_groups(empty).count() == repeats.repeated_spans(empty).count() == repeats.drop_repeats(empty).count() == 0


def test_drop_repeats_keeps_every_document(spark):
    docs = documents(spark).where("doc_id is not null").dropDuplicates(["doc_id"])
    out = repeats.drop_repeats(docs)
    assert out.columns == docs.columns and out.count() == docs.count()
    want = removed(sorted((r.doc_id, r.text) for r in docs.collect()))
    assert {r.doc_id: len((r.text or "").encode()) for r in out.collect()} == {i: n - m for i, (n, m, *_) in want.items()}


@pytest.mark.parametrize("tile", [256, 3])
def test_similar_groups(spark, monkeypatch, tile):
    """Stars, chains whose ends aren't similar, rings of all distances around a leader, copies, nulls: as by all pairs."""
    monkeypatch.setattr(similar, "TILE", tile)
    rng = random.Random(6)
    word = lambda: f"w{rng.randrange(9000)}"
    texts = []
    for size in (60, 150):
        for _ in range(4):
            now = [word() for _ in range(size)]
            middle = list(now)
            for _ in range(12):  # a chain: each a little further from the first
                now = list(now)
                now[rng.randrange(size)] = word()
                texts.append(now)
            for edits in (1, 2, 4, 5, 8, 12, 20):  # around one text
                for _ in range(3):
                    near = list(middle)
                    for k in rng.sample(range(size), edits):
                        near[k] = word()
                    texts.append(near)
    rows = [(i, " ".join(ws), None, None) for i, ws in enumerate(texts)] + [(1000, None, None, None), (1001, "", None, None), (1002, "one two", None, None), (None, "one two", None, None), (1003, "one  TWO", None, None), (1003, "one two", None, None), (None, "null alone here", None, None)]
    sets = [frozenset(similar.shingle_set((t or "").encode()).tolist()) for _, t, _, _ in rows]
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    links = 0
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both >= 0.8 * (len(sets[a]) + len(sets[b]) - both):
                links += 1
                root[find(a)] = find(b)
    least: dict = {}
    for i, r in enumerate(rows):
        if r[0] is not None:
            least[find(i)] = min(least.get(find(i), r[0]), r[0])
    want = sorted(((r[0], least.get(find(i))) for i, r in enumerate(rows)), key=repr)
    got = sorted(((r.doc_id, r.component_id) for r in similar.similar_groups(documents(spark, rows)).collect()), key=repr)
    assert got == want and links > 200
    assert similar.similar_groups(documents(spark, [])).collect() == []


@pytest.mark.parametrize("matrix", [1024, 2])
def test_similar_texts_meet_by_their_simhash(spark, monkeypatch, matrix):
    """Pairs of similarity 0.8 share a band and are close; clusters are those of all pairs; what isn't close is no link."""
    monkeypatch.setattr(similar, "MATRIX", matrix)
    rng = np.random.default_rng(7)
    prints, pairs = [], []
    for size in (10, 16, 50, 400):
        for _ in range(40):
            a = rng.integers(0, 1 << 63, size, np.uint64)
            b = a[: -(-4 * size // 5)]
            pairs.append((similar.fingerprint(a), similar.fingerprint(b)))
            prints += pairs[-1]
    # as by counting bits one by one
    words = [[((int(h) + (w + 1) * 0x9E3779B97F4A7C15) % 2**64) for w in range(similar.WORDS)] for h in a]

    def mixed(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 % 2**64
        x = (x ^ x >> 27) * 0x94D049BB133111EB % 2**64
        return x ^ x >> 31

    ones = [sum(mixed(ws[w]) >> k & 1 for ws in words) for w in range(similar.WORDS) for k in range(64)]
    assert similar.fingerprint(a).tolist() == [sum(1 << k for k in range(64) if 2 * ones[64 * w + k] > len(a)) for w in range(similar.WORDS)]
    differ = lambda a, b: int(np.bitwise_count(a[-2:] ^ b[-2:]).sum())
    assert all((similar.band_keys(a) == similar.band_keys(b)).any() and differ(a, b) <= similar.DISTANCE for a, b in pairs)
    two = np.stack([p[-2:] for p in prints], axis=1)
    near = [[differ(a, b) <= similar.DISTANCE for b in prints] for a in prints]
    want = set()
    for i in range(len(prints)):
        seen, todo = {i}, [i]
        while todo:
            k = todo.pop()
            new = {j for j in range(len(prints)) if near[k][j]} - seen
            seen |= new
            todo += new
        want |= {frozenset(seen)} if len(seen) > 1 else set()
    assert {frozenset(c.tolist()) for c in similar._clusters(two, similar.DISTANCE)} == want
    sets = [np.unique(rng.integers(0, 1 << 63, 60, np.uint64)) for _ in range(5)]
    sets += [s[1:] for s in sets]
    rows = [(i, similar.band_keys(p := similar.fingerprint(s)).tobytes(), p[-2:].tobytes(), s.tobytes()) for i, s in enumerate(sets)]
    df = spark.createDataFrame(rows, "fp long, bands binary, last binary, hashes binary")
    assert sorted(map(tuple, similar.similar_links(df).collect())) == [(i, i + 5) for i in range(5)]
    assert similar.similar_links(df, distance=-1).collect() == []


def test_near_copies_are_in_one_bucket(spark, monkeypatch):
    """However many bands a text meets kin texts in, it is compared with one leader; texts with too many shingles of their own with none."""
    rng = random.Random(8)
    base = [f"w{rng.randrange(9000)}" for _ in range(120)]
    rows = []
    for i in range(90):  # 60 with up to 4 words of their own, and 30 with so many that no other has four fifths of their shingles
        words = list(base)
        for k in rng.sample(range(120), i % 5 if i < 60 else 12):
            words[k] = f"x{i}-{k}"
        rows.append((i, " ".join(words), None, None))
    told, was = {}, similar.staged

    def counted(df, tag):
        out = was(df, tag)
        told[tag] = out.count()
        return out

    monkeypatch.setattr(similar, "staged", counted)
    got = {r.doc_id: r.component_id for r in similar.similar_groups(documents(spark, rows)).collect()}
    sets = [set(similar.shingle_set(r[1].encode()).tolist()) for r in rows]
    want = list(range(90))
    for a in range(90):
        for b in range(a):
            if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]):
                want = [min(want[a], want[b]) if w in (want[a], want[b]) else w for w in want]
    assert [got[i] for i in range(90)] == want and 30 < want.count(0) < 60 and want[60:] == list(range(60, 90))
    assert told["members"] > 200 and told["stars"] <= 60


def test_linkable_counts_what_others_have(spark):
    """Four fifths of a set's shingles, in some other set or other, are enough to stay."""
    sets = [np.arange(0, 10), np.arange(2, 12), np.arange(3, 13), np.arange(20, 30), np.array([0, 1, 20, 21, 22, 40, 41])]
    df = spark.createDataFrame([(i, s.astype("<u8").tobytes()) for i, s in enumerate(sets)], "fp long, hashes binary")
    assert sorted(map(tuple, similar.linkable(df).collect())) == [(0, 10), (1, 10), (2, 9)]
