"""Suffix-array deduplication: bytes covered by a string of ``width`` bytes that also starts in an earlier document are removed.

A suffix array over every byte would be many times the text. The arrays here are sparse: each window of ``width`` bytes belongs to the
least hash of its 16-byte strings, its *key*, so equal windows have equal keys, and a run of windows with one key is one entry,
about one for every 18 bytes. An entry carries its key, a hash of its content, and hashes of the bytes just left and just right of the key.

Entries are dealt to tasks by key. Each task takes them in order of the documents, in batches, and keeps a logarithmic family of
sorted levels: a new batch is sorted, merge-scanned against every level, and added; levels of equal size are merged.
An entry with the key and content of an earlier document's is covered whole. Two entries of one key with different content share a window only if the
bytes left or right of the key agree, as one side holds half of the window's rest; the windows of such entries that hold that side, at the ends of shared
passages, are looked at one by one: the smallest document of every window's hash is found, and the others' windows are covered.

Entries, and later windows, that repeat in one task are answered there, so what is sent for a passage that very many documents share grows with
the number of tasks only. Texts are shuffled twice, by document: to look at windows, and to cut them. Content and windows are compared by hashes (96 and 64 bits).

Defined results: a null text counts as empty; texts under ``width`` bytes lose nothing; rows that repeat an id count as one document and get its spans;
a null id is no document's predecessor and loses nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import release, small_batches, stored, trim

_U = np.uint64
_A, _B, _C = _U(0x9E3779B97F4A7C15), _U(0xC2B2AE3D27D4EB4F), _U(0x165667B19E3779F9)
#: Length of the strings that keys hash.
GRAM = 16


def _loads(data: bytes) -> np.ndarray:
    """The eight bytes from each offset on, as an integer."""
    return np.ndarray((len(data) - 7,), np.uint64, data, 0, (1,)).copy()


def _gram_hashes(x: np.ndarray, n: int) -> np.ndarray:
    h = x[:n] * _A
    h ^= h >> _U(29)
    h += x[GRAM - 8 : GRAM - 8 + n]
    h *= _B
    h ^= h >> _U(32)
    return h


def window_hashes(x: np.ndarray, m: int, width: int) -> np.ndarray:
    """Hashes of the first m windows."""
    h = x[:m] * _A
    for at in [*range(8, width - 8, 8), width - 8]:
        h ^= h >> _U(31)
        h += x[at : at + m]
        h *= _C
    h ^= h >> _U(29)
    h *= _B
    h ^= h >> _U(32)
    return h


#: Longer texts are taken in pieces of so many windows.
PIECE = 1 << 23


def entries(data: bytes, width: int) -> tuple[np.ndarray, ...] | None:
    """(key, content, left, right, place, first, last) of the runs of windows with one key at one place."""
    m = len(data) - width + 1
    if m < 1:
        return None
    if m > PIECE:
        parts = []
        for at in range(0, m, PIECE):
            *rest, place, first, last = entries(data[at : at + PIECE + width - 1], width)
            parts.append((*rest, place + at, first + at, last + at))
        return tuple(np.concatenate(x) for x in zip(*parts, strict=True))
    x = _loads(data)
    grams = _gram_hashes(x, len(data) - GRAM + 1)
    # 40 bits of hash, then the place: of equal strings in a window the leftmost counts.
    grams = ((grams >> _U(24)) << _U(24)) | np.arange(len(grams), dtype=np.uint64)
    span, low, many = 1, grams, width - GRAM + 1
    while span * 2 <= many:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if span < many:
        low = np.minimum(low[: len(low) - (many - span)], low[many - span :])
    start = np.ones(m, bool)
    start[1:] = low[1:] != low[:-1]
    first = np.flatnonzero(start)
    last = np.append(first[1:], m) - 1
    h = window_hashes(x, m, width)
    key = low[first]
    gram_at = (key & _U(0xFFFFFF)).astype(np.int64)
    content = (h[first] * _A) ^ (h[last] + (last - first).astype(np.uint64))
    content ^= content >> _U(33)
    side = (width - GRAM) // 2
    # Eight-byte loads over `side` bytes to each side; one of both sides is whole in every window.
    n = len(x)

    def beside(offsets: list[int]) -> np.ndarray:
        out = np.zeros(len(key), np.uint64)
        for o in offsets:
            at = gram_at + o
            ok = (at >= 0) & (at < n)
            out = (out ^ (out >> _U(31))) * _C + np.where(ok, x[np.clip(at, 0, n - 1)], _U(0))
        return ((out ^ (out >> _U(32))) * _B) >> _U(64 - SIDE_BITS)

    left = beside([-side, -side + 8, -8])
    right = beside([GRAM, GRAM + 8, GRAM + side - 8])
    return key, content, left, right, gram_at, first, last


def _merged(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Overlapping [lo, hi) of one document as one."""
    if not len(doc):
        return doc, lo, hi
    o = np.lexsort((lo, doc))
    doc, lo, hi = doc[o], lo[o], hi[o]
    new = np.ones(len(doc), bool)
    group = np.cumsum(np.append(True, doc[1:] != doc[:-1])) - 1
    reach = np.maximum.accumulate(hi + group * (1 << 40)) - group * (1 << 40)
    new[1:] = (doc[1:] != doc[:-1]) | (lo[1:] > reach[:-1])
    at = np.flatnonzero(new)
    return doc[at], lo[at], np.maximum.reduceat(hi, at)


def _batch(names: list[str], *columns: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=names)


_SPAN = ["doc", "lo", "hi", "kind"]
ASK, COVERED = 0, 1


def _dealt(part: np.ndarray, ask: tuple[np.ndarray, ...], covered: tuple[np.ndarray, ...], parts: int) -> pa.RecordBatch:
    """Rows (part, w, rest): for each part its entries or windows, whose hashes ``w`` don't compress and whose (doc, lo) do; without w, covered (doc, lo, hi)."""
    *w, doc, lo = ask
    o = np.argsort(part, kind="stable")
    cuts = np.flatnonzero(np.append(True, np.diff(part[o]) != 0))
    some = np.split(o, cuts[1:]) if len(o) else []
    rows = [(int(part[x[0]]), b"".join(c[x].tobytes() for c in w), _packed_columns(doc[x], lo[x])) for x in some]
    if len(covered[0]):
        rows.append((int(covered[0][0] % parts), None, _packed_columns(*covered)))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int32(), pa.binary(), pa.binary()))], names=["part", "w", "rest"])


def _entries_of(docs: DataFrame, width: int, chunk_bytes: int, parts: int) -> DataFrame:
    """(part, w, rest): by part of their keys, entries to ask for, packed in two integers, and spans that a smaller document of the same task covers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def close() -> pa.RecordBatch:
            a, b, first, doc = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            o = np.lexsort((doc, b, a))
            new = np.append(True, (a[o][1:] != a[o][:-1]) | (b[o][1:] != b[o][:-1]))
            ask = np.empty(len(a), bool)
            ask[o] = doc[o] == doc[o][np.flatnonzero(new)][np.cumsum(new) - 1]
            del o, new
            lo = first[~ask].astype(np.int64)
            covered = _merged(doc[~ask], lo, lo + (a[~ask] & _U(0x3F)).astype(np.int64) + width)
            # In the order of the texts, in which ids and places compress well.
            a, b, doc, first = a[ask], b[ask], doc[ask], first[ask]
            return _dealt(((a >> _U(24)) % _U(parts)).astype(np.int32), (a, b, doc, first), covered, parts)

        for batch in batches:
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                data = text.as_py().encode("utf-8", "surrogatepass")
                found = entries(data, width)
                if found is not None:
                    key, content, left, right, place, first, last = found
                    a, b = packed(key, content, left, right, place - first, last - first)
                    held.append((a, b, first.astype(np.int32), np.full(len(a), doc, np.int64)))
                    size += len(data)
                    if size >= chunk_bytes:
                        yield close()
                        size = 0
        if held:
            yield close()
        trim()

    rows = docs.where("doc_id is not null and text is not null").select(F.col("doc_id").cast("long").alias("doc"), "text")
    return rows.mapInArrow(run, "part int, w binary, rest binary")


#: Bits of a side's hash: keys that stand in very many texts have that many others beside them, and each one that is alike by chance has its windows looked at.
SIDE_BITS = 18
_SIDE = _U((1 << SIDE_BITS) - 1)


def packed(key, content, left, right, place, size):
    """An entry in two integers: key 40 bits, right 18, size 6; content 40, left 18, place of the key 6."""
    a = ((key >> _U(24)) << _U(24)) | ((right & _SIDE) << _U(6)) | size.astype(np.uint64)
    b = ((content >> _U(24)) << _U(24)) | ((left & _SIDE) << _U(6)) | place.astype(np.uint64)
    return a, b


class Entries:
    """Packed entries with their documents, and what is asked of their sides."""

    def __init__(self, a, b, doc, lo, width: int):
        self.a, self.b, self.doc, self.lo, self.width = a, b, doc, lo, width
        self.size = (a & _U(0x3F)).astype(np.int64)
        self.place = (b & _U(0x3F)).astype(np.int64)
        self.side = (width - GRAM) // 2
        self.whole = (a ^ (b >> _U(7))) * _A ^ b * _B

    def sides(self) -> list[tuple[np.ndarray, np.ndarray]]:
        """For left and right: the entries some window of which holds that side whole, and their key with the side's hash."""
        key = (self.a >> _U(24)) << _U(SIDE_BITS)
        left = np.flatnonzero(self.place >= self.side)
        right = np.flatnonzero(self.place - self.size <= self.side)
        return [(left, key[left] | ((self.b[left] >> _U(6)) & _SIDE)), (right, key[right] | ((self.a[right] >> _U(6)) & _SIDE))]

    def windows(self, which: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
        """The windows of some entries that hold the left (0) or right (1) side whole, to be looked at one by one."""
        lo, hi = self.lo[which], self.lo[which] + self.size[which]
        edge = self.lo[which] + self.place[which] - self.side
        return self.doc[which], lo if side == 0 else np.maximum(lo, edge), np.minimum(hi, edge) if side == 0 else hi, ASK


class Level:
    """Sorted entries: by key and content, and by key and side."""

    def __init__(self, e: Entries, told: list[np.ndarray]):
        self.e, self.told = e, told
        self.by_whole = np.argsort(e.whole, kind="stable")
        self.whole = e.whole[self.by_whole]
        self.by_side = []
        for which, values in e.sides():
            o = np.argsort(values, kind="stable")
            self.by_side.append((values[o], which[o]))

    def __len__(self) -> int:
        return len(self.e.a)

    def holds(self, e: Entries) -> np.ndarray:
        """Which entries stand here with key and content."""
        i = self.by_whole[np.minimum(np.searchsorted(self.whole, e.whole), len(self) - 1)]
        return (self.e.a[i] == e.a) & (self.e.b[i] == e.b)

    def beside(self, values: np.ndarray, side: int) -> tuple[np.ndarray, np.ndarray]:
        """Which values are met here; and the entries here that are met for the first time."""
        mine, which = self.by_side[side]
        lo, hi = np.searchsorted(mine, values, "left"), np.searchsorted(mine, values, "right")
        met, ends = lo < hi, np.zeros(len(mine) + 1, np.int64)
        np.add.at(ends, lo[met], 1)
        np.add.at(ends, hi[met], -1)
        hit = which[np.cumsum(ends[:-1]) > 0]
        news = hit[~self.told[side][hit]]
        self.told[side][news] = True
        return met, news

    def merged(self, other: Level) -> Level:
        x, y = self.e, other.e
        e = Entries(*(np.concatenate([getattr(x, f), getattr(y, f)]) for f in ("a", "b", "doc", "lo")), x.width)
        return Level(e, [np.concatenate([self.told[i], other.told[i]]) for i in (0, 1)])


class Family:
    """Levels of one task's keys. Batches come in order of the documents."""

    def __init__(self, width: int):
        self.levels: list[Level] = []
        self.width = width

    def add(self, a, b, doc, lo) -> list[tuple[np.ndarray, np.ndarray, np.ndarray, int]]:
        """(doc, lo, hi, kind): covered bytes [lo, hi), or windows lo to hi to be looked at one by one."""
        o = np.lexsort((doc, b, a))
        e = Entries(a[o], b[o], doc[o], lo[o], self.width)
        new = np.append(True, (e.a[1:] != e.a[:-1]) | (e.b[1:] != e.b[:-1]))
        covered = e.doc > e.doc[np.flatnonzero(new)][np.cumsum(new) - 1]
        for level in self.levels:
            covered |= level.holds(e)
        out = [(e.doc[covered], e.lo[covered], e.lo[covered] + e.size[covered] + self.width, COVERED)]
        keep = ~covered
        e = Entries(e.a[keep], e.b[keep], e.doc[keep], e.lo[keep], self.width)
        if not len(e.a):
            return out
        told = []
        for side, (which, values) in enumerate(e.sides()):
            _, back, count = np.unique(values, return_inverse=True, return_counts=True)
            met = count[back] > 1  # others of this batch
            for level in self.levels:
                there, news = level.beside(values, side)
                met |= there
                out.append(level.e.windows(news, side))
            out.append(e.windows(which[met], side))
            told.append(np.zeros(len(e.a), bool))
            told[side][which[met]] = True
        self.levels.append(Level(e, told))
        while len(self.levels) > 1 and len(self.levels[-2]) < 2 * len(self.levels[-1]):
            last = self.levels.pop()
            self.levels[-1] = self.levels[-1].merged(last)
        return out


#: Bytes of text whose entries one task takes, about one entry for 18 bytes; a family holds those of one of ``PARTS`` parts of them at a time.
TASK_BYTES = 24 << 20
PARTS = 4


def _scan_levels(rows: DataFrame, width: int, batch_rows: int, partitions: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        at = None

        def spans(found: list) -> pa.RecordBatch:
            kinds = np.concatenate([np.full(len(f[0]), f[3], np.int8) for f in found])
            return _batch(_SPAN, *(np.concatenate([f[i] for f in found]).astype(t) for i, t in ((0, np.int64), (1, np.int32), (2, np.int32))), kinds)

        def solved() -> Iterator[pa.RecordBatch]:
            """The part's entries in order of the documents, some whole documents at a time."""
            a, b, doc, lo = (np.concatenate([h[i] for h in held]) for i in range(4))
            held.clear()
            o = np.argsort(doc, kind="stable")
            a, b, doc, lo = a[o], b[o], doc[o], lo[o]
            family, start = Family(width), 0
            while start < len(doc):
                end = int(np.searchsorted(doc, doc[min(start + batch_rows, len(doc)) - 1], "right"))
                yield spans(family.add(a[start:end], b[start:end], doc[start:end], lo[start:end]))
                start = end

        for batch in batches:
            for part, w, rest in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                if part != at and held:
                    yield from solved()
                at = part
                if not w.is_valid:
                    yield spans([(*_unpacked(rest.as_py(), 3), COVERED)])
                else:
                    held.append((*np.frombuffer(w.as_py(), np.uint64).reshape(2, -1), *_unpacked(rest.as_py(), 2)))
        if held:
            yield from solved()
        trim()

    return rows.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(run, "doc long, lo int, hi int, kind byte")


def _packed_columns(*columns: np.ndarray) -> bytes:
    """Integer columns as differences, compressed: ids and places in the order of the texts take little."""
    parts = [np.diff(c.astype(np.int64), prepend=0).tobytes() for c in columns]
    return zstandard.compress(b"".join(parts), 1)


def _unpacked(data: bytes, n: int) -> list[np.ndarray]:
    """The n columns of _packed_columns."""
    return list(np.frombuffer(zstandard.decompress(data), np.int64).reshape(n, -1).cumsum(1))


def _windows_of(texts: DataFrame, width: int, chunk: int, buckets: int) -> DataFrame:
    """(part, w, rest): the asked windows by part of their hashes, ``rest`` their packed (doc, lo); without w, covered (doc, lo, hi)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def close() -> pa.RecordBatch:
            w, doc, lo = (np.concatenate([h[i] for h in held]) for i in range(3))
            o = np.lexsort((doc, w))
            new = np.append(True, w[o][1:] != w[o][:-1])
            ask = np.empty(len(w), bool)
            ask[o] = doc[o] == doc[o][np.flatnonzero(new)][np.cumsum(new) - 1]
            cd, cl, ch = _merged(doc[~ask], lo[~ask], lo[~ask] + width)
            w, doc, lo = w[ask], doc[ask], lo[ask]
            return _dealt((w % _U(buckets)).astype(np.int32), (w, doc, lo), (cd, cl, ch), buckets)

        for batch in batches:
            spans: list[tuple] = []
            for doc, z, asked in zip(batch.column(0).to_pylist(), batch.column(1), batch.column(2), strict=True):
                v = asked.values
                lo, hi, kind = (v.field(i).to_numpy().astype(np.int64) for i in range(3))
                c = kind == COVERED
                spans.append((np.full(c.sum(), doc, np.int64), lo[c], hi[c]))
                if not c.all():
                    data = zstandard.decompress(z.as_py())
                    lo, count = lo[~c], hi[~c] - lo[~c] + 1
                    at = np.repeat(lo - (np.cumsum(count) - count), count) + np.arange(count.sum())
                    at = np.unique(at[at <= len(data) - width])
                    h = window_hashes(_loads(data), len(data) - width + 1, width) if len(at) else np.zeros(0, np.uint64)
                    held.append((h[at], np.full(len(at), doc, np.int64), at))
                    size += len(at)
            none = np.zeros(0, np.int64)
            yield _dealt(none, (none, none, none), _merged(*(np.concatenate([x[i] for x in spans]) for i in range(3))), buckets)
            if size >= chunk:
                yield close()
                held, size = [], 0
        if held:
            yield close()

    return texts.mapInArrow(run, "part int, w binary, rest binary")


def _judge(windows: DataFrame, width: int, partitions: int) -> DataFrame:
    """(doc, lo, hi): bytes covered by windows of smaller documents, and those known before. One bucket at a time is held."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at = [], None

        def spans(doc: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> pa.RecordBatch:
            return _batch(["doc", "lo", "hi"], doc, lo.astype(np.int32), hi.astype(np.int32))

        def close() -> pa.RecordBatch:
            w, doc, lo = (np.concatenate([h[i] for h in held]) for i in range(3))
            o = np.lexsort((doc, w))
            w, doc, lo = w[o], doc[o], lo[o]
            new = np.append(True, w[1:] != w[:-1])
            later = doc > doc[np.flatnonzero(new)][np.cumsum(new) - 1]
            return spans(*_merged(doc[later], lo[later], lo[later] + width))

        for batch in batches:
            for bucket, w, rest in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if bucket != at and held:
                    yield close()
                    held = []
                at = bucket
                if w is None:
                    yield spans(*_unpacked(rest, 3))
                else:
                    held.append((np.frombuffer(w, np.uint64), *_unpacked(rest, 2)))
        if held:
            yield close()

    return windows.repartition(partitions, "part").sortWithinPartitions("part").mapInArrow(run, "doc long, lo int, hi int")


def _compressed(docs: DataFrame) -> DataFrame:
    """(doc_id, z): the texts in UTF-8, null as empty, compressed one by one, as all of them are shuffled twice."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [packer.compress(t.as_py().encode("utf-8", "surrogatepass")) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).mapInArrow(run, f"doc_id {kind}, z binary")


def remove_repeats(docs: DataFrame, width: int = 50, chunk_bytes: int = 16 << 20, batch_rows: int = 1 << 17) -> DataFrame:
    """(doc_id, n_bytes, spans, kept) of every document: the removed [start, end) and the bytes that stay."""
    if width < 3 * GRAM:
        raise ValueError(f"width must be {3 * GRAM} or more")
    docs = docs.select("doc_id", "text")
    spark = docs.sparkSession
    small_batches(spark)
    # Tasks by the bytes of the texts, so what a family holds doesn't grow with the input; the session's number if that is more.
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    partitions = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total // TASK_BYTES))
    spans = _scan_levels(_entries_of(docs, width, chunk_bytes, PARTS * partitions), width, batch_rows, partitions)
    asked = stored(spans.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi", "kind")).alias("spans")))
    del spans
    release(spark)  # the entries' shuffle files
    some = _compressed(docs.where("text is not null")).join(asked, F.col("doc_id") == F.col("doc")).select("doc", "z", "spans")
    covered = stored(_judge(_windows_of(some, width, 2_000_000, 2 * partitions), width, partitions))
    release(spark, asked)
    covered = covered.groupBy("doc").agg(F.collect_list(F.struct("lo", "hi")).alias("spans"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sizes, removed, kept = [], [], []
            for z, s in zip(batch.column(1), batch.column(2), strict=True):
                data = zstandard.decompress(z.as_py())
                out, ends = data, []
                if s.is_valid and len(s):
                    lo, hi = (np.minimum(s.values.field(i).to_numpy().astype(np.int64), len(data)) for i in (0, 1))
                    _, lo, hi = _merged(np.zeros(len(lo), np.int64), lo, hi)
                    ends = [(int(x), int(y)) for x, y in zip(lo, hi, strict=True) if y > x]
                    out = b"".join(data[x:y] for x, y in zip([0, *(e[1] for e in ends)], [*(e[0] for e in ends), len(data)], strict=True))
                sizes.append(len(data))
                removed.append([{"start": x, "end": y} for x, y in ends])
                kept.append(out)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(removed, pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))), pa.array(kept, pa.binary())],
                names=["doc_id", "n_bytes", "spans", "kept"],
            )

    kind = docs.schema["doc_id"].dataType.simpleString()
    last = _compressed(docs).join(covered, F.col("doc_id") == F.col("doc"), "left").select("doc_id", "z", "spans")
    return last.mapInArrow(cut, f"doc_id {kind}, n_bytes long, spans array<struct<start:long,end:long>>, kept binary")


def op9_repeats(docs: DataFrame) -> DataFrame:
    removed = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return remove_repeats(docs).select(
        "doc_id", "n_bytes", removed.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256")
    )
