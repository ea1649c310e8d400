"""N-gram Jaccard join in metric space: pivots, regions, triangle-inequality windows, recursion; exact.

Jaccard distance is a metric, but a document's distance to nearly all other documents is 1, so regions around documents chosen from the
whole corpus would leave almost everything in one remainder. Regions are therefore formed where distances below 1 can exist:

1. Shingles get one order for the whole corpus, rarest first by a counting sketch of fixed size. Two documents that link share
   a shingle among the first n - ceil(t n) + 1 of each (prefix principle), so a shingle's *region* holds the documents with it in their prefix.
2. The region's pivot is its most central document, the one that meets most others over all its regions. Distances to pivots are exact;
   documents within 1 - t of one pivot hang together. Their number is linear in a region, whatever its size.
3. What isn't joined yet is joined recursively, inside regions that still hold documents of *different* components. The metric there is the Hamming distance of
   parity bitmaps of the sets, which never exceeds the size of the symmetric difference. A region of more than ``cell`` documents gets annuli
   around the empty set and pivots; documents go to the Voronoi cell of their nearest pivot and, as copies, to each cell inside the triangle-inequality window; cells recurse.
   Where windows don't part a region, as in a group of near misses that are all as far from each other, it is compared in blocks of bounded size.
   Pairs whose sizes or bitmaps (first of the region's width, then wider ones) put them beyond 1 - t are dropped, the rest is verified exactly and merged.

A pair that links is either in one component after step 2 or is examined in step 3, so components are exact. Documents of one
task with equal sets are tied to the first of them at once, so groups of copies don't fill regions.

Sets hold 64-bit hashes of shingles. Shingle hashes of all documents never reach the driver.

Defined results: null, empty and blank texts have the empty set and are linked with nothing; with fewer than five words the whole sequence is the one
shingle; rows that repeat an id count as one document in links; a null id has no component.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute  # noqa: F401
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .components import connected_components
from .quality import _P, _hashes  # one memo for all operators that run in a worker
from .words import _cell_of, release, sliced, small_batches, stored, trim, wanted_filter

SKETCH = 1 << 20
#: Counters of the sketch travel in chunks of this size.
CHUNK = 1 << 13


def shingle_set(text: str, width: int = 5) -> np.ndarray:
    """Sorted hashes of the distinct shingles; ASCII letters in lower case, words split at ASCII white space."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))
    k = min(width, len(h))
    n = len(h) - k + 1
    out = h[:n] + np.uint64(k)
    for i in range(1, k):
        out = (out ^ (out >> np.uint64(29))) * _P + h[i : i + n]
    out = (out ^ (out >> np.uint64(32))) * _P
    return np.unique(out ^ (out >> np.uint64(29)))


def least_common(n: int, percent: int) -> int:
    """ceil(t n), in integers."""
    return -(-percent * n // 100)


def bitmap(s: np.ndarray, cells_each: float = 2.0) -> bytes:
    """Parity of the set in each of 64 to 65,536 cells, ``cells_each`` for each shingle or up to twice that."""
    bits = 1 << min(16, max(6, math.ceil(math.log2(cells_each * len(s)))))
    parity = np.bincount((s & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(parity.astype(np.uint8), bitorder="little").tobytes()


def region_bitmap(s: np.ndarray) -> bytes:
    """A bitmap for the comparisons inside regions, which carry one for each prefix shingle: sets of up to 1,024 shingles get two cells or more for each, so that
    near misses are told apart; larger ones half a cell, which tells unrelated sets apart and keeps a very long text's rows small."""
    return bitmap(s, 2.0 if len(s) <= 1024 else 0.5)


def folded(maps: np.ndarray) -> np.ndarray:
    """Bitmaps of half the size."""
    half = maps.shape[1] // 2
    return maps[:, :half] ^ maps[:, half:]


def sketch(docs: DataFrame) -> np.ndarray:
    """How many documents' shingles fall in each of SKETCH cells; all documents count."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, held, size = np.zeros(SKETCH, np.int64), [], 0
        for b in sliced(batches):
            for text in b.column(0).to_pylist():
                held.append((shingle_set(text) >> np.uint64(44)).astype(np.int64))
                size += len(held[-1])
                if size > 500_000:
                    sums += np.bincount(np.concatenate(held), minlength=SKETCH)
                    held, size = [], 0
        if held:
            sums += np.bincount(np.concatenate(held), minlength=SKETCH)
        held.clear()
        at = range(0, SKETCH, CHUNK)
        yield pa.RecordBatch.from_arrays([pa.array([i // CHUNK for i in at], pa.int32()), pa.array([sums[i : i + CHUNK] for i in at], pa.list_(pa.int64()))], names=["chunk", "counts"])
        trim()

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            for chunk, counts in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                values = counts.values.to_numpy()
                sums[chunk] = sums[chunk] + values if chunk in sums else values
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([v.tobytes() for v in sums.values()], pa.binary())], names=["chunk", "sum"])

    texts = docs.select(F.coalesce("text", F.lit("")).alias("text"))
    parts = texts.mapInArrow(count, "chunk int, counts array<long>").repartition("chunk").mapInArrow(add, "chunk int, sum binary")
    out = np.zeros(SKETCH, np.int64)
    for r in parts.collect():  # SKETCH counters, whatever the input
        out[r["chunk"] * CHUNK : (r["chunk"] + 1) * CHUNK] = np.frombuffer(r["sum"], np.int64)
    return out


def prefixes(docs: DataFrame, counts: np.ndarray, percent: int) -> DataFrame:
    """One table of two kinds of rows: (doc, n, bits, few, copy_of) for each document, (doc, n, token) for each prefix shingle."""
    shared = docs.sparkSession.sparkContext.broadcast(counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[bytes, int] = {}
        order = shared.value
        for b in batches:
            for start in range(0, b.num_rows, 500):
                part = b.slice(start, 500)
                ids, ns, bits, few, copies, docs_, sizes, tokens = [], [], [], [], [], [], [], []
                for doc, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    s = shingle_set(text)
                    n, copy_of = len(s), None
                    if n and doc is not None:
                        key = hashlib.blake2b(s.tobytes(), digest_size=16).digest()
                        copy_of = seen.get(key)
                        if copy_of is None:
                            if len(seen) >= 1_000_000:
                                seen.clear()  # bounded; sets met from now on are learned anew
                            seen[key] = doc
                            length = n - least_common(n, percent) + 1
                            c = order[(s >> np.uint64(44)).astype(np.int64)]
                            first = s[np.lexsort((s, c))[:length]] if length < n else s
                            tokens.append(first)
                            docs_.append(np.full(len(first), doc, np.int64))
                            sizes.append(np.full(len(first), n, np.int32))
                    ids.append(doc)
                    ns.append(n)
                    bits.append(bitmap(s) if n and copy_of is None else None)
                    few.append(region_bitmap(s) if n and copy_of is None else None)
                    copies.append(copy_of)
                k = len(ids)
                # 40 bits of a shingle are enough to find a region; sets are compared in full.
                t = (np.concatenate(tokens) >> np.uint64(24)).view(np.int64) if tokens else np.zeros(0, np.int64)
                none = pa.nulls(len(t), pa.binary())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.concat_arrays([pa.nulls(k, pa.int64()), pa.array(t)]),
                        pa.concat_arrays([pa.array(ids, pa.int64()), pa.array(np.concatenate(docs_) if docs_ else t)]),
                        pa.concat_arrays([pa.array(ns, pa.int32()), pa.array(np.concatenate(sizes) if sizes else t.astype(np.int32))]),
                        pa.concat_arrays([pa.array(bits, pa.binary()), none]),
                        pa.concat_arrays([pa.array(few, pa.binary()), none]),
                        pa.concat_arrays([pa.array(copies, pa.int64()), pa.nulls(len(t), pa.int64())]),
                    ],
                    names=["token", "doc", "n", "bits", "few", "copy_of"],
                )
        del seen
        trim()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    return stored(rows.mapInArrow(run, "token long, doc long, n int, bits binary, few binary, copy_of long"))


def plausible(pairs: DataFrame, bits: DataFrame, percent: int) -> DataFrame:
    """The (u, v) that the bitmaps (_d, bits, n) of both can't rule out."""

    def far(x: bytes, y: bytes) -> int:
        a, b = np.frombuffer(x, np.uint64)[None, :], np.frombuffer(y, np.uint64)[None, :]
        while a.shape[1] > b.shape[1]:
            a = folded(a)
        while b.shape[1] > a.shape[1]:
            b = folded(b)
        return int(np.bitwise_count(a ^ b).sum())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, y, total = b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist()
            keep = [far(i, j) * (100 + percent) <= (100 - percent) * t for i, j, t in zip(x, y, total, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))

    left, right = bits.select(F.col("_d").alias("u"), F.col("bits").alias("bu"), F.col("n").alias("nu")), bits.select(F.col("_d").alias("v"), F.col("bits").alias("bv"), F.col("n").alias("nv"))
    return stored(pairs.join(left, "u").join(right, "v").select("u", "v", "bu", "bv", (F.col("nu") + F.col("nv")).alias("total")).mapInArrow(run, "u long, v long"))


def verify(pairs: DataFrame, docs: DataFrame, percent: int) -> DataFrame:
    """The (u, v) whose exact similarity reaches the threshold."""
    wanted = stored(pairs.select("u").union(pairs.select("v")).distinct().withColumnRenamed("u", "_id"))
    packed = docs.sparkSession.sparkContext.broadcast(wanted_filter(wanted))

    def packed_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = np.unpackbits(packed.value).astype(bool)
        for b in sliced(batches):
            b = b.filter(pa.compute.is_valid(b.column(0)))
            b = b.filter(pa.array(bits[_cell_of(b.column(0).to_numpy())]))
            # A compressed text takes a third of its set of hashes.
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([zstandard.compress(t.encode("utf-8", "surrogatepass"), 3) for t in b.column(1).to_pylist()], pa.binary())], names=["doc", "z"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sets: dict[int, np.ndarray] = {}

        def set_of(doc: int, z: pa.Scalar) -> np.ndarray:
            if doc not in sets:
                if len(sets) >= 500:
                    sets.clear()
                sets[doc] = shingle_set(zstandard.decompress(z.as_py()).decode("utf-8", "surrogatepass"))
            return sets[doc]

        for b in sliced(batches):
            keep = []
            for u, v, x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2), b.column(3), strict=True):
                a, c = set_of(u, x), set_of(v, y)
                common = len(np.intersect1d(a, c, assume_unique=True))
                keep.append(100 * common >= percent * (len(a) + len(c) - common))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1)], names=["u", "v"]).filter(pa.array(keep, pa.bool_()))
        sets.clear()
        trim()

    texts = docs.select(F.col("doc_id").cast("long").alias("doc"), F.coalesce("text", F.lit("")).alias("text"))
    known = stored(texts.mapInArrow(packed_texts, "doc long, z binary").join(wanted, F.col("doc") == F.col("_id")).select("doc", "z"))
    left, right = known.select(F.col("doc").alias("u"), F.col("z").alias("zu")), known.select(F.col("doc").alias("v"), F.col("z").alias("zv"))
    links = stored(pairs.join(left, "u").join(right, "v").select("u", "v", "zu", "zv").mapInArrow(compare, "u long, v long").distinct())
    release(docs.sparkSession, known)
    return links


def parted(rows: DataFrame, percent: int, level: int, cell: int, pivots: int = 12) -> DataFrame:
    """One level of the recursion: each region is cut into the Voronoi cells of its pivots.

    Distances are Hamming distances of the parity bitmaps, folded to the width of the region's narrowest. They are a metric and none exceeds the size of the
    symmetric difference, so the bitmaps of a linked pair are at most rho = n (1 - t) / t apart, n being either size. A document is at home with its nearest
    pivot and is copied to each pivot that is at most 2 rho farther: whoever it links with is at home, or copied, in one of the same cells. Before that,
    the empty set serves as a pivot whose annuli are a size ratio of 1 / t wide, so a document stands in its own annulus and, as a copy, in the one below.
    A region whose windows copy documents more than three times as often on the whole isn't cut by them; blocks take its place.
    """
    annulus = F.floor(F.log("n") / (math.log(100 / percent) * (1 + 1e-9))).cast("int")
    rings = F.array(annulus, annulus - 1) if level == 0 else F.array(F.lit(0))
    ringed = rows.withColumn("ring", F.explode(rings)).withColumn("core", F.col("core") & (F.col("ring") == annulus) if level == 0 else F.col("core"))
    ringed = ringed.withColumn("region", F.xxhash64("region", "ring")).drop("ring", "m")
    many = ringed.groupBy("region").agg(F.count("*").alias("m"), F.min(F.length("bits")).alias("width")).withColumnRenamed("region", "_r")
    known = stored(ringed.join(many, F.col("region") == F.col("_r")).drop("_r"))
    # About twice as many pivots as cells of the wished size, never more than a few dozen in a region.
    share = F.least(F.lit(float(pivots)), F.ceil(2 * F.col("m") / cell)) / F.col("m")
    drawn = known.where(F.pmod(F.xxhash64("doc", F.lit(level)), F.lit(1 << 30)) < share * (1 << 30)).where(F.col("m") > cell)
    chosen = drawn.groupBy("region").agg(F.slice(F.sort_array(F.collect_set("bits")), 1, 64).alias("pivots")).withColumnRenamed("region", "_r")

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            homes, cells_ = [], []
            for bits, n, width, pivots_ in zip(*(b.column(i).to_pylist() for i in (4, 2, 6, 7)), strict=True):
                if not pivots_:
                    homes.append(None)
                    cells_.append([])
                    continue
                at = [np.frombuffer(x, np.uint64)[None, :] for x in (bits, *pivots_)]
                for i, x in enumerate(at):
                    while x.shape[1] * 8 > width:
                        x = folded(x)
                    at[i] = x
                d = np.bitwise_count(np.concatenate(at[1:]) ^ at[0]).sum(1, dtype=np.int64)
                homes.append(int(d.argmin()))
                cells_.append(np.flatnonzero(percent * (d - d.min()) <= 2 * (100 - percent) * n).tolist())
            yield pa.RecordBatch.from_arrays([*b.columns[:7], pa.array(homes, pa.int32()), pa.array(cells_, pa.list_(pa.int32()))], names=[*b.schema.names[:7], "home", "cells"])

    dealt = known.join(chosen, F.col("region") == F.col("_r"), "left").select("region", "doc", "n", "component", "bits", "core", "width", "pivots", "m")
    fields = "region long, doc long, n int, component long, bits binary, core boolean, width int"
    placed = stored(dealt.drop("m").mapInArrow(assign, f"{fields}, home int, cells array<int>"))
    spread = placed.groupBy("region").agg(F.sum(F.size("cells")).alias("copies"), F.count("*").alias("m")).withColumnRenamed("region", "_r")
    placed = placed.join(spread, F.col("region") == F.col("_r")).withColumn("cut", F.col("home").isNotNull() & (F.col("copies") <= 3 * F.col("m")))
    moved = placed.select("*", F.explode(F.when(F.col("cut"), F.col("cells")).otherwise(F.array(F.lit(-1)))).alias("to"))
    core = F.col("core") & (~F.col("cut") | (F.col("to") == F.col("home")))
    out = stored(moved.select(F.when(F.col("cut"), F.xxhash64("region", "to")).otherwise(F.col("region")).alias("region"), "doc", "n", "component", "bits", core.alias("core"), "cut"))
    after = out.groupBy("region").agg(F.count("*").alias("m"), F.max("cut").alias("_cut")).withColumnRenamed("region", "_r")
    return stored(out.drop("cut").join(after, F.col("region") == F.col("_r")).select("region", "doc", "n", "component", "bits", "core", "m", F.col("_cut").alias("cut")))


def candidates(rows: DataFrame, percent: int, cell: int, levels: int = 8) -> DataFrame:
    """Distinct (u, v) of different components of a region that sizes and bitmaps can't rule out.

    ``rows``: (region, doc, n, component, bits, m). Regions of more than ``cell`` documents are cut into Voronoi cells, level by level, as long as that parts them.
    """
    rows = stored(rows.withColumn("core", F.lit(True)))
    found = compared(rows.where(F.col("m") <= cell), percent, cell)
    rows = rows.where(F.col("m") > cell)
    for level in range(levels):
        if rows.isEmpty():
            return found
        rows = parted(rows, percent, level, cell)
        ends = (F.col("m") <= cell) | ~F.col("cut")
        found = found.union(compared(rows.where(ends), percent, cell))
        rows = rows.where(~ends).drop("cut")
    return found.union(compared(rows, percent, cell)).distinct()


def compared(rows: DataFrame, percent: int, cell: int) -> DataFrame:
    """The candidates of regions that are not cut any further. One of m documents is cut into parts of about ``cell`` documents, and each pair
    of parts is compared by itself, so no task holds a region whole. Of each pair one document must be at home.
    """
    parts = F.greatest(F.lit(1), F.ceil(F.col("m") / cell)).cast("int")
    mine = F.pmod(F.xxhash64("doc"), parts).cast("int")
    other = F.explode(F.sequence(F.lit(0), parts - 1))
    dealt = rows.withColumn("part", mine).withColumn("other", other)
    dealt = dealt.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("other", "m")
    dealt = dealt.repartition("region", "lo", "hi").sortWithinPartitions("region", "lo", "hi", "n", "doc")

    def close(held: list, lo: int, hi: int) -> Iterator[tuple[int, int]]:
        doc, n, comp, part, core = (np.array([r[i] for r in held], np.int64) for i in (0, 1, 2, 4, 5))
        if (comp == comp[0]).all() or not core.any():
            return
        words = np.array([len(r[3]) // 8 for r in held])
        kinds = np.unique(words)
        maps = {int(w): np.frombuffer(b"".join(held[i][3] for i in np.flatnonzero(words == w)), np.uint64).reshape(-1, w) for w in kinds}
        for w in kinds:
            big = np.flatnonzero(words == w)
            for v in kinds[(kinds <= w) & (4 * kinds >= w)]:  # sizes differ by a quarter at most, widths of linked pairs by two steps
                small, mine_ = np.flatnonzero(words == v), maps[int(w)]
                while mine_.shape[1] > v:
                    mine_ = folded(mine_)
                theirs = maps[int(v)]
                step = max(1, 400_000 // (len(small) * int(v)))  # a few MB for each array of a block
                for s in range(0, len(big), step):
                    x, mx = big[s : s + step], mine_[s : s + step]
                    # J >= t means |symmetric difference| <= (1 - t) / (1 + t) * (a + b)
                    total = n[x][:, None] + n[small][None, :]
                    ok = (comp[x][:, None] != comp[small][None, :]) & ((core[x][:, None] + core[small][None, :]) > 0)
                    ok &= 100 * np.minimum(n[x][:, None], n[small][None, :]) >= percent * np.maximum(n[x][:, None], n[small][None, :])
                    if lo != hi:
                        ok &= part[x][:, None] != part[small][None, :]
                    i, j = np.nonzero(ok)
                    far = np.bitwise_count(mx[i] ^ theirs[j]).sum(1, dtype=np.int64)
                    near = far * (100 + percent) <= (100 - percent) * total[i, j]
                    for p, q in zip(doc[x[i[near]]].tolist(), doc[small[j[near]]].tolist(), strict=True):
                        if p != q:
                            yield min(p, q), max(p, q)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, at, found = [], None, set()

        def out() -> pa.RecordBatch:
            rows_ = sorted(found)
            found.clear()
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows_], pa.int64()), pa.array([r[1] for r in rows_], pa.int64())], names=["u", "v"])

        for b in sliced(batches, 5000):
            for region, lo, hi, doc, n, comp, bits, part, core in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if (region, lo, hi) != at:
                    if len(held) > 1:
                        found.update(close(held, at[1], at[2]))
                        if len(found) > 100_000:
                            yield out()
                    held, at = [], (region, lo, hi)
                held.append((doc, n, comp, bits, part, core))
        if len(held) > 1:
            found.update(close(held, at[1], at[2]))
        yield out()

    return dealt.select("region", "lo", "hi", "doc", "n", "component", "bits", "part", "core").mapInArrow(run, "u long, v long").distinct()


def jaccard_join(docs: DataFrame, percent: int = 80, cell: int = 4096) -> DataFrame:
    """(doc_id, n_shingles, component_id) of every document, for similarity of ``percent`` or more."""
    small_batches(docs.sparkSession)
    docs = docs.select("doc_id", "text")
    table = prefixes(docs, sketch(docs), percent)
    each = table.where("token is null")
    tokens = table.where("token is not null").select("token", "doc", "n")
    copies = each.where("copy_of is not null and copy_of <> doc").select(F.col("copy_of").alias("u"), F.col("doc").alias("v"))
    shared = tokens.groupBy("token").agg(F.count("*").alias("m")).where("m > 1")
    regions = stored(tokens.join(shared, "token"))
    # Rows that repeat an id with other texts keep a bitmap each: their document links if one of its texts does.
    bits = stored(each.where("bits is not null").select(F.col("doc").alias("_d"), "bits", "few", "n").distinct())
    each, copies = stored(each.select("doc", "n")), stored(copies)
    release(docs.sparkSession, table)
    # The most central document of each region.
    central = regions.groupBy("doc").agg(F.sum("m").alias("centre")).withColumnRenamed("doc", "_d")
    ranked = regions.join(central, F.col("doc") == F.col("_d"))
    pivots = ranked.groupBy("token").agg(F.max(F.struct("centre", (-F.col("doc")).alias("minus"), F.col("n").alias("pn"))).alias("p"))
    pivots = pivots.select(F.col("token").alias("_t"), (-F.col("p.minus")).alias("pivot"), "p.pn")
    sizes = 100 * F.least("n", "pn") >= percent * F.greatest("n", "pn")
    star = regions.join(pivots, F.col("token") == F.col("_t")).where((F.col("doc") != F.col("pivot")) & sizes)
    star = stored(star.select(F.least("doc", "pivot").alias("u"), F.greatest("doc", "pivot").alias("v")).distinct())
    first = verify(plausible(star, bits, percent), docs, percent)
    labels = connected_components(first.union(copies)).withColumnsRenamed({"id": "_d", "component": "label"})
    # In a region of two the pivot has met the other; larger ones may hold pairs of other documents.
    labelled = regions.where("m > 2").join(labels, F.col("doc") == F.col("_d"), "left").select("token", "doc", "n", "m", F.coalesce("label", "doc").alias("component"))
    mixed = labelled.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select(F.col("token").alias("_t"))
    few = bits.select("_d", F.col("few").alias("bits"), F.col("n").alias("_n"))
    open_ = labelled.join(mixed, F.col("token") == F.col("_t")).join(few, (F.col("doc") == F.col("_d")) & (F.col("n") == F.col("_n")))
    open_ = open_.select(F.col("token").alias("region"), "doc", "n", "component", "bits", "m")
    rest = stored(candidates(open_, percent, cell).join(star, ["u", "v"], "left_anti"))
    release(docs.sparkSession, regions)
    rest = plausible(rest, bits, percent)
    links = first.union(copies)
    if not rest.isEmpty():
        links = links.union(verify(rest, docs, percent))
        labels = connected_components(links).withColumnsRenamed({"id": "_d", "component": "label"})
    release(docs.sparkSession, bits)
    out = each.join(labels, F.col("doc") == F.col("_d"), "left")
    return out.select(F.col("doc").alias("doc_id"), F.col("n").cast("long").alias("n_shingles"), F.coalesce("label", "doc").alias("component_id"))


def op7_jaccard(docs: DataFrame) -> DataFrame:
    return jaccard_join(docs)
