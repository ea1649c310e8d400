"""Exact top-k search by inner product over a pivot-distance index.

Vectors are lifted by one coordinate to one common norm R, so that the largest inner product is the smallest distance:
|q - x|^2 = |q|^2 + R^2 - 2 q.x. Pivots are spread out over a bounded sample of vectors (``sample``, the smallest hashes of the ids).
Each vector is keyed by its nearest pivot and its distance to it; the keys are sorted over all tasks by range, and each task cuts
its stretch into blocks, sorted annuli of the pivots. A *cell* is the part of one pivot's annuli that one task holds, so there are at
most as many cells as partitions and pivots together, whatever the number of vectors: the driver holds their bounds.

A query orders the cells by the least distance that its distances to their pivots allow, the cell of its own key first, and expands over them in rounds: the first
cell, those up to the sixth, the rest. After each round its k-th best score so far gives a smaller radius, and by the triangle inequality
only annuli within it can hold better vectors; a query is sent no further than they reach, to the cells, and in them to the blocks, that meet it.
Queries travel in batches of ``batch`` and are scored against blocks with one matrix product.

Of equal vectors only the k + 1 smallest ids, each on k rows at most, can be among anybody's k best, so the others aren't indexed: no loss, and a
very common vector doesn't grow a cell.

Defined results: vectors that are null or hold nulls or non-finite components, and rows without id, take no part; shorter vectors are
filled up with zeros; scores beyond a long count as the nearest long; a query doesn't find its own id; an id that stands on several rows is found once for each of them; ties go to the smaller id; an empty table has no results.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import stored


def scaled(embedding: Column, scale: int = 64) -> Column:
    """floor(scale * x) of each component, or null if the vector takes no part."""
    good = F.forall(embedding, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    return F.when(good, F.transform(embedding, lambda x: F.floor(x.cast("double") * scale).cast("long")))


def spread_out(sample: np.ndarray, n: int) -> np.ndarray:
    """Farthest-first choice of up to n distinct vectors."""
    chosen, far = [0], ((sample - sample[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(sample)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((sample - sample[chosen[-1]]) ** 2).sum(1))
    return sample[chosen]


class Geometry:
    """Lifted pivots and what follows from them."""

    def __init__(self, pivots: np.ndarray, norm2: float, exact: bool):
        self.dim, self.norm2, self.exact = pivots.shape[1], norm2, exact
        self.pivots = np.hstack([pivots, np.sqrt(np.maximum(norm2 - (pivots**2).sum(1), 0))[:, None]])

    def matrix(self, vectors: list) -> np.ndarray:
        out = np.zeros((len(vectors), self.dim), np.int64)
        for i, v in enumerate(vectors):
            out[i, : len(v)] = v
        return out

    def keys(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Nearest pivot of each vector and the distance to it."""
        d = self.distances(x, np.sqrt(np.maximum(self.norm2 - (x.astype(float) ** 2).sum(1), 0)))
        at = d.argmin(1)
        return at, d[np.arange(len(x)), at]

    def distances(self, x: np.ndarray, lift: np.ndarray) -> np.ndarray:
        y = np.hstack([x.astype(float), lift[:, None]])
        return np.sqrt(np.maximum((y**2).sum(1)[:, None] + (self.pivots**2).sum(1) - 2 * y @ self.pivots.T, 0))

    def scores(self, q: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Exact integer inner products: in doubles where all sums stay below 2^53, in Python's integers where they may pass a long; what doesn't fit one is its nearest."""
        if self.exact:
            return (q.astype(float) @ x.T.astype(float)).astype(np.int64)
        if self.norm2 < 2**62:  # no inner product is larger than that, and sums that wrap on their way come back
            return q @ x.T
        ends = np.iinfo(np.int64)
        return np.clip(q.astype(object) @ x.T.astype(object), ends.min, ends.max).astype(np.int64)

    def radius(self, q: np.ndarray, least: np.ndarray) -> np.ndarray:
        """Distance within which a vector must be to score ``least`` or more, rounded up."""
        d2 = (q.astype(float) ** 2).sum(1) + self.norm2 - 2 * least.astype(float)
        return np.sqrt(np.maximum(d2, 0)) * (1 + 1e-9) + 1e-6 * (1 + self.norm2**0.5)


_LEAST = np.iinfo(np.int64).min


def best(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, least: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, id and score of each row's k best (ties to smaller ids), none below ``least``; ``ids`` ascend."""
    ok = (ids[None, :] != own[:, None]) & (scores >= least[:, None])
    rows, found, got = [], [], []
    for i in np.flatnonzero(ok.any(1)):
        at = np.flatnonzero(ok[i])
        s = scores[i, at]
        if len(at) > k:
            edge = np.partition(s, len(s) - k)[len(s) - k]
            above, level = np.flatnonzero(s > edge), np.flatnonzero(s == edge)
            keep = np.concatenate([above, level[: k - len(above)]])
            at, s = at[keep], s[keep]
        rows.append(np.full(len(at), i))
        found.append(ids[at])
        got.append(s)
    if not rows:
        return np.zeros(0, int), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(rows), np.concatenate(found), np.concatenate(got)


def search(
    vectors: DataFrame,
    is_query: Column,
    k: int = 20,
    pivots: int = 64,
    sample: int = 4096,
    block: int = 2048,
    batch: int = 256,
    rounds: tuple[int, ...] = (1, 6),
) -> DataFrame:
    """(query_id, rank, vec_id, score) of the k best of every query among (vec_id, v) with v an array of longs."""
    spark = vectors.sparkSession
    rows = stored(vectors.where("v is not null and vec_id is not null"))
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(sample).collect()
    schema = "query_id long, rank int, vec_id long, score long"
    if not some:
        return spark.createDataFrame([], schema)
    most = rows.agg(F.max(F.size("v")), F.max(F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x.cast("double")))).first()
    dim, norm2 = max(int(most[0]), 1), float(most[1])
    first = np.zeros((len(some), dim))
    for i, r in enumerate(some):
        first[i, : len(r["v"])] = r["v"]
    geo = Geometry(spread_out(first, pivots), norm2, norm2 < 2**53)
    shared = spark.sparkContext.broadcast(geo)

    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = shared.value.matrix(b.column(1).to_pylist())
            at, r = shared.value.keys(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([v.tobytes() for v in x], pa.binary()), pa.array(at.astype(np.int32)), pa.array(r)], names=["vec_id", "x", "pivot", "r"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, held, names = TaskContext.get().partitionId(), [], ["cell", "pivot", "lo", "hi", "ids", "xs"]

        def close(part_rows: list) -> pa.RecordBatch:
            part_rows.sort()  # by id
            r = [x[3] for x in part_rows]
            values = [part * 100_000 + part_rows[0][2], part_rows[0][2], min(r), max(r), np.array([x[0] for x in part_rows], np.int64).tobytes(), b"".join(x[1] for x in part_rows)]
            types = [pa.int64(), pa.int32(), pa.float64(), pa.float64(), pa.binary(), pa.binary()]
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names=names)

        for b in batches:
            for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held and (held[0][2] != row[2] or len(held) >= block):
                    yield close(held)
                    held = []
                held.append(row)
        if held:
            yield close(held)

    copies = F.row_number().over(Window.partitionBy("v").orderBy("vec_id"))
    ids = rows.groupBy("vec_id", "v").agg(F.least(F.count("*"), F.lit(k)).cast("int").alias("n"))
    indexed = ids.withColumn("copy", copies).where(F.col("copy") <= k + 1).select("vec_id", "v", F.explode(F.array_repeat(F.lit(0), F.col("n")))).drop("col")
    keyed = "vec_id long, x binary, pivot int, r double"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ordered = indexed.mapInArrow(key, keyed).repartitionByRange(n, "pivot", "r", "vec_id").sortWithinPartitions("pivot", "r", "vec_id")
    blocks = stored(ordered.mapInArrow(cut, "cell long, pivot int, lo double, hi double, ids binary, xs binary"))
    bounds = blocks.groupBy("cell", "pivot").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi")).orderBy("cell").collect()
    cells = spark.sparkContext.broadcast({c: np.array([r[c] for r in bounds]) for c in ("cell", "pivot", "lo", "hi")})
    queries = rows.where(is_query).select("vec_id", "v").distinct().mapInArrow(key, keyed)
    queries = stored(queries.repartitionByRange(n, "pivot", "r", "vec_id").sortWithinPartitions("pivot", "r"))

    def visits(seen: int, upto: int | None):
        """Batches of queries for the cells that they search in a round: those from the ``seen``-th on in order of the least distance that their annuli allow, the cell
        of the query's own key first, as far as they meet its radius."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            g, c = shared.value, cells.value
            step = max(1, min(batch, 4_000_000 // len(c["cell"])))  # queries by cells: some arrays of that size at once
            for b in batches:
                for start in range(0, b.num_rows, step):
                    p = b.slice(start, step).to_pydict()
                    q = np.frombuffer(b"".join(p["x"]), np.int64).reshape(-1, g.dim)
                    ids, least = np.array(p["vec_id"], np.int64), np.array(p["least"], np.int64)
                    at = g.distances(q, np.zeros(len(q)))[:, c["pivot"]]
                    r, own = np.array(p["r"])[:, None], np.array(p["pivot"])[:, None] == c["pivot"]
                    apart = np.maximum(np.maximum(c["lo"] - at, at - c["hi"]), 0)
                    gap = np.where(own, np.maximum(np.maximum(c["lo"] - r, r - c["hi"]), 0), np.inf)
                    home = np.where(own.any(1), gap.argmin(1), apart.argmin(1))
                    apart[np.arange(len(q)), home] = -1
                    place = np.empty_like(apart, dtype=np.int64)
                    np.put_along_axis(place, apart.argsort(1, kind="stable"), np.arange(apart.shape[1])[None, :], 1)
                    rho = g.radius(q, least)[:, None]
                    go = (place >= seen) & (place < (upto or apart.shape[1])) & (at - rho <= c["hi"]) & (at + rho >= c["lo"])
                    out = [(int(c["cell"][j]), ids[m].tobytes(), q[m].tobytes(), least[m].tobytes()) for j in np.flatnonzero(go.any(0)) for m in [go[:, j]]]
                    yield pa.RecordBatch.from_arrays([pa.array([o[i] for o in out], t) for i, t in enumerate([pa.int64(), pa.binary(), pa.binary(), pa.binary()])], names=["at", "qids", "qs", "least"])

        return run

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        g = shared.value
        for b in batches:
            for p in (b.slice(i, 1).to_pydict() for i in range(b.num_rows)):
                q = np.frombuffer(p["qs"][0], np.int64).reshape(-1, g.dim)
                qids, least = np.frombuffer(p["qids"][0], np.int64), np.frombuffer(p["least"][0], np.int64)
                d, rho = g.distances(q, np.zeros(len(q)))[:, p["pivot"][0]], g.radius(q, least)
                near = (d - rho <= p["hi"][0]) & (d + rho >= p["lo"][0])
                if near.any():
                    q, qids, least = q[near], qids[near], least[near]
                    ids = np.frombuffer(p["ids"][0], np.int64)
                    rows_, found, got = best(g.scores(q, np.frombuffer(p["xs"][0], np.int64).reshape(-1, g.dim)), ids, qids, least, k)
                    yield pa.RecordBatch.from_arrays([pa.array(qids[rows_]), pa.array(found), pa.array(got)], names=["query_id", "vec_id", "score"])

    top = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))

    so_far, known = None, queries.withColumn("least", F.lit(int(_LEAST)).cast("long"))
    for seen, upto in zip((0, *rounds), (*rounds, None)):
        sent = known.mapInArrow(visits(seen, upto), "at long, qids binary, qs binary, least binary")
        pairs = blocks.join(sent, F.col("cell") == F.col("at")).select("pivot", "lo", "hi", "ids", "xs", "qids", "qs", "least")
        now = pairs.mapInArrow(score, schema.replace(" rank int,", "")).select("query_id", "vec_id", "score")
        now = (now.unionByName(so_far) if so_far is not None else now).withColumn("rank", top).where(F.col("rank") <= k)
        if upto is None:
            return now.select("query_id", "rank", "vec_id", "score")
        now = stored(now)
        so_far = now.select("query_id", "vec_id", "score")
        kth = now.where(F.col("rank") == k).select(F.col("query_id").alias("_q"), F.col("score").alias("least"))
        known = queries.join(kth, F.col("vec_id") == F.col("_q"), "left").drop("_q")
        known = known.withColumn("least", F.coalesce("least", F.lit(int(_LEAST)).cast("long"))).repartitionByRange(n, "pivot", "r", "vec_id")
    raise AssertionError("the last round has no end")


def op1_topk(embeddings: DataFrame, k: int = 20, every: int = 20) -> DataFrame:
    """The k best of every vector whose id is divisible by ``every``, among all others."""
    return search(embeddings.select("vec_id", scaled(F.col("embedding")).alias("v")), F.col("vec_id") % every == 0, k)
