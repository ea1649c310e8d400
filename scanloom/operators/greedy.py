"""Greedy selection in a given order, by rounds of blocks.

The sequential rule: rows are gone through in order; a row that is still free becomes a seed and takes free rows near it. What a row gets depends on rows before it, and
those on others, but all effects pass through rows within reach. So the plane is cut into blocks with a halo, and each block is gone through by itself, in
order, with a third state besides free and taken: rows that something outside the block *may* have taken. A seed is settled when nothing that it looks at is in doubt;
else it and all within its reach are in doubt. Settled groups are those of the sequential rule, whatever the rest turns out to be, as a
seed's group no longer depends on rows in doubt. They leave, and the next round cuts the rest along other lines. The first row of all is never in doubt
in the block that owns it, so every round settles something; in practice nearly all rows go in the first, and two or three rounds do.

A block is sent to one task: its rows are ``rows_per_block`` on average, and the halo's. Rows that lie within reach of each other by the million are a sequential problem by
definition, and one task's; a band that is dense along one axis only is cut along the other one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored

_HALO = 4  # in reaches; more than two are needed
#: Rows of a block that is as high as the plane, its halo not counted: about 60 bytes each, and as much again for each order of them.
MOST_ROWS = 2_000_000


class Nearby:
    """Rows of a block by cells of one reach."""

    def __init__(self, x: np.ndarray, y: np.ndarray, reach_x: float, reach_y: float):
        self.cx, self.cy = np.floor(x / reach_x).astype(np.int64), np.floor(y / reach_y).astype(np.int64)
        order = np.lexsort((self.cy, self.cx))
        self.cells: dict[tuple[int, int], np.ndarray] = {}
        keys = np.stack([self.cx[order], self.cy[order]], axis=1)
        cuts = np.flatnonzero((np.diff(keys, axis=0) != 0).any(axis=1)) + 1
        for part in np.split(order, cuts) if len(order) else []:
            self.cells[int(self.cx[part[0]]), int(self.cy[part[0]])] = np.sort(part)

    def around(self, v: int) -> np.ndarray:
        a, b = int(self.cx[v]), int(self.cy[v])
        some = [c for i in (-1, 0, 1) for j in (-1, 0, 1) if (c := self.cells.get((a + i, b + j))) is not None]
        return np.concatenate(some)


class Stretches:
    """Rows of a block by sample and strip of y, each stretch in order of x, then of the block; those that leave are passed over, and dropped once they are many."""

    def __init__(self, keys: np.ndarray, rows: np.ndarray, width: int, stretches: int, size: int):
        self.keys, self.rows, self.width, self.edges = keys, rows, width, np.arange(stretches + 1) * width
        self.here = np.zeros(size, bool)
        self.here[rows] = True
        self.gone = 0
        self.starts = np.searchsorted(keys, self.edges)

    def leave(self, rows: np.ndarray) -> None:
        self.gone += int(np.count_nonzero(self.here[rows]))
        self.here[rows] = False
        if self.gone > 0.3 * len(self.rows):
            kept = self.here[self.rows]
            self.keys, self.rows, self.gone = self.keys[kept], self.rows[kept], 0
            self.starts = np.searchsorted(self.keys, self.edges)

    def enter(self, keys: np.ndarray, rows: np.ndarray) -> None:
        order = np.lexsort((rows, keys))
        at = np.searchsorted(self.keys, keys[order])
        self.keys, self.rows = np.insert(self.keys, at, keys[order]), np.insert(self.rows, at, rows[order])
        self.here[rows] = True
        self.starts = np.searchsorted(self.keys, self.edges)


class NearestOfEachSample:
    """A seed takes, of each other sample, the free row nearest by mass, then apex, then intensity, then order; all strictly within the tolerances.

    What a row takes, or casts doubt on, are at most the nearest rows of each sample that are surely free. So many rows in order look for these at once, by arrays, as if none of them came before
    another, and all hold up to the first one that shares a row with one before it. Rows surely free and rows in doubt are kept apart, and looked through from the nearest mass
    outwards; those taken are dropped, so late rows don't look at more than early ones.
    """

    keeps_seeds = False
    #: Pairs that are looked at together, and the most rows that look for theirs at once.
    pairs_at_once = 1 << 18
    most_at_once = 1024

    def __init__(self, eps: Sequence[float], columns: dict[str, np.ndarray], doubt: np.ndarray | None = None):
        self.eps, self.c = eps, columns
        x, self.strip = columns["x"], np.floor(columns["y"] / eps[1])
        places, self.place = np.unique(x, return_inverse=True)
        self.strips, strip = np.unique(self.strip, return_inverse=True)
        samples, self.sample = np.unique(columns["sample"], return_inverse=True)
        self.samples, self.width = len(samples), len(places) + 1
        self.named, self.stretch = np.unique(self.sample * len(self.strips) + strip, return_inverse=True)
        self.keys = self.stretch * self.width + self.place

    def _stretches(self, some: np.ndarray) -> Stretches:
        rows = np.flatnonzero(some)
        rows = rows[np.argsort(self.keys[rows], kind="stable")]
        return Stretches(self.keys[rows], rows, self.width, len(self.named), len(some))

    def _beside(self, v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(place in v, sample, stretch) of the stretches of other samples that reach into a row's reach."""
        out = []
        for side in (-1, 0, 1):
            at = np.minimum(np.searchsorted(self.strips, self.strip[v] + side), len(self.strips) - 1)
            q = np.flatnonzero(self.strips[at] == self.strip[v] + side)
            name = np.arange(self.samples)[None, :] * len(self.strips) + at[q][:, None]
            stretch = np.minimum(np.searchsorted(self.named, name), len(self.named) - 1)
            i, s = np.nonzero((self.named[stretch] == name) & (np.arange(self.samples)[None, :] != self.sample[v[q]][:, None]))
            out.append((q[i], s, stretch[i, s]))
        return tuple(np.concatenate(o) for o in zip(*out, strict=True))

    def _walk(self, among: Stretches, v: np.ndarray, beside: tuple, best: np.ndarray, seen: Callable) -> None:
        """``seen`` gets all that is in reach of rows ``v``, from the nearest mass outwards, as long as it isn't farther in mass than ``best`` of the row and sample."""
        c, (ex, ey, ez) = self.c, self.eps
        q, s, stretch = beside
        at = np.searchsorted(among.keys, stretch * self.width + self.place[v[q]])
        q, key, side = np.tile(q, 2), np.tile(q * self.samples + s, 2), np.repeat((1, -1), len(q))
        end = np.concatenate([among.starts[stretch + 1], among.starts[stretch] - 1])
        at, n = np.concatenate([at, at - 1]), 4
        while True:
            on = np.flatnonzero(at * side < end * side)
            dx = np.abs(c["x"][among.rows[at[on]]] - c["x"][v[q[on]]])
            on = on[(dx < ex) & (dx <= best[key[on]])]
            if not len(on):
                return
            q, key, side, end, at = q[on], key[on], side[on], end[on], at[on]
            step = max(1, self.pairs_at_once // n)
            for k in range(0, len(at), step):
                way = side[k : k + step, None]
                p = at[k : k + step, None] + way * np.arange(n)
                w, j = np.nonzero(p * way < end[k : k + step, None] * way)
                r, w = among.rows[p[w, j]], w + k
                for axis, e in (("z", ez), ("y", ey), ("x", ex)):
                    ok = np.abs(c[axis][r] - c[axis][v[q[w]]]) < e
                    if axis == "z":
                        ok &= among.here[r]
                    r, w = r[ok], w[ok]
                if len(r):
                    d = [np.abs(c[axis][r] - c[axis][v[q[w]]]) for axis in "xyz"]
                    seen(key[w], [*d, r])
            at, n = at + side * n, min(4 * n, 4096)

    def _nearest(self, free: Stretches, v: np.ndarray, beside: tuple) -> list[np.ndarray]:
        """Distances and row of the nearest surely free one, for each of ``v`` and each sample; infinite, and none, without one."""
        best = [np.full(len(v) * self.samples, np.inf) for _ in "xyzr"]

        def seen(key: np.ndarray, values: list[np.ndarray]) -> None:
            for i, b in enumerate(best):
                before = b[key]
                np.minimum.at(b, key, values[i])
                now = b[key]
                for deeper in best[i + 1 :]:
                    deeper[key[now < before]] = np.inf
                same = values[i] == now
                key, values = key[same], [w[same] for w in values]

        self._walk(free, v, beside, best[0], seen)
        return best

    def _unsure(self, doubtful: Stretches, v: np.ndarray, beside: tuple, best: list[np.ndarray]) -> np.ndarray:
        """Whether a row in doubt is nearer than the nearest surely free one, for any sample."""
        found, bound = np.zeros(len(v), bool), best[0].copy()

        def seen(key: np.ndarray, values: list[np.ndarray]) -> None:
            less = np.zeros(len(key), bool)
            same = np.ones(len(key), bool)
            for b, w in zip(best, values, strict=True):
                less |= same & (w < b[key])
                same &= w == b[key]
            q = np.unique(key[less] // self.samples)
            found[q] = True
            bound.reshape(len(v), -1)[q] = -1.0  # one is enough

        self._walk(doubtful, v, beside, bound, seen)
        return found

    def settle(self, doubt: np.ndarray) -> list[tuple[int, np.ndarray, bool]]:
        """What ``settle_block`` gives; ``doubt`` is kept up to date."""
        n, out = len(doubt), []
        taken, first = np.zeros(n, bool), np.full(n, n)
        free, doubtful = self._stretches(~doubt), self._stretches(doubt)
        most = max(8, self.most_at_once // max(1, self.samples // 4))
        at, many = 0, 32
        while at < n:
            v = at + np.flatnonzero(~taken[at : at + 8 * many])[:many]
            if not len(v):
                at += 8 * many
                continue
            beside = self._beside(v)
            best = self._nearest(free, v, beside)
            sure = np.flatnonzero(~doubt[v])
            mine = ~doubt[v[beside[0]]]
            unsure = np.zeros(len(v), bool)
            if len(doubtful.rows) and len(sure):
                unsure = self._unsure(doubtful, v, tuple(b[mine] for b in beside), best)
            takes = ~doubt[v] & ~unsure
            who, s = np.nonzero(np.isfinite(best[3].reshape(len(v), -1)))
            picked = best[3].reshape(len(v), -1)[who, s].astype(np.int64)
            # Up to the first that shares a row with one before it; one that was taken by a sure one is just gone.
            there, end = np.ones(len(v), bool), len(v)
            while True:
                live = there[who]
                rows, by = np.concatenate([v[there], picked[live]]), np.concatenate([np.flatnonzero(there), who[live]])
                order = np.argsort(by, kind="stable")[::-1]
                first[rows[order]] = by[order]  # the first one is written last
                clash = by[first[rows] < by]
                end = int(clash.min()) if len(clash) else len(v)
                gone = end < len(v) and first[v[end]] < end and takes[first[v[end]]]
                first[rows] = n
                if not gone:
                    break
                there[end] = False
            there[end:] = False
            live = there[who]
            who, picked = who[live], picked[live]
            chosen = takes[who]
            taken[v[there & takes]] = True
            taken[picked[chosen]] = True
            cuts = np.searchsorted(who, np.arange(end + 1))
            out += [(int(v[i]), picked[cuts[i] : cuts[i + 1]], True) for i in np.flatnonzero(there & takes).tolist()]
            new = np.concatenate([v[there & unsure], picked[~chosen]])
            doubt[new] = True
            free.leave(np.concatenate([v[there], picked]))
            if len(new):
                doubtful.enter(self.keys[new], new)
            at = int(v[end]) if end < len(v) else int(v[-1]) + 1
            many = min(most, max(8, (10 * many + 13 * end) // 20 if end < len(v) else 2 * many))
        return out


class Hill:
    """A seed takes the free points within ``width`` of its place, scan by scan in both directions, as long as at most ``gap`` - 1 scans in a row have none."""

    keeps_seeds = False

    def __init__(self, width: float, gap: int, columns: dict[str, np.ndarray], doubt: np.ndarray | None = None):
        self.width, self.gap, self.c = width, gap, columns
        x = columns["x"]
        self.order = np.argsort(x, kind="stable")
        self.x = x[self.order]
        self.ends = np.searchsorted(self.x, x - width, "left"), np.searchsorted(self.x, x + width, "right")
        self.after = list(range(1, len(x) + 1))  # places by x: all up to there are taken or in doubt

    def quiet(self, v: int, taken: np.ndarray, doubt: np.ndarray) -> bool:
        """Whether all within ``width`` of ``v`` are taken or in doubt by now. What was found so is skipped from then on, so a block's rows are looked at about once."""
        first, end = int(self.ends[0][v]), int(self.ends[1][v])
        at, after, passed = first, self.after, []
        while at < end and (taken[r := self.order[at]] or doubt[r]):
            passed.append(at)
            at = after[at]
        for p in passed:
            after[p] = at
        return at >= end

    def reach(self, v: int, taken: np.ndarray) -> np.ndarray:
        c = self.c
        n = self.order[self.ends[0][v] : self.ends[1][v]]
        n = n[~taken[n] & (np.abs(c["x"][n] - c["x"][v]) <= self.width)]
        scans = c["idx"][n]
        by = np.argsort(scans, kind="stable")
        n, scans = n[by], scans[by]
        cuts = np.flatnonzero(np.diff(scans) > self.gap)
        at = np.searchsorted(scans, c["idx"][v])
        start, end = np.r_[0, cuts + 1], np.r_[cuts + 1, len(n)]
        k = np.searchsorted(start, at, "right") - 1
        run = n[start[k] : end[k]]
        return run[run != v]

    def pick(self, v: int, near: np.ndarray, doubt: np.ndarray) -> tuple[np.ndarray, bool]:
        return near, not doubt[near].any()  # a point in doubt can join two stretches


class Ladder:
    """A seed takes the free rows on the longest ladder of steps ``spacing`` / charge through its place: at each step up, then down, the row nearest to it within
    ``width`` and within ``reach_y`` of the seed's time, until a step has none or ``most`` are taken. Of charges with ladders of one length the one with the
    larger sum of intensities wins, then the smaller one.
    """

    keeps_seeds = False

    def __init__(self, spacing: float, charges: int, width: float, reach_y: float, most: int, columns: dict[str, np.ndarray], doubt: np.ndarray | None = None):
        self.spacing, self.charges, self.width, self.reach_y, self.most, self.c = spacing, charges, width, reach_y, most, columns
        self.order = np.argsort(columns["x"], kind="stable")
        self.x = columns["x"][self.order]
        self.found: list[np.ndarray] = []

    def _at(self, place: float, v: int, taken: np.ndarray) -> np.ndarray:
        c = self.c
        lo, hi = np.searchsorted(self.x, place - self.width, "left"), np.searchsorted(self.x, place + self.width, "right")
        n = self.order[lo:hi]
        return n[~taken[n] & (n != v) & (np.abs(c["y"][n] - c["y"][v]) <= self.reach_y)]

    def reach(self, v: int, taken: np.ndarray) -> np.ndarray:
        """All rows that any charge looks at; ``found`` keeps the rows of each step of each charge."""
        x0, self.found, seen = self.c["x"][v], [], []
        for z in range(1, self.charges + 1):
            steps = []
            for sign in (1, -1):
                for k in range(1, self.most + 1):
                    place = x0 + sign * k * self.spacing / z
                    n = self._at(place, v, taken)
                    if not len(n):
                        break
                    c = self.c
                    best = n[np.lexsort((n, np.abs(c["y"][n] - c["y"][v]), np.abs(c["x"][n] - place)))[0]]
                    steps.append(best)
                    seen.append(n)
            self.found.append(np.array(steps, np.int64))
        return np.unique(np.concatenate(seen)) if seen else np.zeros(0, np.int64)

    def pick(self, v: int, near: np.ndarray, doubt: np.ndarray) -> tuple[np.ndarray, bool]:
        if doubt[near].any():
            return near, False
        totals = [(-len(f), -self.c["intensity"][f].sum(), z) for z, f in enumerate(self.found)]
        return self.found[min(totals)[2]], True


class AllWithin:
    """A seed takes all free rows within ``ppm`` of its mass and ``reach_y`` of its time."""

    keeps_seeds = True

    def __init__(self, ppm: float, reach_y: float, columns: dict[str, np.ndarray], doubt: np.ndarray | None = None):
        self.ppm, self.reach_y, self.c = ppm, reach_y, columns
        self.near = Nearby(columns["x"], columns["y"], 1.0, reach_y)

    def reach(self, v: int, taken: np.ndarray) -> np.ndarray:
        c = self.c
        n = self.near.around(v)
        n = n[n != v]
        return n[(np.abs(c["z"][n] - c["z"][v]) <= c["z"][v] * self.ppm / 1e6) & (np.abs(c["y"][n] - c["y"][v]) <= self.reach_y)]

    def pick(self, v: int, near: np.ndarray, doubt: np.ndarray) -> tuple[np.ndarray, bool]:
        return near[~doubt[near]], not doubt[near].any()


def settle_block(rule, doubt: np.ndarray, seeds: np.ndarray) -> list[tuple[int, np.ndarray, bool]]:
    """(seed, rows taken, whether the seed is done) in order. ``seeds``: rows known as seeds from an earlier round, with rows left in doubt."""
    if hasattr(rule, "settle"):
        return rule.settle(doubt)  # a rule that goes through many rows at once
    taken, out = np.zeros(len(doubt), bool), []
    maybe, quiet = getattr(rule, "maybe", lambda v, near, doubt: near), getattr(rule, "quiet", None)
    for v in range(len(doubt)):
        if taken[v] or doubt[v] and quiet is not None and not seeds[v] and quiet(v, taken, doubt):
            continue
        near = rule.reach(v, taken)
        near = near[~taken[near] & ~seeds[near]]
        if rule.keeps_seeds:
            near = near[near > v]  # rows before it are seeds by now, or in doubt
        if doubt[v] and not seeds[v]:
            doubt[maybe(v, near, doubt)] = True
            continue
        chosen, sure = rule.pick(v, near, doubt)
        if sure or rule.keeps_seeds:
            taken[chosen] = True
            taken[v] = True
            out.append((v, chosen, sure))
        else:
            doubt[v] = True
            doubt[maybe(v, near, doubt)] = True
    return out


def greedy(rows: DataFrame, order: Sequence[str], reach_x: float, reach_y: float, rule: Callable[[dict[str, np.ndarray], np.ndarray], object], rows_per_block: int = 20_000, rounds: int = 200, along_x: bool = False) -> DataFrame:
    """(id, seed) of every row of (id, x, y, ...), all numbers; ``order`` ends in the id, so that it is total. ``rule`` makes a rule of a block's columns, in order,
    and of what is in doubt.

    ``along_x``: the rule takes the nearest by x, so doubt goes far along y and little along x; blocks are then as high as the plane, as long as they hold ``MOST_ROWS`` at most.

    Rows of different ``part``, if there is such a column, never meet.
    """
    rows = rows if "part" in rows.columns else rows.withColumn("part", F.lit(0))
    names = rows.columns
    free = stored(rows.withColumn("seed", F.lit(False)))
    kind = rows.schema["id"].dataType.simpleString()
    parts: list[DataFrame] = []
    for k in range(rounds):
        middle = F.percentile_approx("x", [0.01, 0.99], 1000).alias("middle")
        size = free.agg(F.count("*").alias("n"), F.min("x").alias("x0"), F.max("x").alias("x1"), middle, F.min("y").alias("y0"), F.max("y").alias("y1"), F.approx_count_distinct("part").alias("parts")).first()
        if not size["n"]:
            break
        n = size["n"] / max(size["parts"], 1)
        # Blocks of about equal numbers of reaches in both directions, 12 at least.
        # The middle 98 % along x: a few far values don't make blocks so wide that one holds all the rest.
        spans = [max(d / r, 1.0) for d, r in ((size["middle"][1] - size["middle"][0], reach_x), (size["y1"] - size["y0"], reach_y))]
        side = max((spans[0] * spans[1] * rows_per_block / n) ** 0.5, 12.0)
        wide, high = side * reach_x, max(side, spans[0] * spans[1] * rows_per_block / n / min(side, spans[0])) * reach_y
        if spans[1] * reach_y <= high:
            wide = max(12.0, spans[0] * rows_per_block / n) * reach_x
        if along_x and max(12.0 * n / spans[0], rows_per_block) <= MOST_ROWS:
            wide, high = max(12.0, spans[0] * rows_per_block / n) * reach_x, (spans[1] + 2 * _HALO + 2) * reach_y
        at = (size["x0"] - wide * (0.37 * k % 1), size["y0"] - high * (0.61 * k % 1))
        if high > (spans[1] + 2 * _HALO) * reach_y:
            at = (at[0], size["y0"] - (_HALO + 1) * reach_y)  # one row of blocks, with no border in reach
        cut = [(F.col(c) - F.lit(a)) / F.lit(w) for c, a, w in (("x", at[0], wide), ("y", at[1], high))]
        halo = (_HALO * reach_x / wide, _HALO * reach_y / high)
        near = lambda c, h: F.sequence(F.floor(c - h).cast("long"), F.floor(c + h).cast("long"))
        sent = free.withColumn("bx", F.explode(near(cut[0], halo[0]))).withColumn("by", F.explode(near(cut[1], halo[1])))

        def work(batches: Iterator[pa.RecordBatch], at=at, wide=wide, high=high) -> Iterator[pa.RecordBatch]:
            held: list[pa.RecordBatch] = []
            block = None

            def solved() -> pa.RecordBatch:
                table = pa.Table.from_batches(held).combine_chunks()
                c = {n: table.column(n).to_numpy() for n in names}
                left, low = at[0] + block[0] * wide, at[1] + block[1] * high
                inside = (np.floor((c["x"] - at[0]) / wide) == block[0]) & (np.floor((c["y"] - at[1]) / high) == block[1])
                edge = (_HALO - 1.01) * reach_x, (_HALO - 1.01) * reach_y
                doubt = (c["x"] < left - edge[0]) | (c["x"] > left + wide + edge[0]) | (c["y"] < low - edge[1]) | (c["y"] > low + high + edge[1])
                found = settle_block(rule(c, doubt), doubt, table.column("seed").to_numpy(zero_copy_only=False).astype(bool))
                mine = [f for f in found if inside[f[0]]]
                firsts = np.array([v for v, _, _ in mine], np.int64)
                sizes = np.array([1 + len(chosen) for _, chosen, _ in mine], np.int64)
                rows, done = np.zeros(sizes.sum(), np.int64), np.ones(sizes.sum(), bool)
                heads = np.zeros(len(rows), bool)
                heads[np.cumsum(sizes) - sizes] = True
                rows[heads], done[heads] = firsts, [sure for _, _, sure in mine]
                rows[~heads] = np.concatenate([chosen for _, chosen, _ in mine]) if mine else []
                t = table.schema.field("id").type
                arrays = [pa.array(c["id"][rows], t), pa.array(np.repeat(c["id"][firsts], sizes), t), pa.array(done, pa.bool_())]
                return pa.RecordBatch.from_arrays(arrays, names=["id", "seed", "done"])

            for batch in batches:
                keys = [batch.column(k).to_numpy(zero_copy_only=False) for k in ("bx", "by", "part")]
                cuts = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
                for start, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(batch)]) if len(batch) else []:
                    key = tuple(k[start] for k in keys)
                    if block is not None and key != block:
                        yield solved()
                        held.clear()
                    block = key
                    held.append(batch.slice(start, end - start))
            if held:
                yield solved()

        # Blocks are dealt to tasks in turn: by hash some tasks would get several of a few large ones, and others none.
        across, along = (int(span * reach / w) + 3 for span, reach, w in ((spans[0], reach_x, wide), (spans[1], reach_y, high)))
        tasks = max(1, min(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), across * along * size["parts"], -(-size["n"] // 2000)))
        turn = F.pmod(F.xxhash64("part"), F.lit(tasks)) + F.pmod(F.col("bx"), F.lit(tasks)) + F.pmod(F.col("by") * across, F.lit(tasks))
        dealt = sent.repartitionById(tasks, turn.cast("int")).sortWithinPartitions("part", "bx", "by", *order)
        settled = stored(dealt.mapInArrow(work, f"id {kind}, seed {kind}, done boolean"))
        parts.append(settled.select("id", "seed"))
        known = settled.groupBy("id").agg(F.max("done").alias("done"))
        left = free.join(known, "id", "left").where("done is null or not done")
        free = stored(left.withColumn("seed", F.col("seed") | F.col("done").isNotNull()).drop("done"))
    else:
        raise RuntimeError("greedy groups did not settle")
    if not parts:
        return free.select("id", F.col("id").alias("seed"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.distinct()  # a seed with rows in doubt is reported in every round


def ranked(rows: DataFrame, order: Sequence[str], name: str) -> DataFrame:
    """``rows`` with their place in the whole order, from 1; no task holds more than its range."""
    parted = stored(rows.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))
    sizes = parted.groupBy("_part").agg(F.count("*").alias("_n"))  # as many rows as partitions
    before = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    place = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    return parted.withColumn("_place", place).join(F.broadcast(before.drop("_n")), "_part").withColumn(name, F.col("_before") + F.col("_place")).drop("_part", "_place", "_before")
