"""Mixing sources to target weights by Sainte-Lague apportionment.

1. Each source's target is its share of all words by weight, stopped at ``cap`` times its size; what is above goes
   to the others by weight until none is above (water filling, in closed form over the sources in the order
   in which they reach their cap).
2. Blocks of ``block_words`` words are the seats. They are dealt to sources by the highest quotients target / (2 s + 1),
   then each source's seats to its shards by the highest quotients words / (2 s + 1): integer quotas that add up.
3. In a shard the documents stand in a seeded order, and their words form one line that is cut into n blocks. A quota of q blocks takes every block
   q // n times, and once more those blocks b for which (a b + c) mod n < k, with a seeded c and a seeded a prime to n: a seeded permutation of the blocks, of
   which each task can tell by itself whether it holds one. A shard's last block may be short; k counts words, and the last block chosen gives a part.

Only (id, source, size) rows are shuffled, never texts, and a source is spread over as many shards as its words ask
for, so no task holds a hot source. The driver sees one row a source and one a shard.

Defined results: null and empty texts have size 0 and are taken 0 times; a null source is a source of its own, after
all others; repeated ids are mixed as separate documents; an empty table gives an empty mix.
"""

from __future__ import annotations

import heapq
import math
import random
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .words import WORD, stored, word_count

#: Weights of the sources by code point of their names, repeating.
WEIGHTS = (1, 2, 3)
#: What tells a shard's chosen blocks: n blocks, of which those with (a b + c) mod n below k are chosen whole, and of the one at k its first ``rest`` words.
PLAN = ("n", "a", "c", "k", "rest")


def sainte_lague(votes: Sequence[float], seats: int) -> list[int]:
    """Seats by highest quotients votes / (2 s + 1); ties go to the earlier one.

    Starts from the rounded quotas, which differ from the result by few seats, and gives or takes single seats.
    """
    total = sum(votes)
    if seats <= 0 or total <= 0:
        return [0] * len(votes)
    got = [int(v * seats / total + 0.5) for v in votes]
    open_ = seats - sum(got)
    if open_ > 0:
        heap = [(-v / (2 * s + 1), i) for i, (v, s) in enumerate(zip(votes, got, strict=True)) if v > 0]
        heapq.heapify(heap)
        for _ in range(open_):
            i = heap[0][1]
            got[i] += 1
            heapq.heapreplace(heap, (-votes[i] / (2 * got[i] + 1), i))
    elif open_ < 0:
        heap = [(v / (2 * s - 1), -i) for i, (v, s) in enumerate(zip(votes, got, strict=True)) if s > 0]
        heapq.heapify(heap)
        for _ in range(-open_):
            i = -heapq.heappop(heap)[1]
            got[i] -= 1
            if got[i]:
                heapq.heappush(heap, (votes[i] / (2 * got[i] - 1), -i))
    return got


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, cap: float = 3) -> DataFrame:
    """(source, source_size, weight, target) from (source, size); one row a source goes through the windows."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), ((F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights) + 1).cast("int"))
    by = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by = by.withColumn("weight", w).withColumn("most", cap * F.col("source_size"))
    reach = Window.orderBy(F.col("most") / F.col("weight"), F.col("source").asc_nulls_last())
    before, after = reach.rowsBetween(Window.unboundedPreceding, -1), reach.rowsBetween(0, Window.unboundedFollowing)
    total = F.sum("source_size").over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    left = total - F.coalesce(F.sum("most").over(before), F.lit(0.0))
    by = by.withColumn("level", left / F.sum("weight").over(after))
    # Those up to the first source whose cap is above the level stand at their caps; the level there holds for the rest.
    free = F.min(F.when(F.col("most") > F.col("weight") * F.col("level"), F.struct(F.col("most") / F.col("weight"), F.col("level")))).over(Window.orderBy(F.lit(0)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    level = free["level"]
    return by.select("source", "source_size", "weight", F.least(F.col("most").cast("double"), F.coalesce(F.col("weight") * level, F.col("most").cast("double"))).alias("target"))


def words_once_more(block: Column, block_words: int, prefix: str = "") -> Column:
    """How many words, from its first on, a block of the line gives once more: all if it is chosen, ``rest`` if it is the last one chosen, else none."""
    n, a, c, k, rest = (F.col(f"{prefix}{x}") for x in PLAN)
    rank = F.pmod(block * a + c, n)
    return F.when(rank < k, F.lit(block_words)).when(rank == k, rest).otherwise(F.lit(0))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    weights: Sequence[float] = WEIGHTS,
    cap: int = 3,
    block_words: int = 32,
    shard_words: int = 2_000_000,
    seed: int = 17,
    row_col: str | None = None,
) -> DataFrame:
    """(id_col, size, source, source_size, target, taken, start, extra, *PLAN) of every document.

    ``taken`` words: the whole document ``(taken - extra) / size`` times and, ``extra`` in number, its words that the blocks of the line give once more (``words_once_more``), on which its first word has the place ``start``. ``row_col``: an identity of the rows, carried into the result.
    """
    spark = docs.sparkSession
    rows = stored(docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), word_count(F.col(text_col)).alias("size"), *([F.col(row_col).alias("again")] if row_col else [])))
    targets = source_targets(rows, weights, cap).withColumn("shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    # One row a source, then one a shard: small lists by construction (a shard has about shard_words words).
    by_source = sorted(targets.collect(), key=lambda r: (r["source"] is None, r["source"] or ""))
    sources = spark.createDataFrame(by_source, targets.schema)
    place = F.xxhash64(F.lit(seed), F.col("id").cast("string"), F.col("source"), F.col("size"))
    dealt = (
        (rows if row_col else rows.withColumn("again", F.monotonically_increasing_id()))
        .withColumnRenamed("source", "_s")
        .join(sources, F.col("_s").eqNullSafe(F.col("source")))
        .drop("_s")
        .withColumn("place", place)
        .withColumn("shard", F.pmod(F.xxhash64(F.lit(seed + 1), "place"), F.col("shards")))
    )
    shards = dealt.groupBy("source", "shard").agg(F.sum("size").alias("words"))
    of: dict = {}
    for r in shards.collect():
        of.setdefault(r["source"], []).append((r["shard"], r["words"]))
    total = sum(r["source_size"] for r in by_source)
    quotas = []
    for r, seats in zip(by_source, sainte_lague([r["target"] for r in by_source], round(total / block_words)), strict=True):
        parts = sorted(of.get(r["source"], []))
        for (shard, words), q in zip(parts, sainte_lague([w for _, w in parts], seats), strict=True):
            # The cap also holds in blocks; a part of a block at a shard's end counts by its words.
            rounds, more = divmod(min(q * block_words, cap * words), words) if words else (0, 0)
            n = max(1, -(-words // block_words))
            rng = random.Random(f"{seed}/{r['source']}/{shard}")
            step = next(x for x in iter(lambda: rng.randrange(1, n + 1), 0) if math.gcd(x, n) == 1)
            shift = rng.randrange(n)
            lacks, last = n * block_words - words, ((n - 1) * step + shift) % n
            given = lambda k: k * block_words - lacks * (last < k)  # noqa: B023, E731
            k = more // block_words
            k += given(k + 1) <= more
            quotas.append((r["source"], shard, rounds, n, step, shift, k, more - given(k)))
    plan = spark.createDataFrame(quotas, "source string, shard long, rounds long, n long, a long, c long, k long, rest long")
    line = Window.partitionBy("source", "shard").orderBy("place", "id", "again").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    at = dealt.withColumn("end", F.sum("size").over(line)).withColumn("start", F.col("end") - F.col("size"))
    at = at.join(
        plan.withColumnsRenamed({"source": "_s", "shard": "_k"}), F.col("_s").eqNullSafe(F.col("source")) & (F.col("shard") == F.col("_k"))
    )
    blocks = F.when(F.col("size") > 0, F.sequence(F.floor(F.col("start") / block_words), F.floor((F.col("end") - 1) / block_words))).otherwise(F.array().cast("array<bigint>"))
    given = lambda b: F.least(F.col("end"), b * block_words + words_once_more(b, block_words)) - F.greatest(F.col("start"), b * block_words)
    at = at.withColumn("extra", F.aggregate(blocks, F.lit(0).cast("long"), lambda x, b: x + F.greatest(F.lit(0), given(b))))
    return at.select(
        F.col("id").alias(id_col),
        "size",
        F.col("source").alias(source_col),
        F.col("source_size").cast("long").alias("source_size"),
        "target",
        (F.col("rounds") * F.col("size") + F.col("extra")).cast("long").alias("taken"),
        *("start", "extra", *PLAN),
        *([F.col("again").alias(row_col)] if row_col else []),
    )


def op6_mixing(docs: DataFrame) -> DataFrame:
    return mix(docs).select("doc_id", "size", "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, block_words: int = 32, **how) -> DataFrame:
    """The mix itself, in the columns of ``docs``: each document as often as it is taken whole, and once more cut to its words in the chosen
    blocks. Rows are numbered, written once with their numbers and joined to the plan by them, so ids may be null or repeat."""
    names = docs.columns
    rows = stored(docs.withColumn("__mix_row", F.monotonically_increasing_id()))
    needed = ("size", "taken", "start", "extra", *PLAN)
    plan = mix(rows, row_col="__mix_row", block_words=block_words, **how).where("taken > 0").select(F.col("__mix_row").alias("__mix_of"), *[F.col(c).alias(f"__mix_{c}") for c in needed])
    size, taken, start, extra = (F.col(f"__mix_{c}") for c in needed[:4])
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(WORD), F.lit(0))
    whole = ((taken - extra) / size).cast("int")
    none = F.array().cast("array<boolean>")
    pieces = F.concat(F.when(whole > 0, F.array_repeat(F.lit(False), whole)).otherwise(none), F.when(extra > 0, F.array(F.lit(True))).otherwise(none))
    out = rows.join(plan, F.col("__mix_row") == F.col("__mix_of")).withColumn("__mix_cut", F.explode(pieces))
    given = lambda i: F.pmod(start + i, F.lit(block_words)) < words_once_more(F.floor((start + i) / block_words), block_words, "__mix_")
    cut = F.array_join(F.filter(words, lambda _, i: given(i)), " ")
    out = out.withColumn("text", F.when(F.col("__mix_cut") & (extra < size), cut).otherwise(F.col("text")))
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(names)
