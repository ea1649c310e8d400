"""Filter interaction audit: what each order of a set of filters keeps and loses, from one count of failure masks.

A document's mask has bit i set if it fails filter i. Per part of the corpus three histograms over the 2^k masks are counted: all documents, the
good ones, the toxic ones. Whatever an order of the filters does at a step depends on the mask alone, so each outcome is an integer matrix of masks
by (order, step), 32 by 600 for five filters:

- kept: the mask fails none of the filters so far;
- removed: it fails this one and none before;
- redundant: it fails this one and one before;
- unique: it fails this one and no other of the set.

The histograms, stacked as rows, times these matrices are the results; the removals of a filter, summed over the orders and steps it stands in, are
its Shapley value times the number of orders. Texts are read once and never shuffled. What is shuffled is a row of some fifty bytes a document
(digest, id, part, mask), first by id to meet the labels, then by digest to find copies: equal digests of a part are counted before the second
shuffle, so a text that fills a third of the table sends one row a task and part. Digests are the first 128 bits of SHA-256.

Defined results: a null text is empty, a null part the empty string. A null id is no smaller and no larger than another, so its text is no copy and
makes none. Of rows with one id none is a copy of another. A document is good (toxic) if any label row of its id says so; labels without an id count
for nothing. An empty table has no parts and gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import permutations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: The bit of the last filter: a copy of a document with a smaller id.
COPY = 16
_COLUMNS = "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"


def text_failures(text: Column) -> list[Column]:
    """The filters that need one text only: A few words, B few distinct words, C many capitals, D symbols."""
    words = F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")
    n, distinct = F.size(words), F.size(F.array_distinct(words))
    # lengths in bytes: capitals are one byte each, and removing them leaves the rest as it is
    capitals = F.octet_length(text) - F.octet_length(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", ""))
    return [n < 50, 100 * distinct < 65 * n, 100 * capitals.cast("long") > 5 * F.length(text), text.rlike(r"[#$%&*|]")]


def failure_masks(docs: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, part, digest, mask) of each row; the mask has the bits of the filters of one text."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    read = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(part_col).cast("string"), F.lit("")).alias("part"), text.alias("text"))
    mask = sum((F.when(fails, F.lit(1 << i)).otherwise(0) for i, fails in enumerate(text_failures(F.col("text")))), F.lit(0))
    return read.select("id", "part", F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"), mask.cast("int").alias("mask"))


def mask_histograms(docs: DataFrame, labels: DataFrame, part_col: str = "source", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(part, mask, n, good, toxic): documents of each part by the filters that they fail, copies among them."""
    rows = failure_masks(docs, part_col, id_col, text_col)
    known = labels.where(F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id")).agg(
        F.coalesce(F.max(F.col("quality") == 1), F.lit(False)).alias("good"), F.coalesce(F.max(F.col("toxic") == 1), F.lit(False)).alias("toxic")
    )
    # Rows without an id meet no label; by their digests they are spread over the tasks.
    spread = F.when(F.col("id").isNull(), F.xxhash64("digest", "part")).otherwise(0)
    rows = rows.withColumn("spread", spread).join(known.withColumn("spread", F.lit(0).cast("long")), ["id", "spread"], "left")
    marks = [F.coalesce(c, F.lit(False)).alias(c) for c in ("good", "toxic")]
    one_id = rows.groupBy("id", "spread", "digest", "part", "mask", *marks).agg(F.count("*").alias("n"))
    # Of a part's copies of one text, those with the smallest id are told apart from the rest; then the smallest id of all parts is found.
    copies = one_id.groupBy("digest", F.col("id").isNull().alias("nameless"), "part", "mask", "good", "toxic").agg(
        F.sum("n").alias("n"), F.min("id").alias("first"), F.min_by("n", "id").alias("n_first")
    )
    least = F.min("first").over(Window.partitionBy("digest"))
    kept = F.when(F.col("nameless"), F.col("n")).when(F.col("first") == F.col("least"), F.col("n_first")).otherwise(0)
    halves = F.array(F.struct("mask", kept.alias("n")), F.struct((F.col("mask") + COPY).alias("mask"), (F.col("n") - kept).alias("n")))
    split = copies.withColumn("least", least).select("part", "good", "toxic", F.inline(halves)).where("n > 0")
    return split.groupBy("part", "mask").agg(F.sum("n").alias("n"), *(F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c) for c in ("good", "toxic")))


def outcome_matrices(filters: str = FILTERS) -> tuple[list[tuple[str, int]], dict[str, np.ndarray]]:
    """The (order, step) pairs, and for each outcome an integer matrix of masks by pairs."""
    k = len(filters)
    orders = list(permutations(range(k)))
    masks = np.arange(1 << k, dtype=np.int64)[:, None]
    this = np.array([1 << i for order in orders for i in order])
    before = np.array([sum(1 << i for i in order[:s]) for order in orders for s in range(k)])
    fails, failed = (masks & this) > 0, (masks & before) > 0
    made = {"kept": ~fails & ~failed, "removed": fails & ~failed, "redundant": fails & failed, "unique": masks == this}
    pairs = [("".join(filters[i] for i in order), s + 1) for order in orders for s in range(k)]
    return pairs, {name: m.astype(np.int64) for name, m in made.items()}


def audit(histograms: DataFrame, filters: str = FILTERS) -> DataFrame:
    """One row a part, order and step, from (part, mask, n, good, toxic)."""
    size = 1 << len(filters)
    rows = histograms.groupBy("part").agg(
        *(F.sum(F.when(F.col("mask") == m, F.col(c)).otherwise(0)).alias(f"{c}{m}") for c in ("n", "good", "toxic") for m in range(size))
    )
    names = ", ".join(f"{c} long" for c in _COLUMNS)

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, m = outcome_matrices(filters)
        order, step = pa.array([o for o, _ in pairs]), pa.array([s for _, s in pairs], pa.int32())
        letter = np.array([filters.index(o[s - 1]) for o, s in pairs])
        of_filter = (letter[:, None] == np.arange(len(filters))).astype(np.int64)
        for batch in batches:
            for at in range(0, batch.num_rows, 64):
                some = batch.slice(at, 64)
                stacked = np.stack([some.column(1 + i).to_numpy(zero_copy_only=False) for i in range(3 * size)], axis=1).astype(np.int64)
                n, good, toxic = stacked[:, :size], stacked[:, size : 2 * size], stacked[:, 2 * size :]
                removed = n @ m["removed"]
                shapley = (removed @ of_filter)[:, letter]
                values = n @ m["kept"], removed, n @ m["redundant"], n @ m["unique"], good @ m["removed"], toxic @ m["removed"], shapley
                for i, part in enumerate(some.column(0)):
                    columns = [pa.array([part.as_py()] * len(pairs), pa.string()), order, step, *(pa.array(v[i]) for v in values)]
                    yield pa.RecordBatch.from_arrays(columns, names=["part", "filter_order", "step", *_COLUMNS])

    return rows.mapInArrow(multiply, f"part string, filter_order string, step int, {names}")


def op13_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return audit(mask_histograms(docs, labels))
