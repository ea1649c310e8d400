"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Words and word pairs are hashed into ``buckets`` cells. Two multinomials are counted over the cells: one over *all*
documents (raw) and one over the trusted ones, smoothed towards the raw one. A document's score is the mean of
log(target / raw) over its n-grams, so length doesn't matter, and it is kept if the score reaches a fixed threshold.

Counting is a map with one row a cell and task, then a sum: the model has a fixed size. Scoring is a narrow map.

Every document that is labelled good and not toxic is trusted. They are found by a join on the id, always shuffled, so that disk grows as the input does. Only texts that
a filter of fixed size lets through are sent, compressed: the trusted ones and few others. The raw side is counted without a shuffle.

Defined results: a null or empty text has no words, fails the base rules and isn't kept; its score is null. Without
trusted documents every ratio is 1, every score 0 and the base rules decide alone. Repeated rows count as often as they come.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import _P, _cell_of, sliced, small_batches, trim, wanted_filter

#: Scores below it reject a document. Junk scores about -0.25, clean text of the rarer languages about -0.05.
THRESHOLD = -0.13
_SPACES = " \t\n\x0b\x0c\r"


class WordHash(dict):
    """64-bit hashes of words, with as many kept as fit a bounded memo."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 150_000:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_hashes = WordHash()


def word_hashes(text: str) -> tuple[list[bytes], np.ndarray]:
    """Words (split at ASCII white space) and their hashes."""
    words = text.encode("utf-8", "surrogatepass").split()
    return words, np.fromiter(map(_hashes.__getitem__, words), np.uint64, len(words))


def cells(h: np.ndarray, buckets: int) -> np.ndarray:
    """Cells of the words and word pairs."""
    pairs = (h[:-1] * _P) ^ (h[1:] >> np.uint64(7))
    both = np.concatenate([h, pairs]) * _P
    return ((both >> np.uint64(33)) % np.uint64(buckets)).astype(np.int64)


def repeated_words(words: list[bytes], h: np.ndarray, width: int = 5) -> int:
    """Words that stand in a window of ``width`` words found at least twice. Hashes only rule windows out."""
    n = len(words) - width + 1
    if n < 2:
        return 0
    w = h[:n].copy()
    for k in range(1, width):
        w = (w ^ (w >> np.uint64(29))) * _P + h[k : k + n]
    order = np.argsort(w, kind="stable")
    same = w[order[1:]] == w[order[:-1]]
    if not same.any():
        return 0
    twice = np.zeros(n, bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    at = np.flatnonzero(twice)
    seen = Counter(windows := [tuple(words[i : i + width]) for i in at])
    ends = np.zeros(len(words) + 1, np.int64)
    starts = np.array([i for i, x in zip(at, windows, strict=True) if seen[x] > 1], np.int64)
    np.add.at(ends, starts, 1)
    np.add.at(ends, starts + width, -1)
    return int((np.cumsum(ends[:-1]) > 0).sum())


def base_counts(text: str, words: list[bytes], h: np.ndarray) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    lines = [x for x in text.split("\n") if x.strip(_SPACES)]
    return (
        len(words),
        len(text) - sum(map(text.count, _SPACES)),
        sum(map(text.count, "#*$%&|<>")),
        len(lines) - len(set(lines)),
        repeated_words(words, h),
    )


def trusted_ids(labels: DataFrame, limit: int | None = None) -> DataFrame:
    """Ids of all documents labelled good and not toxic; with a ``limit``, which the model doesn't use, those with the smallest hashes."""
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0 and doc_id is not null").select("doc_id").distinct()
    return good if limit is None else good.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


def trusted_texts(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, z): the trusted documents' texts in UTF-8, null as empty, compressed one by one."""
    small_batches(docs.sparkSession)
    kind = docs.schema["doc_id"].dataType.simpleString()
    good = trusted_ids(labels).select(F.col("doc_id").cast(kind))
    packed = docs.sparkSession.sparkContext.broadcast(wanted_filter(good.select(F.xxhash64("doc_id").alias("h"))))

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, packer = np.unpackbits(packed.value).astype(bool), zstandard.ZstdCompressor(level=1)
        for b in sliced(batches):
            b = b.filter(pa.array(bits[_cell_of(b.column(2).to_numpy())]))
            z = [packer.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])

    texts = docs.where("doc_id is not null").select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("doc_id").alias("h"))
    return texts.mapInArrow(send, f"doc_id {kind}, z binary").join(good.hint("merge"), "doc_id", "left_semi")


def fit(docs: DataFrame, labels: DataFrame, buckets: int = 16_384, smoothing: float = 16_384.0) -> np.ndarray:
    """log(target / raw) of every cell."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, held, size = np.zeros(buckets, np.int64), [], 0
        for batch in sliced(batches):
            for text in batch.column(0).to_pylist():
                held.append(cells(word_hashes(zstandard.decompress(text).decode("utf-8", "surrogatepass") if isinstance(text, bytes) else text)[1], buckets))
                size += len(held[-1])
                if size > 1_000_000:
                    total += np.bincount(np.concatenate(held), minlength=buckets)
                    held, size = [], 0
        if held:
            total += np.bincount(np.concatenate(held), minlength=buckets)
        trim()
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(buckets)), pa.array(total)], names=["cell", "n"])

    small_batches(docs.sparkSession)
    raw, target = np.zeros(buckets), np.zeros(buckets)
    for out, texts in ((raw, docs.select(F.coalesce("text", F.lit("")).alias("text"))), (target, trusted_texts(docs, labels).select("z"))):
        for cell, n in texts.mapInArrow(count, "cell long, n long").groupBy("cell").agg(F.sum("n")).collect():  # as many rows as cells
            out[cell] = n
    p = (raw + 1) / (raw.sum() + buckets)
    return np.log((target + smoothing * p) / (target.sum() + smoothing) / p)


def apply_rules(docs: DataFrame, ratios: np.ndarray, threshold: float = THRESHOLD, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, base counts, score, base_failed, kept) of every document, under the given cell ratios."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(ratios)
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ratio = shared.value
        for batch in sliced(batches):
            rows, scores = [], []
            for text in batch.column(1).to_pylist():
                words, h = word_hashes(text)
                rows.append(base_counts(text, words, h))
                scores.append(float(ratio[cells(h, len(ratio))].mean()) if words else None)
            columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns), pa.array(scores, pa.float64())],
                names=["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "score"],
            )

    names = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, score double"
    out = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(score, f"id {kind}, {names}")
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        out.withColumn("base_failed", failed)
        .withColumn("kept", ~failed & F.coalesce(F.col("score") >= threshold, F.lit(False)))
        .withColumnRenamed("id", id_col)
    )


def passes(text: str, ratio: np.ndarray, threshold: float) -> bool:
    """Whether the base rules and the score keep a text."""
    words, h = word_hashes(text)
    if len(words) < 10 or 100 * repeated_words(words, h) > 20 * len(words):
        return False
    return bool(ratio[cells(h, len(ratio))].mean() >= threshold)


def kept_documents(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, with all columns, that the rules keep. Only texts go to the workers, and one boolean a row comes back."""
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(fit(docs, labels))

    def keep(texts: pa.Array) -> pa.Array:
        return pa.array([passes(t or "", shared.value, threshold) for i in range(0, len(texts), 500) for t in texts.slice(i, 500).to_pylist()], pa.bool_())

    return docs.where(F.arrow_udf(keep, "boolean")(F.col(text_col)))


def quality_rules(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    return apply_rules(docs, fit(docs, labels), threshold)


def op3_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return quality_rules(docs, labels)
