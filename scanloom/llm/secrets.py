"""Secret scans: base patterns, and a battery of randomness tests over long tokens.

A token of 20 characters or more is taken for the encoding with the smallest alphabet that holds it. Three tests ask
whether its characters look drawn at random from that alphabet: chi-squared uniformity, runs above and below the
alphabet's middle, and lag-1 serial correlation. Their p-values are combined (Fisher) to a score. The score isn't a significance by itself, as the tests aren't
independent; what counts is how often a *natural* token of the same encoding and length scores as random. That background is a fixed model: words joined
as identifiers, paths and constants are, numbers counted and dated. A discovery is a token whose naturalness is rejected, and in each stratum of encoding
and length the Benjamini-Hochberg procedure, with an estimate of the natural tokens' number, holds their share among the discoveries at ``rate``. So a short token, of which many natural ones
look random too, is only taken where secrets abound; a long one nearly always. A secret also holds ``bits`` of entropy. The procedure
works on a histogram of the scores of all documents' tokens, of fixed size.

Spans are (kind, start, end) in code points. Kinds in order: assign, access, hex, random. Random spans that meet a base span
are left out.

Defined results: a null text counts as empty and has no spans; repeated rows are scanned and counted as they come.
"""

from __future__ import annotations

import math
import random
import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .words import small_batches

KINDS = ("assign", "access", "hex", "random")
_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_WORDS = ("passw", "secret", "token", "apikey", "api_key")
_ACCESS = re.compile("AKIA[A-Z0-9]+")
_HEX = re.compile("[0-9a-f]+")
_TOKEN = re.compile(r"[A-Za-z0-9+/_-]{20,}={0,2}")
#: Encodings by the size of their alphabets.
_DIGITS, _LOW, _UP = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
ENCODINGS = [
    ("digits", _DIGITS),
    ("hex", _DIGITS + _LOW[:6]),
    ("HEX", _DIGITS + _UP[:6]),
    ("letters", _LOW),
    ("LETTERS", _UP),
    ("base32", _UP + "234567"),
    ("base36", _DIGITS + _LOW),
    ("BASE36", _DIGITS + _UP),
    ("base62", _UP + _LOW + _DIGITS),
    ("base64", _UP + _LOW + _DIGITS + "+/"),
    ("base64url", _UP + _LOW + _DIGITS + "-_"),
    ("mixed", _UP + _LOW + _DIGITS + "+/-_"),
]
_CODES = [(name, {c: i for i, c in enumerate(letters)}) for name, letters in ENCODINGS]
#: Bins of a histogram: eighths of a power of two.
BINS = 512


def _tail(z: float) -> float:
    return 0.5 * math.erfc(z / math.sqrt(2))


def battery(codes: list[int], size: int) -> float:
    """Combined p-value of the tests that the codes are random in range(size)."""
    n = len(codes)
    counts = [0] * size
    for c in codes:
        counts[c] += 1
    chi = sum(x * x for x in counts) * size / n - n
    # A scaled chi-squared with the exact mean and variance of this statistic; cube root to a normal.
    mean, var = size - 1, 2 * (size - 1) * (n - 1) / n
    df = 2 * mean * mean / var
    uniform = _tail(((chi / mean) ** (1 / 3) - (1 - 2 / (9 * df))) / math.sqrt(2 / (9 * df)))
    high = [2 * c >= size for c in codes]
    a = sum(high)
    b = n - a
    runs = 1 + sum(x != y for x, y in zip(high, high[1:]))
    if a and b:
        expected = 1 + 2 * a * b / n
        spread = max((expected - 1) * (expected - 2) / (n - 1), 1e-9)
        runs_p = 2 * _tail(max(0.0, abs(runs - expected) - 0.5) / math.sqrt(spread))
    else:
        runs_p = 2.0 ** (1 - n)
    m = sum(codes) / n
    dev = [c - m for c in codes]
    power = sum(x * x for x in dev)
    r = sum(x * y for x, y in zip(dev, dev[1:])) / power if power else 1.0
    serial = 2 * _tail(abs(r + 1 / n) * math.sqrt(n))
    half = -sum(math.log(max(min(p, 1.0), 1e-300)) for p in (uniform, runs_p, serial))
    return math.exp(-half) * (1 + half + half * half / 2)


def encoding_of(token: str) -> tuple[int, list[int]]:
    letters = set(token)
    for i, (_, codes) in enumerate(_CODES):
        if letters <= codes.keys():
            return i, [codes[c] for c in token]
    raise ValueError(token)


def candidates(text: str) -> list[tuple[int, int, str, float, float]]:
    """(start, end, stratum, p, bits) of every long token of a text."""
    out = []
    for m in _TOKEN.finditer(text):
        kind, codes = encoding_of(m[0].rstrip("="))
        size = len(ENCODINGS[kind][1])
        out.append((m.start(), m.end(), f"{ENCODINGS[kind][0]}:{band_of(len(codes))}", battery(codes, size), len(codes) * math.log2(size)))
    return out


def bin_of(p: float) -> int:
    return min(BINS - 1, int(-8 * math.log2(max(p, 1e-300))))


def base_spans(text: str, long_words: bool) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base patterns; ``long_words``: whether a word has 20 characters or more."""
    out = []
    low = text.lower()
    if any(w in low for w in _WORDS):
        out += [(m.start(), 0, m.end()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if long_words:
        if "AKIA" in text:
            out += [(m.start(), 1, m.end()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
        out += [(m.start(), 2, m.end()) for m in _HEX.finditer(text) if m.end() - m.start() >= 24]
    return sorted(out)


def has_long_word(text: str) -> bool:
    return any(len(w) >= 20 for w in text.split())


# Words of the background's identifiers.
BACKGROUND_WORDS = (
    "account action active address admin after agent alert allow amount archive array async attribute audit author balance base batch before binary block body branch browser buffer build bundle button cache "
    "calculate callback cancel category channel check child class clear client close cluster code collection column command comment commit common compare component config connection content context control "
    "convert count country create current customer data database date default delete depth description detail device dialog directory display document domain download edit element email enable encode engine "
    "entity error event example exception execute export extension factory failure feature fetch field file filter final find first folder format forward frame function gateway generate global graph group "
    "handler header height history home host image import index initial input insert instance interface internal invoice item job keyboard label language last layer length level library limit link list load"
).split()
#: Tokens of the background in each stratum of a style.
BACKGROUND_SIZE = 1500
#: Quarters of a power of two of the length over 20; the last stratum holds all that are longer.
BANDS = 16


def natural_token(rng: random.Random, style: str, length: int) -> str:
    """A token as people and programs name things, cut to ``length``."""
    out = ""
    while len(out) < length:
        w = rng.choice(BACKGROUND_WORDS)
        if style == "camel":
            out += w.capitalize() if out else w
        elif style == "lower":
            out += w
        elif style == "UPPER":
            out += w.upper()
        elif style == "snake":
            out += ("_" if out else "") + w
        elif style == "path":
            out += rng.choice(("/", "-", "/")) + rng.choice((w, w.capitalize(), w + str(rng.randint(0, 99))))
        elif style == "numbered":
            out += rng.choice((w, w.capitalize(), str(rng.randint(0, 2030))))
        elif style == "CONSTANT":
            out += w.upper() + rng.choice(("", str(rng.randint(0, 99))))
        elif style == "digits":
            out += rng.choice((f"{rng.randint(1990, 2030)}{rng.randint(1, 12):02d}{rng.randint(1, 28):02d}", f"{rng.randint(0, 9999):06d}", str(rng.randint(0, 9)) * 3, f"{rng.randint(0, 23):02d}{rng.randint(0, 59):02d}{rng.randint(0, 59):02d}"))
        else:  # hex and HEX: padded counters, flags and round numbers
            x = rng.choice((f"{rng.randint(0, 0xFFFF):08x}", f"{rng.randint(0, 255):02x}00", "ff", "0" * 4, f"{rng.randint(0, 0xFFF):04x}"))
            out += x.upper() if style == "HEX" else x
    return out[:length]


def band_of(length: int) -> int:
    return min(int(4 * math.log2(length / 20)), BANDS - 1)


STYLES = ("camel", "lower", "UPPER", "snake", "path", "numbered", "CONSTANT", "digits", "hex", "HEX")
_model: dict[tuple[str, int], tuple[list[int], list[tuple[float, float, float]]]] = {}


def background_scores(band: int, style: str) -> Iterator[tuple[str, int, int]]:
    """(encoding, band, score bin) of natural tokens of a style, of lengths in a band."""
    rng = random.Random(f"{band}/{style}")
    low, high = 20 * 2 ** (band / 4), 20 * 2 ** ((band + 1) / 4)
    for _ in range(BACKGROUND_SIZE if band < 8 else BACKGROUND_SIZE // 5):  # longer ones vary less
        kind, codes = encoding_of(natural_token(rng, style, max(20, math.ceil(low + rng.random() * (high - low - 1)))))
        yield ENCODINGS[kind][0], band_of(len(codes)), bin_of(battery(codes, len(ENCODINGS[kind][1])))


def background(spark: SparkSession) -> dict[tuple[str, int], tuple[list[int], list[tuple[float, float, float]]]]:
    """Of each (encoding, band): the sorted score bins of natural tokens; and of each style in it its share, and mean and deviation of the scores' square roots.

    The model is the same for all inputs: it is made once by small tasks and kept.
    """
    if _model:
        return _model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(i % len(STYLES), *r) for i in batch.column(0).to_pylist() for r in background_scores(i // len(STYLES), STYLES[i % len(STYLES)])]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.string(), pa.int32(), pa.int32()))], names=["style", "encoding", "band", "bin"])

    made = spark.range(0, BANDS * len(STYLES), 1, BANDS).mapInArrow(run, "style int, encoding string, band int, bin int")
    bins: dict = {}
    for r in made.collect():  # BANDS times STYLES times BACKGROUND_SIZE rows at most
        bins.setdefault((r["encoding"], r["band"]), {}).setdefault(r["style"], []).append(r["bin"])
    for k, styles in bins.items():
        n, fits = sum(map(len, styles.values())), []
        for x in styles.values():
            roots = [math.sqrt(v) for v in x]
            mean = sum(roots) / len(roots)
            fits.append((len(x) / n, mean, max(1.0, math.sqrt(sum((v - mean) ** 2 for v in roots) / len(roots)))))
        if n >= 100:
            _model[k] = (sorted(v for x in styles.values() for v in x), sorted(fits))
    return _model


def natural_share(known: dict, encoding: str, band: int, score: int) -> float:
    """How many of the ``known`` background's tokens of the stratum score ``score`` or less, that is, look as random as that or more.

    Counted where 20 or more do. Below that, the tails of normal distributions of each style's square roots, as a chi-squared statistic is about normal and its
    log-significance about quadratic in it. A stratum that the background doesn't have takes the largest share of any with its length.
    """
    if (encoding, band) not in known:
        return max(natural_share(known, e, b, score) for e, b in known if b == band)
    x, fits = known[encoding, band]
    at = bisect_right(x, score)
    if at >= 20:
        return at / len(x)
    tail = sum(w * _tail((mean - math.sqrt(score + 0.5)) / dev) for w, mean, dev in fits)
    return max(1e-12, min(tail, 20 / len(x)))


def natural_part(known: dict, encoding: str, band: int, counts: dict[int, int]) -> float:
    """An upper estimate of the share of natural tokens among a stratum's: those that score above the background's median, against what the background has there."""
    x, _ = known.get((encoding, band), (None, None))
    if x is None:
        return 1.0
    median = x[len(x) // 2]
    above = 1 - bisect_right(x, median) / len(x)
    return min(1.0, (1 + sum(n for b, n in counts.items() if b > median)) / (sum(counts.values()) * above)) if above else 1.0


def cuts(docs: DataFrame, text_col: str, rate: float) -> dict[str, int]:
    """For each stratum the last score bin (from random to natural) whose tokens are discoveries."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(s, bin_of(p)) for t in batch.column(0).to_pylist() if has_long_word(t) for _, _, s, p, _ in candidates(t)]
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in found], pa.string()), pa.array([x[1] for x in found], pa.int32())], names=["stratum", "bin"])

    seen = docs.select(F.coalesce(F.col(text_col), F.lit("")).alias("text")).mapInArrow(measure, "stratum string, bin int").groupBy("stratum", "bin").count()
    by: dict[str, dict[int, int]] = {}
    for r in seen.collect():  # at most one row for each encoding, band and bin
        by.setdefault(r["stratum"], {})[r["bin"]] = r["count"]
    out, known = {}, background(docs.sparkSession)
    for stratum, counts in by.items():
        encoding, band = stratum.split(":")
        total, so_far = sum(counts.values()), 0
        natural = total * natural_part(known, encoding, int(band), counts)
        for b in sorted(counts):
            so_far += counts[b]
            if natural_share(known, encoding, int(band), b) * natural <= rate * so_far:
                out[stratum] = b
    return out


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rate: float = 0.05, bits: float = 80.0) -> DataFrame:
    """(id_col, spans) with spans an array of (start, kind, end) in order, of every text."""
    small_batches(docs.sparkSession)
    last = cuts(docs, text_col, rate)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shape = pa.list_(pa.struct([("start", pa.int32()), ("kind", pa.string()), ("end", pa.int32())]))
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                long_words = has_long_word(text)
                spans = base_spans(text, long_words)
                if long_words:
                    taken = list(spans)
                    for start, end, stratum, p, entropy in candidates(text):
                        if entropy >= bits and bin_of(p) <= last.get(stratum, -1) and not any(s < end and start < e for s, _, e in taken):
                            spans.append((start, 3, end))
                out.append([{"start": s, "kind": KINDS[k], "end": e} for s, k, e in sorted(spans)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, shape)], names=["id", "spans"])

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, spans array<struct<start:int,kind:string,end:int>>").withColumnRenamed("id", id_col)


def op4_secrets(docs: DataFrame) -> DataFrame:
    found = scan(docs)
    base = F.filter("spans", lambda s: s["kind"] != "random")

    def line(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")

    def n(kind):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", n("assign"), n("access"), n("hex"), F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"), n("random"))
