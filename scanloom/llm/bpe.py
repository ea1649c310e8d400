"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one vocabulary entry can be the last token of its encoding. An
automaton over the vocabulary lists the entries that end at each position; the entry whose predecessor
(the last token of the shorter prefix) is *compatible* with it is that last token. Following the stored
tokens back from the end gives the exact ids of the merge procedure, in time linear in the matches.

Defined results: a null text counts as empty; an empty text has no ids and decodes to ''.
Characters without an entry are dropped, as the vocabulary has no unknown token.
"""

from __future__ import annotations

import json
import re
import struct
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import small_batches, trim

#: The pattern of these vocabularies, and the same for the standard library's faster matcher where letters, numbers and
#: white space are what that matcher takes for letters, digits and white space.
_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_PLAIN = r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\w\s]|_)+"
_UNCOMMON = re.compile("[\x1c-\x1f\xb2\xb3\xb9\xbc-\xbe\u0250-\U0010ffff]")


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(0x100, 0x200))
    return [chr(b) if b in set(plain) else chr(next(spare)) for b in range(256)]


class Memo(dict):
    """What ``make`` returns for a key, kept for the last ``size`` to ``2 * size`` keys used."""

    def __init__(self, make: Callable[[str], tuple[bytes, str]], size: int):
        super().__init__()
        self.make, self.size, self.older = make, size, {}

    def __missing__(self, key: str) -> tuple[bytes, str]:
        if len(self) >= self.size:
            self.older = dict(self)
            self.clear()
        value = self.older.get(key) or self.make(key)
        if len(key) <= 64:
            self[key] = value
        return value

    def forget(self) -> None:
        self.clear()
        self.older = {}


def known_normalizer(section: dict | None) -> dict | None:
    """None if the vocabulary's normalizer is the one that ``split`` does: NFC, runs of white space to a blank, lower case; else what differs."""
    known = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    return None if section == {"type": "Sequence", "normalizers": known} else section or {}


class PrefixEncoder:
    """Vocabulary, automaton and pair tests for one vocabulary file of a byte-level BPE with word ends."""

    #: Pre-tokens kept with their encoding, during a task: bounds a worker's memory.
    MEMO = 100_000
    #: Pair tests kept.
    PAIRS = 200_000

    def __init__(self, path: str):
        import ahocorasick

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if (other := known_normalizer(spec.get("normalizer"))) is not None:
            raise ValueError(f"this encoder doesn't know the normalizer {other}")
        self.suffix = model.get("end_of_word_suffix") or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.names = {i: s for s, i in self.vocab.items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names.update({i: s for s, i in self.special.items()})
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pieces = regex.compile(split["pattern"]["Regex"])
        self.plain = re.compile(_PLAIN) if split["pattern"]["Regex"] == _PATTERN else None
        self.marks = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")")
        self.letters = byte_letters()
        self.table = dict(enumerate(self.letters))
        # A letter with the word end is one symbol; it gets a private code point.
        self.ends = {c: chr(0xF0000 + i) for i, c in enumerate(self.letters)}
        self.parts: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], tuple[int, int]] = {}
        self.rank: dict[int, int] = {}
        for r, pair in enumerate(model["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            a, b, c = self.vocab[left], self.vocab[right], self.vocab[left + right]
            self.joined[a, b] = (r, c)
            self.parts.setdefault(c, (a, b))
            self.rank.setdefault(c, r)
        self.automaton = ahocorasick.Automaton()
        self.sizes: dict[int, int] = {}
        for s, i in self.vocab.items():
            if symbols := self.symbols(s):
                self.automaton.add_word(symbols, i)
                self.sizes[i] = len(symbols)
        self.automaton.make_automaton()
        self.alphabet = {s for t in self.vocab if len(s := self.symbols(t)) == 1}
        self.whole = self.alphabet.issuperset([*self.letters, *(self.ends.values() if self.suffix else ())])
        self.tested: dict[int, bool] = {}
        self.alone: dict[int, bool] = {}
        self.packed = {i: struct.pack("<I", i) for i in self.names}
        self.named = {i: s + " " for i, s in self.names.items()}
        self.known = Memo(self.piece, self.MEMO)

    def symbols(self, token: str) -> str:
        """A token as one character a symbol."""
        if self.suffix and token.endswith(self.suffix) and len(token) > len(self.suffix):
            body = token[: -len(self.suffix)]
            return body[:-1] + self.ends.get(body[-1], body[-1])
        return token

    def compatible(self, left: int, right: int) -> bool:
        """Whether merging the text of both tokens leaves exactly the two.

        Undo merges on both sides of the seam, latest first. If at some moment the two tokens at the seam
        have a merge that comes before the one undone there, the procedure would have joined them.
        """
        a, b, before, equal = left, right, float("inf"), False
        while True:
            hit = self.joined.get((a, b))
            if hit is not None and (hit[0] < before or (equal and hit[0] == before)):
                return False
            ra, rb = self.rank.get(a, -1), self.rank.get(b, -1)
            if ra < 0 and rb < 0:
                return True
            if ra > rb:  # of two merges of one rank the left one comes first, so the right is undone first
                before, equal, a = ra, False, self.parts[a][1]
            else:
                before, equal, b = rb, True, self.parts[b][0]

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        text = piece.encode("utf-8").decode("latin-1").translate(self.table)
        if self.suffix:
            text = text[:-1] + self.ends[text[-1]]
        if not self.whole:
            text = "".join([c for c in text if c in self.alphabet])
        last: list[int | None] = [None] * (len(text) + 1)
        sizes, tested, alone = self.sizes, self.tested, self.alone
        for end, token in self.automaton.iter(text):
            if last[end + 1] is None:
                start = end + 1 - sizes[token]
                if start:
                    if (before := last[start]) is not None:
                        ok = tested.get(key := before << 20 | token)
                        if ok is None:
                            ok = tested[key] = self.compatible(before, token)
                        if ok:
                            last[end + 1] = token
                elif alone[token] if token in alone else self.stands(token):
                    last[end + 1] = token
        if len(tested) > self.PAIRS:
            tested.clear()
        ids, at = [], len(text)
        while at:
            ids.append(last[at])
            at -= sizes[last[at]]
        return ids[::-1]

    def stands(self, token: int) -> bool:
        """Whether the merges of a token's own text end in that token."""
        known = self.alone.get(token)
        if known is None:
            a, b = self.parts.get(token, (None, None))
            known = self.alone[token] = a is None or (self.stands(a) and self.stands(b) and self._joins_last(a, b))
        return known

    def _joins_last(self, a: int, b: int) -> bool:
        rank, x, y = self.joined[a, b][0], a, b
        while True:
            rx, ry = self.rank.get(x, -1), self.rank.get(y, -1)
            if rx < 0 and ry < 0:
                return True
            if rx > ry:
                before, x = rx, self.parts[x][1]
            else:
                before, y = ry, self.parts[y][0]
            hit = self.joined.get((x, y))
            if hit is not None and hit[0] < min(before, rank):
                return False

    def piece(self, piece: str) -> tuple[bytes, str]:
        """Ids as little-endian bytes and the tokens' names, each followed by a blank, of one pre-token."""
        ids = self.encode_piece(piece)
        return b"".join([self.packed[i] for i in ids]), "".join([self.named[i] for i in ids])

    def split(self, text: str) -> list[str]:
        """Pre-tokens: NFC and lower case letter by letter (no final sigma), then the vocabulary's pattern.

        The pattern never matches white space, so runs of it need not become one blank first.
        """
        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")
        text = text.lower()
        return (self.pieces if self.plain is None or _UNCOMMON.search(text) else self.plain).findall(text)

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as little-endian 32-bit bytes, and what they decode to."""
        found: list[tuple[bytes, str]] = []
        for part in self.marks.split(text) if self.special else [text]:
            if part in self.special:
                found.append((struct.pack("<I", self.special[part]), part + " "))
            else:
                found.extend(map(self.known.__getitem__, self.split(part)))
        return b"".join([x[0] for x in found]), "".join([x[1] for x in found])[:-1]


_loaded: dict[str, PrefixEncoder] = {}


def encoder(path: str) -> PrefixEncoder:
    """The encoder of a vocabulary file, built once in each worker."""
    if path not in _loaded:
        _loaded[path] = PrefixEncoder(path)
    return _loaded[path]


def encode_documents(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id_col, ids_le, decoded) of every text: a narrow map over the documents, no shuffle.

    ``ids_le`` holds the ids as little-endian unsigned 32-bit integers; ``decoded`` what they decode to.
    ``vocabulary`` is the path of the vocabulary file on every executor.
    """
    small_batches(docs.sparkSession)
    kind = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(vocabulary)
        for batch in batches:
            for at in range(0, batch.num_rows, 250):  # what one output batch holds stays small
                part = batch.slice(at, 250)
                rows = [enc.encode(t) for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([r[0] for r in rows], pa.binary()), pa.array([r[1] for r in rows], pa.string())],
                    names=["id", "ids_le", "decoded"],
                )
        enc.known.forget()  # the worker may run other operators next
        trim()

    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))
    return rows.mapInArrow(run, f"id {kind}, ids_le binary, decoded string").withColumnRenamed("id", id_col)


def public_vocabulary(name: str = "word_bpe_49k.json") -> str:
    """Where the public tokenizers' package keeps a vocabulary file."""
    import public_tokenizers

    return public_tokenizers.path(name)


def digests(encoded: DataFrame, *more: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) and ``more`` columns of what encode_documents returns."""
    return encoded.select(
        "doc_id",
        (F.octet_length("ids_le") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids_le", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
        *more,
    )


def op5_bpe(docs: DataFrame, vocabulary: str) -> DataFrame:
    """Digest columns of the encoding of every document."""
    return digests(encode_documents(docs, vocabulary))
