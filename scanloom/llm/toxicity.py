"""Toxicity by weak supervision: many voters, a generative model of their votes, and a linear classifier trained on its posterior.

1. Voters. A *lexicon voter* fires on a term, a whole word or a beginning of words, mined from a bounded sample of labelled documents: terms
   in many toxic documents and hardly any clean one, each taken for the toxic documents that better terms don't cover. A *pattern voter* fires on the shape of a text.
   Each is for toxic or for clean; one that doesn't fire abstains. A document's votes are the bits of one number.
2. Label model. The votes of *all* documents are counted by pattern. The class is hidden, but for the sample's documents; given the class, votes follow a tree: each voter depends on the class
   and on one other voter, the one it shares the most information with beyond the class. So every voter's accuracy in both classes and the strongest correlations are estimated
   together, by expectation and maximisation over the counts, which stay in the cluster; each round brings back the class-weighted counts of pairs of voters.
3. Classifier. Logistic regression on the presence of terms, with the posterior of the label model as target, by proximal gradients with an L1 penalty; terms
   are the ones most associated with that posterior in the sample. Gold labels mine terms and anchor the label model; the classifier sees its posterior only.
4. Every document is scored by the classifier, whole text, in one narrow map.

Bounds, the same at every size: at most ``sample_limit`` labelled documents of each label for mining and training, those with the smallest hashes of their ids;
``max_voters`` voters; ``max_terms`` terms. Counts of votes cover all documents.

Held out: rows whose crc32(doc_id as text) mod 3 is 1. They take no part in mining or training. Labels, language, source and id are no inputs of a score.

Defined results: a null text is empty and has no terms; its score is the classifier's for a text without any. A null id's checksum is that of the
empty string, so it isn't held out. Labels without an id, or null, teach nothing; of contradicting labels of one id the toxic one counts. Without labels no
terms are mined; the scores come from the pattern voters' model. Repeated rows get equal scores.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import WORDS, sliced, small_batches, stored, trim

THRESHOLD = 0.7
_EDGES = "\"'`.,;:!?()[]{}<>*_~«»“”„‘’…-"
_BLANK = " \t\n\x0b\x0c\r"
_BEGINNINGS = 4, 5, 6, 7
#: Beginnings of words are marked, so that they aren't taken for whole words.
_MARK = "^"
#: How a term is found: at all, twice or more, and twice or more with one word in a hundred.
_LEVELS = "123"

#: Pattern voters: what they fire on, and 1 where they are for toxic, 0 where for clean.
PATTERNS: list[tuple[str, int]] = [
    ("shouting", 1),  # over three in ten letters are capitals
    ("exclamations", 1),  # several exclamation marks in a row
    ("masked", 1),  # a word with symbols between its letters
    ("stretched", 1),  # a letter four times in a row
    ("addressed", 1),  # you are, followed by a word
    ("links", 0),  # a link or an address
    ("figures", 0),  # one character in twenty or more is a digit
]
_MASKED = re.compile(r"[^\W\d_][*#@$%]+[^\W\d_]")
_ADDRESSED = re.compile(r"\b[Yy]ou(?:'re| are) [a-z]")
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True


def held_out(doc_id: Column) -> Column:
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 3 == 1


def terms_of(word: str) -> tuple[str, ...]:
    """The word, without marks around it and in lower case, and its beginnings."""
    bare = word.strip(_EDGES).lower()
    return (bare, *(_MARK + bare[:n] for n in _BEGINNINGS if len(bare) >= n)) if bare else ()


class Memo(dict):
    """What a function says of words, for as many words as fit."""

    def __init__(self, told):
        super().__init__()
        self.told = told

    def __missing__(self, word: str):
        if len(self) > 150_000:
            self.clear()
        self[word] = found = self.told(word)
        return found


def levels(times: int, words: int) -> str:
    return _LEVELS[: 1 + (times > 1) + (times > 1 and 100 * times >= words)]


class Terms:
    """Numbers of the terms, of a given list, that a text has; an automaton finds them all in one pass."""

    def __init__(self, terms: list[str]):
        self.numbers = {t: i for i, t in enumerate(terms)}
        self.automaton = ahocorasick.Automaton()
        for key in {t[1:].lstrip(_MARK) for t in terms}:
            self.automaton.add_word(key, (len(key), [x for x in (key, _MARK + key) if any(level + x in self.numbers for level in _LEVELS)]))
        if terms:
            self.automaton.make_automaton()

    def of(self, text: str) -> set[int]:
        if not self.numbers:
            return set()
        low, times = text.lower(), Counter()
        for end, (size, kinds) in self.automaton.iter(low):
            at = end - size
            while at >= 0 and low[at] in _EDGES:
                at -= 1
            if at >= 0 and low[at] not in _BLANK:
                continue  # inside a word
            for term in kinds:
                if term[0] != _MARK:
                    at = end + 1
                    while at < len(low) and low[at] in _EDGES:
                        at += 1
                    if at < len(low) and low[at] not in _BLANK:
                        continue  # the word goes on
                times[term] += 1
        total = len(WORDS.findall(text)) if any(n > 1 for n in times.values()) else 0
        return {self.numbers[x] for t, n in times.items() for level in levels(n, total) if (x := level + t) in self.numbers}


class Voters:
    """Lexicon voters, one for each term, and the pattern voters after them."""

    def __init__(self, lexicon: list[str]):
        self.terms, self.size = Terms(lexicon), len(lexicon)

    def votes(self, text: str) -> int:
        """The bits of the voters that fire."""
        raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
        of = np.bincount(raw, minlength=256)
        letters, capitals = int(of[_LETTER].sum()), int(of[65:91].sum())
        same = raw[1:] == raw[:-1]
        fires = {
            "shouting": letters >= 20 and 10 * capitals > 3 * letters,
            "exclamations": "!!" in text,
            "masked": bool(of[[35, 36, 37, 42, 64]].any()) and bool(_MASKED.search(text)),
            "stretched": len(raw) > 3 and bool((same[2:] & same[1:-1] & same[:-2] & _LETTER[raw[3:]]).any()),
            "addressed": bool(_ADDRESSED.search(text)),
            "links": "://" in text or "www." in text or bool(of[64]),
            "figures": bool(of[48:58].sum() * 20 >= max(len(raw), 1)),
        }
        return sum(1 << i for i in self.terms.of(text)) | sum(1 << (self.size + i) for i, (name, _) in enumerate(PATTERNS) if fires[name])


def labelled_sample(docs: DataFrame, labels: DataFrame, sample_limit: int) -> tuple[DataFrame, float]:
    """(text, toxic) of labelled documents that aren't held out, at most ``sample_limit`` of each label, stored; and the share of toxic labels."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max(F.col("toxic") == 1).alias("toxic"))
    some = [known.where(t).orderBy(F.xxhash64("doc_id"), "doc_id").limit(sample_limit) for t in (F.col("toxic"), ~F.col("toxic"))]
    ids = F.broadcast(some[0].unionByName(some[1]).withColumnRenamed("doc_id", "_id"))  # sample_limit bounds it
    share = known.agg(F.avg(F.col("toxic").cast("int"))).first()[0]
    return stored(docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).join(ids, F.col("doc_id") == F.col("_id")).select("text", "toxic")), share or 0.0


def _counted(sample: DataFrame, weight: str) -> DataFrame:
    """(term, all, hits): documents with each term, and the sum of their weights."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        hits: Counter = Counter()
        memo = Memo(terms_of)

        def batch_of() -> pa.RecordBatch:
            names = list(seen)
            made = pa.RecordBatch.from_arrays([pa.array(names), pa.array([seen[t] for t in names], pa.int64()), pa.array([float(hits[t]) for t in names], pa.float64())], names=["term", "n", "hits"])
            seen.clear()
            hits.clear()
            return made

        for batch in sliced(batches):
            for text, w in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                words = WORDS.findall(text)
                times: Counter = Counter()
                for word, c in Counter(words).items():
                    for t in memo[word]:
                        times[t] += c
                found = [level + t for t, c in times.items() for level in levels(c, len(words))]
                seen.update(found)
                if w > 0:
                    for t in found:
                        hits[t] += w
                if len(seen) > 300_000:
                    yield batch_of()
        yield batch_of()
        trim()

    counted = sample.select("text", F.col(weight).cast("double").alias("w")).mapInArrow(count, "term string, n long, hits double")
    return counted.groupBy("term").agg(F.sum("n").alias("n"), F.sum("hits").alias("hits"))


def mine_lexicon(sample: DataFrame, max_voters: int, candidates: int = 800) -> list[str]:
    """Terms of toxic documents, best first; each covers toxic documents of the sample that the ones before leave."""
    sizes = sample.groupBy("toxic").count().collect()
    n = {r["toxic"]: r["count"] for r in sizes}
    if not n.get(True):
        return []
    # A lower bound of how often the term's documents are toxic, three pseudo-documents of the usual share mixed in.
    usual = n[True] / (n[True] + n.get(False, 0))
    precision = (F.col("hits") + 3 * usual) / (F.col("n") + 3)
    good = _counted(sample, "toxic").where(f"hits >= 2 and hits >= 0.8 * n").withColumn("precision", precision).where(F.col("precision") > min(0.5, 3 * usual))
    known = [r["term"] for r in good.orderBy(F.col("hits").desc(), F.col("precision").desc(), "term").limit(candidates).collect()]

    def cover(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(known)
        for batch in sliced(batches):
            found = [np.packbits(np.isin(np.arange(len(known)), list(terms.of(t)))).tobytes() for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.binary())], names=["found"])

    if not known:
        return []
    rows = sample.where("toxic").select("text").mapInArrow(cover, "found binary").toArrow()  # sample_limit rows of candidates / 8 bytes
    has = np.unpackbits(np.frombuffer(b"".join(rows.column(0).to_pylist()), np.uint8).reshape(rows.num_rows, -1), axis=1)[:, : len(known)].astype(bool)
    # Documents without a voter come first; three for each are enough.
    times, taken, worth = np.zeros(len(has), int), [], np.array([6.0, 1.0, 0.5, 0.0])
    while len(taken) < max_voters:
        gain = worth[np.minimum(times, 3)] @ has
        gain[taken] = 0
        if (best := int(gain.argmax())) in taken or not gain[best]:
            break
        taken.append(best)
        times += has[:, best]
    return [known[i] for i in taken]


class LabelModel:
    """P(class) and, given the class, a tree of voters: P(fires | class, whether the voter it hangs on fires)."""

    def __init__(self, polarity: list[int]):
        self.polarity = np.array(polarity)
        n = len(polarity)
        self.prior = 0.1
        self.parent = np.full(n, -1)
        # to begin with, a voter fires more often in the class that it is for
        rate = np.where(self.polarity[None] == np.array([0, 1])[:, None], 0.4, 0.05)
        self.table = np.repeat(rate[:, :, None], 2, axis=2)  # class, voter, parent fires

    def posterior(self, fired: np.ndarray) -> np.ndarray:
        """P(toxic | votes) of each row."""
        above = np.where(self.parent[None] >= 0, fired[:, np.maximum(self.parent, 0)], 0).astype(int)
        logs = []
        for c in (0, 1):
            p = self.table[c][np.arange(len(self.parent))[None], above]
            logs.append(np.log(np.where(fired, p, 1 - p)).sum(axis=1) + np.log(self.prior if c else 1 - self.prior))
        return 1 / (1 + np.exp(np.clip(logs[0] - logs[1], -60, 60)))

    def update(self, pairs: np.ndarray, total: np.ndarray, trees: bool) -> None:
        """From class-weighted counts: pairs[c, i, j] documents where i and j fire (on the diagonal, i), total[c] documents."""
        n = len(self.parent)
        self.prior = float(np.clip(total[1] / total.sum(), 1e-4, 0.5))
        one = np.einsum("cii->ci", pairs)
        if trees:
            info = np.zeros((n, n))
            for c in (0, 1):
                t = total[c] + 4.0
                a = (one[c] + 2) / t
                both = (pairs[c] + 1) / t
                for x in (0, 1):
                    for y in (0, 1):
                        joint = both if x and y else a[:, None] - both if x else a[None] - both if y else 1 - a[:, None] - a[None] + both
                        joint = np.maximum(joint, 1e-12)
                        alone = (a if x else 1 - a)[:, None] * (a if y else 1 - a)[None]
                        info += total[c] / total.sum() * joint * np.log(joint / alone)
            self.parent = widest_tree(info)
        for c in (0, 1):
            up = np.maximum(self.parent, 0)
            with_up, up_fires = pairs[c][np.arange(n), up], one[c][up]
            fires = np.where(self.parent >= 0, one[c] - with_up, one[c])
            rest = np.where(self.parent >= 0, total[c] - up_fires, total[c])
            base = (one[c] + 0.5) / (total[c] + 1.0)  # few documents with the parent: near the voter's own rate
            self.table[c, :, 0] = (fires + 2 * base) / (rest + 2)
            self.table[c, :, 1] = np.where(self.parent >= 0, (with_up + 2 * base) / (up_fires + 2), base)
        self.table = np.clip(self.table, 1e-5, 1 - 1e-5)


def widest_tree(info: np.ndarray, least: float = 1e-4) -> np.ndarray:
    """Parents in the spanning forest of the largest mutual information; links below ``least`` are left out."""
    n = len(info)
    parent, best, link, inside = np.full(n, -1), np.full(n, -np.inf), np.full(n, -1), np.zeros(n, bool)
    for _ in range(n):
        i = int(np.where(inside, -np.inf, np.where(np.isinf(best), -1e300, best)).argmax())
        inside[i] = True
        parent[i] = link[i] if best[i] > least else -1
        closer = ~inside & (info[i] > best)
        best[closer], link[closer] = info[i][closer], i
    return parent


def fit_label_model(patterns: DataFrame, polarity: list[int], anchors: list[tuple[int, bool]], share: float, rounds: int = 8) -> LabelModel:
    """From (votes, n) of all documents, and the votes of the labelled sample. Each round is one job over the patterns; what comes back is a pair table of each class.

    The sample's documents have their class, and weigh as much as all others, the classes by their share of the labels: so a class is what the labels say, and
    not just any division of the votes.
    """
    model, n = LabelModel(polarity), len(polarity)
    marks = np.array([t for _, t in anchors], bool)
    signs = fired_of(np.array([v for v, _ in anchors], np.int64), n)

    def learn(pairs: np.ndarray, total: np.ndarray, trees: bool) -> None:
        everything = total.sum() or float(len(anchors))
        for c, part in enumerate((1 - share, share)):
            if (of := signs[marks == bool(c)].astype(float)).size:
                pairs[c] += of.T @ of * (everything * part / len(of))
                total[c] += everything * part
        if everything:
            model.update(pairs, total, trees)

    if len(set(marks.tolist())) == 2:
        learn(np.zeros((2, n, n)), np.zeros(2), trees=False)
    for done in range(rounds):

        def weigh(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            pairs, total = np.zeros((2, n, n)), np.zeros(2)
            for batch in batches:
                for at in range(0, batch.num_rows, 2000):
                    some = batch.slice(at, 2000)
                    fired = fired_of(some.column(0).to_numpy(zero_copy_only=False), n)
                    count = some.column(1).to_numpy(zero_copy_only=False).astype(float)
                    q = model.posterior(fired)
                    for c, w in enumerate((count * (1 - q), count * q)):
                        pairs[c] += (fired * w[:, None]).T @ fired
                        total[c] += w.sum()
            flat = np.concatenate([pairs.ravel(), total])
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(flat))), pa.array(flat)], names=["at", "value"])

        sums = np.zeros(2 * n * n + 2)
        for at, value in patterns.mapInArrow(weigh, "at long, value double").groupBy("at").agg(F.sum("value")).collect():  # two tables of voters by voters
            sums[at] = value
        learn(sums[:-2].reshape(2, n, n), sums[-2:], trees=done >= 1)
    return model


def fired_of(bits: np.ndarray, n: int) -> np.ndarray:
    return ((bits.astype(np.int64)[:, None] >> np.arange(n)) & 1).astype(bool)


def vote_patterns(docs: DataFrame, lexicon: list[str]) -> DataFrame:
    """(votes, n) over all documents, stored."""
    small_batches(docs.sparkSession)

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters, seen = Voters(lexicon), Counter()

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(seen), pa.int64()), pa.array(list(seen.values()), pa.int64())], names=["votes", "n"])
            seen.clear()
            return made

        for batch in sliced(batches):
            seen.update(voters.votes(t or "") for t in batch.column(0).to_pylist())
            if len(seen) > 100_000:
                yield batch_of()
        yield batch_of()
        trim()

    return stored(docs.select("text").mapInArrow(cast, "votes long, n long").groupBy("votes").agg(F.sum("n").alias("n")))


def sample_votes(sample: DataFrame, lexicon: list[str]) -> list[tuple[int, bool]]:
    """(votes, toxic) of the sample, which its limit bounds."""

    def cast(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in sliced(batches):
            yield pa.RecordBatch.from_arrays([pa.array([voters.votes(t) for t in batch.column(0).to_pylist()], pa.int64()), batch.column(1)], names=["votes", "toxic"])

    return [tuple(r) for r in sample.select("text", "toxic").mapInArrow(cast, "votes long, toxic boolean").collect()]


def with_posterior(sample: DataFrame, lexicon: list[str], model: LabelModel) -> DataFrame:
    def label(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        voters = Voters(lexicon)
        for batch in sliced(batches):
            q = model.posterior(fired_of(np.array([voters.votes(t) for t in batch.column(0).to_pylist()], np.int64), len(model.parent)))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(q, pa.float64())], names=["text", "q"])

    return sample.select("text").mapInArrow(label, "text string, q double")


def train_classifier(sample: DataFrame, max_terms: int, rounds: int = 300, penalty: float = 5e-5) -> tuple[list[str], np.ndarray, float]:
    """(terms, weights, bias) of a logistic regression on the presence of terms, from (text, q)."""
    total = sample.agg(F.count("*").alias("n"), F.sum("q").alias("q")).first()
    n, share = total["n"], (total["q"] or 0.0) / max(total["n"], 1)
    if not n:
        return [], np.zeros(0), float(np.log(0.05))
    # how far the posterior of a term's documents is from the usual one, in standard deviations
    spread = max(share * (1 - share), 1e-6) ** 0.5
    far = (F.col("hits") - share * F.col("n")) / (spread * F.sqrt("n"))
    terms = [r["term"] for r in _counted(sample, "q").where("n >= 2").orderBy(F.abs(far).desc(), "term").limit(max_terms).collect()]

    def present(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Terms(terms)
        for batch in sliced(batches):
            found = [sorted(known.of(t)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.int32())), batch.column(1)], names=["found", "q"])

    got = sample.mapInArrow(present, "found array<int>, q double").toArrow()  # 2 * sample_limit rows of max_terms numbers at most
    lists = got.column("found").combine_chunks()
    q = got.column("q").to_numpy()
    ends = np.diff(lists.offsets.to_numpy())
    at, row = lists.flatten().to_numpy().astype(np.int64), np.repeat(np.arange(len(q)), ends)
    # Gradients weigh both classes alike; a term's step is by how many rows have it.
    weight = np.where(q > 0.5, 0.5 / max((q > 0.5).mean(), 1e-3), 0.5 / max((q <= 0.5).mean(), 1e-3))
    weight /= weight.mean()
    step = 4.0 / (1.0 + np.sqrt(np.bincount(at, minlength=len(terms)) / len(q) * max(ends.mean(), 1.0)))
    w, b = np.zeros(len(terms)), float(np.log((share + 1e-3) / (1 - share + 1e-3)))
    v, vb, momentum = w.copy(), b, 0.0
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(np.bincount(row, v[at], minlength=len(q)) + vb, -30, 30)))
        error = weight * (p - q) / len(q)
        new = v - step * np.bincount(at, error[row], minlength=len(terms))
        new = np.sign(new) * np.maximum(np.abs(new) - step * penalty, 0)
        nb = vb - 0.5 * error.sum()
        following = (1 + (1 + 4 * momentum**2) ** 0.5) / 2
        v, vb = new + (momentum - 1) / following * (new - w) if momentum else new, nb + ((momentum - 1) / following * (nb - b) if momentum else 0.0)
        w, b, momentum = new, nb, following
    return terms, w, b


def score_documents(docs: DataFrame, terms: list[str], weights: np.ndarray, bias: float, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) of each document."""
    small_batches(docs.sparkSession)
    kept = np.flatnonzero(weights)
    shared = docs.sparkSession.sparkContext.broadcast(([terms[i] for i in kept], weights[kept]))
    kind = docs.schema[id_col].dataType.simpleString()

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, w = shared.value
        known = Terms(names)
        for batch in sliced(batches):
            sums = np.array([w[found].sum() if (found := sorted(known.of(t or ""))) else 0.0 for t in batch.column(1).to_pylist()])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(1 / (1 + np.exp(-np.clip(sums + bias, -60, 60))), pa.float64())], names=["id", "score"])
        trim()

    return docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).mapInArrow(score, f"id {kind}, score double").withColumnRenamed("id", id_col)


def fit(docs: DataFrame, labels: DataFrame, sample_limit: int = 5_000, max_voters: int = 50, max_terms: int = 3_000) -> tuple[list[str], np.ndarray, float]:
    """The classifier, from labels of rows that aren't held out and the votes on all documents."""
    small_batches(docs.sparkSession)
    sample, share = labelled_sample(docs, labels, sample_limit)
    lexicon = mine_lexicon(sample, max_voters)
    polarity = [1] * len(lexicon) + [p for _, p in PATTERNS]
    model = fit_label_model(vote_patterns(docs, lexicon), polarity, sample_votes(sample, lexicon), share)
    return train_classifier(stored(with_posterior(sample, lexicon, model)), max_terms)


def op12_toxicity(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    scored = score_documents(docs, *fit(docs, labels))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
