"""Conversation repair, toxicity and the filter audit: hard cases and brute force."""

import hashlib
import random
import re
import sys
import zlib
from functools import cache
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from scanloom.llm import conversations, filters, toxicity

CONVERSATIONS = "conv_id long, turn long, role string, text string, size int, row string, fault int"


def walk(turns):
    """(cost, audit, repaired) by trying every edit of every turn: turns are (role, text, fault)."""

    @cache
    def best(i, last, inserted):
        """The least (cost, edits, turns) from turn i on, after a retained role; at most two turns are inserted in one place."""
        found = [(0, "", ())] if i == len(turns) and last in ("", "a") else []
        if i < len(turns):
            role, text, fault = turns[i]
            cost, edits, said = best(i + 1, last, 0)
            found.append((cost + 4, "D" + edits, said))
            if fault not in ("blank", "duplicate"):
                for to, edit in ((role, "K"), ("user", "R"), ("assistant", "R")):
                    if to and last + to[0] in ("s", "u", "su", "au", "ua"):
                        cost, edits, said = best(i + 1, to[0], 0)
                        found.append((cost + 3 * (edit == "R") + 3 * (fault == "truncated"), edit + edits, ((to, text), *said)))
        if inserted < 2:
            to = "assistant" if last == "u" else "user"
            cost, edits, said = best(i, to[0], inserted + 1)
            found.append((cost + 3, "I" + edits, ((to, ""), *said)))
        return min(found) if found else (10**9, "~", ())

    sys.setrecursionlimit(20_000)
    return best(0, "", 0)


def brute(rows):
    """The contract by plain loops."""
    out, by = {}, {}
    for conv, turn, role, text, *_ in rows:
        out.setdefault(conv, None)
        h = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if h:
            text = "" if h == 1 else re.sub("[.!?]", "", text) if h == 2 else text
            by.setdefault(conv, []).extend([(turn, "user" if h == 4 else role, text)] * (1 + (h == 3)))
    for conv in out:
        rs = sorted(by.get(conv, []), key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2][:64], hashlib.sha256(r[2].encode()).digest()[:16]))
        seen, turns, illegal = set(), [], 0
        for _, role, text in rs:
            end = text.rstrip(" \t\n\x0b\x0c\r")
            fault = "blank" if not end else "duplicate" if (role, text) in seen else "truncated" if end[-1] not in ".!?" else ""
            seen.add((role, text))
            turns.append((role, text, fault))
        for a, b in zip(turns, turns[1:]):
            illegal += a[0][:1] + b[0][:1] not in ("su", "ua", "au")
        numbers = [t for t, _, _ in rs if t is not None]
        gaps = max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0
        cost, audit, said = walk(tuple(turns))
        text = "\n".join(f"{r}:{t}" for r, t in said)
        out[conv] = (gaps, *(sum(t[2] == f for t in turns) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256(text.encode()).hexdigest())
    return out


def rows_of(rng, conv, n, roles):
    texts = ["Yes.", "No!", "cut off", "Fine.", "", " \t", None, "Why?", "ok.", "é漢.", "more words and no end", "x" * 70 + "a.", "x" * 70 + "b."]
    return [(conv, rng.choice([i, i, i, i, None, i // 2]), rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"word {rng.random()}.", 1, "clash", 2) for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_conversations_against_brute_force(spark, seed):
    rng = random.Random(seed)
    rows = []
    for conv in range(60):
        roles = rng.choice([["user", "assistant"], ["system", "user", "assistant"], ["user"], ["user", "assistant", "tool", "", None, "umpire"]])
        rows += rows_of(rng, conv, rng.randint(1, 12), roles)
    rows += rows_of(rng, None, 9, ["user", "assistant"])
    rows += rows_of(rng, 1000, 300, ["user", "assistant", "system"])  # cut into segments
    rows += rows_of(rng, 1001, 120, ["user"])
    rows += [rows[5]] * 30
    rng.shuffle(rows)
    got = conversations.op11_conversations(spark.createDataFrame(rows, CONVERSATIONS).repartition(3)).collect()
    want = brute(rows)
    assert len(got) == len(want)
    for r in got:
        assert tuple(r)[1:] == want[r["conv_id"]], r["conv_id"]


def test_conversations_odd_tables(spark):
    empty = spark.createDataFrame([], CONVERSATIONS)
    assert conversations.op11_conversations(empty).collect() == []
    # all rows of a conversation dropped: zeros and the digest of nothing
    turn = next(t for t in range(200) if zlib.crc32(f"7:{t}".encode()) % 20 == 0)
    got = conversations.op11_conversations(spark.createDataFrame([(7, turn, "user", "Hi.", 1, "r", 0)], CONVERSATIONS)).collect()
    assert [tuple(r) for r in got] == [(7, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]


def test_repaired_turns(spark):
    rows = [(1, 0, "system", "Be kind."), (1, 1, "user", "Hi."), (1, 2, "user", "Are you there?"), (1, 3, "assistant", "Yes."), (2, 0, "assistant", "cut")]
    turns = conversations.numbered_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    known = conversations.audits(conversations.segments(conversations.with_copies(turns)))
    got = [tuple(r) for r in conversations.repaired_turns(turns, known).orderBy("conv_id", "position").collect()]
    assert got == [
        (1, 0, "system", "Be kind.", "K"), (1, 1, "user", "Hi.", "K"), (1, 2, "assistant", "", "I"), (1, 3, "user", "Are you there?", "K"), (1, 4, "assistant", "Yes.", "K"),
    ]


def test_segments_compose(spark):
    rng = random.Random(5)
    for _ in range(60):
        turns = [(rng.randint(0, 3), rng.choice([0, 0, 0, 1, 2])) for _ in range(rng.randint(1, 40))]
        reached = [(0, 0, ""), None, None, None]
        at = 0
        while at < len(turns):
            size = rng.randint(1, 9)
            costs, audits = [], []
            for entry in range(4):
                c, a = conversations.least_audits(turns[at : at + size], entry)
                costs += c
                audits += a
            reached = conversations.compose(reached, costs, audits)
            at += size
        costs, audits = conversations.least_audits(turns, 0)
        whole = [(c, a) if c >= 0 else None for c, a in zip(costs, audits)]
        assert [(x[0], x[2]) if x else None for x in reached] == whole


DOCS = "doc_id long, text string, source string, mask int, n long, good boolean"


def audit_by_loops(docs, labels):
    good, toxic = {i for i, q, _ in labels if q == 1 and i is not None}, {i for i, _, t in labels if t == 1 and i is not None}
    least = {}
    for i, t, *_ in docs:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = {}
    rows = []
    for i, t, s, *_ in docs:
        t = t or ""
        w = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = {"A"} if len(w) < 50 else set()
        fails |= {"B"} if 100 * len(set(w)) < 65 * len(w) else set()
        fails |= {"C"} if 100 * len(re.findall("[A-Z]", t)) > 5 * len(t) else set()
        fails |= {"D"} if re.search(r"[#$%&*|]", t) else set()
        fails |= {"E"} if i is not None and i > least[t] else set()
        rows.append((s or "", fails, i in good, i in toxic))
    for part in {r[0] for r in rows}:
        shapley = dict.fromkeys("ABCDE", 0)
        for order in permutations("ABCDE"):
            left = [r for r in rows if r[0] == part]
            gone = []
            for k, f in enumerate(order):
                lost = [r for r in left if f in r[1]]
                redundant = sum(f in r[1] for r in gone)
                left = [r for r in left if f not in r[1]]
                gone += lost
                shapley[f] += len(lost)
                out[part, "".join(order), k + 1] = [len(left), len(lost), redundant, sum(r[1] == {f} for r in rows if r[0] == part), sum(r[2] for r in lost), sum(r[3] for r in lost)]
        for (p, order, k), values in out.items():
            if p == part:
                values.append(shapley[order[k - 1]])
    return {k: tuple(v) for k, v in out.items()}


def test_filters_against_loops(spark):
    rng = random.Random(9)
    words = ["alpha", "Beta", "GAMMA", "x", "été", "#tag", "a|b", "漢字"] + [f"w{i}" for i in range(80)]
    texts = [None, "", " \n", "one"] + [" ".join(rng.choice(words) for _ in range(rng.choice([5, 60, 90]))) for _ in range(30)] + ["long " * 30_000]
    rows = [(i, rng.choice(texts), rng.choice(["a", "b", None, ""]), 1, 2, True) for i in range(150)]
    rows += [(None, texts[8], "a", 1, 2, True)] * 5 + [rows[3]] * 4 + [(200 + i, "the same text", "b", 1, 2, None) for i in range(40)]
    labels = [(i, rng.choice([0, 1, None]), rng.choice([0, 1, None])) for i in range(100)] + [(None, 1, 1), (5, 1, 0), (5, 0, 1)]
    got = filters.op13_filters(spark.createDataFrame(rows, DOCS).repartition(3), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()
    want = audit_by_loops(rows, labels)
    assert len(got) == len(want)
    assert {tuple(r)[:3]: tuple(r)[3:] for r in got} == want
    none = filters.op13_filters(spark.createDataFrame([], DOCS), spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert none.collect() == []


def test_toxicity_finds_planted_words(spark):
    rng = random.Random(4)
    plain = [f"{a}{b}{c}" for a in ("tor", "mel", "san", "vi", "ku") for b in ("an", "es", "or", "il") for c in ("a", "en", "ish", "um")]
    bad = ["grumblefax", "snarlpot", "vexlingen"]
    rows, labels = [], []
    for i in range(900):
        text = [rng.choice(plain) for _ in range(rng.randint(5, 150))]
        toxic = i % 7 == 0
        if toxic:
            for _ in range(rng.randint(1, 4)):
                text.insert(rng.randrange(len(text)), rng.choice(bad) + rng.choice(["", ",", "s", "!"]))
        rows.append((i, " ".join(text), "en", 0.5, 1))
        if i % 3 != 2:
            labels.append((i, 1, int(toxic)))
    rows += [(1000, None, "en", 0.5, 1), (1001, "", "en", 0.5, 1), (None, "Snarlpot! grumblefax", "en", 0.5, 1), rows[7], (1002, "tora " * 20_000, "en", 0.5, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, score double, toxic int").repartition(3)
    known = spark.createDataFrame([*labels, (None, 1, 1), (3, 1, None)], "doc_id long, quality int, toxic int")
    got = toxicity.op12_toxicity(docs, known).collect()
    assert len(got) == len(rows)
    held = [r for r in got if r["held_out"]]
    assert {r["doc_id"] for r in held} == {i for i, *_ in rows if i is not None and zlib.crc32(str(i).encode()) % 3 == 1}
    right = [r["predicted"] == int(r["doc_id"] is not None and r["doc_id"] < 900 and r["doc_id"] % 7 == 0) for r in held]
    assert sum(right) >= 0.99 * len(right)
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in got)
    by = {r["doc_id"]: r for r in got}
    assert by[1000]["score"] == by[1001]["score"] < 0.5 < by[None]["score"]
    # the score doesn't depend on labels of held-out rows
    turned = known.withColumn("toxic", F.when(toxicity.held_out(F.col("doc_id")), 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.op12_toxicity(docs, turned).collect()}
    assert all(abs(again[i] - r["score"]) < 1e-9 for i, r in by.items())


def test_toxicity_odd_tables(spark):
    docs = spark.createDataFrame([(1, "a b"), (2, None)], "doc_id long, text string")
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert [r["predicted"] for r in toxicity.op12_toxicity(docs, labels).collect()] == [0, 0]
    assert toxicity.op12_toxicity(docs.limit(0), labels).collect() == []


def test_widest_tree_has_no_circle():
    import numpy as np

    info = np.random.default_rng(1).random((20, 20))
    info = info + info.T
    parent = toxicity.widest_tree(info)
    assert (parent < 0).sum() == 1
    for i in range(20):
        seen = set()
        while i >= 0:
            assert i not in seen
            seen.add(i)
            i = parent[i]
