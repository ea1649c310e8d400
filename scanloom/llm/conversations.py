"""Conversation structure repair: a dynamic programme over the retained turns, and the turns as repaired.

A repaired conversation is empty, or an optional system turn and then pairs of user and assistant. Turns are kept, given the role of user or assistant,
or deleted, and empty turns are inserted. Blank turns and turns whose role and text were seen earlier must go; a truncated turn that stays costs extra.

The programme runs over the turns that stay. Its state is the role of the last one (none, system, user, assistant). Going from a retained turn to the next, the
turns between are deleted, and the two roles alone say how many turns must be inserted. With deletions as prefix sums, the least of (cost - deletions so far)
of each state is all that the next turn needs, so a turn takes constant time. Of equal costs the least audit wins, the string of the edits' initials. No audit
of a state is the beginning of another one's, since all cover the same turns and end in one; so four ranks, updated with each turn, stand for the strings.

A conversation may be any part of the table. Turns are dealt by range over (conversation, turn, ...), and what a task holds of a conversation is a segment: costs and
audits from each state before it to each state after it. Segments compose as matrices do, with the same order of costs and audits, so a long conversation
is worked on by many tasks, on records of some hundred bytes a turn, without texts. Copies are found by counts of (conversation, role, digest), of which only repeated ones
are joined. Then a second pass streams the turns of each conversation once along its audit. That pass is one stream a conversation, as the digest of a
repaired conversation is sequential; it holds one audit (a character a turn, and one value of the result) and no texts.

Order and defined results: turns are taken by number, null first; ties by role, then by the first 64 characters of the text, then by its digest, so the order of
rows in files doesn't matter. A null role or text is one space. A null conversation is one like any other. Roles count by their first character; an empty role,
or one of another letter, can't be kept. Repeated rows are copies. Extra columns don't matter. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .words import sliced, small_batches, stored

REROLE, DELETE, INSERT, TRUNCATED = 3, 4, 3, 3
NONE, SYSTEM, USER, ASSISTANT = range(4)
_STATE = {"s": SYSTEM, "u": USER, "a": ASSISTANT}
_NAMES = {USER: "user", ASSISTANT: "assistant"}
_LEGAL = {(SYSTEM, USER), (USER, ASSISTANT), (ASSISTANT, USER)}
#: Inserted turns between the last retained role and the next one; pairs that aren't here can't be.
_INSERTS = {
    (NONE, SYSTEM): 0, (NONE, USER): 0, (SYSTEM, USER): 0, (ASSISTANT, USER): 0, (USER, USER): 1,
    (USER, ASSISTANT): 0, (NONE, ASSISTANT): 1, (SYSTEM, ASSISTANT): 1, (ASSISTANT, ASSISTANT): 1,
}
#: Inserted turns after the last retained one.
_CLOSING = {NONE: 0, SYSTEM: 2, USER: 1, ASSISTANT: 0}
_FAR = 1 << 60
_SPACE = " \t\n\x0b\x0c\r"


def _moves() -> dict[tuple[int, bool], list[list[tuple[int, int, str]]]]:
    """For a turn's role and whether it is truncated: for each state after it, (state before, cost less the deletion saved, edits)."""
    out = {}
    for role in range(4):
        for cut in (False, True):
            to: list[list[tuple[int, int, str]]] = [[] for _ in range(4)]
            for (before, after), inserts in _INSERTS.items():
                if after == role or after != SYSTEM:
                    cost = INSERT * inserts + TRUNCATED * cut + REROLE * (after != role) - DELETE
                    to[after].append((before, cost, "I" * inserts + ("K" if after == role else "R")))
            out[role, cut] = to
    return out


_MOVES = _moves()


def least_audits(turns: list[tuple[int, int]], entry: int) -> tuple[list[int], list[str]]:
    """Least cost, and least audit of that cost, to each state after the turns, from one state before them.

    A turn is (state of its role, fault), the fault 0 none, 1 to be deleted, 2 truncated.
    """
    low, rank = [_FAR] * 4, [0] * 4
    low[entry] = 0  # cost less the deletion of all turns so far
    steps: list[list[tuple[int, str]] | None] = []
    for role, fault in turns:
        if fault == 1:
            steps.append(None)  # deleted in every state
            continue
        best = []
        for state, moves in enumerate(_MOVES[role, fault == 2]):
            choice = (low[state], rank[state], "D", state)
            for before, cost, edits in moves:
                if low[before] < _FAR:
                    choice = min(choice, (low[before] + cost, rank[before], edits, before))
            best.append(choice)
        low = [c[0] for c in best]
        for place, state in enumerate(sorted(range(4), key=lambda s: best[s][1:3])):
            rank[state] = place
        steps.append([(c[3], c[2]) for c in best])
    costs, audits = [x + DELETE * len(turns) if x < _FAR else -1 for x in low], []
    for state in range(4):
        edits = []
        if costs[state] >= 0:
            at = state
            for step in reversed(steps):
                at, edit = (at, "D") if step is None else step[at]
                edits.append(edit)
        audits.append("".join(reversed(edits)))
    return costs, audits


def compose(reached: list[tuple[int, int, str] | None], costs: list[int], audits: list[str]) -> list[tuple[int, int, str] | None]:
    """(cost, rank, audit) of each state after one more segment, whose costs and audits are listed by state before and state after."""
    best: list = [None] * 4
    for before, known in enumerate(reached):
        for after in range(4):
            if known and costs[4 * before + after] >= 0:
                choice = (known[0] + costs[4 * before + after], known[1], audits[4 * before + after], known[2])
                if best[after] is None or choice < best[after]:
                    best[after] = choice
    order = sorted((s for s in range(4) if best[s]), key=lambda s: best[s][1:3])
    out: list = [None] * 4
    for place, state in enumerate(order):
        cost, _, audit, before = best[state]
        out[state] = (cost, place, before + audit)
    return out


def close(reached: list[tuple[int, int, str] | None]) -> tuple[int, str]:
    """The least (cost, audit) of a whole conversation."""
    ends = [(x[0] + INSERT * _CLOSING[s], x[1], x[2] + "I" * _CLOSING[s]) for s, x in enumerate(reached) if x]
    cost, _, audit = min(ends)
    return cost, audit


def damage(rows: DataFrame) -> DataFrame:
    """Faults put into conversations by the checksum of "conv_id:turn": dropped rows, emptied texts, lost sentence ends, repeated rows, wrong roles."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    fault = F.crc32(key) % 20
    text, role = F.coalesce("text", F.lit(" ")), F.coalesce("role", F.lit(" "))
    text = F.when(fault == 1, "").when(fault == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)
    times = F.when(fault == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    out = rows.where(fault != 0).select("conv_id", "turn", F.when(fault == 4, "user").otherwise(role).alias("role"), text.alias("text"), F.explode(times).alias("time"))
    return out.drop("time")


def _state(role: Column) -> Column:
    first = F.substring(role, 1, 1)
    return F.when(first == "s", SYSTEM).when(first == "u", USER).when(first == "a", ASSISTANT).otherwise(NONE)


_ORDER = ["conv_id", "numbered", "turn", "role", "head", "digest", "row"]


def numbered_turns(rows: DataFrame) -> DataFrame:
    """The turns with the columns that order them, stored, so that a row's number stays the same in all later steps."""
    end = F.rtrim(F.col("text"), F.lit(_SPACE))
    told = rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))
    return stored(told.select(
        "conv_id", F.col("turn").isNotNull().alias("numbered"), "turn", "role", F.substring("text", 1, 64).alias("head"),
        F.unhex(F.substring(F.sha2("text", 256), 1, 32)).alias("digest"), F.monotonically_increasing_id().alias("row"),
        F.when(end == "", 1).when(F.right(end, F.lit(1)).isin(".", "!", "?"), 0).otherwise(2).alias("fault"), "text",
    ))


def with_copies(turns: DataFrame) -> DataFrame:
    """The turns without texts, copies of earlier ones marked by fault 3."""
    short = turns.drop("text")
    at_turn = short.where("fault <> 1").groupBy("conv_id", "role", "digest", "turn").agg(F.count("*").alias("n"), F.min("row").alias("row"))
    unnumbered = F.min(F.when(F.col("turn").isNull(), F.col("row")))
    first = at_turn.groupBy("conv_id", "role", "digest").agg(F.sum("n").alias("n"), F.coalesce(unnumbered, F.min_by("row", "turn")).alias("first")).where("n > 1")
    marked = short.alias("t").join(first.alias("c"), _same("t", "c", "conv_id", "role", "digest") & (F.col("t.fault") != 1), "left")
    return marked.select(*(f"t.{c}" for c in _ORDER), F.when(F.col("t.row") != F.col("c.first"), 3).otherwise(F.col("t.fault")).alias("fault"))


def _same(left: str, right: str, *names: str) -> Column:
    test = F.lit(True)
    for n in names:
        test = test & F.col(f"{left}.{n}").eqNullSafe(F.col(f"{right}.{n}"))
    return test


_COUNTS = ["turns", "blank", "duplicate", "truncated", "illegal"]


def segments(turns: DataFrame) -> DataFrame:
    """What each task of the range-dealt turns holds of each conversation: counts, ends, and costs and audits by states before and after."""
    kind = turns.schema["conv_id"].dataType.simpleString()
    dealt = turns.repartitionByRange(*_ORDER).sortWithinPartitions(*_ORDER).select("conv_id", "turn", _state(F.col("role")).alias("state"), "fault")
    schema = f"conv_id {kind}, part int, {', '.join(f'{c} long' for c in _COUNTS)}, first_state int, last_state int, least long, most long, costs array<long>, audits array<string>"

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, arrow, made, held = TaskContext.get().partitionId(), None, [], 0
        now: dict | None = None
        first = True

        def ended() -> None:
            nonlocal first
            rows = now["rows"]
            # Only the first conversation of a task can have begun in another one.
            costs, audits = [], []
            for entry in range(4):
                c, a = least_audits(rows, entry) if first or entry == NONE else ([-1] * 4, [""] * 4)
                costs += c
                audits += a
            first = False
            made.append((now["id"], part, now["numbers"], *now["faults"], now["illegal"], now["first"], now["last"], now["least"], now["most"], costs, audits))

        def batch_of() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names=names)

        names = ["conv_id", "part", *_COUNTS, "first_state", "last_state", "least", "most", "costs", "audits"]
        for batch in batches:
            arrow = batch.schema.field(0).type
            types = [arrow, pa.int32(), *[pa.int64()] * 5, pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())]
            for conv, turn, state, fault in zip(*(batch.column(i).to_pylist() for i in range(4)), strict=True):
                if now is None or conv != now["id"]:
                    if now is not None:
                        ended()
                        held += len(now["rows"])
                        if held > 20_000:
                            yield batch_of()
                            made.clear()
                            held = 0
                    now = {"id": conv, "rows": [], "numbers": 0, "faults": [0, 0, 0], "illegal": 0, "first": state, "last": None, "least": turn, "most": None}
                if turn is not None and turn != now["most"]:
                    now["numbers"] += 1
                    now["most"] = turn
                    now["least"] = turn if now["least"] is None else now["least"]
                if now["last"] is not None and (now["last"], state) not in _LEGAL:
                    now["illegal"] += 1
                now["last"] = state
                if fault:
                    now["faults"][(0, 0, 2, 1)[fault]] += 1
                now["rows"].append((state, (0, 1, 2, 1)[fault]))
        if now is not None:
            ended()
            yield batch_of()

    return dealt.mapInArrow(work, schema)


def audits(segments: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit) of each conversation, its segments composed in order."""
    kind = segments.schema["conv_id"].dataType.simpleString()
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, reached, out = None, [], []

        def ended() -> tuple:
            cost, audit = close(reached)
            gaps = now["most"] - now["least"] + 1 - now["turns"] if now["least"] is not None else 0
            return now["conv_id"], gaps, now["blank"], now["duplicate"], now["truncated"], now["illegal"], cost, audit

        for batch in batches:
            types = [batch.schema.field(0).type, *[pa.int64()] * 6, pa.string()]
            for row in batch.to_pylist():
                if now is None or row["conv_id"] != now["conv_id"]:
                    if now is not None:
                        out.append(ended())
                    now, reached = row, [(0, 0, ""), None, None, None]
                else:
                    now["turns"] += row["turns"] - (row["least"] is not None and row["least"] == now["most"])
                    now["illegal"] += row["illegal"] + ((now["last_state"], row["first_state"]) not in _LEGAL)
                    for c in ("blank", "duplicate", "truncated"):
                        now[c] += row[c]
                    now["last_state"] = row["last_state"]
                    now["least"] = row["least"] if now["least"] is None else now["least"]
                    now["most"] = now["most"] if row["most"] is None else row["most"]
                reached = compose(reached, row["costs"], row["audits"])
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)
                out = []
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(ended(), types, strict=True)], names=names)

    dealt = segments.repartition("conv_id").sortWithinPartitions("conv_id", "part")
    return dealt.mapInArrow(work, f"conv_id {kind}, {', '.join(f'{c} long' for c in names[1:-1])}, audit string")


def edited(turns: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """(role, text, edit) of each repaired turn, along the audit; deleted turns don't come."""
    state, at, end = NONE, 0, len(audit)

    def inserted() -> Iterator[tuple[str, str, str]]:
        nonlocal state, at
        while at < end and audit[at] == "I":
            state, at = ASSISTANT if state == USER else USER, at + 1
            yield _NAMES[state], "", "I"

    for role, text in turns:
        yield from inserted()
        edit, at = audit[at], at + 1
        if edit == "K":
            state = _STATE[role[0]]
            yield role, text, edit
        elif edit == "R":
            state = ASSISTANT if state == USER else USER
            yield _NAMES[state], text, edit
    yield from inserted()


def _streamed(turns: DataFrame, known: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Turns after the record of their conversation, which has its audit as text; conversations without a turn have a record without one."""
    kept = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    rows = turns.select(F.lit(2).alias("kind"), *_ORDER, "text", *(F.lit(None).cast("long").alias(c) for c in kept))
    blank = {c: F.lit(None).cast(turns.schema[c].dataType).alias(c) for c in _ORDER[1:]}
    rows = rows.unionByName(known.select(F.lit(1).alias("kind"), "conv_id", *blank.values(), F.col("audit").alias("text"), *kept))
    if ids is not None:
        rows = rows.unionByName(ids.select("conv_id").distinct().select(F.lit(0).alias("kind"), "conv_id", *blank.values(), F.lit("").alias("text"), *(F.lit(0).cast("long").alias(c) for c in kept)))
    ordered = rows.repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER[1:])
    return ordered.select("conv_id", "kind", "role", "text", *kept)


def _conversations(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(id, record, turns) of each conversation of a stream; the turns are read as they are asked for."""
    rows = (row for batch in sliced(batches) for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    ahead = next(rows, None)
    while ahead is not None:
        conv, record = ahead[0], ahead
        ahead = next(rows, None)
        if ahead is not None and ahead[0] == conv and ahead[1] == 1:
            record, ahead = ahead, next(rows, None)

        def turns() -> Iterator[tuple[str, str]]:
            nonlocal ahead
            while ahead is not None and ahead[0] == conv and ahead[1] == 2:  # noqa: B023
                yield ahead[2], ahead[3]
                ahead = next(rows, None)

        yield conv, record, turns()


def repaired_turns(turns: DataFrame, known: DataFrame) -> DataFrame:
    """(conv_id, position, role, text, edit) of every turn of the repaired conversations, from numbered_turns() and audits()."""
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def batch_of() -> pa.RecordBatch:
            made = pa.RecordBatch.from_pylist([dict(zip(("conv_id", "position", "role", "text", "edit"), r, strict=True)) for r in out], schema=schema)
            out.clear()
            return made

        batches = iter(batches)
        if (head := next(batches, None)) is None:
            return
        schema = pa.schema([("conv_id", head.schema.field(0).type), ("position", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())])
        for conv, record, said in _conversations(b for some in ([head], batches) for b in some):
            for position, turn in enumerate(edited(said, record[3])):
                out.append((conv, position, *turn))
                if len(out) >= 500:
                    yield batch_of()
        if out:
            yield batch_of()

    return _streamed(turns, known, None).mapInArrow(work, f"conv_id {kind}, position long, role string, text string, edit string")


def digests(turns: DataFrame, known: DataFrame, ids: DataFrame | None = None) -> DataFrame:
    """The audits with the SHA-256 of each conversation as repaired, its turns as role:text lines; with ``ids``, also of those that have no turns."""
    small_batches(turns.sparkSession)
    kind = turns.schema["conv_id"].dataType.simpleString()
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batches = iter(batches)
        if (head := next(batches, None)) is None:
            return
        schema = pa.schema([("conv_id", head.schema.field(0).type), *((c, pa.int64()) for c in counts), ("audit", pa.string()), ("repaired_sha256", pa.string())])
        out = []
        for conv, record, said in _conversations(b for some in ([head], batches) for b in some):
            total, between = hashlib.sha256(), b""
            for role, text, _ in edited(said, record[3]):
                total.update(between + role.encode() + b":" + text.encode("utf-8", "surrogatepass"))
                between = b"\n"
            out.append((conv, *record[4:], record[3], total.hexdigest()))
            if len(out) >= 1000:
                yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_pylist([dict(zip(schema.names, r, strict=True)) for r in out], schema=schema)

    return _streamed(turns, known, ids).mapInArrow(work, f"conv_id {kind}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def op11_conversations(rows: DataFrame) -> DataFrame:
    turns = numbered_turns(damage(rows))
    return digests(turns, audits(segments(with_copies(turns))), rows)
