"""Repair of the structure of conversations, solved once per suffix of their role and fault signatures.

A conversation is its rows by turn (nulls first, then role and text). Each row becomes one letter
of the conversation's signature: x where it must go (blank, or role and text seen earlier), else
s, u, a or o for its role's initial (o: any other), in upper case where its text is cut off.
The cheapest edits lead to roles ``(s?(ua)+)?``; they depend on the signature alone.

Signatures are made distinct and sorted from their end, in ranges, so each task meets them as a
suffix-shared automaton: a node is a suffix, and only the path of the present signature is held.
When a signature shares a suffix with the one before it, its nodes stay; each other node is solved
once per grammar state from the node behind it: least cost, the least letter of that cost, and
where it leads. At one node and state different choices begin with different letters, so ASCII
order of whole audits is decided by that letter, and an audit is read off along the path.

Edits: keep (K) costs 0, a new role (R) 1, delete (D) 2, insert an empty user or assistant row (I)
5; a cut-off row that stays adds 5.

A conversation of any length passes as a stream of sorted rows; a task holds one letter a row of
it, and about 40 bytes a row while its signature is solved. Whether a row was seen earlier is a
minimum per (conversation, role, text hash), combined before the shuffle. Equal signatures, of
however many conversations, are one row of the automaton; the join back is an equi-join of one row
a conversation.

Defined cases: a null role or text counts as one space; null turns come first and count for no
gap; null conversation ids are one conversation; rows with ``present`` false only name their
conversation; one without rows has no faults, cost 0 and an empty audit; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
from array import array
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from pagefacts.llm.common import same
from pagefacts.session import cut_lineage

START, SYSTEM, USER, ASSISTANT = range(4)
_NEXT = (USER, USER, ASSISTANT, USER)  # the role that may be inserted or given in each state
_KEEP = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
_ROLE = ("", "system", "user", "assistant")
RENAME, DELETE, INSERT, CUT = 1, 2, 5, 5

BLANK = r"\A[\x20\x09-\x0D]*\z"
ENDED = r"[.!?][\x20\x09-\x0D]*\z"
OUT_ROWS, OUT_BYTES = 1000, 4_000_000


class SuffixPath:
    """The nodes of one signature's suffixes, the empty one first, solved for the four states."""

    def __init__(self):
        self.cost, self.edit, self.goto = array("q", (0, 2 * INSERT, INSERT, 0)), bytearray(b"\0II\0"), bytearray((0, USER, ASSISTANT, 0))
        self.solved = 0

    def cut(self, length: int) -> None:
        for column in (self.cost, self.edit, self.goto):
            del column[4 * (length + 1) :]

    def push(self, letter: str) -> None:
        """Adds the node that reads ``letter`` and then the last node's suffix."""
        behind = self.cost[-4:]
        role, more = letter.lower(), CUT if letter.isupper() else 0
        plain = []
        for state in range(4):
            found = [(DELETE + behind[state], "D", state)]
            if letter != "x":
                if (kept := _KEEP[state].get(role)) is not None:
                    found.append((more + behind[kept], "K", kept))
                found.append((RENAME + more + behind[_NEXT[state]], "R", _NEXT[state]))
            plain.append(min(found))
        best = plain
        for _ in range(3):  # insertions before the row: never more than two help
            best = [min(plain[q], (INSERT + best[_NEXT[q]][0], "I", _NEXT[q])) for q in range(4)]
        for cost, edit, state in best:
            self.cost.append(cost)
            self.edit.append(ord(edit))
            self.goto.append(state)
        self.solved += 1

    def read(self) -> tuple[int, str]:
        """(cost, audit) of the whole signature from the start of the grammar."""
        node, state, audit = len(self.cost) // 4 - 1, START, bytearray()
        cost = self.cost[4 * node + state]
        while edit := self.edit[4 * node + state]:
            audit.append(edit)
            state, node = self.goto[4 * node + state], node - (edit != ord("I"))
        return cost, audit.decode()


def solve(backwards: Iterator[str]) -> Iterator[tuple[str, int, str]]:
    """(signature, cost, audit) of signatures given from their last letter, in sorted order."""
    path, before = SuffixPath(), ""
    for signature in backwards:
        shared = len(os.path.commonprefix((before, signature)))
        path.cut(shared)
        for letter in signature[shared:]:
            path.push(letter)
        before = signature
        yield signature[::-1], *path.read()


def _solved(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, size = [], 0

    def out():
        made = pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*rows, strict=True)], ["signature", "cost", "audit"])
        rows.clear()
        return made

    for row in solve(s for batch in batches for s in batch.column(0).to_pylist()):
        rows.append(row)
        size += len(row[0])
        if len(rows) >= OUT_ROWS or size > OUT_BYTES:
            size = 0
            yield out()
    if rows:
        yield out()


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = list(zip(*rows, strict=True))
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)


def _conversations(batches: Iterator[pa.RecordBatch]):
    """Sorted rows as (conversation, iterator of row dicts), which must be used up in order."""
    def rows():
        for batch in batches:
            names = batch.schema.names
            for values in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                yield dict(zip(names, values, strict=True))

    return groupby(rows(), key=lambda r: r["conv"])


_COUNTS = ("gaps", "blank", "duplicate", "truncated", "illegal")


def _signatures(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows, kind, size = [], None, 0

    def peeked():
        nonlocal kind
        for batch in batches:
            kind = batch.schema.field("conv").type
            yield batch

    def out():
        schema = pa.schema([("conv", kind), *[(c, pa.int64()) for c in _COUNTS], ("signature", pa.string())])
        made = _batch(rows, schema)
        rows.clear()
        return made

    for conv, own in _conversations(peeked()):
        letters, turns, n = bytearray(), 0, dict.fromkeys(_COUNTS, 0)
        first = last = before = initial = None
        for r in own:
            if not r["present"]:
                continue
            if r["turn"] is not None:
                first = r["turn"] if first is None else first
                turns += r["turn"] != last
                last = r["turn"]
            this = (r["turn"], r["role"], r["hash"])
            now = r["role"][:1]
            if initial is not None and initial + now not in ("su", "ua", "au"):
                n["illegal"] += 1
            letter = now if now in ("s", "u", "a") else "o"
            if r["blank"]:
                n["blank"] += 1
                letter = "x"
            elif r["later"] or this == before:
                n["duplicate"] += 1
                letter = "x"
            elif r["cut"]:
                n["truncated"] += 1
                letter = letter.upper()
            letters += letter.encode()
            before, initial = this, now
        if first is not None:
            n["gaps"] = last - first + 1 - turns
        rows.append((conv, *n.values(), letters.decode()))
        size += len(letters)
        if len(rows) >= OUT_ROWS or size > OUT_BYTES:
            size = 0
            yield out()
    if rows:
        yield out()


def edited(audit: str, rows: Iterator[dict]) -> Iterator[tuple[str, str, str]]:
    """(edit, role, text) of what an audit leaves of its conversation's rows, in order."""
    state, edits = START, iter(audit)
    for r in rows:
        edit = next(edits)
        while edit == "I":
            state = _NEXT[state]
            yield "I", _ROLE[state], ""
            edit = next(edits)
        if edit == "K":
            state = _KEEP[state][r["role"][:1]]
            yield "K", r["role"], r["text"]
        elif edit == "R":
            state = _NEXT[state]
            yield "R", _ROLE[state], r["text"]
    for _ in edits:
        state = _NEXT[state]
        yield "I", _ROLE[state], ""


_HEAD = (*_COUNTS, "cost", "audit")


def _applied(whole: bool):
    """Rows of repaired conversations, or one row a conversation with the hash of its repaired text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, kind, size = [], None, 0

        def peeked():
            nonlocal kind
            for batch in batches:
                kind = batch.schema.field("conv").type
                yield batch

        def out():
            if whole:
                rest = [("place", pa.int64()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())]
            else:
                rest = [(c, pa.string() if c == "audit" else pa.int64()) for c in _HEAD] + [("repaired_sha256", pa.string())]
            made = _batch(rows, pa.schema([("conv", kind), *rest]))
            rows.clear()
            return made

        for conv, own in _conversations(peeked()):
            head = next(own)["head"]
            digest, place = hashlib.sha256(), 0
            for edit, role, text in edited(head["audit"], (r for r in own if r["present"])):
                if whole:
                    rows.append((conv, place, edit, role, text))
                    size += len(text)
                    if len(rows) >= OUT_ROWS or size > OUT_BYTES:
                        size = 0
                        yield out()
                else:
                    digest.update(f"{chr(10) * (place > 0)}{role}:{text}".encode())
                place += 1
            if not whole:
                rows.append((conv, *(head[c] for c in _HEAD), digest.hexdigest()))
                if len(rows) >= OUT_ROWS:
                    yield out()
        if rows:
            yield out()

    return run


def _rows(conversations: DataFrame, conv_id: str, turn: str, role: str, text: str, present: str | None) -> DataFrame:
    return conversations.select(
        F.col(conv_id).alias("conv"),
        F.col(turn).cast("long").alias("turn"),
        F.coalesce(F.col(role), F.lit(" ")).alias("role"),
        F.coalesce(F.col(text), F.lit(" ")).alias("text"),
        (F.coalesce(F.col(present), F.lit(False)) if present else F.lit(True)).alias("present"),
    )


def _after(turn: str) -> Column:
    """A turn as a value that sorts nulls first, also as a minimum."""
    return F.struct(F.col(turn).isNotNull(), F.col(turn))


def diagnose(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None,
) -> DataFrame:
    """Per conversation: conv, gaps, blank, duplicate, truncated, illegal and its signature."""
    rows = _rows(conversations, conv_id, turn, role, text, present).withColumn("hash", F.md5("text"))
    first = (
        rows.filter("present")
        .groupBy("conv", "role", "hash")
        .agg(F.min(_after("turn")).alias("first"), F.count(F.lit(1)).alias("times"))
        .filter("times > 1")
        .select(F.col("conv").alias("c2"), F.col("role").alias("r2"), F.col("hash").alias("h2"), "first")
    )
    marked = rows.join(first, same([F.col(c) for c in ("conv", "role", "hash")], [F.col(c) for c in ("c2", "r2", "h2")]), "left")
    blank = F.col("text").rlike(BLANK)
    seen = marked.select(
        "conv", "turn", "role", "text", "present", "hash",
        blank.alias("blank"),
        (~F.col("text").rlike(ENDED)).alias("cut"),
        F.coalesce(_after("turn") > F.col("first"), F.lit(False)).alias("later"),
    )
    kind = rows.schema["conv"].dataType.simpleString()
    return (
        seen.repartition("conv")
        .sortWithinPartitions("conv", "turn", "role", "text")
        .drop("text")
        .mapInArrow(_signatures, f"conv {kind}, {', '.join(f'{c} long' for c in _COUNTS)}, signature string")
    )


def solve_signatures(signatures: DataFrame) -> DataFrame:
    """(signature, cost, audit) of the distinct values of ``signature``."""
    ends = signatures.select(F.reverse("signature").alias("back")).distinct()
    return (
        ends.repartitionByRange(F.substring("back", 1, 64), F.length("back"), F.xxhash64("back"))
        .sortWithinPartitions("back")
        .mapInArrow(_solved, "signature string, cost long, audit string")
    )


def _plan(conversations, conv_id, turn, role, text, present) -> DataFrame:
    """Sorted rows of each conversation behind a row with its diagnosis, cost and audit."""
    found = cut_lineage(diagnose(conversations, conv_id, turn, role, text, present), "signatures")
    heads = found.join(solve_signatures(found), "signature").select("conv", F.struct(*_HEAD).alias("head"))
    rows = _rows(conversations, conv_id, turn, role, text, present)
    both = rows.withColumn("first", F.lit(1)).unionByName(heads.withColumn("first", F.lit(0)), allowMissingColumns=True)
    return both.repartition("conv").sortWithinPartitions("conv", "first", "turn", "role", "text")


def repair(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None,
) -> DataFrame:
    """Per conversation: its id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256."""
    plan = _plan(conversations, conv_id, turn, role, text, present)
    kind = plan.schema["conv"].dataType.simpleString()
    counts = ", ".join(f"{c} long" for c in (*_COUNTS, "cost"))
    return plan.mapInArrow(_applied(False), f"conv {kind}, {counts}, audit string, repaired_sha256 string").withColumnRenamed(
        "conv", conv_id
    )


def repaired_rows(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    present: str | None = None,
) -> DataFrame:
    """The rows of repaired conversations: id, place (from 0), edit (K, R or I), role, text."""
    plan = _plan(conversations, conv_id, turn, role, text, present)
    kind = plan.schema["conv"].dataType.simpleString()
    return plan.mapInArrow(
        _applied(True), f"conv {kind}, place long, edit string, role string, text string"
    ).withColumnRenamed("conv", conv_id)


def damage(conversations: DataFrame) -> DataFrame:
    """``conversations`` with faults by crc32 of ``conv_id:turn`` (nulls: one space): conv_id, turn, role, text, present.

    Of 20 remainders 0 drops a row (not present), 1 empties its text, 2 removes its sentence ends,
    3 repeats it, 4 makes it a user's.
    """
    spaced = [F.coalesce(F.col(c).cast("string"), F.lit(" ")) for c in ("conv_id", "turn", "role", "text")]
    h = F.crc32(F.concat(spaced[0], F.lit(":"), spaced[1]).cast("binary")) % 20
    text = F.when(h == 1, "").when(h == 2, F.regexp_replace(spaced[3], "[.!?]", "")).otherwise(spaced[3])
    return conversations.select(
        "conv_id", "turn", F.when(h == 4, "user").otherwise(spaced[2]).alias("role"), text.alias("text"),
        (h != 0).alias("present"), F.explode(F.array_repeat(F.lit(0), F.when(h == 3, 2).otherwise(1))).alias("copy"),
    ).drop("copy")
