"""Conversation structure repair by weighted CYK parsing of intervals.

A conversation should read (system? (user assistant)+)?. The grammar of its repairs is in Chomsky normal form: its
nonterminals [p, q] stand for the edits that lead an automaton of that pattern from state p to state q, its binary
rules are [p, q] -> [p, r] [r, q], and each row's keep, rerole and delete are its terminals, closed under insertion of
rows on both sides. A span of rows has a cell of the least (cost, audit) for each nonterminal. Spans are combined
bottom-up by their length. As the nonterminals are pairs of states, every way to split a span has the same minimum,
so one split a span is enough, and a conversation takes as many combinations as it has rows. Minima of (cost, audit)
may be concatenated: of two equally cheap edits of one span none begins with the other, as every row takes one
letter and an insertion more would cost more.

The faults of a row, and the spans of up to PIECE rows, are found in parallel, also within one conversation; only
texts' digests travel for that. Cells of pieces then meet by conversation in order, and each text goes once to where
its conversation is hashed as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

from tocsin.llm.common import Scratch, small_batches

#: Distinct rows of one conversation that a span begins with before spans of several pieces are combined.
PIECE = 1024
KEEP, REROLE, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
#: States: nothing yet, after system, after user, after assistant; which letter leads where; what may be the end.
NONE, SYSTEM, USER, ASSISTANT = range(4)
MOVES = {(NONE, "s"): SYSTEM, (NONE, "u"): USER, (SYSTEM, "u"): USER, (USER, "a"): ASSISTANT, (ASSISTANT, "u"): USER}
ENDS = (NONE, ASSISTANT)
LEGAL = ("su", "ua", "au")
_SOLID = r"[^\x20\x09-\x0D]"
Cell = dict[tuple[int, int], tuple[int, str]]


def combine(left: Cell, right: Cell) -> Cell:
    """The least (cost, audit) of each nonterminal over two spans in a row."""
    out: Cell = {}
    for (p, r), (a, x) in left.items():
        for (s, q), (b, y) in right.items():
            if r == s:
                found = (a + b, x + y)
                if (p, q) not in out or found < out[p, q]:
                    out[p, q] = found
    return out


def _closure() -> Cell:
    """Insertions alone: the fewest from each state to each other."""
    out: Cell = {(p, p): (0, "") for p in range(4)}
    for _ in range(4):
        for (p, q), (cost, audit) in list(out.items()):
            for letter in "ua":
                to = MOVES.get((q, letter))
                found = (cost + INSERT, audit + "I")
                if to is not None and found < out.get((p, to), (99, "")):
                    out[p, to] = found
    return out


CLOSURE = _closure()
#: A row's code: fault (o none, b blank, d duplicate, t truncated), then its role's initial (x: another one).
FAULTS, INITIALS = "obdt", "suax"


def _leaf(fault: str, initial: str) -> Cell:
    """A row's edits, closed under insertion."""
    own: Cell = {(p, p): (DELETE, "D") for p in range(4)}
    if fault in "ot":
        extra = TRUNCATED if fault == "t" else 0
        for p in range(4):
            for cost, letter, edit in ((KEEP, initial, "K"), (REROLE, "u", "R"), (REROLE, "a", "R")):
                to = MOVES.get((p, letter))
                if to is not None:
                    own[p, to] = min(own.get((p, to), (99, "")), (cost + extra, edit))
    return combine(combine(CLOSURE, own), CLOSURE)


LEAVES = {f + i: _leaf(f, i) for f in FAULTS for i in INITIALS}


def parse(cells: list[Cell]) -> Cell:
    """The cell of the span of all these spans, by lengths 2, 4, 8 and so on."""
    while len(cells) > 1:
        cells = [combine(*cells[k : k + 2]) if k + 1 < len(cells) else cells[k] for k in range(0, len(cells), 2)]
    return cells[0] if cells else CLOSURE


def solution(cell: Cell) -> tuple[int, str]:
    """The cheapest cost of a whole conversation and its audit."""
    return min(cell[NONE, q] for q in ENDS if (NONE, q) in cell)


def slices(audit: str, rows: list[int]) -> list[str]:
    """The audit cut after each of the given numbers of rows, insertions before their next row, the last ones at the end."""
    out, at = [], 0
    for n in rows:
        start = at
        while n:
            n -= audit[at] != "I"
            at += 1
        out.append(audit[start:at])
    if out:
        out[-1] += audit[at:]
    return out


def apply_edits(state: int, edits: str, role: str, text: str) -> tuple[int, list[str]]:
    """The state and the lines that a row's edits lead to."""
    lines = []
    for edit in edits:
        if edit == "D":
            continue
        own = role if edit == "K" else "assistant" if state == USER else "user"
        state = MOVES[state, own[:1]]
        lines.append(f"{own}:{'' if edit == 'I' else text}")
    return state, lines


def damage(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with faults planted by crc32 of "conv_id:turn" modulo 20.

    0 drops the row, 1 empties its text, 2 takes `[.!?]` out of it, 3 repeats it, 4 makes its role user. A null is one
    space, in that key too, but a null conv_id or turn stays null in the result.
    """
    written = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fault = F.crc32(F.concat_ws(":", written("conv_id"), written("turn")).cast("binary")) % 20
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), written("role").alias("role"), written("text").alias("text"), fault.alias("fault")).where("fault <> 0")
    text = F.when(F.col("fault") == 1, "").when(F.col("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.explode(F.when(F.col("fault") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    role = F.when(F.col("fault") == 4, "user").otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), copies.alias("copy")).drop("copy")


def _code(first: Column) -> Column:
    """A row's code from blank, truncated and role; first: no earlier row has its role and text."""
    fault = F.when(F.col("blank"), "b").when(~first, "d").when(F.col("cut"), "t").otherwise("o")
    initial = F.substring("role", 1, 1)
    return F.concat(fault, F.when(initial.isin("s", "u", "a"), initial).otherwise("x"))


def _facts(rows: DataFrame) -> DataFrame:
    """Distinct (conv_id, turn, role, h), h a text's digest: how many rows n, the code of the first, and that of its copies."""
    last = F.regexp_extract("text", rf"({_SOLID})[\x20\x09-\x0D]*\z", 1)
    facts = rows.withColumns({"h": F.unhex(F.sha2("text", 256)), "blank": last == "", "cut": ~last.isin(".", "!", "?")})
    facts = facts.groupBy("conv_id", "turn", "role", "h").agg(F.count("*").alias("n"), F.first("blank").alias("blank"), F.first("cut").alias("cut"))
    # where a role and text come first in their conversation: one row a text, joined back to one row
    firsts = facts.groupBy("conv_id", "role", "h").agg(F.min(F.struct(F.col("turn").isNotNull().alias("full"), "turn")).alias("at")).select("conv_id", "at.turn", "role", "h", F.lit(True).alias("first"))
    key = lambda x: [F.col(f"{x}.{c}") for c in ("conv_id", "turn", "role", "h")]
    same = F.lit(True)
    for a, b in zip(key("x"), key("y")):
        same &= a.eqNullSafe(b)
    marked = facts.alias("x").join(firsts.alias("y"), same, "left").select("x.*", F.coalesce("first", F.lit(False)).alias("first"))
    return marked.select("conv_id", "turn", "role", "h", "n", _code(F.col("first")).alias("code"), _code(F.lit(False)).alias("again"))


_CELL = pa.list_(pa.struct([("p", pa.int8()), ("q", pa.int8()), ("cost", pa.int64()), ("audit", pa.string())]))
_ITEMS = pa.list_(pa.struct([("turn", pa.int64()), ("role", pa.string()), ("h", pa.binary())]))
_COUNTS = ("blank", "duplicate", "truncated", "illegal")
_PIECES = pa.schema([
    ("conv_id", pa.int64()), ("piece", pa.int64()), ("items", _ITEMS), ("sizes", pa.list_(pa.int64())), ("cell", _CELL), *((c, pa.int64()) for c in _COUNTS),
    ("initials", pa.string()), ("first_turn", pa.int64()), ("last_turn", pa.int64()), ("turns", pa.int64()),
])
_SOLVED = pa.schema([("conv_id", pa.int64()), ("piece", pa.int64()), ("edits", pa.list_(pa.string())), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string())])
_RESULT = pa.schema([("conv_id", pa.int64()), ("gaps", pa.int64()), *((c, pa.int64()) for c in _COUNTS), ("cost", pa.int64()), ("audit", pa.string()), ("repaired_sha256", pa.string())])
_SUMMARY = [f.name for f in _SOLVED][3:]


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    for batch in batches:
        for k in range(0, batch.num_rows, 256):
            yield from batch.slice(k, 256).to_pylist()


def _batch(rows: list[dict], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_pylist(rows, schema=schema)


def illegal(initials: str) -> int:
    return sum(a + b not in LEGAL for a, b in zip(initials[:-1], initials[1:]))


def _piece(rows: list[dict], number: int) -> dict:
    """Items, cell and counts of some distinct rows of a conversation."""
    codes = [c for r in rows for c in (r["code"], *[r["again"]] * (r["n"] - 1))]
    initials, turns = "".join(c[1] for c in codes), [r["turn"] for r in rows if r["turn"] is not None]
    cell = parse([LEAVES[c] for c in codes])
    counts = {c: sum(x[0] == c[0] for x in codes) for c in _COUNTS[:3]}
    return {
        "conv_id": rows[0]["conv_id"], "piece": number, "items": [{c: r[c] for c in ("turn", "role", "h")} for r in rows], "sizes": [r["n"] for r in rows],
        "cell": [{"p": p, "q": q, "cost": cost, "audit": audit} for (p, q), (cost, audit) in cell.items()], **counts, "illegal": illegal(initials), "initials": initials[0] + initials[-1],
        "first_turn": turns[0] if turns else None, "last_turn": turns[-1] if turns else None, "turns": len(set(turns)),
    }


def _pieces(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    number, rows, out = TaskContext.get().partitionId() << 33, [], []
    for row in _rows(batches):
        if rows and (rows[0]["conv_id"] != row["conv_id"] or len(rows) >= size):
            out.append(_piece(rows, number))
            rows, number = [], number + 1
        rows.append(row)
        if len(out) >= 256:
            yield _batch(out, _PIECES)
            out = []
    if rows:
        out.append(_piece(rows, number))
    if out:
        yield _batch(out, _PIECES)


def _solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Edits of each piece's items, and on a conversation's first piece what holds for all of it."""
    pieces: list[dict] = []
    out: list[dict] = []

    def solved() -> list[dict]:
        cost, audit = solution(parse([{(c["p"], c["q"]): (c["cost"], c["audit"]) for c in x["cell"]} for x in pieces]))
        edits = slices(audit, [n for x in pieces for n in x["sizes"]])
        counts = {c: sum(x[c] for x in pieces) for c in _COUNTS}
        counts["illegal"] += sum(illegal(x["initials"][-1] + y["initials"][0]) for x, y in zip(pieces[:-1], pieces[1:]))
        full = [x for x in pieces if x["turns"]]
        distinct = sum(x["turns"] for x in full) - sum(x["last_turn"] == y["first_turn"] for x, y in zip(full[:-1], full[1:]))
        gaps = full[-1]["last_turn"] - full[0]["first_turn"] + 1 - distinct if full else 0
        rows, at = [], 0
        for x in pieces:
            rows.append({"conv_id": x["conv_id"], "piece": x["piece"], "edits": edits[at : at + len(x["sizes"])]})
            at += len(x["sizes"])
        rows[0] |= {"gaps": gaps, **counts, "cost": cost, "audit": audit}
        return rows

    for row in _rows(batches):
        if pieces and pieces[0]["conv_id"] != row["conv_id"]:
            out += solved()
            pieces = []
            if len(out) >= 256:
                yield _batch(out, _SOLVED)
                out = []
        pieces.append(row)
    if pieces:
        out += solved()
    if out:
        yield _batch(out, _SOLVED)


def _applied(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row a conversation: its summary comes first, then the edits of each distinct row, followed by the row."""
    summary, state, digest, lines, edits, out = None, NONE, hashlib.sha256(), 0, None, []
    for row in _rows(batches):
        if row["kind"] == 0:
            if summary is not None:
                out.append(summary | {"repaired_sha256": digest.hexdigest()})
            summary, state, digest, lines, edits = {c: row[c] for c in ("conv_id", *_SUMMARY)}, NONE, hashlib.sha256(), 0, None
            if len(out) >= 256:
                yield _batch(out, _RESULT)
                out = []
        elif row["kind"] == 1:
            edits = row["edits"]
        elif edits is not None:  # the first of equal rows; the others are deleted
            state, made = apply_edits(state, edits, row["role"], row["text"])
            for line in made:
                digest.update(f"{chr(10) if lines else ''}{line}".encode())
                lines += 1
            edits = None
    if summary is not None:
        out.append(summary | {"repaired_sha256": digest.hexdigest()})
    if out:
        yield _batch(out, _RESULT)


def repair_conversations(conversations: DataFrame, rows: DataFrame, piece: int = PIECE) -> DataFrame:
    """The cheapest repair of each conversation: (conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256).

    rows: (conv_id, turn, role, text) to repair, without null roles and texts; one row comes back for each conv_id of
    conversations, null included, zeros and an empty audit if rows has none of it. Rows go by turn (null first), equal
    turns by role and the text's digest; equal rows are duplicates of the first. Edits: keep K, rerole to user or
    assistant R, delete D, insert an empty row I; among the cheapest the ASCII-least audit counts. repaired_sha256 is of
    the repaired "role:text" lines. A row that is blank or repeats role and text of an earlier one must go. An empty
    table gives no row; other columns are ignored.
    """
    spark = conversations.sparkSession
    small_batches(spark)
    scratch = Scratch(spark)
    sorted_ = _facts(rows).repartitionByRange("conv_id", "turn", "role").sortWithinPartitions("conv_id", "turn", "role", "h")
    pieces = scratch.write(sorted_.mapInArrow(partial(_pieces, size=piece), from_arrow_schema(_PIECES)))
    solved = scratch.write(pieces.drop("items").repartition("conv_id").sortWithinPartitions("conv_id", "piece").mapInArrow(_solve, from_arrow_schema(_SOLVED)))
    items = pieces.select("piece", "items").join(solved.select("conv_id", "piece", "edits"), "piece").select("conv_id", F.explode(F.arrays_zip("items", "edits")).alias("i"))
    summaries = solved.where("audit is not null").select(F.col("conv_id").alias("known"), *_SUMMARY)
    ids = conversations.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    summaries = ids.join(summaries, F.col("conv_id").eqNullSafe(F.col("known")), "left").drop("known").fillna(0, [c for c in _SUMMARY if c != "audit"]).fillna("", ["audit"])
    each = rows.select("conv_id", F.lit(2).alias("kind"), "turn", "role", F.unhex(F.sha2("text", 256)).alias("h"), "text")
    items = items.select("conv_id", F.lit(1).alias("kind"), "i.items.turn", "i.items.role", "i.items.h", "i.edits")
    all_ = summaries.withColumn("kind", F.lit(0)).unionByName(items, allowMissingColumns=True).unionByName(each, allowMissingColumns=True)
    order = ["conv_id", F.col("kind") > 0, "turn", "role", "h", "kind"]
    return all_.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_applied, from_arrow_schema(_RESULT))
