"""Cheapest repair of conversations whose turns are missing, empty, repeated, cut off or in the wrong role.

A repaired conversation alternates: an optional system turn, then pairs of user and assistant, or nothing at all.
The repair is a weighted parse of the rows by a grammar in Chomsky normal form. A nonterminal stands for what a
span of rows may become, told by its first and last role: nothing, u...u, u...a, a...a, a...u, and s, s...u, s...a.
Each span has one cell that holds the least (cost, audit) of every nonterminal; a row's cell is closed under
insertion before and after it, and cells of neighbouring spans are joined by the binary rules. The nonterminals
are closed under cutting: any derivation of a span splits at every row boundary into two of its parts. So one
split of a span gives all its derivations, and the cells needed are those of spans of 1, 2, 4, ... rows, bottom up.

A conversation may hold most of all rows. Rows are spread by range over (conversation, turn), so its spans are
parsed by many tasks, which hand on one cell per ``PIECE`` rows; the joined cells and the audit are strings as
long as the conversation, which the result holds anyway. The checksum of a repaired conversation is a running
one: its rows pass through one task in order, none is held.

Order and ties: rows go by turn (nulls first), rows of equal turn by role and then by a hash of their text. Null
roles and texts are one blank; a null conversation id is a conversation of its own. Of repeated rows the first
is the original and the rest are duplicates. Roles count by their first letter; one that is not s, u or a can be
reassigned or deleted only. Extra columns are not read. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gaugeworks.llm.common import saved, ship, shuffle_parts, text_key
from gaugeworks.llm.spelling_variants import CRC_TABLE, crc32_sql

DELETE, INSERT, REASSIGN, CUT_OFF = 4, 3, 3, 3
#: Rows of the longest span that one record holds.
PIECE = 1024
BLANKS = " \t\n\x0b\f\r"
_NO_TEXT = hashlib.sha256(b"").hexdigest()

#: First and last role of what a span becomes; None is nothing.
KINDS = (None, "uu", "ua", "aa", "au", "ss", "su", "sa")
WHOLE = tuple(KINDS.index(k) for k in (None, "ua", "sa"))
Cell = list  # of (cost, audit) or None, one for each of KINDS


def _rules() -> list[tuple[int, int, int]]:
    """(left, right, whole) of the binary rules: what follows a role must be the other one, and after s comes u."""
    out = []
    for i, a in enumerate(KINDS):
        for j, b in enumerate(KINDS):
            if a is None or b is None:
                out.append((i, j, j if a is None else i))
            elif (a[1] + b[0]) in ("su", "ua", "au"):
                out.append((i, j, KINDS.index(a[0] + b[1])))
    return out


RULES = _rules()


def joined(left: Cell, right: Cell) -> Cell:
    """The cell of two neighbouring spans."""
    out: Cell = [None] * len(KINDS)
    for i, j, k in RULES:
        a, b = left[i], right[j]
        if a is None or b is None:
            continue
        best = out[k]
        cost = a[0] + b[0]
        if best is None or cost < best[0]:
            out[k] = (cost, a[1] + b[1])
        elif cost == best[0]:
            audit = a[1] + b[1]
            if audit < best[1]:
                out[k] = (cost, audit)
    return out


def _inserted() -> Cell:
    """What a place between two rows may become."""
    one, two = (INSERT, "I"), (2 * INSERT, "II")
    return [(0, ""), one, two, one, two, None, None, None]


@cache
def row_cell(initial: str, lost: bool, cut_off: bool) -> Cell:
    """The cell of one row; a ``lost`` one (blank or duplicate) can only be deleted."""
    own: Cell = [(DELETE, "D")] + [None] * (len(KINDS) - 1)
    if not lost:
        more = CUT_OFF if cut_off else 0
        for role in "ua":
            own[KINDS.index(role * 2)] = (more, "K") if initial == role else (REASSIGN + more, "R")
        if initial == "s":
            own[KINDS.index("ss")] = (more, "K")
    return joined(joined(_inserted(), own), _inserted())


def span_cell(cells: list[Cell]) -> Cell:
    """The cell of consecutive rows, by spans of doubled length."""
    while len(cells) > 1:
        cells = [joined(*cells[i : i + 2]) if i + 1 < len(cells) else cells[i] for i in range(0, len(cells), 2)]
    return cells[0]


class Spans:
    """Cells of a growing row of spans, joined like the digits of a binary counter."""

    def __init__(self):
        self.held: list[tuple[int, Cell]] = []

    def add(self, cell: Cell) -> None:
        level = 0
        while self.held and self.held[-1][0] == level:
            cell, level = joined(self.held.pop()[1], cell), level + 1
        self.held.append((level, cell))

    def whole(self) -> Cell:
        cells = [c for _, c in self.held]
        while len(cells) > 1:
            cells[-2:] = [joined(cells[-2], cells[-1])]
        return cells[0]


def damaged(conversations: DataFrame) -> DataFrame:
    """``conv_id``, ``turn``, ``role``, ``text`` and ``copies`` after damage that depends on conversation and turn alone."""
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    role, text = F.coalesce("role", F.lit(" ")), F.coalesce("text", F.lit(" "))
    rows = conversations.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fate"))
    fate = F.col("fate")
    return rows.filter(fate != 0).select(
        "conv_id", "turn", F.when(fate == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(fate == 1, F.lit("")).when(fate == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text")).alias("text"),
        F.when(fate == 3, F.lit(2)).otherwise(F.lit(1)).cast("long").alias("copies"),
    )


_ROW = ["conv_id", "turn", "role", "t1", "t2"]
_TEXT = ["conv_id", "role", "t1", "t2"]


def _last(text: str = "text") -> Column:
    """Last character of a text that is no blank; empty if there is none."""
    return F.right(F.rtrim(F.col(text), F.lit(BLANKS)), F.lit(1))


def _marked(rows: DataFrame) -> DataFrame:
    """One row for each distinct one, with its number and whether its text is the first of its kind in the conversation.

    Texts are compared by 128 bits. The first turn of each text is found by a minimum and brought to its row
    by a union, so neither a hot conversation nor a hot text meets in one task.
    """
    each = rows.select("conv_id", "turn", "role", *text_key("text"), "copies", _last().alias("last"))
    counted = each.groupBy(*_ROW).agg(F.sum("copies").alias("copies"), F.min("last").alias("last"))
    when = F.min(F.struct(F.col("turn").isNotNull().alias("known"), "turn")).alias("first")
    firsts = counted.groupBy(*_TEXT).agg(when).select("conv_id", F.col("first.turn").alias("turn"), "role", "t1", "t2")
    both = counted.withColumn("first", F.lit(False)).unionByName(
        firsts.withColumns({"copies": F.lit(0).cast("long"), "last": F.lit(None).cast("string"), "first": F.lit(True)})
    )
    return both.groupBy(*_ROW).agg(F.sum("copies").alias("copies"), F.min("last").alias("last"), F.max("first").alias("first"))


_CELLS = "costs array<long>, audits array<string>"
_COUNTS = "blank long, duplicate long, truncated long, illegal long"


def _typed(conv_id: T.DataType, rest: str) -> T.StructType:
    return T.StructType([T.StructField("conv_id", conv_id), *T._parse_datatype_string(rest).fields])


def _legal(a: str, b: str) -> bool:
    return a + b in ("su", "ua", "au")


_PIECES = (
    f"part int, seq int, rows long, opens string, closes string, {_COUNTS}, {_CELLS}, "
    "row_roles array<string>, row_t1 array<long>, row_t2 array<long>"
)


def _pieces(piece: int):
    """Spans of up to ``piece`` rows of one conversation, from rows in order."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, seq = TaskContext.get().partitionId(), 0
        done: list[tuple] = []
        kind = None
        conv, rows, counts, initials = None, [], [0, 0, 0], []

        def close():
            nonlocal rows, counts, initials, seq
            if not rows:
                return
            cell = span_cell([c for c, *_ in rows])
            illegal = sum(not _legal(a, b) for a, b in zip(initials, initials[1:]))
            done.append((
                conv, part, seq, len(rows), initials[0], initials[-1], *counts, illegal,
                [None if c is None else c[0] for c in cell], [None if c is None else c[1] for c in cell],
                [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows],
            ))
            rows, counts, initials, seq = [], [0, 0, 0], [], seq + 1

        long, text = pa.list_(pa.int64()), pa.list_(pa.string())
        names = ["conv_id", *[f.split()[0] for f in _PIECES.split(", ")]]
        types = [None, pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string(), *[pa.int64()] * 4, long, text, text, long, long]
        for batch in batches:
            kind = batch.schema.field(0).type
            for here, _, role, t1, t2, copies, last, first in zip(*[c.to_pylist() for c in batch.columns]):
                if rows and here != conv:
                    close()
                conv = here
                for nth in range(copies):
                    if len(rows) == piece:
                        close()
                    blank, again = last == "", not first or nth > 0
                    cut_off = not blank and not again and last not in ".!?"
                    counts[0] += blank
                    counts[1] += again and not blank
                    counts[2] += cut_off
                    initials.append(role[:1])
                    rows.append((row_cell(role[:1], blank or again, cut_off), role, t1, t2))
                    if len(done) >= 2000:
                        yield _batch(done, kind, names, types)
                        done.clear()
        close()
        if done:
            yield _batch(done, kind, names, types)

    return cut


def _batch(rows: list[tuple], kind: pa.DataType, names: list[str], types: list) -> pa.RecordBatch:
    columns = list(zip(*rows)) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(list(c), kind if i == 0 else types[i]) for i, c in enumerate(columns)], names)


_DECIDED = f"part int, seq int, segment string, before long, system boolean, head boolean, {_COUNTS}, cost long, audit string"


def _decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The cheapest repair of each conversation from its pieces in order, and each piece's share of the audit."""
    names = ["conv_id", *[f.split()[0] for f in _DECIDED.split(", ")]]
    types = [None, pa.int32(), pa.int32(), pa.string(), pa.int64(), pa.bool_(), pa.bool_(), *[pa.int64()] * 5, pa.string()]
    done: list[tuple] = []
    spans, places, counts, last, conv, kind = Spans(), [], [0, 0, 0, 0], None, None, None

    def settle():
        cell = spans.whole()
        cost, audit, which = min((*cell[k], k) for k in WHOLE if cell[k] is not None)
        system = KINDS[which] == "sa"
        taken = np.frombuffer(audit.encode(), np.uint8)
        stands = np.concatenate([[0], np.cumsum(taken != ord("D"))])
        own = np.flatnonzero(taken != ord("I"))
        start = row = 0
        for nth, (part, seq, rows) in enumerate(places):
            row += rows
            end = len(audit) if nth + 1 == len(places) else int(own[row - 1]) + 1
            head = (*counts, cost, audit) if nth == 0 else (None,) * 6
            done.append((conv, part, seq, audit[start:end], int(stands[start]), system, nth == 0, *head))
            start = end

    for batch in batches:
        kind = batch.schema.field(0).type
        for here, part, seq, rows, opens, closes, blank, duplicate, truncated, illegal, costs, audits in zip(*[c.to_pylist() for c in batch.columns]):
            if places and here != conv:
                settle()
                spans, places, counts, last = Spans(), [], [0, 0, 0, 0], None
                if len(done) >= 2000:
                    yield _batch(done, kind, names, types)
                    done.clear()
            conv = here
            more = (blank, duplicate, truncated, illegal + (last is not None and not _legal(last, opens)))
            counts = [a + b for a, b in zip(counts, more)]
            last = closes
            spans.add([None if c is None else (c, a) for c, a in zip(costs, audits)])
            places.append((part, seq, rows))
    if places:
        settle()
    if done:
        yield _batch(done, kind, names, types)


_LINES = "pos long, shown string, role string, t1 long, t2 long, added boolean"


def _lines(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of repaired conversations, with their place and role; texts are still to come."""
    names = ["conv_id", *[f.split()[0] for f in _LINES.split(", ")]]
    types = [None, pa.int64(), pa.string(), pa.string(), pa.int64(), pa.int64(), pa.bool_()]
    for batch in batches:
        kind = batch.schema.field(0).type
        done = []
        for conv, roles, t1, t2, segment, before, system in zip(*[c.to_pylist() for c in batch.columns]):
            row, pos = 0, before
            for edit in segment:
                turn = ("user", "assistant")[(pos - system) % 2]
                if edit == "I":
                    done.append((conv, pos, turn, None, None, None, True))
                elif edit != "D":
                    done.append((conv, pos, roles[row] if edit == "K" else turn, roles[row], t1[row], t2[row], False))
                pos += edit != "D"
                row += edit != "I"
        yield _batch(done, kind, names, types)


def _checksum(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    conv, running, kind, done = None, None, None, []
    for batch in batches:
        kind = batch.schema.field(0).type
        for here, shown, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)):
            line = f"{shown}:{text.as_py()}".encode("utf-8", "surrogatepass")
            if running is None or here != conv:
                if running is not None:
                    done.append((conv, running.hexdigest()))
                conv, running = here, hashlib.sha256(line)
            else:
                running.update(b"\n")
                running.update(line)
    if running is not None:
        done.append((conv, running.hexdigest()))
        yield _batch(done, kind, ["conv_id", "sha"], [None, pa.string()])


def repaired_lines(rows: DataFrame, pieces: DataFrame, decided: DataFrame) -> DataFrame:
    """``conv_id``, ``pos``, ``shown`` (role) and ``text`` of every row of the repaired conversations."""
    kind = rows.schema["conv_id"].dataType
    shares = decided.select("part", "seq", "segment", "before", "system")
    chosen = pieces.join(shares, ["part", "seq"]).select("conv_id", "row_roles", "row_t1", "row_t2", "segment", "before", "system")
    lines = saved(chosen.mapInArrow(_lines, _typed(kind, _LINES)), "lines")
    texts = rows.select("conv_id", "role", *text_key("text"), "text").dropDuplicates(_TEXT)
    texts = texts.select(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("t1").alias("h1"), F.col("t2").alias("h2"), "text")
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("t1") == F.col("h1")) & (F.col("t2") == F.col("h2"))
    kept = lines.filter(~F.col("added")).join(texts, same).select("conv_id", "pos", "shown", "text")
    return kept.unionByName(lines.filter("added").select("conv_id", "pos", "shown", F.lit("").alias("text")))


def repair(rows: DataFrame, piece: int = PIECE) -> tuple[DataFrame, DataFrame]:
    """The decisions on damaged rows (one record for each conversation with ``head``), and the repaired rows."""
    spark, kind = rows.sparkSession, rows.schema["conv_id"].dataType
    ship(spark)
    parts = shuffle_parts(spark)
    order = saved(_marked(rows).select(*_ROW, "copies", "last", "first"), "turns")
    in_order = order.repartitionByRange(parts, *_ROW).sortWithinPartitions(*_ROW)
    pieces = saved(in_order.mapInArrow(_pieces(piece), _typed(kind, _PIECES)), "spans")
    light = pieces.drop("row_roles", "row_t1", "row_t2").repartition(parts, "conv_id").sortWithinPartitions("conv_id", "part", "seq")
    decided = saved(light.mapInArrow(_decide, _typed(kind, _DECIDED)), "repairs")
    return decided, repaired_lines(rows, pieces, decided)


def repair_conversations(conversations: DataFrame, piece: int = PIECE) -> DataFrame:
    """One row for each ``conv_id`` of the conversations: their faults after damage, and the cheapest repair."""
    rows = damaged(conversations)
    decided, lines = repair(rows, piece)
    kind = rows.schema["conv_id"].dataType
    in_order = lines.repartition(shuffle_parts(rows.sparkSession), "conv_id").sortWithinPartitions("conv_id", "pos").select("conv_id", "shown", "text")
    sums = in_order.mapInArrow(_checksum, _typed(kind, "sha string"))
    turn = F.col("turn").cast("long")
    gaps = rows.groupBy("conv_id").agg((F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn)).alias("gaps"))
    found = decided.filter("head").select("conv_id", "blank", "duplicate", "truncated", "illegal", "cost", "audit")
    each = conversations.select("conv_id").distinct()
    for more in (gaps, found, sums):
        each = each.unionByName(more, allowMissingColumns=True)
    numbers = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    return each.groupBy("conv_id").agg(
        *[F.coalesce(F.max(c), F.lit(0).cast("long")).alias(c) for c in numbers],
        F.coalesce(F.max("audit"), F.lit("")).alias("audit"), F.coalesce(F.max("sha"), F.lit(_NO_TEXT)).alias("repaired_sha256"),
    )


def _plus(state: str, cost: str | int, edit: str) -> str:
    """A state's cost (nine digits) and audit after one more edit."""
    return f"(lpad((left({state}, 9)::BIGINT + {cost})::VARCHAR, 9, '0') || substr({state}, 10) || {edit})"


def _oracle() -> str:
    """The same by another way: row after row through the automaton of allowed roles (nothing, after s, after u, after a)."""
    nothing, after_s, after_u, after_a = (f"a[{i}]" for i in range(1, 5))
    one = lambda s: _plus(s, INSERT, "'I'")
    two = lambda s: _plus(s, 2 * INSERT, "'II'")
    inserted = (
        f"[{nothing}, {after_s}, least({after_u}, {one(nothing)}, {one(after_s)}, {one(after_a)}), "
        f"least({after_a}, {one(after_u)}, {two(nothing)}, {two(after_s)})]"
    )
    gone = lambda s: _plus(s, DELETE, "'D'")
    as_role = lambda s, r: (
        f"CASE WHEN x[3] = 'lost' THEN '900000000' WHEN x[2] = '{r}' THEN {_plus(s, 'x[4]::BIGINT', chr(39) + 'K' + chr(39))} "
        + ("ELSE '900000000' END" if r == "s" else f"ELSE {_plus(s, f'x[4]::BIGINT + {REASSIGN}', chr(39) + 'R' + chr(39))} END")
    )
    edited = (
        f"[{gone(nothing)}, least({gone(after_s)}, {as_role(nothing, 's')}), "
        f"least({gone(after_u)}, {as_role(nothing, 'u')}, {as_role(after_s, 'u')}, {as_role(after_a, 'u')}), "
        f"least({gone(after_a)}, {as_role(after_u, 'a')})]"
    )
    blank = "chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"
    return f"""
WITH {CRC_TABLE},
fates AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    ({crc32_sql("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}) % 20 AS fate FROM conversations, crc_table),
damaged AS (SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
    CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
    unnest(range(0, CASE fate WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM fates WHERE fate <> 0),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again, right(rtrim(text, {blank}), 1) AS last
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS pos FROM damaged)),
faults AS (SELECT *, last = '' AS blank, last <> '' AND again AS duplicate, last <> '' AND NOT again AND last NOT IN ('.', '!', '?') AS truncated,
    left(role, 1) AS initial, lag(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS before FROM placed),
walked AS (SELECT conv_id, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE duplicate) AS duplicate,
    count(*) FILTER (WHERE truncated) AS truncated, count(*) FILTER (WHERE before || initial NOT IN ('su', 'ua', 'au')) AS illegal,
    coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    list_reduce([['000000000', '900000000', '900000000', '900000000']]
      || flatten(list([['insert'], ['row', initial, CASE WHEN blank OR duplicate THEN 'lost' ELSE '' END, CASE WHEN truncated THEN '{CUT_OFF}' ELSE '0' END]] ORDER BY pos))
      || [['insert']], lambda a, x: CASE WHEN x[1] = 'insert' THEN {inserted} ELSE {edited} END) AS ends
  FROM faults GROUP BY conv_id),
chosen AS (SELECT *, least(ends[1], ends[4]) AS best FROM walked),
edits AS (SELECT conv_id, unnest(range(1, length(best) - 8)) AS j, substr(best, j + 9, 1) AS edit FROM chosen),
numbered AS (SELECT *, count(*) FILTER (WHERE edit <> 'I') OVER w AS pos, count(*) FILTER (WHERE edit <> 'D') OVER w - 1 AS k FROM edits
  WINDOW w AS (PARTITION BY conv_id ORDER BY j ROWS UNBOUNDED PRECEDING)),
kept AS (SELECT n.conv_id, edit, k, role, text, max(CASE WHEN k = 0 AND edit = 'K' AND initial = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY n.conv_id) AS system
  FROM numbered n LEFT JOIN faults f ON n.conv_id IS NOT DISTINCT FROM f.conv_id AND n.pos = f.pos AND edit <> 'I' WHERE edit <> 'D'),
texts AS (SELECT conv_id, sha256(string_agg(CASE WHEN edit = 'K' THEN role WHEN (k - system) % 2 = 0 THEN 'user' ELSE 'assistant' END
    || ':' || coalesce(text, ''), chr(10) ORDER BY k)) AS sha FROM kept GROUP BY conv_id)
SELECT i.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated,
  coalesce(illegal, 0) AS illegal, coalesce(left(best, 9)::BIGINT, 0) AS cost, coalesce(substr(best, 10), '') AS audit, coalesce(sha, sha256('')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) i LEFT JOIN chosen c ON i.conv_id IS NOT DISTINCT FROM c.conv_id
  LEFT JOIN texts t ON i.conv_id IS NOT DISTINCT FROM t.conv_id"""


ORACLE = _oracle()
