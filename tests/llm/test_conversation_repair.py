"""Conversation repair against all edits tried in turn, and on long, empty, repeated and null rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from compare import differences

from gaugeworks.llm import conversation_repair as cr
from gaugeworks.llm.queries import QUERIES

TALKS = "conv_id long, turn long, role string, text string, copies string, first boolean"
ALLOWED = re.compile(r"(s?(ua)+)?\Z")


def tried(rows):
    """Least (cost, audit) over every edit of every row and up to two insertions in each gap."""
    gaps = ["", "u", "a", "ua", "au"]
    edits = [
        [(4, "D", "")] + ([] if lost else [(3 * cut, "K", initial)] + [(3 + 3 * cut, "R", r) for r in "ua"]) for initial, lost, cut in rows
    ]
    best = None
    for chosen in itertools.product(*edits):
        for added in itertools.product(gaps, repeat=len(rows) + 1):
            roles = "".join(g + (chosen[i][2] if i < len(rows) else "") for i, g in enumerate(added))
            if ALLOWED.match(roles):
                cost = sum(c[0] for c in chosen) + 3 * sum(map(len, added))
                audit = "".join("I" * len(g) + (chosen[i][1] if i < len(rows) else "") for i, g in enumerate(added))
                best = min(best or (cost, audit), (cost, audit))
    return best


def test_cells_hold_the_best_of_all_edits():
    rng = random.Random(5)
    for _ in range(120):
        rows = [(rng.choice("suuaax"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(rng.randint(1, 4))]
        cell = cr.span_cell([cr.row_cell(*r) for r in rows])
        assert min(cell[k] for k in cr.WHOLE if cell[k]) == tried(rows)


def test_any_split_of_a_span_gives_its_cell():
    rng = random.Random(6)
    for _ in range(40):
        cells = [cr.row_cell(rng.choice("sua"), rng.random() < 0.2, rng.random() < 0.3) for _ in range(9)]
        spans = cr.Spans()
        for c in cells:
            spans.add(c)
        for at in range(1, 9):
            assert cr.joined(cr.span_cell(cells[:at]), cr.span_cell(cells[at:])) == cr.span_cell(cells) == spans.whole()


def plain(talks):
    """One conversation after the other, by an automaton."""
    out = []
    for conv in {t[0] for t in talks}:
        rows = []
        for _, turn, role, text in (t[:4] for t in talks if t[0] == conv):
            role, text = " " if role is None else role, " " if text is None else text
            fate = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
            if fate == 0:
                continue
            text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
            rows += [(turn, "user" if fate == 4 else role, text)] * (2 if fate == 3 else 1)
        rows.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
        turns = {r[0] for r in rows} - {None}
        counts, seen, marked = [0, 0, 0], set(), []
        for _, role, text in rows:
            bare = text.strip(cr.BLANKS)
            fault = 0 if not bare else 1 if (role, text) in seen else 2 if bare[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                counts[fault] += 1
            marked.append((role, text, fault))
        illegal = sum(a[0][:1] + b[0][:1] not in ("su", "ua", "au") for a, b in zip(marked, marked[1:]))
        start = {"0": (0, "", ())}

        def insert(states):
            for _ in range(2):
                for s, (c, e, o) in list(states.items()):
                    to, role = ("a", "assistant") if s == "u" else ("u", "user")
                    if (c + 3, e + "I") < states.get(to, (10**9, ""))[:2]:
                        states[to] = (c + 3, e + "I", (*o, f"{role}:"))
            return states

        states = start
        for role, text, fault in marked:
            before, states = insert(states), {}
            for s, (c, e, o) in before.items():
                options = [(s, c + 4, e + "D", o)]
                if fault not in (0, 1):
                    more = 3 if fault == 2 else 0
                    for initial, full in (("s", None), ("u", "user"), ("a", "assistant")):
                        fits = s == "0" if initial == "s" else s == "u" if initial == "a" else s != "u"
                        if fits and role[:1] == initial:
                            options.append((initial, c + more, e + "K", (*o, f"{role}:{text}")))
                        elif fits and full:
                            options.append((initial, c + 3 + more, e + "R", (*o, f"{full}:{text}")))
                for to, cost, audit, lines in options:
                    if (cost, audit) < states.get(to, (10**9, ""))[:2]:
                        states[to] = (cost, audit, lines)
        ends = insert(states)
        cost, audit, lines = min(ends[s] for s in "0a" if s in ends)
        sha = hashlib.sha256("\n".join(lines).encode()).hexdigest()
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out.append((conv, gaps, *counts, illegal, cost, audit, sha))
    return sorted(out, key=str)


def result(df):
    columns = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def _talks(n, seed=2):
    rng = random.Random(seed)
    texts = ["Yes.", "No", "What?", "", " \n", "a.\t", None, "ok!"]
    return [(rng.choice([1, 1, 1, 2, 3, None]), t, rng.choice(["user", "assistant", "system", "tool", "u", "", None]), f"{rng.choice(texts)}", "x", True) for t in range(n)]


@pytest.mark.parametrize("piece", [1, 3, cr.PIECE])
def test_spans_over_many_tasks(spark, piece):
    talks = _talks(400) + [(4, None, "user", None, "x", True), (5, 7, "assistant", "é" * 100_000 + ".", None, None)]
    df = spark.createDataFrame(talks, TALKS).repartition(9)
    assert result(cr.repair_conversations(df, piece)) == plain(talks)


def test_repeated_rows_and_equal_turns(spark):
    talks = [(1, 1, "user", "Hm.", "x", True)] * 300 + [(1, None, "assistant", "So.", "x", True)] * 3 + [(2, 5, "user", "A.", "", None), (2, 5, "assistant", "B.", "", None)]
    assert result(cr.repair_conversations(spark.createDataFrame(talks, TALKS), 50)) == plain(talks)


def test_a_conversation_without_rows_after_damage(spark):
    gone = next(c for c in range(1000) if zlib.crc32(f"{c}:0".encode()) % 20 == 0)
    talks = [(gone, 0, "user", "Hi.", None, None)]
    got = result(cr.repair_conversations(spark.createDataFrame(talks, TALKS)))
    assert got == [(gone, 0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())]
    assert result(cr.repair_conversations(spark.createDataFrame([], TALKS))) == []


def test_same_as_sql(spark, small_sql, small_dir):
    assert differences(QUERIES["op13_conversation_repair"](spark, small_dir), small_sql, cr.ORACLE) is None
