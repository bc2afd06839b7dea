"""Conversation repair against a plain search."""

import hashlib
import re
import zlib
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from loadloom.llm import dialogue
from loadloom.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
TURN = "conv_id long, turn long, role string, text string"
OUT = ("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def search(turns):
    """Least (cost, audit) and its roles by relaxing all (position, roles so far) states forward; turns are
    (initial, must delete, truncated)."""
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}

    def inserts(states):
        for _ in range(4):
            for q, (c, a) in list(states.items()):
                for r in "ua":
                    if (q, r) in step:
                        t = step[q, r]
                        states[t] = min(states.get(t, (1 << 60, "")), (c + 5, a + "I"))
        return states

    states = inserts({"": (0, "")})
    for initial, gone, late in turns:
        new = {}
        for q, (c, a) in states.items():
            moves = [(q, 2, "D")]
            if not gone:
                if (q, initial) in step:
                    moves.append((step[q, initial], 5 * late, "K"))
                moves += [(step[q, r], 1 + 5 * late, "R") for r in "ua" if (q, r) in step]
            for t, d, letter in moves:
                new[t] = min(new.get(t, (1 << 60, "")), (c + d, a + letter))
        states = inserts(new)
    return min(states[q] for q in ("", "a") if q in states)


def plain_repair(rows):
    everyone, by = set(), defaultdict(list)
    for conv, turn, role, text in rows:
        everyone.add(conv)
        key = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        hit = zlib.crc32(key.encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        if hit == 0:
            continue
        text = "" if hit == 1 else re.sub("[.!?]", "", text) if hit == 2 else text
        role = "user" if hit == 4 else role
        by[conv] += [(turn, role, text)] * (2 if hit == 3 else 1)
    out = []
    for conv in everyone:
        order = sorted(by[conv], key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.sha256(r[2].encode()).digest()))
        seen, turns, count = set(), [], [0, 0, 0]
        for _, role, text in order:
            shown = text.strip(" \t\n\x0b\x0c\r")
            fault = 0 if not shown else 1 if (role, text) in seen else 2 if shown[-1] not in ".!?" else None
            seen.add((role, text))
            if fault is not None:
                count[fault] += 1
            turns.append((role[:1], fault in (0, 1), fault == 2))
        illegal = sum(a[0] + b[0] not in ("su", "ua", "au") for a, b in zip(turns, turns[1:]))
        cost, audit = search(turns)
        lines, last, left = [], "", list(order)
        for letter in audit:
            row = left.pop(0) if letter != "I" else None
            if letter == "D":
                continue
            role = row[1] if letter == "K" else "assistant" if last == "u" else "user"
            lines.append(f"{role}:{row[2] if row else ''}")
            last = role[0]
        ids = [t for t, _, _ in order if t is not None]
        gaps = max(ids) - min(ids) + 1 - len(set(ids)) if ids else 0
        out.append((conv, gaps, *count, illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest()))
    return sorted(out, key=str)


def result(df):
    return sorted((tuple(r[c] for c in OUT) for r in df.collect()), key=str)


def test_whole_table_equals_plain_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert result(QUERIES["op12_path_repair"](spark, SF)) == plain_repair(rows)


@given(st.lists(st.tuples(st.sampled_from("suax"), st.booleans(), st.booleans()), max_size=14), st.integers(1, 6))
@settings(max_examples=150, deadline=None)
def test_segments_join_to_the_least_path(turns, cut):
    codes = bytes("suax".index(i) | (8 if gone else 4 if late else 0) for i, gone, late in turns)
    pieces = [codes[i:i + cut] for i in range(0, len(codes), cut)]
    behind, ends = dialogue.END, []
    for p in reversed(pieces):
        ends.insert(0, behind)
        behind = (dialogue.crossing_costs([p])[0] + behind).min(1)
    state, audit = 0, ""
    for found in dialogue.least_audits(pieces, np.array(ends)) if pieces else []:
        audit, state = audit + found[state][0], found[state][1]
    audit += dialogue.TAIL[state]
    want = search([(i, gone, late and not gone) for i, gone, late in turns])
    assert (int(behind[0]), audit) == want


def test_ranks_are_those_of_the_least_strings():
    rng = np.random.default_rng(1)
    n = 60
    arcs = np.full((4, n), -1)
    for v in range(n - 3):
        for letter in rng.permutation(4)[:rng.integers(1, 4)]:
            arcs[letter, v] = rng.integers(v + 1, n)
    least = {}
    for v in reversed(range(n)):
        least[v] = min((chr(65 + k) + least[arcs[k, v]] for k in range(4) if arcs[k, v] >= 0), default="")
    place = {x: i for i, x in enumerate(sorted(set(least.values())))}
    assert dialogue.prefix_ranks(arcs).tolist() == [place[least[v]] for v in range(n)]


@pytest.mark.parametrize("segment", [4096, 3])
def test_odd_conversations(spark, segment):
    long = "word " * 40_000 + "end."
    rows = [(1, t, "user" if t % 2 else "assistant", f"line {t}.") for t in range(40)]
    rows += [(2, 5, None, None), (2, None, "user", "Hi"), (2, None, "user", "Hi"), (2, 9, "usher", "a?"), (2, 9, "", "b!")]
    rows += [(None, t, r, x) for t, r, x in ((1, "system", "s."), (None, "assistant", "x"), (3, "User", "\x0b\x85"))]
    rows += [(3, 1, "user", long), (3, 2, "assistant", long), (3, 3, "user", long), (3, 1 << 62, "assistant", "a"),
             (3, -(1 << 62), "user", "b!")]
    rows += [(4 + i, 0, "user", "same") for i in range(60)] + [(100, 0, "user", "again.")] * 50
    df = spark.createDataFrame(rows, TURN)
    got = result(dialogue.repair(df.selectExpr("*", "1 AS at", "2 AS digest", "3 AS n", "4 AS part"), segment))
    assert got == plain_repair(rows)


def test_empty_table(spark):
    df = dialogue.repair(spark.createDataFrame([], TURN))
    assert df.columns == list(OUT) and df.count() == 0
