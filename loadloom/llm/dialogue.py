"""Cheapest repairs of conversations, by a cost table and prefix-doubling ranks.

The turns of a conversation pass an automaton of four states: nothing yet, after a system turn, after a user turn,
after an assistant turn. Keeping, reroling or deleting a turn leads on to the next turn, inserting one changes the
state alone. A node is a (turn, state) pair; its arcs carry the letters of the audit, and one letter leads from a node to
one node only.

A conversation is cut into segments of bounded length that any task may take. Each segment gives a 4 x 4 table of
least costs from its first to its last state; a walk over the tables (16 numbers a segment) gives the costs still to
come behind every segment. With them a segment finds its optimal arcs and ranks its nodes by the least audit prefix of
1, 2, 4, ... letters: a node's rank at 2^(k+1) letters is that of the pair (own rank at 2^k, rank of the node its 2^k
letters lead to). At the end each node takes the arc with the least (letter, rank of its target), and the path is read off
doubled pointers. Pieces are joined by their exit states. Only SHA-256 needs a conversation's texts in one
order; they stream through a task sorted and are never held together.

Defined results: null roles and texts count as one space, in the key of the damage null ids and turns as well. Rows of
one turn are ordered by role, then by SHA-256 of the text; equal rows are the same row several times. Conversations
without id form one conversation. Empty roles have no initial. Gaps beyond 64 bits stop at its end.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..session import cut_lineage

#: Costs of the edits.
REROLE, DELETE, INSERT, TRUNCATED = 1, 2, 5, 5
BLANKS = " \t\n\x0b\x0c\r"
#: Turns in a segment at most.
SEGMENT = 4096
#: Rows that a task holds in tables at a time, about.
BATCH = 20_000
FAR = 1 << 40

# States: 0 nothing yet, 1 after s, 2 after u, 3 after a. Initials: 0 s, 1 u, 2 a, 3 any other.
KEEP_TO = np.array([[1, 2, -1, -1], [-1, 2, -1, -1], [-1, -1, 3, -1], [-1, 2, -1, -1]])
GROWN = np.array([2, 2, 3, 2])  # the state after a turn of the role that must follow
#: Costs behind the last turn, and the inserts they stand for.
END = np.array([0, 2 * INSERT, INSERT, 0])
TAIL = ("", "II", "I", "")
LETTERS = b"\0DIKR"  # in ASCII order; the first one ends a path
MUST_DELETE, IS_TRUNCATED = 8, 4  # bits of a turn's code beside its initial


# --- damage and faults, as DataFrame functions -------------------------------------------------

def damaged(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, n): the rows after damage, n times each."""
    blank = F.lit(" ")
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"),
                   F.coalesce(F.col("turn").cast("string"), blank))
    hit = F.crc32(key.cast("binary")) % 20
    base = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"),
                       hit.alias("hit"))
    return base.filter("hit <> 0").select(
        "conv_id", "turn", F.when(F.col("hit") == 4, F.lit("user")).otherwise(F.col("role")).alias("role"),
        F.when(F.col("hit") == 1, F.lit("")).when(F.col("hit") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(
            F.col("text")).alias("text"), F.when(F.col("hit") == 3, 2).otherwise(1).alias("n"))


def digest(text: Column) -> Column:
    return F.unhex(F.sha2(text.cast("binary"), 256))


def turns(rows: DataFrame) -> DataFrame:
    """(conv_id, turn, role, digest, n, blank, truncated, first): every different row once, without its text;
    ``first`` where role and text were not seen in an earlier turn."""
    shown = F.rtrim("text", F.lit(BLANKS))
    short = rows.select("conv_id", "turn", "role", digest(F.col("text")).alias("digest"), "n", (shown == "").alias("blank"),
                        ((shown != "") & ~F.right(shown, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    once = cut_lineage(short.groupBy("conv_id", "turn", "role", "digest", "blank", "truncated").agg(F.sum("n").alias("n")))
    # In a struct a null turn is the smallest.
    seen = once.groupBy(F.col("conv_id").alias("c"), F.col("role").alias("r"), F.col("digest").alias("d")).agg(
        F.min(F.struct("turn")).alias("least"))
    same = F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("role") == F.col("r")) & (F.col("digest") == F.col("d"))
    return once.join(seen, same).withColumn("first", F.col("turn").eqNullSafe(F.col("least.turn"))).drop("c", "r", "d", "least")


def figures(found: DataFrame) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated) of every conversation that has turns."""
    live = F.col("first") & ~F.col("blank")
    by_turn = found.groupBy("conv_id", "turn").agg(
        F.sum(F.when(F.col("blank"), F.col("n")).otherwise(0)).alias("blank"),
        F.sum(F.when(F.col("blank"), 0).otherwise(F.col("n") - F.col("first").cast("int"))).alias("duplicate"),
        F.sum((live & F.col("truncated")).cast("long")).alias("truncated"))
    wide = lambda c: c.cast("decimal(38,0)")
    gaps = wide(F.max("turn")) - wide(F.min("turn")) + 1 - F.count("turn")
    return by_turn.groupBy("conv_id").agg(
        F.least(F.coalesce(gaps, wide(F.lit(0))), wide(F.lit((1 << 63) - 1))).cast("long").alias("gaps"),
        *(F.sum(c).cast("long").alias(c) for c in ("blank", "duplicate", "truncated")))


# --- segments ----------------------------------------------------------------------------------

def _codes(initial: str, n: int, blank: bool, truncated: bool, first: bool) -> bytes:
    """A byte for each repetition of a row."""
    kind = "sua".find(initial) if initial else 3
    kind = 3 if kind < 0 else kind
    head = kind | (MUST_DELETE if blank or not first else IS_TRUNCATED if truncated else 0)
    return bytes([head]) + bytes([kind | MUST_DELETE]) * (n - 1)


def _illegal(codes: np.ndarray) -> int:
    """Neighbours whose initials are not su, ua or au."""
    a, b = codes[:-1] & 3, codes[1:] & 3
    return int(len(a) - ((a == 0) & (b == 1) | (a == 1) & (b == 2) | (a == 2) & (b == 1)).sum())


SEGMENTS = "conv_id long, at long, codes binary"


def segments(found: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(conv_id, at, codes): the turns in order, in pieces of at most so many, numbered by ``at``."""
    def run(batches):
        from pyspark import TaskContext

        at, now, codes, out = TaskContext.get().partitionId() << 32, None, bytearray(), []
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("conv_id", "initial", "n", "blank", "truncated", "first")]
            for conv, *row in zip(*columns):
                if codes and conv != now:
                    out.append((now, at, bytes(codes)))
                    at, codes = at + 1, bytearray()
                now = conv
                codes += _codes(*row)
                whole = len(codes) - len(codes) % most
                out += [(now, at + i // most, bytes(codes[i:i + most])) for i in range(0, whole, most)]
                at, codes = at + whole // most, codes[whole:] if whole else codes
            yield _batch(out, SEGMENTS)
            out = []
        if codes:
            yield _batch([(now, at, bytes(codes))], SEGMENTS)

    order = ("conv_id", "turn", "role", "digest")
    skinny = found.select(*order, F.left("role", F.lit(1)).alias("initial"), "n", "blank", "truncated", "first")
    return skinny.repartitionByRange(*order).sortWithinPartitions(*order).drop("turn", "role", "digest").mapInArrow(run, SEGMENTS)


_KINDS = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<long>": pa.list_(pa.int64()),
          "array<string>": pa.list_(pa.string())}


def _batch(rows: list, schema: str) -> pa.RecordBatch:
    names, kinds = zip(*(f.split(" ") for f in schema.split(", ")))
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], _KINDS[k]) for i, k in enumerate(kinds)], list(names))


def step_costs(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Costs (delete, keep, rerole) of turns, each by state, and the state that keeping leads to."""
    kind, late = codes & 3, np.where(codes & IS_TRUNCATED, TRUNCATED, 0)[:, None]
    barred = (codes & MUST_DELETE != 0)[:, None]
    to = KEEP_TO[:, kind].T
    keep = np.where(barred | (to < 0), FAR, late)
    rerole = np.where(barred, FAR, REROLE + late) + np.zeros((1, 4), np.int64)
    return np.stack([np.full_like(keep, DELETE), keep, rerole]), to


def _grid(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Codes of several segments, filled up, and their lengths."""
    size = np.array([len(p) for p in pieces])
    grid = np.zeros((len(pieces), int(size.max(initial=1))), np.int64)
    for i, p in enumerate(pieces):
        grid[i, :len(p)] = np.frombuffer(p, np.uint8)
    return grid, size


def cost_table(pieces: list[bytes], behind: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Least costs to come, of all segments side by side: (segments, turns + 1, states, columns) for every column of
    ``behind`` (segments, states, columns); also the codes, lengths and step costs."""
    grid, size = _grid(pieces)
    m, n = grid.shape
    cost, to = step_costs(grid.ravel())
    cost, to = cost.reshape(3, m, n, 4), np.maximum(to, 0).reshape(m, n, 4)
    table = np.empty((m, n + 1, *behind.shape[1:]), np.int64)
    table[:, n] = behind
    which = np.arange(m)[:, None]
    for t in range(n - 1, -1, -1):
        nxt = table[:, t + 1]
        now = np.minimum(np.minimum(nxt + cost[0, :, t, :, None], nxt[which, to[:, t]] + cost[1, :, t, :, None]),
                         nxt[:, GROWN] + cost[2, :, t, :, None])
        for _ in range(2):  # no path gains by more inserts before one turn
            now = np.minimum(now, INSERT + now[:, GROWN])
        table[:, t] = np.where((t < size)[:, None, None], now, behind)
    return table, grid, size, cost


def crossing_costs(pieces: list[bytes]) -> np.ndarray:
    """(segments, 4, 4): least cost from a state before the first turn to a state behind the last."""
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    table, _, _, _ = cost_table(pieces, np.broadcast_to(unit, (len(pieces), 4, 4)))
    return np.minimum(table[:, 0], FAR)


def least_audits(pieces: list[bytes], behind: np.ndarray) -> list[list[tuple[str, int]]]:
    """For every segment and entry state its least cheapest audit and exit state, given the costs behind."""
    table, grid, size, cost = cost_table(pieces, behind[:, :, None])
    table = table[..., 0]
    m, n = grid.shape
    node = np.arange(m * (n + 1) * 4).reshape(m, n + 1, 4)
    to = np.maximum(step_costs(grid.ravel())[1], 0).reshape(m, n, 4)
    here, nxt = table[:, :-1], table[:, 1:]
    which, slot = np.arange(m)[:, None, None], np.arange(n)[None, :, None]
    inside = (np.arange(n)[None, :] < size[:, None])[:, :, None]
    # Optimal arcs by letter D, I, K, R; -1 where there is none.
    kept = nxt[which, slot, to]
    arcs = np.full((4, m, n + 1, 4), -1)
    arcs[0, :, :-1] = np.where(inside & (here == cost[0] + nxt), node[:, 1:], -1)
    arcs[1, :, :-1] = np.where(inside & (here == INSERT + here[:, :, GROWN]), node[:, :-1, GROWN], -1)
    arcs[2, :, :-1] = np.where(inside & (here == cost[1] + kept) & (cost[1] < FAR), node[which, slot + 1, to], -1)
    arcs[3, :, :-1] = np.where(inside & (here == cost[2] + nxt[:, :, GROWN]) & (cost[2] < FAR), node[:, 1:, GROWN], -1)
    arcs = arcs.reshape(4, -1)
    rank = prefix_ranks(arcs)
    # Of a node's arcs the one with the least (letter, rank of its target).
    worth = np.where(arcs >= 0, np.arange(4)[:, None] * (int(rank.max()) + 1) + rank[arcs], FAR)
    best = worth.argmin(0)
    alive = worth.min(0) < FAR
    letter = np.where(alive, best + 1, 0)
    jump = [np.where(alive, arcs[best, np.arange(len(best))], np.arange(len(best)))]
    while alive[jump[-1]].any():
        jump.append(jump[-1][jump[-1]])
    path = node[:, 0].reshape(-1, 1)
    for j in reversed(jump):  # the nodes after 0, 1, 2, ... letters
        path = np.stack([path, j[path]], axis=2).reshape(len(path), -1)
    text = np.frombuffer(LETTERS, np.uint8)[letter[path]]
    last = jump[-1][node[:, 0].ravel()]
    out = []
    for i in range(m):
        out.append([(text[4 * i + q].tobytes().rstrip(b"\0").decode(), int(last[4 * i + q] % 4)) for q in range(4)])
    return out


def prefix_ranks(arcs: np.ndarray) -> np.ndarray:
    """Rank of every node by its least audit; ``arcs`` holds a node's target for each letter, -1 for none.

    A letter leads from a node to one node, so the least prefix of 2^k letters has one end. Ranks of twice the
    length are those of the pairs (rank here, rank at that end); they are final once no path goes on."""
    nodes = np.arange(arcs.shape[1])
    alive = (arcs >= 0).any(0)
    least = (arcs >= 0).argmax(0)
    rank, end = np.where(alive, least + 1, 0), np.where(alive, arcs[least, nodes], nodes)
    while alive[end].any():
        rank = np.unique(rank * (int(rank.max()) + 1) + rank[end], return_inverse=True)[1]
        end = end[end]
    return np.unique(rank * (int(rank.max()) + 1) + rank[end], return_inverse=True)[1]


# --- the whole job -----------------------------------------------------------------------------

def _by_length(pieces: list[bytes]):
    """Indices of segments of similar length, so that a table holds about ``BATCH`` turns."""
    order = sorted(range(len(pieces)), key=lambda i: len(pieces[i]))
    group: list[int] = []
    for i in order:
        if group and (len(group) + 1) * len(pieces[i]) > BATCH:
            yield group
            group = []
        group.append(i)
    if group:
        yield group


CROSSED = SEGMENTS + ", costs array<long>"
PLACED = SEGMENTS + ", behind array<long>"
AUDITED = "conv_id long, at long, audits array<string>, exits array<long>, cost long, illegal long, ends array<long>"


def _crossed(batches):
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for group in _by_length([r[2] for r in rows]):
            costs = crossing_costs([rows[i][2] for i in group])
            yield _batch([(*rows[i], c.ravel().tolist()) for i, c in zip(group, costs)], CROSSED)


def _placed(batches):
    """Segments of a conversation from its last to its first: costs to come behind each."""
    now, behind = object(), END
    for batch in batches:
        out = []
        for conv, at, codes, costs in zip(*(c.to_pylist() for c in batch.columns)):
            if conv != now:
                now, behind = conv, END
            out.append((conv, at, codes, behind.tolist()))
            behind = np.minimum(FAR, (np.array(costs).reshape(4, 4) + behind).min(1))
        yield _batch(out, PLACED)


def _audited(batches):
    for batch in batches:
        rows = list(zip(*(c.to_pylist() for c in batch.columns)))
        for group in _by_length([r[2] for r in rows]):
            pieces, behind = [rows[i][2] for i in group], np.array([rows[i][3] for i in group])
            first = cost_table(pieces, behind[:, :, None])[0][:, 0, 0, 0]
            out = []
            for i, found, cost in zip(group, least_audits(pieces, behind), first.tolist()):
                codes = np.frombuffer(rows[i][2], np.uint8)
                out.append((rows[i][0], rows[i][1], [a for a, _ in found], [q for _, q in found], cost, _illegal(codes),
                            [int(codes[0]), int(codes[-1])]))
            yield _batch(out, AUDITED)


def audits(found: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(conv_id, at, audits, exits, cost, illegal, ends) of every segment: by entry state the least audit and the
    exit state; the cost from state 0 to the conversation's end; its own illegal neighbours; outermost codes."""
    crossed = cut_lineage(segments(found, most).mapInArrow(_crossed, CROSSED))
    placed = crossed.repartition("conv_id").sortWithinPartitions("conv_id", F.desc("at")).mapInArrow(_placed, PLACED)
    return placed.repartition("conv_id", "at").mapInArrow(_audited, AUDITED)


class _Repair:
    """One conversation: figures, then audit pieces, then turns in order."""

    def __init__(self, conv):
        self.conv, self.figures, self.cost, self.illegal = conv, (0, 0, 0, 0), None, 0
        self.audit, self.state, self.end, self.walk = [], 0, None, None
        self.hash, self.lines = hashlib.sha256(), 0

    def piece(self, audits, exits, cost, illegal, ends):
        if self.cost is None:
            self.cost = cost
        else:
            self.illegal += _illegal(np.array([self.end, ends[0]]))
        self.illegal, self.end = self.illegal + illegal, ends[1]
        self.audit.append(audits[self.state])
        self.state = exits[self.state]

    def line(self, role: str, text: str):
        self.hash.update((b"\n" if self.lines else b"") + role.encode() + b":" + text.encode())
        self.lines += 1

    def start(self):
        if self.walk is None:
            self.audit.append(TAIL[self.state] if self.cost is not None else "")
            self.audit = "".join(self.audit)
            self.walk, self.state = iter(self.audit), 0

    def grow(self) -> str:
        self.state = int(GROWN[self.state])
        return "user" if self.state == 2 else "assistant"

    def turn(self, role: str, text: str, n: int):
        self.start()
        for _ in range(n):
            while (letter := next(self.walk)) == "I":
                self.line(self.grow(), "")
            if letter == "R":
                self.line(self.grow(), text)
            elif letter == "K":
                self.state = int(KEEP_TO[self.state]["sua".index(role[0])])
                self.line(role, text)

    def row(self) -> tuple:
        self.start()
        for _ in self.walk:
            self.line(self.grow(), "")
        return (self.conv, *self.figures, self.illegal, self.cost or 0, self.audit, self.hash.hexdigest())


REPAIRED = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, "
            "audit string, repaired_sha256 string")


def _repaired(batches):
    now = None
    for batch in batches:
        out = []
        for conv, part, figures, piece, turn in zip(*(batch.column(c).to_pylist() for c in (
                "conv_id", "part", "figures", "piece", "row"))):
            if now is None or conv != now.conv:
                if now is not None:
                    out.append(now.row())
                now = _Repair(conv)
            if part == 0 and figures is not None:
                now.figures = tuple(figures.values())
            elif part == 1:
                now.piece(*piece.values())
            elif part == 2:
                now.turn(*turn.values())
        yield _batch(out, REPAIRED)
    if now is not None:
        yield _batch([now.row()], REPAIRED)


def repair(conversations: DataFrame, most: int = SEGMENT) -> DataFrame:
    """(conv_id, gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256) of every conversation;
    segments have at most ``most`` turns."""
    rows = damaged(conversations)
    found = cut_lineage(turns(rows))
    none = F.lit(None)
    kinds = {"figures": "struct<gaps:bigint,blank:bigint,duplicate:bigint,truncated:bigint>",
             "piece": "struct<audits:array<string>,exits:array<bigint>,cost:bigint,illegal:bigint,ends:array<bigint>>",
             "row": "struct<role:string,text:string,n:int>"}

    def part(df: DataFrame, number: int, at=none, order=(none, none, none), **filled) -> DataFrame:
        values = [filled.get(k, none).cast(t).alias(k) for k, t in kinds.items()]
        return df.select("conv_id", F.lit(number).alias("part"), at.cast("long").alias("at"), order[0].cast("long").alias("turn"),
                         order[1].cast("string").alias("role"), order[2].cast("binary").alias("digest"), *values)

    stream = part(conversations.select("conv_id").distinct(), 0).unionByName(
        part(figures(found), 0, figures=F.struct("gaps", "blank", "duplicate", "truncated"))).unionByName(
        part(audits(found, most), 1, at=F.col("at"), piece=F.struct("audits", "exits", "cost", "illegal", "ends"))).unionByName(
        part(rows, 2, order=(F.col("turn"), F.col("role"), digest(F.col("text"))), row=F.struct("role", "text", "n")))
    order = ("conv_id", "part", "at", "turn", "role", "digest")
    return stream.repartition("conv_id").sortWithinPartitions(*order).mapInArrow(_repaired, REPAIRED)
