"""What a run of rows does to a state, as a map in pieces.

A battery moves its charge by a fixed amount, stops at a limit, or rests. So does any sequence of such rows: on each piece of
the possible states it either moves all of them by one distance or brings them all to one state. Such
maps are closed under composition. The map of a block needs no entry state, so all blocks are summarised at the same time,
and the true entry states follow from one map per block.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Callable
from dataclasses import dataclass

#: (first state of the piece, whether it ends in one state, that state or else the distance)
Piece = tuple[float, bool, float]


@dataclass(frozen=True)
class Pieces:
    """A map of the states from the first piece's start up to ``top``; pieces lie in order and leave no gap."""

    pieces: tuple[Piece, ...]
    top: float

    @classmethod
    def identity(cls, bottom: float, top: float) -> Pieces:
        return cls(((bottom, False, 0.0),), top)

    @property
    def constant(self) -> float | None:
        """The one state that all lead to, if there is one."""
        _, fixed, value = self.pieces[0]
        return value if len(self.pieces) == 1 and fixed else None

    def __call__(self, state: float) -> float:
        at = max(bisect_right(self.pieces, state, key=lambda p: p[0]) - 1, 0)
        _, fixed, value = self.pieces[at]
        return value if fixed else state + value

    def then(self, row: Pieces, exact: Callable[[float], float] | None = None) -> Pieces:
        """This map followed by ``row``. ``exact`` moves single states in the row's own arithmetic, so that a state
        reached by all is the sequential one to the last bit."""
        starts = [p[0] for p in row.pieces]
        move = exact or row
        out: list[Piece] = []

        def add(start: float, fixed: bool, value: float) -> None:
            if out and out[-1][0] >= start:
                out.pop()  # rounding left nothing of the piece before
            if not out or out[-1][1:] != (fixed, value):
                out.append((start, fixed, value))

        for i, (start, fixed, value) in enumerate(self.pieces):
            if fixed:
                add(start, True, move(value))
                continue
            end = self.pieces[i + 1][0] if i + 1 < len(self.pieces) else self.top
            first = max(bisect_right(starts, start + value) - 1, 0)
            for j in range(first, len(starts)):
                if j > first and starts[j] > end + value:
                    break
                _, stops, moved = row.pieces[j]
                add(start if j == first else starts[j] - value, stops, moved if stops else value + moved)
        return Pieces(tuple(out), self.top)
