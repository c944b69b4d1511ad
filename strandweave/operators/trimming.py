"""Trimming of circular and hairpin overlaps by weighted path alignment."""

from __future__ import annotations

from collections import deque
from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Piece:
    """One column of an alignment; a side that has a gap is None."""

    a: int | None
    ai: int | None
    b: int | None
    bi: int | None

    @property
    def matched(self) -> bool:
        return self.a is not None and self.b is not None


def overlap_alignment(a: list[int], b: list[int], weight: dict[int, int], min_identity: float, max_unitigs: int, skip_diagonal: bool) -> list[Piece]:
    """The beginning of ``a`` aligned with the end of ``b``; empty without a good overlap.

    The first k unitigs of a are rows, the last k of b columns, k up to ``max_unitigs`` (0: no alignment).
    A match scores the unitig's weight, a mismatch loses the mean of both, a gap its weight. With
    ``skip_diagonal`` no unitig is aligned with itself (a and b being one path). The alignment
    ends where the last column scores best and must begin with the first row.
    """
    k = min(len(a), len(b), max_unitigs)
    if not k:
        return []
    wa = np.array([weight[abs(x)] for x in a[:k]], float)
    wb = np.array([weight[abs(x)] for x in b[-k:]], float)
    first_b = len(b) - k
    same = np.array(a[:k])[:, None] == np.array(b[-k:])[None, :]
    score = np.zeros((k + 1, k + 1))
    diagonal = np.where(same, wa[:, None], -(wa[:, None] + wb[None, :]) / 2)
    for i in range(1, k + 1):
        row, above = score[i], score[i - 1]
        best = np.maximum(above[:-1] + diagonal[i - 1], above[1:] - wa[i - 1])
        banned = i - 1 - first_b if skip_diagonal else -1
        for j in range(1, k + 1):
            row[j] = -np.inf if j - 1 == banned else max(best[j - 1], row[j - 1] - wb[j - 1])
    i, j = int(score[:, k].argmax()), k
    if not score[i, k] > 0:
        return []
    out: list[Piece] = []
    while i > 0 and j > 0:
        x, y = a[i - 1], b[first_b + j - 1]
        if x == y and np.isfinite(score[i, j]):
            out.append(Piece(x, i - 1, y, first_b + j - 1))
            i, j = i - 1, j - 1
        elif score[i - 1, j] >= score[i, j - 1]:
            out.append(Piece(x, i - 1, None, None))
            i -= 1
        else:
            out.append(Piece(None, None, y, first_b + j - 1))
            j -= 1
    if i > 0:
        return []
    out.reverse()
    matched = sum(weight[abs(p.a)] for p in out if p.matched)
    sides = sum(weight[abs(p.a)] for p in out if p.a is not None) + sum(weight[abs(p.b)] for p in out if p.b is not None)
    return out if sides and matched / (sides / 2) >= min_identity else []


def midpoint(alignment: list[Piece], weight: dict[int, int]) -> tuple[int, int] | None:
    """(a index, b index) of the matched piece nearest to the middle by weight of both sides."""
    own = [sum(weight[abs(x)] for x in (p.a, p.b) if x is not None) for p in alignment]
    total, run, best, found = sum(own), 0, None, None
    for p, w in zip(alignment, own, strict=True):
        run += w
        if p.matched:
            off = abs(run / total - 0.5)
            if best is None or off < best:
                best, found = off, (p.ai, p.bi)
    return found


def trim_start_end(path: list[int], weight: dict[int, int], min_identity: float, max_unitigs: int) -> list[int] | None:
    """A circular path without its start-end overlap, cut in the middle of it; None without one."""
    alignment = overlap_alignment(path, path, weight, min_identity, max_unitigs, True)
    cut = midpoint(alignment, weight) if alignment else None
    return path[cut[0] : cut[1]] if cut else None


def trim_hairpin_end(path: list[int], weight: dict[int, int], min_identity: float, max_unitigs: int) -> list[int] | None:
    """A path without the hairpin at its end: the overlap of the end with its own reverse is
    peeled from both sides; None without one."""
    back = [-x for x in reversed(path)]
    alignment = overlap_alignment(back, path, weight, min_identity, max_unitigs, False)
    if not alignment:
        return None
    pieces, cut = deque(alignment), None
    while True:
        while pieces and not pieces[0].matched:
            pieces.popleft()
        while pieces and not pieces[-1].matched:
            pieces.pop()
        if len(pieces) < 2:
            return None if cut is None else path[:cut]
        pieces.popleft()
        cut = pieces.pop().bi


def trim_hairpin_start(path: list[int], weight: dict[int, int], min_identity: float, max_unitigs: int) -> list[int] | None:
    out = trim_hairpin_end([-x for x in reversed(path)], weight, min_identity, max_unitigs)
    return None if out is None else [-x for x in reversed(out)]


def choose(start_end: dict[int, list[int] | None], hairpin: dict[int, list[int] | None]) -> dict[int, list[int]]:
    """The trimmed paths of the kind that more sequences have; on a tie the circular one."""
    a = {k: v for k, v in start_end.items() if v is not None}
    b = {k: v for k, v in hairpin.items() if v is not None}
    return a if len(a) >= len(b) else b
