"""Longest common extensions on a run-length grammar built by recompression.

A sequence of symbols is shortened in turns: runs of one symbol become a symbol each,
then pairs of neighbours whose first symbol falls to the left half of the alphabet and whose second falls to
the right half do. What a symbol becomes depends on its surroundings alone, so equal
stretches are parsed alike but at their borders, and a common extension is found by
climbing while parents are equal and descending where they differ: a step or two a level. Names are numbers
given to what they stand for, so equal names mean equal contents.

All functions take arrays of queries and work on them together.
"""

from __future__ import annotations

import numpy as np
import pandas as pd

from upkeep.llm import words


class Level:
    """Symbols, and the index of each symbol's first child (one more at the end), and its parent."""

    def __init__(self, sym: np.ndarray, down: np.ndarray | None, runs: bool) -> None:
        self.sym, self.down, self.runs, self.up = sym, down, runs, None


def _parents(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Parent of each symbol and first child of each parent, from flags of first children."""
    return (np.cumsum(first) - 1).astype(np.int32), np.append(np.flatnonzero(first), len(first)).astype(np.int32)


def _numbers(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A number for each pair of small non-negative integers, the same for equal pairs."""
    wide = np.int64(b.max(initial=0)) + 1
    return pd.factorize(a.astype(np.int64) * wide + b)[0]


def grammar(sym: np.ndarray, longest: int, enough: int = 8) -> list[Level]:
    """Levels from ``sym`` upwards, until the longest part (``longest`` symbols at first) is about ``enough`` symbols.

    The first and last symbol must be unlike all others, and so must whatever ends a part.
    """
    sym = sym.astype(np.int64)
    levels, salt, left = [Level(sym, None, True)], 0, float(longest)
    while left > enough and len(sym) > 3:
        below, runs = levels[-1], levels[-1].runs
        first = np.ones(len(sym), bool)
        if runs:
            first[1:] = sym[1:] != sym[:-1]
            if first.all():  # nothing to join: this level does for the next turn
                below.runs = False
                continue
            below.up, down = _parents(first)
            size = np.diff(down)
            many = size > 1
            new = sym[down[:-1]]
            new[many] = int(sym.max()) + 1 + _numbers(new[many], size[many])
        else:
            salt += 1
            side = words.mix(sym.astype(np.uint64) + np.uint64(salt * 0x9E3779B97F4A7C15 % 2**64)) >> np.uint64(63) == 0
            first[1:] = ~(side[:-1] & ~side[1:])
            below.up, down = _parents(first)
            two = np.diff(down) > 1
            at = down[:-1]
            new = sym[at]
            new[two] = int(sym.max()) + 1 + _numbers(new[two], sym[at[two] + 1])
            left *= 0.76
        sym = new
        levels.append(Level(sym, down, not runs))
    return levels


def _step(level: Level, x: np.ndarray, y: np.ndarray, ahead: bool) -> np.ndarray:
    """How far two equal symbols and what follows them in their runs can be passed together."""
    if not level.runs or level.up is None:
        return np.ones(len(x), np.int32)
    down = level.next.down
    px, py = level.up[x], level.up[y]
    return np.minimum(down[px + 1] - x, down[py + 1] - y) if ahead else np.minimum(x - down[px], y - down[py]) + 1


def _border(level: Level, x: np.ndarray, ahead: bool) -> np.ndarray:
    """Whether these symbols are the first (last, going back) of their parents."""
    down, p = level.next.down, level.up[x]
    return down[p] == x if ahead else down[p + 1] == x + 1


def extend(levels: list[Level], i: np.ndarray, j: np.ndarray, ahead: bool = True) -> np.ndarray:
    """Length of the longest common extension of the symbols from ``i`` and ``j`` on, or up to them and back.

    ``i`` and ``j`` must differ in each query.
    """
    for low, high in zip(levels, levels[1:], strict=False):
        low.next = high
    sign, start = 1 if ahead else -1, i
    x, y = i.astype(np.int32), j.astype(np.int32)
    ids = np.arange(len(x))
    ended: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = [(ids[:0],) * 3 for _ in levels]  # by the level of the mismatch
    for k, level in enumerate(levels):
        if not len(ids):
            break
        top = level.up is None
        going = np.ones(len(ids), bool) if top else ~(_border(level, x, ahead) & _border(level, y, ahead))
        stop = np.zeros(len(ids), bool)
        while going.any():  # once below the top, but for queries that then sit at different places of a run
            g = np.flatnonzero(going)
            same = level.sym[x[g]] == level.sym[y[g]]
            stop[g[~same]], going[g[~same]] = True, False
            g = g[same]
            step = sign * _step(level, x[g], y[g], ahead)
            x[g] += step
            y[g] += step
            if not top:
                going[g] = ~(_border(level, x[g], ahead) & _border(level, y[g], ahead))
        if not top:  # both at borders: parents that are equal are passed higher up
            px, py = level.up[x], level.up[y]
            differ = ~stop & (level.next.sym[px] != level.next.sym[py])
            ended[k + 1] = (ids[differ], px[differ], py[differ])
            ended[k] = tuple(np.concatenate(z) for z in zip(ended[k], (ids[stop], x[stop], y[stop]), strict=True))
            climb = ~stop & ~differ
            ids, x, y = ids[climb], px[climb], py[climb]
        else:
            ended[k] = tuple(np.concatenate(z) for z in zip(ended[k], (ids[stop], x[stop], y[stop]), strict=True))
    # down again: different symbols share some of their first children and differ at the next
    ids, x, y = (np.zeros(0, np.int64), np.zeros(0, np.int32), np.zeros(0, np.int32))
    for k in range(len(levels) - 1, -1, -1):
        level = levels[k]
        ids, x, y = (np.concatenate(z) for z in zip((ids, x, y), ended[k], strict=True))
        if not k:
            break
        edge = 0 if ahead else 1
        x, y = level.down[x + edge] - edge, level.down[y + edge] - edge
        low = levels[k - 1]
        g = np.flatnonzero(low.sym[x] == low.sym[y])
        step = sign * _step(low, x[g], y[g], ahead)
        x[g] += step
        y[g] += step
    out = np.zeros(len(i), np.int64)
    out[ids] = np.abs(x - start[ids])
    return out
