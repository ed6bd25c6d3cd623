"""Cutting stock by column generation over a histogram of item sizes.

A linear program over patterns (how many items of each size one bin holds) is solved by
the simplex method; a knapsack dynamic program over the dual prices finds the pattern to
enter. The size of the problem is that of the histogram, not of the number of items.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class Pattern:
    """``bins`` bins that hold ``copies[size]`` items each."""

    copies: dict[int, int]
    bins: int


def best_fill(sizes: np.ndarray, prices: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """The most valuable multiset of items within ``capacity``; ``sizes`` ascend."""
    value = np.zeros(capacity + 1)
    taken = np.full(capacity + 1, -1)
    fitting = np.searchsorted(sizes, np.arange(capacity + 1), side="right")
    for room in range(1, capacity + 1):
        value[room] = value[room - 1]
        n = fitting[room]
        if n:
            worth = value[room - sizes[:n]] + prices[:n]
            best = int(worth.argmax())
            if worth[best] > value[room] + 1e-12:
                value[room], taken[room] = worth[best], best
    counts, room = np.zeros(len(sizes)), capacity
    while room > 0:
        if taken[room] < 0:
            room -= 1
        else:
            counts[taken[room]] += 1
            room -= sizes[taken[room]]
    return float(value[capacity]), counts


def solve(sizes: np.ndarray, demand: np.ndarray, capacity: int, gap: float, rounds: int) -> tuple[np.ndarray, np.ndarray]:
    """Patterns (columns) and how often each is used, fractional, to meet ``demand``.

    Stops where the dual bound proves the relaxation to be within ``gap`` of its optimum.
    """
    n = len(sizes)
    patterns = np.diag((capacity // sizes).astype(float))
    inverse = np.diag(1 / np.diag(patterns))
    used = inverse @ demand
    for _ in range(rounds):
        prices = inverse.sum(axis=0)
        worth, column = best_fill(sizes, np.maximum(prices, 0), capacity)
        if worth <= 1 + 1e-9 or worth - 1 <= gap:
            break
        change = inverse @ column
        rising = change > 1e-9
        steps = np.full(n, np.inf)
        steps[rising] = used[rising] / change[rising]
        leaves = int(steps.argmin())
        used = np.maximum(used - steps[leaves] * change, 0)
        used[leaves] = steps[leaves]
        patterns[:, leaves] = column
        pivot = inverse[leaves] / change[leaves]
        inverse -= np.outer(change, pivot)
        inverse[leaves] = pivot
    return patterns, used


def fit_decreasing(sizes: list[int], capacity: int) -> list[dict[int, int]]:
    """Best fit of single items, largest first: one pattern per bin."""
    rooms: list[list[int]] = [[] for _ in range(capacity + 1)]
    bins: list[dict[int, int]] = []
    for size in sorted(sizes, reverse=True):
        room = next((r for r in range(size, capacity + 1) if rooms[r]), None)
        if room is None:
            bins.append({})
            at, room = len(bins) - 1, capacity
        else:
            at = rooms[room].pop()
        bins[at][size] = bins[at].get(size, 0) + 1
        rooms[room - size].append(at)
    return bins


def plan(histogram: dict[int, int], capacity: int, gap: float = 2e-4, rounds: int = 6000) -> list[Pattern]:
    """Patterns that hold exactly the items of ``histogram`` (size to number).

    The solution of the linear program is rounded down; what is left, at most one bin per
    pattern, is packed by best fit.
    """
    if not histogram:
        return []
    sizes = np.array(sorted(histogram))
    demand = np.array([histogram[s] for s in sizes.tolist()], dtype=float)
    patterns, used = solve(sizes, demand, capacity, gap, rounds)
    left = {s: histogram[s] for s in sizes.tolist()}
    chosen = []
    for column, bins in zip(patterns.T, np.floor(used + 1e-6).astype(int).tolist(), strict=True):
        copies = {int(s): int(c) for s, c in zip(sizes, column, strict=True) if c}
        bins = min([bins, *(left[s] // c for s, c in copies.items())])
        if bins > 0:
            chosen.append(Pattern(copies, bins))
            for size, c in copies.items():
                left[size] -= c * bins
    # Many items of one size may be left only if the program stopped early.
    for size in sizes.tolist():
        each = capacity // size
        if (whole := left[size] // each - 1) > 0:
            chosen.append(Pattern({size: each}, whole))
            left[size] -= whole * each
    rest = [s for s, n in left.items() for _ in range(n)]
    return chosen + [Pattern(copies, 1) for copies in fit_decreasing(rest, capacity)]
