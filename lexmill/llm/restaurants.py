"""Gibbs moves of Chinese restaurants: all customers of a dish leave and are seated again, one after the other.

A dish's seating is told by the ranks of the customers that opened a table, the first one aside; the sizes of its tables
do not matter for anything that is asked.  With i customers at t tables, the next one opens a table with weight a(t) =
new + more * t and joins one with weight i - d t.  Whole runs of customers who join are drawn at once: the chance that
the next customer opens a table is a Beta variable given that none did so far, so the gap is geometric.  The seating drawn
so is a proposal for the dish's block of customers; it is taken or refused by the ratio of the weights that the sequence
was drawn with, which makes the move leave the posterior of the seating as it is.  The work follows the tables, not
the customers, so a dish served a billion times costs no more steps than its tables.
"""

from __future__ import annotations

import numpy as np

#: Least chance of a new table that is told from none.
TINY = 1e-15
#: Dishes that are left to be seated from which on they are faster one by one than as an array.
FEW = 12


def log_gamma(x: np.ndarray) -> np.ndarray:
    """Stirling's series after seven steps up; exact to ten places for x > 0."""
    z = x + 7.0
    low = np.log(x * (x + 1) * (x + 2) * (x + 3) * (x + 4) * (x + 5) * (x + 6))
    r = 1.0 / (z * z)
    return (z - 0.5) * np.log(z) - z + 0.9189385332046727 + (1 / 12.0 - r * (1 / 360.0 - r / 1260.0)) / z - low


def _segments(c: np.ndarray, opened: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(dish, tables, first customer, end) of every run of customers that meets one number of tables; the opener ends it."""
    parts = opened + 1
    dish = np.repeat(np.arange(len(c)), parts)
    place = np.arange(len(dish)) - np.repeat(np.cumsum(parts) - parts, parts)
    start, end = np.ones(len(dish)), np.empty(len(dish))
    start[place > 0] = ranks + 1
    final = place == opened[dish]
    end[~final] = ranks + 1
    end[final] = c
    return dish, place + 1, start, end


def log_weight(c: np.ndarray, new: np.ndarray, more: np.ndarray, d: float, opened: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """Logarithm of the total weights met along each dish's sequence of customers."""
    dish, t, start, end = _segments(c, opened, ranks)
    a = new[dish] + more[dish] * t
    return np.bincount(dish, log_gamma(end - d * t + a) - log_gamma(start - d * t + a), minlength=len(c))


def _propose_one(c: float, new: float, more: float, d: float, n: float, t: float, rng: np.random.Generator) -> list[float]:
    """Ranks of the openers among the customers of one dish who come after the first n, who sit at t tables."""
    ranks = []
    while n < c:
        p = min(max(rng.beta(max(new + more * t, TINY), n - d * t), TINY), 1.0)
        at = n + rng.geometric(p) - 1.0
        if at >= c:
            break
        ranks.append(at)
        t += 1.0
        n = at + 1.0
    return ranks


def propose(c: np.ndarray, new: np.ndarray, more: np.ndarray, d: float, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """(openers beside the first, their ranks dish by dish) of seatings drawn customer by customer."""
    live, n, t = np.flatnonzero(c > 1), np.ones(len(c)), np.ones(len(c))
    dishes, found = [], []
    while len(live) > FEW:
        a = np.maximum(new[live] + more[live] * t[live], TINY)
        p = np.clip(rng.beta(a, n[live] - d * t[live]), TINY, 1.0)
        at = n[live] + rng.geometric(p) - 1.0
        opens = at < c[live]
        live, at = live[opens], at[opens]
        dishes.append(live)
        found.append(at)
        t[live] += 1
        n[live] = at + 1
        live = live[n[live] < c[live]]
    for i in live.tolist():
        found.append(np.array(_propose_one(float(c[i]), float(new[i]), float(more[i]), d, float(n[i]), float(t[i]), rng)))
        dishes.append(np.full(len(found[-1]), i))
    dish, ranks = (np.concatenate(x) if x else np.zeros(0) for x in (dishes, found))
    order = np.argsort(dish, kind="stable")
    return np.bincount(dish.astype(np.int64), minlength=len(c)), ranks[order]


def carry(c: np.ndarray, opened: np.ndarray, ranks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A stored seating for another number of customers: those of higher rank have left, more sit at tables that are there."""
    dish = np.repeat(np.arange(len(c)), opened)
    stays = ranks < c[dish]
    return np.bincount(dish[stays], minlength=len(c)), ranks[stays]


def reseat(c: np.ndarray, new: np.ndarray, more: np.ndarray, d: float, opened: np.ndarray, ranks: np.ndarray, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """One move of every dish from its stored seating; the tables are ``opened`` + 1."""
    c = c.astype(float)
    drawn, at = propose(c, new, more, d, rng)
    ratio = log_weight(c, new, more, d, drawn, at) - log_weight(c, new, more, d, opened, ranks)
    taken = np.log(rng.random(len(c))) < ratio
    kept = np.where(taken, drawn, opened)
    out = np.empty(kept.sum())
    dish = np.repeat(np.arange(len(c)), kept)
    out[taken[dish]] = at[taken[np.repeat(np.arange(len(c)), drawn)]]
    out[~taken[dish]] = ranks[~taken[np.repeat(np.arange(len(c)), opened)]]
    return kept, out
