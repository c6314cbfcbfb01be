"""Slow and plain versions of the operators, for the tests."""

from __future__ import annotations

import math
import re

import numpy as np

# A word: ASCII letters and digits, or characters beyond ASCII, lower-cased.
WORD = re.compile(r"[0-9a-z\u0080-\U0010ffff]+")


def gram_set(text: str | None, n: int) -> frozenset:
    words = WORD.findall((text or "").lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def jaccard_pairs(rows: list[tuple[int, str | None]], t: float, n: int) -> dict[tuple[int, int], float]:
    sets: dict[int, frozenset] = {}
    for i, text in rows:
        s = gram_set(text, n)
        if i is not None and s and len(s) > len(sets.get(i, ())):
            sets[i] = s
    held: dict[tuple, list[int]] = {}
    for i, s in sets.items():
        for g in s:
            held.setdefault(g, []).append(i)
    inter: dict[tuple[int, int], int] = {}
    for ids in held.values():
        ids = sorted(ids)
        for k, a in enumerate(ids):
            for b in ids[k + 1 :]:
                inter[a, b] = inter.get((a, b), 0) + 1
    out = {}
    for (a, b), c in inter.items():
        j = c / (len(sets[a]) + len(sets[b]) - c)
        if j >= t - 1e-9:
            out[a, b] = j
    return out


def groups(pairs) -> dict[int, int]:
    """Node -> smallest id that it is connected to."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in pairs:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {x: find(x) for x in root}


def nearest(ids: np.ndarray, x: np.ndarray, k: int) -> dict[int, list[int]]:
    x = x.astype(np.float64)
    out = {}
    for i in range(len(ids)):
        d = np.sqrt(((x - x[i]) ** 2).sum(1))
        o = np.lexsort((ids, d))
        out[int(ids[i])] = [int(ids[j]) for j in o if j != i][:k]
    return out


U64 = (1 << 64) - 1


def splitmix(h: int) -> int:
    h ^= h >> 30
    h = h * 0xBF58476D1CE4E5B9 & U64
    h ^= h >> 27
    h = h * 0x94D049BB133111EB & U64
    return h ^ h >> 31


def word_hash(word: bytes, table, base: int) -> int:
    total = sum(int(table[b]) * pow(base, i, 1 << 64) for i, b in enumerate(word)) & U64
    return splitmix(total ^ len(word) * 0xD6E8FEB86659FD93 & U64)


def toxicity_features(text: str | None, bits: int, table, base: int, step, prefixes) -> set[int]:
    """Buckets of the words, their beginnings, and of pairs next to each other or one apart."""
    words = re.findall(rb"[0-9a-zA-Z\x80-\xff]+", (text or "").lower().encode())
    h = [word_hash(w, table, base) for w in words]
    out = set(h)
    out |= {splitmix(word_hash(w[:k], table, base) + k & U64) for w in words for k in prefixes if len(w) > k}
    for gap in (1, 2):
        out |= {splitmix(a * (2 * gap + 1) + b * int(step[gap + 8]) & U64) for a, b in zip(h, h[gap:])}
    return {x >> (64 - bits) for x in out}


def ftrl(rows: list[set[int]], labels: list[float], order, alpha: float, beta: float, l1: float, l2: float) -> tuple[dict[int, float], float]:
    """The published update, a coordinate at a time, over the rows in ``order``; the bias is coordinate -1."""
    z: dict[int, float] = {}
    n: dict[int, float] = {}

    def weight(i: int) -> float:
        zi = z.get(i, 0.0)
        return 0.0 if abs(zi) <= l1 else -(zi - math.copysign(l1, zi)) / ((beta + math.sqrt(n.get(i, 0.0))) / alpha + l2)

    for k in order:
        own = [*rows[k], -1]
        w = {i: weight(i) for i in own}
        g = 1 / (1 + math.exp(-max(-35, min(35, sum(w.values()))))) - labels[k]
        if abs(g) < 1e-4:
            continue
        for i in own:
            ni = n.get(i, 0.0)
            z[i] = z.get(i, 0.0) + g - (math.sqrt(ni + g * g) - math.sqrt(ni)) / alpha * w[i]
            n[i] = ni + g * g
    weights = {i: weight(i) for i in z}
    return {i: w for i, w in weights.items() if w and i >= 0}, weights.get(-1, 0.0)


def shares(budget: float, children: dict[object, tuple[float, float]]) -> dict[object, float]:
    """(weight, capacity) of each child: what it gets of a budget, by the level to which all are filled, found by halving."""
    own = {k: (w, c) for k, (w, c) in children.items() if w > 0 and c > 0}
    budget = min(budget, sum(c for _, c in own.values()))
    lo, hi = 0.0, max((c / w for w, c in own.values()), default=0.0)
    for _ in range(200):
        mid = (lo + hi) / 2
        if sum(min(c, mid * w) for w, c in own.values()) < budget:
            lo = mid
        else:
            hi = mid
    return {k: min(own[k][1], hi * own[k][0]) if k in own else 0.0 for k in children}


def budgets(supply: dict[tuple, int], mix) -> dict[tuple, float]:
    """Each leaf's tokens, level by level."""
    weights = (mix.domain_weights, mix.lang_weights, mix.source_weights)
    held = {(): mix.share * sum(supply.values()) if mix.budget is None else mix.budget}
    for depth in range(3):
        nxt: dict[tuple, float] = {}
        for prefix, budget in held.items():
            children: dict[tuple, list[float]] = {}
            for leaf, tokens in supply.items():
                if leaf[:depth] == prefix:
                    usable = all(weights[d].get(leaf[d], 1.0) > 0 for d in range(depth, 3))
                    one = children.setdefault(leaf[: depth + 1], [weights[depth].get(leaf[depth], 1.0), 0.0])
                    one[1] += tokens * mix.epochs * usable
            nxt |= shares(budget, {k: tuple(v) for k, v in children.items()})
        held = nxt
    return held
