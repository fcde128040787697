"""Vantage-point trees over 64-bit fingerprints under (masked) Hamming distance.

The number of differing bits below a mask is a pseudometric, so at a node with vantage point v, mask m and
threshold mu the triangle inequality holds: a partner of x within r bits below m lies inside (d_m(v, y) <= mu)
only if d_m(v, x) <= mu + r and outside only if d_m(v, x) > mu - r. Of two fingerprints that differ in at
most ``radius`` bits, one half of the bits differs in at most radius // 2; a tree is therefore built for each
half, whose pairs lie within the narrow bound below that half and within ``radius`` below any other mask. A tree
without a half is one of whole keys.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

HALVES = (np.uint64(0xFFFFFFFF00000000), np.uint64(0x00000000FFFFFFFF))
FULL = np.uint64(0xFFFFFFFFFFFFFFFF)


@dataclass(frozen=True)
class Node:
    mask: int
    radius: int
    point: int
    mu: int
    inside: "Node | int"
    outside: "Node | int"


def distance(a: np.ndarray, b, mask=FULL) -> np.ndarray:
    return np.bitwise_count((a ^ np.uint64(b)) & np.uint64(mask)).astype(np.int16)


def bounds(half: int | None, radius: int) -> list[tuple[np.uint64, int]]:
    """(mask, bits) within which partners lie: of a tree for a half, or of one for whole keys without a half."""
    return [(FULL, radius)] if half is None else [(HALVES[half], radius // 2), (HALVES[1 - half], radius), (FULL, radius)]


def split(homes: np.ndarray, half: int | None, radius: int, rng: np.random.Generator):
    """The cheapest of a few vantage points and masks as (mask, r, point, mu), None if no split helps.

    The cost of a split is the number of (home, member) comparisons that remain on both sides, as estimated on
    ``homes``.
    """
    best, n = (0.9 * len(homes) ** 2, None), len(homes)
    for mask, r in bounds(half, radius):
        for point in homes[rng.integers(0, n, 6)]:
            d = distance(homes, point, mask)
            mu = int(np.median(d))
            for cut in {mu, mu - 1}:
                inside = int((d <= cut).sum())
                cost = inside * int((d <= cut + r).sum()) + (n - inside) * int((d > cut - r).sum())
                if 0 < inside < n and cost < best[0]:
                    best = (cost, (int(mask), r, int(point), cut))
    return best[1]


def build(sample: np.ndarray, half: int | None, radius: int, leaves: int, seed: int) -> Node | int:
    """A tree of at most about ``leaves`` leaves, fitted on the sample; leaves are numbered from 0."""
    rng, number = np.random.default_rng(seed), iter(range(1 << 62))

    def grow(fps: np.ndarray, depth: int) -> Node | int:
        rule = split(fps, half, radius, rng) if depth > 0 and len(fps) >= 8 else None
        if rule is None:
            return next(number)
        near = distance(fps, rule[2], rule[0]) <= rule[3]
        return Node(*rule, grow(fps[near], depth - 1), grow(fps[~near], depth - 1))

    return grow(sample, max(0, int(np.ceil(np.log2(max(1, leaves))))))


def implied(leaf: int, half: int | None, radius: int, bits: int) -> Node:
    """The split of a leaf beyond the fitted tree: a vantage point made from the leaf's number, at the middle distance.

    A fitted tree has a bounded number of leaves. Where a table needs more, each leaf goes on by points that every
    task can make alone; as far as fingerprints are even, they part a leaf about in the middle.
    """
    mask, r = bounds(half, radius)[0]
    point = int(np.random.default_rng([leaf, 1 if half is None else 2 + half]).integers(0, 1 << 64, dtype=np.uint64)) & ((1 << bits) - 1 if half is None else int(FULL))
    return Node(int(mask), r, point, (bits if half is None else 32) // 2, 2 * leaf + 1, 2 * leaf + 2)


def route(tree: Node | int, fps: np.ndarray, more: int = 0, half: int | None = None, radius: int = 0, bits: int = 64):
    """Yields (leaf, indices of homes, indices of visitors): each fingerprint has one home leaf and visits
    every other leaf in which the triangle bounds allow a partner. Each leaf is split ``more`` times again."""
    stack = [(tree, 0, np.arange(len(fps)), np.arange(0))]
    while stack:
        node, below, home, visit = stack.pop()
        if not len(home) and not len(visit):
            continue
        if not isinstance(node, Node):
            if below >= more:
                yield node, home, visit
                continue
            # Numbers of a leaf's parts: unique below it, and apart from those of other leaves.
            node, below = implied(node if below else (node + 1) << 2, half, radius, bits), below + 1
        dh, dv = distance(fps[home], node.point, node.mask), distance(fps[visit], node.point, node.mask)
        near, r, mu = dh <= node.mu, node.radius, node.mu
        stack.append((node.inside, below, home[near], np.concatenate([visit[dv <= mu + r], home[~near & (dh <= mu + r)]])))
        stack.append((node.outside, below, home[~near], np.concatenate([visit[dv > mu - r], home[near & (dh > mu - r)]])))


def pairs(homes: np.ndarray, members: np.ndarray, half: int | None, radius: int, seed: int = 0):
    """Yields arrays (i, j) of homes[i] and members[j] within ``radius`` bits.

    Recurses by further vantage points while that saves comparisons, then compares in blocks. Finds every pair
    whose distance is at most ``radius`` in all and at most radius // 2 below the half; others may be found too.
    """
    rng = np.random.default_rng(seed)
    stack = [(np.arange(len(homes)), np.arange(len(members)))]
    while stack:
        h, m = stack.pop()
        if not len(h) or not len(m):
            continue
        rule = split(homes[h], half, radius, rng) if len(h) > 256 and len(h) * len(m) > 1 << 20 else None
        if rule:
            mask, r, point, mu = rule
            dh, dm = distance(homes[h], point, mask), distance(members[m], point, mask)
            stack.append((h[dh <= mu], m[dm <= mu + r]))
            stack.append((h[dh > mu], m[dm > mu - r]))
            continue
        step = max(1, (1 << 22) // len(m))
        for at in range(0, len(h), step):
            near = np.bitwise_count(homes[h[at : at + step], None] ^ members[None, m]) <= radius
            i, j = np.nonzero(near)
            yield h[at + i], m[j]
