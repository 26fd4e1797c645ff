"""Similar sets within one group of sets, found by traversing a prefix tree.

Sets are sequences of tokens in one global order, rarest first. They are stored in a trie
whose edges hold the runs of tokens between fixed depths (``DEPTHS``), so sets that begin alike
share nodes. A probe goes down the levels with the overlap so far of every live node at once;
what sets share is counted once. A subtree is pruned when its overlap and the tokens that
remain, on either side, cannot reach the required overlap of its smallest set.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

# Depths at which trie nodes end: runs of 16, 32, 64, ... tokens.
DEPTHS = np.cumsum(16 << np.arange(40))


@dataclass
class Level:
    tokens: np.ndarray  # the runs of all nodes, one after another
    starts: np.ndarray  # where each node's run begins in tokens
    lengths: np.ndarray
    last: np.ndarray  # last token of the run
    least: np.ndarray  # smallest set size below the node
    beneath: np.ndarray  # most tokens that a set has after the run
    low: np.ndarray  # sorted sets low..high-1 lie below the node
    high: np.ndarray
    end_high: np.ndarray  # sets low..end_high-1 end in the node
    child: np.ndarray  # first child in the next level
    children: np.ndarray


class Trie:
    """``sets``: ascending token arrays; ``sizes``: whole set sizes, tokens left out included."""

    def __init__(self, sets: list[np.ndarray], sizes: np.ndarray):
        keys = [s.astype(">u4").tobytes() for s in sets]
        self.order = np.array(sorted(range(len(sets)), key=keys.__getitem__), np.int64)
        ranked = [sets[i] for i in self.order]
        self.sizes = sizes[self.order]
        lengths = np.array([len(s) for s in ranked], np.int64)
        shared = np.zeros(len(ranked), np.int64)  # tokens shared with the set before
        for i in range(1, len(ranked)):
            a, b = ranked[i - 1], ranked[i]
            n = min(len(a), len(b))
            differ = np.flatnonzero(a[:n] != b[:n])
            shared[i] = differ[0] if len(differ) else n
        self.levels: list[Level] = []
        top = 0
        for depth in DEPTHS:
            if not len(lengths) or top >= lengths.max():
                break
            upto = np.minimum(lengths, depth)
            live = lengths > top
            new = live.copy()
            new[1:] &= ~(live[:-1] & (upto[1:] == upto[:-1]) & (shared[1:] >= upto[1:]))
            low = np.flatnonzero(new)
            # A node's sets are neighbours; it ends where the next one begins or at a shorter set.
            stops = np.flatnonzero(new | ~live)
            after = np.searchsorted(stops, low, "right")
            high = np.append(stops, len(ranked))[after]
            runs = [ranked[i][top : upto[i]] for i in low]
            n = upto[low] - top
            done = lengths <= depth
            ended = np.array([done[a:b].sum() for a, b in zip(low, high, strict=True)], np.int64)
            self.levels.append(
                Level(
                    np.concatenate(runs),
                    np.cumsum(n) - n,
                    n,
                    np.array([r[-1] for r in runs]),
                    np.array([self.sizes[a:b].min() for a, b in zip(low, high, strict=True)]),
                    np.array([lengths[a:b].max() for a, b in zip(low, high, strict=True)]) - upto[low],
                    low,
                    high,
                    low + ended,
                    np.zeros(len(low), np.int64),
                    np.zeros(len(low), np.int64),
                )
            )
            if len(self.levels) > 1:
                before = self.levels[-2]
                first = np.searchsorted(low, before.low)
                before.child, before.children = first, np.searchsorted(low, before.high) - first
            top = depth

    def linked(
        self, mask: np.ndarray, probe: np.ndarray, size: int, bar: tuple[int, int], above: int
    ) -> np.ndarray:
        """Sorted places beyond ``above`` of the sets similar to a probe.

        ``mask`` marks the probe's tokens; ``bar`` is the Jaccard similarity as (numerator,
        denominator).
        """
        part, whole = bar
        found = []
        if not self.levels:
            return np.zeros(0, np.int64)
        nodes = np.arange(len(self.levels[0].low))
        overlap = np.zeros(len(nodes), np.int64)
        for level in self.levels:
            keep = level.high[nodes] > above + 1
            nodes, overlap = nodes[keep], overlap[keep]
            if not len(nodes):
                break
            n = level.lengths[nodes]
            at = np.cumsum(n) - n
            flat = np.repeat(level.starts[nodes] - at, n) + np.arange(n.sum())
            overlap = overlap + np.add.reduceat(mask[level.tokens[flat]].astype(np.int64), at)
            rest = len(probe) - np.searchsorted(probe, level.last[nodes], "right")
            most = overlap + np.minimum(rest, level.beneath[nodes])
            alive = (part + whole) * most >= part * (level.least[nodes] + size)
            nodes, overlap = nodes[alive], overlap[alive]
            ends = np.flatnonzero(level.end_high[nodes] > level.low[nodes])
            for k in ends:
                places = np.arange(level.low[nodes[k]], level.end_high[nodes[k]])
                near = (part + whole) * overlap[k] >= part * (self.sizes[places] + size)
                found.append(places[near & (places > above)])
            n = level.children[nodes]
            at = np.cumsum(n) - n
            overlap = np.repeat(overlap, n)
            nodes = np.repeat(level.child[nodes] - at, n) + np.arange(n.sum())
        return np.concatenate(found) if found else np.zeros(0, np.int64)


class Components:
    """Connected components of a cell's sets, as the smallest member."""

    def __init__(self, n: int):
        self.label = np.arange(n)

    def link(self, one: int, others: np.ndarray) -> None:
        labels = np.unique(np.append(self.label[others], self.label[one]))
        if len(labels) > 1:
            self.label[np.isin(self.label, labels)] = labels[0]


def join_sets(
    sets: list[np.ndarray],
    sizes: np.ndarray,
    copies: np.ndarray,
    side: np.ndarray,
    bar: tuple[int, int],
    two_sided: bool | None = None,
) -> tuple[np.ndarray, np.ndarray]:
    """(component, linked documents) of each set.

    ``sets``: distinct 64-bit tokens of each set; ``side`` holds 0 and 1. If ``two_sided``, only
    pairs of unlike sides are compared, of which there are none where a side is empty; else all
    pairs are. Where it is not told, it is whether any side is 1. ``copies``: the documents behind
    each set.
    """
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, token, seen = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    # Rarest first; a token of one set only can't be shared and is left out of the tree.
    rank = np.empty(len(seen), np.int64)
    rank[np.argsort(seen, kind="stable")] = np.arange(len(seen))
    kept = seen[token] > 1
    by_set = np.lexsort((rank[token[kept]], owner[kept]))
    ranks, owner = rank[token[kept]][by_set], owner[kept][by_set]
    cuts = np.searchsorted(owner, np.arange(n + 1))
    sets = [ranks[cuts[i] : cuts[i + 1]] for i in range(n)]

    part, whole = bar
    # Similar sets differ in size by less than the ratio, so they are in the same band or the next.
    if part == whole:
        band = sizes.astype(np.int64)
    else:
        band = np.floor(np.log(np.maximum(sizes, 1)) / np.log(whole / part)).astype(np.int64)
    two_sided = bool(side.any()) if two_sided is None else two_sided
    components, links = Components(n), np.zeros(n, np.int64)
    mask = np.zeros(len(seen), bool)
    tries = {}
    for b in np.unique(band[side == 0]):
        members = np.flatnonzero((band == b) & (side == 0))
        tries[b] = (members, Trie([sets[i] for i in members], sizes[members]))
    probes = np.flatnonzero(side == 1) if two_sided else np.arange(n)
    places = {b: {int(x): k for k, x in enumerate(m[t.order])} for b, (m, t) in tries.items()}
    for y in probes:
        mask[sets[y]] = True
        # Two bands down or up, so that rounding at a band's edge loses nothing.
        for b in range(band[y] - 2, band[y] + (3 if two_sided else 1)):
            if b not in tries:
                continue
            members, trie = tries[b]
            above = places[b][int(y)] if not two_sided and b == band[y] else -1
            near = trie.linked(mask, sets[y], int(sizes[y]), bar, above)
            if len(near):
                others = members[trie.order[near]]
                components.link(int(y), others)
                links[y] += copies[others].sum()
                links[others] += copies[y]
        mask[sets[y]] = False
    return components.label, links
