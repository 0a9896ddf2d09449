"""Concepts of short descriptions, learned from how their words meet.

Every item is described at least twice, by independent texts (a name and a file name, say).
Words that tell the item meet across the two far more often than by chance, marketing words
don't. Words of one kind of item meet each other, words of two kinds never do: kinds are
the clusters of average linkage over the logarithm of met and expected counts. Within a
kind, words that rule out the same other words and meet each other are one variant,
whatever their wording. All that is collected are counts of pairs of the frequent words, a
bounded number.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Meetings by chance from which on it tells something that there are none, and the part of them that counts as none.
EXPECTED, NONE = 3.0, 0.15
#: Average surplus (logarithm) of meetings for two clusters of words to be one kind.
ALIKE = np.log(1.5)
#: Part of the ruled-out words that words of one variant share.
SAME = 0.75


def surplus(met: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Logarithm of met to expected counts; near zero where too few are expected."""
    return np.log((met + 0.5) / (expected + 0.5))


def telling(cross: np.ndarray, first: np.ndarray, second: np.ndarray, total: int) -> np.ndarray:
    """Which words meet some word of the other text far more often than by chance.

    cross[i, j]: items with word i in the first and j in the second text; first, second:
    items with a word in either.
    """
    expected = first[:, None] * second[None, :] / max(1, total)
    sure = (cross >= 2 * expected) & (cross - expected >= 5 * np.sqrt(expected + 1))
    return sure.any(1) | sure.any(0)


def linked(similar: np.ndarray, least: float, members: list[int]) -> list[list[int]]:
    """Clusters of average linkage: the two most similar are joined until none is above least."""
    clusters = [[m] for m in members]
    s = similar[np.ix_(members, members)].astype(float).copy()
    np.fill_diagonal(s, -np.inf)
    size = np.ones(len(clusters))
    alive = np.ones(len(clusters), bool)
    while alive.sum() > 1:
        k = int(s.argmax())
        a, b = divmod(k, len(s))
        if s[a, b] < least:
            break
        merged = (s[a] * size[a] + s[b] * size[b]) / (size[a] + size[b])
        s[a], s[:, a] = merged, merged
        s[a, a] = -np.inf
        s[b], s[:, b] = -np.inf, -np.inf
        size[a] += size[b]
        alive[b] = False
        clusters[a] += clusters[b]
    return [sorted(c) for c, ok in zip(clusters, alive) if ok]


def ruled_out(met: np.ndarray, expected: np.ndarray) -> np.ndarray:
    """Pairs of words that don't meet though they would by chance."""
    return (expected >= EXPECTED) & (met <= NONE * expected)


def kinds(met: np.ndarray, count: np.ndarray, total: int, words: np.ndarray) -> list[list[int]]:
    """Clusters of the telling words whose words mostly rule each other out, largest first."""
    expected = count[:, None] * count[None, :] / max(1, total)
    s = surplus(met, expected)
    found = linked(s, ALIKE, [int(w) for w in np.flatnonzero(words)])
    out = ruled_out(met, expected)
    # a kind rules out the words of at least one other cluster; what rules out nothing is no kind
    kept = [c for c in found if any(d is not c and out[np.ix_(c, d)].mean() > 0.5 for d in found)]
    return sorted(kept, key=lambda c: (-count[c].sum(), c))


def kind_scores(met: np.ndarray, count: np.ndarray, total: int, found: list[list[int]]) -> np.ndarray:
    """(words, kinds): what a word says for a kind, the mean surplus with the kind's words."""
    s = surplus(met, count[:, None] * count[None, :] / max(1, total))
    np.fill_diagonal(s, np.nan)
    scores = np.zeros((len(count), len(found)))
    for k, members in enumerate(found):
        part = s[:, members]
        held = ~np.isnan(part)
        scores[:, k] = np.where(held, part, 0).sum(1) / np.maximum(1, held.sum(1))
        alone = ~held.any(1)
        scores[alone, k] = np.log(max(1, total) / np.maximum(1, count[alone]))
    return scores


def variants(met: np.ndarray, count: np.ndarray, total: int) -> list[list[int]]:
    """Clusters of words of one kind that tell the same variant, the most specific first.

    met and count are those of the items of the kind. A variant's words rule out the same
    words (the other variants') and meet each other; what rules out nothing tells none.
    """
    expected = count[:, None] * count[None, :] / max(1, total)
    out, known = ruled_out(met, expected), expected >= EXPECTED
    words = np.flatnonzero(out.sum(1) > 0)
    similar = np.full(met.shape, -np.inf)
    for w in words:
        for v in words:
            if w != v and not out[w, v] and met[w, v] >= 1.5 * expected[w, v] and met[w, v] > 0:
                both = known[w] & known[v]
                a, b = out[w] & both, out[v] & both
                similar[w, v] = (a & b).sum() / max(1, (a | b).sum())
    similar = np.where(np.isinf(similar), -1.0, similar)
    clusters = linked(similar, SAME, [int(w) for w in words])
    return sorted(clusters, key=lambda c: (-np.mean([out[w].sum() for w in c]), c))


@dataclass
class Concepts:
    """What was learned: which words tell something, their scores for kinds, and the variants of each kind in order of specificity."""

    telling: np.ndarray
    scores: np.ndarray
    variants: list[list[list[int]]]

    def __post_init__(self) -> None:
        self.of = [{w: v for v, c in enumerate(found) for w in c} for found in self.variants]

    def variant(self, kind: int, words) -> int | None:
        """Variant of an item of a kind: that of most of its words, the more specific one at a tie."""
        votes: dict[int, int] = {}
        for w in words:
            v = self.of[kind].get(int(w))
            if v is not None:
                votes[v] = votes.get(v, 0) + 1
        return min(votes, key=lambda v: (-votes[v], v)) if votes else None
