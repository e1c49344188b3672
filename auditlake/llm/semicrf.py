"""A semi-Markov conditional random field over sparse candidate segments.

A text is a set of candidate segments (start, end, kind, features); everything between chosen segments is outside and
scores 0. A labelling is a chain of segments that do not overlap; its score is the sum of the segments' weights and of the
transitions between segments that stand next to each other. Training maximises the conditional likelihood by the
forward-backward algorithm over the chains; decoding is the Viterbi chain. Segments are bounded in length by whoever
proposes them, so the work is linear in the text.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Hashable
from dataclasses import dataclass, field

#: Segments at most this many characters apart are neighbours; further ones do not know of each other.
NEAR = 3


@dataclass(slots=True)
class Segment:
    start: int
    end: int
    kind: str
    features: list[Hashable] = field(default_factory=list)


def _link(a: Segment, b: Segment, text: str) -> str | None:
    """The transition feature of ``b`` after ``a``; none unless they are near."""
    gap = b.start - a.end
    return f"t|{a.kind}>{b.kind}|{text[a.end:b.start]}" if 0 <= gap <= NEAR else None


def clusters(segments: list[Segment]) -> list[list[Segment]]:
    """Segments in groups that cannot influence each other, each sorted by end."""
    out: list[list[Segment]] = []
    reach = None
    for s in sorted(segments, key=lambda s: (s.start, s.end, s.kind)):
        if reach is None or s.start > reach + NEAR:
            out.append([])
            reach = s.end
        out[-1].append(s)
        reach = max(reach, s.end)
    for g in out:
        g.sort(key=lambda s: (s.end, s.start, s.kind))
    return out


def _lse(values: list[float]) -> float:
    top = max(values)
    return top + math.log(sum(math.exp(v - top) for v in values))


#: Scores of feature groups that are remembered before the memory is emptied.
REMEMBERED = 400_000


class SemiCRF:
    """``expand`` gives the features of a group, where segments carry groups of features; each stands for itself otherwise."""

    def __init__(self, weights: dict[Hashable, float] | None = None, expand: Callable[[Hashable], list[Hashable]] = lambda f: [f]) -> None:
        self.weights: dict[Hashable, float] = weights or {}
        self.expand = expand
        self._known: dict[Hashable, float] = {}
        self._link: float | None = None

    def _score(self, s: Segment) -> float:
        """The segment's score by the weights as they are; groups are remembered, so only for decoding."""
        known, total = self._known, 0.0
        for group in s.features:
            v = known.get(group)
            if v is None:
                if len(known) > REMEMBERED:
                    known.clear()
                w = self.weights
                v = known[group] = sum([w.get(f, 0.0) for f in self.expand(group)])
            total += v
        return total

    def _features(self, s: Segment) -> list[Hashable]:
        return [f for group in s.features for f in self.expand(group)]

    def viable(self, segments: list[Segment]) -> list[tuple[Segment, float]]:
        """The segments, with their scores, that can be in a best chain.

        One whose score and two best transitions sum up to nothing or less improves no chain by being in it; leaving it
        out links its neighbours only if it is no longer than NEAR, and such short ones are kept.
        """
        link = 2 * max((w for f, w in self.weights.items() if isinstance(f, str) and f.startswith("t|")), default=0.0) if self._link is None else self._link
        self._link = link = max(0.0, link)
        scored = [(s, self._score(s)) for s in segments]
        return [(s, v) for s, v in scored if v + link > 0 or s.end - s.start <= NEAR]

    def _before(self, group: list[Segment], text: str) -> list[tuple[int, list[tuple[int, str, float]]]]:
        """For each segment: how many segments end well before its start, and the near ones with their transition."""
        ends, out = [s.end for s in group], []
        for s in group:
            far, n = bisect_left(ends, s.start - NEAR), bisect_right(ends, s.start)
            links = [(i, _link(group[i], s, text)) for i in range(far, n)]
            out.append((far, [(i, f, self.weights.get(f, 0.0)) for i, f in links]))
        return out

    def decode(self, segments: list[Segment], text: str) -> list[Segment]:
        """The best chain, in order of position. Ties: the chain with fewer and then earlier segments."""
        chosen: list[Segment] = []
        scored = self.viable(segments)
        value = {id(s): v for s, v in scored}
        for group in clusters([s for s, _ in scored]):
            before = self._before(group, text)
            best: list[tuple[float, int]] = []  # of chains that end with segment i: score, previous segment (-1: none)
            prefix: list[tuple[float, int]] = [(0.0, -1)]  # best among the first n segments
            for i, s in enumerate(group):
                far, near = before[i]
                top = max([prefix[far], *[(best[j][0] + w, j) for j, _, w in near]], key=lambda p: p[0])
                best.append((top[0] + value[id(s)], top[1]))
                prefix.append(max(prefix[-1], (best[i][0], i), key=lambda p: p[0]))
            at, chain = prefix[-1][1], []
            while at >= 0:
                chain.append(group[at])
                at = best[at][1]
            chosen += chain[::-1]
        return chosen

    def _gradient(self, segments: list[Segment], gold: set[tuple[int, int, str]], text: str, grad: dict[str, float]) -> float:
        """Add the gradient of the log likelihood of the gold chain; returns the log likelihood."""
        total = 0.0
        for group in clusters(segments):
            m, before = len(group), self._before(group, text)
            every = [self._features(s) for s in group]
            w_ = self.weights
            score = [sum([w_.get(f, 0.0) for f in fs]) for fs in every]
            alpha, upto = [0.0] * m, [0.0] + [0.0] * m  # upto[n]: log sum over chains within the first n segments
            for i in range(m):
                far, near = before[i]
                alpha[i] = score[i] + _lse([upto[far], *[alpha[j] + w for j, _, w in near]])
                upto[i + 1] = _lse([upto[i], alpha[i]])
            z = upto[m]
            # Backward: beta[i] is the log sum of what may follow segment i.
            after: list[list[tuple[int, float]]] = [[] for _ in range(m)]
            for j in range(m):
                far, near = before[j]
                for i in range(far):
                    after[i].append((j, 0.0))
                for i, _, w in near:
                    after[i].append((j, w))
            beta = [0.0] * m
            for i in range(m - 1, -1, -1):
                beta[i] = _lse([0.0, *[w + score[j] + beta[j] for j, w in after[i]]])
            chain = [i for i, s in enumerate(group) if (s.start, s.end, s.kind) in gold]
            follows = dict(zip(chain[1:], chain, strict=False))  # the gold segment before each
            for i in chain:
                total += score[i]
                for f in every[i]:
                    grad[f] += 1.0
            for i in range(m):
                p = math.exp(min(0.0, alpha[i] + beta[i] - z))
                for f in every[i]:
                    grad[f] -= p
                for j, link, w in before[i][1]:
                    grad[link] -= math.exp(min(0.0, alpha[j] + w + score[i] + beta[i] - z))
                    if follows.get(i) == j:
                        grad[link] += 1.0
                        total += w
            total -= z
        return total

    def fit(self, samples: list[tuple[str, list[Segment], set[tuple[int, int, str]]]], epochs: int = 5, rate: float = 0.3, decay: float = 1e-4) -> list[float]:
        """AdaGrad over the samples (text, candidates, gold segments) in their order; the mean log likelihood per epoch.

        The weights are the mean of those at the ends of the later half of the epochs.
        """
        seen: dict[Hashable, float] = defaultdict(float)
        history, mean = [], defaultdict(float)
        for epoch in range(epochs):
            total = 0.0
            for text, segments, gold in samples:
                grad: dict[str, float] = defaultdict(float)
                total += self._gradient(segments, gold, text, grad)
                for f, g in grad.items():
                    if g:
                        g -= decay * self.weights.get(f, 0.0)
                        seen[f] += g * g
                        self.weights[f] = self.weights.get(f, 0.0) + rate * g / math.sqrt(seen[f] + 1e-8)
            if epoch >= epochs // 2:
                for f, w in self.weights.items():
                    mean[f] += w / (epochs - epochs // 2)
            history.append(total / max(1, len(samples)))
        self.weights, self._link = dict(mean), None
        self._known.clear()
        return history
