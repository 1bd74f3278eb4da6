"""Generalised suffix automaton over sequences of any hashable symbols."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """State 0 is empty. ``step[s]``: transitions; ``link[s]``: the state of the longest suffix of another class;
    ``length[s]``: the longest string of state s. At most two states for each symbol of the sequences."""

    def __init__(self, sequences: Iterable[Sequence]):
        self.link, self.length, self.step = [-1], [0], [{}]
        for seq in sequences:
            last = 0
            for c in seq:
                last = self._extend(last, c)

    def _state(self, length: int, link: int, step: dict) -> int:
        self.link.append(link)
        self.length.append(length)
        self.step.append(step)
        return len(self.link) - 1

    def _split(self, p: int, c, q: int) -> int:
        """A state for what p's strings followed by c have of q's."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1, self.link[q], dict(self.step[q]))
        self.link[q] = copy
        while p >= 0 and self.step[p].get(c) == q:
            self.step[p][c] = copy
            p = self.link[p]
        return copy

    def _extend(self, last: int, c) -> int:
        if (q := self.step[last].get(c)) is not None:
            return self._split(last, c, q)
        new, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and c not in self.step[p]:
            self.step[p][c] = new
            p = self.link[p]
        if p >= 0:
            self.link[new] = self._split(p, c, self.step[p][c])
        return new

    def walk(self, seq: Sequence):
        """The state after each symbol of ``seq``, which must occur in the sequences."""
        s = 0
        for c in seq:
            s = self.step[s][c]
            yield s
