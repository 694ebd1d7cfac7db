"""Suffix automaton of a shard of reference sequences."""

from __future__ import annotations

from collections.abc import Iterable


class SuffixAutomaton:
    """All substrings of the sequences added. Sequences come in ascending order of their ids; every state knows the first id.

    A state stands for substrings with the same occurrences, so the id under which it was made is the smallest that holds them.
    """

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link = [-1]
        self.length = [0]
        self.first = [-1]

    def _state(self, length: int, first: int, moves: dict[int, int]) -> int:
        self.next.append(moves)
        self.link.append(0)
        self.length.append(length)
        self.first.append(first)
        return len(self.length) - 1

    def _split(self, p: int, symbol: int, q: int) -> int:
        """The state of the longest substring at p and then the symbol, parted from q if q stands for longer ones."""
        if self.length[q] == self.length[p] + 1:
            return q
        part = self._state(self.length[p] + 1, self.first[q], dict(self.next[q]))
        self.link[part] = self.link[q]
        self.link[q] = part
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = part
            p = self.link[p]
        return part

    def add(self, sequence: Iterable[int], first: int) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = self._split(last, symbol, q)
                continue
            new = self._state(self.length[last] + 1, first, {})
            p = last
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = new
                p = self.link[p]
            self.link[new] = 0 if p < 0 else self._split(p, symbol, self.next[p][symbol])
            last = new

    def firsts(self, sequence: Iterable[int], width: int) -> list[int]:
        """For every end of the sequence, the first id that holds the last `width` symbols; -1 if none does.

        The matching statistics of the sequence, cut at `width`: the longest match at each end is followed along suffix links.
        """
        found = []
        state = matched = 0
        moves, link, length = self.next, self.link, self.length
        for symbol in sequence:
            while state and symbol not in moves[state]:
                state = link[state]
                matched = length[state]
            if symbol in moves[state]:
                state = moves[state][symbol]
                matched += 1
            while length[link[state]] >= width if state else False:
                state = link[state]
                matched = length[state]
            found.append(self.first[state] if matched >= width else -1)
        return found
