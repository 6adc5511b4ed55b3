"""A suffix automaton over several sequences that remembers in which document each substring came first."""

from __future__ import annotations


class SuffixAutomaton:
    """Documents are added in ascending order; a state's document is the first that holds its substrings."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length, self.doc = [-1], [0], [0]

    def _clone(self, p: int, q: int, symbol: int) -> int:
        clone = len(self.next)
        self.next.append(self.next[q].copy())
        self.link.append(self.link[q])
        self.length.append(self.length[p] + 1)
        self.doc.append(self.doc[q])
        self.link[q] = clone
        while p >= 0 and self.next[p].get(symbol) == q:
            self.next[p][symbol] = clone
            p = self.link[p]
        return clone

    def add(self, sequence: list[int], doc: int) -> None:
        last = 0
        for symbol in sequence:
            q = self.next[last].get(symbol)
            if q is not None:
                last = q if self.length[q] == self.length[last] + 1 else self._clone(last, q, symbol)
                continue
            state, p = len(self.next), last
            self.next.append({})
            self.link.append(0)
            self.length.append(self.length[last] + 1)
            self.doc.append(doc)
            while p >= 0 and symbol not in self.next[p]:
                self.next[p][symbol] = state
                p = self.link[p]
            if p >= 0:
                q = self.next[p][symbol]
                self.link[state] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, symbol)
            last = state

    def earlier(self, sequence: list[int], length: int, doc: int) -> list[int]:
        """Matching statistics: the ends of all windows of `length` symbols that a document before `doc` holds."""
        out, v, n = [], 0, 0
        following, link, size = self.next, self.link, self.length
        for i, symbol in enumerate(sequence):
            while v and symbol not in following[v]:
                v = link[v]
                n = size[v]
            q = following[v].get(symbol)
            if q is None:
                continue
            v, n = q, n + 1
            while size[link[v]] >= length:  # the shortest suffix of the match that still has `length` symbols
                v = link[v]
                n = size[v]
            if n >= length and self.doc[v] < doc:
                out.append(i + 1)
        return out
