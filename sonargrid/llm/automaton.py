"""Generalised suffix automaton over sequences of hashable symbols, with the least and greatest owner of every state."""

from __future__ import annotations

from collections.abc import Iterable, Sequence


class SuffixAutomaton:
    """Automaton of all substrings of several sequences.

    ``low`` and ``high`` hold, after ``settle()``, the least and greatest owner among the sequences in which a state's
    substrings occur; they differ exactly if there are two owners. ``occurs`` then answers in O(1) whether a substring
    has an owner besides a given one.
    """

    __slots__ = ("next", "link", "len", "low", "high")

    def __init__(self) -> None:
        self.next: list[dict] = [{}]
        self.link = [-1]
        self.len = [0]
        self.low: list = [None]
        self.high: list = [None]

    def add(self, symbols: Iterable, low, high=None) -> None:
        """Add a sequence that occurs with owners from ``low`` to ``high``."""
        high = low if high is None else high
        nxt, link, length, lows, highs = self.next, self.link, self.len, self.low, self.high
        last = 0
        for c in symbols:
            q = nxt[last].get(c)
            if q is not None and length[q] == length[last] + 1:
                last = q  # the state exists since an earlier sequence
            else:
                if q is None:
                    cur = len(nxt)
                    nxt.append({})
                    length.append(length[last] + 1)
                    link.append(0)
                    lows.append(None)
                    highs.append(None)
                    p = last
                    while p != -1 and c not in nxt[p]:
                        nxt[p][c] = cur
                        p = link[p]
                    if p == -1:
                        last = cur
                    else:
                        q = nxt[p][c]
                        if length[q] == length[p] + 1:
                            link[cur] = q
                        else:
                            link[cur] = self._clone(p, c, q)
                        last = cur
                else:
                    last = self._clone(last, c, q)
            if lows[last] is None:
                lows[last], highs[last] = low, high
            else:
                if low < lows[last]:
                    lows[last] = low
                if high > highs[last]:
                    highs[last] = high

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.len
        clone = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.low.append(None)
        self.high.append(None)
        while p != -1 and nxt[p].get(c) == q:
            nxt[p][c] = clone
            p = link[p]
        link[q] = clone
        return clone

    def settle(self) -> SuffixAutomaton:
        """Hand the owners of every state on to the states of its suffixes."""
        link, low, high = self.link, self.low, self.high
        for v in sorted(range(1, len(link)), key=self.len.__getitem__, reverse=True):
            p = link[v]
            if p > 0:
                if low[p] is None:
                    low[p], high[p] = low[v], high[v]
                else:
                    if low[v] < low[p]:
                        low[p] = low[v]
                    if high[v] > high[p]:
                        high[p] = high[v]
        return self

    def shared(self, symbols: Sequence, places: Sequence[int], least: int) -> list[tuple[int, int]]:
        """Maximal runs [a, b) of starts of windows of ``least`` units that have two or more owners in this automaton.

        Symbol i spans the units from ``places[i]`` to ``places[i + 1]``.
        """
        nxt, link, length, low, high = self.next, self.link, self.len, self.low, self.high
        v = n = 0
        runs: list[list[int]] = []
        for i, c in enumerate(symbols):
            w = nxt[v].get(c)
            while w is None or low[w] == high[w]:
                if v == 0:
                    w = None
                    break
                v = link[v]
                n = length[v]
                w = nxt[v].get(c)
            if w is None:
                n = 0
                continue
            v = w
            n += 1
            a, b = places[i + 1 - n], places[i + 1] - least + 1
            if b > a:
                if runs and runs[-1][1] >= a:
                    runs[-1][1] = b
                else:
                    runs.append([a, b])
        return [tuple(r) for r in runs]
