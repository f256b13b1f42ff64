"""Minimum-cost flow on small graphs, by successive cheapest paths."""

from __future__ import annotations

from collections import deque


class Network:
    def __init__(self, nodes: int):
        self.heads: list[list[int]] = [[] for _ in range(nodes)]
        self.to: list[int] = []
        self.room: list[int] = []
        self.cost: list[int] = []

    def arc(self, a: int, b: int, room: int, cost: int) -> int:
        """Number of the new arc; the next number is its reverse."""
        for u, v, r, c in ((a, b, room, cost), (b, a, 0, -cost)):
            self.heads[u].append(len(self.to))
            self.to.append(v)
            self.room.append(r)
            self.cost.append(c)
        return len(self.to) - 2

    def _cheapest(self, source: int, sink: int) -> list[int] | None:
        far = [None] * len(self.heads)
        by = [-1] * len(self.heads)
        far[source] = 0
        queue, queued = deque([source]), {source}
        while queue:
            u = queue.popleft()
            queued.discard(u)
            for e in self.heads[u]:
                v = self.to[e]
                if self.room[e] > 0 and (far[v] is None or far[u] + self.cost[e] < far[v]):
                    far[v], by[v] = far[u] + self.cost[e], e
                    if v not in queued:
                        queue.append(v)
                        queued.add(v)
        if far[sink] is None:
            return None
        path, v = [], sink
        while v != source:
            path.append(by[v])
            v = self.to[by[v] ^ 1]
        return path

    def run(self, source: int, sink: int) -> None:
        """Send as much as fits, as cheaply as possible."""
        while path := self._cheapest(source, sink):
            much = min(self.room[e] for e in path)
            for e in path:
                self.room[e] -= much
                self.room[e ^ 1] += much


def route(quotas: dict, sizes: dict[tuple, int], epochs: int) -> dict[tuple, int]:
    """Words to take of each pattern: ``sizes`` by pattern, a tuple of keys of ``quotas``.

    The ``e``-th reading of a pattern costs ``2 e - 1`` a word, so a cost grows
    with the square of the repetitions.  Sources linked by patterns are solved
    together, others apart.
    """
    parent = {s: s for s in quotas}

    def root(s):
        while parent[s] != s:
            parent[s] = parent[parent[s]]
            s = parent[s]
        return s

    for pattern in sizes:
        for s in pattern[1:]:
            parent[root(s)] = root(pattern[0])
    groups: dict = {}
    for s in quotas:
        groups.setdefault(root(s), ([], []))[0].append(s)
    for pattern in sizes:
        if pattern:
            groups[root(pattern[0])][1].append(pattern)
    taken = {pattern: 0 for pattern in sizes}
    for sources, patterns in groups.values():
        net = Network(2 + len(sources) + len(patterns))
        place = {s: 2 + i for i, s in enumerate(sources)}
        for s in sources:
            net.arc(0, place[s], quotas[s], 0)
        out = []
        for i, pattern in enumerate(patterns, 2 + len(sources)):
            for s in pattern:
                net.arc(place[s], i, quotas[s], 0)
            out += [(pattern, net.arc(i, 1, sizes[pattern], 2 * e - 1)) for e in range(1, epochs + 1)]
        net.run(0, 1)
        for pattern, arc in out:
            taken[pattern] += net.room[arc ^ 1]
    return taken
