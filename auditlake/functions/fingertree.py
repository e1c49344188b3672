"""A finger B-tree of partial aggregates, keyed by event time.

Leaves hold sorted times with one partial aggregate each; inner nodes hold the sum of their subtree. Two fingers point at
the outermost leaves: an event in order is added at the right finger without a search, a late one climbs from there only
as far as its time requires and then descends, and the aggregates of the leaf's ancestors are updated on the way up, so a
late insert costs the logarithm of the open times. ``evict`` cuts whole subtrees off the left edge and repairs only the
nodes along the cut.

Plain Python without Spark, so that executors load it in a moment and tests can drive it alone.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

MIN, MAX = 8, 32


class Node:
    __slots__ = ("keys", "kids", "parent", "agg")

    def __init__(self, keys: list, kids: list, leaf: bool) -> None:
        self.keys = keys  # of a leaf its times; of an inner node the least time of each child
        self.kids = kids  # of a leaf the partials [count, total]; of an inner node its children
        self.parent: Node | None = None
        self.agg = [0, 0]
        if not leaf:
            for k in kids:
                k.parent = self
        for k in kids:
            a = k if leaf else k.agg
            self.agg[0] += a[0]
            self.agg[1] += a[1]


class FingerTree:
    """Counts and totals by time. ``floor`` is the cut-off: times below it are refused."""

    def __init__(self) -> None:
        self.root = self.left = self.right = Node([], [], True)
        self.height = 0
        self.floor: int | None = None

    def __len__(self) -> int:
        return self.root.agg[0]

    def insert(self, time: int, count: int, total: int) -> bool:
        """Add a partial at ``time``; false if it lies below the cut-off."""
        if self.floor is not None and time < self.floor:
            return False
        node, up = self.right, 0
        while node.parent is not None and time < node.keys[0]:  # climb from the finger
            node, up = node.parent, up + 1
        while up:
            node, up = node.kids[max(0, bisect_right(node.keys, time) - 1)], up - 1
        i = bisect_left(node.keys, time)
        if i < len(node.keys) and node.keys[i] == time:
            node.kids[i][0] += count
            node.kids[i][1] += total
        else:
            node.keys.insert(i, time)
            node.kids.insert(i, [count, total])
        up_to = node
        while up_to is not None:
            up_to.agg[0] += count
            up_to.agg[1] += total
            if up_to.parent is not None and time < up_to.parent.keys[0]:
                up_to.parent.keys[0] = time
            up_to = up_to.parent
        if len(node.keys) > MAX:
            self._split(node, True)
        return True

    def _split(self, node: Node, leaf: bool) -> None:
        while len(node.keys) > MAX:
            half = len(node.keys) // 2
            other = Node(node.keys[half:], node.kids[half:], leaf)
            del node.keys[half:], node.kids[half:]
            node.agg = [node.agg[0] - other.agg[0], node.agg[1] - other.agg[1]]
            if leaf and node is self.right:
                self.right = other
            if node.parent is None:
                self.root = Node([node.keys[0], other.keys[0]], [node, other], False)
                self.height += 1
                return
            up = node.parent
            at = up.kids.index(node) + 1
            up.keys.insert(at, other.keys[0])
            up.kids.insert(at, other)
            other.parent = up
            node, leaf = up, False

    def total(self, low: int, high: int) -> tuple[int, int]:
        """Count and total of the times in [low, high)."""
        out = [0, 0]
        self._sum(self.root, self.height, low, high, out)
        return out[0], out[1]

    def _sum(self, node: Node, height: int, low: int | None, high: int | None, out: list) -> None:
        """None as a bound: the whole side is known to lie inside."""
        if low is None and high is None:
            out[0] += node.agg[0]
            out[1] += node.agg[1]
        elif height == 0:
            i = 0 if low is None else bisect_left(node.keys, low)
            j = len(node.keys) if high is None else bisect_left(node.keys, high)
            for count, total in node.kids[i:j]:
                out[0] += count
                out[1] += total
        else:
            i = 0 if low is None else max(0, bisect_right(node.keys, low) - 1)
            j = len(node.keys) if high is None else bisect_left(node.keys, high)
            for k in range(i, j):
                self._sum(node.kids[k], height - 1, low if k == i else None, high if k == j - 1 else None, out)

    def evict(self, floor: int) -> int:
        """Drop all times below ``floor`` and refuse them from now on; the number of rows dropped."""
        if self.floor is not None and floor <= self.floor:
            return 0
        self.floor = floor
        before = self.root.agg[0]
        if not self.root.keys or self.root.keys[0] >= floor:
            return 0
        path, node, height = [], self.root, self.height
        while height:
            cut = max(0, bisect_right(node.keys, floor) - 1)
            del node.keys[:cut], node.kids[:cut]  # whole subtrees
            path.append(node)
            node, height = node.kids[0], height - 1
        cut = bisect_left(node.keys, floor)
        del node.keys[:cut], node.kids[:cut]
        node.agg = [sum(x[0] for x in node.kids), sum(x[1] for x in node.kids)]
        for up in reversed(path):
            self._repair(up)
        if not self.root.keys:
            self.root, self.height = Node([], [], True), 0
        while self.height and len(self.root.kids) == 1:
            self.root, self.height = self.root.kids[0], self.height - 1
            self.root.parent = None
        node = self.root
        for _ in range(self.height):
            node = node.kids[0]
        self.left = node
        node = self.root
        for _ in range(self.height):
            node = node.kids[-1]
        self.right = node
        return before - self.root.agg[0]

    def _repair(self, up: Node) -> None:
        """Fill up the first child from its neighbour, then renew the node's own least times and aggregate."""
        first = up.kids[0]
        if len(first.keys) < MIN and len(up.kids) > 1:
            second = up.kids[1]
            leaf = not isinstance(second.kids[0], Node)  # partials are lists
            keys, kids = first.keys + second.keys, first.kids + second.kids
            parts = [len(keys)] if len(keys) <= MAX else [len(keys) // 2, len(keys) - len(keys) // 2]
            made, at = [], 0
            for n in parts:
                made.append(Node(keys[at : at + n], kids[at : at + n], leaf))
                made[-1].parent, at = up, at + n
            up.kids[:2] = made
        if not up.kids[0].keys:
            del up.kids[0]
        up.keys = [k.keys[0] for k in up.kids]
        up.agg = [sum(k.agg[0] for k in up.kids), sum(k.agg[1] for k in up.kids)]

    def check(self) -> list[int]:
        """All times in order, after checking every aggregate, bound and size (for tests)."""

        def walk(node: Node, height: int) -> list[int]:
            assert list(node.keys) == sorted(set(node.keys)) and len(node.keys) <= MAX
            if height == 0:
                assert node.agg == [sum(x[0] for x in node.kids), sum(x[1] for x in node.kids)]
                return list(node.keys)
            out: list[int] = []
            for key, kid in zip(node.keys, node.kids, strict=True):
                assert kid.parent is node
                got = walk(kid, height - 1)
                assert got and got[0] == key
                out += got
            assert node.agg == [sum(k.agg[0] for k in node.kids), sum(k.agg[1] for k in node.kids)]
            return out

        return walk(self.root, self.height)
