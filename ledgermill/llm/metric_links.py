"""Links of a group of sets that fits one task, by pivots of the Jaccard metric.

d(x, y) = 1 - |x & y| / |x | y| is a metric. Pivots are taken farthest first; every set of the group
is compared with each of them, belongs to the region of the nearest, and is a guest in another
region when the triangle inequality leaves room for a partner there. Regions are then treated alike
until few sets are left. Only components are asked for, so a region whose sets are all connected
already is done.

Sets that lie at one distance from each other, as pages of one template do, are parted by no pivot.
Where a region keeps most of its parent's sets, they are compared by their rarest keys instead: two
sets meet at a key that both have among these, if their lengths and what is left of both behind that
key allow a link.
"""

from __future__ import annotations

import numpy as np

#: Groups up to this many sets are compared pair by pair.
FEW = 12
#: Pivots chosen in one step.
PIVOTS = 6
#: Share of its parent's sets from which a region counts as not parted.
WHOLE = 0.7
_SLACK = 1e-9


class Group:
    """Sets as rows of one key array; ``sizes`` also count the keys that no other set has."""

    def __init__(self, sizes: np.ndarray, keys: np.ndarray, bounds: np.ndarray, percent: int):
        self.sizes, self.keys, self.bounds, self.percent = sizes.astype(np.int64), keys, bounds, percent
        self.parent = list(range(len(sizes)))

    def root(self, x: int) -> int:
        while self.parent[x] != x:
            self.parent[x] = self.parent[self.parent[x]]
            x = self.parent[x]
        return x

    def join(self, x: int, y: int) -> None:
        x, y = self.root(x), self.root(y)
        if x != y:
            self.parent[max(x, y)] = min(x, y)

    def _shared(self, members: np.ndarray, pivot: int) -> np.ndarray:
        """Sizes of the intersections of the members with the pivot."""
        own = self.keys[self.bounds[pivot] : self.bounds[pivot + 1]]
        lengths = self.bounds[members + 1] - self.bounds[members]
        at = np.repeat(self.bounds[members] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        keys = self.keys[at]
        place = np.minimum(np.searchsorted(own, keys), max(len(own) - 1, 0))
        hit = np.concatenate(([0], np.cumsum(own[place] == keys))) if len(own) else np.zeros(len(keys) + 1, np.int64)
        ends = np.cumsum(lengths)
        return hit[ends] - hit[ends - lengths]

    def distances(self, members: np.ndarray, pivot: int) -> np.ndarray:
        """Distances to the pivot; members within the threshold are joined with it."""
        shared = self._shared(members, pivot)
        union = self.sizes[members] + self.sizes[pivot] - shared
        for x in members[100 * shared >= self.percent * union]:
            self.join(int(x), pivot)
        return 1 - shared / union

    def _one_component(self, members: np.ndarray) -> bool:
        first = self.root(int(members[0]))
        return all(self.root(int(x)) == first for x in members[1:])

    def link(self, home: np.ndarray, guests: np.ndarray) -> None:
        """Joins all pairs within the threshold of home with home and of home with guests."""
        reach = 1 - self.percent / 100
        todo = [(home, guests)]
        while todo:
            home, guests = todo.pop()
            members = np.concatenate((home, guests))
            if not len(home) or len(members) < 2 or self._one_component(members):
                continue
            if len(members) <= FEW:
                for i, x in enumerate(home):
                    rest = np.array([y for y in members[i + 1 :] if self.root(int(y)) != self.root(int(x))], dtype=np.int64)
                    rest = rest[100 * np.minimum(self.sizes[rest], self.sizes[x]) >= self.percent * np.maximum(self.sizes[rest], self.sizes[x])]
                    if len(rest):
                        self.distances(rest, int(x))
                continue
            pivots, rows = [0], [self.distances(members, int(home[0]))]
            nearest = rows[0][: len(home)].copy()
            while len(pivots) < PIVOTS and nearest.max() > reach:
                far = int(nearest.argmax())
                pivots.append(far)
                rows.append(self.distances(members, int(home[far])))
                nearest = np.minimum(nearest, rows[-1][: len(home)])
            if self._one_component(members):
                continue
            table = np.array(rows)
            region = table.argmin(axis=0)
            room = table <= table.min(axis=0) + 2 * reach + _SLACK
            is_home = np.arange(len(members)) < len(home)
            is_pivot = np.zeros(len(members), dtype=bool)
            is_pivot[pivots] = True
            parts = []
            for i in range(len(pivots)):
                own = is_home & (region == i) & ~is_pivot
                if not own.any():
                    continue
                window = (table[i] <= table[i][own].max() + reach + _SLACK) & (table[i] >= table[i][own].min() - reach - _SLACK)
                # of two regions the first compares: homes of later regions and all outer guests come as guests
                visit = room[i] & window & ~is_pivot & np.where(is_home, region > i, True)
                parts.append((members[own], members[visit]))
            if any(len(h) + len(g) > WHOLE * len(members) for h, g in parts):
                left = ~is_pivot
                self._link_by_rarest(members[left & is_home], members[left & ~is_home])
            else:
                todo += parts

    def _link_by_rarest(self, home: np.ndarray, guests: np.ndarray) -> None:
        """Joins all pairs within the threshold of home with home and of home with guests, met by their rarest keys."""
        members = np.concatenate((home, guests))
        members = members[np.argsort(self.sizes[members], kind="stable")]
        is_home = np.isin(members, home)
        sizes = self.sizes[members]
        lengths = self.bounds[members + 1] - self.bounds[members]
        owner = np.repeat(np.arange(len(members)), lengths)
        at = np.repeat(self.bounds[members] - np.concatenate(([0], np.cumsum(lengths)[:-1])), lengths) + np.arange(lengths.sum())
        _, key, counts = np.unique(self.keys[at], return_inverse=True, return_counts=True)
        order = np.lexsort((key, counts[key], owner))
        key = key[order]
        place = np.arange(len(key)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + np.repeat(sizes - lengths, lengths)
        n = sizes[owner]
        meets = (counts[key] > 1) & (place < n - (self.percent * n + 99) // 100 + 1)
        owner, key, n, place = owner[meets], key[meets], n[meets], place[meets]
        most = (100 + self.percent) * (n - place) // self.percent - n  # the longest partner that the rest allows
        order = np.lexsort((owner, key))
        owner, key, n, most = owner[order], key[order], n[order], most[order]
        # who has a partner in its region: among those short enough for it, one that allows its length
        scale = int(max(n.max(initial=0), most.max(initial=0), 0)) + 2
        reached = np.searchsorted(key * scale + n, key * scale + np.clip(most, 0, scale - 1), side="right") - 1
        best = np.maximum.accumulate(key * scale + np.maximum(most, 0)) if len(key) else key
        met = (reached >= np.searchsorted(key, key)) & (best[reached] - key * scale >= n)
        owner, key, n, most = owner[met], key[met], n[met], most[met]
        starts = np.searchsorted(key, key)
        of_owner = np.argsort(owner, kind="stable")
        bounds = np.searchsorted(owner[of_owner], np.arange(len(members) + 1))
        label = np.array([self.root(int(x)) for x in members], dtype=np.int64)
        for x in np.flatnonzero(np.diff(bounds)):
            shorter = []
            for v in of_owner[bounds[x] : bounds[x + 1]]:
                near = slice(starts[v], v)  # of its region those before it, which are no longer
                shorter.append(owner[near][(most[near] >= n[v]) & (n[near] <= most[v]) & (100 * n[near] >= self.percent * n[v])])
            found = np.unique(np.concatenate(shorter))
            found = found[(label[found] != label[x]) & (is_home[found] | is_home[x])]
            if not len(found):
                continue
            shared = self._shared(members[found], int(members[x]))
            for y in found[100 * shared >= self.percent * (sizes[found] + sizes[x] - shared)]:
                if label[y] != label[x]:
                    self.join(int(members[x]), int(members[y]))
                    label[label == label[y]] = label[x]

    def roots(self) -> np.ndarray:
        return np.array([self.root(x) for x in range(len(self.sizes))], dtype=np.int64)
