"""Exact neighbour searches on arrays: a k-d tree in numpy whose leaves are met by whole blocks of queries.

Squared distances are summed x, y, z in this order, as the column expressions do, and ties go to the
smaller id, so results are those of comparing all pairs."""

from __future__ import annotations

import numpy as np

LEAF = 128


def squared(q: np.ndarray, t: np.ndarray) -> np.ndarray:
    """(queries, targets) squared distances."""
    out = q[:, 0, None] - t[None, :, 0]
    out *= out
    for c in (1, 2):
        d = q[:, c, None] - t[None, :, c]
        d *= d
        out += d
    return out


def same(xyz: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(order by position, then id; number of the position of each row in that order)."""
    order = np.lexsort((ids, xyz[:, 2], xyz[:, 1], xyz[:, 0]))
    s = xyz[order]
    new = np.ones(len(s), bool)
    new[1:] = (s[1:] != s[:-1]).any(1)
    return order, np.cumsum(new) - 1


class Best:
    """The k best (distance, id) of each query so far, ascending; empty places hold infinity."""

    def __init__(self, n: int, k: int):
        self.k, self.dist, self.id = k, np.full((n, k), np.inf), np.full((n, k), np.iinfo(np.int64).max)

    def meet(self, at: np.ndarray, q: np.ndarray, t: np.ndarray, ids: np.ndarray, limit: float = np.inf) -> None:
        """Queries `at`, at points q, against targets t with ascending ids."""
        d = squared(q, t)
        if self.k == 1:
            j = d.argmin(1)
            near, i = d[np.arange(len(d)), j], ids[j]
            old, old_id = self.dist[at, 0], self.id[at, 0]
            won = ((near < old) | ((near == old) & (i < old_id))) & (near <= limit)
            self.dist[at[won], 0], self.id[at[won], 0] = near[won], i[won]
            return
        worst = np.minimum(self.dist[at, -1], limit)
        if d.shape[1] > self.k:
            worst = np.minimum(worst, np.partition(d, self.k - 1, axis=1)[:, self.k - 1])
        r, c = np.nonzero(d <= worst[:, None])
        if not len(r):
            return
        rows = np.unique(r)
        all_r = np.concatenate([np.repeat(rows, self.k), r])
        all_d = np.concatenate([self.dist[at[rows]].ravel(), d[r, c]])
        all_i = np.concatenate([self.id[at[rows]].ravel(), ids[c]])
        order = np.lexsort((all_i, all_d, all_r))
        all_r, all_d, all_i = all_r[order], all_d[order], all_i[order]
        place = np.arange(len(all_r)) - np.searchsorted(all_r, all_r)
        keep = place < self.k
        self.dist[at[all_r[keep]], place[keep]], self.id[at[all_r[keep]], place[keep]] = all_d[keep], all_i[keep]


class Tree:
    """Of rows at one position those with the `most` smallest ids are held: no others can be among a
    query's `most` nearest."""

    def __init__(self, xyz: np.ndarray, ids: np.ndarray, most: int | None = None):
        xyz, ids = np.asarray(xyz, float).reshape(-1, 3), np.asarray(ids, np.int64)
        if most is not None and len(ids):
            order, at = same(xyz, ids)
            first = np.searchsorted(at, np.arange(at[-1] + 1))
            order = order[np.arange(len(at)) - first[at] < most]
            xyz, ids = xyz[order], ids[order]
        #: of each node: first and last row, lower and upper corner, children (-1 for a leaf), split
        self.bounds, self.low, self.high, self.kids, self.split = [], [], [], [], []
        order = np.arange(len(ids))
        todo = [(0, len(ids), -1, 0)] if len(ids) else []
        while todo:
            a, b, parent, side = todo.pop()
            rows = xyz[order[a:b]]
            low, high = rows.min(0), rows.max(0)
            me = len(self.bounds)
            self.bounds.append((a, b)), self.low.append(low), self.high.append(high), self.kids.append([-1, -1]), self.split.append((0, 0.0))
            if parent >= 0:
                self.kids[parent][side] = me
            axis = int((high - low).argmax())
            if b - a <= LEAF or not high[axis] > low[axis]:
                order[a:b] = order[a:b][np.argsort(ids[order[a:b]], kind="stable")]
                continue
            v = rows[:, axis]
            cut = np.partition(v, len(v) // 2)[len(v) // 2]
            left = v < cut if cut > low[axis] else v <= cut
            cut = v[~left].min()
            order[a:b] = np.concatenate([order[a:b][left], order[a:b][~left]])
            mid = a + int(left.sum())
            self.split[me] = (axis, cut)
            todo += [(a, mid, me, 0), (mid, b, me, 1)]
        self.xyz, self.ids = xyz[order], ids[order]

    def gap(self, node: int, q: np.ndarray) -> np.ndarray:
        """Squared distances to a node's box; none is above that to a row in it, rounding included."""
        d = np.maximum(np.maximum(self.low[node] - q, q - self.high[node]), 0)
        d *= d
        return d[:, 0] + d[:, 1] + d[:, 2]

    def _leaves(self, q: np.ndarray):
        """(leaf, queries that fall into it)."""
        todo = [(0, np.arange(len(q)))] if self.bounds else []
        while todo:
            node, at = todo.pop()
            if not len(at):
                continue
            left, right = self.kids[node]
            if left < 0:
                yield node, at
                continue
            axis, cut = self.split[node]
            low = q[at, axis] < cut
            todo += [(left, at[low]), (right, at[~low])]

    def _meet(self, best: Best, node: int, at: np.ndarray, q: np.ndarray, limit: float) -> None:
        a, b = self.bounds[node]
        for k in range(0, len(at), 2048):
            some = at[k : k + 2048]
            best.meet(some, q[some], self.xyz[a:b], self.ids[a:b], limit)

    def knn(self, q: np.ndarray, k: int, limit: float = np.inf) -> tuple[np.ndarray, np.ndarray]:
        """(ids, squared distances), each (queries, k), nearest first, at most `limit` away (squared);
        places without a target hold an infinite distance. Queries at one position are met once."""
        q = np.asarray(q, float).reshape(-1, 3)
        order, at = same(q, np.zeros(len(q), np.int64))
        back = np.empty(len(q), np.int64)
        back[order] = at
        q = q[order][np.searchsorted(at, np.arange(at[-1] + 1))] if len(q) else q
        best, own = Best(len(q), k), np.full(len(q), -1)
        for node, some in self._leaves(q):
            own[some] = node
            self._meet(best, node, some, q, limit)
        todo = [(0, np.arange(len(q)))] if self.bounds else []
        while todo:
            node, some = todo.pop()
            some = some[self.gap(node, q[some]) <= np.minimum(best.dist[some, -1], limit)]
            left, right = self.kids[node]
            if left < 0:
                some = some[own[some] != node]
                if len(some):
                    self._meet(best, node, some, q, limit)
            elif len(some):
                todo += [(left, some), (right, some)]
        return best.id[back], best.dist[back]

    def within(self, q: np.ndarray, limit: float):
        """Blocks (queries, ids, squared distances) of all pairs at most `limit` apart (squared)."""
        todo = [(0, np.arange(len(q)))] if self.bounds else []
        while todo:
            node, some = todo.pop()
            some = some[self.gap(node, q[some]) <= limit]
            left, right = self.kids[node]
            if left >= 0:
                todo += [(left, some), (right, some)] if len(some) else []
                continue
            a, b = self.bounds[node]
            for i in range(a, b, 4096):
                for k in range(0, len(some), 256):
                    d = squared(q[some[k : k + 256]], self.xyz[i : min(i + 4096, b)])
                    r, c = np.nonzero(d <= limit)
                    if len(r):
                        yield some[k : k + 256][r], self.ids[i:b][c], d[r, c]


class Regions:
    """Space cut into about `parts` boxes that hold equal shares of a sample; the outer ones have no end."""

    def __init__(self, sample: np.ndarray, parts: int):
        self.low, self.high, self.kids, self.split, self.number = [], [], [], [], []
        todo, n = [(sample, parts, np.full(3, -np.inf), np.full(3, np.inf), -1, 0)], 0
        while todo:
            rows, want, low, high, parent, side = todo.pop()
            me = len(self.low)
            self.low.append(low), self.high.append(high), self.kids.append([-1, -1]), self.split.append((0, 0.0)), self.number.append(-1)
            if parent >= 0:
                self.kids[parent][side] = me
            spread = rows.max(0) - rows.min(0) if len(rows) else np.zeros(3)
            axis = int(spread.argmax())
            if want < 2 or not spread[axis] > 0:
                self.number[me], n = n, n + 1
                continue
            v = np.sort(rows[:, axis])
            cut = v[len(v) // 2] if v[len(v) // 2] > v[0] else v[v > v[0]][0]
            below = v[np.searchsorted(v, cut) - 1]
            middle = below + (cut - below) / 2  # between two values, so that rows of either are not at the border
            cut = middle if middle > below else cut
            self.split[me] = (axis, cut)
            left = rows[:, axis] < cut
            share = min(max(round(want * left.mean()), 1), want - 1)
            for s, part, k in ((0, rows[left], share), (1, rows[~left], want - share)):
                a, b = low.copy(), high.copy()
                (b if s == 0 else a)[axis] = cut
                todo.append((part, k, a, b, me, s))
        self.count = n

    def __len__(self) -> int:
        return self.count

    def meet(self, q: np.ndarray, limit: float | None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, region, whether the row lies in it) for each region that a row lies in or, with a limit, is
        at most that far from (squared)."""
        out, todo = [], [(0, np.arange(len(q)), np.ones(len(q), bool))]
        while todo:
            node, at, own = todo.pop()
            if not len(at):
                continue
            if self.number[node] >= 0:
                out.append((at, np.full(len(at), self.number[node]), own))
                continue
            axis, cut = self.split[node]
            low = q[at, axis] < cut
            for kid, inside in zip(self.kids[node], (low, ~low)):
                keep = own & inside
                if limit is not None:
                    d = np.maximum(np.maximum(self.low[kid] - q[at], q[at] - self.high[kid]), 0)
                    d *= d
                    keep |= d[:, 0] + d[:, 1] + d[:, 2] <= limit
                todo.append((kid, at[keep], (own & inside)[keep]))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)
        return tuple(np.concatenate(v) for v in zip(*out))


def brute(q: np.ndarray, t: np.ndarray, ids: np.ndarray, k: int, block: int = 1024, wide: int = 4096) -> tuple[np.ndarray, np.ndarray]:
    """Tree.knn() by meeting every query with every target. A product of matrices gives every distance
    up to rounding; those that could be among the best, with a margin for it, are computed exactly."""
    order = np.argsort(ids, kind="stable")
    t, ids = t[order], ids[order]
    best = Best(len(q), k)
    mid = t.mean(0) if len(t) else np.zeros(3)
    tc, qc = t - mid, q - mid
    tn, qn = (tc * tc).sum(1), (qc * qc).sum(1)
    left = np.concatenate([qc, np.ones((len(q), 1))], 1)
    right = np.concatenate([-2 * tc, tn[:, None]], 1).T.copy()
    big = float(tn.max(initial=0)) + float(qn.max(initial=0)) + float((mid * mid).sum())
    margin = 1e-13 * big if np.isfinite(big) else np.inf
    for a in range(0, len(q), block):
        at = np.arange(a, min(a + block, len(q)))
        for b in range(0, len(t), wide):
            d = left[at] @ right[:, b : b + wide]  # without the query's own square
            if b == 0:
                best.meet(at, q[at], t[:wide], ids[:wide])
                continue
            edge = best.dist[at, -1] - qn[at] + margin
            hit = np.flatnonzero((d <= edge[:, None]).ravel())
            if not len(hit):
                continue
            r, c = np.divmod(hit, d.shape[1])
            e = q[at[r]] - t[b + c]
            e *= e
            _merge(best, at[r], e[:, 0] + e[:, 1] + e[:, 2], ids[b + c])
    return best.id, best.dist


def _merge(best: Best, at: np.ndarray, dist: np.ndarray, ids: np.ndarray) -> None:
    """Candidates of queries into their best; `at` ascends."""
    rows = np.unique(at)
    r = np.concatenate([np.repeat(rows, best.k), at])
    d = np.concatenate([best.dist[rows].ravel(), dist])
    i = np.concatenate([best.id[rows].ravel(), ids])
    order = np.lexsort((i, d, r))
    r, d, i = r[order], d[order], i[order]
    place = np.arange(len(r)) - np.searchsorted(r, r)
    keep = place < best.k
    best.dist[r[keep], place[keep]], best.id[r[keep], place[keep]] = d[keep], i[keep]
