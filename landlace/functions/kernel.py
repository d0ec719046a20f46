"""Polygon geometry in numpy: measures, overlap, distance, validity, and overlay by slabs.

A polygon is a list of rings, each an (n, 2) array without a repeated last point; ring 0 is the shell, the others holes. A region
is a list of polygons. Coordinates are taken to a local origin first, as metric ones run to millions.
"""

from __future__ import annotations

import numpy as np

Ring = np.ndarray


def ring(points) -> Ring:
    """As an array, without the repeated last point."""
    r = np.asarray(points, float).reshape(-1, 2)
    return r[:-1] if len(r) > 1 and (r[0] == r[-1]).all() else r


def signed(r: Ring) -> float:
    """Area, positive if the ring runs against the clock."""
    if len(r) < 3:
        return 0.0
    p = r - r[0]
    q = np.roll(p, -1, 0)
    return float((p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]).sum() / 2)


def area(poly: list[Ring]) -> float:
    return abs(signed(poly[0])) - sum(abs(signed(h)) for h in poly[1:]) if poly else 0.0


def perimeter(poly: list[Ring]) -> float:
    return float(sum(np.hypot(*(np.roll(r, -1, 0) - r).T).sum() for r in poly))


def centroid(poly: list[Ring]) -> tuple[float, float]:
    origin, total, cx, cy = poly[0][0], 0.0, 0.0, 0.0
    for i, r in enumerate(poly):
        p = r - origin
        q = np.roll(p, -1, 0)
        c = p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]
        s = (1 if c.sum() >= 0 else -1) * (1 if i == 0 else -1)
        total += s * c.sum() / 2
        cx += s * ((p[:, 0] + q[:, 0]) * c).sum() / 6
        cy += s * ((p[:, 1] + q[:, 1]) * c).sum() / 6
    if abs(total) < 1e-12:
        return tuple(poly[0].mean(0))
    return float(origin[0] + cx / total), float(origin[1] + cy / total)


def compactness(poly: list[Ring]) -> float:
    p = perimeter(poly)
    return 4 * np.pi * area(poly) / p**2 if p > 0 else 0.0


def inside(x: float, y: float, poly: list[Ring]) -> bool:
    """Whether a point lies in the polygon, by the even-odd rule."""
    hits = 0
    for r in poly:
        a, b = r, np.roll(r, -1, 0)
        cross = (a[:, 1] > y) != (b[:, 1] > y)
        if cross.any():
            a, b = a[cross], b[cross]
            hits += int((x < a[:, 0] + (y - a[:, 1]) / (b[:, 1] - a[:, 1]) * (b[:, 0] - a[:, 0])).sum())
    return hits % 2 == 1


def clipped_areas(tri: np.ndarray, other: np.ndarray, step: int = 1 << 15) -> np.ndarray:
    """Areas that pairs of counter-clockwise triangles (n, 3, 2) share: all of one side are cut by each side of the others at once.

    A cut gives two places for each corner (the corner itself if it stays, and where its side crosses the line); a place without
    a point takes the last point before it, which adds nothing to the area.
    """
    out = np.zeros(len(tri))
    for first in range(0, len(tri), step):
        p, own = tri[first : first + step], other[first : first + step]
        some = np.ones(len(p), bool)
        for k in range(3):
            a, d = own[:, None, k], own[:, None, (k + 1) % 3] - own[:, None, k]
            s = d[..., 0] * (p[..., 1] - a[..., 1]) - d[..., 1] * (p[..., 0] - a[..., 0])
            q, t = np.roll(p, -1, 1), np.roll(s, -1, 1)
            cross = s * t < 0
            f = np.where(cross, s / np.where(cross, s - t, 1.0), 0.0)
            points = np.stack([p, p + f[..., None] * (q - p)], 2).reshape(len(p), -1, 2)
            there = np.stack([s >= 0, cross], 2).reshape(len(p), -1)
            some &= there.any(1)
            at = np.maximum.accumulate(np.where(there, np.arange(there.shape[1]), -1), 1)
            at = np.where(at < 0, at[:, -1:], at)  # before the first point: the last one
            p = np.take_along_axis(points, np.maximum(at, 0)[..., None], 1)
        p = p - p[:, :1]
        q = np.roll(p, -1, 1)
        out[first : first + step] = np.where(some, np.abs((p[..., 0] * q[..., 1] - q[..., 0] * p[..., 1]).sum(1)) / 2, 0.0)
    return out


class Polygons:
    """Many polygons as flat arrays, for measures of all of them at once: corners one after the other, ring by ring."""

    def __init__(self, points: np.ndarray, ring_sizes: np.ndarray, rings_of: np.ndarray):
        """points: (m, 2) of all rings; ring_sizes: corners of each ring; rings_of: rings of each polygon, one at least. Repeated last points go."""
        last = np.cumsum(ring_sizes) - 1
        closed = (ring_sizes > 1) & (points[last] == points[last - np.maximum(ring_sizes - 1, 0)]).all(1)
        keep = np.ones(len(points), bool)
        keep[last[closed]] = False
        size = ring_sizes - closed
        if len(size) and (size.min() < 1 or rings_of.min() < 1):
            raise ValueError("a polygon or a ring without corners")
        self.points, self.start = points[keep], np.cumsum(size) - size
        self.ring = np.repeat(np.arange(len(size)), size)
        ends = self.start + size - 1
        after = np.arange(1, len(self.points) + 1)
        after[ends] = self.start
        self.after = self.points[after]
        self.owner = np.repeat(np.arange(len(rings_of)), rings_of)
        self.shells = np.cumsum(rings_of) - rings_of
        self.hole = np.ones(len(size), bool)
        self.hole[self.shells] = False
        self.first = self.start[self.shells]
        self.sizes = np.bincount(self.owner, size, len(rings_of)).astype(int)
        pick = lambda f: f.reduceat(self.points, self.start)[self.shells] if len(size) else np.zeros((0, 2))
        self.low, self.high = pick(np.minimum), pick(np.maximum)
        self._fans = None

    @classmethod
    def of(cls, polygons: list[list[Ring]]) -> Polygons:
        rings = [r for p in polygons for r in p]
        return cls(np.concatenate(rings) if rings else np.zeros((0, 2)), np.array([len(r) for r in rings], int), np.array([len(p) for p in polygons], int))

    def __len__(self) -> int:
        return len(self.shells)

    def polygon(self, k: int) -> list[Ring]:
        """One of them as a list of rings."""
        ends = np.append(self.start, len(self.points))
        return [self.points[ends[r] : ends[r + 1]] for r in range(self.shells[k], self.shells[k] + np.count_nonzero(self.owner == k))]

    def _turns(self, origin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, q = self.points - origin, self.after - origin
        return p, q, p[:, 0] * q[:, 1] - q[:, 0] * p[:, 1]

    def areas(self) -> np.ndarray:
        own = np.abs(np.bincount(self.ring, self._turns(self.points[self.start][self.ring])[2], len(self.start))) / 2
        return np.bincount(self.owner, np.where(self.hole, -own, own), len(self))

    def centroids(self) -> np.ndarray:
        """(n, 2); of a polygon without area the mean of its shell's corners."""
        origin = self.points[self.first]
        p, q, c = self._turns(origin[self.owner][self.ring])
        ring = lambda v: np.bincount(self.ring, v, len(self.start))
        sign = np.where(ring(c) >= 0, 1.0, -1.0) * np.where(self.hole, -1.0, 1.0)
        whole = lambda v: np.bincount(self.owner, sign * ring(v), len(self))
        total = whole(c) / 2
        flat = np.abs(total) < 1e-12
        mean = np.stack([ring(self.points[:, k]) / ring(np.ones(len(self.points))) for k in (0, 1)], 1)[self.shells]
        middle = np.stack([whole((p[:, k] + q[:, k]) * c) / 6 / np.where(flat, 1.0, total) for k in (0, 1)], 1)
        return np.where(flat[:, None], mean, origin + middle)

    def fans(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Signs and counter-clockwise triangles (t, 3, 2) that add up to each polygon, the first of each polygon's, and how many it has."""
        if self._fans is None:
            k = np.arange(len(self.points)) - self.start[self.ring]
            size = np.bincount(self.ring, minlength=len(self.start))
            mid = np.nonzero((k > 0) & (k < size[self.ring] - 1))[0]
            ring = self.ring[mid]
            t = np.stack([self.points[self.start[ring]], self.points[mid], self.after[mid]], 1)
            s = (t[:, 1, 0] - t[:, 0, 0]) * (t[:, 2, 1] - t[:, 0, 1]) - (t[:, 2, 0] - t[:, 0, 0]) * (t[:, 1, 1] - t[:, 0, 1])
            way = np.where(np.bincount(ring, s, len(self.start)) >= 0, 1.0, -1.0) * np.where(self.hole, -1.0, 1.0)
            t = np.where((s < 0)[:, None, None], t[:, ::-1], t)
            own = s != 0
            count = np.bincount(self.owner[ring[own]], minlength=len(self))
            self._fans = (way[ring] * np.sign(s))[own], t[own], np.cumsum(count) - count, count
        return self._fans


def _runs(count: np.ndarray, most: int) -> list[slice]:
    """Stretches of items whose counts add up to about `most`, one item at least."""
    edges = np.nonzero(np.diff(np.cumsum(count) // most))[0] + 1
    return [slice(x, y) for x, y in zip([0, *edges], [*edges, len(count)], strict=True) if y > x]


def shared_pairs(p: Polygons, i: np.ndarray, q: Polygons, j: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Areas of the intersections of pairs (p[i], q[j]) of simple polygons, with or without holes: signed triangles against signed triangles."""
    out = np.zeros(len(i))
    low = np.maximum(p.low[i], q.low[j])
    live = np.nonzero((low < np.minimum(p.high[i], q.high[j])).all(1))[0]
    if not len(live):
        return out
    (s, a, a0, an), (t, b, b0, bn) = p.fans(), q.fans()
    (al, ah), (bl, bh) = (a.min(1), a.max(1)), (b.min(1), b.max(1))
    every = an[i[live]] * bn[j[live]]
    for run in _runs(every, most):
        own, count = live[run], every[run]
        pair = np.repeat(np.arange(len(own)), count)
        nth, width = np.arange(len(pair)) - (np.cumsum(count) - count)[pair], bn[j[own]][pair]
        u, v = a0[i[own]][pair] + nth // np.maximum(width, 1), b0[j[own]][pair] + nth % np.maximum(width, 1)
        near = ((al[u] < bh[v]) & (bl[v] < ah[u])).all(1)
        pair, u, v = pair[near], u[near], v[near]
        origin = low[own][pair][:, None]
        areas = s[u] * t[v] * clipped_areas(a[u] - origin, b[v] - origin)
        out[own] = np.maximum(0.0, np.bincount(pair, areas, len(own)))
    return out


def shared_many(pairs: list[tuple[list[Ring], list[Ring]]]) -> np.ndarray:
    """As shared_pairs, of polygons as lists of rings."""
    n = np.arange(len(pairs))
    return shared_pairs(Polygons.of([p for p, _ in pairs]), n, Polygons.of([q for _, q in pairs]), n)


def shared(p: list[Ring], q: list[Ring]) -> float:
    """Area of the intersection of two simple polygons."""
    return float(shared_many([(p, q)])[0])


def _to_segments(points: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distance of each point to the nearest of the segments a-b."""
    d = b - a
    n = np.maximum((d * d).sum(1), 1e-300)
    t = np.clip(((points[:, None, :] - a) * d).sum(2) / n, 0, 1)
    return np.hypot(*np.moveaxis(points[:, None, :] - (a + t[..., None] * d), 2, 0)).min(1)


def _sides(poly: list[Ring]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate(poly), np.concatenate([np.roll(r, -1, 0) for r in poly])


def _cross(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether segments a-b (rows) and c-d (columns) cross properly."""
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    a, b, c, d = a[:, None], b[:, None], c[None], d[None]
    return (turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)


def apart(p: list[Ring], q: list[Ring]) -> tuple[float, float]:
    """(distance, Hausdorff distance): 0 where the polygons meet, else the least distance of their outlines; and the largest distance of a
    corner of either to the other's outline. Polygons whose envelopes are apart can't meet, so only others are tested for that."""
    (a, b), (c, d) = _sides(p), _sides(q)
    there, back = _to_segments(a, c, d), _to_segments(c, a, b)
    far = float(max(there.max(), back.max()))
    if (np.maximum(a.min(0), c.min(0)) > np.minimum(a.max(0), c.max(0))).any():
        return float(min(there.min(), back.min())), far
    if _cross(a, b, c, d).any() or inside(*p[0][0], q) or inside(*q[0][0], p):
        return 0.0, far
    return float(min(there.min(), back.min())), far


def _reach(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Square of the distance of each point (k, n, 2) to the nearest of the segments a-b (k, m, 2) of its row."""
    d = b - a
    n = np.maximum((d * d).sum(2), 1e-300)[:, None]
    ax, ay, dx, dy = a[:, None, :, 0], a[:, None, :, 1], d[:, None, :, 0], d[:, None, :, 1]
    x, y = x[:, :, None, 0], x[:, :, None, 1]
    t = np.clip(((x - ax) * dx + (y - ay) * dy) / n, 0, 1)
    u, v = x - (ax + t * dx), y - (ay + t * dy)
    return (u * u + v * v).min(2)


def _within(x: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Whether the point (k, 2) lies in the polygon of the sides a-b (k, m, 2) of its row, by the even-odd rule."""
    px, py = x[:, :1], x[:, 1:]
    cross = (a[..., 1] > py) != (b[..., 1] > py)
    at = a[..., 0] + (py - a[..., 1]) / np.where(cross, b[..., 1] - a[..., 1], 1.0) * (b[..., 0] - a[..., 0])
    return (cross & (px < at)).sum(1) % 2 == 1


def _cross_rows(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether any of the segments a-b (k, n, 2) properly crosses one of c-d (k, m, 2) of its row."""
    turn = lambda p, q, r: (q[..., 0] - p[..., 0]) * (r[..., 1] - p[..., 1]) - (q[..., 1] - p[..., 1]) * (r[..., 0] - p[..., 0])
    a, b, c, d = a[:, :, None], b[:, :, None], c[:, None], d[:, None]
    return ((turn(a, b, c) * turn(a, b, d) < 0) & (turn(c, d, a) * turn(c, d, b) < 0)).any((1, 2))


def apart_pairs(p: Polygons, i: np.ndarray, q: Polygons, j: np.ndarray, most: int = 1 << 17) -> tuple[np.ndarray, np.ndarray]:
    """As apart, for pairs (p[i], q[j]): those with as many corners on either side are rows of one array."""
    near, far = np.zeros(len(i)), np.zeros(len(i))
    n, m = p.sizes[i], q.sizes[j]
    for x, y in np.unique(np.stack([n, m], 1), axis=0) if len(i) else ():
        same = np.nonzero((n == x) & (m == y))[0]
        step = max(1, most // (int(x) * int(y)))
        for own in (same[k : k + step] for k in range(0, len(same), step)):
            at, bt = p.first[i[own]][:, None] + np.arange(x), q.first[j[own]][:, None] + np.arange(y)
            a, b, c, d = p.points[at], p.after[at], q.points[bt], q.after[bt]
            there, back = _reach(a, c, d), _reach(c, a, b)
            far[own] = np.sqrt(np.maximum(there.max(1), back.max(1)))
            gap = np.sqrt(np.minimum(there.min(1), back.min(1)))
            k = np.nonzero((np.maximum(a.min(1), c.min(1)) <= np.minimum(a.max(1), c.max(1))).all(1) & (gap > 0))[0]
            if len(k):
                a, b, c, d = a[k], b[k], c[k], d[k]
                gap[k[_cross_rows(a, b, c, d) | _within(a[:, 0], c, d) | _within(c[:, 0], a, b)]] = 0.0
            near[own] = gap
    return near, far


def covered_areas(p: Polygons, q: Polygons, of: np.ndarray, most: int = 64) -> np.ndarray:
    """Area of each p that the union of its covers takes: q[k] covers p[of[k]], of in ascending order.

    Covers within another one go. Where the rest don't overlap one another, what they share with p adds up; the others (and those with more than
    `most` covers) are cut away one by one, so what overlaps counts once.
    """
    takes = shared_pairs(p, of, q, np.arange(len(of)))
    live = np.nonzero(takes > 1e-9)[0]
    size = np.bincount(of[live], minlength=len(p))
    start = np.cumsum(size) - size
    cut = size > most
    n = np.where(cut, 0, size)[of[live]]
    kept = np.ones(len(q), bool)
    areas = q.areas()
    pairs = []
    for run in _runs(n, 1 << 20):
        first = np.repeat(np.arange(run.start, run.stop), n[run])
        second = start[of[live[first]]] + np.arange(len(first)) - np.repeat(np.cumsum(n[run]) - n[run], n[run])
        u, v = live[first[first < second]], live[second[first < second]]
        met = (np.maximum(q.low[u], q.low[v]) < np.minimum(q.high[u], q.high[v])).all(1)
        u, v = u[met], v[met]
        both = shared_pairs(q, u, q, v)
        small, big = np.where(areas[u] > areas[v], v, u), np.where(areas[u] > areas[v], u, v)
        within = both >= areas[small] - 1e-9
        kept[small[within]] = False
        pairs.append((u[~within & (both > 1e-9)], v[~within & (both > 1e-9)]))
    for u, v in pairs:
        cut[of[u[kept[u] & kept[v]]]] = True
    out = np.bincount(of[live], np.where(kept[live], takes[live], 0.0), len(p))
    for k in np.nonzero(cut)[0]:
        whole = p.polygon(k)
        left = [whole]
        for c in live[start[k] : start[k] + size[k]]:
            cover = q.polygon(c)
            left = [piece for r in left for piece in (difference(r, cover) if shared(r, cover) > 1e-9 else [r])]
        out[k] = area(whole) - total(left)
    return out


def distance(p: list[Ring], q: list[Ring]) -> float:
    return apart(p, q)[0]


def hausdorff(p: list[Ring], q: list[Ring]) -> float:
    return apart(p, q)[1]


def valid(poly: list[Ring]) -> bool:
    """No ring with fewer than three corners or no area, and no sides that cross."""
    if not poly or any(len(r) < 3 or abs(signed(r)) < 1e-12 for r in poly):
        return False
    a, b = _sides(poly)
    return not _cross(a, b, a, b).any()


# --- overlay ---------------------------------------------------------------------------------------------------------


def overlay(p: list[Ring], q: list[Ring], keep) -> list[list[Ring]]:
    """The region where keep(in p, in q) holds, as polygons without holes or overlaps.

    The plane is cut into slabs at every corner and crossing. Within a slab no two sides cross, so the sides stand in a fixed order
    and membership changes only at them; each stretch to keep is a trapezoid. Trapezoids that meet side to side in
    neighbouring slabs are joined into chains.
    """
    origin = np.concatenate([*p, *q]).min(0)
    segs = []
    for which, poly in ((0, p), (1, q)):
        for r in poly:
            a, b = r - origin, np.roll(r, -1, 0) - origin
            segs += [(which, *u, *v) if u[0] < v[0] else (which, *v, *u) for u, v in zip(a, b, strict=True) if u[0] != v[0]]
    if not segs:
        return []
    s = np.array(segs, float)
    a, b = s[:, 1:3], s[:, 3:5]
    xs = [*a[:, 0], *b[:, 0]]
    for i, j in zip(*np.nonzero(np.triu(_cross(a, b, a, b))), strict=True):
        d1, d2, w = b[i] - a[i], b[j] - a[j], a[j] - a[i]
        xs.append(a[i, 0] + d1[0] * (w[0] * d2[1] - w[1] * d2[0]) / (d1[0] * d2[1] - d1[1] * d2[0]))
    xs = np.unique(np.round(xs, 9))
    open_: list[tuple[list, list]] = []  # lower and upper chains that end at the current x
    done: list[tuple[list, list]] = []
    for x1, x2 in zip(xs[:-1], xs[1:], strict=True):
        if x2 - x1 < 1e-9:
            continue
        mid = (x1 + x2) / 2
        live = s[(a[:, 0] <= mid) & (b[:, 0] > mid)]
        at = lambda x, t=live: t[:, 2] + (x - t[:, 1]) / (t[:, 3] - t[:, 1]) * (t[:, 4] - t[:, 2])
        order = np.argsort(at(mid), kind="stable")
        y1, y2, which = at(x1)[order], at(x2)[order], live[order, 0]
        inside_, stretches, begun = [False, False], [], None
        for k, w in enumerate(which):
            inside_[int(w)] ^= True
            now = keep(*inside_)
            if now and begun is None:
                begun = k
            elif not now and begun is not None:
                stretches.append((y1[begun], y2[begun], y1[k], y2[k]))
                begun = None
        new = []
        for l1, l2, u1, u2 in stretches:
            if max(u1 - l1, u2 - l2) < 1e-9:
                continue
            k = next((k for k, (lo, up) in enumerate(open_) if abs(lo[-1][0] - x1) < 1e-9 and abs(lo[-1][1] - l1) < 1e-6 and abs(up[-1][1] - u1) < 1e-6), None)
            lo, up = open_.pop(k) if k is not None else ([(x1, l1)], [(x1, u1)])
            lo.append((x2, l2)), up.append((x2, u2))
            new.append((lo, up))
        done += open_
        open_ = new
    out = []
    for lo, up in done + open_:
        chain = lo + up[::-1]
        points = [pt for pt, nxt in zip(chain, chain[1:] + chain[:1], strict=True) if abs(pt[0] - nxt[0]) + abs(pt[1] - nxt[1]) > 1e-9]
        if len(points) >= 3:
            out.append([np.array(points) + origin])
    return [o for o in out if area(o) > 1e-9]


def difference(p: list[Ring], q: list[Ring]) -> list[list[Ring]]:
    return overlay(p, q, lambda a, b: a and not b)


def intersection(p: list[Ring], q: list[Ring]) -> list[list[Ring]]:
    return overlay(p, q, lambda a, b: a and b)


def union(p: list[Ring], q: list[Ring]) -> list[list[Ring]]:
    return overlay(p, q, lambda a, b: a or b)


def made_valid(poly: list[Ring]) -> list[list[Ring]]:
    """The even-odd interior as simple polygons: a bow-tie becomes two triangles."""
    far = poly[0].max(0) + 10
    return [poly] if valid(poly) else overlay(poly, [np.array([far, far + [1, 0], far + [0, 1]])], lambda a, b: a)


def total(region: list[list[Ring]]) -> float:
    return sum(map(area, region))


def representative(poly: list[Ring]) -> tuple[float, float]:
    """A point inside: the middle of the longest stretch of a line half way up."""
    ys = np.unique(np.concatenate(poly)[:, 1])
    y = (ys[len(ys) // 2 - 1] + ys[len(ys) // 2]) / 2
    a, b = _sides(poly)
    hit = (a[:, 1] > y) != (b[:, 1] > y)
    x = np.sort(a[hit, 0] + (y - a[hit, 1]) / (b[hit, 1] - a[hit, 1]) * (b[hit, 0] - a[hit, 0]))
    k = int(np.argmax(x[1::2] - x[::2]))
    return float((x[2 * k] + x[2 * k + 1]) / 2), float(y)


def hull(points: np.ndarray) -> Ring:
    """Convex hull, against the clock."""
    p = sorted(map(tuple, points))

    def half(seq):
        out: list = []
        for q in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (q[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (q[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(q)
        return out[:-1]

    return np.array(half(p) + half(p[::-1]))


def long_axis(r: Ring) -> np.ndarray:
    """Direction of the longer side of the smallest turned rectangle around a ring."""
    h = hull(r)
    best = None
    for d in np.roll(h, -1, 0) - h:
        d = d / np.hypot(*d)
        u, v = h @ d, h @ [-d[1], d[0]]
        w, t = np.ptp(u), np.ptp(v)
        if best is None or w * t < best[0] - 1e-12:
            best = (w * t, d if w >= t else np.array([-d[1], d[0]]))
    return best[1]


def halved(poly: list[Ring]) -> list[list[Ring]]:
    """The shell cut across its long axis at the centroid; each half is one ring."""
    c, d = np.array(centroid(poly)), long_axis(poly[0])
    out = []
    for side in (1, -1):
        s = side * ((poly[0] - c) @ d)
        ring_: list = []
        for k, (p, a) in enumerate(zip(poly[0], s, strict=True)):
            q, b = poly[0][(k + 1) % len(s)], s[(k + 1) % len(s)]
            if a >= 0:
                ring_.append(p)
            if a * b < 0:
                ring_.append(p + (q - p) * a / (a - b))
        if len(ring_) >= 3:
            out.append([np.array(ring_)])
    return out


def turned(poly: list[Ring], angle: float, factor: float = 1.0, shift: tuple[float, float] = (0.0, 0.0)) -> list[Ring]:
    """Turned and scaled about the centroid, then shifted."""
    c, (co, si) = np.array(centroid(poly)), (np.cos(angle), np.sin(angle))
    return [(r - c) @ (factor * np.array([[co, si], [-si, co]])) + c + np.array(shift) for r in poly]


def widened(line: np.ndarray, half: float, corners: int = 32) -> list[list[Ring]]:
    """A line grown by `half` on either side, with flat ends: a rectangle for each of its sides and a disc of `corners` corners where two meet."""
    out = []
    sides = [(p, q) for p, q in zip(line[:-1], line[1:], strict=True) if (p != q).any()]
    for p, q in sides:
        d = (q - p) / np.hypot(*(q - p)) * half
        n = np.array([-d[1], d[0]])
        out.append([np.array([p + n, p - n, q - n, q + n])])
    angle = np.arange(corners) * 2 * np.pi / corners
    out += [[q + half * np.stack([np.cos(angle), np.sin(angle)], 1)] for _, q in sides[:-1]]
    return out
