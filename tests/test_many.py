"""Measures of many polygons at once, against those of one pair after the other."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql.readwriter import DataFrameWriter

from landlace.functions import kernel
from landlace.operators import coreg, polygons


def shapes(rng, n, wide=40.0):
    """Star-shaped polygons far from the origin, some with a hole, some with their first point repeated."""
    out = []
    while len(out) < n:
        k = rng.integers(3, 9)
        angle, r = np.sort(rng.uniform(0, 2 * np.pi, k)), rng.uniform(5, 15, k)
        gap = max(*np.diff(angle), 2 * np.pi - angle[-1] + angle[0])
        if gap > 3:
            continue
        c = rng.uniform(0, wide, 2) + 5e5
        p = [c + np.stack([r * np.cos(angle), r * np.sin(angle)], 1)]
        if gap < 2.2 and rng.random() < 0.5:
            p.append(c + np.array([[0, 0], [0.5, 0], [0, 0.5]]))
        if rng.random() < 0.3:
            p[0] = np.concatenate([p[0], p[0][:1]])
        out.append(p)
    return out


@pytest.fixture(scope="module")
def pairs():
    rng = np.random.default_rng(7)
    a, b = shapes(rng, 300), shapes(rng, 300)
    clean = lambda ps: [[kernel.ring(r) for r in p] for p in ps]
    return a, b, clean(a), clean(b)


def arrow(ps):
    return pa.array([[[{"x": x, "y": y} for x, y in r.tolist()] for r in p] for p in ps], pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())]))))


def test_many_pairs_as_one_by_one(pairs):
    """polygon_features' measures, in batches, from the Arrow column (also a slice of one)."""
    a, b, p, q = pairs
    n = np.arange(len(a) - 3)
    flat_a, flat_b = polygons.flat(arrow(a)[3:]), polygons.flat(arrow(b)[3:])
    p, q = p[3:], q[3:]
    assert np.allclose(flat_a.areas(), [kernel.area(x) for x in p], atol=1e-9) and np.allclose(flat_a.centroids(), [kernel.centroid(x) for x in p], atol=1e-7, rtol=0)
    near, far = kernel.apart_pairs(flat_a, n, flat_b, n, most=500)
    want = np.array([kernel.apart(x, y) for x, y in zip(p, q, strict=True)])
    assert (want[:, 0] == 0).any() and ((near == 0) == (want[:, 0] == 0)).all()
    assert np.allclose(np.stack([near, far], 1), want, atol=1e-9)
    shared = kernel.shared_pairs(flat_a, n, flat_b, n, most=100)
    assert np.allclose(shared, [kernel.total(kernel.intersection(x, y)) for x, y in zip(p, q, strict=True)], atol=1e-5)
    assert np.allclose(flat_a.centroids()[0], kernel.Polygons.of([a[3]]).centroids()[0])


def test_no_polygons():
    none, n = polygons.flat(arrow([])), np.arange(0)
    assert len(none) == 0 and none.centroids().shape == (0, 2) and not len(none.areas())
    assert not len(kernel.shared_pairs(none, n, none, n)) and not len(kernel.apart_pairs(none, n, none, n)[0])
    some = kernel.Polygons.of([[np.array([(0.0, 0.0), (2.0, 0.0), (0.0, 2.0)])]])
    assert kernel.covered_areas(some, none, n).tolist() == [0.0]


def test_turned_squares_in_batches():
    """Squares on their corners are boxes in turned coordinates, which give what they share and how far apart they are."""
    rng = np.random.default_rng(11)
    x, y, r = rng.integers(0, 60, 200) / 2 + 1e6, rng.integers(0, 60, 200) / 2, rng.integers(5, 12, 200) / 1.0
    flat = polygons.flat(arrow([[np.array([(a - c, b), (a, b - c), (a + c, b), (a, b + c)])] for a, b, c in zip(x, y, r, strict=True)]))
    i, j = (v.ravel() for v in np.meshgrid(np.arange(200), np.arange(200)))
    low, high = np.stack([x + y - r, x - y - r], 1), np.stack([x + y + r, x - y + r], 1)
    over = np.minimum(high[i], high[j]) - np.maximum(low[i], low[j])
    assert np.allclose(kernel.shared_pairs(flat, i, flat, j, most=5000), np.maximum(over, 0).prod(1) / 2, atol=1e-8)
    assert np.allclose(kernel.apart_pairs(flat, i, flat, j)[0], np.hypot(*np.maximum(-over, 0).T) / np.sqrt(2), atol=1e-9)


def test_covers_of_many(pairs):
    """Covers apart, within one another, the same twice, overlapping, and too many for comparing each with each: as cutting away one by one."""
    a, b, p, q = pairs
    rng = np.random.default_rng(13)
    of = np.sort(rng.integers(0, 60, 200))
    lists = [[b[k] for k in np.nonzero(of == g)[0]] for g in range(60)]
    lists[1] += lists[1][:1]  # a copy
    lists[2] += [[np.array([(-1.0, -1.0), (1.0, -1.0), (0.0, 1.0)]) * s + b[0][0][0]] for s in (4.0, 2.0, 1.0)]  # one within another
    lists[3] = []
    lists[4] = lists[4] + [a[4]]  # the whole
    of = np.repeat(np.arange(60), [len(c) for c in lists])
    whole, covers = kernel.Polygons.of(a[:60]), kernel.Polygons.of([c for cs in lists for c in cs])
    want = []
    for g, cs in enumerate(lists):
        left = [p[g]]
        for c in cs:
            left = [x for r in left for x in (kernel.difference(r, [kernel.ring(v) for v in c]) if kernel.shared(r, [kernel.ring(v) for v in c]) > 1e-9 else [r])]
        want.append(kernel.area(p[g]) - kernel.total(left))
    for most in (64, 2):
        assert np.allclose(kernel.covered_areas(whole, covers, of, most), want, atol=1e-5)


def test_covers_apart_or_within_need_no_cutting(monkeypatch):
    """Those of union_cover: each cover and its lower half."""
    box = lambda x1, y1, x2, y2: [np.array([(x1, y1), (x2, y1), (x2, y2), (x1, y2)], float)]
    monkeypatch.setattr(kernel, "difference", None)
    covers = [box(x, 0, x + 4, h) for x in range(0, 60, 6) for h in (4, 2)]
    got = kernel.covered_areas(kernel.Polygons.of([box(-1, -1, 31, 3), box(100, 0, 101, 1)]), kernel.Polygons.of(covers), np.zeros(len(covers), int))
    assert got.tolist() == [5 * 12 + 3, 0]


def test_one_join_finds_mutual_neighbours(spark):
    """Both directions come from the same pairs; ties go to the smaller key on either side."""
    from landlace.operators.spatial_join import mutual_nearest

    rows = lambda ps, key: spark.createDataFrame([(k, float(x), float(y)) for k, x, y in ps], f"{key} long, x double, y double")
    a = rows([(1, 0, 0), (2, 10, 0), (3, 100, 0), (4, 104, 0), (5, 200, 0)], "a_id")
    b = rows([(7, 3, 0), (8, -3, 0), (9, 102, 0), (10, 215, 0), (11, 12, 0)], "b_id")
    found = mutual_nearest(a, "a_id", b, "b_id", 15.0)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    assert sorted((r.a_id, r.b_id, r.dist) for r in found.collect()) == [(1, 7, 3.0), (2, 11, 2.0), (3, 9, 2.0)]


@pytest.fixture(scope="module")
def offsets(spark):
    """Anchors, crowded on the left, sparse on the right, with ties; shapes among and beside them, and the median offsets by brute force."""
    rng = np.random.default_rng(17)
    ax, ay = np.concatenate([rng.integers(0, 120, 150), rng.integers(200, 900, 40)]) * 1.0, np.concatenate([rng.integers(0, 120, 150), rng.integers(0, 900, 40)]) * 1.0
    dx, dy = rng.integers(-9, 10, (2, 190)) / 4
    bx, by = np.concatenate([rng.integers(0, 900, (2, 200)) * 1.0, [[5000.0], [5000.0]]], axis=1)
    want = {}
    for i in range(len(bx)):
        d = np.sqrt((bx[i] - ax) ** 2 + (by[i] - ay) ** 2)
        near = [j for j in np.lexsort((np.arange(190), d)) if d[j] < 250][:25]
        of = near if len(near) >= 5 else range(190)
        want[i] = (len(near), float(np.median(dx[list(of)])), float(np.median(dy[list(of)])))
    found = spark.createDataFrame([(j, float(ax[j]), float(ay[j]), float(dx[j]), float(dy[j])) for j in range(190)], "a_id long, a_x double, a_y double, dx double, dy double")
    return spark.createDataFrame([(i, float(bx[i]), float(by[i])) for i in range(len(bx))], "b_id long, x double, y double"), found, want


def test_local_shift_as_by_hand(offsets):
    b, found, want = offsets
    assert {0, 25} < {n for n, *_ in want.values()} and any(0 < n < 5 for n, *_ in want.values()) and any(5 <= n < 25 for n, *_ in want.values())
    assert {r.b_id: (r.n_anchors, r.sx, r.sy) for r in coreg.local_shift(b, found).collect()} == want


def test_local_shift_writes_no_neighbours(offsets, monkeypatch):
    """What is written on the way has a row a shape or an anchor at most."""
    b, found, want = offsets
    rows, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (rows.append(self._df.count()), write(self, *a, **k))[1])
    assert coreg.local_shift(b, found).count() == len(want) and rows and max(rows) <= len(want)


def test_rounds_of_the_shift_field_start_from_tables(spark, sf, monkeypatch):
    """A round's layer is moved once and read from there: no plan moves it again beside the joins that find anchors or neighbours."""
    from landlace.plans import registry, spatial_queries  # noqa: F401

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, *a, **k: (plans.append(self._df._jdf.queryExecution().executedPlan().toString()), write(self, *a, **k))[1])
    registry.QUERIES["shift_field"](spark, sf)
    assert max(p.count("SortMergeJoin") for p in plans) <= 3
