"""The nearest target by grids of several widths against plain loops."""

import math
import random

import pytest

from aforo.operators import geometry

MOST = 60.0


def expected(points, targets, most=MOST):
    def at(x, y):
        if x is None or y is None:
            return (None, None)
        d = [(math.sqrt((x - tx) * (x - tx) + (y - ty) * (y - ty)), tid) for tid, tx, ty in targets if tx is not None and ty is not None]
        best = min((c for c in d if c[0] <= most), default=(None, None))
        return (best[1], best[0])

    return {p: at(x, y) for p, x, y in points}


def got(spark, points, targets, most=MOST):
    p, t = spark.createDataFrame(points, "pid long, x double, y double"), spark.createDataFrame(targets, "tid long, tx double, ty double")
    rows = geometry.nearest(p, t, most).collect()
    assert len(rows) == len(points)
    return {r.pid: (r.tid, r.distance) for r in rows}


@pytest.fixture(scope="module")
def crowded():
    """Targets on a lattice in one corner (ties, several at a place), a knot of them in 0.001, a few far out; points in and between them and beyond reach."""
    rnd = random.Random(4)
    spots = [(rnd.randrange(80) / 2, rnd.randrange(80) / 2) for _ in range(1500)] + [(200 + rnd.random() / 1000, 200.0) for _ in range(300)]
    spots += [(rnd.uniform(0, 900), rnd.uniform(0, 900)) for _ in range(30)] + [(None, 5.0)]
    tids = rnd.sample(range(10_000), len(spots))
    places = [(rnd.randrange(100) / 2 + 0.25, rnd.randrange(100) / 2 + 0.25) for _ in range(300)] + [(rnd.uniform(150, 250), rnd.uniform(150, 250)) for _ in range(100)]
    places += [(rnd.uniform(-200, 1100), rnd.uniform(-200, 1100)) for _ in range(300)] + [(-80.0, 0.0), (7.25, 8.25), (7.25, 8.25), (None, 1.0), (1.0, None)]
    return [(i, *xy) for i, xy in enumerate(places)], [(t, *xy) for t, xy in zip(tids, spots)]


def test_nearest_among_crowds_and_gaps(spark, crowded):
    assert got(spark, *crowded) == expected(*crowded)


def test_nearest_looks_at_few_pairs(spark, crowded, monkeypatch):
    """Targets crowd in one cell of the given width: the search starts in smaller ones, and few places come to that width at all."""
    asked, inner = [], geometry._nearest_within

    def watched(spots, marks, width):
        asked.append((width, spots.count()))
        return inner(spots, marks, width)

    monkeypatch.setattr(geometry, "_nearest_within", watched)
    rnd = random.Random(5)
    targets = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(4000)]
    points = [(i, rnd.uniform(0, 60), rnd.uniform(0, 60)) for i in range(500)]
    assert got(spark, points, targets) == expected(points, targets)
    assert asked[0] == (1.875, 500) and sum(n for w, n in asked if w > 1.875) < 50


def test_no_pairs_are_sorted(spark):
    """The least pair per point is kept while pairs pass by; sorted, all pairs of a point and its surroundings go to disk."""
    p, t = spark.range(5).selectExpr("id AS pid", "id + 0.5D AS x", "1.0D AS y"), spark.range(3).selectExpr("id AS tid", "CAST(id AS double) AS tx", "2.0D AS ty")
    assert "SortAggregate" not in geometry.nearest(p, t, MOST)._jdf.queryExecution().toString()


def test_nearest_at_the_limit_and_without_targets(spark):
    points = [(1, 0.0, 0.0), (2, 59.99999999999999, 0.0), (3, 0.0, -60.0), (4, 0.0, -60.00000001)]
    assert got(spark, points, [(8, 0.0, 0.0), (9, 119.99999999999999, 0.0)]) == {1: (8, 0.0), 2: (8, 59.99999999999999), 3: (8, 60.0), 4: (None, None)}
    assert got(spark, points, []) == dict.fromkeys((1, 2, 3, 4), (None, None))
    assert got(spark, [(1, 59.99999999999999, 0.0)], [(9, 119.99999999999999, 0.0)]) == expected([(1, 59.99999999999999, 0.0)], [(9, 119.99999999999999, 0.0)])
