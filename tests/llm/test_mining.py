"""Hard negatives against a plain search; the curve and the zone maps by themselves."""

import random

import numpy as np

from cyclelens.llm import mining


def expected(rows, anchors):
    out = []
    dot = lambda a, b: sum(x * y for x, y in zip(a, b))
    for a, la, va in rows:
        if a not in anchors:
            continue
        scored = sorted(((dot(va, v), i, lab) for i, lab, v in rows if i != a), key=lambda r: (-r[0], r[1]))
        for ps, p, _ in [s for s in scored if s[2] == la][:5]:
            fits = [s for s in scored if s[2] != la and 80 * ps <= 100 * s[0] <= 100 * ps][:5]
            out += [(a, p, k + 1, n, ps, ns) for k, (ns, n, _) in enumerate(fits)]
    return sorted(out)


def got(spark, rows, anchors, **more):
    df = spark.createDataFrame(rows, "vec_id long, label long, v array<long>")
    picked = df.where(df.vec_id.isin(list(anchors) or [-1]))
    return sorted(tuple(r) for r in mining.hard_negatives(df, picked, **more).collect())


def test_equals_a_plain_search(spark):
    rng = random.Random(1)
    rows = [(i, rng.randrange(4), [rng.randint(-60, 200) for _ in range(5)]) for i in range(900)]
    rows += [(1000 + i, i % 3, [90, 10, -20, 50, 60]) for i in range(300)]  # a third of all rows are one vector: ties by id
    anchors = {r[0] for r in rows if r[0] % 40 == 0}
    assert got(spark, rows, anchors, block=32) == expected(rows, anchors)


def test_negative_scores_short_vectors_and_lone_labels(spark):
    rows = [(1, 1, [-5, 3]), (2, 1, [5, -3]), (3, 2, [4]), (4, 3, []), (5, 2, [4, 0, 9]), (6, 1, [-6, 3]), (7, 2, [-6, 1]), (8, 4, [0, 0])]
    full = [(i, lab, [*v, 0, 0, 0][:3]) for i, lab, v in rows]
    assert got(spark, rows, {1, 2, 3, 4, 7, 8}) == expected(full, {1, 2, 3, 4, 7, 8})


def test_empty(spark):
    assert got(spark, [], set()) == [] and got(spark, [(1, 1, [3])], {1}) == []


def test_flawed_rows_take_no_part(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [0.5], 1, "x"), (1, [0.5], 1, "x"), (1, [0.25], 2, "x"), (2, None, 1, "x"), (3, [nan], 1, "x"), (4, [inf], 1, "x"), (5, [None], 1, "x"), (6, [1.0], None, "x"), (None, [1.0], 1, "x"), (7, [-0.001, 2.0], 1, "x")]
    df = spark.createDataFrame(rows, "vec_id long, e array<double>, l int, page string")
    out = sorted(tuple(r) for r in mining.labelled_integers(df, "vec_id", "e", "l").collect())
    assert out == [(1, 2, [64]), (7, 1, [-1, 512])]


def test_neighbours_on_the_curve_are_neighbours():
    for dims, bits in ((2, 3), (3, 2), (2, 1)):
        side = 1 << bits
        cells = np.array(np.meshgrid(*[np.arange(side)] * dims)).reshape(dims, -1).T
        places = mining.hilbert(cells, bits)
        assert len(set(places)) == len(cells)
        walk = cells[sorted(range(len(cells)), key=lambda i: places[i])]
        assert (np.abs(np.diff(walk, axis=0)).sum(axis=1) == 1).all()


def test_zone_maps_spare_blocks():
    """Of blocks that lie far apart, an anchor's window reads those alone that its bounds allow."""
    vectors = np.concatenate([np.full((8, 2), 10 * b) for b in range(1, 9)])
    lows = highs = np.array([[10 * b] * 2 for b in range(1, 9)])
    flat = np.ones(8, np.int64)
    page = mining.Page(np.arange(64), np.ones(64, np.int64), 2, vectors, lows, highs, flat, flat, 8)
    anchors = {"ids": [99], "labels": [2], "data": [1, 1], "windows": [[{"window": 1, "low": 100, "high": 120, "floor": mining.LOWEST}]]}
    found, scored = mining.scan(page, anchors, False, 5)
    assert scored == 2 and [(f["vec_id"], f["score"]) for f in found] == [(40 + i, 120) for i in range(5)]
    anchors["windows"][0][0]["floor"] = 110
    assert mining.scan(page, anchors, False, 5)[1] == 1
    assert mining.scan(page, anchors, True, 5) == ([], 0)
