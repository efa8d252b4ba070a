"""Areas that polygons cover, against supersampling, closed forms and the measures of rasters; components by spreading."""

import numpy as np
from pyspark.sql import functions as F

from panelspark.operators import coverage, raster

RINGS = "key long, rings array<array<struct<x: double, y: double>>>, size string, alpha string"


def ring(*points):
    return [{"x": float(x), "y": float(y)} for x, y in points]


def box(x0, y0, x1, y1):
    return ring((x0, y0), (x1, y0), (x1, y1), (x0, y1))


def star(rng, n, centre, most):
    turn = np.sort(rng.uniform(0, 2 * np.pi, n))
    far = rng.uniform(0.2, most, n)
    return ring(*zip(centre + far * np.cos(turn), centre + far * np.sin(turn), strict=True))


def winding(points, xs, ys):
    """How often the ring goes round each point, by crossings of a ray to the left."""
    total = np.zeros(xs.shape, int)
    for a, b in zip(points, points[1:] + points[:1], strict=True):
        if a["y"] == b["y"]:
            continue
        up = b["y"] > a["y"]
        low, high = sorted((a["y"], b["y"]))
        x = a["x"] + (ys - a["y"]) * (b["x"] - a["x"]) / (b["y"] - a["y"])
        total += np.where((ys >= low) & (ys < high) & (x < xs), 1 if up else -1, 0)
    return total


def test_areas_against_supersampling():
    rng = np.random.default_rng(3)
    fine = 64
    at = (np.arange(12 * fine) + 0.5) / fine
    xs, ys = np.meshgrid(at, at)
    for n in (3, 5, 9, 30):
        for most in (5.0, 9.0):  # the latter leaves the view on all sides
            points = star(rng, n, 6.0, most)
            want = np.abs(winding(points, xs, ys)).clip(0, 1).reshape(12, fine, 12, fine).mean((1, 3)) * 255
            got = coverage.alpha_of_edges(coverage.edges_of([points]), (0, 0, 12, 12), 12)
            assert np.abs(got - want).max() < 255 * 3 / fine and abs(got.sum() - want.sum()) < 0.01 * want.sum() + 20


def test_rectangles_and_holes_are_exact():
    rng = np.random.default_rng(4)
    for _ in range(50):
        x0, y0 = rng.uniform(-3, 9, 2)
        w, h = rng.uniform(0, 6, 2)
        over = lambda a, n: np.clip(np.minimum(a + n, np.arange(1, 11)) - np.maximum(a, np.arange(10)), 0, 1)
        want = np.floor(np.round(np.outer(over(y0, h), over(x0, w)), 9) * 255 + 0.5)
        for points in (box(x0, y0, x0 + w, y0 + h), box(x0, y0, x0 + w, y0 + h)[::-1]):
            assert (coverage.alpha_of_edges(coverage.edges_of([points]), (0, 0, 10, 10), 10) == want).all()
    frame = [box(1, 1, 9, 9), box(2.5, 2.5, 7.5, 7.5)[::-1]]
    got = coverage.alpha_of_edges(coverage.edges_of(frame), (0, 0, 10, 10), 10)
    assert got[1, 1] == 255 and got[5, 5] == 0 and got[2, 5] == 128 and got[0, 0] == 0
    far = coverage.alpha_of_edges(coverage.edges_of([box(-1e12, -1e12, 1e12, 1e12)]), (0, 0, 10, 10), 10)
    assert (far == 255).all()
    assert coverage.alpha_of_edges(np.zeros((0, 4)), (0, 0, 8, 2), 8).shape == (2, 8)
    assert [coverage.reference_size(w) for w in (8, 24, 64)] == [512, 768, 1024]


def test_boxes_from_runs_equal_those_of_whole_rasters():
    rng = np.random.default_rng(8)
    for n in range(300):
        rings = [star(rng, int(rng.integers(3, 20)), rng.uniform(-2, 14), 7.0)] + ([box(*rng.uniform(-4, 16, 4))] if n % 3 == 0 else [])
        edges = coverage.edges_of(rings)
        for width in (7, 40):
            want = coverage._measure(coverage.alpha_of_edges(edges, (0, 0, 12, 9), width), (0, 0, 12, 9))[2:6]
            assert coverage.box_of_edges(edges, (0, 0, 12, 9), width) == (None if want[0] is None else want)
    assert coverage.box_of_edges(np.zeros((0, 4)), (0, 0, 8, 8), 8) is None


def test_measures_agree_with_those_of_rasters(spark):
    rng = np.random.default_rng(5)
    rows = [(i, [star(rng, 11, 4.0, 5.5)], "x", "y") for i in range(20)]
    bad = [None, [], [None], [ring((1, 1), (2, 2))], [[{"x": 1.0, "y": None}, *box(0, 0, 4, 4)]], [[None, *box(0, 0, 4, 4)]], [[{"x": float("nan"), "y": 1.0}, *box(0, 0, 4, 4)]], [[{"x": float("inf"), "y": 1.0}, *box(0, 0, 4, 4)]]]
    rows += [(100 + i, r, "x", "y") for i, r in enumerate(bad)] + [(None, [box(0, 0, 8, 8)], "x", "y"), (0, *rows[0][1:])]
    df = spark.createDataFrame(rows, RINGS)
    got = coverage.measures(df, "key", "rings", (0, 0, 8, 8), (8, 16))
    assert got.count() == 2 * len(rows) and coverage.measures(df.limit(0), "key", "rings", (0, 0, 8, 8), (8,)).count() == 0
    r = coverage.rasters(df, "key", "rings", (0, 0, 8, 8), (8, 16)).where("size = 8 AND key < 100").dropDuplicates(["key"]).cache()
    b = {x.key: x for x in raster.bounds(r, "key").join(raster.centroid(r, "key"), "key").collect()}
    for m in got.where("size = 8 AND key < 100").collect():
        x = b[m.key]
        assert (m.painted_pixels, m.alpha_sum, m.touches) == (x.painted_pixels, x.alpha_sum, x.touches)
        assert (m.min_x, m.min_y, m.max_x, m.max_y) == (x.min_x, x.min_y, x.max_x + 1, x.max_y + 1)
        assert abs(m.x - x.x) < 1e-6 and abs(m.y - x.y) < 1e-6
    assert got.where("key >= 100 AND painted_pixels = 0 AND x IS NULL AND touches = ''").count() == 2 * len(bad)
    whole = got.where("key IS NULL").orderBy("size").collect()
    assert [(x.painted_pixels, x.touches, x.x, x.max_y) for x in whole] == [(64, "left,right,top,bottom", 4.0, 8.0), (256, "left,right,top,bottom", 4.0, 8.0)]


def test_clipping_by_side_and_by_lost_alpha(spark):
    rows = [(1, [box(2, 2, 6, 6)], "", ""), (2, [box(0, 2, 4, 6)], "", ""), (3, [box(0.9, 2, 7, 6)], "", ""), (4, None, "", ""), (5, [box(2, 2, 6, 8)], "", "")]
    df = spark.createDataFrame(rows, RINGS)
    got = coverage.clipping(df, "key", "rings", (0, 0, 8, 8), (1, 0, 8, 8), (8, 16))
    by = {(r.key, r.size): (r.retained, r.sides, r.touches) for r in got.collect()}
    assert by[1, 8] == (1.0, "", "") and by[2, 16] == (0.75, "left,raster-loss", "left") and by[4, 8] == (1.0, "", "")
    assert by[3, 8][1] == "left" and 0.95 < by[3, 8][0] < 1 and by[5, 8] == (1.0, "", "bottom")
    assert got.agg(F.count(F.lit(1))).first()[0] == 10


def spread_count(a, threshold, least):
    """The same by spreading from every pixel."""
    left = {(y, x) for y, x in zip(*np.nonzero(a > threshold), strict=True)}
    n = 0
    while left:
        todo, seen = [left.pop()], 1
        while todo:
            y, x = todo.pop()
            for q in ((y - 1, x), (y + 1, x), (y, x - 1), (y, x + 1)):
                if q in left:
                    left.remove(q)
                    todo.append(q)
                    seen += 1
        n += seen >= least
    return n


def test_components_of_many_rasters_at_once():
    rng = np.random.default_rng(6)
    images = [(rng.random((int(rng.integers(0, 20)), 13)) < rng.uniform(0.2, 0.8)) * 255 for _ in range(200)] + [np.zeros((0, 13)), np.full((5, 13), 255)]
    got = raster.component_counts(images)
    assert got.tolist() == [spread_count(a, raster.STRUCTURE, 2) for a in images]
    assert raster.component_counts([]).tolist() == [] and raster.component_count_of(np.zeros((0, 8))) == 0
    spiral = np.zeros((128, 128), int)
    y, x, dy, dx = 0, 0, 0, 1
    spiral[0, 0] = 255
    free = lambda y, x: 0 <= y < 128 and 0 <= x < 128 and not spiral[y, x]
    for _ in range(128 * 128):
        ahead = 0 <= y + dy < 128 and 0 <= x + dx < 128 and free(y + dy, x + dx)
        beyond = not (0 <= y + 2 * dy < 128 and 0 <= x + 2 * dx < 128) or not spiral[y + 2 * dy, x + 2 * dx]
        if not (ahead and beyond):
            dy, dx = dx, -dy
            if not free(y + dy, x + dx) or (0 <= y + 2 * dy < 128 and 0 <= x + 2 * dx < 128 and spiral[y + 2 * dy, x + 2 * dx]):
                break
        y, x = y + dy, x + dx
        spiral[y, x] = 255
    assert spiral.astype(bool).sum() > 7000 and raster.component_count_of(spiral) == 1
    assert raster.component_count_of(255 - spiral) == spread_count(255 - spiral, raster.STRUCTURE, 2)
