"""Measures of small rasters held as arrays of alpha values (row by row), one row a raster.

Sums, bounds, profiles, edges and symmetry are array expressions: a raster is measured where it lies, without a shuffle.
Hulls and connected components are inherently sequential and run on Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6

PAINTED, STRUCTURE = 1, 8  # fixed values: alpha above which a pixel is painted, and part of a component


def alpha_of(values: Column) -> Column:
    """Alphas 0..255 of an array of numbers around 0."""
    return F.transform(values, lambda v: F.coalesce(F.least(F.lit(255), F.floor(F.abs(v.cast("double")) * 510)), F.lit(0)).cast("int"))


def cells(df: DataFrame, key: str, alpha: str = "alpha", width: int = 8) -> DataFrame:
    """The long form: one row a pixel."""
    return df.select(key, F.posexplode(alpha).alias("i", "alpha")).select(key, (F.col("i") % width).alias("x"), F.floor(F.col("i") / width).cast("int").alias("y"), "alpha")


def _sum(values: Column) -> Column:
    return F.aggregate(values, F.lit(0.0), lambda s, v: s + v)


def _painted(df: DataFrame, alpha: str, threshold: int) -> DataFrame:
    return df.withColumn("_a", F.transform(alpha, lambda v: F.when(v > threshold, v).otherwise(0)))


def bounds(df: DataFrame, key: str, alpha: str = "alpha", width: int = 8, threshold: int = PAINTED) -> DataFrame:
    """Painted pixels, alpha sum, the box around them and the sides that it touches; an unpainted raster has null bounds."""
    p = _painted(df, alpha, threshold).withColumn("_on", F.filter(F.transform("_a", lambda v, i: F.when(v > 0, i)), lambda i: i.isNotNull()))
    xs, ys = F.transform("_on", lambda i: i % width), F.transform("_on", lambda i: F.floor(i / width).cast("int"))
    m = p.select(key, F.size("_on").alias("painted_pixels"), _sum("_a").cast("long").alias("alpha_sum"), F.array_min(xs).alias("min_x"), F.array_max(xs).alias("max_x"), F.array_min(ys).alias("min_y"), F.array_max(ys).alias("max_y"), F.floor(F.size("_a") / width).cast("int").alias("_h"))
    sides = (("left", F.col("min_x") == 0), ("right", F.col("max_x") == width - 1), ("top", F.col("min_y") == 0), ("bottom", F.col("max_y") == F.col("_h") - 1))
    return m.withColumn("touches", F.array_join(F.filter(F.array(*[F.when(c, F.lit(s)) for s, c in sides]), lambda s: s.isNotNull()), ",")).drop("_h")


def centroid(df: DataFrame, key: str, alpha: str = "alpha", width: int = 8, threshold: int = PAINTED) -> DataFrame:
    """Alpha-weighted centre in pixels; null without paint."""
    p = _painted(df, alpha, threshold)
    total = _sum("_a")
    x, y = _sum(F.transform("_a", lambda v, i: v * (i % width + 0.5))), _sum(F.transform("_a", lambda v, i: v * (F.floor(i / width) + 0.5)))
    return p.select(key, F.try_divide(x, total).alias("x"), F.try_divide(y, total).alias("y"))


def edge_centroid(df: DataFrame, key: str, alpha: str = "alpha", width: int = 8, threshold: int = PAINTED) -> DataFrame:
    """Centre weighted by differences to the four neighbours; outside of the raster alpha is 0.

    Neighbours keep their alpha even where it is too faint to count as paint itself.
    """
    p = _painted(df, alpha, threshold).withColumn("_r", F.col(alpha))
    at = lambda i, ok: F.when(ok, F.coalesce(F.get(F.col("_r"), i), F.lit(0))).otherwise(0)

    def weight(v, i):
        x = i % width
        near = (at(i - 1, x > 0), at(i + 1, x < width - 1), at(i - width, i >= width), at(i + width, i + width < F.size("_r")))
        total = F.abs(v - near[0])
        for n in near[1:]:
            total = total + F.abs(v - n)
        return F.when(v > 0, total).otherwise(0)

    e = p.withColumn("_e", F.transform("_a", weight))
    total = _sum("_e")
    x, y = _sum(F.transform("_e", lambda v, i: v * (i % width + 0.5))), _sum(F.transform("_e", lambda v, i: v * (F.floor(i / width) + 0.5)))
    return e.select(key, total.cast("long").alias("edge_sum"), F.when(total > 0, F.try_divide(x, total)).alias("x"), F.when(total > 0, F.try_divide(y, total)).alias("y"))


def profile(alpha: Column, axis: str, width: int, size: int, threshold: int = PAINTED) -> Column:
    """Alpha summed by column (x) or row (y)."""
    def line(k):
        picks = F.filter(F.transform(alpha, lambda v, i: F.when(((i % width) if axis == "x" else F.floor(i / width)) == k, F.when(v > threshold, v).otherwise(0))), lambda v: v.isNotNull())
        return F.aggregate(picks, F.lit(0).cast("long"), lambda s, v: s + v)

    return F.transform(F.sequence(F.lit(0), F.lit(size - 1)), line)


def symmetry(df: DataFrame, key: str, column: str) -> DataFrame:
    """The mirror axis of a profile in half pixels (axis2) with the least error, ties to the centre then the lower; and its score."""
    p = F.col(column)
    n = F.size(p)
    out = df.select(key, p.alias("_p")).withColumn("_t", F.aggregate("_p", F.lit(0).cast("long"), lambda s, v: s + v))
    p, n = F.col("_p"), F.size("_p")

    def error(axis2):
        miss = F.transform(p, lambda v, i: F.abs(v - F.when((axis2 - i - 1 >= 0) & (axis2 - i - 1 < n), F.get(p, axis2 - i - 1)).otherwise(0)))
        return F.aggregate(miss, F.lit(0).cast("long"), lambda s, v: s + v)

    best = F.array_min(F.transform(F.sequence(F.lit(1), 2 * n - 1), lambda a: F.struct(error(a).alias("e"), F.abs(a - n).alias("d"), a.alias("axis2"))))
    painted = F.col("_t") > 0
    return out.withColumn("_b", best).select(key, F.when(painted, F.col("_b.axis2")).alias("axis2"), F.when(painted, r6(F.greatest(F.lit(0.0), 1 - F.col("_b.e") / F.when(painted, 2 * F.col("_t"))))).alias("score"))


# --- sequential measures on Arrow batches -----------------------------------------------------------------------------


def hull_of(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Corners of the convex hull, anticlockwise from the leftmost; points on its sides are no corners."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        chain: list[tuple[float, float]] = []
        for q in seq:
            while len(chain) > 1:
                (ax, ay), (bx, by) = chain[-2:]
                if (bx - ax) * (q[1] - ay) > (by - ay) * (q[0] - ax):
                    break
                chain.pop()
            chain.append(q)
        return chain[:-1]

    return half(pts) + half(pts[::-1])


def area_centre(corners: list[tuple[float, float]]) -> tuple[float, float] | None:
    if len(corners) < 3:
        return None
    c = np.array(corners)
    d = np.roll(c, -1, 0)
    cross = c[:, 0] * d[:, 1] - d[:, 0] * c[:, 1]
    twice = cross.sum()
    if abs(twice) < 1e-9:
        return None
    return tuple(((c + d) * cross[:, None]).sum(0) / (3 * twice))


def boundary_of(a: np.ndarray, threshold: int = PAINTED) -> list[tuple[float, float]]:
    """Centres of painted pixels with an unpainted neighbour."""
    on = np.pad(a > threshold, 1)
    inner = on[1:-1, 1:-1]
    open_ = inner & ~(on[:-2, 1:-1] & on[2:, 1:-1] & on[1:-1, :-2] & on[1:-1, 2:])
    y, x = np.nonzero(open_)
    return [(i + 0.5, j + 0.5) for i, j in zip(x.tolist(), y.tolist(), strict=True)]


def component_counts(images: list[np.ndarray], threshold: int = STRUCTURE, least: int = 2) -> np.ndarray:
    """4-connected groups of at least `least` pixels in each of several rasters of one width, in two passes.

    The first finds the runs of all rows and which of them touch a run in the next row; the second joins those by union and
    find and counts pixels by root. An empty row parts the rasters, so all of them are labelled at once.
    """
    width = max((a.shape[1] for a in images if a.size), default=0)
    heights = np.array([len(a) if a.size else 0 for a in images], int)
    on = np.zeros((int(heights.sum()) + len(images), width + 2), np.int8)
    top = np.cumsum(heights + 1) - heights - 1
    for a, h, at in zip(images, heights.tolist(), top.tolist(), strict=True):
        if h:
            on[at : at + h, 1:-1] = a > threshold
    edge = np.diff(on, axis=1)
    row, start = np.nonzero(edge == 1)
    end = np.nonzero(edge == -1)[1]
    wide = width + 2
    # runs of the next row that end after this one starts and start before it ends
    low = np.searchsorted(row * wide + end, (row + 1) * wide + start, "right")
    high = np.searchsorted(row * wide + start, (row + 1) * wide + end, "left")
    n = np.maximum(0, high - low)
    upper = np.repeat(np.arange(len(row)), n)
    lower = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + low[upper]
    parent = list(range(len(row)))

    def root(i: int) -> int:
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    for i, j in zip(upper.tolist(), lower.tolist(), strict=True):
        i, j = root(i), root(j)
        parent[max(i, j)] = min(i, j)
    roots = np.array([root(i) for i in range(len(row))], int)
    area = np.bincount(roots, end - start, len(row)) if len(row) else np.zeros(0)
    large = np.flatnonzero(area >= least)
    return np.bincount(np.searchsorted(top, row[large], "right") - 1, minlength=len(images))


def component_count_of(a: np.ndarray, threshold: int = STRUCTURE, least: int = 2) -> int:
    return int(component_counts([a], threshold, least)[0])


def shapes(df: DataFrame, key: str, alpha: str = "alpha", width: int = 8, threshold: int = PAINTED, structure: int = STRUCTURE) -> DataFrame:
    """key, hull_x, hull_y (null for hulls without area) and components."""
    kind = df.schema[key].dataType.simpleString()

    def run(source):
        for batch in source:
            hull_x, hull_y = [], []
            images = [np.array(values or [], int).reshape(-1, width) for values in batch.column(1).to_pylist()]
            n = component_counts(images, structure)
            for a in images:
                c = area_centre(hull_of(boundary_of(a, threshold)))
                hull_x.append(c[0] if c else None), hull_y.append(c[1] if c else None)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(hull_x, pa.float64()), pa.array(hull_y, pa.float64()), pa.array(n, pa.int32())], names=[key, "hull_x", "hull_y", "components"])

    return df.select(key, alpha).mapInArrow(run, f"{key} {kind}, hull_x double, hull_y double, components int")


def shifted_retention(df: DataFrame, key: str, alpha: str = "alpha", width: int = 8, dx: int = 1, threshold: int = PAINTED, least: float = 0.95) -> DataFrame:
    """Alpha kept when a raster moves dx pixels to the right (left if negative), and what is lost: a side, and raster-loss."""
    p = _painted(df, alpha, threshold)
    kept = F.transform("_a", lambda v, i: F.when((i % width + dx >= 0) & (i % width + dx < width), v).otherwise(0))
    before, after = _sum("_a"), _sum(kept)
    share = F.when(before > 0, F.try_divide(after, before)).otherwise(1.0)
    side = F.when(after < before, "right" if dx > 0 else "left")
    codes = F.array(side, F.when(share < least, F.lit("raster-loss")))
    return p.select(key, r6(share).alias("retained"), F.array_join(F.array_distinct(F.filter(codes, lambda c: c.isNotNull())), ",").alias("sides"))


def resampled(alpha: Column, width: int, to: int) -> Column:
    """The raster at `to` pixels a side: the floored mean alpha of each block; width has to be a multiple of it."""
    step = width // to
    inside = [dy * width + dx for dy in range(step) for dx in range(step)]
    block = lambda i: sum((F.get(alpha, (F.floor(i / to) * step * width + i % to * step + o).cast("int")) for o in inside), F.lit(0))
    return F.transform(F.sequence(F.lit(0), F.lit(to * to - 1)), lambda i: F.floor(block(i) / (step * step)).cast("int"))
