"""Polygons as alpha: the exact area of each pixel that an outline covers, at any size, and what is measured of it.

An outline is an array of rings, each an array of struct(x, y) in units of a view (x, y, width, height); curves come flattened.
Rings that turn the same way add up and rings that turn the other way cut holes; a pixel is covered once at most. Edges are cut
where they cross lines between pixels, so each piece lies in one pixel: its height goes to that pixel and to all right of it.
One raster at a time stands in memory, whatever the number of outlines and sizes.

Defined results: a null outline, one without rings, rings of fewer than three points and null rings cover nothing; a null or
non-finite point makes the outline cover nothing. Repeated keys give repeated rows, null keys stay.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.numeric import r6
from .raster import PAINTED

View = tuple[float, float, float, float]
#: Pixels a unit of the view, least and most, of the raster that bounds are taken from.
REFERENCE = (32, 512, 1024)


def reference_size(width: float) -> int:
    per_unit, least, most = REFERENCE
    return min(most, max(least, int(width * per_unit + 0.5)))


def edges_of(rings) -> np.ndarray:
    """x, y of both ends of all edges, one row each."""
    out = []
    for ring in rings or []:
        points = np.array([(np.nan, np.nan) if p is None or p["x"] is None or p["y"] is None else (p["x"], p["y"]) for p in ring or []], float).reshape(-1, 2)
        if not np.isfinite(points).all():
            return np.zeros((0, 4))
        if len(points) > 2:
            out.append(np.hstack([points, np.roll(points, -1, 0)]))
    return np.concatenate(out) if out else np.zeros((0, 4))


def _crossings(start: np.ndarray, step: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Edge and share of its way of each crossing with the lines 0..most."""
    low, high = np.minimum(start, start + step), np.maximum(start, start + step)
    first = np.clip(np.floor(low) + 1, 0, most + 1).astype(int)
    n = np.maximum(0, np.clip(np.ceil(high) - 1, -1, most).astype(int) - first + 1)
    edge = np.repeat(np.arange(len(start)), n)
    line = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + first[edge]
    return edge, (line - start[edge]) / step[edge]


def _steps(edges: np.ndarray, view: View, width: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Where coverage changes along the rows of a raster (pixels of rows of width + 2) and by how much, and its height."""
    height = max(1, int(width * view[3] / view[2] + 0.5))
    scale = np.array([width / view[2], height / view[3]] * 2)
    a = (edges - np.array([view[0], view[1]] * 2)) * scale
    x, y, dx, dy = a[:, 0], a[:, 1], a[:, 2] - a[:, 0], a[:, 3] - a[:, 1]
    across, down = _crossings(x, dx, width), _crossings(y, dy, height)
    every = np.arange(len(a))
    edge = np.concatenate([every, every, across[0], down[0]])
    at = np.clip(np.concatenate([np.zeros(len(a)), np.ones(len(a)), across[1], down[1]]), 0, 1)
    order = np.lexsort((at, edge))
    edge, at = edge[order], at[order]
    same = edge[1:] == edge[:-1]
    e, t0, t1 = edge[1:][same], at[:-1][same], at[1:][same]
    middle, tall = (t0 + t1) / 2, (t1 - t0) * dy[e]
    row = np.floor(y[e] + middle * dy[e])
    inside = (row >= 0) & (row < height)
    row, tall = row[inside].astype(int), tall[inside]
    where = np.clip((x[e] + middle * dx[e])[inside], 0, width)
    column = np.floor(where).astype(int)
    share, wide = where - column, width + 2
    return np.concatenate([row * wide + column, row * wide + column + 1]), np.concatenate([tall * (1 - share), tall * share]), height


def _alpha(total: np.ndarray) -> np.ndarray:
    return np.floor(np.round(np.minimum(1, np.abs(total)), 9) * 255 + 0.5).astype(np.int32)


def alpha_of_edges(edges: np.ndarray, view: View, width: int) -> np.ndarray:
    """Alphas 0..255 of a raster of the given width; its height follows from the view."""
    at, by, height = _steps(edges, view, width)
    return _alpha(np.cumsum(np.bincount(at, by, height * (width + 2)).reshape(height, width + 2), 1)[:, :width])


def box_of_edges(edges: np.ndarray, view: View, width: int) -> tuple[float, float, float, float] | None:
    """The painted box of the same raster in the view's units, from the runs between changes alone; None without paint."""
    at, by, height = _steps(edges, view, width)
    wide = width + 2
    places, of = np.unique(at, return_inverse=True)
    row, start = np.divmod(places, wide)
    total = np.cumsum(np.bincount(of, by, len(places)))
    first = np.searchsorted(row, row, "left")
    total = total - np.where(first > 0, total[first - 1], 0.0) if len(places) else total
    end = np.where(np.append(row[1:] == row[:-1], False) if len(row) else np.zeros(0, bool), np.append(start[1:], width), width)
    end = np.minimum(end, width)
    on = (_alpha(total) > PAINTED) & (start < end)
    if not on.any():
        return None
    sx, sy = view[2] / width, view[3] / height
    return view[0] + start[on].min() * sx, view[1] + row[on].min() * sy, view[0] + end[on].max() * sx, view[1] + (row[on].max() + 1) * sy


def rasters(df: DataFrame, key: str, rings: str, view: View, sizes: tuple[int, ...]) -> DataFrame:
    """key, size and alpha (row by row) of each outline at each size."""
    kind = df.schema[key].dataType.simpleString()

    def run(source):
        for batch in source:
            for i, outline in enumerate(batch.column(1).to_pylist()):
                edges = edges_of(outline)
                for size in sizes:
                    alpha = alpha_of_edges(edges, view, size).ravel()
                    yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, 1), pa.array([size], pa.int32()), pa.array([alpha], pa.list_(pa.int32()))], names=[key, "size", "alpha"])

    return df.select(key, rings).mapInArrow(run, f"`{key}` {kind}, size int, alpha array<int>")


def _measure(alpha: np.ndarray, view: View) -> tuple:
    """Painted pixels, alpha sum, painted box and centre in the view's units, sides that paint touches."""
    on = alpha > PAINTED
    if not on.any():
        return 0, 0, None, None, None, None, None, None, ""
    columns, rows = np.flatnonzero(on.any(0)), np.flatnonzero(on.any(1))
    height, width = alpha.shape
    painted = np.where(on, alpha, 0).astype(np.int64)
    total = int(painted.sum())
    sx, sy = view[2] / width, view[3] / height
    x = float((painted.sum(0) * (np.arange(width) + 0.5)).sum()) / total
    y = float((painted.sum(1) * (np.arange(height) + 0.5)).sum()) / total
    sides = [s for s, c in (("left", columns[0] == 0), ("right", columns[-1] == width - 1), ("top", rows[0] == 0), ("bottom", rows[-1] == height - 1)) if c]
    return int(on.sum()), total, view[0] + columns[0] * sx, view[1] + rows[0] * sy, view[0] + (columns[-1] + 1) * sx, view[1] + (rows[-1] + 1) * sy, view[0] + x * sx, view[1] + y * sy, ",".join(sides)


_MEASURES = ("painted_pixels", "alpha_sum", "min_x", "min_y", "max_x", "max_y", "x", "y", "touches")
_KINDS = (pa.int64(), pa.int64(), *[pa.float64()] * 6, pa.string())


def measures(df: DataFrame, key: str, rings: str, view: View, sizes: tuple[int, ...]) -> DataFrame:
    """key, size, painted_pixels, alpha_sum, painted box and centre (in the view's units) and touches, a row a size.

    An outline that paints nothing has zeros, nulls and no sides.
    """
    kind = df.schema[key].dataType.simpleString()

    def run(source):
        for batch in source:
            rows, keys = [], []
            for i, outline in enumerate(batch.column(1).to_pylist()):
                edges = edges_of(outline)
                for size in sizes:
                    keys.append(i)
                    rows.append((size, *_measure(alpha_of_edges(edges, view, size), view)))
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), *_KINDS))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], names=[key, "size", *_MEASURES])

    got = df.select(key, rings).mapInArrow(run, f"`{key}` {kind}, size int, painted_pixels long, alpha_sum long, min_x double, min_y double, max_x double, max_y double, x double, y double, touches string")
    return got.select(key, "size", "painted_pixels", "alpha_sum", *[r6(F.col(c)).alias(c) for c in _MEASURES[2:8]], "touches")


def clipping(df: DataFrame, key: str, rings: str, view: View, candidate: View, sizes: tuple[int, ...], least: float = 0.95) -> DataFrame:
    """What an outline loses when it is seen through another view, a row a size: retained alpha, touches and sides.

    Sides come from the box of the reference raster, by a hundred-thousandth of the view; raster-loss joins them where any
    size keeps less than `least` of its alpha.
    """
    kind = df.schema[key].dataType.simpleString()
    slack = max(candidate[2], candidate[3]) / 100_000

    def run(source):
        for batch in source:
            keys, rows = [], []
            for i, outline in enumerate(batch.column(1).to_pylist()):
                edges = edges_of(outline)
                box = box_of_edges(edges, view, reference_size(view[2]))
                out = box and (box[0] < candidate[0] - slack, box[2] > candidate[0] + candidate[2] + slack, box[1] < candidate[1] - slack, box[3] > candidate[1] + candidate[3] + slack)
                sides = [s for s, lost in zip(("left", "right", "top", "bottom"), out, strict=True) if lost] if out else []
                seen = [(_measure(alpha_of_edges(edges, view, s), view)[1], _measure(alpha_of_edges(edges, candidate, s), candidate)) for s in sizes]
                kept = [after[1] / before if before else 1.0 for before, after in seen]
                sides += ["raster-loss"] if any(float(f"{k:.6f}") < least and k < least for k in kept) else []
                keys += [i] * len(sizes)
                rows += [(s, k, after[8], ",".join(sides)) for s, k, (_, after) in zip(sizes, kept, seen, strict=True)]
            columns = [pa.array([r[k] for r in rows], t) for k, t in enumerate((pa.int32(), pa.float64(), pa.string(), pa.string()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(keys, pa.int64())), *columns], names=[key, "size", "retained", "touches", "sides"])

    got = df.select(key, rings).mapInArrow(run, f"`{key}` {kind}, size int, retained double, touches string, sides string")
    return got.withColumn("retained", r6(F.col("retained")))
