"""Whitening of embeddings from an exact scatter matrix, put together from residues modulo several primes.

1. Counts: every component c becomes the integer x = floor(scale * c) + shift. Tasks add up rows, sums, least and largest x of
   each dimension; sums are Python integers, so no size of table overflows them.
2. Scatter: with d = n*x - S (the centred row, times n) each task takes d modulo several primes below 2^21 and multiplies
   blocks of rows as matrices of balanced residues, in doubles: a block has so few rows that no sum reaches 2^53. There are
   as many primes as the largest |d| and n call for. Residues of a task's rows are added up modulo each prime.
3. Tasks send one row for each prime and row of the matrix; rows of one matrix row meet in one place, are added up as they
   stream by, and Chinese remainders give the exact integer entries, n^3 times the covariance.
4. The driver, which holds one matrix of dims x dims doubles, finds the eigenvectors twice: of the matrix, then of what the
   first basis leaves of it, which cleans up the smaller components.
5. Each row is projected; a last pass measures the covariance of the projections, centred in each block and merged by rows.
"""

from __future__ import annotations

import math
from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import shuffle_parts

#: Residues of at most 2^20 in size: 8,192 products of two stay below 2^53, where doubles are exact.
PRIME_BITS, BLOCK = 21, 8192
#: Components must be below 2^63 as integers.
FITS = 2.0**62


def primes(product: int) -> list[int]:
    """The largest primes below 2^PRIME_BITS, as many as exceed the product."""
    top, least = 1 << PRIME_BITS, (1 << PRIME_BITS) - 4096
    sieve = np.ones(top - least, bool)
    for k in range(2, math.isqrt(top) + 1):
        sieve[(-least) % k :: k] = False
    out = []
    for p in (least + np.flatnonzero(sieve)[::-1]).tolist():
        if math.prod(out) > product:
            return out
        out.append(p)
    if math.prod(out) > product:
        return out
    raise ValueError("components are too large and too many for an exact scatter")


def usable(vector: Column, scale: float) -> Column:
    """Vectors without null or non-finite components, whose integers are longs."""
    return vector.isNotNull() & F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double") * scale) < FITS))


def integers(column: pa.Array, scale: float, shift: int) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return (np.floor(flat * scale).astype(np.int64) + shift).reshape(len(column), -1)


def blocks(source, at: int, scale: float, shift: int):
    """(Arrow rows, their integers) of at most BLOCK rows at a time, gathered over small batches."""
    waiting, have = [], 0
    for batch in source:
        for a in range(0, batch.num_rows, BLOCK):
            part = batch.slice(a, BLOCK)
            if have and have + part.num_rows > BLOCK:
                rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
                yield rows, integers(rows.column(at), scale, shift)
                waiting, have = [], 0
            waiting.append(part)
            have += part.num_rows
    if have:
        rows = pa.Table.from_batches(waiting).combine_chunks().to_batches()[0]
        yield rows, integers(rows.column(at), scale, shift)


class Fit:
    """What whitening needs to know of the fit list."""

    def __init__(self, n: int, sums: list[int], reach: int, dims: int):
        self.n, self.sums, self.reach, self.dims = n, sums, reach, dims

    def centred(self, x: np.ndarray) -> np.ndarray:
        """n*x - S: longs where all of them fit, else Python integers."""
        if self.reach < 1 << 62 and self.n * max(1, int(np.abs(x).max(initial=0))) < 1 << 62 and all(abs(s) < 1 << 62 for s in self.sums):
            return self.n * x - np.array(self.sums, np.int64)
        return self.n * x.astype(object) - np.array(self.sums, object)


def vectors(df: DataFrame, id_col: str, vector_col: str, scale: float) -> tuple[DataFrame, int]:
    """id and vector of the rows that take part, and how long their vectors are: the commonest length, the longer of equally common ones."""
    rows = df.select(F.col(id_col).alias("id"), F.col(vector_col).alias("vector")).where(usable(F.col(vector_col), scale) & (F.size(vector_col) > 0))
    lengths = rows.groupBy(F.size("vector").alias("dims")).count().orderBy(F.desc("count"), F.desc("dims")).limit(1).collect()
    dims = lengths[0].dims if lengths else 0
    return rows.where(F.size("vector") == dims), dims


def measure(rows: DataFrame, dims: int, scale: float, shift: int) -> Fit:
    """Rows, sums and the largest |n*x - S|; tasks send one row, which are merged in two levels."""

    def per_task(source):
        n, s, low, high = 0, [0] * dims, None, None
        for _, x in blocks(source, 0, scale, shift):
            n += len(x)
            whole, part = (x >> 31).sum(0).tolist(), (x & ((1 << 31) - 1)).sum(0).tolist()  # BLOCK rows of either half fit a long
            s = [a + (b << 31) + c for a, b, c in zip(s, whole, part, strict=True)]
            low = x.min(0) if low is None else np.minimum(low, x.min(0))
            high = x.max(0) if high is None else np.maximum(high, x.max(0))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [[str(v) for v in s]], "low": [low.tolist()], "high": [high.tolist()]}, schema=as_arrow)

    def merge(source):
        n, s, low, high = 0, [0] * dims, None, None
        for batch in source:
            for row in batch.to_pylist():
                n += row["n"]
                s = [a + int(b) for a, b in zip(s, row["sums"], strict=True)]
                low = row["low"] if low is None else list(map(min, low, row["low"]))
                high = row["high"] if high is None else list(map(max, high, row["high"]))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "sums": [list(map(str, s))], "low": [low], "high": [high]}, schema=as_arrow)

    as_arrow = pa.schema([("n", pa.int64()), ("sums", pa.list_(pa.string())), ("low", pa.list_(pa.int64())), ("high", pa.list_(pa.int64()))])
    schema = "n long, sums array<string>, low array<long>, high array<long>"
    few = rows.select("vector").mapInArrow(per_task, schema).repartition(shuffle_parts(rows.sparkSession)).mapInArrow(merge, schema).toArrow()
    parts = list(merge(few.to_batches()))
    if not parts:
        return Fit(0, [0] * dims, 0, dims)
    total = parts[0].to_pylist()[0]
    n, sums = total["n"], list(map(int, total["sums"]))
    reach = max(max(abs(n * a - s), abs(n * b - s)) for a, b, s in zip(total["low"], total["high"], sums, strict=True))
    return Fit(n, sums, reach, dims)


def scatter(rows: DataFrame, fit: Fit, scale: float, shift: int) -> DataFrame:
    """i, entries (of n^2 times the covariance's row i, as decimal text) and covariance (doubles, correctly rounded): one row a dimension."""
    modulus = primes(2 * fit.n * fit.reach * fit.reach)
    n, dims, sums = fit.n, fit.dims, fit.sums

    def residues(x: np.ndarray, p: int) -> np.ndarray:
        d = (n % p * (x % p) - np.array([s % p for s in sums], np.int64)) % p  # never the centred number itself, so nothing overflows
        return np.where(d > p // 2, d - p, d).astype(np.float64)

    def per_task(source):
        total = np.zeros((len(modulus), dims, dims), np.int64)
        some = False
        for _, x in blocks(source, 0, scale, shift):
            some = True
            for k, p in enumerate(modulus):
                r = residues(x, p)
                total[k] = (total[k] + (r.T @ r).astype(np.int64)) % p
        if some:
            for k in range(len(modulus)):
                yield pa.RecordBatch.from_arrays([pa.array([k] * dims, pa.int32()), pa.array(range(dims), pa.int32()), pa.array(list(total[k]), pa.list_(pa.int64()))], names=["k", "i", "entries"])

    product = math.prod(modulus)
    lifts = [product // p * pow(product // p, -1, p) for p in modulus]

    def remainders(source):
        """Add up each matrix row's residues as they stream by, then reconstruct it."""
        held: dict[int, np.ndarray] = {}
        for batch in source:
            values = batch.column(2).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, dims)
            for k, i, row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values, strict=True):
                mine = held.setdefault(i, np.zeros((len(modulus), dims), np.int64))
                mine[k] = (mine[k] + row) % modulus[k]
        for i, mine in held.items():
            exact = [sum(int(r) * lift for r, lift in zip(column, lifts, strict=True)) % product for column in mine.T]
            exact = [v - product if v > product // 2 else v for v in exact]
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([list(map(str, exact))], pa.list_(pa.string())), pa.array([[v / n**3 for v in exact]], pa.list_(pa.float64()))], names=["i", "entries", "covariance"])

    parts = rows.select("vector").mapInArrow(per_task, "k int, i int, entries array<long>")
    return parts.repartition(max(1, min(dims, shuffle_parts(rows.sparkSession))), "i").mapInArrow(remainders, "i int, entries array<string>, covariance array<double>")


def eigen(covariance: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Eigenvalues by falling size and their unit eigenvectors as columns, those beyond rounding from zero alone.

    The second eigh is of the matrix in the basis of the first, whose entries off the diagonal are rounding that it undoes.
    """
    _, first = np.linalg.eigh(covariance)
    turned = first.T @ covariance @ first
    values, second = np.linalg.eigh((turned + turned.T) / 2)
    vectors = first @ second
    order = np.argsort(-values, kind="stable")[:most]
    values, vectors = values[order], vectors[:, order]
    clear = values > len(covariance) * np.finfo(float).eps * max(values.max(initial=0.0), 0.0)
    return values[clear], vectors[:, clear] / np.linalg.norm(vectors[:, clear], axis=0)


def whiten(df: DataFrame, components: int = 32, scale: float = 64.0, shift: int = 1_000_000, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """id, n, deviation (exact, as decimal(38,0); null beyond that), whitened and explained (arrays of at most `components` doubles, largest eigenvalue
    first) and identity_error of each row that takes part.

    Rows whose vector is null, empty, of another length than the commonest, or holds null, non-finite or (times scale) 2^62 and
    larger components take no part and have no row. One row out for each other row in, repeated ones and null ids included;
    other columns are left out. Components whose eigenvalue is zero but for rounding can't be scaled and are left out, so that equal
    rows, or a single one, give empty arrays (identity_error 0). An empty table gives no rows. Signs are the same for all rows.
    """
    spark = df.sparkSession
    kind = df.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n long, deviation decimal(38,0), whitened array<double>, explained array<double>, identity_error double"
    rows, dims = vectors(df, id_col, vector_col, scale)
    fit = measure(rows, dims, scale, shift)
    if not fit.n:
        return spark.createDataFrame([], schema).withColumnRenamed("id", id_col)
    matrix = np.zeros((dims, dims))
    for row in scatter(rows, fit, scale, shift).select("i", "covariance").collect():  # dims rows of dims doubles
        matrix[row.i] = row.covariance
    values, basis = eigen(matrix, components)
    share = (values / np.trace(matrix)).tolist()
    project = basis / np.sqrt(values)

    def projected(x: np.ndarray) -> np.ndarray:
        return (fit.centred(x) / fit.n).astype(np.float64) @ project

    def per_task(source):
        """n, mean and scatter about it of the projections, block by block."""
        n, mean, about = 0, np.zeros(len(values)), np.zeros((len(values),) * 2)
        for _, x in blocks(source, 0, scale, shift):
            w = projected(x)
            n, mean, about = merged((n, mean, about), (len(w), w.mean(0), (w - w.mean(0)).T @ (w - w.mean(0))))
        if n:
            yield pa.RecordBatch.from_pydict({"n": [n], "mean": [mean.tolist()], "about": [about.ravel().tolist()]})

    def merge(source):
        total = 0, np.zeros(len(values)), np.zeros((len(values),) * 2)
        for batch in source:
            for row in batch.to_pylist():
                total = merged(total, (row["n"], np.array(row["mean"]), np.array(row["about"]).reshape(len(values), -1)))
        if total[0]:
            yield pa.RecordBatch.from_pydict({"n": [total[0]], "mean": [total[1].tolist()], "about": [total[2].ravel().tolist()]})

    error = 0.0
    if len(values):
        moments = "n long, mean array<double>, about array<double>"
        few = rows.select("vector").mapInArrow(per_task, moments).repartition(shuffle_parts(spark)).mapInArrow(merge, moments).toArrow()
        total = next(merge(few.to_batches())).to_pylist()[0]
        error = float(np.abs(np.array(total["about"]).reshape(len(values), -1) / total["n"] - np.eye(len(values))).max())

    def run(source):
        for part, x in blocks(source, 1, scale, shift):
            d = fit.centred(x)
            if d.dtype == object or dims * fit.reach**2 >= 1 << 63:
                deviation = [sum(int(v) ** 2 for v in row) for row in d]
            else:
                deviation = (d * d).sum(1).tolist()
            m = len(x)
            flat = pa.array(((d / fit.n).astype(np.float64) @ project).ravel())
            offsets = pa.array(np.arange(m + 1) * len(values), pa.int32())
            shares = pa.ListArray.from_arrays(offsets, pa.array(share * m, pa.float64()))
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([fit.n] * m, pa.int64()), pa.array([Decimal(v) if v < 10**38 else None for v in deviation], pa.decimal128(38, 0)), pa.ListArray.from_arrays(offsets, flat), shares, pa.array([error] * m)],
                names=["id", "n", "deviation", "whitened", "explained", "identity_error"],
            )

    return rows.mapInArrow(run, schema).withColumnRenamed("id", id_col)


def merged(a, b):
    """Count, mean and scatter about the mean of two sets of rows together."""
    n = a[0] + b[0]
    shift = b[1] - a[1]
    return n, a[1] + shift * (b[0] / n), a[2] + b[2] + np.outer(shift, shift) * (a[0] * b[0] / n)
