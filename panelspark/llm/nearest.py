"""Approximate nearest neighbours by inner product over a hierarchical k-means tree.

The tree is fitted on a bounded sample; every row is then assigned to a leaf. A query walks the tree best bin first: a
priority queue holds subtrees by the distance of their centroids, and leaves are visited in the order they are popped.
How many leaves to visit is calibrated: the true neighbours of a bounded set of rows among all rows are found by brute
force, and visits widen until the leaves hold the wanted share of them. Inner products become distances by one more
component, sqrt(largest norm^2 - norm^2), which is 0 for queries.

Equal vectors are searched once. Leaves are cut into blocks of bounded size, each scored as one matrix product. The first
leaves of a query give it k scores, the least of which bounds its k best from below: later leaves only send on what
exceeds it, so that rows grow with queries and not with visits.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import keep, mix64

BLOCK = 32_768


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def lifted(x: np.ndarray, top: float) -> np.ndarray:
    return np.c_[x, np.sqrt(np.maximum(0.0, top * top - (x * x).sum(1)))]


class Tree:
    """Flat arrays: centroids of nodes, the children of each inner node, the leaf number of each leaf node."""

    def __init__(self, x: np.ndarray, leaf_rows: int, branching: int = 8, seed: int = 1):
        self.centre, self.children, self.leaf = [x.mean(0)], [None], [-1]
        self.leaves = 0
        rng, todo = np.random.default_rng(seed), [(0, x)]
        while todo:
            node, rows = todo.pop()
            groups = self._split(rows, branching, rng) if len(rows) > leaf_rows else []
            if len(groups) < 2:
                self.leaf[node], self.leaves = self.leaves, self.leaves + 1
                continue
            self.children[node] = np.arange(len(self.centre), len(self.centre) + len(groups))
            for g in groups:
                todo.append((len(self.centre), g))
                self.centre.append(g.mean(0)), self.children.append(None), self.leaf.append(-1)
        self.centre = np.array(self.centre)

    @staticmethod
    def _split(x: np.ndarray, k: int, rng) -> list[np.ndarray]:
        c = x[rng.choice(len(x), min(k, len(x)), replace=False)]
        for _ in range(12):
            near = ((c * c).sum(1) - 2 * x @ c.T).argmin(1)
            new = np.array([x[near == j].mean(0) if (near == j).any() else c[j] for j in range(len(c))])
            if np.allclose(new, c):
                break
            c = new
        return [x[near == j] for j in range(len(c)) if (near == j).any()]

    def assign(self, x: np.ndarray) -> np.ndarray:
        out = np.zeros(len(x), np.int32)
        todo = [(0, np.arange(len(x)))]
        while todo:
            node, rows = todo.pop()
            kids = self.children[node]
            if kids is None:
                out[rows] = self.leaf[node]
                continue
            c = self.centre[kids]
            near = ((c * c).sum(1) - 2 * x[rows] @ c.T).argmin(1)
            todo += [(int(kids[j]), rows[near == j]) for j in np.unique(near)]
        return out

    def visit(self, q: np.ndarray, most: int) -> list[int]:
        """The first `most` leaves, best bin first."""
        queue, out = [(0.0, 0)], []
        while queue and len(out) < most:
            _, node = heapq.heappop(queue)
            kids = self.children[node]
            if kids is None:
                out.append(self.leaf[node])
                continue
            gap = self.centre[kids] - q
            for d, k in zip((gap * gap).sum(1).tolist(), kids.tolist(), strict=True):
                heapq.heappush(queue, (d, k))
        return out


def top_rows(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Columns of the k best of each row by score, ties to the smaller id (ids ascend)."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, -k][:, None]
        return [np.flatnonzero(r >= e)[np.argsort(-r[r >= e], kind="stable")][:k] for r, e in zip(score, edge, strict=True)]
    return [np.argsort(-r, kind="stable") for r in score]


def valid_vectors(rows: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id and vector (array<double>) of rows that take part: no null or non-finite component, not all zero, of the commonest length."""
    v = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("v")).where(
        "vec_id IS NOT NULL AND v IS NOT NULL AND size(v) > 0 AND forall(v, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) < double('Infinity')) AND exists(v, x -> x <> 0)"
    )
    size = v.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1)
    n = size.first()
    return v.where(F.size("v") == (n["n"] if n else 0))


def nearest(rows: DataFrame, is_query, k: int = 20, recall: float = 0.96, leaves: int | None = None, sample_rows: int = 30_000, calibration_rows: int = 256, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: each query's k nearest other rows by inner product in double precision.

    is_query is a condition on vec_id. leaves is about how many the tree has (64 by default, or the cube root of
    the rows if that is more, so that a query's visits grow slowly); sample_rows bounds the rows that the tree is fitted on, calibration_rows those that
    the number of visits is calibrated on; both are even shares by a hash of the id. Every row is indexed. Vectors that are
    null, zero, or hold null or non-finite components take no part, nor do those of another length than the commonest. Ties
    go to the smaller vec_id; repeated vec_ids are candidates each. With no valid row the result is empty.
    """
    spark = rows.sparkSession
    v = valid_vectors(rows, id_col, vec_col)
    distinct = keep(v.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count(F.lit(1)).alias("n"), F.max(F.when(is_query, 1).otherwise(0)).alias("asked")))
    total, top = distinct.agg(F.count(F.lit(1)), F.max(F.sqrt(F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x)))).first()
    out_schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return spark.createDataFrame([], out_schema)

    def share(n: int, salt: int):
        return distinct if total <= n else distinct.where(F.pmod(F.xxhash64("rep", F.lit(salt)), F.lit(1_000_000)) < int(n / total * 1_000_000))

    sample = share(sample_rows, 1).select("rep", "v").orderBy("rep").toPandas()  # bounded by sample_rows
    x = np.array(sample["v"].tolist())
    tree = Tree(lifted(x, top), max(4, int(2.5 * len(x) / (leaves or max(64, total ** (1 / 3))))))

    def index(source):
        for batch in source:
            leaf = tree.assign(lifted(matrix(batch.column(0)), top))
            yield pa.RecordBatch.from_arrays([batch.column(1), pa.array(leaf), batch.column(0)], names=["rep", "leaf", "v"])

    indexed = keep(distinct.select("v", "rep").mapInArrow(index, "rep long, leaf int, v array<double>"))
    sizes = {r["leaf"]: r["count"] for r in indexed.groupBy("leaf").count().collect()}  # one row a leaf: bounded by the sample

    # calibration: true neighbours of a bounded set against all rows, in blocks, and where the walk meets their leaves
    probe = share(calibration_rows, 2).select("rep", "v").orderBy("rep").toPandas().head(4 * calibration_rows)
    pid, pv = probe["rep"].to_numpy(), np.array(probe["v"].tolist())

    def truth(source):
        for batch in source:
            rep, leaf, m = batch.column(0).to_numpy(), batch.column(1).to_numpy(), matrix(batch.column(2))
            order = np.argsort(rep, kind="stable")
            s = pv @ m[order].T
            s[pid[:, None] == rep[order][None, :]] = -np.inf
            best = top_rows(s, rep[order], k)
            q = np.repeat(np.arange(len(pid)), [len(b) for b in best])
            at = np.concatenate(best) if len(best) else np.zeros(0, int)
            yield pa.RecordBatch.from_arrays([pa.array(q.astype(np.int32)), pa.array(leaf[order][at]), pa.array(s[q, at])], names=["q", "leaf", "score"])

    visits = tree.leaves
    if len(pid):
        w = Window.partitionBy("q").orderBy(F.desc("score"), "leaf")
        found = indexed.mapInArrow(truth, "q int, leaf int, score double").withColumn("r", F.row_number().over(w)).where((F.col("r") <= k) & (F.col("score") > float("-inf"))).toPandas()
        place = {q: {leaf: i + 1 for i, leaf in enumerate(tree.visit(np.append(pv[q], 0.0), tree.leaves))} for q in range(len(pid))}
        needed = np.sort([place[q][leaf] for q, leaf in zip(found["q"], found["leaf"], strict=True)])
        if len(needed):
            visits = int(needed[min(len(needed) - 1, int(np.ceil(recall * len(needed))) - 1)])

    blocks = {leaf: -(-n // BLOCK) for leaf, n in sizes.items()}

    early = max(1, visits // 8)

    def walk(first: bool):
        def run(source):
            for batch in source:
                rep, m = batch.column(0).to_pylist(), matrix(batch.column(1))
                rows_, leaves_, block = [], [], []
                for i in range(len(rep)):
                    order = tree.visit(np.append(m[i], 0.0), visits)
                    if sum(sizes.get(leaf, 0) for leaf in order) < k + 2:  # too few rows in them: widen to all
                        order = tree.visit(np.append(m[i], 0.0), tree.leaves)
                    for leaf in order[:early] if first else order[early:]:
                        for b in range(blocks.get(leaf, 0)):
                            rows_.append(i), leaves_.append(leaf), block.append(b)
                take = pa.array(rows_, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(take), pa.array(leaves_, pa.int32()), pa.array(block, pa.int32()), batch.column(1).take(take), batch.column(2).take(take)], names=["q", "leaf", "block", "qv", "least"])

        return run

    def place_rows(source):
        for batch in source:
            rep, leaf = batch.column(0).to_numpy(), batch.column(1).to_numpy()
            n = np.array([blocks[x] for x in leaf.tolist()], np.uint64) if len(leaf) else np.zeros(0, np.uint64)
            b = (mix64(rep.astype(np.int64).view(np.uint64)) % n).astype(np.int32) if len(leaf) else np.zeros(0, np.int32)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(b)], names=["rep", "leaf", "v", "block"])

    def block_best(left: pa.Table, right: pa.Table) -> pa.Table:
        schema = pa.schema([("q", pa.int64()), ("rep", pa.int64()), ("score", pa.float64())])
        if not left.num_rows or not right.num_rows:
            return schema.empty_table()
        rep = right.column("rep").to_numpy()
        order = np.argsort(rep, kind="stable")
        rep, m = rep[order], matrix(right.column("v"))[order]
        q, qv = left.column("q").to_numpy(), matrix(left.column("qv"))
        bound = left.column("least").to_numpy()
        bound = bound - 1e-9 * (1 + np.abs(bound))
        bound[~np.isfinite(bound)] = -np.inf
        outs = []
        for a in range(0, len(q), 1024):
            s = qv[a : a + 1024] @ m.T
            # a hair below the bound: products are summed in another order here
            best = [x[r[x] >= e] for x, r, e in zip(top_rows(s, rep, k + 4), s, bound[a : a + 1024], strict=True)]
            who = np.repeat(np.arange(len(best)), [len(b) for b in best])
            at = np.concatenate(best).astype(np.int64)
            exact = (qv[a + who] * m[at]).sum(1)  # one order of summation, whatever the block
            outs.append(pa.table([pa.array(q[a + who]), pa.array(rep[at]), pa.array(exact)], schema=schema))
        return pa.concat_tables(outs)

    held = indexed.mapInArrow(place_rows, "rep long, leaf int, v array<double>, block int")

    def search(asked: DataFrame, first: bool) -> DataFrame:
        went = asked.mapInArrow(walk(first), "q long, leaf int, block int, qv array<double>, least double")
        return went.groupBy("leaf", "block").cogroup(held.groupBy("leaf", "block")).applyInArrow(block_best, "q long, rep long, score double")

    def best(rows: DataFrame) -> DataFrame:
        w = Window.partitionBy("q").orderBy(F.desc("score"), "rep")
        return rows.withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("q", "rep", "score", "r")

    asked = distinct.where("asked = 1").select("rep", "v")
    start = keep(best(search(asked.withColumn("least", F.lit(float("-inf"))), True)))
    bounds = start.where(F.col("r") == k + 1).select(F.col("q").alias("rep"), F.col("score").alias("least"))
    later = asked.join(bounds, "rep", "left").select("rep", "v", F.coalesce("least", F.lit(float("-inf"))).alias("least"))
    near = best(start.drop("r").unionByName(search(later, False))).drop("r")

    # back to rows: of equal vectors the first k + 1 ids at most can be wanted
    ids = v.join(distinct.select("v", "rep"), "v").select("rep", "vec_id")
    first = ids.withColumn("r", F.row_number().over(Window.partitionBy("rep").orderBy("vec_id"))).where(F.col("r") <= k + 1).select("rep", "vec_id")
    asking = ids.where(is_query).select(F.col("rep").alias("q"), F.col("vec_id").alias("query_id"))
    # the k + 1 best rows of each distinct query first, then its queries: a vector that many rows share adds k + 1 rows for each
    w = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id")
    wide = near.join(first, "rep").withColumn("r", F.row_number().over(w)).where(F.col("r") <= k + 1).select("q", "vec_id", "score")
    full = wide.join(asking, "q").where("vec_id <> query_id")
    w = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return full.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
