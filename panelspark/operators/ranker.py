"""A transparent pairwise ranker: features, gradient descent, out-of-fold scores, losses, risk against coverage, promotion."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, StructField, StructType

from ..functions.numeric import dot, js_round, share, sigmoid

SCALE = 5.0
# A gradient near a point: the logistic function's Taylor series converges within pi of any real number, so terms beyond
# ORDER are below (RADIUS / pi) ** (ORDER + 1) = 4e-13. Moments go by exponents of three features.
ORDER, RADIUS = 20, 0.8
EXPONENTS = np.array([(a, b, n - a - b) for n in range(1, ORDER + 2) for a in range(n + 1) for b in range(n + 1 - a)])
DEGREES = [np.flatnonzero(EXPONENTS.sum(1) == n) for n in range(1, ORDER + 2)]
LOWER = np.array([(a, b, n - a - b) for n in range(ORDER + 1) for a in range(n + 1) for b in range(n + 1 - a)])
WAYS = np.array([float(math.factorial(sum(e)) // math.prod(map(math.factorial, e))) for e in LOWER.tolist()])
_AT = {tuple(e): i for i, e in enumerate(EXPONENTS.tolist())}
RAISED = [np.array([_AT[tuple(e)] for e in (LOWER + np.eye(3, dtype=int)[i]).tolist()]) for i in range(3)]
BASELINES = {"zero": (1.0, 0.0, 0.0), "centroid": (1.0, 1.0, 0.0)}


def candidate_features(value: Column, proposal: Column) -> Column:
    q, r = value / SCALE, proposal / SCALE
    return F.array(-q * q, 2 * q * r, -F.abs(q))


def feature_difference(left: Column, right: Column, proposal: Column) -> Column:
    """Features of the first candidate less those of the second."""
    return F.zip_with(candidate_features(left, proposal), candidate_features(right, proposal), lambda a, b: a - b)


def prediction(weights: Column, x: Column) -> Column:
    """Chance that the first candidate is preferred."""
    return sigmoid(dot(weights, x))


def _powers(values: np.ndarray, most: int) -> np.ndarray:
    """Powers 0..most of three columns: [column, row, power]."""
    out = np.ones((3, len(values), most + 1))
    np.cumprod(np.broadcast_to(values.T[:, :, None], (3, len(values), most)), axis=2, out=out[:, :, 1:])
    return out


def _moments(source, places: np.ndarray, reach: np.ndarray):
    """A task's sums of w s_k(z) u^b for all |b| = k + 1 (k up to ORDER): s_k are the logistic function's Taylor terms at z = place . x, u is x / reach."""
    sums: dict[int, np.ndarray] = {}
    for batch in source:
        group, weight = batch.column(0).to_numpy(), batch.column(2).to_numpy()
        x = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, 3)
        z = np.einsum("ij,ij->i", places[group], x)
        e = np.exp(-np.abs(z))
        terms = [np.where(z >= 0, 1 / (1 + e), e / (1 + e))]
        for k in range(ORDER):  # from s' = s (1 - s)
            terms.append((terms[k] - sum(terms[i] * terms[k - i] for i in range(k + 1))) / (k + 1))
        power = _powers(x / reach[group], ORDER + 1)
        rows = {int(g): np.flatnonzero(group == g) for g in np.unique(group)}
        for k, at in enumerate(DEGREES):
            by = EXPONENTS[at]
            unit = power[0][:, by[:, 0]] * power[1][:, by[:, 1]] * power[2][:, by[:, 2]]
            scale = weight * terms[k]
            for g, r in rows.items():
                sums.setdefault(g, np.zeros(len(EXPONENTS)))[at] += scale[r] @ unit[r]
    for g, m in sums.items():
        n = len(m)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(n, g, np.int32)), pa.array(np.arange(n, dtype=np.int32)), pa.array(m)], names=["g", "i", "m"])


def _descend(moments: np.ndarray, v: np.ndarray, left: np.ndarray, pull: np.ndarray, total: np.ndarray, reach: np.ndarray, rate: float, ridge: float) -> None:
    """Steps of all groups, in place, on the gradients that moments at v give, as far as these hold."""
    start, near = v.copy(), [moments[:, i] for i in RAISED]
    while True:
        away = (v - start) * reach
        go = np.flatnonzero((np.abs(away).sum(1) <= RADIUS) & (left > 0))
        if not len(go):
            return
        power = _powers(away[go], ORDER)
        terms = power[0][:, LOWER[:, 0]] * power[1][:, LOWER[:, 1]] * power[2][:, LOWER[:, 2]] * WAYS
        gradient = np.stack([np.einsum("ij,ij->i", terms, n[go]) for n in near], axis=1) * reach[go] - pull[go]
        v[go] -= rate * (gradient / total[go, None] + ridge * v[go])
        left[go] -= 1


def fit(examples: DataFrame, keys: list[str], iterations: int = 1500, rate: float = 0.15, ridge: float = 0.01, most_groups: int = 2000) -> DataFrame:
    """Weights of each group of keys by full-batch gradient descent from zero; null under 5 examples or without variance.

    examples: x array(3), target, weight. A pass over the examples sums, for each group, the moments that its gradient's Taylor
    series at the present weights needs (some 2,000 numbers, whatever the rows); from them follow all steps while no example's
    score moves by more than RADIUS, with gradients exact to 1e-12. Then comes the next pass, from the weights so reached. The further
    scores move the more passes there are (one for the votes by axis of sf0.01); each makes at least one step. Sums are combined in
    tasks before they are shuffled, so a group that holds most rows is spread over all of them.

    Fits at once, as later steps read the weights only; more than most_groups groups are refused. No examples, no rows; x must not be null.
    """
    spark = examples.sparkSession
    distinct = examples.groupBy(*keys, "x").agg(F.sum("weight").alias("w"), F.sum(F.col("weight") * F.col("target")).alias("wy"), F.count(F.lit(1)).alias("n")).persist(StorageLevel.DISK_ONLY)
    try:
        each = [F.get("x", F.lit(i)) for i in range(3)]
        varied = reduce(lambda a, b: a | b, [F.max(x) - F.min(x) >= 1e-12 for x in each])
        known = distinct.groupBy(*keys).agg(
            ((F.sum("n") >= 5) & varied & (F.sum("w") > 0)).alias("ok"), F.sum("w").alias("total"),
            F.array(*[F.sum(F.col("wy") * x) for x in each]).alias("pull"), F.array(*[F.max(F.abs(x)) for x in each]).alias("reach"),
        ).limit(most_groups + 1).collect()
        if len(known) > most_groups:
            raise ValueError(f"more than {most_groups} groups")
        known.sort(key=lambda r: not r["ok"])
        able = [r for r in known if r["ok"]]
        v, left = np.zeros((len(able), 3)), np.full(len(able), iterations)
        if able:
            total, pull, reach = (np.array([r[name] for r in able], float) for name in ("total", "pull", "reach"))
            reach[reach == 0] = 1.0
            names = [f"_{k}" for k in keys]
            numbers = StructType([StructField("g", IntegerType()), *(StructField(n, distinct.schema[k].dataType) for n, k in zip(names, keys, strict=True))])
            numbered = F.broadcast(spark.createDataFrame([(i, *(r[k] for k in keys)) for i, r in enumerate(able)], numbers))
            rows = distinct.join(numbered, reduce(lambda a, b: a & b, [distinct[k].eqNullSafe(numbered[n]) for n, k in zip(names, keys, strict=True)])).select("g", "x", "w")
            while (left > 0).any():
                sums = rows.mapInArrow(lambda source, at=v.copy(): _moments(source, at, reach), "g int, i int, m double").groupBy("g", "i").agg(F.sum("m").alias("m")).toArrow()
                moments = np.zeros((len(able), len(EXPONENTS)))
                moments[sums["g"].to_numpy(), sums["i"].to_numpy()] = sums["m"].to_numpy()
                _descend(moments, v, left, pull, total, reach, rate, ridge)
    finally:
        distinct.unpersist()
    found = [(*(r[k] for k in keys), v[i].tolist() if i < len(able) else None) for i, r in enumerate(known)]
    out = spark.createDataFrame(found, StructType([*(StructField(k, distinct.schema[k].dataType) for k in keys), StructField("v", ArrayType(DoubleType()))]))
    return out.select(*keys, F.transform("v", lambda x: js_round(x, 10)).alias("weights"))


def out_of_fold(pairs: DataFrame, assigned: DataFrame, mode: str, **options) -> DataFrame:
    """Held-out pairs with fold, target, weight and each model's prediction; learned is null where a fold's axis has no fit.

    assigned: unit and fold of the mode. A pair trains every fold but its own.
    """
    unit = F.col("family_no").cast("string") if mode == "family" else F.concat_ws("/", "family_no", "group_no")
    rows = pairs.where("eligible").withColumn("unit", unit).join(assigned.select("unit", "fold"), "unit")
    numbers = assigned.select(F.col("fold").alias("held")).distinct()
    models = fit(rows.join(F.broadcast(numbers), F.col("fold") != F.col("held")), ["held", "axis"], **options)  # at most ten folds
    scored = rows.join(F.broadcast(models), (rows["fold"] == models["held"]) & (rows["axis"] == models["axis"]), "left").drop(models["axis"])
    fixed = {name: prediction(F.array(*map(F.lit, w)), F.col("x")) for name, w in BASELINES.items()}
    return scored.select(*pairs.columns, "fold", F.lit(mode).alias("mode"), F.when(F.col("weights").isNotNull(), prediction(F.col("weights"), F.col("x"))).alias("learned"), *[p.alias(n) for n, p in fixed.items()])


def long_form(scored: DataFrame, keys: list[str], models: tuple[str, ...]) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("p")) for m in models])
    return scored.select(*keys, "target", "weight", F.explode(entries).alias("e")).select(*keys, "target", "weight", "e.model", "e.p").where("p IS NOT NULL")


def losses(long: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted log loss, Brier score and winner accuracy of each model. A prediction of exactly 0.5 isn't above a half."""
    p = F.least(F.lit(1 - 1e-12), F.greatest(F.lit(1e-12), F.col("p")))
    loss = -(F.col("target") * F.log(p) + (1 - F.col("target")) * F.log(1 - p))
    decided = F.col("target") != 0.5
    right = (p > 0.5) == (F.col("target") > 0.5)
    agg = long.groupBy(*keys, "model").agg(
        F.count(F.lit(1)).alias("eligible_pairs"), F.count(F.when(decided, 1)).alias("winner_pairs"), F.sum("weight").alias("_w"), F.sum(F.col("weight") * loss).alias("_l"), F.sum(F.col("weight") * F.pow(p - F.col("target"), 2)).alias("_b"),
        F.sum(F.when(decided, F.col("weight"))).alias("_d"), F.sum(F.when(decided & right, F.col("weight")).otherwise(F.when(decided, 0.0))).alias("_c"),
    )
    return agg.select(*keys, "model", "eligible_pairs", "winner_pairs", share(F.col("_c"), F.col("_d")).alias("winner_accuracy"), share(F.col("_l"), F.col("_w")).alias("log_loss"), share(F.col("_b"), F.col("_w")).alias("brier"))


def risk_coverage(long: DataFrame, keys: list[str], thresholds: tuple[float, ...] = (0.5, 0.6, 0.7, 0.8, 0.9)) -> DataFrame:
    """For each threshold of confidence, the share of winners' weight that is covered and the error among it."""
    at = long.where("target <> 0.5").select("*", F.explode(F.array(*map(F.lit, thresholds))).alias("threshold"))
    taken = F.greatest("p", 1 - F.col("p")) >= F.col("threshold")
    right = (F.col("p") > 0.5) == (F.col("target") > 0.5)
    agg = at.groupBy(*keys, "model", "threshold").agg(F.sum("weight").alias("_w"), F.sum(F.when(taken, F.col("weight")).otherwise(0.0)).alias("_t"), F.sum(F.when(taken & right, F.col("weight")).otherwise(0.0)).alias("_c"))
    return agg.select(*keys, "model", "threshold", share(F.col("_t"), F.col("_w")).alias("coverage"), (1 - share(F.col("_c"), F.when(F.col("_t") > 0, F.col("_t")))).alias("risk"))


def promotion(metrics: DataFrame, coverage: DataFrame, families: DataFrame) -> DataFrame:
    """One row: whether the learned model beats both baselines out of fold, with full coverage and families enough.

    metrics: losses() of one mode; coverage: one row evaluation_coverage; families: one row eligible_family_count.
    """
    m = metrics.groupBy().pivot("model", ["learned", *BASELINES]).agg(F.first("winner_accuracy").alias("acc"), F.first("log_loss").alias("loss"), F.first("winner_pairs").alias("winners"), F.first("eligible_pairs").alias("n"))
    ok = (
        (F.col("learned_winners") >= 10) & (F.col("evaluation_coverage") == 1) & (F.col("learned_n") == F.col("zero_n")) & (F.col("learned_n") == F.col("centroid_n"))
        & (F.col("learned_acc") > F.greatest(F.coalesce("zero_acc", F.lit(0.0)), F.coalesce("centroid_acc", F.lit(0.0)))) & (F.col("learned_loss") < F.least(F.coalesce("zero_loss", F.lit(float("inf"))), F.coalesce("centroid_loss", F.lit(float("inf")))))
        & (F.col("eligible_family_count") >= 5)
    )
    beats = F.coalesce(ok, F.lit(False))
    return m.crossJoin(coverage).crossJoin(families).select(beats.alias("recommended"), F.when(beats, "PROMISING").otherwise("BASELINE_NOT_BEATEN").alias("status"))  # one row each
