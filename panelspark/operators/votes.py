"""From votes to canonical pairs: relabelling, panel outcome, weights, agreement, statistics, readiness and folds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.numeric import choose2, js_round, share

VOTES = ("candidate1", "candidate2", "tie", "abstain")


def canonical_vote(choice: Column, a: Column, b: Column, a_id: Column | None = None, b_id: Column | None = None) -> Column:
    """The choice relative to the pair in value order (ties of value by id), whichever way it was shown."""
    a_id, b_id = (a_id, b_id) if a_id is not None else (a.cast("string"), b.cast("string"))
    a_first = F.struct(a.alias("v"), a_id.alias("i")) <= F.struct(b.alias("v"), b_id.alias("i"))
    return F.when(choice.isin("A", "B"), F.when((choice == "A") == a_first, "candidate1").otherwise("candidate2")).otherwise(F.lower(choice))


def duplicates(votes: DataFrame, keys: list[str]) -> DataFrame:
    return votes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_votes")).where("n_votes > 1")


def first_per(df: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """The first row of each key; ranks are limited before the shuffle too."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def pair_votes(votes: DataFrame, keys: list[str], min_raters: int = 3) -> DataFrame:
    """One row a pair: vote counts, decisive, total, status, winner, majority_share, eligible, target.

    Counting combines on the map side, so a pair that holds a third of all votes is no hot task.
    """
    counts = votes.groupBy(*keys).agg(*[F.count(F.when(F.col("vote") == v, 1)).alias(v) for v in VOTES])
    decisive = F.col("candidate1") + F.col("candidate2")
    out = counts.withColumn("decisive", decisive).withColumn("total", decisive + F.col("tie") + F.col("abstain"))
    enough = F.col("decisive") >= min_raters
    winner = F.when(enough & (F.col("candidate1") > F.col("candidate2")), "candidate1").when(enough & (F.col("candidate1") < F.col("candidate2")), "candidate2")
    return out.select(
        *keys, *VOTES, "decisive", "total",
        F.when(~enough, "UNDERPOWERED").when(winner.isNotNull(), "WINNER").otherwise("UNRESOLVED").alias("status"), winner.alias("winner"),
        js_round(share(F.greatest("candidate1", "candidate2"), F.col("decisive")), 8).alias("majority_share"), enough.alias("eligible"),
        F.when(enough, js_round(share(F.col("candidate1"), F.col("decisive")), 8)).alias("target"),
    )


def sample_weights(pairs: DataFrame, source: str = "source_no", axis: str = "axis") -> DataFrame:
    """Eligible pairs share a weight of 1 within each source and axis, by their decisive votes.

    Sums by (source, axis) are joined back, which has a map-side combine; the window form would gather a source's pairs.
    """
    totals = pairs.where("eligible").groupBy(source, axis).agg(F.sum("decisive").alias("_of"))
    joined = pairs.join(totals, [source, axis], "left")
    return joined.withColumn("weight", F.when(F.col("eligible"), js_round(share(F.col("decisive"), F.col("_of")), 10)).otherwise(0.0)).drop("_of")


def weight_errors(weighted: DataFrame, source: str = "source_no", axis: str = "axis") -> DataFrame:
    """Sources and axes whose eligible weights don't sum to 1."""
    return weighted.where("eligible").groupBy(source, axis).agg(F.sum("weight").alias("weight_sum")).where(F.abs(F.col("weight_sum") - 1) > 1e-8)


def agreement(pairs: DataFrame, categories: tuple[str, ...]) -> DataFrame:
    """observed, expected, chance_corrected and rated_pairs over all pairs.

    Observed agreement pools rater pairs of pairs with two votes at least; expected counts every vote.
    """
    n = sum((F.col(c) for c in categories[1:]), F.col(categories[0]))
    agg = pairs.agg(
        F.sum(F.when(n >= 2, sum((choose2(F.col(c)) for c in categories[1:]), choose2(F.col(categories[0]))))).alias("same"), F.sum(F.when(n >= 2, choose2(n))).alias("all"),
        F.count(F.when(n >= 2, 1)).alias("rated_pairs"), *[F.sum(c).alias(c) for c in categories],
    )
    total = sum((F.col(c) for c in categories[1:]), F.col(categories[0]))
    observed = share(F.col("same"), F.col("all"))
    expected = sum((F.pow(share(F.col(c), total), 2) for c in categories[1:]), F.pow(share(F.col(categories[0]), total), 2))
    corrected = F.when(F.col("e") != 1, (F.col("o") - F.col("e")) / F.when(F.col("e") != 1, 1 - F.col("e")))
    return agg.select(observed.alias("o"), expected.alias("e"), "rated_pairs").select(js_round(F.col("o"), 8).alias("observed"), js_round(F.col("e"), 8).alias("expected"), js_round(corrected, 8).alias("chance_corrected"), "rated_pairs")


def corpus_stats(pairs: DataFrame) -> DataFrame:
    """One row of counts over weighted pairs with source_no, family_no and group_no."""
    group = F.concat_ws("/", "family_no", "group_no")
    return pairs.agg(
        F.sum("total").alias("row_count"), F.countDistinct("source_no").alias("source_count"), F.countDistinct("family_no").alias("family_count"), F.countDistinct(group).alias("group_count"),
        F.countDistinct(F.when(F.col("eligible"), F.col("family_no"))).alias("eligible_family_count"), F.countDistinct(F.when(F.col("eligible"), group)).alias("eligible_group_count"),
        F.count(F.lit(1)).alias("pair_count"), F.count(F.when(F.col("eligible"), 1)).alias("eligible_pairs"), F.sum("tie").alias("tie_votes"), F.sum("abstain").alias("abstain_votes"),
    )


def contributors(pairs: DataFrame) -> DataFrame:
    """Sorted distinct sources, families and groups of eligible pairs, as one row of arrays."""
    e = pairs.where("eligible")
    return e.agg(F.array_sort(F.collect_set("source_no")).alias("sources"), F.array_sort(F.collect_set("family_no")).alias("families"), F.array_sort(F.collect_set(F.concat_ws("/", "family_no", "group_no"))).alias("groups"))


def readiness(stats: DataFrame, folds: int = 5, least_families: int = 4, least_groups: int = 4, least_pairs: int = 20) -> DataFrame:
    """status, and reasons in their fixed order."""
    rules = (
        ("fewer-than-4-eligible-families", F.col("eligible_family_count") < least_families), ("fewer-than-4-eligible-groups", F.col("eligible_group_count") < least_groups), ("fewer-than-20-eligible-pairs", F.col("eligible_pairs") < least_pairs),
        ("family-holdout-unavailable", F.least(F.lit(folds), "eligible_family_count") < 2), ("group-holdout-unavailable", F.least(F.lit(folds), "eligible_group_count") < 2),
    )
    reasons = F.filter(F.array(*[F.when(bad, F.lit(code)) for code, bad in rules]), lambda c: c.isNotNull())
    return stats.select(F.when(F.size(reasons) > 0, "UNDERPOWERED").otherwise("READY").alias("status"), F.array_join(reasons, ",").alias("reasons"))


def assign_folds(pairs: DataFrame, mode: str, folds: int = 5, seed: str = "panel") -> DataFrame:
    """unit, weight, fold, effective_folds, status: the heaviest unit goes to the lightest fold, ties by a seeded hash.

    Units are families or groups, a dimension far smaller than the votes; the greedy pass is one fold over their array.
    """
    unit = F.col("family_no").cast("string") if mode == "family" else F.concat_ws("/", "family_no", "group_no")
    units = pairs.where("eligible").groupBy(unit.alias("unit")).agg(F.sum("weight").alias("weight"))
    # weights are sums of numbers of 10 digits: rounding them makes the order of summation irrelevant to ties
    units = units.select("unit", F.round("weight", 9).alias("weight"), F.sha2(F.concat(F.lit(f"{seed}:{mode}:"), "unit"), 256).alias("tie"))
    listed = units.agg(F.array_sort(F.collect_list(F.struct((-F.col("weight")).alias("w"), F.col("tie"), F.col("unit")))).alias("units"))
    k = F.least(F.lit(folds), F.size("units"))
    start = F.struct(F.transform(F.sequence(F.lit(1), F.greatest(k, F.lit(1))), lambda _: F.lit(0.0)).alias("load"), F.array().cast("array<int>").alias("fold"))

    def place(state, u):
        least = F.array_position(state["load"], F.array_min(state["load"])).cast("int") - 1
        return F.struct(F.transform(state["load"], lambda v, i: F.when(i == least, v - u["w"]).otherwise(v)).alias("load"), F.concat(state["fold"], F.array(least)).alias("fold"))

    placed = listed.select("units", k.alias("k"), F.aggregate("units", start, place)["fold"].alias("folds"))
    rows = placed.where("k >= 2").select(F.posexplode("units").alias("i", "u"), "folds", "k", F.size("units").alias("n"))
    return rows.select(F.col("u.unit").alias("unit"), (-F.col("u.w")).alias("weight"), F.get("folds", F.col("i")).alias("fold"), F.col("k").alias("effective_folds"), F.when(F.col("n") >= folds, "READY").otherwise("LIMITED").alias("status"))
