"""Policies against baselines on a holdout that shares nothing with training: trials, votes, bounds and the gate."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import coin, content_id, fixed, rank_code, unordered_id
from ..functions.numeric import js_round, share, wilson_lower
from .contracts import CHOICES, broken

LEARNED, ENSEMBLE = "learned", "ensemble"
BASELINES = ("zero", "centroid", "ensemble")
POLICIES = (*BASELINES, LEARNED)
HAZARDS = ("active-content", "clipped", "detached", "empty", "filtered", "masked", "text-only", "unstable-signals")


def overlaps(cases: DataFrame, training: DataFrame, source: str = "source_id", family: str = "family", group: str = "group") -> DataFrame:
    """Holdout cases that share a source, a family or a family's group with training: kind and n. All have to be 0."""
    whole = F.concat_ws("/", family, group)
    kinds = (("source", F.col(source)), ("family", F.col(family)), ("group", whole))
    out = []
    for kind, key in kinds:
        seen = training.select(key.cast("string").alias("_key")).distinct()
        hit = cases.withColumn("_key", key.cast("string")).join(seen, "_key", "left_semi")
        out.append(hit.agg(F.count(F.lit(1)).alias("n")).select(F.lit(kind).alias("kind"), "n"))
    return reduce(DataFrame.unionByName, out)


def case_rules(outputs: Column) -> Column:
    """outputs: map of policy to struct(status, percent). Exactly the four policies; learned may not answer where the ensemble abstains."""
    return broken(
        ("policies", F.array_sort(F.map_keys(outputs)) == F.array(*[F.lit(p) for p in sorted(POLICIES)])),
        ("learned-overreach", ~((outputs[ENSEMBLE]["status"] == "ABSTAIN") & (outputs[LEARNED]["status"] == "VALUE"))),
    )


def missing_hazards(hazards: DataFrame) -> DataFrame:
    """Required kinds that don't occur exactly once."""
    want = hazards.sparkSession.createDataFrame([(h,) for h in HAZARDS], "kind string")
    return want.join(hazards.groupBy("kind").count(), "kind", "left").where("coalesce(count, 0) <> 1").select("kind")


def long_outputs(cases: DataFrame, keys: list[str]) -> DataFrame:
    """One row a case and policy: status and percent."""
    return cases.select(*keys, F.explode("outputs").alias("policy", "o")).select(*keys, "policy", "o.status", "o.percent")


def trials(cases: DataFrame, keys: list[str], case: str = "case_id", seed: str = "panel") -> DataFrame:
    """One row a case and baseline where both it and the learned policy give different values.

    The learned value is shown as A unless the trial's coin says otherwise. Outputs are one map a case, so no join is needed.
    """
    o = F.col("outputs")
    rows = cases.select(*keys, o, F.explode(F.array(*map(F.lit, BASELINES))).alias("baseline"))
    mine, other = o[LEARNED], o[F.col("baseline")]
    rows = rows.select(*keys, "baseline", mine["percent"].alias("learned_percent"), other["percent"].alias("other_percent"), (mine["status"] == "VALUE").alias("_m"), (other["status"] == "VALUE").alias("_o")).where("_m AND _o AND learned_percent <> other_percent")
    ident = unordered_id("trial", F.concat_ws(":", case, "baseline"), fixed(F.col("learned_percent")), fixed(F.col("other_percent")))
    return rows.drop("_m", "_o").withColumn("trial_id", ident).withColumn("flipped", coin(seed, F.col("trial_id")))


def range_bounds(rows: DataFrame, key: str, parts: int, each: int = 64) -> list[str]:
    """At most parts - 1 values of a text column that cut its order into parts of about as many rows.

    They come of the parts * each rows with the least hashes of the key: a sample of all rows of a fixed size, found in one pass.
    """
    least = rows.select(key).where(F.col(key).isNotNull()).orderBy(F.xxhash64(key)).limit(parts * each)
    held = sorted(r[0] for r in least.collect())
    return sorted({held[len(held) * i // parts] for i in range(1, parts)}) if held else []


def part_of(key: Column, bounds: list[str]) -> Column:
    """How many bounds a value reaches, by halving: the same value has the same part wherever and however often it is computed."""

    def between(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        middle = (low + high) // 2
        return F.when(key >= bounds[middle], between(middle + 1, high)).otherwise(between(low, middle))

    return between(0, len(bounds))


def ranked(rows: DataFrame, key: str, rank: str, parts: int | None = None) -> DataFrame:
    """Rows with their place, from 1, in the order of a text column; equal values are placed in any order, null comes first.

    Bounds are fixed once, as data. What lies before a part (counted without moving rows) and the place inside it (a window
    over the part alone) both follow from them, so that places stay whole whichever rows a later step reads or writes again.
    """
    parts = parts or max(2, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    part = rows.withColumn("_p", part_of(F.col(key), range_bounds(rows, key, parts)))
    counts = {r["_p"]: r["n"] for r in part.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a part
    before, upto = [], 0
    for p in range(max(counts, default=0) + 1):
        before.append(upto)
        upto += counts.get(p, 0)
    within = F.row_number().over(Window.partitionBy("_p").orderBy(key))
    return part.withColumn(rank, within + F.get(F.array(*[F.lit(b).cast("long") for b in before]), F.col("_p"))).drop("_p")


def participants(rows: DataFrame) -> DataFrame:
    """Opaque numbers in order of trial id, for the blinded view."""
    return ranked(rows, "trial_id", "_r").withColumn("participant_id", rank_code(F.col("_r"))).drop("_r")


def blinded(rows: DataFrame) -> DataFrame:
    """What a participant may see: no policy, no value, no id of content."""
    return rows.select("participant_id", F.sha2(F.concat_ws("|", F.lit("image"), "trial_id", F.lit("A")), 256).alias("image_a"), F.sha2(F.concat_ws("|", F.lit("image"), "trial_id", F.lit("B")), 256).alias("image_b"))


def counted(votes: DataFrame, case: str = "case_id") -> DataFrame:
    """One row a case: how many raters it has, and choices (an array of choice and n); a rater votes once on a case.

    All trials of a case have its votes alike, so that what is counted of them needs no row a vote and trial.
    """
    n = lambda c: F.struct(F.lit(c).alias("choice"), F.count(F.when(F.col("choice") == c, 1)).alias("n"))
    return votes.groupBy(case).agg(F.count("rater").alias("raters"), F.array(*map(n, CHOICES)).alias("choices"))


def judged(rows: DataFrame, votes: DataFrame, case: str = "case_id") -> DataFrame:
    """Each vote on a case counts for each of its trials: result is win, loss, tie or abstain of the learned policy.

    votes are rows of votes, or counted() ones: then a row is a trial's result and n says how often it was given. Either side
    grows with the data: they meet in a shuffle, and neither goes through the driver.
    """
    j = rows.hint("merge").join(votes, case)
    if "choices" in votes.columns:
        j = j.select("*", F.inline("choices")).drop("choices").where("n > 0")
    won = (F.col("choice") == "A") != F.col("flipped")
    return j.withColumn("result", F.when(F.col("choice").isin("A", "B"), F.when(won, "win").otherwise("loss")).otherwise(F.lower("choice")))


def _times(results: DataFrame, where: Column) -> Column:
    """How many votes a condition holds for: n a row where votes were counted before, else one a row."""
    return F.coalesce(F.sum(F.when(where, F.col("n"))), F.lit(0)) if "n" in results.columns else F.count(F.when(where, 1))


def head_to_head(results: DataFrame, keys: list[str]) -> DataFrame:
    n = lambda r: _times(results, F.col("result") == r)
    agg = results.groupBy(*keys).agg(n("win").alias("wins"), n("loss").alias("losses"), n("tie").alias("ties"), n("abstain").alias("cannot_judge"))
    decisive = F.col("wins") + F.col("losses")
    return agg.withColumn("decisive", decisive).withColumn("win_rate", js_round(share(F.col("wins"), F.col("decisive")), 8)).withColumn("wilson_lower", js_round(wilson_lower(F.col("wins"), F.col("decisive")), 8))


def family_macro(results: DataFrame, family: str = "family") -> DataFrame:
    """baseline, represented_families and the unweighted mean of their win rates."""
    per = head_to_head(results, ["baseline", family]).where("decisive > 0").withColumn("rate", share(F.col("wins"), F.col("decisive")))
    return per.groupBy("baseline").agg(F.count(F.lit(1)).alias("represented_families"), js_round(F.sum("rate") / F.count(F.lit(1)), 8).alias("family_macro"))


def sources_with(results: DataFrame, source: str = "case_id", least: int = 5) -> DataFrame:
    """baseline and how many sources have `least` decisive votes or more."""
    per = results.where("result IN ('win', 'loss')").groupBy("baseline", source).agg(_times(results, F.lit(True)).alias("_n"))
    return per.groupBy("baseline").agg(F.count(F.when(F.col("_n") >= least, 1)).alias("sources"))


def policy_coverage(cases: DataFrame) -> DataFrame:
    per = long_outputs(cases, []).groupBy("policy").agg(F.count(F.when(F.col("status") == "VALUE", 1)).alias("value_cases"), F.count(F.when(F.col("status") == "ABSTAIN", 1)).alias("abstain_cases"))
    return per.withColumn("coverage", js_round(share(F.col("value_cases"), F.col("value_cases") + F.col("abstain_cases")), 8))


def distinct_outputs(cases: DataFrame, rows: DataFrame, case: str = "case_id") -> DataFrame:
    """baseline, cases with a trial, and cases where both give the same value."""
    o = F.col("outputs")
    both = cases.select(case, F.explode(F.array(*map(F.lit, BASELINES))).alias("baseline"), o).where((o[LEARNED]["status"] == "VALUE") & (o[F.col("baseline")]["status"] == "VALUE")).groupBy("baseline").agg(F.countDistinct(case).alias("both"))
    have = rows.groupBy("baseline").agg(F.countDistinct(case).alias("distinct_cases"))
    return both.join(have, "baseline", "left").select("baseline", F.coalesce("distinct_cases", F.lit(0)).alias("distinct_cases"), (F.col("both") - F.coalesce("distinct_cases", F.lit(0))).alias("identical_cases"))


def hazard_failures(hazards: DataFrame) -> DataFrame:
    """Hazards whose outcome isn't the expected one."""
    return hazards.where(~(F.col("expected_status").eqNullSafe(F.col("status")) & F.col("expected_reason").eqNullSafe(F.col("reason"))))


def gate(evidence: DataFrame, head: DataFrame, macro: DataFrame, sources: DataFrame, coverage: DataFrame, failures: DataFrame) -> DataFrame:
    """One row a gate: code, kind (evidence or preference), passed.

    evidence: one row source_count, family_count, group_count, raters_per_pair. All inputs are a few aggregated rows.
    """
    e = evidence.select(F.explode(F.array(*[
        F.struct(F.lit(code).alias("code"), F.lit("evidence").alias("kind"), F.coalesce(F.col(col) >= least, F.lit(False)).alias("passed"))
        for code, col, least in (("at-least-40-holdout-sources", "source_count", 40), ("at-least-6-holdout-families", "family_count", 6), ("at-least-8-holdout-groups", "group_count", 8), ("at-least-5-raters-per-distinct-pair", "raters_per_pair", 5))
    ])).alias("g")).select("g.*")
    base = evidence.sparkSession.createDataFrame([(b,) for b in BASELINES], "baseline string")
    per = base.join(head, "baseline", "left").join(macro, "baseline", "left").join(sources, "baseline", "left")
    rules = (
        ("at-least-120-decisive-votes", "evidence", F.col("decisive") >= 120), ("at-least-40-sources-with-5-decisive-votes", "evidence", F.col("sources") >= 40), ("at-least-5-families", "evidence", F.col("represented_families") >= 5),
        ("win-rate-over-half", "preference", F.col("win_rate") > 0.5), ("wilson-lower-over-half", "preference", F.col("wilson_lower") > 0.5), ("family-macro-over-half", "preference", F.col("family_macro") > 0.5),
    )
    p = per.select("baseline", F.explode(F.array(*[F.struct(F.lit(c).alias("code"), F.lit(k).alias("kind"), F.coalesce(ok, F.lit(False)).alias("passed")) for c, k, ok in rules])).alias("g")).select(F.concat_ws("-", "baseline", "g.code").alias("code"), "g.kind", "g.passed")
    cov = coverage.agg(F.max(F.when(F.col("policy") == LEARNED, F.col("coverage"))).alias("l"), F.max(F.when(F.col("policy") == ENSEMBLE, F.col("coverage"))).alias("e"))
    c = cov.select(F.lit("learned-coverage-not-below-ensemble").alias("code"), F.lit("preference").alias("kind"), F.coalesce(F.col("l") >= F.col("e"), F.lit(False)).alias("passed"))
    h = failures.agg(F.count(F.lit(1)).alias("n")).select(F.lit("hazard-suite-pass").alias("code"), F.lit("preference").alias("kind"), (F.col("n") == 0).alias("passed"))
    return e.unionByName(p).unionByName(c).unionByName(h)


def gate_status(gates: DataFrame) -> DataFrame:
    """A failed evidence gate outweighs the rest."""
    s = gates.agg(F.bool_and(F.when(F.col("kind") == "evidence", F.col("passed"))).alias("evidence"), F.bool_and("passed").alias("everything"), F.count(F.when(~F.col("passed"), 1)).alias("failed"))
    return s.select(F.when(~F.col("evidence"), "UNDERPOWERED").when(~F.col("everything"), "BASELINE_NOT_BEATEN").otherwise("PROMISING").alias("status"), "failed")


def case_id(*fields: Column) -> Column:
    return content_id("case", *fields)


def completeness(expected: DataFrame, answered: DataFrame, keys: list[str]) -> DataFrame:
    """Per rater: answered, missing, unknown and repeated trials. keys: [rater, trial].

    expected holds each rater's trials, answered the answers; both are counted by key first, so repeats don't multiply.
    """
    e = expected.select(*keys).distinct().withColumn("_e", F.lit(1))
    a = answered.groupBy(*keys).agg(F.count(F.lit(1)).alias("_a"))
    j = e.join(a, keys, "full_outer")
    return j.groupBy(keys[0]).agg(
        F.count(F.when(F.col("_e").isNotNull() & F.col("_a").isNotNull(), 1)).alias("answered"), F.count(F.when(F.col("_a").isNull(), 1)).alias("missing"),
        F.count(F.when(F.col("_e").isNull(), 1)).alias("unknown"), F.count(F.when(F.col("_a") > 1, 1)).alias("repeated"),
    )
