"""Every registered query of the preference engine, over whole tables."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.lineage import fixed, has_key, key_violations
from ..functions.numeric import js_round, r6
from ..operators import adaptive, chain, contracts, coverage, decide, holdout, markup, ranker, raster, votes
from ..streaming import trials as live
from . import facts

STRUCTURE = 64  # dense rasters: a higher threshold than a drawing's, so that bounds and components say something
REGISTRY: dict = {}


def query(f):
    REGISTRY[f.__name__] = f
    return f


# --- contracts and lineage


@query
def contract_violations(spark: SparkSession, d: str) -> DataFrame:
    return contracts.violation_counts(facts.raw_votes(spark, d), facts.violations())


@query
def closed_schema(spark, d):
    unknown, missing = key_violations(F.col("props"), ["k"])
    return facts.table(spark, d, "events").select(F.size(unknown).alias("unknown"), F.size(missing).alias("missing")).groupBy("unknown", "missing").agg(F.count(F.lit(1)).alias("n"))


@query
def forbidden_keys(spark, d):
    e = facts.table(spark, d, "events")
    return reduce(DataFrame.unionByName, [e.agg(F.count(F.when(has_key(F.col("props"), k), 1)).alias("n")).select(F.lit(k).alias("name"), "n") for k in ("k", "raterId", "approved", "accuracy")])


@query
def content_ids(spark, d):
    t = facts.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("content_id"))
    return t.groupBy("content_id").agg(F.count(F.lit(1)).alias("n_docs"), F.min("doc_id").alias("first_doc"))


@query
def fd_conflicts(spark, d):
    v, p = facts.raw_votes(spark, d), facts.all_cases(spark, d)
    return reduce(DataFrame.unionByName, [contracts.dependency_conflicts(v, "k", "source_no"), contracts.dependency_conflicts(v, "source_no", "family_no"), contracts.dependency_conflicts(p, "family", "group")])


@query
def artifact_revalidation(spark, d):
    stored = facts.pairs(spark, d).select("k", "candidate1", "candidate2", "tie", "abstain")
    tampered = stored.withColumn("tie", F.when(F.col("k") % 10 == 3, F.col("tie") + 1).otherwise(F.col("tie")))
    return contracts.differences(tampered, stored).groupBy("side").agg(F.count(F.lit(1)).alias("n"))


ARTIFACTS = ["votes", "pairs", "weights", "folds", "ranker", "losses"]


def _artifact_levels(spark, d):
    """Each kind's digest as recorded and, in "other", with one field of some rows edited."""
    c, text = F.col, chain.row_text
    w = facts.weighted(spark, d)
    edit = lambda field, where: F.when(where, field + 1).otherwise(field)
    ranks = [fixed(F.get("weights", F.lit(i)), 3).cast("long") for i in range(3)]
    told = ranker.losses(_baselines_long(spark, d), [])
    fields = {
        "votes": (facts.unique_votes(spark, d), [c("user_id"), c("k")], c("vote"), F.when(c("user_id") % 50 == 7, "tie").otherwise(c("vote"))),
        "pairs": (w, [c("k"), c("candidate1"), c("candidate2"), c("abstain")], c("tie"), edit(c("tie"), c("k") % 10 == 3)),
        "weights": (w, [c("k")], fixed(c("weight"), 6), edit(fixed(c("weight"), 6).cast("long"), c("k") % 10 == 4)),
        "folds": (votes.assign_folds(w, "family"), [c("unit")], c("fold"), edit(c("fold"), c("unit") == "0")),
        "ranker": (ranker.fit(w.where("eligible"), ["axis"]), [c("axis"), *ranks[:2]], ranks[2], edit(ranks[2], c("axis") == "x")),
        "losses": (told, [c("model"), c("eligible_pairs"), fixed(c("winner_accuracy"), 4)], c("winner_pairs"), edit(c("winner_pairs"), c("model") == "zero")),
    }
    return chain.union([chain.level(kind, i, fields[kind][0], own=text(*fields[kind][1], fields[kind][2]), other=text(*fields[kind][1], fields[kind][3])) for i, kind in enumerate(ARTIFACTS)])


@query
def artifact_chain(spark, d):
    """Six kinds of artifacts, made of each other; in turn one field of each is edited, and the chain names the level."""
    rows = _artifact_levels(spark, d).select("*", F.explode(F.array(*[F.lit(k) for k in [*ARTIFACTS, "none"]])).alias("edit"))
    rows = rows.withColumn("found", F.when(F.col("edit") == F.col("kind"), F.col("other")).otherwise(F.col("own")))
    return chain.revalidate(chain.seal(rows, ARTIFACTS, ["edit"], carry=("found",)), ARTIFACTS, ["edit"])


@query
def exact_rounding(spark, d):
    return facts.table(spark, d, "part").select("p_partkey", js_round(F.col("p_retailprice") / 7, 4).alias("seventh"), js_round(-F.col("p_retailprice") / 3, 6).alias("third"))


# --- votes to pairs


@query
def duplicate_votes(spark, d):
    return votes.duplicates(facts.valid_votes(spark, d), ["user_id", "k"])


@query
def pair_votes(spark, d):
    return facts.pairs(spark, d)


@query
def sample_weights(spark, d):
    return votes.sample_weights(facts.pairs(spark, d)).select("k", "source_no", "axis", "decisive", r6(F.col("weight")).alias("weight"))


@query
def weight_errors(spark, d):
    w = votes.sample_weights(facts.pairs(spark, d))
    return votes.weight_errors(w).agg(F.count(F.lit(1)).alias("n_errors"))


@query
def corpus_stats(spark, d):
    return votes.corpus_stats(facts.pairs(spark, d))


@query
def readiness_reasons(spark, d):
    return votes.readiness(votes.corpus_stats(facts.pairs(spark, d)))


@query
def contributor_lists(spark, d):
    c = votes.contributors(facts.pairs(spark, d))
    return c.select(F.array_join(F.transform("sources", lambda s: s.cast("string")), ",").alias("sources"), F.array_join(F.transform("families", lambda s: s.cast("string")), ",").alias("families"), F.array_join("groups", ",").alias("groups"))


@query
def agreement_fourway(spark, d):
    return _agreement(spark, d, votes.VOTES)


@query
def agreement_decisive(spark, d):
    return _agreement(spark, d, votes.VOTES[:2])


def _agreement(spark, d, categories):
    a = votes.agreement(facts.pairs(spark, d), categories)
    return a.select(*[r6(F.col(c)).alias(c) for c in ("observed", "expected", "chance_corrected")], "rated_pairs")


@query
def fold_assignment_family(spark, d):
    return _folds(spark, d, "family")


@query
def fold_assignment_group(spark, d):
    return _folds(spark, d, "group")


def _folds(spark, d, mode):
    out = votes.assign_folds(votes.sample_weights(facts.pairs(spark, d)), mode)
    return out.select("unit", r6(F.col("weight")).alias("weight"), "fold", "effective_folds", "status")


# --- ranker


@query
def pair_features(spark, d):
    return facts.weighted(spark, d).select("k", *[r6(F.get("x", F.lit(i))).alias(f"x{i}") for i in range(3)])


@query
def baseline_predictions(spark, d):
    return facts.weighted(spark, d).select("k", *[r6(ranker.prediction(F.array(*map(F.lit, w)), F.col("x"))).alias(n) for n, w in ranker.BASELINES.items()])


def _baselines_long(spark, d):
    w = facts.weighted(spark, d).where("eligible")
    scored = w.select("*", *[ranker.prediction(F.array(*map(F.lit, v)), F.col("x")).alias(n) for n, v in ranker.BASELINES.items()])
    return ranker.long_form(scored, [], tuple(ranker.BASELINES))


@query
def scored_losses(spark, d):
    out = ranker.losses(_baselines_long(spark, d), [])
    return out.select("model", "eligible_pairs", "winner_pairs", *[r6(F.col(c)).alias(c) for c in ("winner_accuracy", "log_loss", "brier")])


@query
def risk_coverage(spark, d):
    out = ranker.risk_coverage(_baselines_long(spark, d), [])
    return out.select("model", "threshold", r6(F.col("coverage")).alias("coverage"), r6(F.col("risk")).alias("risk"))


@query
def ranker_weights(spark, d):
    w = ranker.fit(facts.weighted(spark, d).where("eligible"), ["axis"])
    return w.select("axis", *[r6(F.get("weights", F.lit(i)), 5).alias(f"w{i}") for i in range(3)])


def _out_of_fold(spark, d, mode):
    w = facts.weighted(spark, d)
    return ranker.out_of_fold(w, votes.assign_folds(w, mode), mode)


@query
def oof_metrics(spark, d):
    both = _out_of_fold(spark, d, "family").unionByName(_out_of_fold(spark, d, "group")).where("learned IS NOT NULL")
    out = ranker.losses(ranker.long_form(both, ["mode"], ("learned", *ranker.BASELINES)), ["mode"])
    return out.select("mode", "model", "eligible_pairs", "winner_pairs", *[r6(F.col(c), 4).alias(c) for c in ("winner_accuracy", "log_loss", "brier")])


@query
def promotion_flag(spark, d):
    rows = _out_of_fold(spark, d, "family")
    metrics = ranker.losses(ranker.long_form(rows.where("learned IS NOT NULL"), [], ("learned", *ranker.BASELINES)), [])
    coverage = rows.agg((F.count("learned") / F.count(F.lit(1))).alias("evaluation_coverage"))
    return ranker.promotion(metrics, coverage, votes.corpus_stats(facts.pairs(spark, d)).select("eligible_family_count"))


# --- holdout


@query
def training_overlap(spark, d):
    good = holdout.overlaps(facts.holdout(spark, d), facts.training(spark, d)).withColumn("variant", F.lit("disjoint"))
    return good.unionByName(holdout.overlaps(facts.all_cases(spark, d), facts.training(spark, d)).withColumn("variant", F.lit("overlapping")))


@query
def output_contracts(spark, d):
    long = holdout.long_outputs(facts.all_cases(spark, d), ["case_id"])
    rules = contracts.output_rules(F.col("status"), F.col("percent"), F.when(F.col("status") == "ABSTAIN", F.lit("size-rule")))
    return contracts.violation_counts(long, rules)


def _trials(spark, d):
    return holdout.trials(facts.holdout(spark, d), ["case_id", "family", "group"])


@query
def holdout_trials(spark, d):
    return _trials(spark, d).select("case_id", "baseline", "learned_percent", "other_percent", "trial_id", "flipped")


@query
def blinded_trials(spark, d):
    return holdout.blinded(holdout.participants(_trials(spark, d)))


@query
def distinct_outputs(spark, d):
    return holdout.distinct_outputs(facts.holdout(spark, d), _trials(spark, d))


def _results(spark, d):
    return holdout.judged(_trials(spark, d), holdout.counted(facts.case_votes(spark, d)))


@query
def head_to_head(spark, d):
    h = holdout.head_to_head(_results(spark, d), ["baseline"])
    return h.select("baseline", "wins", "losses", "ties", "cannot_judge", "decisive", r6(F.col("win_rate")).alias("win_rate"))


@query
def wilson_bounds(spark, d):
    return holdout.head_to_head(_results(spark, d), ["baseline", "family"]).select("baseline", "family", "decisive", r6(F.col("wilson_lower")).alias("wilson_lower"))


@query
def family_macro(spark, d):
    return holdout.family_macro(_results(spark, d)).select("baseline", "represented_families", r6(F.col("family_macro")).alias("family_macro"))


@query
def sources_with_votes(spark, d):
    return holdout.sources_with(_results(spark, d))


@query
def policy_coverage(spark, d):
    return holdout.policy_coverage(facts.holdout(spark, d)).select("policy", "value_cases", "abstain_cases", r6(F.col("coverage")).alias("coverage"))


def _hazards(spark, d):
    """One hazard a kind, from the parts whose key is its place; those of size 1 to 5 answer where they shouldn't."""
    kinds = spark.createDataFrame(list(enumerate(holdout.HAZARDS)), "case_id long, kind string")
    p = facts.table(spark, d, "part").select(F.col("p_partkey").alias("case_id"), "p_size")
    wrong = F.col("p_size") <= 5
    return kinds.join(p, "case_id").select("case_id", "kind", F.lit("ABSTAIN").alias("expected_status"), F.col("kind").alias("expected_reason"), F.when(wrong, "VALUE").otherwise("ABSTAIN").alias("status"), F.when(~wrong, F.col("kind")).alias("reason"))


@query
def hazard_failures(spark, d):
    return holdout.hazard_failures(_hazards(spark, d)).select("case_id", "kind", "status")


def _gate(spark, d):
    cases, results = facts.holdout(spark, d), _results(spark, d)
    raters = results.agg(F.min("raters").alias("raters_per_pair"))
    evidence = cases.agg(F.countDistinct("source_id").alias("source_count"), F.countDistinct("family").alias("family_count"), F.countDistinct("family", "group").alias("group_count")).crossJoin(raters)  # one row each
    return holdout.gate(evidence, holdout.head_to_head(results, ["baseline"]), holdout.family_macro(results), holdout.sources_with(results), holdout.policy_coverage(cases), holdout.hazard_failures(_hazards(spark, d)))


@query
def promotion_gate(spark, d):
    return _gate(spark, d)


@query
def gate_status(spark, d):
    return holdout.gate_status(_gate(spark, d))


@query
def region_rollup(spark, d):
    """Win rates against the zero baseline by the region of the judging supplier."""
    s = facts.table(spark, d, "supplier").select(F.col("s_suppkey").alias("rater"), "s_nationkey")
    n, r = facts.table(spark, d, "nation"), facts.table(spark, d, "region")
    won = holdout.judged(_trials(spark, d).where("baseline = 'zero'"), facts.case_votes(spark, d)).groupBy("rater").agg(F.count(F.when(F.col("result") == "win", 1)).alias("wins"), F.count(F.when(F.col("result") == "loss", 1)).alias("losses"))
    by = won.join(s, "rater").join(n, F.col("s_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"))
    agg = by.groupBy("r_name").agg(F.sum("wins").alias("wins"), F.sum("losses").alias("losses"))
    return agg.withColumn("win_rate", r6(F.try_divide(F.col("wins"), F.col("wins") + F.col("losses"))))


@query
def missing_responses(spark, d):
    v = facts.valid_votes(spark, d).select("user_id", "k")
    expected = v.select("user_id").distinct().select("user_id", F.explode(F.sequence(F.lit(0), F.lit(99))).alias("k"))
    return holdout.completeness(expected, v, ["user_id", "k"])


# --- adaptive


def _candidates(spark, d):
    v = facts.unique_votes(spark, d)
    return v.select("axis", F.col("left_pct").alias("value")).unionByName(v.select("axis", F.col("right_pct").alias("value"))).distinct()


@query
def candidate_grid(spark, d):
    s = facts.unique_votes(spark, d).select("source_no", "proposal_pct").distinct()
    return s.select("source_no", F.explode(adaptive.candidate_values(F.col("proposal_pct"), 1.0, 0.3)).alias("value"))


@query
def adjacent_trials(spark, d):
    grid = candidate_grid(spark, d)
    return adaptive.adjacent_trials(grid, ["source_no"])


@query
def trial_pool(spark, d):
    return adaptive.trial_pool(_candidates(spark, d)).drop("repeat_id")


@query
def choice_likelihood(spark, d):
    counts = adaptive.choice_counts(facts.unique_votes(spark, d), ["axis"])
    return counts.select("axis", "a", "b", "choice", "n", r6(adaptive.likelihood(F.col("choice"), F.lit(0.0), F.col("a"), F.col("b"))).alias("p"))


def _posterior(spark, d):
    return adaptive.posterior(adaptive.choice_counts(facts.unique_votes(spark, d), ["axis"]), ["axis"])


@query
def axis_posterior(spark, d):
    return _posterior(spark, d).select("axis", "i", r6(F.col("p")).alias("p"))


@query
def running_posterior(spark, d):
    out = adaptive.running_posterior(facts.unique_votes(spark, d), ["user_id", "axis"], ["ts", "event_id"])
    return out.select("user_id", "axis", "step", r6(F.col("mean"), 5).alias("mean"), r6(F.col("entropy"), 5).alias("entropy"))


def _seen(spark, d):
    return facts.unique_votes(spark, d).groupBy("size", "theme").agg(F.countDistinct("user_id").alias("n"))


@query
def information_topk(spark, d):
    scored = adaptive.information(adaptive.trial_pool(_candidates(spark, d)), _posterior(spark, d), _seen(spark, d)).withColumn("score", F.round("score", 9))
    return adaptive.next_trial(scored, ["axis"], 3).select("axis", "rank", "trial_id", r6(F.col("score")).alias("score"))


@query
def condition_counts(spark, d):
    """How often a rater had met a condition before each vote."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("user_id", "size", "theme").orderBy("ts", "event_id").rowsBetween(Window.unboundedPreceding, -1)
    return facts.unique_votes(spark, d).select("event_id", "user_id", "size", "theme", F.count(F.lit(1)).over(w).alias("before"))


def _losses(spark, d):
    return adaptive.search_losses(adaptive.choice_counts(facts.unique_votes(spark, d), ["axis"]), ["axis"])


@query
def ideal_point(spark, d):
    return adaptive.ideal_point(_losses(spark, d), ["axis"]).select("axis", "ideal_percent", "indifference_percent", F.round("loss", 4).alias("loss"))


@query
def ideal_interval(spark, d):
    return adaptive.ideal_interval(_losses(spark, d), ["axis"])


@query
def sequence_check(spark, d):
    c = facts.table(spark, d, "conversations")
    return adaptive.sequence_check(c, "conv_id", "turn", "role", "role")


@query
def repeat_reliability(spark, d):
    return adaptive.repeat_reliability(facts.valid_votes(spark, d), ["user_id", "k"], ["ts", "event_id"], "vote")


@query
def adaptive_replay(spark, d):
    """Each rater's votes in order as answers to the policy; the pool is one study's, bounded by contract."""
    pool = [r.asDict() for r in adaptive.trial_pool(_candidates(spark, d)).collect()]
    v = facts.unique_votes(spark, d).select("rater", F.struct("ts", "event_id").alias("position"), "choice")
    return adaptive.replay(v, pool)


# --- rasters and decisions


@query
def raster_bounds(spark, d):
    return raster.bounds(facts.rasters(spark, d), "vec_id", threshold=STRUCTURE)


@query
def alpha_centroid(spark, d):
    c = raster.centroid(facts.rasters(spark, d), "vec_id")
    return c.select("vec_id", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


@query
def edge_centroid(spark, d):
    c = raster.edge_centroid(facts.rasters(spark, d), "vec_id")
    return c.select("vec_id", "edge_sum", r6(F.col("x")).alias("x"), r6(F.col("y")).alias("y"))


def _profiles(spark, d):
    return facts.rasters(spark, d).select("vec_id", raster.profile(F.col("alpha"), "x", 8, 8).alias("columns"), raster.profile(F.col("alpha"), "y", 8, 8).alias("rows"))


@query
def profiles(spark, d):
    return _profiles(spark, d).select("vec_id", F.posexplode(F.arrays_zip("columns", "rows")).alias("place", "p")).select("vec_id", "place", F.col("p.columns").alias("column_alpha"), F.col("p.rows").alias("row_alpha"))


def _symmetry(spark, d):
    p = _profiles(spark, d)
    x, y = raster.symmetry(p, "vec_id", "columns"), raster.symmetry(p, "vec_id", "rows")
    return x.withColumn("axis", F.lit("x")).unionByName(y.withColumn("axis", F.lit("y")))


@query
def symmetry_axis(spark, d):
    return _symmetry(spark, d).select("vec_id", "axis", "axis2", "score")


@query
def hull_centroid(spark, d):
    return raster.shapes(facts.rasters(spark, d), "vec_id", threshold=STRUCTURE, structure=STRUCTURE).select("vec_id", r6(F.col("hull_x")).alias("hull_x"), r6(F.col("hull_y")).alias("hull_y"))


@query
def component_count(spark, d):
    return raster.shapes(facts.rasters(spark, d), "vec_id", threshold=STRUCTURE, structure=STRUCTURE).select("vec_id", "components")


def _signals(spark, d):
    r = facts.rasters(spark, d)
    c = raster.centroid(r, "vec_id").select("vec_id", F.col("x").alias("ax"), F.col("y").alias("ay"))
    e = raster.edge_centroid(r, "vec_id").select("vec_id", F.col("x").alias("ex"), F.col("y").alias("ey"))
    s = _symmetry(spark, d).groupBy("vec_id").agg(F.max(F.when(F.col("axis") == "x", F.col("axis2") / 2)).alias("sx"), F.max(F.when(F.col("axis") == "y", F.col("axis2") / 2)).alias("sy"))
    return c.join(e, "vec_id").join(s, "vec_id")


def _combined(s: DataFrame, *axes) -> DataFrame:
    """vec_id and the combination of each axis's entries as an array c: one lambda, evaluated once an axis."""
    return s.select("vec_id", F.array(*axes).alias("e")).select("vec_id", F.transform("e", decide.combine).alias("c"))


@query
def signal_consensus(spark, d):
    s = _signals(spark, d)
    found = decide.entries(8.0, 4.0, alpha=F.col("ax"), edge=F.col("ex"), symmetry=F.col("sx"))
    return _combined(s, found).select("vec_id", F.get("c", F.lit(0)).alias("c")).select("vec_id", "c.status", "c.band", "c.n", r6(F.col("c.consensus"), 4).alias("consensus"))


@query
def ensemble_decision(spark, d):
    """All four signals, hulls included, on both axes, and their stability between two thresholds."""
    base = facts.rasters(spark, d)
    s = _signals(spark, d).join(raster.shapes(base, "vec_id"), "vec_id").join(raster.shapes(base, "vec_id", threshold=STRUCTURE).select("vec_id", F.col("hull_x").alias("hx2"), F.col("hull_y").alias("hy2")), "vec_id")
    both = lambda a, e, h, m: decide.entries(8.0, 4.0, alpha=F.col(a), edge=F.col(e), convexHull=F.col(h), symmetry=F.col(m))
    c = _combined(s, both("ax", "ex", "hull_x", "sx"), both("ay", "ey", "hull_y", "sy"), both("ax", "ex", "hx2", "sx"), both("ay", "ey", "hy2", "sy"))
    x, y, x2, y2 = (F.get("c", F.lit(i)) for i in range(4))
    e = c.select("vec_id", decide.ensemble(x, y, F.array(x, x2), F.array(y, y2)).alias("e"))
    return e.select("vec_id", "e.status", "e.reason", "e.band", r6(F.col("e.dx")).alias("dx"), r6(F.col("e.dy")).alias("dy"))


@query
def size_stability(spark, d):
    """Spread of the centre over three thresholds, as sizes would blur a drawing."""
    r = facts.rasters(spark, d)
    at = [raster.centroid(r, "vec_id", threshold=t).select("vec_id", ((4.0 - F.col("x")) / 8 * 100).alias(f"x{t}")) for t in (1, 32, 64)]
    j = at[0].join(at[1], "vec_id").join(at[2], "vec_id")
    known = F.filter(F.array("x1", "x32", "x64"), lambda v: v.isNotNull())
    spread = F.array_max(known) - F.array_min(known)
    return j.select("vec_id", r6(spread).alias("spread"), (spread <= decide.UNSTABLE).alias("stable"))


@query
def decision_codes(spark, d):
    """The centroid engine: bounds rules first, then shift, range and tolerance."""
    r = facts.rasters(spark, d)
    m = raster.bounds(r, "vec_id", threshold=STRUCTURE).join(raster.centroid(r, "vec_id", threshold=STRUCTURE), "vec_id")
    bx, by = (F.col("min_x") + F.col("max_x") + 1) / 2, (F.col("min_y") + F.col("max_y") + 1) / 2
    first = decide.bounds_first(F.abs(bx - 4) / 8, F.abs(by - 4) / 8, F.abs(F.col("x") - bx) / 8, F.abs(F.col("y") - by) / 8)
    why = decide.reasons(no_painted_content=F.col("painted_pixels") == 0, fix_bounds_first=first)
    p = decide.proposal((4 - F.col("x")) / 8 * 100, (4 - F.col("y")) / 8 * 100, F.when(F.size(why) > 0, F.array_join(why, ",")))
    return m.select("vec_id", p.alias("p")).select("vec_id", "p.status", "p.reason", r6(F.col("p.dx"), 4).alias("dx"), r6(F.col("p.dy"), 4).alias("dy"))


@query
def decision_pixels(spark, d):
    s = facts.weighted(spark, d).select("k", decide.pixel_offsets(F.col("proposal_pct"), F.col("left_pct"), F.array(F.lit(16), F.lit(24))).alias("o"))
    return s.select("k", F.explode("o").alias("p")).select("k", "p.size", "p.dx", "p.dy")


@query
def clipping_retention(spark, d):
    return raster.shifted_retention(facts.rasters(spark, d), "vec_id")


@query
def outline_measures(spark, d):
    """What outlines paint at two sizes, in units of their view."""
    return coverage.measures(facts.outlines(spark, d), "vec_id", "rings", (0, 0, 24, 24), (16, 24))


@query
def outline_clipping(spark, d):
    """What outlines lose when their view moves by half a unit to the right."""
    return coverage.clipping(facts.outlines(spark, d), "vec_id", "rings", (0, 0, 24, 24), (0.5, 0, 24, 24), (16, 24))


@query
def axis_review(spark, d):
    o = F.col("outputs")
    c = facts.all_cases(spark, d).where(o["learned"]["status"] == "VALUE").select(decide.axis_action(o["learned"]["percent"], o["ensemble"]["percent"]).alias("action"))
    return c.groupBy("action").agg(F.count(F.lit(1)).alias("n"))


@query
def verification_status(spark, d):
    p = facts.table(spark, d, "part")
    size = F.col("p_size")
    v = decide.verification(size % 10 == 0, (size % 13 - 6.0), F.lit(0.0), size % 3 != 0, F.when(size % 4 != 0, size % 5 != 0))
    return p.select(v.alias("v")).select("v.status", F.array_join("v.codes", ",").alias("codes")).groupBy("status", "codes").agg(F.count(F.lit(1)).alias("n"))


@query
def apply_gate(spark, d):
    o = facts.table(spark, d, "orders")
    codes = decide.apply_gate(verified=F.col("o_orderstatus") == "F", audit_bound=F.col("o_orderkey") % 7 != 0, comparison_bound=F.col("o_custkey") % 5 != 0)
    return o.select(F.array_join(codes, ",").alias("codes")).groupBy("codes").agg(F.count(F.lit(1)).alias("n"))


# --- markup, events


@query
def markup_issues(spark, d):
    p = facts.table(spark, d, "pages").select(F.explode(markup.preflight(F.coalesce("html", F.lit("")))).alias("code"))
    return p.groupBy("code").agg(F.count(F.lit(1)).alias("n"))


@query
def markup_elements(spark, d):
    e = facts.table(spark, d, "pages").select(F.explode(markup.elements(F.coalesce("html", F.lit("")))).alias("name"))
    listed = F.when(F.col("name").isin(*markup.BLOCKED_ELEMENTS), "blocked").when(F.col("name").isin(*markup.ALLOWED_ELEMENTS), "allowed").otherwise("unsupported")
    return e.groupBy("name", listed.alias("listed")).agg(F.count(F.lit(1)).alias("n"))


@query
def vote_rate_windows(spark, d):
    return live.vote_rates(facts.table(spark, d, "events")).select("window_start", "event_type", "n")


def queries() -> dict:
    from . import study_queries

    return REGISTRY | study_queries.REGISTRY
