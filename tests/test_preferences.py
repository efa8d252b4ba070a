"""Contracts, votes, folds, ranker and holdout on small literal corpora."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from panelspark.operators import contracts, holdout, ranker, votes

KEYS = ["source_no", "family_no", "group_no", "axis", "left_pct", "right_pct", "proposal_pct"]


def corpus(families=5, per=8, raters=3, extra=()):
    """The candidate nearer 0.6 of the proposal wins."""
    rows = []
    for f in range(families):
        proposal = -1.5 + 0.75 * f
        for p in range(per):
            left, right = -2 + 0.5 * p, -1.5 + 0.5 * p
            for r in range(raters):
                best = left if abs(left - 0.6 * proposal) < abs(right - 0.6 * proposal) else right
                a, b = (left, right) if r % 2 else (right, left)
                rows.append((f, f, f, "xy"[p % 2], left, right, proposal, a, b, "A" if a == best else "B", f"r{r}"))
    return rows + list(extra)


SCHEMA = "source_no int, family_no int, group_no int, axis string, left_pct double, right_pct double, proposal_pct double, a double, b double, choice string, rater string"


def pairs_of(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA).withColumn("vote", votes.canonical_vote(F.col("choice"), F.col("a"), F.col("b")))
    w = votes.sample_weights(votes.pair_votes(df, KEYS))
    return w.withColumn("x", ranker.feature_difference(F.col("left_pct"), F.col("right_pct"), F.col("proposal_pct")))


def plain(df):
    return sorted(map(str, df.collect()))


def test_presentation_and_order_dont_matter(spark):
    rows = corpus()
    mirrored = [(*r[:7], r[8], r[7], {"A": "B", "B": "A"}[r[9]], r[10]) for r in rows]
    random.Random(1).shuffle(mirrored)
    assert plain(pairs_of(spark, rows).drop("x")) == plain(pairs_of(spark, mirrored).drop("x"))


def test_panel_outcomes(spark):
    base = (0, 0, 0, "x", -0.5, 0.5, 0.0, -0.5, 0.5)
    made = {"WINNER": "AAB", "UNRESOLVED": "AABB", "UNDERPOWERED": ["A", "B", "TIE", "ABSTAIN"]}
    for status, choices in made.items():
        r = pairs_of(spark, [(*base, c, str(i)) for i, c in enumerate(choices)]).first()
        assert r.status == status and (r.winner == "candidate1") == (status == "WINNER") and (r.target is None) == (status == "UNDERPOWERED")


def test_weights_sum_to_one_and_ties_leave_them(spark):
    tie = [(0, 0, 0, "x", -2.0, -1.5, -1.5, -2.0, -1.5, c, f"t{c}") for c in ("TIE", "ABSTAIN")]
    one, two = pairs_of(spark, corpus()), pairs_of(spark, corpus(extra=tie))
    assert votes.weight_errors(one).count() == 0
    assert plain(one.select(*KEYS, "weight", "target")) == plain(two.select(*KEYS, "weight", "target"))


def agreement_by_hand(counts):
    same = sum(math.comb(c, 2) for row in counts for c in row if sum(row) >= 2)
    every = sum(math.comb(sum(row), 2) for row in counts if sum(row) >= 2)
    totals = np.sum(counts, 0)
    e = float(((totals / totals.sum()) ** 2).sum())
    return same / every, e, (same / every - e) / (1 - e)


def test_agreement(spark):
    counts = [(3, 0, 1, 0), (1, 2, 0, 0), (0, 0, 0, 1), (2, 2, 1, 1)]
    df = spark.createDataFrame(counts, "candidate1 long, candidate2 long, tie long, abstain long")
    r = votes.agreement(df, votes.VOTES).first()
    assert (r.observed, r.expected, r.chance_corrected) == pytest.approx(agreement_by_hand(counts), abs=1e-8) and r.rated_pairs == 3
    alone = votes.agreement(spark.createDataFrame([(1, 0, 0, 0)], df.schema), votes.VOTES).first()
    assert alone.observed is None and alone.chance_corrected is None


def test_readiness_and_folds(spark):
    p = pairs_of(spark, corpus())
    assert votes.readiness(votes.corpus_stats(p)).first().status == "READY"
    few = votes.readiness(votes.corpus_stats(pairs_of(spark, corpus(families=1, per=2)))).first()
    assert few.reasons.split(",") == ["fewer-than-4-eligible-families", "fewer-than-4-eligible-groups", "fewer-than-20-eligible-pairs", "family-holdout-unavailable", "group-holdout-unavailable"]
    got = votes.assign_folds(p, "family", 3).collect()
    load = {}
    for r in got:
        load[r.fold] = load.get(r.fold, 0) + r.weight
    assert len(got) == 5 and set(load) == {0, 1, 2} and max(load.values()) - min(load.values()) <= max(r.weight for r in got) + 1e-9
    assert plain(votes.assign_folds(p, "family", 3)) == plain(votes.assign_folds(p.repartition(7), "family", 3))
    assert votes.assign_folds(pairs_of(spark, corpus(families=1)), "family").count() == 0


def descend(x, y, w, steps=1500):
    v = np.zeros(3)
    for _ in range(steps):
        v -= 0.15 * ((w * (1 / (1 + np.exp(-x @ v)) - y)) @ x / w.sum() + 0.01 * v)
    return v


def test_training_is_gradient_descent(spark):
    p = pairs_of(spark, corpus())
    rows = p.where("eligible").toPandas()
    got = {r.axis: r.weights for r in ranker.fit(p.where("eligible"), ["axis"]).collect()}
    for axis in "xy":
        part = rows[rows.axis == axis]
        assert got[axis] == pytest.approx(descend(np.array(part.x.tolist()), part.target.to_numpy(), part.weight.to_numpy()), abs=1e-8)
    few = ranker.fit(pairs_of(spark, corpus(families=1, per=4)).where("eligible"), ["axis"]).collect()
    assert all(r.weights is None for r in few)


def test_out_of_fold_never_trains_on_its_own(spark):
    p = pairs_of(spark, corpus())
    folds = votes.assign_folds(p, "family")
    rows = ranker.out_of_fold(p, folds, "family", iterations=200).toPandas()
    assert len(rows) == 40 and rows.learned.notna().all()
    k = rows.iloc[0]
    rest = rows[(rows.fold != k.fold) & (rows.axis == k.axis)]
    v = descend(np.array(rest.x.tolist()), rest.target.to_numpy(), rest.weight.to_numpy(), 200)
    assert k.learned == pytest.approx(1 / (1 + math.exp(-float(np.dot(v, k.x)))), abs=1e-8)
    out = {r.model: r for r in ranker.losses(ranker.long_form(ranker.out_of_fold(p, folds, "family"), [], ("learned", "zero", "centroid")), []).collect()}
    assert out["learned"].winner_accuracy >= out["zero"].winner_accuracy and out["learned"].eligible_pairs == 40


def test_a_half_counts_as_not_above(spark):
    df = spark.createDataFrame([("m", 0.5, 0.0, 1.0), ("m", 0.5, 1.0, 1.0), ("m", 1.0, 1.0, 2.0)], "model string, p double, target double, weight double")
    r = ranker.losses(df, []).first()
    assert r.winner_accuracy == 0.75
    risk = {x.threshold: x for x in ranker.risk_coverage(df, []).collect()}
    assert risk[0.5].coverage == 1 and risk[0.9].coverage == 0.5 and risk[0.9].risk == 0


# --- contracts


def test_violations_keep_every_code(spark):
    df = spark.createDataFrame([("A", "u1", "x", -0.5, 0.5, 0.0), ("C", "u 1", "z", 9.0, 9.0, float("nan")), (None, None, None, None, None, None), ("A", "u\n", "x", 0.0, 0.5, 0.0)], "c string, r string, x string, a double, b double, p double")
    rules = contracts.vote_rules(*(F.col(c) for c in "crxabp"))
    got = [r.v for r in df.select(rules.alias("v")).collect()]
    assert got[0] == [] and len(got[1]) == 7 and len(got[2]) == 7 and got[3] == ["rater-invalid"]
    good, bad = contracts.quarantine(df, rules)
    assert good.count() == 1 and bad.count() == 3
    with pytest.raises(Exception, match="contract"):
        contracts.strict(df, rules).count()


def test_output_union_and_case_rules(spark):
    rows = [("VALUE", 1.0, None), ("VALUE", 9.0, None), ("VALUE", 1.0, "x"), ("ABSTAIN", None, "too-few"), ("ABSTAIN", 1.0, "x"), ("OTHER", None, None)]
    got = [len(r.v) for r in spark.createDataFrame(rows, "s string, p double, r string").select(contracts.output_rules(F.col("s"), F.col("p"), F.col("r")).alias("v")).collect()]
    assert got == [0, 1, 1, 0, 1, 2]


def test_dependencies_and_differences(spark):
    df = spark.createDataFrame([("a", 1), ("a", 2), ("b", 1)], "l string, r int")
    assert {(r.dependency, r.n_conflicts) for r in contracts.dependency_conflicts(df, "l", "r").collect()} == {("l->r", 1), ("r->l", 1)}
    assert [r.side for r in contracts.differences(df, df.limit(0)).collect()] == ["stored"] * 3
    assert contracts.differences(df, df).count() == 0


# --- holdout


def cases(spark, n=48, learned=1.0):
    rows = [(i, str(i), f"f{i % 6}", f"g{i % 8}", {"zero": ("VALUE", 0.0), "centroid": ("VALUE", 0.5), "ensemble": ("VALUE", 0.75), "learned": ("VALUE", learned)}) for i in range(n)]
    return spark.createDataFrame(rows, "case_id long, source_id string, family string, group string, outputs map<string, struct<status: string, percent: double>>")


def report(spark, c, say, raters=5):
    t = holdout.trials(c, ["case_id", "family", "group"])
    v = c.select("case_id").crossJoin(spark.range(raters).withColumnRenamed("id", "rater")).withColumn("choice", F.lit(say))
    r = holdout.judged(t, v)
    if say in "AB":  # everyone prefers the learned value, wherever it was shown
        r = r.withColumn("result", F.lit("win"))
    evidence = c.agg(F.countDistinct("source_id").alias("source_count"), F.countDistinct("family").alias("family_count"), F.countDistinct("family", "group").alias("group_count")).withColumn("raters_per_pair", F.lit(raters))
    h = holdout.head_to_head(r, ["baseline"])
    none = spark.createDataFrame([], "case_id long")
    return h, holdout.gate(evidence, h, holdout.family_macro(r), holdout.sources_with(r), holdout.policy_coverage(c), none)


def test_gate_outcomes(spark):
    h, g = report(spark, cases(spark), "A")
    assert g.count() == 24 and holdout.gate_status(g).first().status == "PROMISING"
    assert all(r.wilson_lower > 0.9 and r.decisive == 240 for r in h.collect())
    _, few = report(spark, cases(spark, 4), "A")
    assert holdout.gate_status(few).first().status == "UNDERPOWERED"
    _, ties = report(spark, cases(spark), "TIE")
    assert holdout.gate_status(ties).first().status == "UNDERPOWERED"


def test_identical_outputs_make_no_trial(spark):
    c = cases(spark, 10, learned=0.5)
    t = holdout.trials(c, ["case_id"])
    assert {r.baseline for r in t.collect()} == {"zero", "ensemble"}
    d = {r.baseline: r for r in holdout.distinct_outputs(c, t).collect()}
    assert d["centroid"].identical_cases == 10 and d["zero"].distinct_cases == 10


def test_coin_decides_who_is_shown_first_and_results_follow(spark):
    t = holdout.trials(cases(spark, 40), ["case_id"])
    v = spark.range(40).select(F.col("id").alias("case_id"), F.lit(1).alias("rater"), F.lit("A").alias("choice"))
    got = holdout.judged(t, v).collect()
    assert {(r.flipped, r.result) for r in got} == {(False, "win"), (True, "loss")}


def test_participants_are_numbered_by_trial_and_see_nothing_else(spark):
    t = holdout.participants(holdout.trials(cases(spark, 30), ["case_id"]))
    rows = t.orderBy("trial_id").collect()
    assert [int(r.participant_id[2:], 36) for r in rows] == list(range(1, 91))
    assert set(holdout.blinded(t).columns) == {"participant_id", "image_a", "image_b"}


def test_overlap_hazards_and_completeness(spark):
    c = cases(spark, 12)
    got = {r.kind: r.n for r in holdout.overlaps(c, c.where("case_id = 0")).collect()}
    assert got == {"source": 1, "family": 2, "group": 1}
    h = spark.createDataFrame([(i, k, "ABSTAIN", k, "ABSTAIN" if i else "VALUE", k) for i, k in enumerate(holdout.HAZARDS)], "case_id long, kind string, expected_status string, expected_reason string, status string, reason string")
    assert [r.case_id for r in holdout.hazard_failures(h).collect()] == [0] and holdout.missing_hazards(h).count() == 0 and holdout.missing_hazards(h.where("case_id > 0")).count() == 1
    e = spark.createDataFrame([("r", 1), ("r", 2), ("s", 1)], "rater string, trial int")
    a = spark.createDataFrame([("r", 1), ("r", 1), ("r", 9)], e.schema)
    assert {tuple(r) for r in holdout.completeness(e, a, ["rater", "trial"]).collect()} == {("r", 1, 1, 1, 1), ("s", 0, 1, 0, 0)}


def test_participants_are_distinct_and_in_order_beyond_a_sample(spark, tmp_path):
    trials = spark.range(1_500_000).select(F.sha2(F.col("id").cast("string"), 256).alias("trial_id"), F.repeat(F.lit("x"), 20).alias("more"))
    for i, rows in enumerate((trials, trials.where("id % 100 = 0"))):
        holdout.participants(rows).write.parquet(str(tmp_path / str(i)))  # written, as columns that nobody reads are pruned
        out = spark.read.parquet(str(tmp_path / str(i)))
        n = rows.count()
        got = out.select(F.count(F.lit(1)).alias("n"), F.countDistinct("participant_id").alias("distinct")).first()
        assert (got.n, got.distinct) == (n, n)
        number = F.conv(F.substr("participant_id", F.lit(3)), 36, 10).cast("long")
        inside = out.select("trial_id", number.alias("n")).orderBy("trial_id").toArrow()["n"].to_pylist()
        assert inside == list(range(1, n + 1))


def test_ranks_of_few_equal_and_null_keys(spark):
    rows = spark.createDataFrame([(k,) for k in ["b", "a", "b", None, "c", "b", ""]], "k string")
    got = sorted((r.place, r.k) for r in holdout.ranked(rows, "k", "place", parts=5).collect())
    assert got == [(1, None), (2, ""), (3, "a"), (4, "b"), (5, "b"), (6, "b"), (7, "c")]
    assert holdout.ranked(rows.limit(0), "k", "place").count() == 0


def test_a_descent_on_moments_is_the_plain_one(spark):
    rng = np.random.default_rng(3)
    # one key holds most rows; one has too few, one no variance
    keys = ["a"] * 900 + ["b"] * 80 + ["few"] * 4 + ["flat"] * 9 + [None] * 30
    x = rng.normal(size=(len(keys), 3))
    x[984:993] = 0.5
    y = rng.integers(0, 2, len(keys)).astype(float)
    w = rng.random(len(keys)) + 0.1
    rows = spark.createDataFrame([(k, a.tolist(), float(t), float(v)) for k, a, t, v in zip(keys, x, y, w, strict=True)] * 2, "k string, x array<double>, target double, weight double")
    got = {r.k: r.weights for r in ranker.fit(rows.repartition(5), ["k"]).collect()}
    assert set(got) == {"a", "b", "few", "flat", None} and got["flat"] is None and got["few"] is not None
    for k, part in (("a", slice(0, 900)), ("b", slice(900, 980)), (None, slice(993, None))):
        assert got[k] == pytest.approx(descend(x[part], y[part], w[part]), abs=1e-9)
    assert ranker.fit(rows.limit(0), ["k"]).count() == 0
    with pytest.raises(ValueError, match="groups"):
        ranker.fit(rows, ["k"], most_groups=2)


def test_votes_counted_by_case_give_what_each_vote_gives(spark):
    t = holdout.trials(cases(spark, 30), ["case_id", "family", "group"])
    v = spark.range(400).selectExpr("id % 37 AS case_id", "id div 37 AS rater", "element_at(array('A', 'B', 'TIE', 'ABSTAIN'), cast(pmod(hash(id), 4) AS int) + 1) AS choice")
    votes, n = holdout.judged(t, v), holdout.judged(t, holdout.counted(v))
    same = lambda f: sorted(f(votes).collect()) == sorted(f(n).collect())
    assert same(lambda r: holdout.head_to_head(r, ["baseline", "family"])) and same(lambda r: holdout.sources_with(r, least=3)) and same(holdout.family_macro)
    assert n.count() <= 4 * t.count() and n.agg(F.min("raters")).first()[0] == votes.groupBy("trial_id").agg(F.countDistinct("rater").alias("n")).agg(F.min("n")).first()[0]
    for r in (votes, n):
        assert "Broadcast" not in r._jdf.queryExecution().executedPlan().toString()
