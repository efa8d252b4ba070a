"""Queries over studies, audits and their lineage. Faults are planted by remainders of keys, so that every rule meets rows that break it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.lineage import content_id, unordered_id
from ..functions.numeric import r6
from ..operators import adaptive, contracts, decide, holdout, markup, markup_reader, raster, studies, votes
from . import facts

REGISTRY: dict = {}
STRUCTURE = 64


def query(f):
    REGISTRY[f.__name__] = f
    return f


def every(n: int, key: str):
    return F.col(key) % n == 0


def text(c):
    return c.cast("string")


# --- contracts of single rows


def _candidate_columns(key: str, dx, dy, axis, digest):
    good = contracts.candidate_id(axis, dx, dy, digest)
    return F.struct(F.when(every(23, key), F.sha2(F.lit("other"), 256)).otherwise(good).alias("id"), digest.alias("candidate_sha256"), dx.alias("dx"), dy.alias("dy"))


@query
def candidate_violations(spark, d):
    p = facts.table(spark, d, "part")
    axis = F.when(every(2, "p_partkey"), "x").otherwise("y")
    value, off = F.col("p_size") % 13 - 6.0, F.when(every(17, "p_partkey"), 1.0).otherwise(0.0)
    digest = F.when(every(19, "p_partkey"), F.lit("no hash")).otherwise(F.sha2(F.col("p_name"), 256))
    c = _candidate_columns("p_partkey", F.when(axis == "x", value).otherwise(off), F.when(axis == "x", off).otherwise(value), axis, digest)
    return contracts.violation_counts(p.select(axis.alias("axis"), c.alias("c")), contracts.candidate_rules(F.col("c"), F.col("axis")))


def _datums(spark, d) -> DataFrame:
    v = facts.valid_votes(spark, d)
    side = lambda value: F.struct(
        contracts.candidate_id(F.col("axis"), F.when(F.col("axis") == "x", value).otherwise(0.0), F.when(F.col("axis") == "x", 0.0).otherwise(value), F.sha2(text(F.round(value * 100).cast("long")), 256)).alias("id"),
        F.sha2(text(F.round(value * 100).cast("long")), 256).alias("candidate_sha256"), F.when(F.col("axis") == "x", value).otherwise(0.0).alias("dx"), F.when(F.col("axis") == "x", 0.0).otherwise(value).alias("dy"),
    )
    v = v.select("event_id", "choice", "axis", "rater", side(F.col("a")).alias("candidate_a"), side(F.col("b")).alias("candidate_b"), "proposal_pct")
    bad = lambda n: every(n, "event_id")
    chosen = F.when(F.col("choice") == "A", F.col("candidate_a.id")).when(F.col("choice") == "B", F.col("candidate_b.id"))
    trial = F.sha2(F.concat_ws("|", F.lit("trial"), "axis", F.array_sort(F.array("candidate_a.id", "candidate_b.id"))), 256)
    return v.select(
        "event_id", "choice", "axis", "candidate_a", "candidate_b", F.when(bad(101), 1).otherwise(2).alias("schema_version"), (~bad(103)).alias("non_authorizing"), F.sha2(F.lit("source"), 256).alias("source_sha256"),
        F.sha2(F.lit("study"), 256).alias("study_digest"), F.when(bad(107), "two words").otherwise(F.col("rater")).alias("rater_id"), F.when(bad(109), "poster").otherwise("icon-only").alias("context"),
        F.when(bad(113), F.array(F.lit(0))).otherwise(F.array(F.lit(16), F.lit(24))).alias("target_sizes"), F.array(F.lit("light"), F.lit("dark")).alias("themes"), F.when(bad(127), F.sha2(F.lit("no"), 256)).otherwise(trial).alias("trial_id"),
        F.when(bad(131), F.lit("none")).otherwise(chosen).alias("preferred_candidate_id"), ((F.col("choice") == "TIE") != bad(137)).alias("tie"), (F.col("choice") == "ABSTAIN").alias("abstain"), F.col("choice").isin("A", "B").alias("pairwise_winner_eligible"),
        F.struct(F.col("proposal_pct").alias("proposal"), F.lit(0.75).alias("centroid_offset"), F.lit(3.0).alias("bearing_imbalance"), F.when(bad(139), 101.0).otherwise(58.0).alias("extent"), F.lit(64.0).alias("orthogonal_extent"), F.when(bad(149), 0).otherwise(1).alias("components")).alias("source_features"),
    )


@query
def datum_violations(spark, d):
    return contracts.violation_counts(_datums(spark, d), contracts.datum_rules(""))


@query
def adaptive_violations(spark, d):
    v = facts.valid_votes(spark, d)
    a_id, b_id = content_id("candidate", F.col("axis"), (F.col("a") * 100).cast("long")), content_id("candidate", F.col("axis"), (F.col("b") * 100).cast("long"))
    ident = unordered_id("adaptive", F.concat_ws(":", "axis", text(F.col("size")), "theme"), a_id, b_id)
    bad = lambda n: every(n, "event_id")
    again = bad(7)
    repeat = F.sha2(F.concat(F.lit("repeat:"), ident), 256)
    trial = F.struct(
        F.when(bad(101), F.lit("x")).when(again, repeat).otherwise(ident).alias("id"), "axis", F.when(bad(103), 4).otherwise(F.col("size")).alias("_size"), F.when(bad(107), "sepia").otherwise(F.col("theme")).alias("_theme"),
        a_id.alias("a_id"), b_id.alias("b_id"), F.when(bad(109), F.col("b")).otherwise(F.col("a")).alias("a"), "b", repeat.alias("repeat_id"), F.when(again, ident).alias("repeat_of"),
    )
    t = v.select("event_id", "choice", trial.alias("t"))
    shown = F.struct("t.id", "t.axis", F.col("t._size").alias("size"), F.col("t._theme").alias("theme"), "t.a_id", "t.b_id", "t.a", "t.b", "t.repeat_id", "t.repeat_of")
    t = t.select("event_id", "choice", shown.alias("t"), F.when(bad(113), -1).otherwise(0).alias("i"), F.when(bad(127), 10).otherwise(500).alias("ms"))
    return contracts.violation_counts(t, contracts.adaptive_rules(F.col("t"), F.col("choice"), F.col("i"), F.col("ms")))


# --- studies, manifests, training, audits


def _conversations(spark, d):
    c = facts.table(spark, d, "conversations").groupBy("conv_id").agg(F.count(F.lit(1)).alias("n"), F.array_sort(F.collect_list("role")).alias("ids"))
    core = studies.digest_of(F.col("n"), F.array_join("ids", ","))
    return c.withColumn("digest", F.when(every(7, "conv_id"), F.lit("edited")).otherwise(core)).withColumn("core", core)


@query
def study_violations(spark, d):
    """A conversation's roles stand for a study's trials: most repeat one, and an edited digest shows."""
    c = _conversations(spark, d)
    known = F.array(F.lit("user"), F.lit("assistant"))
    rules = F.concat(contracts.study_rules(F.col("n"), F.col("ids"), known), contracts.broken(("study-tampered", F.col("digest") == F.col("core"))))
    return contracts.violation_counts(c, rules)


@query
def base_studies(spark, d):
    c = _conversations(spark, d)
    rules = studies.base_study_rules(F.when(every(5, "conv_id"), 2).otherwise(1), ~every(11, "conv_id"), F.size(F.array_distinct("ids")), F.array(F.lit(16)), F.when(every(3, "conv_id"), F.array().cast("array<string>")).otherwise(F.array(F.lit("light"))))
    return contracts.violation_counts(c, rules)


def _manifest(spark, d):
    c = facts.all_cases(spark, d)
    free = F.transform_values("outputs", lambda k, v: F.when((k == "learned") & every(22, "case_id") & (v["status"] == "ABSTAIN"), F.struct(F.lit("VALUE").alias("status"), F.lit(0.5).alias("percent"))).otherwise(v))
    short = F.map_filter(free, lambda k, v: (k != "zero") | ~every(31, "case_id"))
    return c.select("case_id", "source_id", F.replace("family", F.lit("#"), F.lit("-")).alias("family"), F.replace("group", F.lit(" "), F.lit("-")).alias("group"), F.when(every(37, "case_id"), 4).otherwise(24).alias("size"), F.when(every(41, "case_id"), "sepia").otherwise("dark").alias("theme"), short.alias("outputs"))


@query
def manifest_violations(spark, d):
    c = _manifest(spark, d)
    case = F.when(every(29, "case_id"), F.lit("two words")).otherwise(text(F.col("case_id")))
    return contracts.violation_counts(c, studies.case_rules(case, F.col("source_id"), F.col("family"), F.col("group"), F.col("size"), F.col("theme"), F.col("outputs")))


@query
def source_identities(spark, d):
    """Source ids and hashes that don't go together one to one: every fiftieth source takes its neighbour's hash."""
    p = facts.table(spark, d, "part")
    return studies.one_to_one(p.select(F.col("p_partkey").alias("source"), F.sha2(text(F.when(every(50, "p_partkey"), F.col("p_partkey") - 1).otherwise(F.col("p_partkey"))), 256).alias("hash")), "source", "hash")


@query
def missing_hazards(spark, d):
    """Required kinds of hazards that a manifest lacks; kinds of sizes over 40 were left out of this one."""
    kinds = spark.createDataFrame(list(enumerate(holdout.HAZARDS)), "case_id long, kind string")
    p = facts.table(spark, d, "part").where("p_size <= 40").select(F.col("p_partkey").alias("case_id"))
    return kinds.join(p, "case_id", "left_anti").select("kind")


@query
def training_violations(spark, d):
    p = facts.table(spark, d, "part")
    family, group = F.replace("p_brand", F.lit("#"), F.lit("-")), F.regexp_replace("p_type", r"\s+", "-")
    key = F.sha2(text(F.col("p_partkey")), 256)
    t = p.groupBy("p_brand").agg(F.collect_set(F.when(every(97, "p_partkey"), "short").otherwise(key)).alias("source_hashes"), F.collect_set(F.when(every(89, "p_partkey"), F.lit("a b")).otherwise(family)).alias("families"), F.collect_set(F.when(every(83, "p_partkey"), group).otherwise(F.concat_ws("/", family, group))).alias("groups"), F.min("p_partkey").alias("first"))
    t = t.select("p_brand", F.struct(F.when(every(3, "first"), F.lit("draft")).otherwise(F.sha2("p_brand", 256)).alias("dataset_digest"), F.sha2("p_brand", 256).alias("model_digest"), "source_hashes", "families", "groups").alias("t"))
    return t.select("p_brand", F.array_join(studies.training_rules(F.col("t")), ",").alias("codes"))


@query
def audit_violations(spark, d):
    p = facts.table(spark, d, "part")
    bad = lambda n: every(n, "p_partkey")
    digest = F.sha2("p_name", 256)
    source = F.struct(text(F.col("p_partkey")).alias("path"), digest.alias("sha256"), F.octet_length("p_name").alias("bytes"), F.concat_ws(" ", F.lit("0 0"), "p_size", "p_size").alias("view_box"), (~bad(47)).alias("safe"))
    audit = F.struct(
        F.when(bad(11), 1).otherwise(2).alias("schema"), F.when(bad(13), F.lit("short")).when(bad(17), F.sha2(F.lit("edited"), 256)).otherwise(digest).alias("sha256"), F.octet_length("p_name").alias("bytes"), F.when(bad(19), "elsewhere").otherwise(text(F.col("p_partkey"))).alias("path"),
        F.when(bad(23), F.lit("0 0 1 1")).otherwise(F.concat_ws(" ", F.lit("0 0"), "p_size", "p_size")).alias("view_box"), F.when(bad(29), F.array(F.lit(0))).otherwise(F.array(F.lit(16), F.lit(24))).alias("sizes"), F.when(bad(31), "guess").otherwise("ensemble").alias("engine"), F.lit("icon-only").alias("context"),
    )
    return contracts.violation_counts(p.select(audit.alias("a"), source.alias("s")), studies.audit_rules(F.col("a"), F.col("s")))


@query
def row_audit_mismatches(spark, d):
    """Lines as exported rows against the audits of their parts."""
    p = facts.table(spark, d, "part").where(~every(50, "p_partkey")).select("p_partkey", F.sha2("p_name", 256).alias("source_sha256"), (F.col("p_size") % 2 == 0).alias("rtl"), F.when(F.col("p_size") % 3 == 0, F.lit("logo")).alias("context"))
    li = facts.table(spark, d, "lineitem").select("l_orderkey", F.col("l_partkey").alias("p_partkey"))
    whole = facts.table(spark, d, "part").select("p_partkey", "p_name", "p_size")
    rows = li.join(whole, "p_partkey").select("p_partkey", "l_orderkey", F.when(every(31, "l_orderkey"), F.sha2(F.lit("edited"), 256)).otherwise(F.sha2("p_name", 256)).alias("source_sha256"), ((F.col("p_size") % 2 == 0) != every(37, "l_orderkey")).alias("rtl"), F.when(F.col("p_size") % 3 == 0, F.when(~every(41, "l_orderkey"), F.lit("logo"))).alias("context"))
    out = studies.row_audit_differences(rows, p, "p_partkey", ["source_sha256", "rtl", "context"])
    return out.groupBy(F.array_join("differences", ",").alias("differences")).agg(F.count(F.lit(1)).alias("n"))


# --- joins through ids


def _trials_with_ids(spark, d):
    v = facts.valid_votes(spark, d)
    ident = lambda value: content_id("candidate", F.col("axis"), F.round(value * 100).cast("long"))
    return v.select("event_id", "axis", "choice", "size", "theme", ident(F.col("a")).alias("a_id"), ident(F.col("b")).alias("b_id"), "a", "b")


def _known_candidates(spark, d):
    t = _trials_with_ids(spark, d)
    both = t.select(F.col("a_id").alias("candidate_id"), F.col("a").alias("value")).unionByName(t.select(F.col("b_id").alias("candidate_id"), F.col("b").alias("value")))
    return both.distinct()


@query
def trial_candidates(spark, d):
    met = studies.with_candidates(_trials_with_ids(spark, d), _known_candidates(spark, d), ["axis", "choice"])
    return met.groupBy("axis", "a_value", "b_value").agg(F.count(F.lit(1)).alias("n"), F.count(F.when(F.col("choice") == "A", 1)).alias("a_wins"))


@query
def trial_displays(spark, d):
    c = _known_candidates(spark, d)
    display = c.select("candidate_id", F.explode(F.array(F.lit("light"), F.lit("dark"))).alias("theme"), "value").select("candidate_id", "theme", F.explode(F.array(F.lit(16), F.lit(24))).alias("size"), "value")
    display = display.select("candidate_id", "theme", "size", F.concat_ws(":", F.round(F.col("value") * 100).cast("long"), "theme", "size").alias("image"))
    rows = studies.display_rows(_trials_with_ids(spark, d), display)
    return rows.groupBy("theme", "size", "a_image", "b_image").agg(F.count(F.lit(1)).alias("n"))


@query
def participant_answers(spark, d):
    """Votes under the ids that participants see, joined back to the trial and its baseline; every 500th answers an unknown trial."""
    trials = holdout.trials(facts.holdout(spark, d), ["case_id", "family", "group"]).select("trial_id", "case_id", "baseline")
    opaque = trials.withColumn("participant_id", F.sha2(F.concat(F.lit("participant:"), "trial_id"), 256))
    heard = F.when(F.col("case_id") % 500 == 0, F.lit("q-unknown")).otherwise(F.col("participant_id")).alias("participant_id")
    said = holdout.counted(facts.case_votes(spark, d)).hint("merge").join(opaque, "case_id").select(heard, F.inline("choices")).where("n > 0")
    said = said.groupBy("participant_id", "choice").agg(F.sum("n").alias("n"))
    back = studies.answered(said, opaque.select("participant_id", "trial_id", "baseline"))
    return back.groupBy(F.coalesce("baseline", F.lit("unknown")).alias("baseline"), "choice").agg(F.sum("n").alias("n"))


@query
def blinded_payload(spark, d):
    """What a page would carry, as base64 of JSON: the opaque id and the condition, and nothing of the policies."""
    t = facts.holdout(spark, d).select("case_id", F.base64(F.to_json(F.struct(F.sha2(text(F.col("case_id")), 256).alias("id"), F.lit("light").alias("theme"), F.lit(24).alias("size"))).cast("binary")).alias("payload"))
    return t.withColumn("payload", F.replace("payload", F.lit("\r\n"), F.lit("")))


# --- order of outputs


@query
def ordered_pairs(spark, d):
    """Canonical pairs in their order; there are at most as many as a study has, so one window numbers them."""
    p = facts.pairs(spark, d).select("k", "source_no", "axis", "left_pct")
    w = Window.orderBy("source_no", "axis", "left_pct", "k")
    return p.withColumn("position", F.row_number().over(w).cast("long")).orderBy("position")


@query
def ordered_cases(spark, d):
    return facts.holdout(spark, d).select("case_id", "family", "group").orderBy("case_id")


# --- measurements and decisions


def _box():
    return F.struct(F.lit(-4.0).alias("x"), F.lit(2.0).alias("y"), F.lit(24.0).alias("width"), F.lit(12.0).alias("height"))


def _places(spark, d, threshold=STRUCTURE):
    r = facts.rasters(spark, d)
    m = raster.bounds(r, "vec_id", threshold=threshold).join(raster.centroid(r, "vec_id", threshold=threshold), "vec_id")
    place = studies.geometry(_box(), F.struct("min_x", "max_x", "min_y", "max_y"), 8)
    return m.select("vec_id", "painted_pixels", place.alias("g"), (F.col("x") * 3.0 - 4.0).alias("cx"), (F.col("y") * 1.5 + 2.0).alias("cy"))


@query
def geometry(spark, d):
    return _places(spark, d).select("vec_id", *[F.col(f"g.{c}").alias(c) for c in ("x", "y", "width", "height", "left", "right", "top", "bottom")])


def _features(spark, d):
    p = _places(spark, d).where("painted_pixels > 0").withColumn("axis", F.explode(F.array(F.lit("x"), F.lit("y"))))
    f = studies.source_features(F.col("axis"), _box(), F.col("g"), F.col("cx"), F.col("cy"), F.col("vec_id") % 13 - 6.0, (F.col("vec_id") % 3).cast("int"))
    return p.select("vec_id", "axis", f.alias("f"))


@query
def source_features(spark, d):
    return _features(spark, d).select("vec_id", "axis", *[F.col(f"f.{c}") for c in ("proposal", "centroid_offset", "bearing_imbalance", "extent", "orthogonal_extent")], "f.components")


@query
def feature_violations(spark, d):
    return contracts.violation_counts(_features(spark, d), contracts.feature_rules(F.col("f")))


@query
def size_measures(spark, d):
    """Each raster at 8, 4 and 2 pixels a side: alpha sum, painted pixels and centre, in view box units."""
    r = facts.rasters(spark, d)
    out = None
    for width in (8, 4, 2):
        small = r if width == 8 else r.withColumn("alpha", raster.resampled(F.col("alpha"), 8, width))
        m = raster.bounds(small, "vec_id", width=width, threshold=STRUCTURE).join(raster.centroid(small, "vec_id", width=width, threshold=STRUCTURE), "vec_id")
        one = m.select("vec_id", F.lit(width).alias("size"), "painted_pixels", "alpha_sum", r6(F.col("x") / width * 24, 4).alias("x"), r6(F.col("y") / width * 24, 4).alias("y"))
        out = one if out is None else out.unionByName(one)
    return out


def _decided(spark, d):
    r = facts.rasters(spark, d)
    m = raster.bounds(r, "vec_id", threshold=STRUCTURE).join(raster.centroid(r, "vec_id", threshold=STRUCTURE), "vec_id")
    bx, by = (F.col("min_x") + F.col("max_x") + 1) / 2, (F.col("min_y") + F.col("max_y") + 1) / 2
    off = decide.bounds_first(F.abs(bx - 4) / 8, F.abs(by - 4) / 8, F.abs(F.col("x") - bx) / 8, F.abs(F.col("y") - by) / 8)
    v = F.col("vec_id")
    flag = lambda n: F.when(v % n == 0, 1).otherwise(0)
    why = studies.decision_reasons(F.col("painted_pixels") > 0, F.when(v % 41 == 0, "none").otherwise("centroid"), F.when(v % 11 == 0, "logo").when(v % 13 == 0, "icon-text").otherwise("icon-only"), flag(17), flag(19), flag(23), v % 29 == 0, flag(31) + 1, off)
    p = decide.proposal((4 - F.col("x")) / 8 * 100, (4 - F.col("y")) / 8 * 100, F.when(F.size(why) > 0, F.array_join(why, ",")))
    return m.select("vec_id", "painted_pixels", "alpha_sum", p.alias("p"))


@query
def decision_reasons(spark, d):
    return _decided(spark, d).select("vec_id", "p.status", "p.reason", r6(F.col("p.dx"), 4).alias("dx"), r6(F.col("p.dy"), 4).alias("dy"))


@query
def audit_digests(spark, d):
    """An audit's derived digest: its measures and its decision as integers and codes."""
    digest = studies.digest_of(F.col("vec_id"), F.col("painted_pixels"), F.col("alpha_sum"), F.col("p.status"), F.col("p.reason"))
    return _decided(spark, d).select("vec_id", digest.alias("digest"))


# --- lineage of a correction


@query
def apply_lineage(spark, d):
    p = facts.table(spark, d, "part")
    bad = lambda n: every(n, "p_partkey")
    sha = lambda tag: F.sha2(F.concat_ws(":", F.lit(tag), "p_partkey"), 256)
    sizes = F.array(F.lit(16), F.lit(24))
    source, candidate, audit_sha, review = sha("source"), sha("candidate"), sha("audit"), sha("review")
    v = F.struct(
        F.when(bad(11), 1).otherwise(2).alias("schema"), F.when(bad(13), "REVIEW_REQUIRED").otherwise("PASS").alias("status"), F.lit(True).alias("approved"), (~bad(17)).alias("review_approved"), F.lit(True).alias("comparison_bound"), F.lit(True).alias("axes_reviewed"),
        F.when(bad(19), sha("other")).otherwise(review).alias("review_digest"), review.alias("review_sha256"), F.when(bad(23), F.lit(float("nan"))).otherwise(F.col("p_size") % 15 - 7.0).alias("dx"), F.lit(0.5).alias("dy"), F.when(bad(29), sha("edited")).otherwise(source).alias("source_sha256"), F.col("p_size").alias("source_bytes"),
        text(F.col("p_size")).alias("view_box"), F.when(bad(31), sha("edited")).otherwise(audit_sha).alias("audit_sha256"), sha("derived").alias("audit_digest"), F.when(bad(37), sha("edited")).otherwise(candidate).alias("candidate_sha256"), sha("comparison").alias("comparison_sha256"),
        F.when(bad(41), sha("edited")).otherwise(studies.digest_of(source, audit_sha, F.when(bad(19), sha("other")).otherwise(review), candidate)).alias("correction_digest"), F.when(bad(43), F.array(F.lit(16))).otherwise(sizes).alias("raster_sizes"),
    )
    audit = F.struct(F.when(bad(47), "ABSTAIN").otherwise("REVIEW").alias("status"), audit_sha.alias("sha256"), sha("derived").alias("digest"), sizes.alias("sizes"))
    doc = F.struct(F.lit(True).alias("safe"), source.alias("sha256"), F.col("p_size").alias("bytes"), text(F.col("p_size")).alias("view_box"))
    shown = F.struct(source.alias("source_sha256"), candidate.alias("candidate_sha256"), F.when(bad(53), F.array(F.lit(24))).otherwise(sizes).alias("sizes"), sha("comparison").alias("sha256"), bad(59).alias("clipped"))
    t = p.select(v.alias("v"), audit.alias("a"), doc.alias("s"), F.struct(candidate.alias("sha256")).alias("c"), shown.alias("k"))
    return contracts.violation_counts(t, studies.apply_rules(F.col("v"), F.col("a"), F.col("s"), F.col("c"), F.col("k")))


@query
def ideal_readiness(spark, d):
    """Per source: what its votes amount to as evidence; second looks are repeats, and every seventh source mixes two studies."""
    w = Window.partitionBy("user_id", "k").orderBy("ts", "event_id")
    v = facts.valid_votes(spark, d).withColumn("n", F.row_number().over(w))
    rows = v.select("source_no", "rater", "choice", F.when(F.col("n") > 1, F.col("k")).alias("repeat_of"), F.when((F.col("source_no") % 7 == 0) & (F.col("event_id") % 2 == 0), "late").otherwise("first").alias("study"))
    return studies.ideal_readiness(rows, ["source_no"]).drop("studies")


@query
def replay_mismatches(spark, d):
    """Shown trials against the policy's: about every 50th was swapped."""
    from . import queries

    again = queries.adaptive_replay(spark, d)
    shown = again.select("rater", "step", F.when(F.sha2(F.concat_ws(":", "rater", "step"), 256).rlike("^0[0-4]"), F.lit("another")).otherwise(F.col("trial_id")).alias("trial_id"))
    return studies.shown_mismatches(shown, again)


# --- markup and reports


def _bare_pages(spark, d):
    return facts.table(spark, d, "pages").select("page_id", F.regexp_replace(F.coalesce("html", F.lit("")), "(?i)<!DOCTYPE[^>]*>", "").alias("html"))


@query
def markup_document_issues(spark, d):
    """Everything that pages break once their document types are off."""
    return markup.issues(_bare_pages(spark, d), "page_id", "html")


@query
def markup_breaks(spark, d):
    """Where pages stop being well-formed, as they are served and with their void elements closed."""
    bare = _bare_pages(spark, d)
    closed = F.regexp_replace("html", r"<(br|hr|img|input|link|meta)\b([^<>]*)>", "<$1$2/>")
    both = bare.select(F.concat_ws("/", "page_id", F.lit("served")).alias("page"), "html").unionByName(bare.select(F.concat_ws("/", "page_id", F.lit("closed")).alias("page"), closed.alias("html")))
    return markup_reader.breaks(both, "page", "html").select("page", "tokens", "elements", "code", "at")


@query
def coloured_roots(spark, d):
    return _bare_pages(spark, d).select("page_id", F.sha2(markup.with_root_colour(F.col("html"), "#123456"), 256).alias("sha256"))


@query
def comparison_panels(spark, d):
    """One panel a theme and size of each case that proposes a shift: what is shown beside what."""
    c = facts.holdout(spark, d).where((F.col("outputs")["learned"]["status"] == "VALUE") & (F.col("outputs")["learned"]["percent"] != 0))
    rows = c.select("case_id", (F.col("outputs")["learned"]["percent"] * 2).cast("long").alias("half_percents"), F.explode(F.array(F.lit("light"), F.lit("dark"))).alias("theme")).withColumn("size", F.explode(F.array(F.lit(16), F.lit(24))))
    return rows.select("case_id", "theme", "size", F.sha2(F.concat_ws(":", "case_id", F.lit("source")), 256).alias("source_image"), F.sha2(F.concat_ws(":", "case_id", "half_percents", "theme", "size"), 256).alias("candidate_image"))


@query
def run_summary(spark, d):
    """The line that a run prints."""
    s = votes.corpus_stats(facts.pairs(spark, d))
    return s.select(F.to_json(F.struct("eligible_pairs", "eligible_family_count")).alias("summary"))


@query
def audit_markdown(spark, d):
    """Decisions by status as a Markdown list, most severe first."""
    n = _decided(spark, d).groupBy(F.col("p.status").alias("status")).agg(F.count(F.lit(1)).alias("n"))
    line = F.format_string("- **%s**: %d", "status", "n")
    return n.agg(F.array_join(F.concat(F.array(F.lit("# Audit"), F.lit("")), F.array_sort(F.collect_list(line))), "\n").alias("markdown"))
