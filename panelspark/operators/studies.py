"""Studies as data: source features, bindings between trials, candidates and answers, lineage of a correction, readiness."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import SAFE_ID, SHA256
from ..functions.numeric import js_round
from . import decide
from .contracts import CONTEXTS, broken, in_range

ENGINES = ("ensemble", "centroid", "none")
POLICIES = ("zero", "centroid", "ensemble", "learned")


def geometry(box: Column, bounds: Column, pixels: int) -> Column:
    """Painted bounds (min_x, max_x, min_y, max_y in pixels) in view box units, with the bearings to each side."""
    sx, sy = box["width"] / pixels, box["height"] / pixels
    x, y = box["x"] + bounds["min_x"] * sx, box["y"] + bounds["min_y"] * sy
    max_x, max_y = box["x"] + (bounds["max_x"] + 1) * sx, box["y"] + (bounds["max_y"] + 1) * sy
    r = lambda v, n: js_round(v, 6).alias(n)
    return F.when(
        bounds["min_x"].isNotNull(),
        F.struct(
            r(x, "x"), r(y, "y"), r(max_x - x, "width"), r(max_y - y, "height"), r(x - box["x"], "left"), r(box["x"] + box["width"] - max_x, "right"),
            r(y - box["y"], "top"), r(box["y"] + box["height"] - max_y, "bottom"),
        ),
    )


def source_features(axis: Column, box: Column, place: Column, centre_x: Column, centre_y: Column, proposal: Column, components: Column) -> Column:
    """What a ranker knows of a source along one axis, in percent of the view box; place is geometry()'s struct."""
    along = lambda x, y: F.when(axis == "x", x).otherwise(y)
    size, across = along(box["width"], box["height"]), along(box["height"], box["width"])
    middle = along(box["x"], box["y"]) + size / 2
    percent = lambda v, whole, n: js_round(v / whole * 100, 6).alias(n)
    return F.struct(
        F.coalesce(js_round(proposal, 6), F.lit(0.0)).alias("proposal"), percent(middle - along(centre_x, centre_y), size, "centroid_offset"),
        percent(along(place["right"], place["bottom"]) - along(place["left"], place["top"]), size, "bearing_imbalance"),
        percent(along(place["width"], place["height"]), size, "extent"), percent(along(place["height"], place["width"]), across, "orthogonal_extent"), components.alias("components"),
    )


def decision_reasons(painted: Column, engine: Column, context: Column, masks: Column, filters: Column, text: Column, non_scaling: Column, components: Column, off_frame: Column) -> Column:
    """Why no shift may be proposed at all, in their fixed order."""
    return decide.reasons(
        no_painted_content=~painted, no_optical_engine=engine == "none", brand_artwork_manual_review=context == "logo", text_baseline_unverified=context == "icon-text", mask_geometry_unsupported=masks > 0,
        filter_geometry_unsupported=filters > 0, font_rendering_nondeterministic=text > 0, non_scaling_stroke_unsupported=non_scaling, semantic_weight_ambiguous=components > 1, fix_svg_bounds_first=painted & off_frame,
    )


def digest_of(*fields: Column) -> Column:
    """A digest of typed fields; nulls are written, so that they can't be mistaken for a missing field."""
    return F.sha2(F.concat_ws("|", *[F.coalesce(f.cast("string"), F.lit("null")) for f in fields]), 256)


def audit_rules(audit: Column, source: Column) -> Column:
    """audit: schema, sha256, bytes, path, view_box, sizes, engine, context; source: the same facts of the document itself."""
    return broken(
        ("audit-schema", audit["schema"] == 2), ("audit-binding", audit["sha256"].rlike(SHA256)), ("audit-sizes", (F.size(audit["sizes"]).between(1, 32)) & F.forall(audit["sizes"], lambda s: s.between(1, 512))),
        ("audit-request", audit["engine"].isin(*ENGINES) & audit["context"].isin(*CONTEXTS)), ("audit-path", audit["path"] == source["path"]), ("audit-hash", (audit["sha256"] == source["sha256"]) & (audit["bytes"] == source["bytes"])),
        ("audit-view-box", audit["view_box"].eqNullSafe(source["view_box"])), ("unsafe-source", source["safe"]),
    )


def row_audit_differences(rows: DataFrame, audits: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Rows with the fields in which they differ from their audit; rows without one differ in 'audit' itself."""
    there = audits.select(F.col(key), F.struct(*fields).alias("_audit"))
    met = rows.join(there, key, "left")
    codes = F.array_compact(F.array(*[F.when(~F.col(f).eqNullSafe(F.col("_audit")[f]), F.lit(f)) for f in fields]))
    return met.withColumn("differences", F.when(F.col("_audit").isNull(), F.array(F.lit("audit"))).otherwise(codes)).drop("_audit")


def training_rules(t: Column) -> Column:
    """t: dataset_digest, model_digest, source_hashes, families, groups (family/group)."""
    safe = r"[A-Za-z0-9._-]{1,64}"
    return broken(
        ("training-bindings", t["dataset_digest"].rlike(SHA256) & t["model_digest"].rlike(SHA256)), ("training-sources", F.forall(t["source_hashes"], lambda x: x.rlike(SHA256))),
        ("training-families", F.forall(t["families"], lambda x: x.rlike(SAFE_ID))), ("training-groups", F.forall(t["groups"], lambda x: x.rlike(rf"\A{safe}/{safe}\z"))),
    )


def case_rules(case_id: Column, source_id: Column, family: Column, group: Column, size: Column, theme: Column, outputs: Column) -> Column:
    """One holdout case: safe ids, a bounded condition, exactly the four policies, and no learned answer where the ensemble abstains."""
    safe = lambda c: F.coalesce(c.rlike(SAFE_ID), F.lit(False))
    return broken(
        ("case-identity", safe(case_id) & safe(source_id) & safe(family) & safe(group)), ("case-condition", size.between(8, 512) & theme.isin("light", "dark")),
        ("case-policies", F.array_sort(F.map_keys(outputs)) == F.array_sort(F.array(*map(F.lit, POLICIES)))), ("safety-wrapper", (outputs["ensemble"]["status"] != "ABSTAIN") | (outputs["learned"]["status"] == "ABSTAIN")),
    )


def one_to_one(df: DataFrame, left: str, right: str) -> DataFrame:
    """Values on either side that go with several on the other."""
    def one(a: str, b: str) -> DataFrame:
        return df.groupBy(F.col(a).alias("value")).agg(F.countDistinct(b).alias("n")).where("n > 1").select(F.lit(a).alias("side"), F.col("value").cast("string").alias("value"), "n")

    return one(left, right).unionByName(one(right, left))


def base_study_rules(schema: Column, non_authorizing: Column, candidates: Column, sizes: Column, themes: Column) -> Column:
    return broken(("base-study", (schema == 1) & non_authorizing), ("base-study-unusable", (candidates >= 2) & (F.size(sizes) > 0) & (F.size(themes) > 0)))


def with_candidates(trials: DataFrame, candidates: DataFrame, keep: list[str]) -> DataFrame:
    """Trials with the values of both candidates, by id; a trial whose candidate is unknown is lost (see study_rules for those)."""
    side = lambda n: candidates.select(F.col("candidate_id").alias(f"{n}_id"), F.col("value").alias(f"{n}_value"))
    return trials.join(side("a"), "a_id").join(side("b"), "b_id").select(*keep, "a_value", "b_value")


def display_rows(trials: DataFrame, display: DataFrame) -> DataFrame:
    """What a rater sees: for each trial and condition the images of both candidates; display: candidate_id, theme, size, image."""
    side = lambda n: display.select(F.col("candidate_id").alias(f"{n}_id"), "theme", "size", F.col("image").alias(f"{n}_image"))
    return trials.join(side("a"), ["a_id", "theme", "size"]).join(side("b"), ["b_id", "theme", "size"])


def answered(responses: DataFrame, trials: DataFrame) -> DataFrame:
    """Answers under opaque ids joined to the trials that they stand for; unknown ids keep a null trial.

    Both sides grow with the study: they meet in a shuffle, and neither goes through the driver.
    """
    return responses.hint("merge").join(trials, "participant_id", "left")


def apply_rules(v: Column, audit: Column, source: Column, candidate: Column, comparison: Column) -> Column:
    """Every predicate between a verification, its audit, the document, the rebuilt candidate and the comparison that was seen."""
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    return broken(
        ("unsafe-source", source["safe"]), ("audit-abstained", audit["status"] != "ABSTAIN"), ("verification-schema-unsupported", v["schema"] == 2), ("verification-not-pass", (v["status"] == "PASS") & v["approved"]),
        ("approval-lineage-mismatch", v["review_approved"] & v["comparison_bound"] & v["axes_reviewed"] & (v["review_digest"] == v["review_sha256"])), ("invalid-correction", finite(v["dx"]) & finite(v["dy"])),
        ("verification-source-mismatch", (v["source_sha256"] == source["sha256"]) & (v["source_bytes"] == source["bytes"]) & v["view_box"].eqNullSafe(source["view_box"])),
        ("verification-audit-mismatch", (v["audit_sha256"] == audit["sha256"]) & (v["audit_digest"] == audit["digest"])), ("candidate-hash-mismatch", v["candidate_sha256"] == candidate["sha256"]),
        ("comparison-lineage-mismatch", (comparison["source_sha256"] == source["sha256"]) & (comparison["candidate_sha256"] == candidate["sha256"]) & (comparison["sizes"] == audit["sizes"]) & (comparison["sha256"] == v["comparison_sha256"])),
        ("correction-digest-mismatch", v["correction_digest"] == digest_of(source["sha256"], audit["sha256"], v["review_digest"], candidate["sha256"])), ("correction-out-of-range", in_range(v["dx"], -5, 5) & in_range(v["dy"], -5, 5)),
        ("verification-evidence-missing", v["raster_sizes"].eqNullSafe(audit["sizes"])), ("postflight-clipping", ~comparison["clipped"]),
    )


def ideal_readiness(rows: DataFrame, keys: list[str], least_raters: int = 3, least_rows: int = 5) -> DataFrame:
    """Per study what its answers amount to: rows, evidence (first looks that chose or tied), raters, ties, abstentions, reasons.

    rows: rater, choice, repeat_of (null on first looks), study. Studies mixed under one key are a reason of their own.
    """
    evidence = (F.col("choice") != "ABSTAIN") & F.col("repeat_of").isNull()
    agg = rows.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("row_count"), F.count(F.when(evidence, 1)).alias("evidence_rows"), F.countDistinct(F.when(evidence, F.lower("rater"))).alias("rater_count"),
        F.count(F.when(evidence & (F.col("choice") == "TIE"), 1)).alias("tie_rows"), F.count(F.when(F.col("choice") == "ABSTAIN", 1)).alias("abstain_rows"), F.countDistinct("study").alias("studies"),
    )
    why = decide.reasons(provenance_mismatch=F.col("studies") > 1, too_few_raters=F.col("rater_count") < least_raters, too_few_rows=F.col("evidence_rows") < least_rows)
    return agg.withColumn("reasons", F.array_join(why, ","))


def shown_mismatches(shown: DataFrame, replayed: DataFrame) -> DataFrame:
    """Answers whose trial isn't the one that the policy shows at that step: rater, step, trial_id, expected.

    Both sides grow with the answers: they meet in a shuffle, and neither goes through the driver.
    """
    want = replayed.select("rater", "step", F.col("trial_id").alias("expected"))
    return shown.hint("merge").join(want, ["rater", "step"], "left").where(~F.col("trial_id").eqNullSafe(F.col("expected"))).select("rater", "step", "trial_id", "expected")
