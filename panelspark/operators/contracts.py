"""Contracts as violation arrays: every row keeps all codes that it breaks, and strict mode raises on any."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lineage import SAFE_ID, SHA256, unordered_id

CHOICES = ("A", "B", "TIE", "ABSTAIN")
CONTEXTS = ("icon-only", "icon-text", "logo", "unknown")


def broken(*rules: tuple[str, Column]) -> Column:
    """Codes of the rules that don't hold; a rule that is null counts as broken."""
    return F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in rules]), lambda c: c.isNotNull())


def in_range(value: Column, low: float, high: float) -> Column:
    return value.isNotNull() & ~F.isnan(value.cast("double")) & value.between(low, high)


def quarantine(df: DataFrame, violations: Column) -> tuple[DataFrame, DataFrame]:
    """Rows that hold, and the others with their codes."""
    marked = df.withColumn("violations", violations)
    return marked.where(F.size("violations") == 0).drop("violations"), marked.where(F.size("violations") > 0)


def strict(df: DataFrame, violations: Column) -> DataFrame:
    """The rows as they are; evaluating one that breaks a rule fails the job with its codes."""
    return df.where(F.when(F.size(violations) > 0, F.raise_error(F.concat(F.lit("contract: "), F.array_join(violations, ",")))).otherwise(F.lit(True)).cast("boolean"))


def vote_rules(choice: Column, rater: Column, axis: Column, a: Column, b: Column, proposal: Column) -> Column:
    return broken(
        ("choice-invalid", choice.isin(*CHOICES)), ("rater-invalid", rater.rlike(SAFE_ID)), ("axis-invalid", axis.isin("x", "y")),
        ("candidate-a-range", in_range(a, -5, 5)), ("candidate-b-range", in_range(b, -5, 5)), ("candidates-equal", a != b), ("proposal-range", in_range(proposal, -5, 5)),
    )


def candidate_rules(c: Column, axis: Column) -> Column:
    """c: struct(id, candidate_sha256, dx, dy); the value off the axis has to be zero and the id its content's."""
    off = F.when(axis == "x", c["dy"]).otherwise(c["dx"])
    return broken(
        ("candidate-hash", c["candidate_sha256"].rlike(SHA256)), ("candidate-range", in_range(c["dx"], -5, 5) & in_range(c["dy"], -5, 5)), ("candidate-off-axis", off == 0),
        ("candidate-id", c["id"] == candidate_id(axis, c["dx"], c["dy"], c["candidate_sha256"])),
    )


def candidate_id(axis: Column, dx: Column, dy: Column, digest: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit("candidate"), axis, F.round(dx * 1_000_000).cast("long").cast("string"), F.round(dy * 1_000_000).cast("long").cast("string"), digest), 256)


def feature_rules(f: Column) -> Column:
    """f: struct(proposal, centroid_offset, bearing_imbalance, extent, orthogonal_extent, components)."""
    return broken(
        ("feature-proposal", in_range(f["proposal"], -5, 5)), ("feature-centroid", in_range(f["centroid_offset"], -100, 100)), ("feature-bearing", in_range(f["bearing_imbalance"], -100, 100)),
        ("feature-extent", in_range(f["extent"], 0, 100)), ("feature-orthogonal", in_range(f["orthogonal_extent"], 0, 100)), ("feature-components", f["components"].between(1, 10_000)),
    )


def datum_rules(row) -> Column:
    """Rules of a whole preference row (a DataFrame with the columns of sources.artifacts.DATUM)."""
    c = lambda name: F.col(f"{row}.{name}") if row else F.col(name)
    chosen = F.when(c("choice") == "A", c("candidate_a.id")).when(c("choice") == "B", c("candidate_b.id"))
    return F.concat(
        broken(
            ("schema-version", c("schema_version") == 2), ("authorizing", c("non_authorizing")), ("source-hash", c("source_sha256").rlike(SHA256)), ("study-hash", c("study_digest").rlike(SHA256)),
            ("rater-invalid", c("rater_id").rlike(SAFE_ID)), ("axis-invalid", c("axis").isin("x", "y")), ("choice-invalid", c("choice").isin(*CHOICES)), ("context-invalid", c("context").isin(*CONTEXTS)),
            ("sizes-invalid", (F.size(c("target_sizes")) > 0) & ~F.exists(c("target_sizes"), lambda s: ~s.between(1, 512))), ("themes-invalid", (F.size(c("themes")) > 0) & ~F.exists(c("themes"), lambda t: ~t.isin("light", "dark"))),
            ("candidates-equal", c("candidate_a.id") != c("candidate_b.id")), ("trial-id", c("trial_id") == F.sha2(F.concat_ws("|", F.lit("trial"), c("axis"), F.array_sort(F.array(c("candidate_a.id"), c("candidate_b.id")))), 256)),
            ("preferred-id", c("preferred_candidate_id").eqNullSafe(chosen)), ("tie-flag", c("tie") == (c("choice") == "TIE")), ("abstain-flag", c("abstain") == (c("choice") == "ABSTAIN")),
            ("winner-flag", c("pairwise_winner_eligible") == c("choice").isin("A", "B")),
        ),
        candidate_rules(c("candidate_a"), c("axis")), candidate_rules(c("candidate_b"), c("axis")), feature_rules(c("source_features")),
    )


def adaptive_rules(trial: Column, choice: Column, presented_index: Column, response_ms: Column) -> Column:
    """trial: struct(id, axis, size, theme, a_id, b_id, a, b, repeat_id, repeat_of)."""
    identity = unordered_id("adaptive", F.concat_ws(":", trial["axis"], trial["size"].cast("string"), trial["theme"]), trial["a_id"], trial["b_id"])
    return broken(
        ("trial-values", in_range(trial["a"], -5, 5) & in_range(trial["b"], -5, 5) & (trial["a"] != trial["b"])), ("trial-size", trial["size"].between(8, 512)), ("trial-theme", trial["theme"].isin("light", "dark")),
        ("trial-id", F.when(trial["repeat_of"].isNull(), trial["id"] == identity).otherwise((trial["id"] == trial["repeat_id"]) & (trial["repeat_of"] == identity))),
        ("choice-invalid", choice.isin(*CHOICES)), ("index-invalid", presented_index >= 0), ("response-time", response_ms.between(50, 300_000)),
    )


def output_rules(status: Column, percent: Column, reason: Column) -> Column:
    """A policy's output is a value in range without a reason, or an abstention with one."""
    return broken(("output-status", status.isin("VALUE", "ABSTAIN")), ("output-body", F.when(status == "VALUE", in_range(percent, -5, 5) & reason.isNull()).otherwise(percent.isNull() & reason.rlike(SAFE_ID))))


def study_rules(config_trials: Column, trial_ids: Column, bound_ids: Column) -> Column:
    return broken(("trial-count", config_trials.between(1, 32)), ("trial-unique", F.size(F.array_distinct(trial_ids)) == F.size(trial_ids)), ("trial-bound", F.size(F.array_except(trial_ids, bound_ids)) == 0))


def violation_counts(df: DataFrame, violations: Column) -> DataFrame:
    """code and n over all rows; rows without a violation count as 'none'."""
    codes = F.when(F.size(violations) > 0, violations).otherwise(F.array(F.lit("none")))
    return df.select(F.explode(codes).alias("code")).groupBy("code").agg(F.count(F.lit(1)).alias("n"))


def dependency_conflicts(df: DataFrame, left: str, right: str) -> DataFrame:
    """Determinants and those with more than one dependent value, in both directions: direction, n_values, n_conflicts."""
    def one(a: str, b: str) -> DataFrame:
        return df.groupBy(a).agg(F.countDistinct(b).alias("_d")).agg(F.count(F.lit(1)).alias("n_values"), F.count(F.when(F.col("_d") > 1, 1)).alias("n_conflicts")).select(F.lit(f"{a}->{b}").alias("dependency"), "n_values", "n_conflicts")

    return one(left, right).unionByName(one(right, left))


def differences(stored: DataFrame, recomputed: DataFrame) -> DataFrame:
    """An artifact against its recomputation: rows on one side only, with the side."""
    same = recomputed.select(*stored.columns)
    return stored.exceptAll(same).withColumn("side", F.lit("stored")).unionByName(same.exceptAll(stored).withColumn("side", F.lit("recomputed")))
