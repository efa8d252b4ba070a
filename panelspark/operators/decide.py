"""From signals to a decision that would rather abstain: combination, stability over sizes, reason codes, review, gates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.numeric import js_round, median, spread

DISAGREE, UNSTABLE, SYMMETRIC, LIMIT, SMALL = 2.0, 3.0, 0.9, 5.0, 0.1  # fixed values: thresholds in percent, and the least symmetry score


def entries(size: float, centre: float, mirror: bool = False, **signals: Column) -> Column:
    """Signals of one axis as array<struct(name, value)>: percent from each coordinate to the centre; null ones drop out.

    mirror negates the values, as right-to-left contexts do with x.
    """
    sign = -1 if mirror else 1
    made = [F.when(c.isNotNull() & ~F.isnan(c), F.struct(F.lit(n).alias("name"), (sign * (centre - c) / size * 100).alias("value"))) for n, c in signals.items()]
    return F.filter(F.array(*made), lambda e: e.isNotNull())


def combine(found: Column) -> Column:
    """struct(status, reason, n, consensus, spread, structural_spread, band) of an axis's entries.

    Three finite signals at least; the median decides; signals other than the edge may not differ by over 2 percent.
    """
    usable = F.filter(found, lambda e: e["value"].isNotNull() & ~F.isnan(e["value"]) & (F.abs(e["value"]) < float("inf")))
    values = F.transform(usable, lambda e: e["value"])
    structural = F.transform(F.filter(usable, lambda e: e["name"] != "edge"), lambda e: e["value"])
    enough = F.size(usable) >= 3
    wide = F.when(F.size(structural) >= 2, spread(structural)).otherwise(spread(values))
    band = F.when(wide > DISAGREE, "conflict").when(spread(values) <= 0.5, "strong").otherwise("mixed")
    m = median(values)
    status = F.when(~enough | (band == "conflict"), "ABSTAIN").when(F.abs(m) < SMALL, "NO_CHANGE").otherwise("REVIEW")
    reason = F.when(~enough, "insufficient-signals").when(band == "conflict", "signals-disagree")
    only = lambda c: F.when(enough, c)
    return F.struct(status.alias("status"), reason.alias("reason"), F.size(usable).alias("n"), only(js_round(m, 6)).alias("consensus"), only(js_round(spread(values), 6)).alias("spread"), only(js_round(wide, 6)).alias("structural_spread"), only(band).alias("band"))


def ensemble(x: Column, y: Column, x_by_size: Column, y_by_size: Column) -> Column:
    """struct(status, reason, dx, dy, band) from both axes and the consensus of each at every size."""
    def swing(by):
        known = F.filter(F.transform(by, lambda s: s["consensus"]), lambda v: v.isNotNull())
        return F.when(F.size(known) > 0, js_round(spread(known), 6))

    shaky = (F.coalesce(swing(x_by_size), F.lit(float("inf"))) > UNSTABLE) | (F.coalesce(swing(y_by_size), F.lit(float("inf"))) > UNSTABLE)
    few = (x["reason"].eqNullSafe(F.lit("insufficient-signals"))) | (y["reason"].eqNullSafe(F.lit("insufficient-signals")))
    conflict = (x["status"] == "ABSTAIN") | (y["status"] == "ABSTAIN") | shaky
    return proposal(x["consensus"], y["consensus"], F.when(few, "insufficient-signals").when(conflict, "signals-disagree"), F.when(conflict, "conflict").when((x["band"] == "strong") & (y["band"] == "strong"), "strong").otherwise("mixed"))


def proposal(dx: Column, dy: Column, reason: Column, band: Column | None = None) -> Column:
    """A shift, unless there is a reason against it, it is out of range, or too small to matter."""
    far = F.sqrt(dx * dx + dy * dy)
    why = F.coalesce(reason, F.when(far.isNull(), "insufficient-signals"), F.when(far > LIMIT, "proposal-out-of-range"))
    status = F.when(why.isNotNull(), "ABSTAIN").when(far < SMALL, "NO_CHANGE").otherwise("REVIEW")
    shown = lambda v: F.when(status == "REVIEW", js_round(v, 6)).when(status == "NO_CHANGE", 0.0)
    return F.struct(status.alias("status"), F.coalesce(why, F.when(status == "NO_CHANGE", "within-tolerance")).alias("reason"), shown(dx).alias("dx"), shown(dy).alias("dy"), *([band.alias("band")] if band is not None else []))


def bounds_first(frame_x: Column, frame_y: Column, inner_x: Column, inner_y: Column) -> Column:
    """Whether a drawing sits off its frame as a whole: shares of the frame from box to frame centre, and from box to weight centre."""
    return (frame_x > 0.125) | (frame_y > 0.125) | ((frame_x > 0.01) & (inner_x < 0.005)) | ((frame_y > 0.01) & (inner_y < 0.005))


def reasons(**found: Column) -> Column:
    """Codes (underscores become dashes) of the conditions that hold, in the given order."""
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(code.replace("_", "-"))) for code, c in found.items()]), lambda c: c.isNotNull())


def pixel_offsets(dx: Column, dy: Column, sizes: Column) -> Column:
    """A shift in percent as pixels at each size, to four digits."""
    return F.transform(sizes, lambda s: F.struct(s.alias("size"), js_round(dx / 100 * s, 4).alias("dx"), js_round(dy / 100 * s, 4).alias("dy")))


def axis_action(final: Column, proposed: Column) -> Column:
    return F.when(F.abs(final) < 1e-9, "ZERO").when(F.abs(final - proposed) < 1e-9, "ACCEPT_PROPOSAL").otherwise("OVERRIDE")


def verification(clipped: Column, dx: Column, dy: Column, approved: Column, bound: Column) -> Column:
    """struct(status, codes): any failure fails, anything missing asks for review."""
    fails = reasons(post_correction_clipping=clipped, correction_out_of_range=(F.abs(dx) > LIMIT) | (F.abs(dy) > LIMIT), comparison_binding_mismatch=approved & bound.isNotNull() & ~bound)
    blocks = reasons(comparison_required=approved & bound.isNull(), review_approval_required=~approved)
    return F.struct(F.when(F.size(fails) > 0, "FAIL").when(F.size(blocks) > 0, "REVIEW_REQUIRED").otherwise("PASS").alias("status"), F.concat(fails, blocks).alias("codes"))


def apply_gate(**lineage: Column) -> Column:
    """Codes of lineage predicates that don't hold; applying needs all of them."""
    return reasons(**{code: ~F.coalesce(ok, F.lit(False)) for code, ok in lineage.items()})


def diagnosis(blocked: Column, abstained: Column, changed: Column) -> Column:
    return F.when(blocked, "unsafe-source").when(abstained, "manual-review").when(changed, "optical-offset").otherwise("balanced")
