"""Artifacts sealed by level: order and partitions don't matter, every edit is named."""

import pytest
from pyspark.sql import functions as F

from panelspark.operators import chain

KINDS = ["low", "middle", "high"]


def levels(spark, tables):
    text = chain.row_text(F.col("a"), F.col("b"))
    rows = [chain.level(k, i, spark.createDataFrame(t, "a int, b string").repartition(2), own=text) for i, (k, t) in enumerate(zip(KINDS, tables, strict=False))]
    return chain.union(rows).withColumn("study", F.lit("s"))


def checked(spark, recorded, now):
    found = levels(spark, now).select("study", "level", F.col("own").alias("found"))
    return chain.revalidate(chain.seal(levels(spark, recorded), KINDS, ["study"]).join(found, ["study", "level"], "left"), KINDS, ["study"])


@pytest.mark.parametrize("at", [0, 1, 2])
def test_the_first_edited_level_is_named(spark, at):
    tables = [[(1, "x"), (2, None), (2, None)], [(3, "y")], []]
    edited = [list(t) for t in tables]
    edited[at] = [*edited[at][:-1], (9, "z")]
    rows = {r.level: r for r in checked(spark, tables, edited).collect()}
    assert [rows[i].status for i in range(3)] == ["whole"] * at + ["edited"] + ["rests-on-edited"] * (2 - at)
    assert {r.first_edited for r in rows.values()} == {KINDS[at]}


def test_order_partitions_repeats_and_fields(spark):
    rows = [(i % 7, str(i % 5)) for i in range(100)]
    digest = lambda t, n: chain.level("k", 0, spark.createDataFrame(t, "a int, b string").repartition(n), own=chain.row_text(F.col("a"), F.col("b"))).first().own
    assert digest(rows, 1) == digest(rows[::-1], 5)
    assert digest(rows, 1) != digest(rows[1:], 1) != digest([*rows, rows[0]], 1)
    assert digest([(1, "1:x")], 1) != digest([(11, ":x")], 1) and digest([(1, None)], 1) != digest([(1, "")], 1) != digest([(1, "-")], 1)


def test_missing_levels_and_no_edits(spark):
    tables = [[(1, "x")], [(3, "y")], [(4, None)]]
    same = checked(spark, tables, tables).collect()
    assert {r.status for r in same} == {"whole"} and {r.first_edited for r in same} == {None}
    short = {r.level: r.status for r in checked(spark, tables, tables[:2]).collect()}
    assert short == {0: "whole", 1: "whole", 2: "edited"}


def test_a_seal_that_was_made_anew_doesnt_fit_the_one_below(spark):
    tables, other = [[(1, "x")], [(3, "y")], [(4, None)]], [[(2, "x")], [(3, "y")], [(4, None)]]
    mixed = chain.seal(levels(spark, tables), KINDS, ["study"]).where("level <> 1").unionByName(chain.seal(levels(spark, other), KINDS, ["study"]).where("level = 1"))
    found = levels(spark, tables).select("study", "level", F.col("own").alias("found"))
    got = {r.level: r.status for r in chain.revalidate(mixed.join(found, ["study", "level"]), KINDS, ["study"]).collect()}
    assert got == {0: "whole", 1: "edited", 2: "edited"}
