"""The engine's facts derived from the driver's tables: votes, pairs, holdout cases and votes, rasters, candidates."""

from __future__ import annotations

import os
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import contracts, raster, ranker, votes

REPO = str(Path(__file__).resolve().parents[2])
PAIR = ["k", "source_no", "family_no", "group_no", "axis", "left_pct", "right_pct", "proposal_pct"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    env = spark.sparkContext.environment  # Python workers import this package from where the driver has it
    have = env.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if REPO not in have.split(os.pathsep):
        env["PYTHONPATH"] = os.pathsep.join(x for x in (REPO, have) if x)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a vote, valid or not."""
    # k is taken out by a generator of one row: rules on it aren't pushed below, so each text is parsed once
    k = F.explode(F.array(F.get_json_object("props", "$.k").cast("int")))
    e = table(spark, sf_dir, "events").select("event_id", "ts", "user_id", "event_type", k.alias("k"))
    slot = F.floor(F.col("k") / 20).cast("int")
    straight = F.col("event_id") % 2 == 0
    left = slot * 0.5 - 1.25
    right = slot * 0.5 - 0.75
    choice = F.when(F.col("event_type") == "click", "A").when(F.col("event_type") == "view", "B").when(F.col("event_type") == "purchase", "TIE").when(F.col("event_type") == "signup", "ABSTAIN")
    return e.select(
        "event_id", "ts", "user_id", F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("rater"), "k", (F.col("k") % 10).alias("source_no"), (F.col("k") % 10 % 5).alias("family_no"), (F.col("k") % 10).alias("group_no"),
        F.when(F.floor(F.col("k") / 10) % 2 == 0, "x").otherwise("y").alias("axis"), left.alias("left_pct"), right.alias("right_pct"), ((F.col("k") % 10 * 3 - 15) / 10.0).alias("proposal_pct"),
        F.when(straight, left).otherwise(right).alias("a"), F.when(straight, right).otherwise(left).alias("b"), choice.alias("choice"),
        F.when(F.floor(F.col("event_id") / 2) % 2 == 0, 16).otherwise(24).alias("size"), F.when(F.floor(F.col("event_id") / 4) % 2 == 0, "light").otherwise("dark").alias("theme"),
    )


def violations():
    c = F.col
    return contracts.vote_rules(c("choice"), c("rater"), c("axis"), c("a"), c("b"), c("proposal_pct"))


def valid_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    good, _ = contracts.quarantine(raw_votes(spark, sf_dir), violations())
    return good.withColumn("vote", votes.canonical_vote(F.col("choice"), F.col("a"), F.col("b")))


def unique_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rater's first vote on each pair."""
    return votes.first_per(valid_votes(spark, sf_dir), ["user_id", "k"], ["ts", "event_id"])


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return votes.pair_votes(unique_votes(spark, sf_dir), PAIR)


def weighted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs with weights and features."""
    w = votes.sample_weights(pairs(spark, sf_dir))
    return w.withColumn("x", ranker.feature_difference(F.col("left_pct"), F.col("right_pct"), F.col("proposal_pct")))


def all_cases(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts as cases: outputs is a map of policy to struct(status, percent)."""
    p = table(spark, sf_dir, "part")
    size = F.col("p_size")
    quiet = size % 11 == 0
    out = lambda percent, off: F.struct(F.when(off, "ABSTAIN").otherwise("VALUE").alias("status"), F.when(~off, percent).alias("percent"))
    never = F.lit(False)
    outputs = F.create_map(
        F.lit("zero"), out(F.lit(0.0), never), F.lit("centroid"), out((size % 5 - 2) / 2.0, never), F.lit("ensemble"), out((size % 7 - 3) / 2.0, quiet), F.lit("learned"), out((size % 9 - 4) / 2.0, quiet),
    )
    brand = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    return p.select(F.col("p_partkey").alias("case_id"), F.col("p_partkey").cast("string").alias("source_id"), F.col("p_brand").alias("family"), F.col("p_type").alias("group"), brand.alias("brand_no"), outputs.alias("outputs"))


def holdout(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_cases(spark, sf_dir).where("brand_no > 10")


def training(spark: SparkSession, sf_dir: str) -> DataFrame:
    return all_cases(spark, sf_dir).where("brand_no <= 10")


def case_votes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A supplier's first line of each part as its vote."""
    flag, line = F.col("l_returnflag"), F.col("l_linestatus")
    choice = F.when(flag == "A", "A").when(flag == "R", "B").when(line == "O", "TIE").otherwise("ABSTAIN")  # told before rows are shuffled: they are smaller
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_partkey").alias("case_id"), F.col("l_suppkey").alias("rater"), choice.alias("choice"))
    return votes.first_per(li, ["case_id", "rater"], ["l_orderkey", "l_linenumber"]).select("case_id", "rater", "choice")


def rasters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select("vec_id", raster.alpha_of(F.col("embedding")).alias("alpha"))


#: Directions of an outline's sixteen corners, anticlockwise.
CORNERS = [(2, 0), (2, 1), (2, 2), (1, 2), (0, 2), (-1, 2), (-2, 2), (-2, 1), (-2, 0), (-2, -1), (-2, -2), (-1, -2), (0, -2), (1, -2), (2, -2), (2, -1)]


def outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A star of sixteen corners round the middle of a view of 24 x 24, as far out as a vector's first components say; some leave the view."""
    far = lambda k: F.least(F.lit(1.0), 4 * F.abs(F.coalesce(F.nanvl(F.get(F.col("embedding"), k).cast("double"), F.lit(0.0)), F.lit(0.0)))) + 0.1
    corners = F.array(*[F.struct((12 + 6 * dx * far(k)).alias("x"), (12 + 6 * dy * far(k)).alias("y")) for k, (dx, dy) in enumerate(CORNERS)])
    return table(spark, sf_dir, "embeddings").select("vec_id", F.array(corners).alias("rings"))
