"""Readers and writers of study artifacts: JSON and JSONL with closed schemas, manifests, limits, atomic files."""

from __future__ import annotations

import json
import os

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.lineage import key_violations
from . import commits

CANDIDATE = "struct<id: string, candidate_sha256: string, dx: double, dy: double>"
FEATURES = "struct<proposal: double, centroid_offset: double, bearing_imbalance: double, extent: double, orthogonal_extent: double, components: int>"
#: A preference row as JSON.
DATUM = (
    "schema_version int, non_authorizing boolean, study_id string, study_digest string, source_sha256 string, trial_id string, rater_id string, axis string, choice string, context string, rtl boolean, target_sizes array<int>, themes array<string>, "
    f"candidate_a {CANDIDATE}, candidate_b {CANDIDATE}, preferred_candidate_id string, tie boolean, abstain boolean, pairwise_winner_eligible boolean, source_features {FEATURES}"
)
#: How much one corpus may hold.
LIMITS = {"bytes": 64 << 20, "sources": 256, "files": 1024}


def read_json(spark: SparkSession, paths, schema: str) -> DataFrame:
    """Whole-file JSON documents; what doesn't parse keeps its text in _corrupt_record."""
    return spark.read.schema(f"{schema}, _corrupt_record string").option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(paths)


def _parsed(lines: DataFrame, schema: str, keys: list[str]) -> DataFrame:
    """Lines that aren't blank as rows, with the codes that each breaks (unparsed, unknown-key, missing-key)."""
    parsed = lines.where(F.trim(F.regexp_replace("value", r"[\r\t]", "")) != "").withColumn("row", F.from_json("value", schema, {"mode": "PERMISSIVE"}))
    unknown, missing = key_violations(F.col("value"), keys)
    bad = F.json_object_keys("value").isNull()
    codes = F.filter(F.array(F.when(bad, F.lit("unparsed")), F.when(~bad & (F.size(unknown) > 0), F.lit("unknown-key")), F.when(~bad & (F.size(missing) > 0), F.lit("missing-key"))), lambda c: c.isNotNull())
    return parsed.withColumn("violations", codes)


def read_jsonl(spark: SparkSession, paths, schema: str, keys: list[str]) -> DataFrame:
    """JSON lines with a closed key set: the schema's columns, path, and violations (unparsed, unknown-key, missing-key).

    Lines are read as text first, as JSON readers pass over unknown keys in silence. Blank lines are skipped; LF and CRLF end a line.
    """
    lines = spark.read.text(paths).select("value", F.col("_metadata.file_path").alias("path"))
    return _parsed(lines, schema, keys).select("row.*", "path", "violations")


def line_errors(spark: SparkSession, paths, schema: str, keys: list[str]) -> DataFrame:
    """path, line (from 1, blank ones counted) and code of everything that read_jsonl finds wrong, for files of any number of splits.

    A line's place in its split follows from row ids, which grow within a split by one; the lines of the splits before it are
    counted in a scan without texts. Only broken lines are joined with these counts.
    """
    place = (F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("split"), F.monotonically_increasing_id().alias("id"))
    text = spark.read.text(paths)
    splits = text.select(*place).groupBy("path", "split").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    earlier = Window.partitionBy("path").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    before = splits.select("path", "split", (F.coalesce(F.sum("n").over(earlier), F.lit(0)) - F.col("first") + 1).alias("shift"))
    broken = _parsed(text.select("value", *place), schema, keys).where(F.size("violations") > 0).select("path", "split", "id", "violations")
    return broken.join(before, ["path", "split"]).select("path", (F.col("id") + F.col("shift")).alias("line"), F.explode("violations").alias("code"))


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """One row a source and preference file: source_id, family_id, group_id, audit, preferences (paths beside the manifest's)."""
    folder = os.path.dirname(path)
    doc = read_json(spark, path, "schema_version int, sources array<struct<source_id: string, family_id: string, group_id: string, audit: string, preferences: array<string>>>")
    rows = doc.select(F.explode("sources").alias("s")).select("s.*").withColumn("preferences", F.explode("preferences"))
    return rows.withColumn("audit", F.concat(F.lit(f"{folder}/"), "audit")).withColumn("preferences", F.concat(F.lit(f"{folder}/"), "preferences"))


def read_corpus(spark: SparkSession, manifest_path: str, schema: str, keys: list[str]) -> DataFrame:
    """Every row of every preference file of a manifest, with its source, family and group."""
    manifest = read_manifest(spark, manifest_path)
    paths = [r[0] for r in manifest.select("preferences").distinct().collect()]  # at most LIMITS["files"] names
    if len(paths) > LIMITS["files"]:
        raise ValueError(f"more than {LIMITS['files']} files")
    rows = read_jsonl(spark, paths, schema, keys).withColumn("_file", F.regexp_replace("path", r"\Afile:/*", "/"))
    return rows.join(F.broadcast(manifest.withColumn("_file", F.regexp_replace("preferences", r"\Afile:/*", "/"))), "_file").drop("_file", "preferences", "audit", "path")


def limit_violations(spark: SparkSession, paths, n_sources: int) -> list[str]:
    """Codes of the limits that a corpus breaks."""
    size = spark.read.format("binaryFile").load(paths).select("path", "length").agg(F.sum("length"), F.count(F.lit(1)), F.countDistinct("path")).first()
    rules = (("corpus-too-large", (size[0] or 0) > LIMITS["bytes"]), ("too-many-files", size[1] > LIMITS["files"]), ("repeated-file", size[1] != size[2]), ("too-many-sources", n_sources > LIMITS["sources"]))
    return [code for code, bad in rules if bad]


def read_markup(spark: SparkSession, paths) -> DataFrame:
    """path, byte_length, sha256 and text of vector documents."""
    return spark.read.format("binaryFile").load(paths).select("path", F.col("length").alias("byte_length"), F.sha2("content", 256).alias("sha256"), F.decode("content", "UTF-8").alias("markup"))


# --- sinks ------------------------------------------------------------------------------------------------------------


def write_jsonl(df: DataFrame, path: str) -> None:
    """One JSON object a line, nulls kept; an existing target is an error."""
    df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("value")).write.mode("errorifexists").text(path)


#: How many rows a report may have; more belong into a table.
REPORT_ROWS = 10_000


def _small(df: DataFrame) -> list:
    rows = df.limit(REPORT_ROWS + 1).collect()
    if len(rows) > REPORT_ROWS:
        raise ValueError(f"a report of more than {REPORT_ROWS} rows")
    return rows


def markdown(df: DataFrame) -> str:
    """A small report as a Markdown table."""
    rows = _small(df)
    head = "| " + " | ".join(df.columns) + " |\n| " + " | ".join("---" for _ in df.columns) + " |"
    return "\n".join([head, *("| " + " | ".join("" if v is None else str(v) for v in r) + " |" for r in rows)]) + "\n"


def write_report(df: DataFrame, path: str | None) -> str:
    """A result of at most REPORT_ROWS rows as JSON or, by its extension, Markdown; to the caller alone without a path."""
    body = markdown(df) if path and path.lower().endswith((".md", ".markdown")) else json.dumps([r.asDict(recursive=True) for r in _small(df)], indent=2, default=str) + "\n"
    if path:
        commits.put(df.sparkSession, path, body.encode())
    return body


def same_file(a: str, b: str) -> bool:
    return os.path.realpath(a) == os.path.realpath(b) or os.path.exists(a) and os.path.exists(b) and os.path.samefile(a, b)


def guard_output(inputs: list[str], output: str) -> None:
    if any(same_file(i, output) for i in inputs):
        raise ValueError("output would overwrite an input")
