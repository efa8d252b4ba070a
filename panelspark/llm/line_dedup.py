"""Line dedup: lines whose normalised form stands in many documents go from every document.

Native: DataFrame functions only. Lines are exploded as (document, position, key hash) without their text, so the
two shuffles by key move some 60 bytes a line; the text moves once, to meet the positions that its document loses.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE

SALTS = 32


def line_key(line: Column) -> Column:
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    return F.translate(F.btrim(line, F.lit(ASCII_SPACE)), upper, lower)


def drop_common_lines(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped added; other columns pass through (these three names are replaced).

    A text is split at line feeds; null and empty texts are one empty line. A line's key is the line without white
    space at its ends, A-Z lower-cased. Keys of at least min_chars code points (empty keys never count) that stand in
    at least min_docs different documents lose all their lines. Rows that share an id are one document for the count;
    each row is cut by its own lines. A null id is one more document. A document that loses every line keeps ''.
    """
    lines = F.split(F.coalesce(F.col(text_col), F.lit("")), "\n", -1)
    base = docs.drop("kept_text", "n_lines", "n_dropped")
    row = F.xxhash64(F.coalesce(F.col(text_col), F.lit("")))
    keyed = base.select(
        F.col(id_col).alias("_id"), row.alias("_row"),
        F.posexplode(F.transform(lines, lambda line: F.when(F.char_length(line_key(line)) >= max(1, min_chars), F.md5(line_key(line).cast("binary"))))).alias("_pos", "_key"),
    ).where(F.col("_key").isNotNull())
    common = keyed.groupBy("_key").agg(F.countDistinct(F.struct("_id")).alias("_n")).where(F.col("_n") >= min_docs).select("_key")
    # a line that a third of all documents share would be one task's join: keys are met in SALTS parts, by document
    keyed = keyed.withColumn("_salt", F.pmod(F.xxhash64("_id", "_row"), F.lit(SALTS)).cast("int"))
    common = common.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    lost = keyed.join(common, ["_key", "_salt"], "left_semi").groupBy("_id", "_row").agg(F.collect_set("_pos").alias("_lost"))
    out = base.withColumn("_row", row).alias("d").join(lost.alias("l"), F.col(f"d.{id_col}").eqNullSafe(F.col("l._id")) & (F.col("d._row") == F.col("l._row")), "left")
    gone = F.coalesce(F.col("l._lost"), F.array().cast("array<int>"))
    n = F.size(lines)
    # transform over a one-element array binds the split lines once; array_except is hashed, so the cut is linear
    kept = F.transform(F.array(lines), lambda split: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(split) - 1), gone), lambda i: F.get(split, i)), "\n"))[0]
    text = F.when(F.size(gone) == 0, F.coalesce(F.col(f"d.{text_col}"), F.lit(""))).otherwise(kept)
    return out.select(*[F.col(f"d.{c}") for c in base.columns], text.alias("kept_text"), n.cast("long").alias("n_lines"), F.size(gone).cast("long").alias("n_dropped"))
