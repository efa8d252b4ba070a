"""From raw documents to packed training sequences: toxicity, line dedup, near-dedup, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns a table with the columns of its input, but for the last, which returns
pieces. A stage works on all that its predecessor kept. SQL can't express the learned and hashed stages, so run() is
tested against a brute-force version.

In every stage null texts count as empty ones, very long texts are read whole, columns beside doc_id and text pass through
untouched whatever their names, rows come and go one by one, repeated ones too, and an empty table gives an empty table.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.llm import decontaminate, line_dedup, near_dedup, packing, toxicity
from panelspark.llm.common import crc_of, forget, keep, shuffle_parts, ship, table
from panelspark.llm.queries import tokenizer_path

ORACLE_SQL = None


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that score 0.7 or more go, each by its own text; the lexicon is learned from labels outside of the held-out third.

    An empty text has no match and stays. A score of 0.7 itself is rejected. Labels of ids that documents lack teach nothing.
    """
    labels = table(spark, sf_dir, "labels").where(crc_of(F.col("doc_id")) % 3 != 1)
    return toxicity.drop_toxic(docs, toxicity.learn(docs, labels)).repartition(shuffle_parts(spark))  # even parts for the next stage


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten or more documents share go; text is what is left (null becomes '') and n_chars follows it.

    Rows that share an id are one document to the count; a row that loses all its lines stays, with an empty text.
    """
    other = {c: f"_{i}" for i, c in enumerate(docs.columns) if c not in ("doc_id", "text")}  # clear of the names that the operator adds
    cut = line_dedup.drop_common_lines(docs.withColumnsRenamed(other))
    columns = {"text": F.col("kept_text").alias("text"), "n_chars": F.char_length("kept_text").cast("long").alias("n_chars")}
    return cut.select(*[columns[c] if c in columns else F.col(other.get(c, c)).alias(c) for c in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates the document with the smallest id stays.

    Texts without a word are nobody's duplicates and stay, as do rows without an id. Rows that share an id are one
    document here: all of them stay or go.
    """
    found = near_dedup.near_duplicates(docs, words=5, percent=80)
    return docs.join(found.where("NOT kept").select("doc_id").distinct(), "doc_id", "left_anti").select(*docs.columns)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that hold half of a benchmark item's tokens or more go, each by its own text; items without a token reject none."""
    return decontaminate.drop_contaminated(docs, table(spark, sf_dir, "benchmark")).select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """What is left, in sequences of 2048 tokens; a row without a text or an id is packed like any other."""
    return packing.pack(docs, tokenizer_path("word_bpe_49k.json"), capacity=2048)


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("near_dedup", drop_near_copies),
    ("decontamination", drop_leaks),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each stage's rows are kept until those of the next one are: two copies of the corpus at most."""
    docs, kept = table(ship(spark), sf_dir, "documents"), None
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i + 1 < len(STAGES):
            docs, before = keep(docs), kept
            if before is not None:
                forget(before)
            kept = docs
    return docs
