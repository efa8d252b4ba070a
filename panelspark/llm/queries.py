"""The corpus queries op1..op13 over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import alignment, decontaminate, html_text, lexicon, line_dedup, near_dedup, nearest, packing, recurrent_lm, substring_dedup, token_counts, toxicity, whitening
from .common import crc_of, table


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return str(public_tokenizers.path(name))


def op1_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores every document; labels of rows with crc32(id) mod 3 = 1 are held out."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_of(F.col("doc_id")) % 3 == 1
    labels = table(spark, sf_dir, "labels").where(~held_out).select("doc_id", "toxic")
    lexicon = toxicity.learn(docs, labels)
    scored = toxicity.score(docs, lexicon)
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted")


def op2_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 nearest rows of every row whose vec_id is divisible by 20."""
    return nearest.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op3_recurrent_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Learns from documents whose crc32(id) mod 10 isn't 0, and scores all."""
    held_out = crc_of(F.col("doc_id")) % 10 == 0
    out = recurrent_lm.score_documents(table(spark, sf_dir, "documents"), ~held_out)
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


def op4_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring_dedup.drop_repeats(table(spark, sf_dir, "documents"), least=50)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))


def op7_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it holds; clean documents have no row."""
    return decontaminate.contaminated_pairs(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op8_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(table(spark, sf_dir, "pages"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = line_dedup.drop_common_lines(docs)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("kept_text").cast("binary"), 256).alias("kept_sha256"))


def op10_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles of four words, as its contract fixes; the operator's own default is five."""
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), words=4, percent=80)


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row for each vector and component."""
    out = whitening.whiten(table(spark, sf_dir, "embeddings"), components=32)
    each = F.posexplode(F.arrays_zip("whitened", "explained")).alias("at", "value")
    out = out.select("vec_id", "n", F.col("deviation").try_cast("long").alias("deviation"), "identity_error", each)
    return out.select("vec_id", (F.col("at") + 1).alias("component"), "n", "deviation", "value.whitened", "value.explained", "identity_error")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return alignment.align(table(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def op13_bpe_lexicon(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, file = table(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json")
    out = lexicon.decode(lexicon.encode(docs, file, lexicon.build_lexicon(docs, file)), file)
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))


OP9_SQL = r"""
WITH d AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS pos FROM d),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
c AS (SELECT key FROM k WHERE key <> '' GROUP BY key HAVING count(DISTINCT doc_id) >= 10),
m AS (SELECT k.*, c.key IS NOT NULL AS gone FROM k LEFT JOIN c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (WHERE gone))::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""


def queries() -> dict:
    return {f.__name__: f for f in (op1_toxicity, op2_nearest, op3_recurrent_lm, op4_token_counts, op5_substring_dedup, op6_packing, op7_decontaminate, op8_html_text, op9_line_dedup, op10_near_dedup, op11_whitening, op12_alignment, op13_bpe_lexicon)}


def oracle_sql() -> dict[str, str]:
    return {"op9_line_dedup": OP9_SQL}
