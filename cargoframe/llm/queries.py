"""Registered queries of the operators, over whole tables, with their digests."""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargoframe.llm import (alignment, decontaminate, fingerprints, hard_negatives, hilbert, html_extract, license_scan,
                            line_rules, packing, signature_tree, substring, toxicity, wavelet)
from cargoframe.sources.scratch import place


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"), keep_ids=False)
    return pieces.drop("token_ids")


def op2_wavelet(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = place(spark, "wavelet")
    wavelet.write_shards(_read(spark, sf_dir, "documents"), path, _tokenizer("word_bpe_49k.json"))
    return wavelet.read_documents(spark, path, keep_ids=False).drop("token_ids")


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan(_read(spark, sf_dir, "documents")).drop("spans")


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substring.remove_repeats(_read(spark, sf_dir, "documents")).select(
        "doc_id", "n_words", "n_removed", "kept_sha256")


def op5_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_extract.extract(_read(spark, sf_dir, "pages"))


def op6_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signature_tree.near_duplicates(_read(spark, sf_dir, "documents"), k=4, num=85, den=100)


def op7_hilbert_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hilbert.assign(_read(spark, sf_dir, "documents")).withColumn("law", F.lit("bytes")).withColumn(
        "grown_shard", F.lit(None).cast("int"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = toxicity.train(docs, _read(spark, sf_dir, "labels"))
    scored = toxicity.score(docs, model)
    return scored.select(
        "doc_id", (F.crc32(F.col("doc_id").cast("string")) % 5 == 0).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op9_line_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_rules.judge(_read(spark, sf_dir, "documents"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.find_items(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op11_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = fingerprints.edits(_read(spark, sf_dir, "documents"))
    return made.select(
        "doc_id", "n_chars", F.sha2(F.encode("edited_text", "UTF-8"), 256).alias("edited_sha256"),
        fingerprints.as_text(F.col("fingerprint")).alias("fingerprint"),
        fingerprints.as_text(F.col("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings")
    shifted = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine(rows.withColumn("label", shifted))


def op13_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = alignment.align(_read(spark, sf_dir, "documents"), _tokenizer("byte_bpe_50k.json"),
                           _tokenizer("piece_bpe_32k.model"), keep_groups=False, keep_ids=False)
    return made.documents.drop("groups")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (
    op1_packing, op2_wavelet, op3_license_scan, op4_substring_dedup, op5_html_extract, op6_ngram_jaccard,
    op7_hilbert_shards, op8_toxicity, op9_line_rules, op10_decontaminate, op11_minhash, op12_hard_negatives,
    op13_alignment, pipeline)}
ORACLES: dict[str, str] = {
    "op12_hard_negatives": """
WITH usable AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
   list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
   AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, a.label = r.label AS same,
   CAST(list_inner_product(a.q, r.q) AS BIGINT) AS score
  FROM usable a JOIN usable r ON a.vec_id % 100 = 0 AND a.vec_id <> r.vec_id),
positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, CAST(row_number() OVER best AS INT) AS rank, vec_id AS negative_id,
 positive_score, score AS negative_score
FROM positives p JOIN scores s ON s.anchor_id = p.anchor_id AND NOT s.same
 AND 80 * positive_score <= 100 * score AND score <= positive_score
WINDOW best AS (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id)
QUALIFY row_number() OVER best <= 5""",
}
