"""Training-text pipeline: five stages over the documents, each on what the one before kept.

Every stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read
again as the next stage's docs. All but the last return the columns of documents; the last
returns the pieces of the packed sequences.
"""

from pyspark.sql import DataFrame, SparkSession, functions as F

from cargoframe.llm import decontaminate, packing, signature_tree, substring, toxicity
from cargoframe.sources.scratch import settle


def _tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier gives a score below one half. Rows without an id stay in play."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    model = toxicity.train(docs, labels)
    return toxicity.score(docs.withColumnRenamed("score", "_score") if "score" in docs.columns else docs, model).filter(
        "score < 0.5").drop("score").withColumnsRenamed({"_score": "score"} if "score" in docs.columns else {})


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, the one with the least id, of every group linked at 0.8 on five-word shingles."""
    return signature_tree.keep_one(docs, k=5, num=80, den=100)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the passages of 50 words or more that an earlier document holds.

    n_chars follows the text; a document that loses all its words goes.
    """
    rest = [c for c in docs.columns if c != "text"]
    cut = substring.remove_repeats(docs, window=50, carry=rest)
    changed = F.col("n_removed") > 0
    values = {c: F.col("carried").getField(c) for c in rest} | {"text": F.col("kept_text")}
    if "n_chars" in rest:
        values["n_chars"] = F.when(changed, F.char_length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(
            values["n_chars"])
    return cut.filter(~(changed & (F.col("n_removed") == F.col("n_words")))).select(
        *(values[c].alias(c) for c in docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item."""
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontaminate.drop_found(docs, benchmark).select(*docs.columns)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 1024 ids, with the ids."""
    return packing.pack(docs, _tokenizer("byte_bpe_50k.json"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard", drop_near_duplicates),
    ("substring_dedup", cut_repeats),
    ("decontamination", drop_contaminated),
    ("packing", pack_sequences),
]

#: The classifier and the packing have no SQL form; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = settle(stage(spark, docs, sf_dir), name)
    return docs
