"""The pipeline's stages on the smallest tables."""

from pyspark.sql import functions as F

import corpus_pipeline
from cargoframe.llm.queries import QUERIES


def test_stages(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf)
        assert out.columns == docs.columns
        kept = out.count()
        assert 0 < kept <= before, name
        docs, before = out, kept
    pieces = corpus_pipeline.pack_sequences(spark, docs, sf)
    assert pieces.select("doc_id").distinct().count() == before


def test_cut_repeats_carries_the_rows_with_their_text(spark):
    """Null and repeated ids, repeated rows and clashing names; the texts meet their marks in the only join."""
    line = " ".join(f"w{i}" for i in range(60))
    rows = [(1, line, 359, "a", 1), (2, f"x\n{line}  y z", 359, "b", 2), (2, f"x\n{line}  y z", 359, "c", 3), (2, "other", 5, None, 4),
            (3, line, 359, "d", 5), (4, None, None, "e", 6), (4, "", 0, "f", None), (None, "  kept\n as it is ", 16, "g", 7)]
    docs = spark.createDataFrame(rows, "doc_id int, text string, n_chars int, kept_text string, carried long")
    docs = docs.withColumn("n_words", F.struct(F.col("carried").alias("n"), F.array("kept_text").alias("list")))
    out = corpus_pipeline.cut_repeats(spark, docs, "")
    assert out.dtypes == docs.dtypes
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Join ") == 1
    want = [(1, line, 359, "a", 1), (2, "x\ny z", 5, "b", 2), (2, "x\ny z", 5, "c", 3), *rows[3:4], *rows[5:]]
    assert sorted(map(repr, map(tuple, out.drop("n_words").collect()))) == sorted(map(repr, want))
    assert all((r.n_words.n, r.n_words.list) == (r.carried, [r.kept_text]) for r in out.collect())


def test_registered():
    assert [n.split("_")[0] for n in QUERIES] == [*[f"op{i}" for i in range(1, 14)], "pipeline"]
