"""The corpus pipeline, stage by stage."""

import sys
from pathlib import Path

import corpus_pipeline
from pyspark.sql import functions as F

from placeloom.llm import jaccard
from placeloom.llm.common import table

sys.path.insert(0, str(Path(__file__).parent))
from contamination import contaminated  # noqa: E402


def test_stages_keep_columns_and_clean_rows(spark, sf):
    docs = table(spark, sf, "documents").withColumn("extra", F.lit(1))
    before = docs.count()
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf).cache()
        assert out.columns == docs.columns, name
        assert out.count() <= docs.count()
        if name == "ngram_jaccard_join":
            assert jaccard.jaccard_components(out).where("doc_id <> component_id").count() == 0
        if name == "benchmark_decontamination":
            kept = {r.doc_id for r in out.collect()}
            items = [r.text for r in table(spark, sf, "benchmark").collect()]
            for r in docs.collect():
                assert (r.doc_id in kept) == (not contaminated(r.text or "", items))
        docs = out
    assert 0.5 * before < docs.count() <= before
    last = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert last.count() == docs.count() and last.where("NOT round_trip").count() == 0


def test_run(spark, sf):
    assert corpus_pipeline.run(spark, sf).count() > 0


def test_null_ids_and_repeats(spark, sf):
    text = " ".join(f"w{i}" for i in range(40))
    rows = [(1, text), (1, text), (2, text + " x"), (None, "alone here"), (None, None), (7, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"))
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name == "ngram_jaccard_join":
            assert sorted(str(r.doc_id) for r in docs.collect()) == ["1", "7", "None", "None"]
    assert docs.count() == 4
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, table(spark, sf, "documents").limit(0), sf).count() == 0



def test_rows_of_one_id_and_of_none(spark, sf):
    text, other = (" ".join(f"{c}{i}" for i in range(40)) for c in "vw")
    rows = [(1, text), (1, other), (2, other + " x"), (None, text + " y"), (None, "alone here"), (None, "alone here"), (3, "alone here now that we are"), (5, ""), (5, "")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").select("doc_id", "text", F.lit("en").alias("lang"), F.lit("s").alias("source"), F.lit(1).cast("bigint").alias("n_chars"), F.lit(2).alias("key"))
    out = corpus_pipeline.drop_near_duplicates(spark, docs, sf)
    assert out.columns == docs.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted([("1", text), ("1", other), ("None", "alone here"), ("3", "alone here now that we are"), ("5", ""), ("5", "")])
