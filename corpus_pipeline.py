"""The corpus pipeline: five stages, each one operator over all that the stage before it kept.

Toxic documents go; of every group of near duplicates one document stays; documents that hold
benchmark passages go; personal data gets surrogates; the texts become token ids.

All stages but the last keep the columns of ``documents``, extra ones included; the last returns
doc_id, lang, source, n_tokens, ids and round_trip.  Rows are judged by their text, so rows that
share a doc_id or have none are told apart.  Empty tables pass through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from placeloom.llm import bpe, decontamination, jaccard, pii, toxicity
from placeloom.llm.common import free, materialize, release, table

#: Keys of rejected documents that are broadcast; more are joined by an exchange.
KEYS_BOUND = 1_000_000


def _few(written: DataFrame) -> DataFrame:
    """A written table of keys, broadcast if it has few rows."""
    return F.broadcast(written) if written.count() <= KEYS_BOUND else written


def _without(docs: DataFrame, keys: DataFrame, *on) -> DataFrame:
    """``docs`` less the rows whose values ``on`` are a row of ``keys`` (columns k0, k1, ...)."""
    same = [value.eqNullSafe(F.col(f"k{i}")) for i, value in enumerate(on)]
    return docs.join(_few(materialize(keys.distinct(), "rejected")), same, "left_anti")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier does not reject."""
    kept = toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"))
    release(spark)
    return kept


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of every group of linked texts the row with the smallest doc_id, rows without one last; texts without words stay.

    Rows whose doc_id others share, or is missing, are linked under the hash of their text; of
    rows that agree in doc_id and text one stays.
    """
    doubtful = docs.groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1 OR doc_id IS NULL")
    if not doubtful.limit(1).count():
        linked = jaccard.jaccard_components(docs).where("doc_id <> component_id")
        kept = _without(docs, linked.select(F.col("doc_id").alias("k0")), F.col("doc_id"))
        release(spark)
        return kept
    key = F.xxhash64(F.coalesce(F.col("text").cast("string"), F.lit("")))
    found = jaccard.jaccard_components(docs.select(key.alias("doc_id"), "text")).where("n_shingles > 0")
    found = materialize(found.select(F.col("doc_id").alias("h"), F.col("component_id").alias("grp")), "groups")
    several = found.groupBy("grp").agg(F.count("*").alias("n")).where("n > 1").select("grp")
    members = _few(materialize(found.distinct().join(several, "grp"), "members"))
    rows = docs.select(key.alias("h"), "doc_id").join(members, "h")
    rows = materialize(rows.groupBy("grp", "h", "doc_id").agg(F.count("*").alias("n")), "member-rows")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "h")
    first = rows.groupBy("grp").agg(F.min(order).alias("f"))
    judged = rows.join(first, "grp").withColumn("stays", (order == F.col("f")) | (F.col("doc_id").isNull() & F.col("f.none") & (F.col("h") == F.col("f.h"))))
    judged = materialize(judged.select("h", "doc_id", "n", "stays"), "judged")
    kept = _without(docs, judged.where("NOT stays").select(F.col("h").alias("k0"), F.col("doc_id").alias("k1")), key, F.col("doc_id"))
    repeated = materialize(judged.where("stays AND n > 1").select(F.col("h").alias("k0"), F.col("doc_id").alias("k1")), "repeated")
    release(spark)
    if not repeated.limit(1).count():
        return kept
    mark = free(docs, "key")
    kept = kept.withColumn(mark, key)
    same = [F.col(mark) == F.col("k0"), kept["doc_id"].eqNullSafe(F.col("k1"))]
    once = kept.join(_few(repeated), same, "left_semi").dropDuplicates([mark, "doc_id"])
    return kept.join(_few(repeated), same, "left_anti").unionByName(once).drop(mark)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of which less than a twentieth lies in passages of the benchmark."""
    # the text's hash stands for the row: ids may be missing
    keyed = docs.select(F.xxhash64("text").alias("doc_id"), "text")
    found = decontamination.summary(decontamination.decontaminate(keyed, table(spark, sf_dir, "benchmark")))
    kept = _without(docs, found.where("contaminated").select(F.col("doc_id").alias("k0")), F.xxhash64("text"))
    release(spark)
    return kept


def replace_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with surrogates in their texts; n_chars follows the text where it changed."""
    count = free(docs, "entities")
    made = pii.replace_pii(docs, pii.key_of(spark), count=count)
    release(spark)
    if "n_chars" in docs.columns:
        made = made.withColumn("n_chars", F.when(F.col(count) > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return made.select(*docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of all documents, and whether decoding them gives the text back."""
    path, pattern = bpe.public_vocabulary()
    plain = docs.select("doc_id", "lang", "source", F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    back = bpe.code_documents(plain, path, pattern, decoded="decoded")
    whole = F.col("decoded") == F.col("text").cast("binary")
    return back.select("doc_id", "lang", "source", F.size("ids").cast("bigint").alias("n_tokens"), "ids", whole.alias("round_trip"))


STAGES = [
    ("toxicity", drop_toxic),
    ("ngram_jaccard_join", drop_near_duplicates),
    ("benchmark_decontamination", drop_contaminated),
    ("pii", replace_personal_data),
    ("byte_bpe", encode),
]

#: SQL can't express the classifier, the surrogates and the encoder.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result is written and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
