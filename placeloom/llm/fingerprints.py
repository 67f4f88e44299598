"""Exact document fingerprints on DataFrame functions alone.

A text is brought to canonical form (compatibility composition, full case folding, composition
again, runs of white space to one space, trimmed) and digested by two differently seeded 64-bit
xxhashes.  Texts of one digest form a bucket; the bytes of the canonical texts inside a bucket
are compared, and where they differ the digests get an ordinal, so that equal fingerprints mean
equal canonical texts.  The digest is exact: the likeness of two fingerprints is 1 or 0.

The Unicode work calls the ICU classes that Spark itself ships, by the SQL function ``reflect``.

Defined results: null texts count as empty; repeated rows get equal fingerprints; the document
after the last is the first, in ascending doc_id, nulls first, ties by text; a single document
follows itself; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.llm.common import free, join_hot, materialize, table

#: Least and most range buckets of the id order, between them two for each shuffle partition; their
#: borders and first ids are all that the driver sees.
ID_BUCKETS = (512, 8192)
#: Digests of repeated texts that may be broadcast.
BROADCAST_ROWS = 500_000


def canonical(text: Column) -> Column:
    """Canonical form of a text."""
    compose = lambda c: F.reflect(F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(True))
    folded = F.reflect(F.lit("com.ibm.icu.lang.UCharacter"), F.lit("foldCase"), compose(F.coalesce(text, F.lit(""))), F.lit(True))
    return F.trim(F.regexp_replace(compose(folded), r"(?U)\s+", " "))


def digest(text: Column) -> Column:
    """128 bits of two xxhashes of different seeds, in hexadecimal."""
    wide = [F.lpad(F.lower(F.hex(h)), 16, "0") for h in (F.xxhash64(text), F.xxhash64(F.lit("wide"), text))]
    return F.concat(*wide)


def with_digest(df: DataFrame, text: str, fingerprint: str, form: str | None = None) -> DataFrame:
    """``df`` with the digest of a text column and, if named, its canonical form."""
    own = form or free(df, "form")
    made = df.withColumn(own, canonical(F.col(text))).withColumn(fingerprint, digest(F.col(own)))
    return made if form else made.drop(own)


def _repeated(fingerprints: DataFrame) -> DataFrame:
    """Digests (fp) of more than one row, broadcast if they are few."""
    many = materialize(fingerprints.groupBy("fp").agg(F.count("*").alias("n")).where("n > 1").select("fp"), "buckets")
    return F.broadcast(many) if many.count() <= BROADCAST_ROWS else many


def collisions(texts: DataFrame, repeated: DataFrame) -> DataFrame:
    """(fp, form, ordinal) of the buckets whose canonical texts differ, by comparing bytes.

    Least and greatest form of a bucket are equal just when all are; both are partial aggregates,
    so a text of many copies reaches a bucket once from each task.
    """
    forms = with_digest(texts, "text", "fp", "form").select("fp", "form").join(repeated, "fp", "left_semi")
    mixed = forms.groupBy("fp").agg(F.min("form").alias("lo"), F.max("form").alias("hi")).where("lo <> hi").select("fp")
    mixed = materialize(mixed, "mixed-buckets")
    if not mixed.limit(1).count():
        return mixed.select("fp", F.lit("").alias("form"), F.lit(0).alias("ordinal")).where(F.lit(False))
    distinct = forms.join(mixed, "fp", "left_semi").distinct()
    return materialize(distinct.withColumn("ordinal", F.row_number().over(W.partitionBy("fp").orderBy("form"))), "collisions")


def fingerprint(docs: DataFrame, text: str = "text", column: str = "fingerprint") -> DataFrame:
    """``docs`` with the fingerprint of each row's text, under a name with underscores where it is taken."""
    column = free(docs, column)
    plain = docs.select(F.col(text).cast("string").alias("text"))
    split = collisions(plain, _repeated(with_digest(plain, "text", "fp").select("fp")))
    if not split.limit(1).count():
        return with_digest(docs, text, column)
    fp, form, ordinal = (free(docs, f"{column}_{name}") for name in ("digest", "form", "ordinal"))
    made = with_digest(docs, text, fp, form)
    keys = split.select(F.col("fp").alias(fp), F.col("form").alias(form), F.col("ordinal").alias(ordinal))
    named = made.join(keys, [fp, form], "left").withColumn(column, F.concat_ws("-", fp, F.col(ordinal).cast("string")))
    return named.select(*[F.col(f"`{c}`") for c in docs.columns], column)


def followed(docs: DataFrame, *carried: str) -> DataFrame:
    """(doc_id, text, next_text): each row with the text of the next in ascending doc_id.

    Columns named in ``carried`` come with their next row's value, as next_<name>.

    Ids are cut into ranges by their quantiles; the first row of each range is copied to the end
    of the range before it, so one exchange brings every row together with its successor.
    """
    ids = docs.select("doc_id")
    n = min(ID_BUCKETS[1], max(ID_BUCKETS[0], 2 * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    cuts = ids.agg(F.percentile_approx("doc_id", [i / n for i in range(1, n)], F.lit(10 * n))).first()[0]
    borders = F.array(*[F.lit(b) for b in sorted(set(cuts or []))]).cast("array<bigint>")
    bucket = F.coalesce(F.size(F.filter(borders, lambda b: b < F.col("doc_id"))), F.lit(0))
    bucket = F.when(F.col("doc_id").isNull(), -1).otherwise(bucket)
    heads = ids.groupBy(bucket.alias("bucket")).agg(F.min("doc_id").alias("doc_id")).collect()
    own = ["doc_id", "text", *carried]
    leads = ["text", *carried]
    plain = docs.select(*own, bucket.alias("bucket"), F.lit(0).alias("copied"))
    if not heads:
        return plain.select(*own, *[F.col(c).alias(f"next_{c}") for c in leads])
    order = sorted(((r["bucket"], r["doc_id"]) for r in heads), key=lambda r: r[0])
    rows = [(order[i][1], order[i - 1][0]) for i in range(len(order))]
    # one row for each range, ID_BUCKETS[1] + 1 at most
    marks = docs.sparkSession.createDataFrame(rows, "head bigint, target int")
    copies = docs.select(*own).join(F.broadcast(marks), F.col("doc_id").eqNullSafe(F.col("head")))
    first = W.partitionBy("target").orderBy(F.col("text").asc_nulls_first())
    copies = copies.withColumn("at", F.row_number().over(first)).where("at = 1")
    both = plain.unionByName(copies.select(*own, F.col("target").alias("bucket"), F.lit(1).alias("copied")))
    along = W.partitionBy("bucket").orderBy("copied", F.col("doc_id").asc_nulls_first(), F.col("text").asc_nulls_first())
    nexts = [F.lead(c).over(along).alias(f"next_{c}") for c in leads]
    return both.select(*own, "copied", *nexts).where("copied = 0").drop("copied")


def edited(text: Column, following: Column) -> Column:
    """The last quarter of the code points replaced by as many of the following text."""
    n = F.length(text)
    cut = F.floor(n / 4).cast("int")
    return F.concat(F.substring(text, F.lit(1), n - cut), F.substring(following, F.lit(1), cut))


def fingerprint_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of all texts and of their edited texts, with the likenesses."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    pairs = followed(with_digest(plain, "text", "fp"), "fp").withColumn("edited", edited(F.col("text"), F.col("next_text")))
    made = with_digest(pairs, "edited", "edited_fp", "edited_form")
    # likeness: equal digests whose texts are equal byte by byte
    form = canonical(F.col("text"))
    likeness = lambda fp, other: F.when(F.col("fp") == F.col(fp), (form == other).cast("double")).otherwise(0.0)
    made = made.select(
        "doc_id",
        F.length("text").cast("bigint").alias("n_chars"),
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        "fp",
        "edited_fp",
        likeness("edited_fp", F.col("edited_form")).alias("near_edited"),
        likeness("next_fp", canonical(F.col("next_text"))).alias("near_next"),
    )
    made = materialize(made, "fingerprints")
    pool = made.select("fp").union(made.select("edited_fp"))
    repeated = _repeated(pool)
    split = collisions(plain.select("text"), repeated)
    if split.limit(1).count():
        made = _resolved(made, plain, pairs, split)
    groups = materialize(made.groupBy("fp").agg(F.min("doc_id").alias("group_id"), F.count("*").alias("m")).where("m > 1"), "equal-texts")
    return join_hot(made, groups, ["fp"], made.count()).select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        F.col("fp").alias("fingerprint"),
        F.col("edited_fp").alias("edited_fingerprint"),
        "near_edited",
        "near_next",
        F.coalesce("group_id", "doc_id").alias("group_id"),
    )


def _resolved(made: DataFrame, plain: DataFrame, pairs: DataFrame, split: DataFrame) -> DataFrame:
    """``made`` with ordinals on the digests of colliding buckets."""
    keys = split.select("fp", "form", "ordinal")
    mixed = keys.select("fp").distinct()
    out = made
    for source, text, column in ((plain, "text", "fp"), (pairs, "edited", "edited_fp")):
        own = with_digest(source.select("doc_id", text), text, "fp", "form").join(mixed, "fp", "left_semi").join(keys, ["fp", "form"], "left")
        # an edited text that no document has gets a further hash in place of an ordinal
        mark = F.coalesce(F.col("ordinal").cast("string"), F.concat(F.lit("x"), F.hex(F.xxhash64(F.lit("further"), F.col("form")))))
        named = own.select(F.col("doc_id").alias("d"), F.col("fp").alias("f"), mark.alias("mark")).distinct()
        joined = out.join(named, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col(column) == F.col("f")), "left")
        out = joined.withColumn(column, F.concat_ws("-", column, "mark")).drop("d", "f", "mark")
    return out


def op2_fingerprints(spark, sf_dir: str) -> DataFrame:
    """All documents, their edited texts and the documents after them."""
    return fingerprint_edits(table(spark, sf_dir, "documents"))
