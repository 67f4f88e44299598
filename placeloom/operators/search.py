"""Forward search: posting lists and the cascade of exact, phonetic, trigram and edit layers.

A query is a row; every layer is a join of query keys with a posting table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from placeloom.functions import scoring, text

EXACT_CAP, NGRAM_CAP = 16, 4096
#: Alternative names and trigrams of derived names count less.
WORD_SHIFT = 128


def postings(keyed: DataFrame, cap: int, within: tuple[str, ...] = ()) -> DataFrame:
    """(key, record_id, importance, rank): the best ``cap`` records of every key, or of every key within the columns named.

    The maximum of a record comes first (a partial aggregate); the ranking keeps ``cap`` rows of
    each task before the exchange, so a common key never gathers its whole list.
    """
    best = keyed.groupBy("key", *within, "record_id").agg(F.max("importance").alias("importance"))
    order = W.partitionBy("key", *within).orderBy(F.desc("importance"), "record_id")
    return best.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap)


def exact_keys(places: DataFrame, stopwords: tuple[str, ...] = (), carried: tuple[str, ...] = ()) -> DataFrame:
    """(key, record_id, importance) of whole names and of their longer words, with the columns in ``carried``."""
    name = text.base(F.col("name"))
    whole = places.select(name.alias("key"), "record_id", "importance", *carried)
    words = F.filter(F.split(F.regexp_replace(name, r"[^\p{L}\p{N} ]", ""), " "), lambda t: (F.octet_length(t) > 2) & ~t.isin(list(stopwords) or [""]))
    several = places.where(F.size(F.split(name, " ")) > 1)
    single = several.select(F.explode(words).alias("key"), "record_id", F.greatest(F.col("importance").cast("int") / WORD_SHIFT, F.lit(1)).cast("int").alias("importance"), *carried)
    return whole.unionByName(single)


def ngram_keys(places: DataFrame) -> DataFrame:
    """(key, record_id, importance) of the names' trigrams."""
    return places.select(F.explode(text.trigrams(text.base(F.col("name")))).alias("key"), "record_id", "importance")


def exact(queries: DataFrame, posted: DataFrame) -> DataFrame:
    """(query_id, record_id, importance, rank) of the queries' keys."""
    return queries.join(posted, "key").select("query_id", "record_id", "importance", "rank")


def by_trigrams(queries: DataFrame, posted: DataFrame, ratio: float = 0.7, limit: int = 64) -> DataFrame:
    """(query_id, record_id, matches, score) of records that share enough trigrams with a query."""
    grams = queries.withColumn("grams", text.trigrams(F.col("key"))).where(F.size("grams") >= 2)
    grams = grams.select("query_id", F.size("grams").alias("n"), F.explode("grams").alias("key"))
    counted = grams.join(posted.select("key", "record_id", "importance"), "key").groupBy("query_id", "record_id").agg(
        F.count("*").alias("matches"), F.max("n").alias("n"), F.max("importance").alias("importance")
    )
    enough = counted.where(F.col("matches") >= F.greatest(F.ceil(F.col("n") * F.lit(ratio) - 1e-9), F.lit(2)))
    scored = enough.withColumn("score", (F.col("matches") * 1000 + F.floor(F.col("importance") / 64)).cast("bigint"))
    order = W.partitionBy("query_id").orderBy(F.desc("score"), "record_id")
    return scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= limit).select("query_id", "record_id", "matches", "score")


def within_one_edit(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key, hit, distance): keys at most one edit away.

    Two words within one edit share themselves or a form with one letter left out, so the join is
    on those forms and the distance is computed for the pairs that meet.
    """
    forms = lambda df: df.withColumn("form", F.explode(text.deletions(F.col("key"))))
    left, right = forms(queries), forms(keys.select(F.col("key")).distinct()).withColumnRenamed("key", "hit")
    met = left.join(right, "form").select("query_id", "key", "hit").distinct()
    return met.withColumn("distance", F.levenshtein("key", "hit", 1)).where(F.col("distance").between(0, 1))


def within_two_edits(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """(query_id, key, hit, distance): single words at most two edits away.

    Two words within two edits share a form with up to two letters left out of each; keys whose
    lengths differ by more meet nothing, as their forms have other lengths.
    """
    single = lambda df: df.where(~F.col("key").contains(" "))
    forms = lambda df: df.withColumn("form", F.explode(text.deletions_twice(F.col("key"))))
    left, right = forms(single(queries)), forms(single(keys.select("key").distinct())).withColumnRenamed("key", "hit")
    met = left.join(right, "form").select("query_id", "key", "hit").distinct()
    return met.withColumn("distance", F.levenshtein("key", "hit", 2)).where(F.col("distance").between(0, 2))


def prefix(queries: DataFrame, places: DataFrame, limit: int = 10, letters: int = 3) -> DataFrame:
    """(query_id, record_id, name, importance, rank) of the best names that begin with a query.

    Every name stands under its beginnings of the lengths that queries have, ``letters`` at least;
    the best of each beginning are kept before the join, which is on the beginning itself.
    """
    named = places.withColumn("key", text.base(F.col("name")))
    asked = queries.withColumn("prefix", text.base(F.col("q"))).where(F.length("prefix") >= letters)
    # as many rows as there are lengths of queries
    lengths = asked.select(F.length("prefix").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("lengths")).first()[0]
    wanted = F.array(*map(F.lit, lengths or [letters]))
    begun = named.withColumn("n", F.explode(F.filter(wanted, lambda n: n <= F.length("key")))).withColumn("prefix", F.substring(F.col("key"), F.lit(1), F.col("n")))
    best = begun.withColumn("rank", F.row_number().over(W.partitionBy("prefix").orderBy(F.desc("importance"), "record_id"))).where(F.col("rank") <= limit)
    return asked.join(best.select("prefix", "record_id", "name", "importance", "rank"), "prefix").select("query_id", "record_id", "name", "importance", "rank")


def cascade(queries: DataFrame, places: DataFrame, phonetic=None, grams: DataFrame | None = None) -> DataFrame:
    """(query_id, record_id, layer, confidence, importance): hits of the first layer that has any.

    Layers: exact, phonetic (if a key function is given), trigrams (of queries of at least two),
    one edit, two edits of single words.  All layers run on all queries and the first that hits is
    kept: asking a layer only what the ones before it missed would compute those again for every
    layer, unless the remainders were written.  ``grams`` are trigram postings that were built before.
    """
    named = places.select("record_id", "importance", text.base(F.col("name")).alias("key"))
    left = queries.select("query_id", text.base(F.col("q")).alias("key"))
    by_key = named.withColumnRenamed("key", "hit")

    def heard(asked: DataFrame) -> DataFrame:
        return asked.withColumn("key", phonetic(F.col("key"))).join(named.withColumn("key", phonetic(F.col("key"))), "key")

    layers = [("exact", lambda asked: asked.join(named, "key"))]
    if phonetic is not None:
        layers.append(("phonetic", heard))
    layers += [
        ("ngram", lambda asked: by_trigrams(asked, postings(ngram_keys(places), NGRAM_CAP) if grams is None else grams)),
        ("edit1", lambda asked: within_one_edit(asked.where(F.length("key") >= 4), named).join(by_key, "hit")),
        ("edit2", lambda asked: within_two_edits(asked.where(F.length("key") >= 4), named).join(by_key, "hit")),
    ]
    every: DataFrame | None = None
    for number, (label, layer) in enumerate(layers):
        hits = layer(left).select("query_id", "record_id", F.lit(number).alias("layer_no"), F.lit(label).alias("layer"))
        every = hits if every is None else every.unionByName(hits)
    first = every.groupBy("query_id").agg(F.min("layer_no").alias("layer_no"))
    every = every.join(first, ["query_id", "layer_no"]).drop("layer_no").distinct()
    return every.join(places.select("record_id", "importance"), "record_id").select(
        "query_id", "record_id", "layer", scoring.confidence(F.col("layer")).alias("confidence"), "importance"
    )


def confident(hits: DataFrame, least: float) -> DataFrame:
    """Hits of at least some confidence."""
    return hits.where(F.col("confidence") >= least)


def best_importance(names: DataFrame, places: DataFrame) -> DataFrame:
    """(query_id, whole, last): importance of the best place of the whole name and of its last word, 0 without one."""
    best = places.groupBy(text.base(F.col("name")).alias("key")).agg(F.max("importance").alias("importance"))
    asked = names.withColumn("key", text.base(F.col("q"))).withColumn("last", F.element_at(F.split("key", " "), -1))
    out = asked.join(best.withColumnRenamed("importance", "whole"), "key", "left").drop("key")
    out = out.join(best.select(F.col("key").alias("last"), F.col("importance").alias("last_importance")), "last", "left")
    return out.select("query_id", F.coalesce("whole", F.lit(0)).alias("whole"), F.coalesce("last_importance", F.lit(0)).alias("last"))


def top(hits: DataFrame, by: list[Column], limit: int) -> DataFrame:
    """The first ``limit`` hits of every query, with their rank."""
    return hits.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(*by))).where(F.col("rank") <= limit)


def ambiguous(places: DataFrame, countries: int = 2) -> DataFrame:
    """(name, n_countries) of names that several countries have."""
    return places.groupBy("name").agg(F.countDistinct("country").alias("n_countries")).where(F.col("n_countries") >= countries)


def filtered(hits: DataFrame, box: tuple | None = None, bounded: bool = False, excluded: Column | None = None, kinds: Column | None = None) -> DataFrame:
    """Result filters: a viewbox (bias, or limit if ``bounded``), excluded ids and types."""
    out = hits
    if box is not None:
        inside = F.coalesce(F.col("lat").between(box[0], box[1]) & F.col("lon").between(box[2], box[3]), F.lit(False))
        out = out.where(inside) if bounded else out.withColumn("importance", F.when(inside, F.col("importance") * 1.5).otherwise(F.col("importance")))
    if excluded is not None:
        out = out.where(~F.array_contains(excluded, F.col("record_id")))
    return out.where(kinds) if kinds is not None else out


def first_wins(hits: DataFrame, keys: list[str], by: list[Column]) -> DataFrame:
    """Of results that look the same, the first."""
    return hits.withColumn("r", F.row_number().over(W.partitionBy(*keys).orderBy(*by))).where("r = 1").drop("r")
