"""Exact n-gram Jaccard self-join by a token-group matrix.

Tokens are the distinct word shingles of a document, as 64-bit hashes.  Similar documents are
first partitioned into groups: documents that share a min-hash meet the smallest id among them
(the pivot); those alike to it form groups of bounded size, and those that reach the threshold
are linked to it.  The matrix holds, for every group, the union of its members' prefix tokens,
under one global token order.  Groups meet only if their unions share a token, and their overlap,
the sizes and the positions in the order bound what any two members share; only groups whose
bound reaches the threshold are opened.  Members that links have joined already are not compared
again.

Because groups stand for their members, a family of thousands of copies costs a link per member
and not one per pair.  Tokens that many groups share go to the end of the global order, which
changes the cost and never the result.

Defined results: null, empty or wordless texts have no shingles and no links; equal texts link;
rows with a null doc_id get a null component; rows that repeat a doc_id are one node with the
links of all of them; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from placeloom.llm.common import discard, join_hot, materialize, release, release_executors, table, trim
from placeloom.llm.components import components

WORDS = 5
PERCENT = 80
#: Independent min-hashes that form the first groups.
GROUP_KEYS = 4
#: Percent of similarity to a pivot that puts a document into its group, and members of a group's part.
ALIKE = 50
GROUP_SIZE = 256
#: Tokens of more groups than this go to the end of the token order.
COMMON = 100
#: Common tokens that are broadcast; those of fewer groups beyond it stay in plain order.
COMMON_BOUND = 2_000_000
#: Tokens that are broadcast to pick rows; beyond it the rows are joined by an exchange.
TOKENS_BOUND = 2_000_000
#: Rounds in which common tokens are looked for.
ORDER_ROUNDS = 2
#: Document ids that are broadcast to pick texts; beyond it the texts are joined by an exchange.
IDS_BOUND = 1_000_000

_ROLL = np.uint64(0x9E3779B97F4A7C15)
_MIX = (np.uint64(0xFF51AFD7ED558CCD), np.uint64(0xC4CEB9FE1A85EC53))


def _mixed(x: np.ndarray) -> np.ndarray:
    """Finalizer that spreads 64-bit values."""
    x = (x ^ (x >> np.uint64(33))) * _MIX[0]
    x = (x ^ (x >> np.uint64(33))) * _MIX[1]
    return x ^ (x >> np.uint64(33))


def shingles(text: bytes, words: int = WORDS) -> np.ndarray:
    """Sorted distinct shingle hashes of a text; ``bytes.split`` parts at the six ASCII spaces."""
    hashed = [xxhash.xxh64_intdigest(w) for w in text.lower().split()]
    if not hashed:
        return np.empty(0, dtype=np.uint64)
    h = np.array(hashed, dtype=np.uint64)
    k = min(words, len(h))
    rolled = h[: len(h) - k + 1].copy()
    for i in range(1, k):
        rolled = _mixed(rolled * _ROLL + h[i : len(h) - k + 1 + i])
    # a short text's sequence is no shingle of a longer one
    return np.unique(_mixed(rolled + np.uint64(k)))


def prefix_size(n: int, percent: int) -> int:
    """Tokens of which a partner holds at least one: n less its least overlap, plus one."""
    return n - -(-n * percent // 100) + 1


def _prefix(tokens: np.ndarray, common: np.ndarray, percent: int) -> np.ndarray:
    size = prefix_size(len(tokens), percent)
    if not len(common):
        return tokens[:size]
    at = np.searchsorted(common, tokens)
    at[at == len(common)] = 0
    is_common = common[at] == tokens
    return np.concatenate([tokens[~is_common], tokens[is_common]])[:size]


def _lists(parts: list[np.ndarray]) -> pa.ListArray:
    ends = np.cumsum([0, *map(len, parts)])
    values = np.concatenate(parts) if parts else np.empty(0, dtype=np.uint64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(values.view(np.int64), pa.int64()))


def _texts(batch: pa.RecordBatch) -> Iterator[bytes]:
    for x in batch.column(1).cast(pa.binary()):
        yield x.as_py() or b""


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def signatures(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, keys: int = GROUP_KEYS) -> DataFrame:
    """Per row: doc_id, n (set size), d1, d2 (digest of the set), group keys, prefix tokens."""
    seeds = _mixed(np.arange(1, keys + 1, dtype=np.uint64) * _ROLL)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, dtype=np.uint64)
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sizes, d1, d2, mins, prefixes = [], [], [], [], []
                for text in _texts(batch):
                    t = shingles(text, words)
                    sizes.append(len(t))
                    digest = xxhash.xxh3_128_intdigest(t.tobytes())
                    d1.append(digest & (2**63 - 1))
                    d2.append(digest >> 65)
                    mins.append(np.array([((t ^ s) * _MIX[0]).min() for s in seeds], dtype=np.uint64) if len(t) else none)
                    prefixes.append(_prefix(t, none, percent) if len(t) else none)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(sizes, pa.int64()), pa.array(d1, pa.int64()), pa.array(d2, pa.int64()), _lists(mins), _lists(prefixes)],
                    names=["doc_id", "n", "d1", "d2", "keys", "prefix"],
                )
        trim()

    return _plain(docs).mapInArrow(run, "doc_id bigint, n bigint, d1 bigint, d2 bigint, keys array<bigint>, prefix array<bigint>")


def token_sets(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """(doc_id, tokens) of every row with words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), _lists([shingles(t, words) for t in _texts(batch)])], names=["doc_id", "tokens"]
                )
        trim()

    return _plain(docs).mapInArrow(run, "doc_id bigint, tokens array<bigint>").where(F.size("tokens") > 0)


def _reordered(docs: DataFrame, common: np.ndarray, words: int, percent: int) -> DataFrame:
    """(doc_id, n, comp, grp, prefix) of ``docs`` (doc_id, text, comp, grp) under the order that puts ``common`` last."""
    shared = docs.sparkSession.sparkContext.broadcast(common)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                sets = [shingles(t, words) for t in _texts(batch)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array([len(t) for t in sets], pa.int64()), batch.column(2), batch.column(3), _lists([_prefix(t, last, percent) for t in sets])],
                    names=["doc_id", "n", "comp", "grp", "prefix"],
                )
        trim()

    return docs.mapInArrow(run, "doc_id bigint, n bigint, comp bigint, grp bigint, prefix array<bigint>")


def _small(written: DataFrame) -> DataFrame:
    """A written table of ids, broadcast if it has few rows."""
    return F.broadcast(written) if written.count() <= IDS_BOUND else written


def _with_ids(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of ``docs`` whose doc_id is in the written table ``ids``."""
    return docs.join(_small(ids), "doc_id", "left_semi")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return (100 * a >= percent * b) & (100 * b >= percent * a)


def compared(pairs: DataFrame, docs: DataFrame, words: int, percent: int, least: int) -> DataFrame:
    """(a, b, linked) of the id pairs (a, b) whose sets reach ``least`` percent; linked: ``percent``."""
    needed = materialize(pairs.select(F.col("a").alias("doc_id")).union(pairs.select("b")).distinct(), "needed")
    sets = materialize(token_sets(_with_ids(docs, needed), words), "token-sets")
    left = sets.select(F.col("doc_id").alias("a"), F.col("tokens").alias("ta"))
    right = sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb"))
    joined = pairs.join(left, "a").join(right, "b").where(_sizes_fit(F.size("ta"), F.size("tb"), least))
    both, total = F.size(F.array_intersect("ta", "tb")), F.size("ta") + F.size("tb")
    judged = joined.select("a", "b", both.alias("both"), total.alias("total")).where((100 + least) * F.col("both") >= least * F.col("total"))
    out = materialize(judged.select("a", "b", ((100 + percent) * F.col("both") >= percent * F.col("total")).alias("linked")), "compared", few=True)
    discard(sets)
    return out


def _keyed(reps: DataFrame) -> DataFrame:
    """(doc_id, n, k, key, band): the buckets of documents that share a min-hash and are of about one size."""
    keyed = reps.select("doc_id", "n", F.posexplode("keys").alias("k", "key"))
    return keyed.withColumn("band", F.floor(F.log(F.col("n").cast("double")) / float(np.log(1.5))).cast("int"))


_BUCKET = ["k", "key", "band"]


def _met_pivots(reps: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """(a, b, linked): documents b that are alike to the pivot a, the smallest document of a bucket."""
    keyed = _keyed(reps)
    pivots = keyed.groupBy(*_BUCKET).agg(F.min(F.struct("doc_id", "n")).alias("p"), F.count("*").alias("m")).where("m > 1")
    pairs = (
        keyed.join(pivots.select(*_BUCKET, F.col("p.doc_id").alias("a"), F.col("p.n").alias("an")), _BUCKET)
        .where((F.col("a") != F.col("doc_id")) & _sizes_fit(F.col("n"), F.col("an"), percent))
        .select("a", F.col("doc_id").alias("b"))
        .distinct()
    )
    return compared(materialize(pairs, "pivot-pairs"), docs, words, percent, ALIKE)


def _groups(reps: DataFrame, met: DataFrame) -> DataFrame:
    """(doc_id, grp) of the documents in groups of several: those alike to one pivot, in parts of bounded size."""
    label = met.groupBy(F.col("b").alias("doc_id")).agg(F.min("a").alias("label"))
    pivots = met.select(F.col("a").alias("doc_id")).distinct().join(label, "doc_id", "left_anti").select("doc_id", F.col("doc_id").alias("label"))
    labelled = materialize(label.unionByName(pivots), "labels")
    parts = labelled.groupBy("label").agg(F.ceil(F.count("*") / GROUP_SIZE).alias("parts"))
    dealt = labelled.join(parts, "label").withColumn("part", F.pmod(F.xxhash64("doc_id"), F.col("parts")))
    names = dealt.groupBy("label", "part").agg(F.min("doc_id").alias("grp"))
    return materialize(dealt.join(names, ["label", "part"]).select("doc_id", "grp"), "groups")


def _common_tokens(rows: DataFrame, column: str) -> np.ndarray:
    """Tokens that lie in many groups, counted at the groups' first members; the most frequent ones."""
    firsts = rows.where("doc_id = grp").select(F.explode(column).alias("token"))
    counted = firsts.groupBy("token").agg(F.count("*").alias("m")).where(F.col("m") > COMMON)
    top = counted.orderBy(F.desc("m"), "token").limit(COMMON_BOUND).select("token")
    return top.toArrow()["token"].to_numpy().view(np.uint64)


def _holders(rows: DataFrame, common: np.ndarray) -> DataFrame:
    """(doc_id, comp, grp) of the rows with a common token in their prefix."""
    marks = rows.sparkSession.createDataFrame(pa.table({"token": common.view(np.int64)}))
    # COMMON_BOUND tokens at most
    held = rows.select("doc_id", "comp", "grp", F.explode("prefix").alias("token")).join(F.broadcast(marks), "token", "left_semi")
    return materialize(held.select("doc_id", "comp", "grp").distinct(), "holders")


def _ordered_prefixes(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """``rows`` (doc_id, n, comp, grp, prefix) with the prefixes under the final token order.

    A prefix that loses common tokens grows by others, so common tokens are looked for once more
    among the prefixes that have changed.
    """
    common = np.empty(0, dtype=np.uint64)
    changed = rows
    for _ in range(ORDER_ROUNDS):
        fresh = np.setdiff1d(_common_tokens(changed, "prefix"), common)[: COMMON_BOUND - len(common)]
        if not len(fresh):
            break
        common = np.union1d(common, fresh)
        held = _small(_holders(rows, fresh))
        again = _reordered(_plain(docs).join(held, "doc_id").select("doc_id", "text", "comp", "grp"), common, words, percent)
        changed = materialize(again.where("n > 0"), "reordered")
        rows = rows.join(held.select("doc_id"), "doc_id", "left_anti").unionByName(changed)
    return rows


def _matrix_rows(rows: DataFrame) -> DataFrame:
    """(token, pos, doc_id, n, grp) of the prefix tokens that more than one document holds."""
    each = rows.select("doc_id", "n", "grp", F.posexplode("prefix").alias("pos", "token"))
    shared = each.groupBy("token").agg(F.count("*").alias("m")).where("m > 1").select("token")
    shared = materialize(shared, "shared-tokens", few=True)
    # tokens are as many as the input has, so they are broadcast only while they are few
    if shared.count() <= TOKENS_BOUND:
        shared = F.broadcast(shared)
    return materialize(each.join(shared, "token", "left_semi"), "matrix-rows")


def _rest(n: Column, percent: int) -> Column:
    """Tokens of a set of ``n`` behind its prefix."""
    return F.ceil(n * percent / 100).cast("bigint") - 1


def _near_groups(held: DataFrame, percent: int) -> DataFrame:
    """(ga, gb): groups of which members can reach the threshold, from the token-group matrix.

    The matrix has, for every group and size step, the union of its members' prefix tokens.  Two
    members share at most the ``c`` tokens that both unions hold within the prefixes.  Beyond
    them, whichever of the two prefixes ends first in the token order leaves only the rest of its
    own set, so c plus the larger rest bounds the overlap.  It is also bounded by what stands at
    and behind the first shared token, in either set; a set whose first token that any other
    group holds comes late is left out before pairs are formed.
    """
    # sizes in steps of 1 / percent: partners lie in the same step or in the next
    step = F.floor(F.log(F.col("n").cast("double")) / float(np.log(100 / percent)) + 1e-9).cast("int")
    several = held.groupBy("token").agg(F.min("grp").alias("lowest"), F.max("grp").alias("highest")).where("lowest < highest").select("token", "highest")
    several = materialize(several, "met-tokens")
    held = held.join(F.broadcast(several) if several.count() <= TOKENS_BOUND else several, "token")
    matrix = held.withColumn("step", step).groupBy("token", "grp", "step").agg(
        F.min("n").alias("lo"), F.max("n").alias("hi"), F.min("pos").alias("pos"), F.max("highest").alias("highest")
    )
    matrix = materialize(matrix, "matrix")
    starts = materialize(matrix.groupBy("grp", "step").agg(F.min("pos").alias("first")), "matrix-starts")
    matrix = matrix.join(_small(starts), ["grp", "step"])
    left = matrix.where("grp < highest").select(
        "token", F.col("grp").alias("ga"), F.col("step").alias("sa"), F.col("lo").alias("la"), F.col("hi").alias("ha"), F.col("pos").alias("pa"), F.col("first").alias("fa"),
        F.explode(F.array(F.col("step") - 1, F.col("step"), F.col("step") + 1)).alias("step"),
    )
    right = matrix.select("token", "step", F.col("grp").alias("gb"), F.col("lo").alias("lb"), F.col("hi").alias("hb"), F.col("pos").alias("pb"), F.col("first").alias("fb"))
    needed = percent * (F.col("la") + F.col("lb"))
    fits = (100 * F.col("hb") >= percent * F.col("la")) & (100 * F.col("ha") >= percent * F.col("lb"))
    fits = fits & ((100 + percent) * F.least(F.col("ha") - F.col("fa"), F.col("hb") - F.col("fb")) >= needed)
    met = left.join(right, ["token", "step"]).where((F.col("ga") < F.col("gb")) & fits)
    bound = met.groupBy("ga", "sa", "gb", "step").agg(
        F.count("*").alias("c"), F.max(F.least(F.col("ha") - F.col("pa"), F.col("hb") - F.col("pb"))).alias("reach"),
        F.min("la").alias("la"), F.max("ha").alias("ha"), F.min("lb").alias("lb"), F.max("hb").alias("hb"),
    )
    most = F.col("c") + F.greatest(_rest(F.col("ha"), percent), _rest(F.col("hb"), percent))
    return bound.where(((100 + percent) * most >= needed) & ((100 + percent) * F.col("reach") >= needed)).select("ga", "gb").distinct()


def _open_groups(rows: DataFrame, docs: DataFrame, words: int, percent: int) -> DataFrame:
    """Links between documents of different groups, by the token-group matrix.

    Of two near groups the members of the smaller one are queries.  Pairs of documents exist only
    inside the last join, whose condition is the exact test; it returns the links.
    """
    near = _near_groups(_matrix_rows(rows), percent)
    # a group of several components is also near itself
    mixed = rows.groupBy("grp").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo <> hi")
    near = materialize(near.union(mixed.select("grp", F.col("grp").alias("gb"))), "near-groups")
    release_executors(docs.sparkSession)
    ids = _small(materialize(near.select(F.col("ga").alias("grp")).union(near.select("gb")).distinct(), "near-ids"))
    inside = materialize(rows.select("doc_id", "n", "comp", "grp").join(ids, "grp", "left_semi"), "near-members", few=True)
    sizes = _small(materialize(inside.groupBy("grp").agg(F.count("*").alias("m")), "group-sizes"))
    sized = near.join(sizes.select(F.col("grp").alias("ga"), F.col("m").alias("ma")), "ga").join(sizes.select(F.col("grp").alias("gb"), F.col("m").alias("mb")), "gb")
    first = F.col("ma") <= F.col("mb")
    sized = sized.select(F.when(first, F.col("ga")).otherwise(F.col("gb")).alias("asks"), F.when(first, F.col("gb")).otherwise(F.col("ga")).alias("grp"))
    # the matrix has bounded the overlap of these; the last join opens them
    opened = sized.join(inside.select(F.col("grp").alias("asks"), F.col("doc_id").alias("q"), "comp"), "asks").select("q", "comp", "grp").distinct()
    opened = materialize(opened, "query-groups")
    held = materialize(inside.select("doc_id").distinct(), "near-docs")
    sets = materialize(token_sets(_with_ids(docs, held), words), "near-sets")
    left = opened.join(sets.select(F.col("doc_id").alias("q"), F.col("tokens").alias("ta")), "q")
    right = inside.select("grp", F.col("doc_id").alias("b"), "comp").join(sets.select(F.col("doc_id").alias("b"), F.col("tokens").alias("tb")), "b")
    fits = _sizes_fit(F.size("ta"), F.size("tb"), percent)
    same = (100 + percent) * F.size(F.array_intersect("ta", "tb")) >= percent * (F.size("ta") + F.size("tb"))
    met = left.alias("l").join(right.alias("r"), (F.col("l.grp") == F.col("r.grp")) & (F.col("l.comp") != F.col("r.comp")) & fits & same)
    links = materialize(met.select(F.col("q").alias("a"), "b").distinct(), "opened-links")
    discard(sets)
    return links


def jaccard_components(docs: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id (smallest linked doc_id)."""
    signed = materialize(signatures(docs, words, percent), "signatures")
    linked = signed.where("n > 0 AND doc_id IS NOT NULL")
    keys = ["doc_id", "n", "d1", "d2"]
    small = linked.select(*keys)
    classes = small.groupBy("n", "d1", "d2").agg(F.min("doc_id").alias("rep"), F.count("*").alias("m")).where("m > 1")
    classes = materialize(classes, "set-classes")
    others = materialize(join_hot(small, classes, ["n", "d1", "d2"], small.count(), "inner").where("doc_id <> rep").distinct(), "copies")
    copies = others.select(F.col("rep").alias("a"), F.col("doc_id").alias("b"))
    others = others.select(*keys)
    reps = linked.join(_small(others), keys, "left_anti")
    met = _met_pivots(reps, docs, words, percent)
    release_executors(docs.sparkSession)
    first = met.where("linked").select("a", "b")
    linked_to = _small(components(first, "linked").select(F.col("node").alias("doc_id"), F.col("component").alias("comp")))
    groups = _small(_groups(reps, met))
    grouped = reps.join(linked_to, "doc_id", "left").join(groups, "doc_id", "left")
    grouped = grouped.select("doc_id", "n", F.coalesce("comp", "doc_id").alias("comp"), F.coalesce("grp", "doc_id").alias("grp"), "prefix")
    grouped = materialize(grouped, "grouped")
    sizes = materialize(signed.select("doc_id", F.col("n").alias("n_shingles")), "sizes", few=True)
    discard(signed)
    release(docs.sparkSession)
    release_executors(docs.sparkSession)
    ordered = _ordered_prefixes(grouped, docs, words, percent)
    release_executors(docs.sparkSession)
    rest = _open_groups(ordered, docs, words, percent)
    discard(grouped)
    release(docs.sparkSession)
    release_executors(docs.sparkSession)
    labels = components(copies.union(first).union(rest), "classes")
    return sizes.join(labels.withColumnRenamed("node", "doc_id"), "doc_id", "left").select(
        "doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id")
    )


def op6_ngram_jaccard_join(spark, sf_dir: str) -> DataFrame:
    """All documents against each other."""
    return jaccard_components(table(spark, sf_dir, "documents"))


ORACLE_SQL = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 5) - 1], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
links AS (
  SELECT p.a, p.b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS k FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2) p
  JOIN n na ON na.doc_id = p.a JOIN n nb ON nb.doc_id = p.b WHERE 100 * p.k >= 80 * (na.n + nb.n - p.k)),
reach(a, b) AS (SELECT doc_id, doc_id FROM w UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, min(reach.b) AS component_id
FROM w LEFT JOIN n ON n.doc_id = w.doc_id JOIN reach ON reach.a = w.doc_id GROUP BY 1, 2
"""
