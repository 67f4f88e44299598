"""Benchmark decontamination over a positional inverted index.

``build_index`` turns documents into inverted segments (term -> positions of all its occurrences,
for all words of the documents), which are stored as a table; an index serves any number of
benchmarks.  ``search`` intersects the offset-adjusted position lists of every benchmark window,
starting from its rarest term in the segment, and returns exact phrase hits; ``proximity`` returns
the places where all words of an item stand within a span.  A segment holds a bounded number of
tokens, or one document, so memory does not grow with the corpus and no posting list of a frequent
word meets in one task.

Defined results: a null or wordless text has no words and no hits; null or wordless items match
nothing; an item with a null id marks words as hit but is not listed; repeated documents, and
different ones with one doc_id or none, each get their own row; an empty benchmark leaves every
document clean; other columns are ignored.
"""

from __future__ import annotations

import re
from collections import defaultdict
from collections.abc import Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import materialize

WINDOW = 13
#: Tokens of one inverted segment.
SEGMENT_TOKENS = 1_000_000
#: Benchmark text that one block may hold; larger benchmarks are searched block by block.
BLOCK_BYTES = 64 << 20
_WORD = re.compile(rb"[0-9a-z\x80-\xff]+")

#: Bytes of a text whose words are taken at once.
PIECE_BYTES = 4 << 20

INDEX_SCHEMA = (
    "segment bigint, doc_ids array<bigint>, starts array<bigint>, lengths array<bigint>, "
    "lexicon array<binary>, offsets binary, gaps binary"
)
#: ``row`` numbers the documents of an index
HIT_SCHEMA = "row string, doc_id bigint, n_words bigint, hit_starts array<int>, hit_ends array<int>, items array<string>"


def words_of(text: bytes) -> list[bytes]:
    """Words: runs of digits, letters a-z (after lower-casing A-Z) and non-ASCII characters."""
    return _WORD.findall(text.lower())


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text cut behind white space, so that its words need not be held at once."""
    at = 0
    while at < len(text):
        end = at + PIECE_BYTES
        if end < len(text):
            cut = max(text.rfind(b" ", at, end), text.rfind(b"\n", at, end))
            end = cut + 1 if cut > at else len(text)
        yield text[at:end]
        at = end


class Phrases:
    """The distinct windows of one block of the benchmark, as rows of term numbers."""

    def __init__(self, items: Iterable[tuple[str | None, str | None]], window: int = WINDOW):
        self.vocabulary: dict[bytes, int] = {}
        owners: dict[tuple[int, ...], set[str]] = defaultdict(set)
        self.item_terms: list[tuple[str | None, list[int]]] = []
        for item_id, text in items:
            words = words_of((text or "").encode())
            if not words:
                continue
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            self.item_terms.append((item_id, ids))
            for i in range(max(1, len(ids) - window + 1)):
                owner = owners[tuple(ids[i : i + window])]
                if item_id is not None:
                    owner.add(item_id)
        by_length: dict[int, list[tuple[int, ...]]] = defaultdict(list)
        for phrase in owners:
            by_length[len(phrase)].append(phrase)
        self.windows = {n: np.array(rows, dtype=np.int32) for n, rows in by_length.items()}
        self.owners = {n: [sorted(owners[r]) for r in rows] for n, rows in by_length.items()}
        self.words = pa.array(list(self.vocabulary), pa.binary())


class _Segment:
    """Tokens gathered for one segment; documents are kept apart by one empty position."""

    def __init__(self, number: int) -> None:
        self.number = number
        self.ids: list[int | None] = []
        self.starts: list[int] = []
        self.lengths: list[int] = []
        self.parts: list[np.ndarray] = []
        self.lexicon: dict[bytes, int] = {}
        self.size = 0

    def add(self, doc_id: int | None, text: bytes) -> None:
        self.ids.append(doc_id)
        self.starts.append(self.size)
        put, terms = self.lexicon.setdefault, self.lexicon
        for piece in _pieces(text):
            own = np.array([put(w, len(terms)) for w in words_of(piece)], dtype=np.int32)
            self.parts.append(own)
            self.size += len(own)
        self.lengths.append(self.size - self.starts[-1])
        self.parts.append(np.array([-1], dtype=np.int32))
        self.size += 1

    def batch(self) -> pa.RecordBatch:
        tokens = np.concatenate(self.parts)
        at = np.flatnonzero(tokens >= 0)
        positions = at[np.argsort(tokens[at], kind="stable")]
        offsets = np.concatenate([[0], np.cumsum(np.bincount(tokens[at], minlength=len(self.lexicon)))])
        gaps = np.diff(positions, prepend=0).astype(np.int32)
        lists = [pa.array([x], pa.list_(pa.int64())) for x in (self.ids, self.starts, self.lengths)]
        lexicon = pa.ListArray.from_arrays(pa.array([0, len(self.lexicon)], pa.int32()), pa.array(list(self.lexicon), pa.binary()))
        return pa.RecordBatch.from_arrays(
            [pa.array([self.number], pa.int64()), *lists, lexicon, pa.array([offsets.astype(np.int64).tobytes()], pa.binary()), pa.array([gaps.tobytes()], pa.binary())],
            names=["segment", "doc_ids", "starts", "lengths", "lexicon", "offsets", "gaps"],
        )


def build_index(docs: DataFrame, segment_tokens: int = SEGMENT_TOKENS) -> DataFrame:
    """Inverted segments of ``docs`` (doc_id, text), to be stored; segments are numbered by the task that makes them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number = TaskContext.get().partitionId() << 32
        segment = _Segment(number)
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for doc_id, text in zip(batch.column(0).to_pylist(), texts):
                segment.add(doc_id, text.as_py() or b"")
                if segment.size >= segment_tokens:
                    yield segment.batch()
                    segment = _Segment(segment.number + 1)
        if segment.ids:
            yield segment.batch()

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(
        run, INDEX_SCHEMA
    )


class _Postings:
    """Read side of a segment, for the terms of one block of the benchmark."""

    def __init__(self, batch: pa.RecordBatch, i: int, phrases: Phrases):
        self.number, self.ids = batch.column(0)[i].as_py(), batch.column(1)[i].as_py()
        self.starts, self.lengths = (np.array(batch.column(c)[i].as_py(), dtype=np.int64) for c in (2, 3))
        offsets = np.frombuffer(batch.column(5)[i].as_buffer(), dtype=np.int64)
        self.positions = np.cumsum(np.frombuffer(batch.column(6)[i].as_buffer(), dtype=np.int32), dtype=np.int64)
        n = max(1, len(phrases.words))
        self.begin = np.zeros(n, dtype=np.int64)
        self.count = np.zeros(n, dtype=np.int64)
        local = pc.index_in(phrases.words, value_set=batch.column(4)[i].values)
        known = np.flatnonzero(local.is_valid().to_numpy(zero_copy_only=False))
        at = local.drop_null().to_numpy()
        self.begin[known] = offsets[at]
        self.count[known] = offsets[at + 1] - offsets[at]

    def of(self, term: int) -> np.ndarray:
        return self.positions[self.begin[term] : self.begin[term] + self.count[term]]

    def phrase(self, window: np.ndarray) -> np.ndarray:
        """Start positions of ``window``: offset-adjusted lists intersected from the rarest term."""
        found: np.ndarray | None = None
        for offset in np.argsort(self.count[window], kind="stable"):
            listed = self.of(window[offset])
            if found is None:
                found = listed - offset
                continue
            at = np.searchsorted(listed, found + offset)
            at[at == len(listed)] = 0
            found = found[listed[at] == found + offset]
            if not len(found):
                break
        return found if found is not None else np.empty(0, dtype=np.int64)


def _phrase_hits(postings: _Postings, phrases: Phrases) -> tuple[np.ndarray, np.ndarray, list[set[str]]]:
    """Merged hit spans of a segment (starts, ends) and the items found in each document."""
    doc_starts = postings.starts
    size = int(doc_starts[-1] + postings.lengths[-1] + 1)
    edges = np.zeros(size + 1, dtype=np.int64)
    items: list[set[str]] = [set() for _ in doc_starts]
    for length, windows in phrases.windows.items():
        alive = np.flatnonzero(postings.count[windows].min(axis=1) > 0)
        for w in alive:
            starts = postings.phrase(windows[w])
            if not len(starts):
                continue
            np.add.at(edges, starts, 1)
            np.add.at(edges, starts + length, -1)
            for d in np.unique(np.searchsorted(doc_starts, starts, side="right") - 1):
                items[d].update(phrases.owners[length][w])
    covered = np.concatenate([[0], (np.cumsum(edges) > 0).astype(np.int8), [0]])
    turns = np.diff(covered)
    return np.flatnonzero(turns == 1), np.flatnonzero(turns == -1), items


def search(index: DataFrame, phrases: Phrases) -> DataFrame:
    """Exact phrase hits: one row per indexed document (see ``HIT_SCHEMA``)."""
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                postings = _Postings(batch, i, block)
                starts, ends, items = _phrase_hits(postings, block)
                bounds = postings.starts
                owner = np.searchsorted(bounds, starts, side="right") - 1
                cuts = np.searchsorted(owner, np.arange(len(bounds) + 1))
                local_s, local_e = starts - bounds[owner], ends - bounds[owner]
                offsets = pa.array(cuts, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([f"{postings.number}:{d}" for d in range(len(bounds))], pa.string()),
                        pa.array(postings.ids, pa.int64()),
                        pa.array(postings.lengths, pa.int64()),
                        pa.ListArray.from_arrays(offsets, pa.array(local_s, pa.int32())),
                        pa.ListArray.from_arrays(offsets, pa.array(local_e, pa.int32())),
                        pa.array([sorted(x) for x in items], pa.list_(pa.string())),
                    ],
                    names=["row", "doc_id", "n_words", "hit_starts", "hit_ends", "items"],
                )

    return index.mapInArrow(run, HIT_SCHEMA)


def proximity(index: DataFrame, phrases: Phrases, span: int) -> DataFrame:
    """Places where all distinct words of an item stand within ``span`` consecutive words.

    Returns doc_id, item_id, position (first word of each minimal span that starts at an
    occurrence of the item's rarest word's nearest neighbours).  Walks from the rarest term.
    """
    shared = index.sparkSession.sparkContext.broadcast(phrases)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = shared.value
        for batch in batches:
            for i in range(batch.num_rows):
                postings = _Postings(batch, i, block)
                bounds = postings.starts
                out: list[tuple] = []
                for item_id, ids in block.item_terms:
                    terms = np.unique(ids)
                    if postings.count[terms].min() == 0:
                        continue
                    lists = [postings.of(t) for t in terms[np.argsort(postings.count[terms])]]
                    for anchor in lists[0]:
                        d = int(np.searchsorted(bounds, anchor, side="right") - 1)
                        low = max(int(bounds[d]), int(anchor) - span + 1)
                        high = min(int(bounds[d]) + int(postings.lengths[d]), int(anchor) + span)
                        if (start := _tightest(lists, low, high, span)) is not None:
                            out.append((postings.ids[d], item_id, start - int(bounds[d])))
                cols = list(zip(*sorted(set(out), key=str))) or [(), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64())],
                    names=["doc_id", "item_id", "position"],
                )

    return index.mapInArrow(run, "doc_id bigint, item_id string, position bigint")


def _tightest(lists: list[np.ndarray], low: int, high: int, span: int) -> int | None:
    """Start of the first window of ``span`` positions in [low, high) that meets every list."""
    marks = sorted((int(p), k) for k, x in enumerate(lists) for p in x[np.searchsorted(x, low) : np.searchsorted(x, high)])
    seen: dict[int, int] = defaultdict(int)
    left = 0
    for position, k in marks:
        seen[k] += 1
        while position - marks[left][0] >= span or seen[marks[left][1]] > 1:
            seen[marks[left][1]] -= 1
            left += 1
        if len([1 for v in seen.values() if v]) == len(lists):
            return marks[left][0]
    return None


def _blocks(benchmark: DataFrame, block_bytes: int) -> Iterator[Phrases]:
    """The benchmark as blocks of bounded text; each is gathered only after that check."""
    items = benchmark.select(F.col("item_id").cast("string").alias("item_id"), F.col("text").cast("string").alias("text"))
    total = items.agg(F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()[0]
    n = max(1, -(-int(total) // block_bytes))
    key = F.pmod(F.xxhash64("item_id", "text"), F.lit(n))
    for b in range(n):
        rows = (items if n == 1 else items.where(key == b)).toLocalIterator()
        yield Phrases(((r[0], r[1]) for r in rows))


def decontaminate(docs: DataFrame, benchmark: DataFrame, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """Hit spans and items of every document of ``docs`` (doc_id, text): see ``HIT_SCHEMA``.

    A benchmark beyond ``block_bytes`` is searched block by block in the one index; what the
    blocks find in a document is merged by the document's row of the index.
    """
    index = materialize(build_index(docs), "postings")
    blocks = [search(index, phrases) for phrases in _blocks(benchmark, block_bytes)]
    if len(blocks) == 1:
        return blocks[0]
    spans = F.transform(F.arrays_zip("hit_starts", "hit_ends"), lambda x: F.sequence(x.hit_starts, x.hit_ends - 1))
    found = reduce(DataFrame.unionByName, blocks).withColumn("hits", F.flatten(spans))
    merged = found.groupBy("row", "doc_id", "n_words").agg(
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("hits")))).alias("hits"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("items")))).alias("items"),
    )
    return merged.select("row", "doc_id", "n_words", F.col("hits").alias("hit_starts"), F.transform("hits", lambda x: x + 1).alias("hit_ends"), "items")


def summary(hits: DataFrame) -> DataFrame:
    """Counts, the items' digest and the contamination decision of each document."""
    lengths = F.zip_with("hit_ends", "hit_starts", lambda e, s: (e - s).cast("bigint"))
    n_hit = F.aggregate(lengths, F.lit(0).cast("bigint"), lambda a, x: a + x)
    return hits.select(
        "doc_id",
        "n_words",
        n_hit.alias("n_hit"),
        F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
    ).withColumn("contaminated", is_contaminated(F.col("n_hit"), F.col("n_words")))


def is_contaminated(n_hit: Column, n_words: Column) -> Column:
    """At least a twentieth of the words is hit."""
    return (n_hit > 0) & (20 * n_hit >= n_words)


def op10_decontamination(spark, sf_dir: str) -> DataFrame:
    """All documents against the whole benchmark."""
    from placeloom.llm.common import table

    return summary(decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")))


ORACLE_SQL = r"""
WITH d AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM documents),
i AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
           '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS phrase
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM win),
grams AS (
  SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS phrase
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, sizes WHERE len(w) >= n)),
hits AS (SELECT g.doc_id, g.s, g.n, win.item_id FROM grams g JOIN win ON g.phrase = win.phrase AND g.n = win.n),
pos AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM hits) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(pos.n_hit, 0) AS n_hit, coalesce(its.n_items, 0) AS n_items,
       sha256(coalesce(its.ids, '')) AS items_sha256,
       coalesce(pos.n_hit, 0) > 0 AND 20 * coalesce(pos.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN pos ON d.doc_id = pos.doc_id LEFT JOIN its ON d.doc_id = its.doc_id
"""
