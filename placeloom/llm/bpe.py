"""Byte-level BPE with a hierarchical-bitmap rank queue.

Each pre-token is merged by a queue whose buckets, one per merge rank, hold the linked-list
positions of the pairs of that rank.  A three-level bitmap over the ranks gives the lowest
occupied rank by find-first-set, and entries whose pair has changed since are skipped when they
come up.  A merge so costs a constant number of word operations and one bucket operation,
whatever the length of the pre-token.  Short pre-tokens that recur are remembered in a bounded
table.

Defined results: a null text encodes as the empty one, to no ids; equal texts give equal ids;
special-token strings are ordinary text; very long texts and pre-tokens are encoded whole; other
columns pass through untouched.
"""

from __future__ import annotations

import base64
import heapq
import itertools
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import table

VOCABULARY = "byte_bpe_multi_50k.tiktoken"
#: Pre-tokens up to this many bytes are remembered, this many at a time.
MEMO_BYTES = 48
MEMO_ENTRIES = 400_000


class RankQueue:
    """Positions by rank: three levels of 64-bit words over the occupied ranks.

    The words are empty again when the queue has run empty, so one queue serves all pre-tokens.
    """

    def __init__(self, ranks: int) -> None:
        self.top = 0
        self.mid = [0] * ((ranks >> 12) + 1)
        self.low = [0] * ((ranks >> 6) + 1)
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        bucket = self.buckets.get(rank)
        if bucket is None:
            self.buckets[rank] = [position]
            a, b = rank >> 6, rank >> 12
            self.low[a] |= 1 << (rank & 63)
            self.mid[b] |= 1 << (a & 63)
            self.top |= 1 << b
        else:
            heapq.heappush(bucket, position)

    def pop(self) -> tuple[int, int]:
        """The lowest rank and its leftmost position; the queue must not be empty."""
        b = (self.top & -self.top).bit_length() - 1
        mid = self.mid[b]
        a = b << 6 | (mid & -mid).bit_length() - 1
        low = self.low[a]
        rank = a << 6 | (low & -low).bit_length() - 1
        bucket = self.buckets[rank]
        if len(bucket) > 1:
            return rank, heapq.heappop(bucket)
        del self.buckets[rank]
        self.low[a] = low = low & (low - 1)
        if not low:
            self.mid[b] = mid = mid & (mid - 1)
            if not mid:
                self.top &= self.top - 1
        return rank, bucket[0]


class _Memo(dict):
    """Packed ids of short pre-tokens, in two generations: the older goes when the newer is full."""

    def __init__(self, merge) -> None:
        super().__init__()
        self.merge = merge
        self.older: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.older.get(piece)
        if ids is None:
            raw = piece.encode()
            ids = array("i", self.merge(raw)).tobytes()
            if len(raw) > MEMO_BYTES:
                return ids
        if len(self) >= MEMO_ENTRIES:
            self.older = dict(self)
            self.clear()
        self[piece] = ids
        return ids


def load_ranks(path: str) -> dict[bytes, int]:
    """Rank file: a base64 token and its rank on each line."""
    with open(path, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (x.split() for x in lines if x.strip())}


class Codec:
    """Encoder and decoder over one rank table and one splitting pattern."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        self.ranks = ranks
        self.longest = max(map(len, ranks), default=1)
        self.tokens = {rank: token for token, rank in ranks.items()}
        self.split = regex.compile(pattern).findall
        self.queue = RankQueue(max(self.tokens, default=0))
        self.memo = _Memo(self.merge)

    def merge(self, word: bytes) -> list[int]:
        """Ids of one pre-token."""
        find = self.ranks.get
        whole = find(word)
        if whole is not None:
            return [whole]
        n, longest, queue = len(word), self.longest, self.queue
        buckets, low, mid, push = queue.buckets, queue.low, queue.mid, queue.push
        after = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        # pair[i]: rank of the token at i joined with the next; None: none, or i is merged away
        pair = [find(word[i : i + 2]) for i in range(n - 1)]
        pair.append(None)
        for i, rank in enumerate(pair):
            if rank is not None:
                if rank in buckets:
                    buckets[rank].append(i)
                else:
                    push(rank, i)
        while top := queue.top:
            # find-first-set on the three levels, as in pop()
            b = (top & -top).bit_length() - 1
            bits = mid[b]
            a = b << 6 | (bits & -bits).bit_length() - 1
            bits = low[a]
            rank = a << 6 | (bits & -bits).bit_length() - 1
            bucket = buckets[rank]
            if len(bucket) > 1:
                i = heapq.heappop(bucket)
            else:
                i = bucket[0]
                del buckets[rank]
                low[a] = bits = bits & (bits - 1)
                if not bits:
                    mid[b] = bits = mid[b] & (mid[b] - 1)
                    if not bits:
                        queue.top = top & (top - 1)
            if pair[i] != rank:
                continue
            j = after[i]
            pair[j] = None
            k = after[i] = after[j]
            joined = None
            if k < n:
                before[k] = i
                end = after[k]
                if end - i <= longest and (joined := find(word[i:end])) is not None:
                    push(joined, i)
            pair[i] = joined
            h = before[i]
            if h >= 0:
                joined = find(word[h:k]) if k - h <= longest else None
                if joined != pair[h]:
                    pair[h] = joined
                    if joined is not None:
                        push(joined, h)
        ids, i = [], 0
        while i < n:
            ids.append(find(word[i : after[i]]))
            i = after[i]
        return ids

    def encode(self, text: str) -> np.ndarray:
        """Ids of a whole text."""
        return np.frombuffer(b"".join(map(self.memo.__getitem__, self.split(text))), dtype=np.int32)

    def decode(self, ids: np.ndarray) -> bytes:
        """Bytes of an array of ids."""
        return b"".join(map(self.tokens.__getitem__, ids.tolist()))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(path: str, pattern: str) -> Codec:
    """The worker's codec for a rank file; made once in each process."""
    made = _CODECS.get((path, pattern))
    if made is None:
        made = _CODECS[path, pattern] = Codec(load_ranks(path), pattern)
    return made


def _free(df: DataFrame, name: str) -> str:
    """A column name that ``df`` doesn't have yet."""
    taken = {c.lower() for c in df.columns}
    return name if name not in taken else next(f"{name}_{i}" for i in itertools.count(1) if f"{name}_{i}" not in taken)


def code_documents(
    docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str | None = "ids", packed: str | None = None, decoded: str | None = None
) -> DataFrame:
    """``docs`` with the columns that are named: ids (array<int>), their little-endian bytes, the bytes decoded from them.

    One pass encodes and decodes, so the ids leave the worker only if they are asked for.  A name
    that ``docs`` has already gets a number.
    """
    at = docs.columns.index(text)
    kinds = ((ids, T.ArrayType(T.IntegerType())), (packed, T.BinaryType()), (decoded, T.BinaryType()))
    schema = T.StructType([*docs.schema.fields, *[T.StructField(_free(docs, n), k) for n, k in kinds if n]])
    names = schema.fieldNames()
    want_ids, want_packed, want_decoded = (n is not None for n, _ in kinds)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made = codec(path, pattern)
        for whole in batches:
            for start in range(0, whole.num_rows, 250):
                batch = whole.slice(start, 250)
                parts = [made.encode(x.as_py() or "") for x in batch.column(at)]
                out = list(batch.columns)
                if want_ids:
                    ends = np.cumsum([0, *map(len, parts)])
                    out.append(pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(parts), pa.int32())))
                if want_packed:
                    out.append(pa.array([p.astype("<u4").tobytes() for p in parts], pa.binary()))
                if want_decoded:
                    out.append(pa.array([made.decode(p) for p in parts], pa.binary()))
                yield pa.RecordBatch.from_arrays(out, names=names)

    return docs.mapInArrow(run, schema)


def encode_documents(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """``docs`` with a column of token ids (array<int>)."""
    return code_documents(docs, path, pattern, text, ids)


def decode_documents(encoded: DataFrame, path: str, pattern: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """``encoded`` with the decoded bytes and the packed little-endian ids."""
    out, packed = _free(encoded, decoded), _free(encoded, "packed_ids")
    at = encoded.columns.index(ids)
    schema = T.StructType(
        [*encoded.schema.fields, T.StructField(out, T.BinaryType()), T.StructField(packed, T.BinaryType())]
    )
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decode = codec(path, pattern).decode
        for whole in batches:
            for start in range(0, whole.num_rows, 250):
                batch = whole.slice(start, 250)
                texts, raw = [], []
                for x in batch.column(at):
                    values = x.values.to_numpy(zero_copy_only=False) if x.is_valid else np.empty(0, dtype=np.int32)
                    texts.append(decode(values))
                    raw.append(values.astype("<u4").tobytes())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array(texts, pa.binary()), pa.array(raw, pa.binary())],
                    names=names,
                )

    return encoded.mapInArrow(run, schema)


def public_vocabulary() -> tuple[str, str]:
    """Path and splitting pattern of the installed public rank file."""
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY), public_tokenizers.PATTERN


def digests(docs: DataFrame, path: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row of ``docs``."""
    plain = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    back = code_documents(plain, path, pattern, ids=None, packed="packed", decoded="decoded")
    return back.select(
        "doc_id",
        (F.octet_length("packed") / 4).cast("bigint").alias("n_tokens"),
        F.sha2("packed", 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op3_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """All documents under the public many-language ranks."""
    return digests(table(spark, sf_dir, "documents"), *public_vocabulary())
