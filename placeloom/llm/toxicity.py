"""Convolutional toxicity classifier over hashed word embeddings, trained in numpy.

A word's vector is the sum of the embeddings of its own hash bucket and that of its first
letters.  Filters of several widths slide over the words, each filter's maximum over the whole
text is kept, and a logistic layer turns the maxima into a probability.  Thresholds are
calibrated by language on rows held back from training; the language is guessed from function
words of the text itself, and a score is the probability bent so that its language's threshold
falls on 0.5.

The model is fitted on all labelled rows.  Up to ``SHARD_ROWS`` of them are one task's; more are
dealt by the hash of doc_id into shards that are trained side by side, and after each of ``ROUNDS``
rounds the shards' weights are averaged.  Thresholds then come from all rows held back, counted by
language and step of probability.  Every text is scored whole, in pieces of bounded length that
overlap by the widest filter.

Defined results: null, empty and wordless texts are scored as an empty sequence; labels that are
null are ignored and repeated labels count as their maximum; without rows of both classes every
score is 0; equal texts get equal scores; other columns pass through untouched, and the new column gets
underscores where its name is taken.
"""

from __future__ import annotations

import pickle
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain, groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import discard, fold_of, free, materialize, release, table, trim

#: Labelled rows that one task trains on; more are trained in shards of about as many.
SHARD_ROWS = 8000
#: Times that shards are averaged; each trains ``EPOCHS / ROUNDS`` epochs in between.
ROUNDS = 5
#: Buckets whose weights and rates go from round to round as one row, of 140 KB at most: large
#: rows cost executors many times their size.
RANGE = 1024
#: Steps of probability in which held-back rows of all shards are counted.
STEPS = 4096
#: Labelled ids that are broadcast to pick texts; beyond it the texts are joined by an exchange.
IDS_BOUND = 1_000_000
BUCKETS = 1 << 17
WIDTH = 16
FILTERS = 12
SIZES = (1, 2, 3)
EPOCHS = 10
BATCH = 32
RATE = 0.05
STEM = 4
#: Words that are scored at once.
PIECE = 50_000
#: Least rows of either class that a threshold needs; languages with fewer take that of all rows,
#: and 0.5 where those are too few.
CALIBRATION_ROWS = 15
FOLDS = 5

#: Frequent function words by language.
MARKERS = {
    "en": "the of and to in is that it for was on are with as be at by this from or an",
    "de": "der die und das von mit den zu ist des dem nicht sich auf ein eine auch im für",
    "fr": "le la les et des du un une dans est que qui pour pas sur au avec par ce il",
    "es": "el la los las y del que en un una por con para es se no al lo como su",
    "it": "il di che e la un una per non con del della sono gli alla nel anche",
    "pt": "o a os as e do da que em um uma para com não no na dos se por",
    "nl": "de het een en van ik te dat die in is niet op aan met voor er zijn",
}
LANGUAGES = [*MARKERS, "other"]
_WORDS = re.compile(r"[^\W_]+")
#: Words remembered with their buckets, in each worker.
MEMO_ENTRIES = 150_000


def _bucket(word: str, salt: int) -> int:
    """Bucket 0 is the empty word's and stays zero."""
    return 1 + xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"), salt) % (BUCKETS - 1)


class Buckets:
    """Bucket pairs of the words of a text."""

    def __init__(self) -> None:
        self.memo: dict[str, int] = {}

    def of(self, text: str | None) -> np.ndarray:
        """(words, 2) bucket numbers; one empty word for a text without words."""
        words = _WORDS.findall((text or "").lower())
        memo = self.memo
        try:
            packed = [memo[w] for w in words]
        except KeyError:
            packed = []
            for w in words:
                value = memo.get(w)
                if value is None:
                    if len(memo) >= MEMO_ENTRIES:
                        memo.clear()
                    value = memo[w] = _bucket(w, 1) << 32 | _bucket(w[:STEM], 2)
                packed.append(value)
        codes = np.array(packed or [0], dtype=np.int64)
        return np.stack([codes >> 32, codes & 0xFFFFFFFF], axis=1)


def _marker_table() -> np.ndarray:
    owner = np.full(BUCKETS, -1, dtype=np.int8)
    shared = set()
    for i, words in enumerate(MARKERS.values()):
        for w in words.split():
            b = _bucket(w, 1)
            if owner[b] not in (-1, i):
                shared.add(b)
            owner[b] = i
    owner[list(shared)] = -1
    return owner


def language_of(pairs: np.ndarray, markers: np.ndarray) -> int:
    """The language whose own function words are most frequent; the last one where there are none."""
    seen = markers[pairs[:, 0]]
    counts = np.bincount(seen[seen >= 0], minlength=len(MARKERS))
    return int(counts.argmax()) if counts.any() else len(MARKERS)


@dataclass
class Model:
    """Weights and thresholds of a trained classifier."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    shifts: list[np.ndarray]
    weights: np.ndarray
    bias: float
    thresholds: np.ndarray
    trained: bool = True

    def pooled(self, pairs: list[np.ndarray]) -> np.ndarray:
        """Maxima of all filters over each text."""
        out = np.zeros((len(pairs), FILTERS * len(SIZES)), dtype=np.float32)
        # (text, words, starts of windows in them)
        group: list[tuple[int, np.ndarray, int]] = []
        size = 0
        reach = max(SIZES) - 1
        for i, p in enumerate(pairs):
            for start in range(0, max(1, len(p) - reach if len(p) > PIECE else 1), PIECE):
                piece = p[start : start + PIECE + reach] if len(p) > PIECE else p
                last = start + len(piece) == len(p)
                if size + len(piece) > PIECE and group:
                    self._pool(group, out)
                    group, size = [], 0
                group.append((i, piece, len(piece) if last else PIECE))
                size += len(piece)
        if group:
            self._pool(group, out)
        return out

    def _pool(self, group: list[tuple[int, np.ndarray, int]], out: np.ndarray) -> None:
        x, starts, _ = _packed([p for _, p, _ in group], self.embedding)
        at = np.stack([starts, starts + [n for _, _, n in group]], axis=1).ravel()
        owners = np.array([i for i, _, _ in group])
        for k, (w, b) in enumerate(zip(self.filters, self.shifts)):
            c = _convolved(x, w, b)
            peak = np.maximum.reduceat(c, at, axis=0)[::2]
            np.maximum.at(out[:, k * FILTERS : (k + 1) * FILTERS], owners, peak)

    def probability(self, pairs: list[np.ndarray]) -> np.ndarray:
        if not self.trained or not pairs:
            return np.zeros(len(pairs))
        z = self.pooled(pairs).astype(np.float64) @ self.weights + self.bias
        return 1 / (1 + np.exp(-np.clip(z, -50, 50)))

    def score(self, pairs: list[np.ndarray], markers: np.ndarray) -> np.ndarray:
        """Probabilities, bent so that each language's threshold lies at 0.5."""
        p = self.probability(pairs)
        if not self.trained:
            return p
        t = self.thresholds[[language_of(x, markers) for x in pairs]] if pairs else p
        return np.where(p < t, 0.5 * p / t, 0.5 + 0.5 * (p - t) / (1 - t))


def _packed(pairs: list[np.ndarray], embedding: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Word vectors of all texts in a row, each followed by empty words; where each begins and ends."""
    pad = np.zeros((max(SIZES), 2), dtype=np.int32)
    lengths = np.array([len(p) for p in pairs])
    starts = np.concatenate([[0], np.cumsum(lengths + len(pad))[:-1]])
    ids = np.concatenate([x for p in pairs for x in (p, pad)])
    return embedding[ids[:, 0]] + embedding[ids[:, 1]], starts, starts + lengths


def _convolved(x: np.ndarray, w: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Rectified filter values at each start; the last starts repeat the bias."""
    n = len(x) - len(w) + 1
    c = x[:n] @ w[0]
    for j in range(1, len(w)):
        c += x[j : j + n] @ w[j]
    c += b
    np.maximum(c, 0, out=c)
    return np.concatenate([c, np.zeros((len(w) - 1, c.shape[1]), dtype=c.dtype)]) if len(w) > 1 else c


class _Adagrad:
    def __init__(self, *arrays: np.ndarray):
        self.sums = [np.full(a.shape, 1e-4, dtype=np.float32) for a in arrays]
        self.arrays = arrays

    def step(self, i: int, grad: np.ndarray, rows: np.ndarray | slice = slice(None)) -> None:
        self.sums[i][rows] += grad * grad
        self.arrays[i][rows] -= RATE * grad / np.sqrt(self.sums[i][rows])


def train(pairs: list[np.ndarray], labels: np.ndarray, weights: tuple[float, float] = (1.0, 1.0)) -> Model:
    """Fit on texts given as bucket pairs; ``weights`` are rows that one row of each class stands for."""
    model, adapt, bias = _fresh()
    if len(set(labels.tolist())) < 2:
        model.trained = False
        return model
    held = np.arange(len(labels)) % 5 == 4
    rows = np.flatnonzero(~held)
    _epochs(model, adapt, bias, pairs, labels, rows, EPOCHS, np.random.default_rng(7))
    model.bias = float(bias[0])
    back = np.flatnonzero(held) if held.any() else rows
    model.thresholds = _thresholds(model, [pairs[i] for i in back], labels[back], weights)
    return model


def _fresh() -> tuple[Model, _Adagrad, np.ndarray]:
    """An untrained model, its adaptive rates and its bias."""
    rng = np.random.default_rng(7)
    width = FILTERS * len(SIZES)
    embedding = rng.normal(0, 0.1, (BUCKETS, WIDTH)).astype(np.float32)
    embedding[0] = 0
    filters = [rng.normal(0, 1 / np.sqrt(k * WIDTH), (k, WIDTH, FILTERS)).astype(np.float32) for k in SIZES]
    shifts = [np.zeros(FILTERS, dtype=np.float32) for _ in SIZES]
    out = rng.normal(0, 1 / np.sqrt(width), width).astype(np.float32)
    bias = np.zeros(1, dtype=np.float32)
    model = Model(embedding, filters, shifts, out, 0.0, np.full(len(LANGUAGES), 0.5))
    return model, _Adagrad(embedding, *filters, *shifts, out, bias), bias


def _epochs(model: Model, adapt: _Adagrad, bias: np.ndarray, pairs: list[np.ndarray], labels: np.ndarray, rows: np.ndarray, epochs: int, rng: np.random.Generator) -> None:
    for _ in range(epochs):
        for batch in np.array_split(rng.permutation(rows), max(1, len(rows) // BATCH)):
            _step(model, adapt, [pairs[i] for i in batch], labels[batch], bias)


def _step(model: Model, adapt: _Adagrad, pairs: list[np.ndarray], labels: np.ndarray, bias: np.ndarray) -> None:
    x, starts, ends = _packed(pairs, model.embedding)
    pad = np.zeros((max(SIZES), 2), dtype=np.int32)
    ids = np.concatenate([v for p in pairs for v in (p, pad)])
    peaks, places = [], []
    for w, b in zip(model.filters, model.shifts):
        c = _convolved(x, w, b)
        place = np.stack([s + c[s:e].argmax(axis=0) for s, e in zip(starts, ends)])
        places.append(place)
        peaks.append(np.take_along_axis(c, place, axis=0))
    h = np.concatenate(peaks, axis=1)
    z = h @ model.weights + bias[0]
    error = ((1 / (1 + np.exp(-np.clip(z, -50, 50)))) - labels).astype(np.float32) / len(labels)
    back = error[:, None] * model.weights[None, :] * (h > 0)
    n = len(SIZES)
    touched: list[np.ndarray] = []
    grads: list[np.ndarray] = []
    for k, size in enumerate(SIZES):
        g = back[:, k * FILTERS : (k + 1) * FILTERS]
        w = model.filters[k]
        grad = np.empty_like(w)
        for j in range(size):
            at = places[k] + j
            grad[j] = np.einsum("nf,nfd->df", g, x[at])
            touched.append(at.ravel())
            grads.append((g[:, :, None] * w[j].T[None]).reshape(-1, WIDTH))
        adapt.step(1 + k, grad)
        adapt.step(1 + n + k, g.sum(axis=0))
    adapt.step(1 + 2 * n, h.T @ error)
    adapt.step(2 + 2 * n, error.sum(keepdims=True))
    where, change = np.concatenate(touched), np.concatenate(grads)
    live = np.abs(change).sum(axis=1) > 0
    buckets, change = ids[where[live]], change[live]
    both, twice = buckets.T.ravel(), np.concatenate([change, change])
    keep = both > 0
    unique, inverse = np.unique(both[keep], return_inverse=True)
    summed = np.zeros((len(unique), WIDTH), dtype=np.float32)
    np.add.at(summed, inverse, twice[keep])
    adapt.step(0, summed, unique)


def _thresholds(model: Model, pairs: list[np.ndarray], labels: np.ndarray, weights: tuple[float, float]) -> np.ndarray:
    """By language, the threshold of the highest F1 where classes have their own shares again."""
    p = model.probability(pairs)
    markers = _marker_table()
    language = np.array([language_of(x, markers) for x in pairs])
    enough = lambda own: min((labels[own] == 1).sum(), (labels[own] == 0).sum()) >= CALIBRATION_ROWS
    every = np.ones(len(labels), dtype=bool)
    out = np.full(len(LANGUAGES), _best(p, labels, weights) if enough(every) else 0.5)
    for i in range(len(LANGUAGES)):
        own = language == i
        if enough(own):
            out[i] = _best(p[own], labels[own], weights)
    return np.clip(out, 0.02, 0.98)


def _best(p: np.ndarray, labels: np.ndarray, weights: tuple[float, float]) -> float:
    order = np.argsort(-p, kind="stable")
    ranked = p[order]
    return _cut(ranked, ranked, (labels[order] == 0) * weights[0], (labels[order] == 1) * weights[1])


def _cut(low: np.ndarray, high: np.ndarray, clean: np.ndarray, toxic: np.ndarray) -> float:
    """Cut of the highest F1 through falling steps of probability, from ``low`` to ``high``, that hold so many rows of each class."""
    hit, wrong = np.cumsum(toxic), np.cumsum(clean)
    f1 = 2 * hit / np.maximum(1e-9, hit + wrong + toxic.sum())
    # a cut lies in the middle of the gap between neighbouring probabilities
    below = np.append(high[1:], 0.0)
    f1 = np.where(low > below, f1, -1)
    best = int(f1.argmax())
    return float((low[best] + below[best]) / 2)


def fit(docs: DataFrame, labels: DataFrame, shard_rows: int = SHARD_ROWS) -> Model:
    """Train on all labelled documents outside the held-out fold, in shards of about ``shard_rows``."""
    known = (
        labels.where(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & (fold_of("doc_id", FOLDS) != 0))
        .groupBy("doc_id")
        .agg(F.max("toxic").cast("int").alias("toxic"))
    )
    known = materialize(known, "labelled")
    n = known.count()
    shards = max(1, -(-n // shard_rows))
    plain = docs.select(F.col("doc_id"), F.col("text").cast("string").alias("text"))
    sample = plain.join(F.broadcast(known) if n <= IDS_BOUND else known, "doc_id").select("doc_id", "text", "toxic")

    def bucketed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets = Buckets()
        for batch in batches:
            raw = [buckets.of(x.as_py()).astype(np.int32).tobytes() for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), pa.array(raw, pa.binary())], names=["doc_id", "toxic", "pairs"])
        del buckets
        trim()

    rows = sample.mapInArrow(bucketed, "doc_id bigint, toxic int, pairs binary").withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int"))
    if shards > 1:
        rows = materialize(rows, "training-rows", BATCH_ROWS)
        model = _averaged(rows, shards)
        discard(rows, known)
        return model

    def trained(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, pairs, toxic in _shards(batches):
            model = pickle.dumps(train(pairs, toxic))
            del pairs, toxic
            yield pa.RecordBatch.from_arrays([pa.array([model], pa.binary())], names=["model"])
        trim()

    # one task trains; the driver sees the model alone
    made = rows.repartition(1).mapInArrow(trained, "model binary").collect()
    discard(known)
    return pickle.loads(made[0][0]) if made else train([], np.empty(0, dtype=np.int64))


def _shards(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[np.ndarray], np.ndarray]]:
    """(shard, bucket pairs, labels) of rows (doc_id, toxic, pairs, shard) that are sorted by shard, in hash order of doc_id."""
    own: list[tuple] = []
    current = -1

    def done() -> tuple[int, list[np.ndarray], np.ndarray]:
        own.sort(key=lambda r: r[0])
        return current, [np.frombuffer(raw, dtype=np.int32).reshape(-1, 2) for (_, raw), _ in own], np.array([t for _, t in own], dtype=np.int64)

    for batch in batches:
        for doc_id, toxic, raw, shard in zip(*(c.to_pylist() for c in batch.columns)):
            if shard != current and own:
                yield done()
                own = []
            current = shard
            own.append(((xxhash.xxh64_intdigest(str(doc_id)), raw), toxic))
    if own:
        yield done()


def _dealt(rows: DataFrame, state: DataFrame | None, tasks: int) -> DataFrame:
    """``rows`` with every shard in one of ``tasks`` partitions, behind a copy of the state; shard -1 is the state's."""
    rows = rows.withColumn("part", F.pmod("shard", F.lit(tasks)))
    if state is not None:
        none = [F.lit(None).cast("bigint").alias("doc_id"), F.lit(None).cast("int").alias("toxic")]
        rows = rows.unionByName(state.select(*none, F.col("state").alias("pairs"), F.lit(-1).alias("shard"), F.explode(F.sequence(F.lit(0), F.lit(tasks - 1))).alias("part")))
    dealt = rows.repartitionById(tasks, F.col("part")) if hasattr(rows, "repartitionById") else rows.repartition(tasks, "part")
    return dealt.drop("part").sortWithinPartitions("shard")


def _peeled(batches: Iterator[pa.RecordBatch]) -> tuple[tuple[list[np.ndarray], list[np.ndarray]], Iterator[pa.RecordBatch]]:
    """Weights and rates of the state in front of a partition of ``_dealt``, those before the first round without one, and the batches behind it."""
    state = _begun()
    for batch in batches:
        ahead = 0
        while ahead < batch.num_rows and batch.column(3)[ahead].as_py() < 0:
            _put(state, pickle.loads(batch.column(2)[ahead].as_buffer()))
            ahead += 1
        if ahead < batch.num_rows:
            return state, chain([batch.slice(ahead)], batches)
    return state, iter(())


def _averaged(rows: DataFrame, shards: int) -> Model:
    """A model of all shards of the written ``rows``: each round they train side by side from one model, then their weights and rates are averaged.

    Models go from round to round as written tables, a range of buckets a row, and every range is
    averaged by itself; the driver sees the last model alone.
    """
    tasks = min(shards, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if rows.select("toxic").distinct().count() < 2:
        return train([], np.empty(0, dtype=np.int64))

    def trained(at: int):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            weighed = _Mean()
            state, batches = _peeled(batches)
            for shard, pairs, toxic in _shards(batches):
                model, adapt, bias = _restored(state)
                own = np.flatnonzero(np.arange(len(toxic)) % 5 != 4)
                _epochs(model, adapt, bias, pairs, toxic, own, EPOCHS // ROUNDS, np.random.default_rng((7, at, shard)))
                moved = (adapt.sums[0] != state[1][0]).any(axis=1)
                weighed.add(adapt.arrays, adapt.sums, moved * np.float64(len(own)), len(own))
                del model, adapt, bias, pairs
            if weighed.rows:
                yield from _state_rows(*weighed.mean(), weighed.weight, weighed.rows)
            del weighed, state
            trim()

        return run

    def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = (row for batch in batches for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2)))
        for place, own in groupby(each, key=lambda r: r[0]):
            listed = [(n, pickle.loads(raw.as_buffer())) for _, n, raw in own]
            yield _state_row(place, sum(n for n, _ in listed if n > 0), _joined_head(listed) if place < 0 else _joined_range(listed))
        trim()

    def judged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        markers = _marker_table()
        state, batches = _peeled(batches)
        for _, pairs, toxic in _shards(batches):
            pairs, toxic = pairs[4::5], toxic[4::5]
            language = [language_of(x, markers) for x in pairs]
            columns = [pa.array(language, pa.int32()), pa.array(_model_of(state).probability(pairs), pa.float64()), pa.array(toxic, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["language", "p", "toxic"])
        trim()

    def weights(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for raw in batch.column(2):
                buckets, arrays, rates, weight = pickle.loads(raw.as_buffer())
                yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps((buckets, arrays, None, None))], pa.binary())], names=["state"])
        trim()

    state = None
    for at in range(ROUNDS):
        parts = materialize(_dealt(rows, state, tasks).mapInArrow(trained(at), _STATE), "shard-models", BATCH_ROWS)
        every = parts if state is None else parts.unionByName(state.withColumn("rows", F.lit(-1).cast("bigint")))
        # sorted, so that sums of one input are always the same; the state before comes first
        met = every.repartition("range").sortWithinPartitions("range", "rows", F.xxhash64("state"))
        one = materialize(met.mapInArrow(joined, _STATE), "model", BATCH_ROWS)
        discard(parts, *([] if state is None else [state]))
        state = one
    seen = materialize(_dealt(rows, state, tasks).mapInArrow(judged, "language int, p double, toxic bigint"), "judged", BATCH_ROWS)
    thresholds = _counted_thresholds(seen)
    last = _begun()
    for row in state.mapInArrow(weights, "state binary").collect():
        _put(last, pickle.loads(row["state"]))
    model = _model_of(last)
    model.thresholds = thresholds
    discard(state, seen)
    release(rows.sparkSession)
    return model


_STATE = "range int, rows bigint, state binary"
#: Rows of training tables that Spark's reader holds at once.
BATCH_ROWS = 128


class _Mean:
    """Mean of arrays and rates, weighed by rows; of the embeddings, only over shards that have seen them, so that rare words don't fade."""

    def __init__(self) -> None:
        self.rows = 0
        self.weight = np.zeros(BUCKETS)
        self.sums: tuple[list[np.ndarray], ...] = ([], [])

    def add(self, arrays: list[np.ndarray], rates: list[np.ndarray], weight: np.ndarray, rows: int) -> None:
        each = [weight[:, None], *[np.float64(rows)] * (len(arrays) - 1)]
        if not self.rows:
            self.sums = tuple([x * w for x, w in zip(xs, each)] for xs in (arrays, rates))
        else:
            for mine, xs in zip(self.sums, (arrays, rates)):
                for m, x, w in zip(mine, xs, each):
                    m += x * w
        self.weight += weight
        self.rows += rows

    def mean(self) -> tuple[list[np.ndarray], list[np.ndarray]]:
        whole = [np.maximum(self.weight, 1.0)[:, None], *[self.rows] * (len(self.sums[0]) - 1)]
        arrays, rates = ([(x / w).astype(np.float32) for x, w in zip(xs, whole)] for xs in self.sums)
        return arrays, rates


def _state_row(place: int, rows: int, state: tuple) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([place], pa.int32()), pa.array([rows], pa.int64()), pa.array([pickle.dumps(state)], pa.binary())], names=["range", "rows", "state"])


def _state_rows(arrays: list[np.ndarray], rates: list[np.ndarray], weight: np.ndarray, rows: int) -> Iterator[pa.RecordBatch]:
    """Rows of a state: buckets (null: the layers above them), weights, rates, and rows that each bucket's stand for.

    Buckets that no shard has moved are left out.
    """
    yield _state_row(-1, rows, (None, arrays[1:], rates[1:], None))
    for start in range(0, BUCKETS, RANGE):
        buckets = start + np.flatnonzero(weight[start : start + RANGE])
        if len(buckets):
            yield _state_row(start // RANGE, rows, (buckets, arrays[0][buckets], rates[0][buckets], weight[buckets]))


def _put(state: tuple[list[np.ndarray], list[np.ndarray]], row: tuple) -> None:
    """Put the content of a row into weights and rates."""
    buckets, arrays, rates, _ = row
    for now, new in zip(state, (arrays, rates)):
        if new is None:
            continue
        if buckets is None:
            now[1:] = new
        else:
            now[0][buckets] = new


def _joined_head(listed: list[tuple[int, tuple]]) -> tuple:
    """Means of the layers above the buckets, of (rows, content); rows under 0 are of the state before."""
    weighed = [(n, content) for n, content in listed if n > 0]
    rows = sum(n for n, _ in weighed)
    means = ([(sum(x * np.float64(n) for n, x in zip([n for n, _ in weighed], xs)) / rows).astype(np.float32) for xs in zip(*(content[k] for _, content in weighed))] for k in (1, 2))
    return None, *means, None


def _joined_range(listed: list[tuple[int, tuple]]) -> tuple:
    """Means of a range's buckets over those that have moved them; others keep their values of the state before."""
    start = min(int(content[0][0]) for _, content in listed) // RANGE * RANGE
    whole, sums = np.zeros(RANGE), np.zeros((2, RANGE, WIDTH))
    before = None
    for n, (buckets, arrays, rates, weight) in listed:
        if n < 0:
            before = buckets - start, arrays, rates
            continue
        whole[buckets - start] += weight
        sums[0, buckets - start] += arrays * weight[:, None]
        sums[1, buckets - start] += rates * weight[:, None]
    moved = np.flatnonzero(whole)
    out = np.zeros((2, RANGE, WIDTH), dtype=np.float32)
    known = whole > 0
    if before is not None:
        known[before[0]] = True
        out[0, before[0]], out[1, before[0]] = before[1:]
    out[:, moved] = sums[:, moved] / whole[moved, None]
    at = np.flatnonzero(known)
    return start + at, out[0, at], out[1, at], None


def _begun() -> tuple[list[np.ndarray], list[np.ndarray]]:
    """Weights and rates before the first round."""
    adapt = _fresh()[1]
    return list(adapt.arrays), adapt.sums


def _restored(state: tuple[list[np.ndarray], list[np.ndarray]]) -> tuple[Model, _Adagrad, np.ndarray]:
    """A model with copies of given weights and rates."""
    model = _model_of(([x.copy() for x in state[0]], state[1]))
    arrays = [model.embedding, *model.filters, *model.shifts, model.weights, state[0][-1].copy()]
    adapt = _Adagrad(*arrays)
    adapt.sums = [x.copy() for x in state[1]]
    return model, adapt, arrays[-1]


def _model_of(state: tuple[list[np.ndarray], list[np.ndarray]]) -> Model:
    arrays, n = state[0], len(SIZES)
    return Model(arrays[0], arrays[1 : 1 + n], arrays[1 + n : 1 + 2 * n], arrays[1 + 2 * n], float(arrays[-1][0]), np.full(len(LANGUAGES), 0.5))


def _counted_thresholds(rows: DataFrame) -> np.ndarray:
    """Thresholds as of ``_thresholds`` from ``rows`` (language, p, toxic), counted by language and step of probability."""
    rows = rows.withColumn("step", F.floor(F.col("p") * STEPS))
    counted = rows.groupBy("language", "step").agg(F.min("p").alias("low"), F.max("p").alias("high"), F.sum(1 - F.col("toxic")).alias("clean"), F.sum("toxic").alias("toxic"))
    # (STEPS + 1) * len(LANGUAGES) rows at most
    listed = counted.orderBy(F.desc("step"), "language").collect()
    language, step = (np.array([r[c] for r in listed], dtype=np.int64) for c in ("language", "step"))
    low, high, clean, toxic = (np.array([r[c] for r in listed], dtype=np.float64) for c in ("low", "high", "clean", "toxic"))

    def cut(own: np.ndarray) -> float | None:
        if min(clean[own].sum(), toxic[own].sum()) < CALIBRATION_ROWS:
            return None
        at = np.flatnonzero(np.diff(step[own], prepend=step[own][0] + 1))
        return _cut(np.minimum.reduceat(low[own], at), np.maximum.reduceat(high[own], at), np.add.reduceat(clean[own], at), np.add.reduceat(toxic[own], at))

    every = cut(np.ones(len(listed), dtype=bool)) if listed else None
    out = np.full(len(LANGUAGES), 0.5 if every is None else every)
    for i in range(len(LANGUAGES)):
        own = cut(language == i)
        if own is not None:
            out[i] = own
    return np.clip(out, 0.02, 0.98)


def score(docs: DataFrame, model: Model, column: str = "score") -> DataFrame:
    """``docs`` with a column of scores, its name followed by underscores where it is taken; only the text is read for it."""
    column = free(docs, column)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        buckets, markers = Buckets(), _marker_table()
        for whole in batches:
            for start in range(0, whole.num_rows, 500):
                batch = whole.slice(start, 500)
                values = shared.value.score([buckets.of(x.as_py()) for x in batch.column(at)], markers)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, pa.float64())], names=names)
        del buckets
        trim()

    return docs.mapInArrow(run, schema)


def reject_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of ``docs`` that score under 0.5, with their own columns."""
    column = free(docs, "toxicity_score")
    return score(docs, fit(docs, labels), column).where(F.col(column) < 0.5).drop(column)


def op1_toxicity(spark, sf_dir: str) -> DataFrame:
    """Scores of all documents; labels of the held-out fold are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id",
        (fold_of("doc_id", FOLDS) == 0).alias("held_out"),
        "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
