"""Language identification by segmentation-marginalised unigrams.

Every language has probabilities for the pieces of a fixed public vocabulary.  The probability of
a word is the sum over all its segmentations into pieces of the product of their probabilities,
which a forward pass over the word's characters gives; a text's log-probability is the sum over
its words.  The pieces' probabilities are trained by expectation-maximisation over the same sums
(forward-backward), on all words of a bounded sample of labelled documents, counted by language;
every round is one pass over the table of these words, and the driver sees sums by piece alone.

A word's likelihoods are computed once for all languages and remembered in a bounded table.  The
model holds one number for each piece and language; what is computed at once is bounded in bytes.

Defined results: a text that is null or has no letter is ``und`` with score 0; without training
rows all others are ``und`` too; ties go to the alphabetically first language; equal texts get
equal results; repeated rows count as often as they stand in training; other columns pass through.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from placeloom.llm.common import discard, fold_of, free, materialize, table

#: Bound of the training sample: documents of each language, chosen by the hash of doc_id (the
#: expected number).
TRAIN_PER_LANGUAGE = 1500
ROUNDS = 4
#: Share of a language's probability that is spread over all pieces.
SMOOTHING = 0.02
#: Words of more letters are computed one by one, in logarithms.
WORD_LETTERS = 64
#: Words that are remembered, and the bytes that their likelihoods may take.
MEMO_ENTRIES = 600_000
MEMO_BYTES = 64 << 20
FOLDS, HELD_OUT = 4, 2
VOCABULARY = "piece_bpe_32k.model"
UNKNOWN = "und"

_WORD = regex.compile(r"\p{L}+")
#: Words that are computed together, and bytes that their positions may take.
CHUNK = 4000
CHUNK_BYTES = 16 << 20
#: Expected counts are summed up as multiples of this, so that sums don't depend on their order.
STEP = 2.0**-20


def public_pieces(path: str | None = None) -> list[str]:
    """Lower-case pieces of letters in the public vocabulary; a word's start is marked by ``_``."""
    import public_tokenizers
    import sentencepiece

    made = sentencepiece.SentencePieceProcessor(model_file=path or public_tokenizers.path(VOCABULARY))
    pieces = set()
    for i in range(made.get_piece_size()):
        if not (made.is_control(i) or made.is_unknown(i) or made.is_byte(i)):
            text = made.id_to_piece(i).lower()
            body = text.removeprefix("▁")
            if body and regex.fullmatch(r"\p{L}+", body):
                pieces.add(("_" if text != body else "") + body)
    return sorted(pieces)


def words_of(text: str) -> list[str]:
    """Runs of letters in lower case."""
    return _WORD.findall(text.lower())


class Lattice:
    """All segmentations of a chunk of words, as spans (word, start, end, piece) ordered by start.

    Every word is marked at its start.  Lone letters are always pieces: the vocabulary's, or the
    one that stands for unknown letters.  The bare mark is the piece of probability 1.
    """

    def __init__(self, words: list[str], index: dict[str, int], longest: int):
        find, other = index.get, len(index)
        mark = other + 1
        spans: list[tuple[int, int, int, int]] = []
        add = spans.append
        for w, word in enumerate(words):
            marked = "_" + word
            n = len(marked)
            add((0, w, 1, mark))
            for j in range(2, min(n, longest) + 1):
                piece = find(marked[:j])
                if piece is not None:
                    add((0, w, j, piece))
            for i in range(1, n):
                add((i, w, i + 1, find(marked[i : i + 1], other)))
                for j in range(i + 2, min(n, i + longest) + 1):
                    piece = find(marked[i:j])
                    if piece is not None:
                        add((i, w, j, piece))
        table = np.array(spans, dtype=np.int32).reshape(-1, 4)
        table = table[np.argsort(table[:, 0], kind="stable")]
        self.start, self.word, self.end, self.piece = table.T
        self.lengths = np.array([len(w) + 1 for w in words])
        self.cuts = np.searchsorted(self.start, np.arange(self.lengths.max() + 1)) if words else np.zeros(1, dtype=int)

    def forward(self, p: np.ndarray) -> np.ndarray:
        """Probability of reaching each position; ``p`` by piece and language."""
        alpha = np.zeros((len(self.lengths), int(self.lengths.max()) + 1, p.shape[1]))
        alpha[:, 0] = 1
        for i in range(len(self.cuts) - 1):
            at = slice(self.cuts[i], self.cuts[i + 1])
            # the spans of one start end at different positions of each word
            alpha[self.word[at], self.end[at]] += alpha[self.word[at], i] * p[self.piece[at]]
        return alpha

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        alpha = self.forward(p)
        return np.log(np.maximum(alpha[np.arange(len(alpha)), self.lengths], 1e-300))

    def expected(self, p: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece, for words seen ``counts`` times in each language."""
        alpha = self.forward(p)
        beta = np.zeros_like(alpha)
        rows = np.arange(len(alpha))
        beta[rows, self.lengths] = counts / np.maximum(alpha[rows, self.lengths], 1e-300)
        flows = np.empty((len(self.start), p.shape[1]))
        for i in range(len(self.cuts) - 2, -1, -1):
            at = slice(self.cuts[i], self.cuts[i + 1])
            flows[at] = beta[self.word[at], self.end[at]] * p[self.piece[at]]
            np.add.at(beta, (self.word[at], i), flows[at])
        uses = flows * alpha[self.word, self.start]
        return np.stack([np.bincount(self.piece, uses[:, k], minlength=len(p)) for k in range(p.shape[1])], axis=1)


class LongWord:
    """All segmentations of one word of any length, in logarithms."""

    def __init__(self, word: str, index: dict[str, int], longest: int):
        lattice = Lattice([word], index, longest)
        self.spans = list(zip(lattice.start.tolist(), lattice.end.tolist(), lattice.piece.tolist()))
        self.n = len(word) + 1

    def forward(self, log_p: np.ndarray) -> np.ndarray:
        out = np.full((self.n + 1, log_p.shape[1]), -np.inf)
        out[0] = 0
        for i, j, piece in self.spans:
            np.logaddexp(out[j], out[i] + log_p[piece], out=out[j])
        return out

    def likelihood(self, p: np.ndarray) -> np.ndarray:
        return self.forward(np.log(p))[self.n]

    def add_expected(self, p: np.ndarray, counts: np.ndarray, uses: np.ndarray) -> None:
        log_p = np.log(p)
        alpha = self.forward(log_p)
        beta = np.full_like(alpha, -np.inf)
        beta[self.n] = 0
        for i, j, piece in reversed(self.spans):
            np.logaddexp(beta[i], beta[j] + log_p[piece], out=beta[i])
        for i, j, piece in self.spans:
            uses[piece] += counts * np.exp(alpha[i] + log_p[piece] + beta[j] - alpha[self.n])


def _chunks(words: list[str], languages: int) -> Iterator[tuple[int, int]]:
    """Ranges of words, shorter ones first, whose positions fit into memory together."""
    start = 0
    while start < len(words):
        most = max(1, CHUNK_BYTES // (8 * max(1, languages) * (len(words[start]) + 8)))
        end = min(len(words), start + min(CHUNK, most))
        # the chunk's last word is its longest
        while end > start + 1 and (end - start) * 8 * languages * (len(words[end - 1]) + 2) > 2 * CHUNK_BYTES:
            end -= max(1, (end - start) // 2)
        yield start, end
        start = end


@dataclass
class Model:
    """Piece probabilities by language."""

    languages: list[str]
    index: dict[str, int]
    #: (pieces + 2, languages); the last rows are an unknown letter's and the bare mark's.
    probability: np.ndarray
    longest: int
    prior: np.ndarray
    memo: dict = field(default_factory=dict, repr=False)
    rows: np.ndarray = field(default=None, repr=False)

    def __getstate__(self) -> dict:
        return self.__dict__ | {"memo": {}, "rows": None}

    def likelihoods(self, words: list[str]) -> Iterator[tuple[list[str], np.ndarray]]:
        """Log-likelihoods of words (shorter ones first) in every language, chunk by chunk."""
        short = next((i for i, w in enumerate(words) if len(w) > WORD_LETTERS), len(words))
        for a, b in _chunks(words[:short], len(self.languages)):
            yield words[a:b], Lattice(words[a:b], self.index, self.longest).likelihood(self.probability)
        for word in words[short:]:
            yield [word], LongWord(word, self.index, self.longest).likelihood(self.probability)[None]

    def expected(self, words: list[str], counts: np.ndarray) -> np.ndarray:
        """Expected uses of every piece for words (shorter ones first) seen ``counts`` times in each language."""
        uses = np.zeros_like(self.probability)
        short = next((i for i, w in enumerate(words) if len(w) > WORD_LETTERS), len(words))
        for a, b in _chunks(words[:short], len(self.languages)):
            uses += Lattice(words[a:b], self.index, self.longest).expected(self.probability, counts[a:b])
        for i in range(short, len(words)):
            LongWord(words[i], self.index, self.longest).add_expected(self.probability, counts[i], uses)
        return uses

    def learn(self, texts: list[list[str]]) -> None:
        """Bring the words of some texts into the table of likelihoods."""
        memo, k = self.memo, len(self.languages)
        if self.rows is None or len(memo) >= min(MEMO_ENTRIES, MEMO_BYTES // (8 * k)):
            memo.clear()
            self.rows = np.empty((1024, k))
        fresh = sorted(set().union(*texts).difference(memo), key=len)
        for words, values in self.likelihoods(fresh):
            n = len(memo)
            if n + len(words) > len(self.rows):
                rows = np.empty((max(2 * len(self.rows), n + len(words)), k))
                rows[:n] = self.rows[:n]
                self.rows = rows
            self.rows[n : n + len(words)] = values
            memo.update(zip(words, range(n, n + len(words))))

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        """Language and its posterior probability of each text."""
        split = [words_of(t) if t else [] for t in texts]
        if self.languages:
            self.learn(split)
        out = []
        for words in split:
            if not words or not self.languages:
                out.append((UNKNOWN, 0.0))
                continue
            total = self.prior + self.rows[[self.memo[w] for w in words]].sum(axis=0)
            best = int(total.argmax())
            out.append((self.languages[best], float(1 / np.exp(total - total[best]).sum())))
        return out


def start(documents: dict[str, int], pieces: list[str]) -> Model:
    """A model of uniform probabilities."""
    languages = sorted(documents)
    n, k = len(pieces) + 1, len(languages)
    total = max(1, sum(documents.values()))
    prior = np.log(np.array([documents[g] / total for g in languages])) if k else np.zeros(0)
    uniform = np.concatenate([np.full((n, k), 1.0 / n), np.ones((1, k))])
    return Model(languages, {p: i for i, p in enumerate(pieces)}, uniform, max(map(len, pieces), default=1), prior)


def renewed(model: Model, uses: np.ndarray) -> Model:
    """The model after a round, by the expected uses of its pieces."""
    n = len(model.index) + 1
    shares = uses[:n] / np.maximum(uses[:n].sum(axis=0), 1e-300)
    p = np.concatenate([(1 - SMOOTHING) * shares + SMOOTHING / n, np.ones((1, len(model.languages)))])
    return Model(model.languages, model.index, p, model.longest, model.prior)


def _uses(words: DataFrame, model: Model) -> np.ndarray:
    """Expected uses of every piece by language, for a table of words (word, lang: numbers of languages, c)."""
    shared = words.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        total: np.ndarray | None = None
        for batch in batches:
            rows = sorted(zip(*(batch.column(i).to_pylist() for i in range(3))), key=lambda r: (len(r[0]), r[0]))
            # counts of a bounded number of words are spread over all languages at once
            for a, b in _chunks([r[0] for r in rows], len(m.languages)):
                counts = np.zeros((b - a, len(m.languages)))
                for at, (_, langs, c) in enumerate(rows[a:b]):
                    counts[at, langs] = c
                uses = m.expected([r[0] for r in rows[a:b]], counts)
                total = uses if total is None else total + uses
        if total is not None:
            piece, lang = np.nonzero(total)
            steps = np.rint(total[piece, lang] / STEP).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int32()), pa.array(lang, pa.int32()), pa.array(steps)], names=["piece", "lang", "steps"])

    summed = words.select("word", "langs", "c").mapInArrow(run, "piece int, lang int, steps bigint").groupBy("piece", "lang").agg(F.sum("steps").alias("steps")).toArrow()
    out = np.zeros_like(model.probability)
    out[summed["piece"].to_numpy(), summed["lang"].to_numpy()] = summed["steps"].to_numpy() * STEP
    return out


def fit(docs: DataFrame, per_language: int = TRAIN_PER_LANGUAGE, pieces: list[str] | None = None) -> Model:
    """Train on ``docs`` (doc_id, text, lang) outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & (fold_of("doc_id", FOLDS) != HELD_OUT) & F.col("text").isNotNull())
    known = known.select("doc_id", F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text"))
    # every document whose hash lies under its language's share
    shares = known.groupBy("lang").agg(F.count("*").alias("n")).select("lang", (F.lit(per_language) / F.col("n")).alias("share"))
    place = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    # one row for each language, as the model has
    sample = known.join(F.broadcast(shares), "lang").where(place < F.col("share")).select("doc_id", "lang", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tallies: dict[str, Counter] = defaultdict(Counter)
        for batch in batches:
            for lang, text in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist()):
                tallies[lang].update(words_of(text or ""))
                tallies[lang]["\n"] += 1  # documents
            if sum(map(len, tallies.values())) >= 300_000:
                yield from tallied(tallies)
                tallies.clear()
        yield from tallied(tallies)

    def tallied(tallies: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, tally in tallies.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array([lang] * len(tally)), pa.array(list(tally)), pa.array(list(tally.values()), pa.int64())], names=["lang", "word", "c"]
            )

    counted = materialize(sample.mapInArrow(run, "lang string, word string, c bigint").groupBy("lang", "word").agg(F.sum("c").alias("c")), "language-words")
    model = start(dict(counted.where(F.col("word") == "\n").select("lang", "c").collect()), public_pieces() if pieces is None else pieces)
    if not model.languages:
        return model
    number = F.array_position(F.array(*map(F.lit, model.languages)), F.col("lang")).cast("int") - 1
    words = counted.where(F.col("word") != "\n").withColumn("lang", number).groupBy("word").agg(F.collect_list(F.struct("lang", "c")).alias("of"))
    words = materialize(words.select("word", F.col("of.lang").alias("langs"), F.col("of.c").alias("c")), "training-words")
    for _ in range(ROUNDS):
        model = renewed(model, _uses(words, model))
    discard(counted, words)
    return model


def identify(docs: DataFrame, model: Model, language: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with predicted language and score, under names with underscores where they are taken; only the text is read for them."""
    language, score = free(docs, language), free(docs, score)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index("text")
    schema = T.StructType([*docs.schema.fields, T.StructField(language, T.StringType()), T.StructField(score, T.DoubleType())])
    names = schema.fieldNames()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for whole in batches:
            for start in range(0, whole.num_rows, 1000):
                batch = whole.slice(start, 1000)
                made = predict(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [*batch.columns, pa.array([m[0] for m in made], pa.string()), pa.array([m[1] for m in made], pa.float64())], names=names
                )

    return docs.mapInArrow(run, schema)


def op4_language_id(spark, sf_dir: str) -> DataFrame:
    """Languages of all documents; those of the held-out fold are never read."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = fit(docs)
    found = identify(docs.select("doc_id", F.col("text").cast("string").alias("text")), model)
    return found.select("doc_id", (fold_of("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score")
