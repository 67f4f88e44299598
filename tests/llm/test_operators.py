"""The training-data operators against brute force, reference libraries and held-out labels."""

import base64
import hashlib
import hmac
import io
import os
import pickle
import random
import re
import unicodedata
import zlib
from collections import Counter

import duckdb
import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from placeloom.llm import bpe, common, components, decontamination, fingerprints, html, jaccard, langid, lm, pii, toxicity, warc
from placeloom.llm.common import table
from placeloom.llm.registry import ORACLES, QUERIES

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ODD = [None, "", " \t\n", "x", "the the the the the the", "a b c", "A  b C", "word " * 30_000, "ü" * 5000]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, "en", "s", None) for i, t in enumerate(ODD)] + [(3, "x", None, None, 1), (3, "x", None, None, 1), (None, "x y z", None, None, None)]
    return spark.createDataFrame(rows, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def texts(spark, sf):
    return {r.doc_id: r.text or "" for r in table(spark, sf, "documents").collect()}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf, name):
    c = duckdb.connect()
    for t in ("documents", "pages", "benchmark"):
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    df, want = QUERIES[name](spark, sf), c.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    pick = lambda names, data: sorted(tuple(str(r[names.index(n)]) for n in sorted(names)) for r in data)
    assert pick(df.columns, df.collect()) == pick(want.columns, want.fetchall())


# --- toxicity


def test_toxicity_finds_held_out_rows(spark, sf):
    scored = toxicity.op1_toxicity(spark, sf.replace("sf0.001", "sf0.01")).join(table(spark, sf.replace("sf0.001", "sf0.01"), "labels"), "doc_id").collect()
    right = sum(r.predicted == r.toxic for r in scored) / len(scored)
    assert right > 0.9
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in scored)


def test_toxicity_odd_rows(spark, odd, empty):
    rows = [(i, "you are a vile wretch" if i % 2 else "you are a kind friend", "en", "s", 1) for i in range(300)]
    docs = spark.createDataFrame(rows, SCHEMA)
    labels = spark.createDataFrame([(i, i % 2) for i in range(300)] + [(None, 1), (5, None)], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    assert model.trained
    got = {r.doc_id: r.score for r in toxicity.score(docs, model).collect()}
    assert all((s >= 0.5) == bool(i % 2) for i, s in got.items())
    scored = toxicity.score(odd, model)
    assert scored.columns == [*odd.columns, "score"] and all(0 <= r.score <= 1 for r in scored.collect())
    assert toxicity.score(empty, model).count() == 0
    untrained = toxicity.fit(docs, labels.where("toxic = 0"))
    assert {r.score for r in toxicity.score(docs, untrained).collect()} == {0.0}
    assert toxicity.reject_toxic(odd, labels.limit(0)).count() == odd.count()


def test_toxicity_learns_from_all_labelled_rows(spark):
    rng = np.random.default_rng(3)
    letters = np.array(list("abcdefghijklmnopqrstuvwxyz"))
    words = ["".join(rng.choice(letters, 9)) for _ in range(3600)]
    # each word marks its class and stands in four rows, so a sample of them doesn't know all
    rows = [(i, f"they say {words[i % 3600]} again", i % 2) for i in range(14400)]
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id bigint, text string")
    labels = spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id bigint, toxic int")
    model = toxicity.fit(docs, labels)
    start = toxicity.train([], np.empty(0)).embedding
    moved = [bool(np.any(model.embedding[b] != start[b])) for b in (toxicity._bucket(w, 1) for w in words)]
    assert sum(moved) > 0.95 * len(words)
    got = toxicity.score(docs, model).select("doc_id", "score").collect()
    assert sum((r.score >= 0.5) == bool(r.doc_id % 2) for r in got) > 0.95 * len(got)


def test_shards_of_training_rows_are_averaged(spark, sf):
    sf = sf.replace("sf0.001", "sf0.01")
    docs, labels = table(spark, sf, "documents"), table(spark, sf, "labels")
    one, again = (toxicity.fit(docs, labels, shard_rows=90) for _ in range(2))
    assert all(np.array_equal(a, b) for a, b in zip([one.embedding, *one.filters, one.weights, one.thresholds], [again.embedding, *again.filters, again.weights, again.thresholds]))
    scored = toxicity.score(docs.select("doc_id", "text"), one).join(labels, "doc_id").collect()
    assert sum((r.score >= 0.5) == bool(r.toxic) for r in scored) > 0.9 * len(scored)
    assert not toxicity.fit(docs, labels.where("toxic = 0"), shard_rows=90).trained


def test_toxicity_models_travel_in_small_rows(spark, monkeypatch):
    """No row that goes from round to round holds a whole model, whatever the vocabulary."""
    largest, write = [], toxicity.materialize

    def measured(df, name, *more):
        out = write(df, name, *more)
        if "state" in out.columns:
            largest.append(out.agg(F.max(F.length("state"))).first()[0])
        return out

    monkeypatch.setattr(toxicity, "materialize", measured)
    rows = [(i, " ".join(f"w{i}x{j}" for j in range(60)) + (" foul" if i % 2 else " fair"), i % 2) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string, toxic int")
    assert toxicity.fit(docs, docs.select("doc_id", "toxic"), shard_rows=100).trained
    assert len(largest) == 2 * toxicity.ROUNDS and max(largest) < 200_000


def test_toxicity_ranges_average_like_whole_models():
    rng = np.random.default_rng(3)
    begun, whole, rows = toxicity._begun(), toxicity._Mean(), []
    before = [[x + np.float32(1) for x in xs] for xs in begun]
    seen = (rng.random(toxicity.BUCKETS) < 0.3).astype(float)
    rows += [(-1, b) for b in toxicity._state_rows(*before, seen, 9)]
    for n in (7, 5):
        arrays, rates = ([x + rng.random(x.shape).astype(np.float32) for x in xs] for xs in begun)
        weight = (rng.random(toxicity.BUCKETS) < 0.1) * float(n)
        whole.add(arrays, rates, weight, n)
        rows += [(n, b) for b in toxicity._state_rows(arrays, rates, weight, n)]
    ranges = {}
    for n, b in rows:
        ranges.setdefault(b.column(0)[0].as_py(), []).append((n, pickle.loads(b.column(2)[0].as_py())))
    got = toxicity._begun()
    for place, listed in ranges.items():
        toxicity._put(got, toxicity._joined_head(listed) if place < 0 else toxicity._joined_range(listed))
    for mine, mean, first, then in zip(got, whole.mean(), begun, before):
        kept = np.where(seen[:, None] > 0, then[0], first[0])
        np.testing.assert_allclose(mine[0], np.where(whole.weight[:, None] > 0, mean[0], kept), rtol=1e-6)
        for a, b in zip(mine[1:], mean[1:]):
            np.testing.assert_allclose(a, b, rtol=1e-6)


def test_long_texts_are_scored_in_pieces():
    rng = np.random.default_rng(0)
    pairs = [rng.integers(1, 500, (n, 2)) for n in (5, 30, 200)]
    model = toxicity.train(pairs * 4, np.array([0, 1, 1] * 4))
    whole, toxicity.PIECE = model.pooled(pairs), 20
    try:
        assert np.allclose(whole, model.pooled(pairs), atol=1e-5)
    finally:
        toxicity.PIECE = 50_000


# --- fingerprints


def test_fingerprints_by_brute_force(spark, sf):
    docs = sorted(texts(spark, sf).items())
    form = lambda t: re.sub(r"\s+", " ", unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", t).casefold())).strip(" ")
    rows = {r.doc_id: r for r in fingerprints.op2_fingerprints(spark, sf).collect()}
    assert len(rows) == len(docs)
    for i, (doc_id, text) in enumerate(docs):
        following, cut = docs[(i + 1) % len(docs)][1], len(text) // 4
        edited = text[: len(text) - cut] + following[:cut]
        r = rows[doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint[:16] == f"{xxhash.xxh64_intdigest(form(text).encode(), 42):016x}"
        assert (r.near_edited, r.near_next) == (float(form(edited) == form(text)), float(form(following) == form(text)))


def test_fingerprint_canonical_form_and_collisions(spark, odd, empty, monkeypatch):
    df = spark.createDataFrame([("Straße  ﬁ",), ("STRASSE fi",), ("Café",), ("CafÉ",), ("other",), (None,), ("",)], "text string")
    got = [r.fingerprint for r in fingerprints.fingerprint(df).collect()]
    assert got[0] == got[1] and got[2] == got[3] and got[5] == got[6] and len(set(got)) == 4
    assert fingerprints.fingerprint_edits(odd).count() == odd.count()
    assert fingerprints.fingerprint_edits(empty).count() == 0
    monkeypatch.setattr(fingerprints, "digest", lambda t: F.lit("same"))
    clash = spark.createDataFrame([(1, "a"), (2, "b"), (3, "A")], "doc_id bigint, text string")
    split = {r.text: r.fingerprint for r in fingerprints.fingerprint(clash).collect()}
    assert split["a"] == split["A"] != split["b"]
    made = {r.doc_id: r for r in fingerprints.fingerprint_edits(clash).collect()}
    assert made[1].fingerprint == made[3].fingerprint != made[2].fingerprint and made[1].group_id == 1 and made[2].group_id == 2


# --- byte-level BPE


def test_bpe_matches_the_library(spark, sf, odd, empty):
    import public_tokenizers
    import tiktoken

    path, pattern = bpe.public_vocabulary()
    ranks = bpe.load_ranks(path)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    codec = bpe.Codec(ranks, pattern)
    rng = random.Random(3)
    cases = list(texts(spark, sf).values()) + ["a" * 4000, "ab" * 1500, "<|endoftext|>", "日本語" * 200, "=-" * 2000, "".join(rng.choice("abc xyzé\n") for _ in range(9000)), "😀🏽‍♂️", "\x00\x01"]
    for t in cases:
        ids = codec.encode(t)
        assert ids.tolist() == library.encode_ordinary(t)
        assert codec.decode(ids) == t.encode()
    got = bpe.digests(odd, path, pattern).collect()
    assert len(got) == odd.count() and {r.n_tokens for r in got if r.doc_id in (0, 1)} == {0}
    assert bpe.digests(empty, path, pattern).count() == 0
    clash = bpe.encode_documents(odd.withColumn("ids", F.lit(1)), path, pattern)
    assert clash.columns[-1] == "ids_1" and clash.count() == odd.count()


def test_rank_queue_is_a_priority_queue():
    rng, queue = random.Random(1), bpe.RankQueue(50_000)
    pushed = [(rng.randrange(50_000), rng.randrange(1000)) for _ in range(3000)]
    for rank, at in pushed:
        queue.push(rank, at)
    out = []
    while queue.top:
        out.append(queue.pop())
    assert out == sorted(pushed) and not any(queue.low) and not any(queue.mid) and not queue.buckets


# --- language identification


def test_language_id_held_out(spark, sf):
    rows = langid.op4_language_id(spark, sf).join(table(spark, sf, "documents").select("doc_id", "lang"), "doc_id").collect()
    held = [r for r in rows if r.held_out]
    assert sum(r.lang == r.lang_pred for r in held) / len(held) > 0.95


def test_language_forward_sums_all_segmentations():
    model = langid.start({"aa": 2, "bb": 1}, ["_a", "a", "ab", "_ab", "b"])
    for _ in range(4):
        model = langid.renewed(model, model.expected(["b", "ab", "ba"], np.array([[0, 2], [3, 0], [1, 0.0]])))
    p = {**{piece: model.probability[i] for piece, i in model.index.items()}, "_": np.ones(2)}
    word = "_ab"
    total = np.zeros(2)
    for cuts in ((1, 2), (1,), (2,), ()):
        parts = [word[a:b] for a, b in zip((0, *cuts), (*cuts, len(word)))]
        if all(x in p for x in parts):
            total += np.prod([p[x] for x in parts], axis=0)
    assert np.allclose(langid.Lattice(["ab"], model.index, model.longest).likelihood(model.probability)[0], np.log(total))
    assert np.allclose(model.probability[:-1].sum(axis=0), 1)


def test_language_long_words_alike(monkeypatch):
    rng = np.random.default_rng(2)
    words = ["".join(rng.choice(list("abcd"), n)) for n in (3, 7, 7, 12, 40)]
    model = langid.start({"x": 1, "y": 3}, ["_a", "a", "ab", "_ab", "b", "abc", "cd", "dab"])
    model.probability[:-1] = rng.dirichlet(np.ones(len(model.probability) - 1), 2).T
    counts = rng.integers(0, 5, (5, 2)).astype(float)
    whole, uses = np.concatenate([v for _, v in model.likelihoods(words)]), model.expected(words, counts)
    monkeypatch.setattr(langid, "WORD_LETTERS", 5)
    monkeypatch.setattr(langid, "CHUNK_BYTES", 200)
    assert np.allclose(np.concatenate([v for _, v in model.likelihoods(words)]), whole) and np.allclose(model.expected(words, counts), uses)
    assert list(langid._chunks(words, 2))[-1][1] == 5
    # a word beyond the range of floats is one word still
    assert langid.words_of("A" * 5000) == ["a" * 5000] and np.isfinite(next(model.likelihoods(["a" * 5000]))[1]).all()


def test_language_learns_every_language_and_word(spark):
    rows = [(i, f"w{chr(97 + i % 26)}{chr(97 + i // 26 % 26)} " * (1 + i // 300) + "q" * 90, f"l{i % 600}", None, None) for i in range(2400)]
    model = langid.fit(spark.createDataFrame(rows, SCHEMA), pieces=["_w", "a", "b"])
    assert len(model.languages) == len({r[2] for r in rows if zlib.crc32(str(r[0]).encode()) % 4 != 2}) > 500
    assert np.allclose(model.probability[:-1].sum(axis=0), 1)


def test_clashing_columns_of_fingerprints(spark, monkeypatch):
    df = spark.createDataFrame([(1, "A  b", 5, "x"), (2, "a b", 6, "y"), (3, "c", 7, "z")], "doc_id bigint, text string, fingerprint int, fp string")
    for digest in (fingerprints.digest, lambda form: F.lit("same")):
        monkeypatch.setattr(fingerprints, "digest", digest)
        out = fingerprints.fingerprint(df)
        assert out.columns == ["doc_id", "text", "fingerprint", "fp", "fingerprint_"]
        rows = {r.doc_id: r for r in out.collect()}
        assert rows[1].fingerprint == 5 and rows[1].fingerprint_ == rows[2].fingerprint_ != rows[3].fingerprint_


def test_clashing_columns_of_other_operators(spark):
    docs = spark.createDataFrame([(1, "a b c d e f g", 1, 2, 3)], "doc_id bigint, text string, n_shingles int, items int, row int")
    assert jaccard.jaccard_components(docs).first().n_shingles == 3
    items = spark.createDataFrame([(1, "a b", 5)], "item_id bigint, text string, row int")
    assert decontamination.decontaminate(docs, items).first().hit_ends == [2]
    held = docs.withColumn("held_out", F.lit(False)).withColumn("score", F.lit(9))
    model, counts = lm.fit(held)
    assert lm.score(held, model, counts).columns == ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"]


def test_join_hot_is_a_join(spark, monkeypatch):
    monkeypatch.setattr(common, "HOT_ROWS", 3)
    big = spark.createDataFrame([(k, i) for i, k in enumerate([1] * 9 + [2] * 3 + [3])], "k int, v int")
    small = spark.createDataFrame([(1, "a", 9), (2, "b", 3), (4, "c", 0)], "k int, w string, m bigint")
    want = sorted(map(str, big.join(small.drop("m"), ["k"], "left").collect()))
    assert sorted(map(str, common.join_hot(big, small, ["k"], 13).collect())) == want
    assert common.join_hot(big, small, ["k"], 13, "inner").count() == 12


def test_shared_folder_is_asked_for_on_a_cluster():
    class Context:
        master = "spark://somewhere:7077"
        _jsc = type("J", (), {"sc": lambda self: type("S", (), {"getCheckpointDir": lambda self: type("O", (), {"isDefined": lambda self: False})()})()})()

        def getConf(self):  # noqa: N802
            return {}

    session = type("Session", (), {"sparkContext": Context(), "conf": {}})()
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_root(session)


def test_clashing_columns_of_scores(spark):
    docs = spark.createDataFrame([(1, "some text", 7, "x", "y")], "doc_id bigint, text string, score int, lang_pred string, pairs string")
    found = langid.identify(docs, langid.start({}, []))
    assert found.columns[-2:] == ["lang_pred_", "score_"] and found.first().score == 7
    scored = toxicity.score(docs, toxicity.train([], np.empty(0)))
    assert scored.columns[-1] == "score_" and scored.first().score == 7


def test_language_odd_rows(spark, odd, empty):
    docs = spark.createDataFrame([(i, ("alpha beta" if i % 2 else "gamma delta"), ("l1" if i % 2 else "l2"), None, None) for i in range(80)], SCHEMA)
    model = langid.fit(docs)
    assert {(r.doc_id % 2, r.lang_pred) for r in langid.identify(docs, model).collect()} == {(1, "l1"), (0, "l2")}
    got = langid.identify(odd.drop("lang"), model).collect()
    assert all((r.lang_pred == "und") == (not re.search(r"[^\W\d_]", r.text or "")) for r in got)
    assert langid.identify(docs, langid.fit(empty)).where("lang_pred <> 'und'").count() == 0
    assert langid.identify(empty, model).count() == 0


# --- WARC


def test_warc_round_trip(spark):
    big = "é" * 50_000
    pages = spark.createDataFrame([(3, "u", big), (1, None, big), (2, "v", None), (5, "v", ""), (7, "w\r\n", "a\r\n\r\nWARC/1.1"), (None, "z", big), (9, "q", "single")], "page_id bigint, url string, html string")
    chunks = warc.write_archives(pages, chunk_bytes=1000)
    assert chunks.agg(F.max(F.octet_length("data"))).first()[0] <= 1000
    rows = {r.page_id: r for r in warc.read_chunks(chunks).collect()}
    digest = lambda t: base64.b32encode(hashlib.sha1(t.encode()).digest()).decode()
    assert {k: (r.record_type, r.refers_to) for k, r in rows.items()} == {
        3: ("revisit", 1), 1: ("response", None), 2: ("response", None), 5: ("revisit", 2), 7: ("response", None), None: ("revisit", 1), 9: ("response", None)
    }
    assert (rows[3].payload_bytes, rows[3].payload_digest) == (100_000, digest(big)) and all(r.intact for r in rows.values())
    # every payload chunk carries the digest of the payload so far
    body = chunks.where((F.col("record_id") == rows[1].record_id) & F.col("digest").isNotNull()).orderBy("chunk").collect()
    assert [r.digest for r in body] == [base64.b32encode(hashlib.sha1(big.encode()[: 1000 * (i + 1)]).digest()).decode() for i in range(100)]
    archive = io.BytesIO()
    for a in sorted(r.archive for r in chunks.select("archive").distinct().collect()):
        warc.export(chunks, a, archive)
    archive.seek(0)
    again = spark.createDataFrame(list(warc.chunks_of(archive, 0, 777)), warc.CHUNK_SCHEMA)
    assert {tuple(r) for r in warc.read_chunks(again).collect()} == {tuple(r) for r in rows.values()}
    # every revisit of the file resolves to a response with its digest
    fields = [warc.parse_header(bytes(r.data).rstrip()) for r in again.where("chunk = 0").collect()]
    by_id = {f["warc-record-id"]: f for f in fields}
    for f in fields:
        if f["warc-type"] == "revisit":
            there = by_id[f["warc-refers-to"]]
            assert there["warc-type"] == "response" and there["warc-payload-digest"] == f["warc-payload-digest"]
    broken = chunks.withColumn("data", F.when(F.col("record_id").startswith("urn:page:7:") & F.col("digest").isNotNull(), F.lit(b"x" * 14)).otherwise(F.col("data")))
    assert {r.page_id for r in warc.read_chunks(broken).collect() if not r.intact} == {7}
    assert warc.read_chunks(warc.write_archives(pages.limit(0))).count() == 0
    kept = warc.read_chunks(warc.write_archives(pages, least=10)).where("refers_to IS NOT NULL").count()
    assert kept == 2


def test_warc_repeated_and_missing_ids(spark, monkeypatch):
    rows = [(1, "u", "a"), (1, "u", "a"), (None, "v", "b"), (None, "v", "b"), (2, "w", "a")]
    pages = spark.createDataFrame(rows, "page_id bigint, url string, html string").withColumn("data", F.lit(1)).withColumn("digest", F.lit(2))
    want = sorted([("1", "response", "None"), ("1", "revisit", "1"), ("2", "revisit", "1"), ("None", "response", "None"), ("None", "response", "None")])
    for bound in (warc.KEYS_BOUND, 0):
        monkeypatch.setattr(warc, "KEYS_BOUND", bound)
        found = warc.read_chunks(warc.write_archives(pages)).collect()
        assert sorted((str(r.page_id), r.record_type, str(r.refers_to)) for r in found) == want


# --- n-gram Jaccard


def brute_components(rows):
    sets = {}
    for doc_id, t in rows:
        w = (t or "").translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
        w = [x for x in re.split(r"[\x20\x09-\x0D]+", w) if x]
        sets.setdefault(doc_id, []).append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = list(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            if any(x and y and 100 * len(x & y) >= 80 * len(x | y) for x in sets[a] for y in sets[b]):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in ids}


def family(rng, n, edits):
    words = [f"w{i}" for i in range(60)]
    out = []
    for _ in range(n):
        w = list(words)
        for _ in range(rng.randrange(edits)):
            w[rng.randrange(len(w))] = f"x{rng.randrange(10**6)}"
        out.append(" ".join(w))
    return out


def test_jaccard_against_all_pairs(spark, monkeypatch):
    rng = random.Random(5)
    monkeypatch.setattr(jaccard, "COMMON", 8)
    monkeypatch.setattr(jaccard, "GROUP_SIZE", 7)
    line = " ".join(f"common{i}" for i in range(12))
    bodies = family(rng, 60, 4) + [f"{line} " + " ".join(f"u{i}_{j}" for j in range(rng.randrange(3, 40))) for i in range(60)]
    bodies += [rng.choice(bodies) for _ in range(30)] + ["short text", "Short  text", "a b c d e", "a b c d e f", "", None]
    rows = [(rng.randrange(10**6), t) for t in bodies]
    df = spark.createDataFrame(rows, "doc_id bigint, text string")
    got = {r.doc_id: r.component_id for r in jaccard.jaccard_components(df).collect()}
    assert got == brute_components(rows)


def test_jaccard_odd_rows(spark, odd, empty):
    got = jaccard.jaccard_components(odd.withColumn("n", F.lit(1)).withColumn("grp", F.lit("x"))).collect()
    assert len(got) == odd.count()
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert by[0].n_shingles == by[1].n_shingles == 0 and by[1].component_id == 1 and by[3].component_id == 3
    assert [r.component_id for r in got if r.doc_id is None] == [None]
    assert jaccard.jaccard_components(empty).count() == 0


def test_components_of_chains(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(1, 60)] + [(100, 101), (7, 7)], "a bigint, b bigint")
    got = {r.node: r.component for r in components.components(edges).collect()}
    assert got == {**{i: 1 for i in range(1, 61)}, 100: 100, 101: 100}


# --- language-model scoring


def test_lm_counts_and_base(spark, sf):
    docs = texts(spark, sf)
    counts = Counter()
    for doc_id, t in docs.items():
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            counts.update(lm.tokens_of(t.encode()))
    total, distinct = sum(counts.values()), len(counts)
    rows = lm.op7_lm_scoring(spark, sf).collect()
    assert len(rows) == len(docs)
    for r in rows:
        words = lm.tokens_of(docs[r.doc_id].encode())
        assert (r.n_tokens, r.n_known, r.train_tokens) == (len(words), sum(counts[w] > 0 for w in words), total)
        assert r.base_score == pytest.approx(sum(np.log10((counts[w] + 1) / (total + distinct + 1)) for w in words), rel=1e-9)
        assert r.score < 0
    assert sum(r.score for r in rows if r.held_out) > sum(r.base_score for r in rows if r.held_out)


@pytest.mark.parametrize("top", [lm.TOP_WORDS, 300])
def test_lm_scores_against_a_plain_model(spark, sf, monkeypatch, top):
    """The formula over exact counts, quantised as the filter does; what differs are its false positives."""
    monkeypatch.setattr(lm, "TOP_WORDS", top)
    monkeypatch.setattr(lm, "CONTEXT_WORDS", 200)
    docs = texts(spark, sf)
    words, pairs = Counter(), Counter()
    for doc_id, t in docs.items():
        if zlib.crc32(str(doc_id).encode()) % 7 != 2:
            own = lm.tokens_of(t.encode())
            words.update(own)
            pairs.update(zip(own, own[1:]))
    types, total = Counter(a for a, _ in pairs), sum(words.values())
    rank = {w: i for i, (w, _) in enumerate(sorted(words.items(), key=lambda x: (-x[1], x[0])))}
    ones, twos = (sum(c == n for c in words.values()) for n in (1, 2))
    discount = ones / (ones + 2 * twos)
    level = lambda n: lm.level_of(np.array([n])) if n else np.array([0])
    least, most = (lambda n: lm.count_of(level(n))[0]), (lambda n: lm.most_of(level(n))[0] if n else 0.0)
    kept = lambda w, of: words[w] if rank.get(w, 1 << 30) < top else of(words[w])

    def unigram(w):
        c = kept(w, least)
        return max(c - discount, 0.1) / total if c else max(discount * len(words) / total, 1 / (total + 1))

    def score(text):
        own, out = lm.tokens_of(text.encode()), 0.0
        for i, w in enumerate(own):
            p = unigram(w)
            if i and words[own[i - 1]]:
                before = own[i - 1]
                n = kept(before, most)
                t = max(types[before], 1) if rank[before] < 200 else max(least(types[before]), 1.0)
                p = (min(least(pairs[before, w]), n) + t * p) / (n + t)
            out += np.log10(p)
        return out

    rows = lm.op7_lm_scoring(spark, sf).collect()
    apart = [abs(r.score / score(docs[r.doc_id]) - 1) for r in rows]
    assert np.median(apart) < 0.01 and np.quantile(apart, 0.95) < 0.05, (np.median(apart), sorted(apart)[-9:])


def test_lm_filter_and_probabilities(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP_WORDS", 3)
    monkeypatch.setattr(lm, "CONTEXT_WORDS", 3)
    docs = spark.createDataFrame([(i, "a b a c" if i % 2 else f"a a b d{i}") for i in range(40)], "doc_id bigint, text string")
    model, counts = lm.fit(docs)
    exact = {r.word: r.c for r in counts.collect()}
    rare = [w for w in map(bytes, exact) if w not in model.words]
    levels = model.levels(np.array([lm.word_key(w) for w in rare], dtype=np.uint64))
    assert all(level >= lm.level_of(np.array([exact[w]]))[0] for w, level in zip(rare, levels))
    for h in range(3):
        ids = np.arange(3)
        listed = model.score(np.concatenate([[h, w] for w in ids]), np.empty(0, dtype=np.uint64), np.arange(0, 6, 2))
        first = model.score(np.array([h]), np.empty(0, dtype=np.uint64), np.array([0]))[0]
        assert (10 ** (listed - first)).sum() <= 1 + 1e-9
    block = lm.build_block(np.arange(100, dtype=np.uint64), np.arange(1, 101), 640)
    assert len(block) * 8 <= 640


def test_lm_counts_bigrams_of_all_words(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP_WORDS", 4)
    monkeypatch.setattr(lm, "CONTEXT_WORDS", 2)
    rng = random.Random(3)
    bodies = [" ".join(rng.choice("abcdefgh") + str(rng.randrange(9)) for _ in range(30)) + f" x{i % 20} y{i % 20} the of" for i in range(80)]
    model, _ = lm.fit(spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string"))
    words, pairs = Counter(), Counter()
    for t in bodies:
        own = lm.tokens_of(t.encode())
        words.update(own)
        pairs.update(zip(own, own[1:]))
    types = Counter(a for a, _ in pairs)

    def asked(*text):
        ids = np.array([model.words.get(w, -1) for w in text])
        rare = np.array([lm.word_key(w) for w in text if w not in model.words], dtype=np.uint64)
        return ids, rare, np.array([0])

    level = lambda n: lm.level_of(np.array([n]))[0]
    exact = 0
    for (a, b), n in pairs.items():
        found = model.look(*asked(a, b))
        assert found[1, 1] >= level(n)
        exact += found[1, 1] == level(n)
        if types[a] > 1 and model.words.get(a, 9) >= 2:
            assert found[2, 1] >= level(types[a])
    assert exact > 0.9 * len(pairs)
    assert {model.words[w] for w in model.words if model.words[w] < 2} and all(
        model.types[i] == max(types[w], 1) for w, i in model.words.items() if i < 2
    )
    # x and y are outside the frequent words and always stand together
    x, y = b"x7", b"y7"
    alone = model.score(*asked(x))[0] + model.score(*asked(y))[0]
    assert x not in model.words and model.score(*asked(x, y))[0] > alone + 1
    for context in (b"x7", b"the", b"a1"):
        first = model.score(*asked(context))[0]
        assert sum(10 ** (model.score(*asked(context, w))[0] - first) for w in words) <= 1.05


def test_lm_large_filter_in_passes(spark, monkeypatch):
    monkeypatch.setattr(lm, "TOP_WORDS", 50)
    docs = spark.createDataFrame([(i, f"a b c{i} d{i % 7} a c{i} e" if i else None, i % 5 == 0) for i in range(60)], "doc_id bigint, text string, held_out boolean")
    train = docs.select("doc_id", "text")
    model, counts = lm.fit(train)
    whole = {r.doc_id: r for r in lm.score(docs, model, counts).collect()}
    size = 8 * len(model.data)
    cut, counts = lm.fit(train, size // 3)
    assert len(model.passes) == 1 and len(cut.passes) >= 3
    parts = [cut.of_pass(i) for i in range(len(cut.passes))]
    assert sum(len(p.data) for p in parts) == len(model.data) and all(8 * len(p.data) <= size // 3 for p in parts)
    # nothing is left out, and the passes give the same scores
    assert {r.doc_id: r for r in lm.score(docs, cut, counts).collect()} == whole


def test_lm_odd_rows(spark, odd, empty):
    docs = odd.select("doc_id", "text").withColumn("held_out", F.lit(False))
    model, counts = lm.fit(docs.select("doc_id", "text"))
    rows = lm.score(docs, model, counts).collect()
    assert len(rows) == odd.count() and all(r.n_known == r.n_tokens for r in rows)
    model, counts = lm.fit(empty.select("doc_id", "text"))
    rows = lm.score(docs, model, counts).collect()
    assert {(r.n_known, r.train_tokens) for r in rows} == {(0, 0)} and {r.base_score for r in rows} == {0.0}
    assert lm.score(docs.limit(0), model, counts).count() == 0


# --- PII


def replaced(spark, rows, **kw):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(rows)], "doc_id bigint, text string")
    return [r.text for r in pii.replace_pii(df, kw.pop("key", "k"), **kw).orderBy("doc_id").collect()]


def test_pii_long_secrets_and_quoted_keys(spark):
    rng = random.Random(9)
    secrets = ["".join(rng.choice("abcdefXYZ0123456789._-") for _ in range(n)) for n in (512, 513, 3000, 40, 40)]
    forms = ['token = "{}"', "token = '{}'", 'secret: "{}"', '{{"api_key": "{}", "n": 1}}', "{{'password' : '{}'}}"]
    rows = [f.format(x) for f, x in zip(forms, secrets)] + ['"colour": "abcdefghij"', 'token = "short"']
    out = replaced(spark, rows)
    for before, after, x in zip(rows, out, secrets):
        assert x not in after and len(after) == len(before) and x[:20] not in after and x[-20:] not in after
    assert out[5:] == rows[5:]


def test_pii_masked_secrets_end(spark):
    rows = ['password = "********"', 'password = "--------"', 'password = "------a-"', 'password = "********" again'] + [f'pwd: "-------{c}"' for c in "abcdefghijklmnopqrstuvwxyz"]
    out = replaced(spark, rows)
    drawn = [re.search('"(.*)"', x).group(1) for x in out]
    assert drawn[0] == drawn[3] and not {re.search('"(.*)"', x).group(1) for x in rows} & set(drawn)
    assert len(set(drawn)) == len(rows) - 1 and drawn[0].isalpha() and len(drawn[0]) == 8


def test_pii_types_and_coreference(spark):
    rows = [
        "mail Bob.12@mail4.org, bob.12@mail4.org call +1 (017) 555-7713 card 4111111111111111 ip 152.143.123.131###",
        'token = "24be64439e3e49cf46b2d7c90f3602a3d0b907ff" and TOKEN = "24BE64439E3E49CF46B2D7C90F3602A3D0B907FF"',
        "Mary Miller met Анна Иванова, ssn 123-45-6789, DE89 3704 0044 0532 0130 00",
        "+1-017-555-7713 and bob.12@mail4.org",
        "nothing here 12 3.4 1.2.3 a@ @b Mary had 4111111111111112", "", None,
    ]
    df = spark.createDataFrame([(i, t, "k") for i, t in enumerate(rows)], "doc_id bigint, text string, kind string")
    out = {r.doc_id: r.text for r in pii.replace_pii(df, "k", count="n").collect()}
    assert (out[4], out[5], out[6]) == (rows[4], "", None)
    for secret in ("bob.12", "Bob.12", "555-7713", "4111111111111111", "152.143", "24be6443", "24BE6443", "Miller", "Иванова", "123-45-6789", "3704"):
        assert not any(secret in (t or "") for t in out.values()), secret
    mails = re.findall(r"\S+@\S+?\.example", " ".join(t for t in out.values() if t))
    assert len(mails) == 3 and len(set(mails)) == 1
    digits = [re.sub(r"\D", "", x) for x in re.findall(r"\+1[ (\d)-]+\d{4}", " ".join((out[0], out[3])))]
    assert digits[0] == digits[1] and digits[0].startswith("1") and re.search(r"\+1 \(\d{3}\) \d{3}-\d{4}", out[0])
    card = re.search(r"card (\d{16})", out[0]).group(1)
    assert luhn(card)
    given = re.match(r"(\w+) \w+ met (\w+) \w+(?:ова|ева|ина|ская|\w),", out[2]).groups()
    assert given[0] in pii.FEMALE["latin"].split() and given[1] in pii.FEMALE["cyrillic"].split()
    joined = {r.doc_id: r.text for r in pii.replace_pii(df, "k", inline=-1).collect()}
    assert joined == out
    assert {r.doc_id: r.text for r in pii.replace_pii(df, "other").collect()}[0] != out[0]


def test_pii_names_by_words(spark):
    rows = [
        "José María García met Emma Schmidt-Weber. Later Emma, Weber and García spoke; GARCÍA did not.",
        "Wang Fang and Dr. von Hagen and Mr O'Neil. My name is Olga Petrova.",
        "Emma García", "Emma had a Weber.", "Mr smith, Dr no. The Mary Poppins",
    ]
    out = replaced(spark, rows)
    for word in ("José", "María", "García", "Emma", "Schmidt", "Weber", "Wang", "Fang", "Hagen", "Neil", "Olga", "Petrova", "Poppins"):
        assert not any(word in x for i, x in enumerate(out) if i != 3), word
    first, again = re.match(r"(.*) met (.*)\. Later", out[0]).groups(), re.search(r"Later (\w+), (\w+) and (\w+) spoke", out[0]).groups()
    assert again == (again[0], again[1], first[0].split()[2]) and first[1].startswith(again[0] + " ") and first[1].endswith("-" + again[1])
    assert out[2] == f"{again[0]} {again[2]}" and first[0].split()[0] in pii.MALE["latin"].split() and first[0].split()[1] in pii.FEMALE["latin"].split()
    assert "GARCÍA" in out[0] and " von " in out[1] and out[1].count("Dr. ") == 1 and "My name is " in out[1]
    assert out[3] == rows[3] and out[4].startswith("Mr smith, Dr no. The ")


def test_pii_keeps_scripts_and_whole_addresses(spark):
    rows = ["иван.петров@почта.example", "a" * 70 + "@x.org", "password = '密碼密碼密碼密碼'", "an_é.x@y.z.example.org"]
    out = replaced(spark, rows)
    assert re.fullmatch(r"[а-я]{4}\.[а-я]{6}@[а-я]{5}\.example", out[0]) and re.fullmatch(r"[a-z]{70}@[a-z]\.example", out[1])
    assert re.fullmatch(r"password = '[一-鿿]{8}'", out[2]) and not set(out) & set(rows)


def model_digest(key, *parts):
    return hmac.new(key.encode(), "|".join(map(str, parts)).encode(), "sha512").hexdigest()


def model_draw(digest, i, n):
    return int(digest[i % 31 * 4 : i % 31 * 4 + 4], 16) % n


def model_like(digest, text):
    """Plain model of ``pii._like`` for ASCII texts."""
    kind = "hex" if re.fullmatch("[0-9a-f]+", text) else "HEX" if re.fullmatch("[0-9A-F]+", text) else "text"
    out = ""
    for i, c in enumerate(text):
        d = digest if i < 31 else hashlib.sha512((digest + str(i // 31)).encode()).hexdigest()
        if kind != "text":
            out += ("%x" if kind == "hex" else "%X") % model_draw(d, i, 16)
        elif c.isdigit():
            out += str(model_draw(d, i, 10))
        else:
            out += chr((97 if c.islower() else 65) + model_draw(d, i, 1 << 16) % 26) if c.isalpha() else c
    return out


def luhn(digits):
    return sum(sum(divmod(int(d) * (1 + i % 2), 10)) for i, d in enumerate(reversed(digits))) % 10 == 0


def model_surrogate(kind, entity, key):
    """First draws of the types that the documents hold."""
    if kind == "card":
        d = model_digest(key, kind, entity, 0)
        body = entity[0] + "".join(str(model_draw(d, i, 10)) for i in range(2, len(entity)))
        return next(body + c for c in "0123456789" if luhn(body + c)) if luhn(entity) else entity
    if kind == "ip":
        d = model_digest(key, kind, entity, 0)
        return ".".join(str(1 + model_draw(d, i, 254)) for i in range(4))
    if kind == "phone":
        digits = re.sub(r"\D", "", entity)
        kept = len(re.match(r"\+?(\d{0,3})", entity).group(1))
        d = model_digest(key, kind, digits, 0)
        new = iter(c if i <= kept else str(model_draw(d, i, 10)) for i, c in enumerate(digits, 1))
        return re.sub(r"\d", lambda _: next(new), entity)
    if kind == "email":
        local, _, domain = entity.lower().partition("@")
        return model_like(model_digest(key, kind, entity.lower(), 0), f"{local}@{domain.split('.')[0]}") + ".example"
    return model_like(model_digest(key, kind, entity, 0), entity)


def test_pii_against_a_plain_model(spark, sf):
    """Every document of the small tables, by patterns and draws written anew."""
    octet = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
    forms = [
        ("email", r"(?<![\w.%+-])[\w.%+-]+@(?:[^\W_]+\.)+[^\W_]{2,63}"), ("secret", r"(?<=(?:token) = [\"'])[^\"'\s]{8,}(?=[\"'])"),
        ("ip", rf"(?<![0-9.])(?:{octet}\.){{3}}{octet}(?!\d|\.\d)"), ("phone", r"(?<![\d+])\+\d{1,3} \(\d{1,4}\) \d{2,4}-\d{2,4}(?!\d)"),
        ("card", r"(?<![\d+.-])\d{13,19}(?!\d)"),
    ]
    one = re.compile("|".join(f"(?P<{k}>{p})" for k, p in forms))
    docs = table(spark, sf, "documents")
    got = {r.doc_id: (r.text, r.n) for r in pii.replace_pii(docs, "k", count="n").collect()}
    total = 0
    for row in docs.collect():
        found = [m for m in one.finditer(row.text or "") if m.lastgroup != "card" or luhn(m.group(0))]
        want = one.sub(lambda m: model_surrogate(m.lastgroup, m.group(0), "k"), row.text) if row.text else row.text
        assert got[row.doc_id] == (want, len(found)), row.doc_id
        total += len(found)
    assert total > 10


def test_pii_surrogates_stay_distinct(spark):
    rows = [f"John Smith{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(600)]
    out = replaced(spark, rows)
    assert len(set(out)) == 600 and all(x.split()[0] in pii.MALE["latin"].split() for x in out)
    assert replaced(spark, rows, inline=0) == out


def test_pii_long_runs_and_empty(spark, odd, empty):
    assert pii.replace_pii(empty, "k").count() == 0
    kept = {str(r.text) for r in pii.replace_pii(odd, "k").collect()}
    assert kept == {str(r.text) for r in odd.collect()}
    long = spark.createDataFrame([(1, "a" * 300_000), (2, "1" * 300_000), (3, "a.b@" * 50_000), (4, "A" * 300_000), (5, "Mary " * 50_000)], "doc_id bigint, text string")
    assert pii.replace_pii(long, "k").count() == 5


def test_pii_clashing_columns(spark):
    df = spark.createDataFrame([(1, "bob.1@mail.org", 7, "x")], "doc_id bigint, text string, n int, `found` string")
    out = pii.replace_pii(df, "k", count="n")
    assert out.columns == ["doc_id", "text", "n", "found", "n_"] and tuple(out.first()[2:]) == (7, "x", 1)


# --- main text


@pytest.mark.parametrize(
    "before",
    [
        "<select><option>A<option>B</select>", "<select><optgroup><option>A<optgroup><option>B</select>", "<div><select><option>A</div>", "<svg viewBox='0'/>", "<svg><path/><text>A</svg>",
        "<div><svg><path></div>", "<svg><path>", "<ul><li><button>A<li>B</ul>", "<div><canvas>A</div>", "</select></svg>", "<object data='x'/>",
    ],
)
def test_html_silent_elements_end(before):
    for page in (f"<html><body>{before}<p>The article.</p></body></html>", f"<html><head><title>T</title><meta a=b>{before}<p>The article.</p>"):
        said = [t for _, t in html.parse(page).blocks]
        assert said[-1] == "The article." and not {"A", "T"} & set(said), page


@pytest.mark.parametrize(
    "between",
    [
        "<select><option>a<option>b</select>", "<svg/>", "<p data=don't>x</p>", "<audio controls>", "<video src=a><source src=b>", "<!--->", "<!-->", "<!-- a --!>", "<p title=\"a>b\" data-x='c>d'>x</p>",
        "<p data = \"it's\">x</p>", "<script src='x'/>", "<style/>", "<iframe src=x>", "<textarea>", "<a href=x'y\"z>x</a>", "<audio><p>no sound</p></audio>", "<script>if (a < b) '<p>' </script >",
    ],
)
def test_html_insertions_lose_nothing(between):
    page = f"<html><body><article><p>The first paragraph.</p>{between}<p>The second one.</p></article></body></html>"
    said = [t for _, t in html.parse(page).blocks]
    assert said in (["The first paragraph.", "The second one."], ["The first paragraph.", "x", "The second one."])


def test_html_formulas_stay():
    page = "<article><p>The sum <math><mi>a</mi><mo>+</mo><mi>b</mi><annotation>a+b</annotation></math> is <math/> here.</p><p>Next.</p></article>"
    assert [t for _, t in html.parse(page).blocks] == ["The sum a+b is here.", "Next."]


def test_html_head_without_end():
    assert [t for _, t in html.parse("<head><title>T</title><style>x</style>\n<p>one</p>two").blocks] == ["one", "two"]
    assert [t for _, t in html.parse("<head><link a=b>text<p>one").blocks] == ["text", "one"]
    assert [t for _, t in html.parse("<body><p>a<video>no<p>no</p></video>b<svg><title>no</title></svg>c").blocks][0][0] == "a"
    assert "no" not in " ".join(t for _, t in html.parse("<p>a <svg><title>no</title><text>no</text></svg> <button>no</button> b</p>").blocks)


def test_html_generated_pages():
    model = html.model()
    right = total = 0
    for page, _ in html.labelled_pages(120, seed=77):
        p, _ = model.marginals(*html.features(page))
        for at, t in page.blocks:
            total += 1
            right += (p[at] >= 0.5) == (html._Maker.MARK in t)
    assert right / total > 0.98


def test_html_marginals_are_exact():
    model = html.model()
    page = html.parse("<body><nav><a>x</a></nav><article><p>some text here.</p><div><p>more</p></div></article></body>")
    x, parents, kinds = html.features(page)
    p, _ = model.marginals(x, parents, kinds)
    n, weights, mass = len(x), np.zeros(len(x)), 0.0
    for bits in range(2**n):
        y = [(bits >> i) & 1 for i in range(n)]
        s = sum(y[i] * float(x[i] @ model.node) for i in range(n)) + sum(model.pair[kinds[i], y[parents[i]], y[i]] for i in range(1, n))
        w = np.exp(s)
        mass += w
        weights += w * np.array(y)
    assert np.allclose(p, weights / mass, atol=1e-9)


def test_html_pages(spark, sf):
    rows = html.op9_html_extraction(spark, sf).join(table(spark, sf, "pages").select("page_id", "html"), "page_id").collect()
    right = 0
    for r in rows:
        body = re.search(r"<article>(.*)</article>", r.html, re.S).group(1)
        want = [re.sub(r"\s+", " ", html.entities.unescape(re.sub(r"<[^>]*>", " ", b))).strip() for b in re.split(r"</?(?:p|h1)>", body)]
        right += r.text == "\n".join(b for b in want if b) and r.n_chars == len(r.text)
    assert right / len(rows) >= 0.95


def test_html_odd_pages(spark):
    model = html.model()
    assert html.extract(None, model) == html.extract("", model) == html.extract("<p></p>", model) == ""
    assert html.extract("plain &amp; simple", model) == "plain & simple"
    assert html.extract("<article><p>One two three four.<p>Five &lt;six&gt; seven</article><script>var a='<p>x</p>'", model) == "One two three four.\nFive <six> seven"
    df = spark.createDataFrame([(1, None), (2, "<article><p>" + "word " * 50_000)], "page_id bigint, html string").withColumn("text", F.lit("kept"))
    out = html.extract_pages(df).collect()
    assert out[0].main_text == "" and len(out[1].main_text) > 200_000 and out[0].text == "kept"
    assert html.extract_pages(df.limit(0)).count() == 0


def test_html_clashing_column(spark):
    df = spark.createDataFrame([(1, "kept", "<p>The article.</p>")], "page_id bigint, main_text string, html string")
    out = html.extract_pages(df)
    assert out.columns[-1] == "main_text_" and out.first().main_text == "kept" and out.first().main_text_ == "The article."


# --- decontamination


def test_decontamination_blocks_agree(spark, sf):
    docs, items = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    docs = docs.unionByName(docs.where("doc_id < 5"))
    pick = lambda df: sorted(map(tuple, decontamination.summary(df).collect()))
    assert pick(decontamination.decontaminate(docs, items)) == pick(decontamination.decontaminate(docs, items, block_bytes=2000))


def test_decontamination_odd_rows(spark, odd, empty):
    items = spark.createDataFrame([(1, "the the"), (None, "a b c"), (2, None), (3, "!!!"), (1, "x")], "item_id bigint, text string")
    rows = {r.doc_id: r for r in decontamination.summary(decontamination.decontaminate(odd, items)).collect()}
    assert (rows[4].n_hit, rows[4].n_items, rows[4].contaminated) == (6, 1, True)
    assert (rows[5].n_hit, rows[5].n_items) == (3, 0) and (rows[0].n_words, rows[0].n_hit) == (0, 0)
    assert decontamination.decontaminate(empty, items).count() == 0
    assert decontamination.summary(decontamination.decontaminate(odd, items.limit(0))).where("contaminated").count() == 0


def test_proximity(spark):
    docs = spark.createDataFrame([(1, "red one two blue three"), (2, "red a b c d e blue"), (3, "blue red"), (4, "red red")], "doc_id bigint, text string")
    phrases = decontamination.Phrases([("q", "blue red")])
    index = decontamination.build_index(docs)
    found = decontamination.proximity(index, phrases, 4)
    assert sorted((r.doc_id, r.position) for r in found.collect()) == [(1, 0), (3, 0)]
    # the same index serves another benchmark
    others = decontamination.search(index, decontamination.Phrases([("w", "one two")])).collect()
    assert sorted((r.doc_id, r.hit_starts, r.hit_ends) for r in others if r.hit_starts) == [(1, [1], [3])]


@pytest.mark.parametrize("block_bytes", [12, 1 << 20])
def test_decontamination_rows_of_one_id(spark, block_bytes):
    rows = [(1, "red green blue"), (1, "one two three"), (None, "red green blue"), (None, "one two three"), (1, "one two three")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string")
    items = spark.createDataFrame([(1, "red green"), (2, "green blue"), (3, "white")], "item_id bigint, text string")
    out = decontamination.summary(decontamination.decontaminate(docs, items, block_bytes=block_bytes)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items) for r in out) == [("1", 3, 0, 0), ("1", 3, 0, 0), ("1", 3, 3, 2), ("None", 3, 0, 0), ("None", 3, 3, 2)]


def test_decontamination_long_text_in_pieces(spark, monkeypatch):
    text = " ".join(f"w{i % 700}é" for i in range(3000)) + "\nthe end"
    monkeypatch.setattr(decontamination, "PIECE_BYTES", 50)
    segment = decontamination._Segment(0)
    segment.add(1, text.encode())
    segment.add(2, b"")
    words = decontamination.words_of(text.encode())
    assert segment.lengths == [len(words), 0] and list(segment.lexicon) == list(dict.fromkeys(words))
    postings = decontamination._Postings(segment.batch(), 0, decontamination.Phrases([("a", "w5é w6é"), ("b", "the end"), ("c", "none")]))
    assert postings.of(0).tolist() == [i for i, w in enumerate(words) if w == words[5]] and postings.of(3).tolist() == [len(words) - 1]


def test_words_are_numbered_in_batches(monkeypatch):
    monkeypatch.setattr(lm, "PIECE_BYTES", 50)
    rng = np.random.default_rng(1)
    known = [b"word%d" % i for i in range(3000)] + [lm.END, b"\x00", "\u00e9t\u00e9".encode(), b"x" * 64, b"y" * 65, b"z" * 200]
    words = lm.Words((w, i) for i, w in enumerate(known))
    unknown = [b"w\xc3\x89", b"x" * 63, b"y" * 66, b"word", b"0" * 300]
    gaps = [b" ", b"\n\t", b"\x0b\x0c\r ", b"  "]
    pool = [w.upper() for w in known if w != lm.END] + known[-5:] * 50 + unknown * 50
    texts = [b"", b" \n", b"\x1c\x85"] + [b"".join(pool[rng.integers(len(pool))] + gaps[rng.integers(4)] for _ in range(n)) for n in (1, 2, 40, 300)] + [b""]
    tokens = [lm.tokens_of(t) for t in texts]
    for given in (words, lm.Words()):
        ids, rare, keys, starts = given.numbered(texts)
        assert ids.tolist() == [given.get(w, -1) for t in tokens for w in t]
        assert rare == [w for t in tokens for w in t if w not in given]
        assert keys.tolist() == [lm.word_key(w) for w in rare]
        assert starts.tolist() == np.cumsum([0, *map(len, tokens)])[:-1].tolist()


def test_driver_gives_free_native_memory_back(spark):
    commands = spark._jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand")
    server = spark._jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer()
    named = spark._jvm.java.lang.Class.forName
    kinds = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Class, 1)
    kinds[0] = named("javax.management.ObjectName")
    asked = spark.sparkContext._gateway.new_array(spark._jvm.java.lang.Object, 1)
    asked[0] = commands
    known = named("javax.management.MBeanServer").getMethod("getMBeanInfo", kinds).invoke(server, asked).getOperations()
    if not any(x.getName() == "systemTrimNativeHeap" for x in known):
        pytest.skip("a JVM without the command")
    assert common._trim_native(spark).startswith("Trim native heap")


def test_operators_release_between_their_tables(spark, monkeypatch):
    done = Counter()
    monkeypatch.setattr(common, "release", lambda s: done.update(["release"]))
    monkeypatch.setattr(common, "_trim_native", lambda s: done.update(["trim"]))
    rows = 2 * common.RELEASE_EVERY
    for _ in range(rows):
        common.materialize(spark.range(1).toDF("a"), "released")
    assert done == {"release": 2, "trim": rows - 2}


def test_written_tables_hold_rows_alone(spark):
    # each further file is a process that a local file system starts, and so a copy of the JVM for a moment
    rows = spark.range(100).repartition(4)
    written = {few: common.materialize(rows, "rows-alone", few=few) for few in (False, True)}
    names = {few: os.listdir(df._written_to.removeprefix("file://")) for few, df in written.items()}
    assert all(n.startswith("part-") for found in names.values() for n in found)
    assert len(names[False]) == 4 and len(names[True]) == 1
    assert all(sorted(r.id for r in df.collect()) == list(range(100)) for df in written.values())


def test_executors_collect_their_garbage(spark, monkeypatch):
    def collections():
        return sum(b.getCollectionCount() for b in spark._jvm.java.lang.management.ManagementFactory.getGarbageCollectorMXBeans() if "Old" in b.getName() or "MarkSweep" in b.getName())

    before = collections()
    common.release_executors(spark)
    assert collections() > before
    done = Counter()
    monkeypatch.setattr(jaccard, "release_executors", lambda s: done.update(["collected"]))
    docs = spark.createDataFrame([(1, "a b c d e f g"), (2, "a b c d e f g"), (3, "x y")], "doc_id long, text string")
    assert {r.doc_id: r.component_id for r in jaccard.jaccard_components(docs).collect()} == {1: 1, 2: 1, 3: 3}
    assert done["collected"] >= 3
