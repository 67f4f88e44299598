"""Every registered query of the engine against its SQL in DuckDB."""

import math
from pathlib import Path

import duckdb
import pytest

from placeloom.functions import text
from placeloom.plans import queries
from placeloom.plans.registry import ORACLES, QUERIES


@pytest.fixture(scope="module")
def duck(sf):
    c = duckdb.connect()
    for f in Path(sf).iterdir():
        c.execute(f"CREATE VIEW {f.stem} AS SELECT * FROM '{f}'")
    return c


def plain(value):
    if value is None or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, (int, float)) or type(value).__name__ == "Decimal":
        return f"{float(value):.6f}"
    return str(value)


def rows(names, data):
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(plain(r[i]) for i in order) for r in data)


#: Queries that SQL can't express, each held against a plain walk below.
BRUTE = ("gcra_limit", "mistyped_names", "normalize_candidates", "phonetic_search", "weighted_places")


def test_queries_without_sql_have_a_plain_model():
    assert sorted(set(QUERIES) - set(ORACLES)) == sorted(BRUTE)


def test_phonetic_search_by_all_pairs(spark, sf, duck):
    sound = text.Language(engine="cologne").phonetic
    names = [r[0] for r in duck.sql("SELECT DISTINCT p_name FROM part").fetchall()]
    want = sorted((a, b, sound(a)) for a in names for b in names if a != b and sound(a) == sound(b))
    assert sorted((r["name"], r["alike"], r["key"]) for r in QUERIES["phonetic_search"](spark, sf).collect()) == want


def test_gcra_limit_by_a_plain_walk(spark, sf, duck):
    every, burst, due, want = 6 * 3600 * 10**6, 24 * 3600 * 10**6, {}, {}
    for key, event, at in duck.sql("SELECT user_id, event_id, epoch_us(ts) FROM events ORDER BY user_id, ts, event_id").fetchall():
        ready = max(due.get(key, 0), at)
        want[key, event] = ready - at <= burst
        if want[key, event]:
            due[key] = ready + every
    got = {(r["key"], r["event_id"]): r["allowed"] for r in QUERIES["gcra_limit"](spark, sf).collect()}
    assert got == want and set(want.values()) == {True, False}


def test_mistyped_names_are_one_error_away(spark, sf):
    kinds = set()
    for r in QUERIES["mistyped_names"](spark, sf).collect():
        a, b = r["p_name"], r["typed"]
        apart = [i for i in range(min(len(a), len(b))) if a[i] != b[i]]
        if len(b) < len(a):
            assert any(a[:i] + a[i + 1 :] == b for i in range(len(a)))
            kinds.add("left out")
        elif len(apart) == 2:
            i, j = apart
            assert j == i + 1 and (a[i], a[j]) == (b[j], b[i])
            kinds.add("swapped")
        else:
            assert len(a) == len(b) and len(apart) <= 1
            kinds.add("replaced")
    assert kinds == {"left out", "swapped", "replaced"}


def test_weighted_places_prefer_important_ones(spark, sf, duck):
    importance = "CAST((p_partkey * 48271) % 65521 AS INTEGER)"
    every = dict(duck.sql(f"SELECT p_partkey, {importance} FROM part").fetchall())
    got = {r["record_id"]: r["importance"] for r in QUERIES["weighted_places"](spark, sf).collect()}
    assert all(every[k] == v for k, v in got.items()) and 0 < len(got) < len(every)
    mean = lambda values: sum(values) / len(values)
    assert mean(list(got.values())) > 1.15 * mean(list(every.values()))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_its_sql(spark, sf, duck, name):
    df = QUERIES[name](spark, sf)
    got = df.collect()
    want = duck.sql(ORACLES[name])
    assert sorted(df.columns) == sorted(want.columns)
    assert rows(df.columns, got) == rows(want.columns, want.fetchall())


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)


def test_normalize_candidates_of_all_lines(spark, tmp_path):
    bodies = ["Norra Storgatan 5\nÅkers styckebruk\n\nSt. Eriks plan", "one line", "Norra Storgatan 5\nlast", None]
    spark.createDataFrame(list(enumerate(bodies)), "doc_id bigint, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([("green part",), ("one line",)], "p_name string").write.parquet(f"{tmp_path}/part.parquet")
    names = {line for b in bodies if b for line in b.split("\n")} | {"green part", "one line"}
    rows = queries.normalize_candidates(spark, str(tmp_path)).collect()
    assert len(rows) == len(names)
    assert {(r.name, r.forms, r.phonetic) for r in rows} == {(n, "|".join(text.SWEDISH.candidates(n)), text.SWEDISH.phonetic(n)) for n in names}
