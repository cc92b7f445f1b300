"""Title queries over many files of few titles."""

import os

import duckdb
import pytest

from seriesloom.operators import lookup, match, search
from seriesloom.plans.registry import QUERIES

DATA = "/root/testdata/sf0.001"


def test_files_are_never_sent_uncounted(spark, monkeypatch):
    """Tables beyond the count are shuffled, however small Spark thinks they are."""
    monkeypatch.setattr(lookup, "SENT_ROWS", 0)
    files = spark.createDataFrame([(1, "red ring", 2000)], "id int, title string, year int")
    entries = spark.createDataFrame([(5, "red ring", 2000, "MOVIE", 1.0)], "cand int, title string, year int, category string, popularity double")
    plans = spark.createDataFrame([(1, 1, "red ring", 2000, "MOVIE", "primary-title")], "id int, plan_no int, query string, year int, category string, reason string")
    scored = search.score_results(search.search(plans, entries), plans, files, entries)
    assert "Broadcast" not in scored._jdf.queryExecution().executedPlan().toString()
    assert [tuple(r) for r in scored.select("id", "plan_no", "place", "cand").collect()] == [(1, 1, 0, 5)]


def test_alike_files_are_searched_once(spark):
    rows = [(4, "red ring", None), (2, "red ring", None), (3, "red ring", 1999), (7, None, 1999), (6, None, 1999)]
    first, members = search.alike_files(spark.createDataFrame(rows, "id int, title string, year int"))
    assert sorted(r.id for r in first.collect()) == [2, 3, 6]
    found = spark.createDataFrame([(2, 50), (2, 51), (6, 52)], "id int, cand int")
    got = sorted((r.id, r.cand) for r in search.for_members(found, members).collect())
    assert got == [(2, 50), (2, 51), (4, 50), (4, 51), (6, 52), (7, 52)]


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_every_pair_of_part_and_nation_is_scored(spark):
    con = duckdb.connect()
    pairs = con.execute(f"SELECT p_partkey, n_nationkey FROM '{DATA}/part.parquet', '{DATA}/nation.parquet' ORDER BY ALL").fetchall()
    got = QUERIES["title_score"](spark, DATA).collect()
    assert sorted((r.p_partkey, r.cand) for r in got) == pairs
    assert min(r.score for r in got) < match.LEAST


@pytest.mark.skipif(not os.path.isdir(DATA), reason="tables are not there")
def test_the_lead_is_over_the_next_of_all_entries(spark):
    scores: dict = {}
    for r in QUERIES["title_score"](spark, DATA).collect():
        scores.setdefault(r.p_partkey, []).append(r.score)
    got = {r.p_partkey: r.margin for r in QUERIES["resolve_margin"](spark, DATA).collect()}
    ranked = {k: sorted(v, reverse=True) for k, v in scores.items()}
    assert set(got) == {k for k, v in ranked.items() if v[0] >= match.LEAST}
    assert any(ranked[k][1] < match.LEAST for k in got)
    assert all(abs(got[k] - (ranked[k][0] - ranked[k][1])) < 3e-6 for k in got)
