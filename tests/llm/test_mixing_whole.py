"""Fits of the mixing rates with the production weights and steps."""

import numpy as np
import pytest

from seriesloom.llm import mixing
from seriesloom.llm.mixing import CLOSE, WEIGHTS, fit_rates, unreachable


def members_of(spark, floor, tail=40):
    """Clean rows with a chance of toxic and poor from ``floor`` on, and rows of either domain."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        poor = rng.beta(60, 3) if i % 7 == 0 else floor + rng.beta(1, tail)
        toxic = rng.beta(60, 3) if i % 29 == 1 else floor + rng.beta(1, tail)
        rows.append((i, int(rng.integers(1, 500)), float((1 - poor) * (1 - toxic)), float((1 - poor) * toxic), float(poor)))
    return spark.createDataFrame(rows, "doc_id long, n_tokens long, p_fine double, p_toxic double, p_poor double").coalesce(1)


def test_production_fit_converges(spark):
    members = members_of(spark, 0.0)
    assert unreachable(members, WEIGHTS) == []
    steps, targets, reached = fit_rates(members, WEIGHTS)
    assert np.allclose(reached, targets, rtol=CLOSE) and len(steps) < mixing.STEPS
    x = np.array([tuple(r)[1:] for r in members.collect()], float)
    r = np.ones(len(x))
    for s in steps:
        r = np.maximum(0, r - x[:, 1:] @ np.array(s))
    assert np.allclose((r * x[:, 0]) @ x[:, 1:], targets, rtol=2 * CLOSE)


def test_targets_out_of_reach_are_reported(spark, monkeypatch):
    members = members_of(spark, 0.001, 1000)
    assert unreachable(members, WEIGHTS) == ["poor"]
    monkeypatch.setattr(mixing, "domain_posteriors", lambda *_: members)
    with pytest.warns(UserWarning, match="out of reach of any rates: .'poor'"):
        rated, totals = mixing.mix_with_totals(members, None)
    target, reached = totals["poor"]
    assert reached > 2 * target and rated.agg({"rate": "max"}).first()[0] < 3


def test_no_rows_and_no_budget(spark):
    members = members_of(spark, 0.0)
    assert fit_rates(members.where("false"), WEIGHTS) == ([], [0.0] * 3, [0.0] * 3)
    bad = members.selectExpr("doc_id", "n_tokens", "0.0D as p_fine", "0.0D as p_toxic", "1.0D as p_poor")
    assert fit_rates(bad, WEIGHTS)[0] == []
