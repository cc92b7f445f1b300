"""Mixing sources to target weights with soft memberships.

Classifiers fitted on the labelled table give each document the chance to belong
to each domain. A rate for every document then makes the expected tokens of each
domain meet its target: projected gradient steps on the squared difference from a
rate of one, until the targets are met. The gradient is scaled by the inverse of the
domains' joint tokens over the rows whose rate is not zero, as the plain one, scaled
by each domain's present share, would take hundreds of steps for a rare domain. A step
changes a document's rate by an amount that follows from its posteriors alone, so
a task needs only the few numbers of the steps so far and an iteration is one
aggregate over the posteriors.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import FEATURE_BYTES, Stored, carried, plain_columns, text_slices
from .quality import labelled_features, train

#: Domains, in the order of all vectors below.
DOMAINS = ("fine", "toxic", "poor")
#: Target weights of the production queries.
WEIGHTS = {"fine": 0.985, "toxic": 0.0145, "poor": 0.0005}
#: Relative miss of all targets at which steps end.
CLOSE = 1e-4
#: Share by which a step towards a target out of reach must lessen the squared misses, and share of the way back that such a domain is given.
GAIN, EASE = 0.01, 0.05
#: Steps after which the fit is given up, which is reported, and halvings of one step.
STEPS, HALVINGS = 400, 12


def domain_posteriors(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", carry: tuple[str, ...] = (), prefix: str = ""
) -> DataFrame:
    """Identifier, ``n_tokens`` (words) and the chance of each domain in ``DOMAINS`` (``p_<domain>``) for every row.

    Poor is what the quality labels mark 0, toxic what is not poor and marked
    toxic, fine the rest. Null texts have no tokens and the posteriors of empty
    ones. The names of the new columns begin with ``prefix``.
    """
    known = labelled_features(docs, labels, {"quality": "shapes", "toxic": "words"}, id_col, text_col)
    models = train(known.df, "quality", "quality_features"), train(known.df, "toxic", "toxic_features", "words")
    known.drop()
    sent = docs.sparkSession.sparkContext.broadcast(models)
    added = ["n_tokens", *[f"p_{d}" for d in DOMAINS]]
    kept, plain, fields = carried(docs, (id_col, *carry), prefix, (*added, "rate", "copies", *[f"{k}_{d}" for k in ("target", "reached") for d in DOMAINS]))
    slim, text_name = plain_columns(docs, kept, plain, text_col)
    schema = T.StructType([*fields, T.StructField("n_tokens", T.LongType()), *[T.StructField(f"p_{d}", T.DoubleType()) for d in DOMAINS]])

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        good, bad = sent.value
        for batch in text_slices(batches, text_name, FEATURE_BYTES):
            texts = [t or "" for t in batch.column(text_name).to_pylist()]
            q, t = good.scores(texts), bad.scores(texts)
            cols = [pa.array([len(x.split()) for x in texts], pa.int64()), pa.array(q * (1 - t)), pa.array(q * t), pa.array(1 - q)]
            yield pa.RecordBatch.from_arrays([batch.column(c) for c in plain] + cols, names=plain + added)

    made = slim.mapInArrow(work, schema)
    return made.select(*[F.col(a).alias(c) for c, a in zip(kept, plain)], *[F.col(a).alias(f"{prefix}{a}") for a in added])


def _rate(steps: list[list[float]], prefix: str = "") -> Column:
    """Rate after the steps: each takes off its scaled gradient and stays at or above zero."""
    if not steps:
        return F.lit(1.0)
    past = F.expr("array(" + ", ".join("array(" + ", ".join(f"{float(x)!r}D" for x in s) + ")" for s in steps) + ")")
    move = lambda s: sum((F.col(f"{prefix}p_{d}") * s[k] for k, d in enumerate(DOMAINS)), F.lit(0.0))
    return F.aggregate(past, F.lit(1.0), lambda r, s: F.greatest(F.lit(0.0), r - move(s)))


def _totals(members: DataFrame, steps: list[list[float]]) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of each domain, and joint tokens of each two over rows of a rate above zero."""
    n = len(DOMAINS)
    names = [f"s{k}" for k in range(n + n * n)]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = np.zeros(len(names))
        for batch in batches:
            tokens, *p = [np.asarray(c, dtype=float) for c in batch.columns]
            p = np.stack(p, 1)
            rate = np.ones(len(tokens))
            for s in steps:
                rate = np.maximum(0.0, rate - p @ np.array(s))
            free = p * np.where(rate > 0, tokens, 0.0)[:, None]
            sums += np.concatenate([(rate * tokens) @ p, (free.T @ p).ravel()])
        yield pa.RecordBatch.from_arrays([pa.array([x]) for x in sums], names=names)

    parts = members.select("n_tokens", *[f"p_{d}" for d in DOMAINS]).mapInArrow(work, ", ".join(f"{c} double" for c in names))
    row = [float(x) for x in parts.agg(*[F.coalesce(F.sum(c), F.lit(0.0)).alias(c) for c in names]).first()]
    return np.array(row[:n]), np.array(row[n:]).reshape(n, n)


def unreachable(members: DataFrame, weights: dict[str, float]) -> list[str]:
    """Domains whose share next to the first one's is above, or below, their target in every single row with tokens.

    No rates can meet such a target. Domains that can each be reached, but not all
    at once, are not found here; their fit ends unmet.
    """
    first = DOMAINS[0]
    over = {d: F.col(f"p_{d}") * weights[first] - F.col(f"p_{first}") * weights[d] for d in DOMAINS[1:] if d in weights}
    if not over:
        return []
    ends = [f(x).alias(f"{d}{k}") for d, x in over.items() for k, f in enumerate((F.min, F.max))]
    row = members.where("n_tokens > 0").agg(*ends).first()
    return [d for d in over if row[f"{d}0"] is not None and (row[f"{d}0"] > 0 or row[f"{d}1"] < 0)]


def fit_rates(members: DataFrame, weights: dict[str, float], steps: int = STEPS) -> tuple[list[list[float]], list[float], list[float]]:
    """Gradient steps, target totals and reached totals.

    The token budget is set by the first domain, which keeps its present expected
    tokens; the others get theirs in proportion to the weights. A domain without
    a weight or without any tokens is left out of the fit. Steps go on until all
    targets are met to ``CLOSE``. A domain that is ``unreachable`` is first drawn
    towards its target by plain steps, as long as these lessen the squared misses
    by ``GAIN``; then it is held at what it has reached while the others are met,
    and given ``EASE`` of the way back wherever they cannot be met so. Without
    tokens of the first domain there is no budget and no step.
    """
    present, joint = _totals(members, [])
    budget = present[0] / weights[DOMAINS[0]]
    targets = np.array([budget * weights[d] if d in weights else t for d, t in zip(DOMAINS, present)])
    scale = np.where(targets > 0, targets, np.maximum(present, 1.0))
    fitted = np.flatnonzero((present > 0) & np.array([d in weights for d in DOMAINS]))
    far = [DOMAINS.index(d) for d in unreachable(members, weights)] if budget > 0 else []
    taken: list[list[float]] = []
    now, goals = present, targets.copy()

    def misses(totals: np.ndarray) -> float:
        return float((((totals - goals) / scale)[fitted] ** 2).sum())

    def plain() -> np.ndarray:
        out = np.zeros(len(DOMAINS))
        out[fitted] = (now - goals)[fitted] / present[fitted]
        return out

    def tried(tries: list[np.ndarray], gain: float) -> bool:
        """Take the first step that lessens the misses by its share."""
        nonlocal now, joint
        for step in tries:
            got = _totals(members, [*taken, step.tolist()])
            if misses(got[0]) <= misses(now) * (1 - gain):
                taken.append(step.tolist())
                now, joint = got
                return True
        return False

    while any(k in fitted for k in far) and len(taken) < steps and tried([plain()], GAIN):
        pass
    goals[far] = now[far]
    while budget > 0 and len(taken) < steps and np.abs(((now - goals) / scale)[fitted]).max() >= CLOSE:
        whole = np.zeros(len(DOMAINS))
        if np.trace(joint) > 0:
            free = joint[np.ix_(fitted, fitted)]
            whole[fitted] = np.linalg.solve(free + 1e-12 * np.trace(free) * np.eye(len(fitted)), (now - goals)[fitted])
        if not tried([whole / 2**k for k in range(HALVINGS)] + [plain()], CLOSE):
            if np.allclose(goals[far], present[far], rtol=EASE):
                break
            goals[far] += EASE * (present[far] - goals[far])
    return taken, targets.tolist(), now.tolist()


def mix_with_totals(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    prefix: str = "",
) -> tuple[DataFrame, dict[str, tuple[float, float]]]:
    """What ``mix_documents`` gives, and the target and reached tokens of each domain.

    A target that is missed is warned of.
    """
    weights = weights or WEIGHTS
    members = Stored(domain_posteriors(docs, labels, id_col, text_col, carry, prefix), "members").df
    added = ["n_tokens", *[f"p_{d}" for d in DOMAINS]]
    steps, targets, reached = fit_rates(members.select(*[F.col(f"{prefix}{c}").alias(c) for c in added]), weights)
    totals = dict(zip(DOMAINS, zip(targets, reached)))
    missed = {d: f"{a:.6g} tokens for {t:.6g}" for d, (t, a) in totals.items() if d in weights and abs(a - t) > CLOSE * t}
    if missed:
        out = unreachable(members.select(*[F.col(f"{prefix}{c}").alias(c) for c in added]), weights)
        warnings.warn(f"targets not met after {len(steps)} steps: {missed}; out of reach of any rates: {out}", stacklevel=2)
    rate, copies = f"{prefix}rate", f"{prefix}copies"
    chance = F.pmod(F.xxhash64(F.col(f"`{id_col}`"), F.col(f"{prefix}n_tokens")), F.lit(1 << 30)) / float(1 << 30)
    rated = members.withColumn(rate, _rate(steps, prefix))
    up = (chance < F.col(rate) - F.floor(rate)).cast("long")
    told = {f"{prefix}{k}_{d}": F.lit(float(v)) for d, pair in totals.items() for k, v in zip(("target", "reached"), pair)}
    return rated.withColumn(copies, F.floor(rate) + up).withColumns(told), totals


def mix_documents(
    docs: DataFrame,
    labels: DataFrame,
    weights: dict[str, float] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    carry: tuple[str, ...] = (),
    prefix: str = "",
) -> DataFrame:
    """``n_tokens`` (words), posteriors, ``rate`` and ``copies`` of every row, with the columns of ``carry``.

    ``target_<domain>`` and ``reached_<domain>``, the same in every row, are a
    domain's target and its expected words under the rates; a domain without a
    weight has its present words as target.

    The names of these columns begin with ``prefix``, so that columns of any name
    can be carried. ``copies`` is the rate rounded up or down by a hash of
    identifier and token count, up as often as the fraction says, so that totals
    keep their expectation. Null texts have no tokens, so their rates change no
    total; null identifiers are kept; repeated rows are rated alike. An empty
    table gives an empty result. Targets that are missed are warned of;
    ``mix_with_totals`` returns them with what was reached.
    """
    return mix_with_totals(docs, labels, weights, id_col, text_col, carry, prefix)[0]
