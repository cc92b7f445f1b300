"""Scores that do not depend on how many rows of each class were drawn."""

import numpy as np

from seriesloom.llm.quality import PENALTY, train


def test_scores_keep_the_class_shares(spark):
    rng = np.random.default_rng(4)
    rows = []
    for i in range(1200):
        label = int(rng.random() < 0.85)
        found = np.unique(np.concatenate([rng.integers(10, 40, 6), rng.choice([1, 2], 1, p=[0.3, 0.7] if label else [0.7, 0.3])]))
        rows.append((i * 7919 % 1201, found.astype(np.uint16).tobytes(), label))
    known = spark.createDataFrame(rows, "`order` long, features binary, label int").coalesce(1)
    share = np.mean([r[2] for r in rows])
    for sample in (4000, 240):  # all rows, and as many of each class
        m = train(known, sample_rows=sample)
        margins = np.array([m.weights[np.frombuffer(r[1], np.uint16)].sum() for r in rows])
        scores = 1 / (1 + np.exp(-(m.slope * margins + m.shift)))
        assert abs(scores.mean() - share) < 0.05


def test_fit_against_brute_force(spark):
    """Counts by hand, and weights whose objective no other found way comes below."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(240):
        label = int(rng.random() < 0.7)
        found = np.unique(np.concatenate([rng.integers(10, 40, 6), rng.choice([1, 2], 1, p=[0.2, 0.8] if label else [0.8, 0.2])]))
        rows.append((i, found.astype(np.uint16), label))
    known = spark.createDataFrame([(i, f.tobytes(), y) for i, f, y in rows], "`order` long, features binary, label int")
    n = [sum(y == k for _, _, y in rows) for k in (0, 1)]
    ratio = np.array([np.log((sum(j in f for _, f, y in rows if y) + 1) / (n[1] + 2) / ((sum(j in f for _, f, y in rows if not y) + 1) / (n[0] + 2))) for j in range(40)])
    model = train(known)
    x = np.zeros((240, 40))
    for i, (_, f, _) in enumerate(rows):
        x[i, f] = ratio[f]
    y = np.array([1.0 if r[2] else -1.0 for r in rows])
    box = PENALTY * 0.5 / np.array([n[0], n[1]])[(y > 0).astype(int)] * 240

    def objective(w):
        return 0.5 * w @ w + (box * np.maximum(0, 1 - y * (x @ w))).sum()

    # the model's weights hold the ratios; without them they are those of the linear model
    used = ratio != 0
    mine = np.zeros(40)
    mine[used] = model.weights[:40][used] / ratio[used]
    w, best = np.zeros(40), np.inf
    for t in range(1, 20001):
        w = w - (w - ((box * y * (y * (x @ w) < 1))[:, None] * x).sum(0)) / t
        best = min(best, objective(w)) if t % 50 == 0 else best
    assert objective(mine) <= best * 1.005
    margins = x @ mine
    assert np.allclose(margins, [model.weights[f].sum() for _, f, _ in rows])
