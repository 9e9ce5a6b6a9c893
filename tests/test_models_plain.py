"""The logistic scorer and its calibration against a plain version: Newton's method and pooled neighbours."""

import random

import numpy as np
import pytest

from helpers import days
from tarnlight.operators import models


def made(seed, n, keys=("AAA", "BBB", "CCC")):
    rng = random.Random(seed)
    out = []
    for i, d in enumerate(days(n)):
        x, y = rng.gauss(0, 1), rng.choice([0.0, 1.0, 5.0])
        p = 1 / (1 + np.exp(-(1.2 * x - 0.4 * y + (i % 3) * 0.5 - 1)))
        out.append((keys[i % len(keys)], d, x if i % 11 else None, y if i % 7 else None, 3.0, bool(rng.random() < p) if i % 19 else None))
    return out


SCHEMA = "currency string, effective_date date, x double, y double, flat double, t boolean"
COLUMNS = ["x", "y", "flat"]


class Plain:
    def __init__(self, rows, validation=None):
        own = [r for r in rows if r[5] is not None]
        cells = np.array([[np.nan if v is None else v for v in r[2:5]] for r in own], float)
        self.medians = np.nanmedian(cells, axis=0)
        filled = np.where(np.isnan(cells), self.medians, cells)
        self.mean, scale = filled.mean(axis=0), filled.std(axis=0)
        self.scale = np.where(scale == 0, 1.0, scale)
        self.keys = sorted({r[0] for r in own})
        t = np.array([r[5] for r in own], float)
        w = np.where(t == 1, len(t) / (2 * t.sum()), len(t) / (2 * (1 - t).sum()))
        a = self.design(rows=own)
        beta, ridge = np.zeros(a.shape[1]), np.ones(a.shape[1]) / w.sum()
        ridge[-1] = 0  # the intercept is free
        for _ in range(60):
            p = 1 / (1 + np.exp(-a @ beta))
            gradient = a.T @ (w * (p - t)) / w.sum() + ridge * beta
            hessian = (a * (w * p * (1 - p))[:, None]).T @ a / w.sum() + np.diag(ridge)
            beta -= np.linalg.lstsq(hessian, gradient, rcond=None)[0]
        self.beta, self.steps = beta, None
        if validation is not None:
            seen = [r for r in validation if r[5] is not None]
            self.steps = pooled(self.raw(seen), np.array([r[5] for r in seen], float))

    def design(self, rows):
        cells = np.array([[np.nan if v is None else v for v in r[2:5]] for r in rows], float)
        x = (np.where(np.isnan(cells), self.medians, cells) - self.mean) / self.scale
        hot = np.array([[float(r[0] == k) for k in self.keys] for r in rows])
        return np.hstack([x, hot, np.ones((len(rows), 1))])

    def raw(self, rows):
        return 1 / (1 + np.exp(-self.design(rows) @ self.beta))

    def score(self, rows):
        p = self.raw(rows)
        return p if self.steps is None else np.interp(p, *self.steps)


def pooled(scores, labels):
    """Ends and levels of the best rising step function: neighbours that fall are pooled."""
    blocks = []
    for s in np.unique(scores):
        blocks.append([labels[scores == s].sum(), float((scores == s).sum()), s, s])
        while len(blocks) > 1 and blocks[-2][0] / blocks[-2][1] >= blocks[-1][0] / blocks[-1][1]:
            last = blocks.pop()
            blocks[-1] = [blocks[-1][0] + last[0], blocks[-1][1] + last[1], blocks[-1][2], last[3]]
    xs = [v for b in blocks for v in (b[2], b[3])]
    return np.array(xs), np.array([b[0] / b[1] for b in blocks for _ in range(2)])


@pytest.mark.parametrize("calibrated", [False, True])
def test_scores_match_a_plain_version(spark, calibrated):
    train, validation, test = made(1, 400), made(2, 150), made(3, 120) + [("new", days(1)[0], 0.5, 1.0, 3.0, None)]
    frames = [spark.createDataFrame(r, SCHEMA) for r in (train, validation, test)]
    scorer = models.fit_scorer(frames[0], COLUMNS, "t", "logreg", frames[1] if calibrated else None)
    assert (scorer.calibrator is not None) is calibrated
    got = {(r["currency"], r["effective_date"]): r["score"] for r in models.score(frames[2], scorer).collect()}
    want = Plain(train, validation if calibrated else None).score(test)
    off = [abs(got[r[0], r[1]] - w) for r, w in zip(test, want)]
    # A step of the calibration may fall between two scores that differ in their last digits.
    assert sorted(off)[int(len(off) * (0.95 if calibrated else 1)) - 1] < 2e-3 and len(got) == len(test)


def test_each_fold_is_scored_by_a_model_of_its_own_past(spark):
    from pyspark.sql import functions as F

    from tarnlight.operators import backtest, splits

    rows = made(5, 700)
    frame = spark.createDataFrame(rows, SCHEMA).withColumns({"rub_per_unit": F.lit(10.0), "forward_mean_h5": F.lit(10.5) + F.col("flat") * 0, "has_fact": F.lit(True)})
    at = [days(701)[n] for n in (300, 400, 500, 600, 700)]
    folds = [splits.Fold(f"f{k}", "wf_oos", at[k], at[k], at[k + 1], at[k + 1], at[k + 2]) for k in range(3)]
    found, audit = backtest.walk_forward_predictions(frame, folds, COLUMNS, "t", 5)
    plain = lambda df: [tuple(r) for r in df.select("currency", "effective_date", *COLUMNS, "t").collect()]
    got = {(r["fold"], r["currency"], r["effective_date"]): r["score"] for r in found.collect()}
    assert all(a["calibrated"] for a in audit) and [a["fold"] for a in audit] == ["f0", "f1", "f2"]
    seen = 0
    for fold in folds:
        train, test = plain(splits.train_rows(frame, fold, 5)), plain(splits.test_rows(frame, fold))
        assert max(r[1] for r in train) < fold.val_start and min(r[1] for r in test) == fold.test_start
        want = Plain(train, plain(splits.validation_rows(frame, fold, 5))).score(test)
        off = sorted(abs(got[fold.name, r[0], r[1]] - w) for r, w in zip(test, want))
        assert off[int(0.9 * len(off)) - 1] < 2e-3
        seen += len(test)
    assert seen == len(got)
