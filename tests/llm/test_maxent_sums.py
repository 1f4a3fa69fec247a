"""The maximum-entropy model's sums of gradients over rows of its tables, its softmax, and what a step costs."""

import numpy as np
import pytest

from corvane.llm import maxent


def by_columns(at, d, times):
    """Column after column with bincount."""
    used, place = np.unique(at, return_inverse=True)
    return used, np.stack([np.bincount(place, weights=np.tile(c, times), minlength=len(used)) for c in d.T.astype(np.float64)], axis=1)


def zipf(rng, rows, n):
    return np.minimum(rows - 1, rng.zipf(1.3, n) - 1)


@pytest.mark.parametrize("rows,n", [(1, 1), (1, 5000), (7, 3), (8192, 16384), (1 << 18, 16384)])
def test_steps_equal_sums_by_column(rows, n):
    rng = np.random.default_rng(5)
    parts, d = [zipf(rng, rows, n), rng.integers(0, rows, n), zipf(rng, rows, n)], rng.normal(size=(n, maxent.WIDTH)).astype(np.float32)
    w, g2 = rng.normal(size=(rows, maxent.WIDTH)).astype(np.float32), np.abs(rng.normal(size=(rows, maxent.WIDTH))).astype(np.float32)
    used, g = by_columns(np.concatenate(parts), d, 3)
    want, want2 = w.astype(np.float64), g2.astype(np.float64)
    want2[used] += g * g
    want[used] -= 0.15 * g / np.sqrt(want2[used] + 1e-6)
    maxent._step(w, g2, parts, d, 0.15)
    assert np.allclose(w, want, atol=1e-4) and np.allclose(g2, want2, rtol=1e-3, atol=1e-3)


def test_softmax_of_any_exponents():
    rng = np.random.default_rng(6)
    z = rng.normal(size=(400, maxent.WIDTH)) * np.repeat([0.0, 1.0, 30.0, 1000.0], 100)[:, None]
    z[-1] = -500.0
    want = np.exp(z - z.max(axis=1, keepdims=True))
    want /= want.sum(axis=1, keepdims=True)
    mine = z.astype(np.float32)
    assert np.allclose(maxent._softmax(mine.copy()), want, atol=1e-4)
    # a row's result is its own, whatever stands beside it
    assert np.array_equal(maxent._softmax(mine.copy())[:300], maxent._softmax(mine[:300].copy()))
    branch = np.arange(400) % maxent.WIDTH
    assert np.allclose(maxent._chosen(mine.copy(), branch), want[np.arange(400), branch], atol=1e-4)


def test_a_step_goes_over_its_tokens_once(monkeypatch):
    """Not once more for each column of the table."""
    rng = np.random.default_rng(7)
    counted, bincount = [], np.bincount
    monkeypatch.setattr(np, "bincount", lambda x, *more, **named: counted.append(len(x)) or bincount(x, *more, **named))
    w, g2 = np.zeros((2, 1 << 15, maxent.WIDTH), np.float32)
    maxent._step(w, g2, [zipf(rng, 1 << 15, 16384), rng.integers(0, 1 << 15, 16384)], rng.normal(size=(16384, maxent.WIDTH)).astype(np.float32), 0.15)
    assert sum(counted) <= 4 * 16384
    # rows of the gradient that are gathered: each token's once, then those of ever fewer groups
    taken = []

    class Rows(np.ndarray):
        def take(self, at, axis=None):
            taken.append(len(at))
            return np.asarray(self).take(at, axis=axis)

    count = np.array([1, 40, 16384, 2, 7])
    d = np.ones((int(count.sum()), maxent.WIDTH), np.float32).view(Rows)
    got = maxent.run_sums(d, np.arange(len(d)), np.cumsum(count) - count, count)
    assert np.array_equal(np.asarray(got), np.repeat(count[:, None], maxent.WIDTH, axis=1)) and sum(taken) == len(d)
