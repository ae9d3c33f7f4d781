"""The fit of a law where points do not tell all of its terms apart."""

import numpy as np

from cadenza.operators import sequences as S


def test_points_that_leave_terms_open():
    """Resamples of few points, or of points on a line: no term is singled out, but there is a fit."""
    for seed in range(12):
        rng = np.random.default_rng(seed)
        x, y = np.log(rng.integers(1, 500, 6)), np.log(rng.integers(50, 90_000, 6))
        target = -0.1 * x - 0.15 * y + rng.normal(0, 0.01, 6)
        for at in (rng.integers(0, 6, 6), [0, 1, 1, 0], [2, 2, 2]):
            with np.errstate(all="ignore"):
                assert np.isfinite(S.fit_law(x[at], y[at], target[at])).all()


def test_law_of_no_points(spark):
    points = spark.createDataFrame([], "x double, y double, l double")
    assert [set(r) for r in S.scaling_law(points, 4).collect()] == [{None}]
