"""The quality model is fitted to all labelled documents and all their pairs."""

import numpy as np
import pytest

from tessera.llm import quality


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(4)
    label = rng.integers(0, 2, 2600)
    x = np.clip(rng.normal(size=(2600, 3)) * 0.5 + 1 + label[:, None] * [0.6, -0.3, 0.0], 0, 3)
    x[:40] = 0
    return label, x, spark.createDataFrame([(int(k), v.tolist()) for k, v in zip(label, x, strict=True)], "label int, x array<double>").repartition(3)


def test_fit_minimises_the_loss_of_all_pairs(rows):
    label, x, frame = rows
    w, cut, scale = quality.fit(frame)
    d = (x[label == 1][:, None, :] - x[label == 0][None, :, :]).reshape(-1, 3)
    miss = 1 / (1 + np.exp(d @ np.array(w)))
    gradient = (d * miss[:, None]).mean(0) - 0.01 * np.array(w)
    assert np.abs(gradient).max() < 1e-4
    s = np.sort(x @ np.array(w))
    low = int((label == 0).sum())
    assert cut == pytest.approx((s[low - 1] + s[low]) / 2, abs=1e-12) and scale == pytest.approx(s.std() / 2)


@pytest.mark.parametrize("values", [[2.0], [1.0, 1.0, 1.0], [0.0, 5e-324, 3.0], [-5.0, -5.0, 1e-9, 7.0, 7.0, 7.0, 1e300]])
def test_order_statistics_by_counts(spark, values):
    frame = spark.createDataFrame([(float(v),) for v in values], "s double")
    for k in range(len(values)):
        assert quality._next_two(frame, k) == (sorted(values)[k], sorted(values)[min(k + 1, len(values) - 1)])
