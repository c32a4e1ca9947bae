"""Results that depend neither on the order of rows nor on partitions, and samples by the whole hash."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from lexweave.llm import quality
from lexweave.llm.common import share


def _documents(spark):
    good = "The report of the committee describes how the river was measured in spring number {}."
    bad = "BUY NOW!!! $$$ click {} click click >>> win win win !!!"
    rows = [(i, (bad if i % 4 == 1 else good).format(i) * (1 + i % 3)) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 4 != 1)) for i in range(400)], "doc_id long, quality int")
    return docs, labels


def test_quality_model_is_the_same_however_rows_are_dealt(spark):
    docs, labels = _documents(spark)
    models = [quality.train(d, labels) for d in (docs.coalesce(1), docs.repartition(7), docs.orderBy(F.desc("doc_id")))]
    first = models[0]
    for m in models[1:]:
        assert m.prior == first.prior and (m.mean == first.mean).all() and (m.spread == first.spread).all() and (m.edges == first.edges).all()
        assert np.allclose(m.weights, first.weights, rtol=0, atol=1e-9)


def test_quality_tells_how_far_it_came(spark):
    docs, labels = _documents(spark)
    model = quality.train(docs, labels)
    assert 1 < model.evaluations <= quality.EVALUATIONS and 0 <= model.gradient < 1e-2
    trace = []
    best = quality.minimise(lambda w: (float(((w - 3) ** 2).sum()), 2 * (w - 3)), 2, trace=trace)
    assert np.allclose(best, 3) and trace[0] == (1, 6.0) and trace[-1][1] <= quality.FLAT


def test_quality_grid_against_sorting(spark):
    rng = np.random.default_rng(5)
    x = rng.gamma(1.0, 3.0, (3_000, quality.FEATURES)) * (rng.random((3_000, quality.FEATURES)) > 0.2)
    table = spark.createDataFrame([(r.tolist(),) for r in x], "x array<double>").repartition(5)
    rows, mean, spread, edges = quality._grid(table)
    assert rows == len(x)
    # a cell is as wide as 1/256 of its values
    assert np.allclose(mean, x.mean(0), rtol=0.004) and np.allclose(spread, x.std(0), rtol=0.004)
    exact = np.sort(x, 0)[[int(np.ceil(len(x) * i / quality.BINS)) - 1 for i in range(1, quality.BINS)]].T
    assert (edges <= exact).all() and np.allclose(edges, exact, rtol=0.004)


@pytest.mark.parametrize("rate", [0.0, 0.1, 0.5, 1.0, 3.0])
def test_share(spark, rate):
    n = spark.range(20_000).filter(share("id", "some", rate)).count()
    assert abs(n - 20_000 * min(rate, 1)) <= 300


def test_share_of_little(spark):
    """A rate below a millionth still picks something, in proportion."""
    picked = spark.range(2_000_000_000, 2_004_000_000).filter(share("id", "some", 2e-6)).count()
    assert 1 <= picked <= 25
