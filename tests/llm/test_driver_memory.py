"""What the driver holds: freed native memory goes back, the fit has one copy of its sample, stars take no round."""

import tracemalloc

import numpy as np

from knotwork import durable as shared
from knotwork.llm import components, quality
from knotwork.llm.components import connected_components


def test_the_driver_gives_freed_memory_back(spark, monkeypatch):
    assert shared.driver_trimmed(spark)
    asked = []
    monkeypatch.setattr(shared, "driver_trimmed", asked.append)
    assert shared.durable(spark.range(3)).count() == 3
    assert asked == [spark]


def test_fit_holds_its_sample_once():
    draws = np.random.default_rng(3)
    x = draws.random((3_000, quality.BUCKETS)) * (draws.random((3_000, quality.BUCKETS)) < 0.2)
    labels, idf = (draws.random(3_000) < 0.5).astype(float), 1 + draws.random(quality.BUCKETS)
    w = quality.normalised(x * idf)
    values, vectors = np.linalg.eigh(w.T @ w)
    basis = vectors[:, ::-1][:, : quality.RANK].astype(np.float32)
    want = quality.normalised(w.astype(np.float32) @ basis)
    del w
    tracemalloc.start()
    space = quality.Space.fit(x, labels, idf)
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert most < x.nbytes  # 2.0 times that before, besides the sample itself
    assert np.array_equal(space.basis, basis) and np.array_equal(space.vectors, want)


def test_stars_take_no_round(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "durable", lambda df: written.append(1) or shared.durable(df))

    def found(edges):
        written.clear()
        return {r.node: r.component for r in connected_components(spark.createDataFrame(edges, "a long, b long")).collect()}

    assert found([(1, 2), (3, 1), (1, 2), (5, 6), (7, 7)]) == {1: 1, 2: 1, 3: 1, 5: 5, 6: 5}
    assert len(written) == 2
    assert found([(i, i + 1) for i in range(9)] + [(20, 21), (22, 21)]) == {i: 0 for i in range(10)} | {20: 20, 21: 20, 22: 20}
    assert len(written) > 2
    assert found([]) == {}
