"""Mini-batch training against plain numpy."""

import zlib

import numpy as np
import pytest
from gapline.operators import training


def plain(ids, x, y, classes, epochs, batch, rate, seed):
    """Softmax regression with Adam, in loops."""
    w, b = np.zeros((classes, x.shape[1])), np.zeros(classes)
    m, v, t, losses, right = 0.0, 0.0, 0, [], []
    batches = max(1, round(len(y) / batch))
    for epoch in range(epochs):
        at = np.array([zlib.crc32(f"{seed}:{epoch}:{i}".encode()) % batches for i in ids])
        loss = good = 0.0
        for k in range(batches):
            rows = np.flatnonzero(at == k)
            if not len(rows):
                continue
            gw, gb = np.zeros_like(w), np.zeros_like(b)
            for r in rows:
                z = w @ x[r] + b
                p = np.exp(z - z.max()) / np.exp(z - z.max()).sum()
                loss -= np.log(p[y[r]])
                good += p.argmax() == y[r]
                p[y[r]] -= 1
                gw += np.outer(p, x[r])
                gb += p
            g = np.concatenate([gw.ravel(), gb]) / len(rows)
            t += 1
            m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
            step = rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
            w, b = w - step[: w.size].reshape(w.shape), b - step[w.size :]
        losses.append(loss / len(y))
        right.append(good / len(y))
    return w, b, losses, right


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y = rng.integers(0, 3, 90)
    return np.arange(90), rng.normal(size=(90, 5)) + np.eye(3, 5)[y] * 2, y


def test_training_is_plain_adam(spark, data):
    ids, x, y = data
    rows = [(int(i), int(c), [float(v) for v in r]) for i, c, r in zip(ids, y, x, strict=True)]
    bad = [(900, None, [0.0] * 5), (901, 1, None), (902, 1, [None] * 5)]
    df = spark.createDataFrame(rows + bad, "id long, label int, vector array<double>")
    w, b, losses, right = plain(ids, x, y, 3, 2, 40, 0.05, 7)
    got = [training.train(df.repartition(n), 3, epochs=2, batch=40, rate=0.05, seed=7, fan_in=2) for n in (1, 5)]
    for g in got:
        assert np.allclose(g.weights, w, atol=1e-8) and np.allclose(g.bias, b, atol=1e-8)
        assert np.allclose(g.losses, losses, atol=1e-8) and np.allclose(g.accuracies, right)
    assert (got[0].weights == got[1].weights).all() and losses[1] < losses[0]


def test_training_rejects_what_it_cannot_use(spark):
    kind = "id long, label int, vector array<double>"
    with pytest.raises(ValueError, match="no rows"):
        training.train(spark.createDataFrame([], kind), 2)
    for rows in ([(1, 2, [1.0])], [(1, -1, [1.0])], [(1, 0, [1.0]), (2, 0, [1.0, 2.0])]):
        with pytest.raises(ValueError, match="labels are from"):
            training.train(spark.createDataFrame(rows, kind), 2)


def test_a_step_reads_its_own_rows_only(spark, data, monkeypatch):
    """Before, every step read the whole table, so the work grew with the square of its rows."""
    ids, x, y = data
    df = spark.createDataFrame([(int(i), int(c), [float(v) for v in r]) for i, c, r in zip(ids, y, x, strict=True)], "id long, label int, vector array<double>")
    read, whole = [], training._sum

    def seen(rows, *rest):
        names = rows.inputFiles()
        read.append(spark.read.parquet(*names).count())
        return whole(rows, *rest)

    monkeypatch.setattr(training, "_sum", seen)
    a = training.train(df, 3, epochs=2, batch=20, seed=7)
    assert sum(read) == 2 * len(ids) and len(read) > 6
    monkeypatch.setattr(training, "SMALL", 0)  # sums meet in the tree
    assert (training.train(df, 3, epochs=2, batch=20, seed=7).weights == a.weights).all()
