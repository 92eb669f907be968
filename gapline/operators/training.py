"""Training of the gates by mini-batches: softmax regression, cross entropy, Adam.

Rows are dealt to the batches of an epoch by a hash of seed, epoch and id, so that runs repeat, whatever the table's partitioning. For each batch the tasks sum
the gradients of their rows, a vector of fixed size each; those meet in a tree of ``fan_in`` (by shuffles, not on the driver) and one sum reaches the driver, which
makes Adam's step; batches of at most ``SMALL`` rows need no tree. Gradients are added as whole multiples of 2**-40, so that the order of the sums doesn't matter either. The table is written to the shared
folder once, each row with its features only, and for each epoch again in a folder for each batch: a step reads its own rows only, and a lost executor costs a part
of one step.

Rows with a null label, vector or place in it don't train; rows that share an id fall in one batch together. An empty table is an error.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.sources.shared import Scope

#: gradients are whole multiples of this
GRAIN = 2.0**-40
#: rows of a batch whose sums need no tree: they are read in a task or two
SMALL = 1 << 14


@dataclass
class Gates:
    weights: np.ndarray  # classes x places
    bias: np.ndarray
    losses: list[float]  # of each epoch's batches, before their steps
    accuracies: list[float]


def softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def sums(x: np.ndarray, y: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Gradients of weights and bias, loss, right answers and rows, summed over rows, in grains."""
    p = softmax(x @ weights.T + bias)
    own = p[np.arange(len(y)), y]
    d = p.copy()
    d[np.arange(len(y)), y] -= 1.0
    each = np.concatenate(
        [(d[:, :, None] * x[:, None, :]).reshape(len(y), -1), d, -np.log(np.maximum(own, 1e-300))[:, None], (p.argmax(1) == y)[:, None], np.ones((len(y), 1))], 1
    )
    return np.rint(each / GRAIN).astype(np.int64).sum(0)


@dataclass
class Adam:
    rate: float
    first: np.ndarray
    second: np.ndarray
    n: int = 0

    def step(self, gradient: np.ndarray) -> np.ndarray:
        self.n += 1
        self.first = 0.9 * self.first + 0.1 * gradient
        self.second = 0.999 * self.second + 0.001 * gradient**2
        return self.rate * (self.first / (1 - 0.9**self.n)) / (np.sqrt(self.second / (1 - 0.999**self.n)) + 1e-8)


def batch_of(id_column: str, seed: int, epoch: int, batches: int):
    """The batch of each row in an epoch."""
    return F.pmod(F.crc32(F.concat_ws(":", F.lit(str(seed)), F.lit(str(epoch)), F.col(id_column).cast("string")).cast("binary")), F.lit(batches))


def train(
    rows: DataFrame,
    classes: int,
    id_column: str = "id",
    label: str = "label",
    vector: str = "vector",
    epochs: int = 30,
    batch: int = 32,
    rate: float = 0.005,
    seed: int = 42,
    fan_in: int = 32,
) -> Gates:
    """Gates for the labels 0 .. classes - 1, trained from zero weights on about ``batch`` rows a step."""
    with Scope(rows.sparkSession) as scope:
        clean = rows.select(F.col(id_column).alias("id"), F.col(label).cast("int").alias("y"), F.col(vector).cast("array<double>").alias("x"))
        clean = scope.keep(clean.where(F.col("y").isNotNull() & F.col("x").isNotNull() & ~F.exists("x", lambda v: v.isNull())))
        n, width, least, most, narrow = clean.agg(F.count(F.lit(1)), F.max(F.size("x")), F.min("y"), F.max("y"), F.min(F.size("x"))).first()
        if not n:
            raise ValueError("there are no rows to train on")
        if least < 0 or most >= classes or narrow != width:
            raise ValueError(f"labels are from 0 to {classes - 1} and vectors of one length")
        weights, bias = np.zeros((classes, width)), np.zeros(classes)
        size = classes * (width + 1)
        adam = Adam(rate, np.zeros(size), np.zeros(size))
        batches = max(1, round(n / batch))
        out = Gates(weights, bias, [], [])
        for epoch in range(epochs):
            total = np.zeros(3)
            with Scope(rows.sparkSession) as own:
                dealt = clean.withColumn("batch", batch_of("id", seed, epoch, batches)).repartition("batch")
                found = own.keep(dealt.select("batch", "y", "x"), "batch").select("batch").distinct().collect()  # a number for each batch
                for k in sorted(r["batch"] for r in found):
                    of = rows.sparkSession.read.schema("y int, x array<double>").parquet(f"{own.paths[-1]}/batch={k}")
                    got = _sum(of, weights, bias, fan_in, batch <= SMALL)
                    total += got[-3:]
                    step = adam.step(got[:-3] / got[-1])
                    weights = weights - step[: classes * width].reshape(classes, width)
                    bias = bias - step[classes * width :]
            out.losses.append(float(total[0] / total[2]))
            out.accuracies.append(float(total[1] / total[2]))
        out.weights, out.bias = weights, bias
        return out


def _sum(rows: DataFrame, weights: np.ndarray, bias: np.ndarray, fan_in: int, small: bool) -> np.ndarray:
    def run(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for b in parts:
            if b.num_rows:
                x = b.column(1).flatten().to_numpy().reshape(b.num_rows, -1)
                own = sums(x, b.column(0).to_numpy(), weights, bias)
                total = own if total is None else total + own
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], names=["s"])

    part = rows.select("y", "x").mapInArrow(run, "s array<long>")
    if small:
        return sum(np.array(r["s"], np.int64) for r in part.collect()) * GRAIN  # of a task or two
    part = part.withColumn("part", F.spark_partition_id())
    add = F.aggregate(F.slice(F.collect_list("s"), 2, 1 << 30), F.get(F.collect_list("s"), F.lit(0)), lambda a, b: F.zip_with(a, b, lambda x, y: x + y))
    tree = part.groupBy(F.floor(F.col("part") / fan_in).alias("part")).agg(add.alias("s"))
    tree = tree.groupBy(F.floor(F.col("part") / fan_in).alias("part")).agg(add.alias("s"))
    got = [np.array(r["s"], np.int64) for r in tree.collect()]  # one row for fan_in ** 2 tasks
    return sum(got) * GRAIN
