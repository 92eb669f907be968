"""Language identification with a blended-spectrum string kernel.

A text is lower-cased (ASCII), digits and punctuation become blanks, and its set of byte n-grams (n = 1 .. ``max_n``) is kept as
presence in ``width`` hashed places. The kernel of two texts is the cosine of their presence vectors. ``landmarks`` texts of the
sample give a Nyström map; one-versus-rest ridge regression on it gives a score for each language. Batches of documents are scored
by two matrix products (presence by landmarks, kernels by weights).

Training uses about ``fit_rows`` labelled rows, twice as many at most, spread evenly over the labels; only their presence bits (width / 8
bytes each) reach the driver. The draw is a hash of id and text, and a label's rows are taken in the order of it, so the same rows are
drawn however the table is split, and rows with one id, or none, are told apart by their texts; rows that agree in both give the same
bits, whichever is taken. Every label takes part with a row and a landmark at least; more labels than ``fit_rows`` / 2 are an error, and
nothing else is.

Null text, or text without a letter, is ``und`` with score 0; with no labelled rows, or none at all, all are ``und``, and an empty table
gives an empty result. Texts of any length are read whole. Rows with the same or a null id are scored on their own; ``lang`` is null-safe
and only used for training. :func:`identify` reads id and text only; :func:`tag` keeps all columns and replaces those named as its own.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapline.llm.shared import lean
from gapline.llm.textbytes import as_bytes

UND = "und"
ROWS = 256
_CLASS = np.arange(256, dtype=np.uint8)
_CLASS[65:91] += 32
_CLASS[[c for c in range(128) if not chr(c).isalpha()]] = 32


def presence(text: bytes, max_n: int, width: int) -> np.ndarray:
    """Boolean vector of the hashed n-grams that occur; runs of blanks count as one."""
    t = _CLASS[np.frombuffer(b" " + text + b" ", np.uint8)]
    t = t[np.append(True, (t[1:] != 32) | (t[:-1] != 32))].astype(np.uint32)
    out = np.zeros(width, bool)
    code = np.zeros(len(t), np.uint32)
    for n in range(1, max_n + 1):
        if len(t) < n:
            break
        code = code[: len(t) - n + 1] * np.uint32(257) + t[n - 1 :]
        out[((code * np.uint32(2654435761)) ^ np.uint32(n * 0x9E3779B1 & 0xFFFFFFFF)) % np.uint32(width)] = True
    return out


def has_letter(text: bytes) -> bool:
    if (_CLASS[np.frombuffer(text, np.uint8)] != 32).any():
        return any(c.isalpha() for c in text.decode("utf-8", "replace")) if not _ascii_letter(text) else True
    return False


def _ascii_letter(text: bytes) -> bool:
    t = np.frombuffer(text, np.uint8) | 32
    return bool(((t >= 97) & (t <= 122)).any())


@dataclass(frozen=True)
class LanguageModel:
    labels: list[str]
    marks: np.ndarray  # width x landmarks, columns of unit length
    weights: np.ndarray  # landmarks x labels
    max_n: int
    width: int

    def score(self, texts: list[bytes]) -> tuple[list[str], list[float]]:
        langs, scores = [UND] * len(texts), [0.0] * len(texts)
        if not self.labels:
            return langs, scores
        some = [k for k, t in enumerate(texts) if t and has_letter(t)]
        for a in range(0, len(some), ROWS):
            part = some[a : a + ROWS]
            x = np.empty((len(part), self.width), np.float32)
            for r, k in enumerate(part):
                x[r] = presence(texts[k], self.max_n, self.width)
            x /= np.sqrt(x.sum(1, keepdims=True))
            s = (x @ self.marks) @ self.weights
            best = s.argmax(1)
            for r, k in enumerate(part):
                langs[k], scores[k] = self.labels[best[r]], float(min(1.0, max(0.0, s[r, best[r]])))
        return langs, scores


def fit(
    docs: DataFrame,
    usable: Column,
    fit_rows: int = 2400,
    landmarks: int = 128,
    max_n: int = 4,
    width: int = 1 << 14,
    ridge: float = 1e-2,
) -> LanguageModel:
    """Learns from rows (doc_id, text, lang) with ``usable``, non-null lang and text."""
    rows = docs.where(
        usable & F.col("lang").isNotNull() & F.col("text").isNotNull() & (F.col("lang") != UND)
    ).select(F.col("doc_id").cast("string").alias("k"), "lang", "text")
    draw = F.pmod(F.xxhash64("k", "text", F.lit(7)), F.lit(1 << 52)) / F.lit(float(1 << 52))
    per = rows.groupBy("lang").agg(
        F.count("*").alias("n"),
        F.min(draw).alias("least"),
    ).orderBy(F.desc("n"), "lang").limit(fit_rows // 2 + 1).collect()
    if not per:
        return LanguageModel([], np.zeros((width, 0), np.float32), np.zeros((0, 0), np.float32), max_n, width)
    if len(per) > fit_rows // 2:
        raise ValueError(f"more than {fit_rows // 2} labels: fit_rows = {fit_rows} can't hold them all")
    each = fit_rows // len(per)
    below = [(r["lang"], max(min(1.0, 1.2 * each / r["n"]), r["least"])) for r in per]  # the row of the least draw is always in
    below = F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below double"))
    picked = rows.withColumn("draw", draw).join(below, "lang").where("draw <= below")
    # many rows may agree in id and text; each task keeps the first of a label before they are dealt (window group limit)
    picked = picked.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy("draw", F.xxhash64("text")))).where(
        F.col("rank") <= 2 * each
    )
    picked = picked.select("lang", "text", F.xxhash64("k", "text", F.lit(8)).alias("o"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    b.column(2),
                    pa.array([np.packbits(presence(t, max_n, width)).tobytes() for t in as_bytes(b.column(1))], pa.binary()),
                ],
                names=["lang", "o", "bits"],
            )

    got = sorted(
        picked.mapInArrow(lean(bits), "lang string, o long, bits binary").collect(),
        key=lambda r: (r["o"], r["lang"], r["bits"]),
    )
    labels = sorted({r["lang"] for r in got})
    x = np.array([np.unpackbits(np.frombuffer(r["bits"], np.uint8)) for r in got], np.float32)
    x /= np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
    turn: dict[str, int] = {}
    order = []
    for k, r in enumerate(got):  # landmarks: the labels in turn
        turn[r["lang"]] = turn.get(r["lang"], 0) + 1
        order.append((turn[r["lang"]], k))
    marks = x[[k for _, k in sorted(order)[: max(landmarks, len(labels))]]].T.copy()
    values, vectors = np.linalg.eigh((marks.T @ marks).astype(np.float64))
    keep = values > 1e-6 * values.max()
    root = vectors[:, keep] / np.sqrt(values[keep])
    phi = (x @ marks).astype(np.float64) @ root
    y = np.array([[float(r["lang"] == c) for c in labels] for r in got])
    w = np.linalg.solve(phi.T @ phi + ridge * len(got) / 100 * np.eye(phi.shape[1]), phi.T @ y)
    return LanguageModel(labels, np.ascontiguousarray(marks), (root @ w).astype(np.float32), max_n, width)


def identify(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """doc_id, lang_pred, score for each row; reads nothing but the text (and carries the id)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # width x landmarks floats: bounded by the parameters

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            langs, scores = m.score(as_bytes(b.column(1)))
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=["doc_id", "lang_pred", "score"],
            )

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def tag(docs: DataFrame, model: LanguageModel) -> DataFrame:
    """``docs`` (text and others) with lang_pred and score; columns of these names are replaced."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    docs = docs.drop("lang_pred", "score")
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = shared.value.score(as_bytes(b.column(at)))
            yield pa.RecordBatch.from_arrays(
                [*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())],
                names=[*b.schema.names, "lang_pred", "score"],
            )

    return docs.mapInArrow(
        lean(run),
        T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]),
    )


def with_letter(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` (text and others) with a letter in the text."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array([bool(t) and has_letter(t) for t in as_bytes(b.column(at))], pa.bool_()))

    return docs.mapInArrow(lean(run), docs.schema)


def not_held_out() -> Column:
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4, F.lit(0)) != 2
