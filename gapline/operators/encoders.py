"""Continuity of the two sides of a gap by vectors of their texts.

A model is named in ``Config.continuity``: the path of a model file, or the name of a sentence encoder, if the package for these is installed.
It is loaded once on the driver, to see that it can be; if it can't, a warning is given and the lexical continuity takes its place, as in a
run without any model. Each Python worker then loads it once, however many batches and tasks it gets.

Most sides occur twice (the left side of one gap is the right side of another), and copied texts share all of theirs. So sides are
told apart by a 128-bit hash, each distinct text is encoded once, and vectors are joined back by hash. A text that very many gaps share is a
skewed key of an inner join, which adaptive execution splits.

Model files are JSON with a ``kind``. ``hashed-projection`` adds a vector of -1 and 1 for each word, drawn by hash: the cosine of two texts estimates
how many words they share. Other kinds are added with :func:`register`.
"""

from __future__ import annotations

import hashlib
import importlib.util
import itertools
import json
import os
import re
import warnings
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.functions import text as T

#: a model file has at most so many bytes: it goes through the driver to each worker
MODEL_BYTES = 64 << 20
#: texts encoded at once
ROWS = 512
WORD = re.compile(r"[a-z0-9]+(?:['’][a-z0-9]+)?")


class Encoder(Protocol):
    def encode(self, texts: list[str]) -> np.ndarray:
        """A row of floats for each text."""


class NoEncoder(LookupError):
    """The model can't be loaded."""


class HashedProjection:
    """The sum of the words' vectors; a word's k-th place is 1 if the k-th digit of its hash is at least 8, else -1."""

    def __init__(self, dimensions: int, seed: str = ""):
        self.dimensions, self.seed = int(dimensions), str(seed)
        if not 0 < self.dimensions <= 4096:
            raise ValueError("dimensions are from 1 to 4096")
        self.of_word = lru_cache(maxsize=1 << 16)(self._of_word)

    def _of_word(self, word: str) -> np.ndarray:
        parts = range(-(-self.dimensions // 32))
        digits = "".join(hashlib.md5(f"{self.seed}:{k}:{word}".encode(), usedforsecurity=False).hexdigest() for k in parts)
        return np.array([1 if c >= "8" else -1 for c in digits[: self.dimensions]], np.float32)

    def encode(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimensions), np.float32)
        each = [WORD.findall(t.lower()) for t in texts]
        place = {w: k for k, w in enumerate(dict.fromkeys(itertools.chain.from_iterable(each)))}
        if place:
            vectors = np.array([self.of_word(w) for w in place], np.float32)
            n = np.array(list(map(len, each)))
            words = vectors[[place[w] for w in itertools.chain.from_iterable(each)]]
            out[n > 0] = np.add.reduceat(words, (np.cumsum(n) - n)[n > 0])
        return out


KINDS: dict[str, Callable[..., Encoder]] = {"hashed-projection": HashedProjection}


def register(kind: str, make: Callable[..., Encoder]) -> None:
    """``make`` gets a model file's other entries by name."""
    KINDS[kind] = make


@dataclass(frozen=True)
class Model:
    """What a worker needs to load a model: a file's contents, or a name."""

    name: str
    contents: str | None = None

    def load(self) -> Encoder:
        if self.contents is None:
            from sentence_transformers import SentenceTransformer

            return SentenceTransformer(self.name)
        entries = json.loads(self.contents)
        return KINDS[entries.pop("kind")](**entries)


_loaded: dict[Model, Encoder] = {}


def encoder_of(model: Model) -> Encoder:
    """The model, loaded once for each worker; one is held at a time."""
    if model not in _loaded:
        _loaded.clear()
        _loaded[model] = model.load()
    return _loaded[model]


def _file(spark: SparkSession, path: str) -> str:
    if os.path.exists(path):
        if os.path.getsize(path) > MODEL_BYTES:
            raise NoEncoder(f"{path} is larger than {MODEL_BYTES} bytes")
        with open(path, encoding="utf-8") as f:
            return f.read()
    found = spark.read.format("binaryFile").load(path)
    if (found.agg(F.sum("length")).first()[0] or 0) > MODEL_BYTES:
        raise NoEncoder(f"{path} is larger than {MODEL_BYTES} bytes")
    return bytes(found.select("content").first()[0]).decode()


def find(spark: SparkSession, name: str) -> Model:
    """The model of that name; ``NoEncoder`` if there is none that can be loaded."""
    try:
        if name.endswith(".json"):
            model = Model(name, _file(spark, name))
        elif importlib.util.find_spec("sentence_transformers") is None:
            raise NoEncoder("the package for sentence encoders isn't installed")
        else:
            model = Model(name)
        encoder_of(model)
        return model
    except Exception as e:
        raise NoEncoder(f"could not load the model {name!r}: {e}") from e


def find_or_warn(spark: SparkSession, name: str) -> Model | None:
    """The model of that name, or a warning and none: lexical continuity takes its place."""
    try:
        return find(spark, name)
    except NoEncoder as e:
        warnings.warn(f"{e}; lexical continuity is used", stacklevel=2)
        return None


def vectors(texts: DataFrame, model: Model) -> DataFrame:
    """key and vector of each distinct key of ``texts`` (key, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder_of(model)
        for b in batches:
            for a in range(0, b.num_rows, ROWS):
                part = b.slice(a, ROWS)
                made = np.asarray(own.encode(part.column(1).to_pylist()), np.float32)
                flat = pa.FixedSizeListArray.from_arrays(pa.array(made.ravel()), made.shape[1]).cast(pa.list_(pa.float32()))
                yield pa.RecordBatch.from_arrays([part.column(0), flat], names=["key", "vector"])

    once = texts.groupBy("key").agg(F.min("text").alias("text"))
    return once.mapInArrow(run, "key binary, vector array<float>")


def with_vectors(sides: DataFrame, model: Model) -> DataFrame:
    """Adds l_vector and r_vector to rows with the sides' tokens (l_tokens, r_tokens); a blank side has none."""
    rows = sides
    for x in "lr":
        text = T.detokenize(F.col(f"{x}_tokens"))
        rows = rows.withColumn(f"{x}_text", text).withColumn(f"{x}_key", F.unhex(F.md5(f"{x}_text")))
    both = rows.select(F.explode(F.array(*(F.struct(F.col(f"{x}_key").alias("key"), F.col(f"{x}_text").alias("text")) for x in "lr"))).alias("s"))
    found = vectors(both.select("s.*"), model)
    for x in "lr":
        rows = rows.join(found.select(F.col("key").alias(f"{x}_key"), F.col("vector").alias(f"{x}_vector")), f"{x}_key")
    blank = {f"{x}_vector": F.when(F.trim(f"{x}_text") != "", F.col(f"{x}_vector")) for x in "lr"}
    return rows.withColumns(blank).drop("l_text", "r_text", "l_key", "r_key")
