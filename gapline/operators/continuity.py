"""Continuity of every gap of a chunk, taken where the chunk's tokens are: nothing is shuffled, and no side of a gap is made twice.

A chunk's array of tokens goes to Python once and an array of numbers comes back. The window to the right of one gap is the window to the
left of a later one, so each is built once; texts are compared, or encoded, a block of gaps at a time, each distinct one of a block once. A worker
holds a block, however long the chunk is. Results are those of the expressions of :mod:`gapline.operators.gaps`.
"""

from __future__ import annotations

import itertools
import re
from collections import deque
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.config import EVENT, Config
from gapline.functions import sequence
from gapline.functions.lists import cuts, firsts_of, kinds_of, lists_of, sizes_of
from gapline.operators import encoders, gaps

#: gaps that are compared at once
BLOCK = 4096
BEFORE_MARK = re.compile(r"\s+([.!?;:,])", re.ASCII)


def plain_words(tokens: Column) -> Column:
    """The tokens in lower case, null in the place of those that aren't letters and digits."""
    return F.transform(tokens, lambda t: F.when(t.rlike("^[A-Za-z0-9]+$"), F.lower(t)))


def word_side(words: list[str | None]) -> tuple[set[str], str]:
    own = set(words)
    own.discard(None)
    return own, " ".join(sorted(own))


def text_side(tokens: list[str]) -> str:
    """As :func:`gapline.functions.text.detokenize`."""
    return BEFORE_MARK.sub(r"\1", " ".join([t for t in tokens if t != EVENT])).strip(" ")


def sides(tokens: list, width: int, side: Callable) -> Iterator[tuple]:
    """What ``side`` makes of the ``width`` tokens left and right of each gap."""
    past = deque([side(tokens[:width])], maxlen=width)
    for k in range(1, len(tokens)):
        here = side(tokens[k : k + width])
        yield past[0] if k >= width else side(tokens[:k]), here
        past.append(here)


def lexical(pairs: tuple) -> np.ndarray:
    """As :func:`gapline.operators.gaps.lexical`: a ratio is computed only where it can exceed the jaccard index."""
    out = np.zeros(len(pairs))
    at, left, right = [], [], []
    for k, ((a, x), (b, y)) in enumerate(pairs):
        if a and b:
            both = len(a & b)
            out[k] = near = both / (len(a) + len(b) - both)
            if near < 0.35 * (2.0 * min(len(x), len(y)) / (len(x) + len(y))):
                at.append(k)
                left.append(x)
                right.append(y)
    some = list(dict.fromkeys(zip(left, right, strict=True)))
    known = dict(zip(some, sequence.ratios([a for a, _ in some], [b for _, b in some]), strict=True))
    for k, x, y in zip(at, left, right, strict=True):
        out[k] = max(out[k], 0.35 * known[x, y])
    return out


def encoded(model: encoders.Model) -> Callable[[tuple], np.ndarray]:
    """As :func:`gapline.operators.gaps.vector_similarity` of the texts' vectors, whose products are added in the same order."""

    def run(pairs: tuple) -> np.ndarray:
        place = {t: k for k, t in enumerate(dict.fromkeys(itertools.chain.from_iterable(pairs)))}
        texts = list(place)
        own = encoders.encoder_of(model)
        made = [np.asarray(own.encode(texts[k : k + encoders.ROWS]), np.float32) for k in range(0, len(texts), encoders.ROWS)]
        v = np.concatenate(made).astype(np.float64)
        v[[k for k, t in enumerate(texts) if not t]] = 0.0
        a, b = (v[[place[p[x]] for p in pairs]] for x in (0, 1))

        def dot(x: np.ndarray, y: np.ndarray) -> np.ndarray:
            out = np.zeros(len(x))
            for k in range(x.shape[1]):
                out += x[:, k] * y[:, k]
            return out

        own_size = np.sqrt(dot(v, v))
        size = own_size[[place[p[0]] for p in pairs]] * own_size[[place[p[1]] for p in pairs]]
        with np.errstate(divide="ignore", invalid="ignore"):
            return np.where(size <= 0, 0.0, np.fmax(0.0, np.fmin(1.0, (dot(a, b) / size + 1.0) / 2.0)))

    return run


def of_chunks(width: int, side: Callable, value: Callable[[tuple], np.ndarray]) -> Callable[[Column], Column]:
    """A number for each token of an array but the first: ``value`` of the sides of the gap before it."""

    @F.arrow_udf("array<double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            n = column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
            ends = np.concatenate([[0], np.cumsum(n)])
            tokens = column.flatten().to_numpy(zero_copy_only=False).tolist()
            pairs = itertools.chain.from_iterable(sides(tokens[a:z], width, side) for a, z in itertools.pairwise(ends.tolist()))
            found = [value(x) for x in itertools.batched(pairs, BLOCK)]
            first = np.zeros(len(tokens), bool)
            first[ends[:-1][n > 0]] = True
            out = np.zeros(len(tokens))
            out[~first] = np.concatenate([np.zeros(0), *found])
            yield pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(out, mask=first))

    return run


#: tokens that :func:`overlaps` counts at once
TOKENS = 20_000
PLAIN = re.compile("[A-Za-z0-9]+")


def jaccards(ids: np.ndarray, sizes: np.ndarray, width: int) -> np.ndarray:
    """The jaccard index of the distinct ids left and right of each token, for lists of ``sizes`` ids that lie one after another; negative ids don't count.
    An id is counted where it comes first in a window: where its place before lies outside."""
    n = len(ids)
    owner, nowhere, never = np.repeat(np.arange(len(sizes)), sizes), -n - 2 * width, n + 2 * width
    order = np.lexsort((ids, owner))
    again = (np.diff(ids[order]) == 0) & (np.diff(owner[order]) == 0)
    before = np.full(n, nowhere)
    before[order[1:][again]] = order[:-1][again]
    before[ids < 0] = never
    at = np.arange(n)
    begin = (np.cumsum(sizes) - sizes)[owner]
    end = begin + sizes[owner]
    wide = np.concatenate([np.full(width, never), before, np.full(width, never)])
    left, right, either = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for o in range(1, width + 1):
        left += (at - o >= begin) & (wide[width - o : width - o + n] < at - width)
    for o in range(width):
        place, there = wide[width + o : width + o + n], at + o < end
        right += there & (place < at)
        either += there & (place < at - width)
    either += left
    return np.where((left == 0) | (right == 0), 0.0, (left + right - either) / np.maximum(either, 1))


def overlaps(width: int) -> Callable[[Column], Column]:
    """As :func:`gapline.operators.gaps.jaccard` of the plain words of both sides, for each token of an array but the first."""

    @F.arrow_udf("array<double>")
    def run(columns: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in columns:
            made = []
            for a, z in cuts(sizes_of(column), TOKENS):
                tokens = column.slice(a, z - a)
                sizes, (kinds, own) = sizes_of(tokens), kinds_of(tokens.flatten())
                words: dict[str, int] = {}
                ids = np.array([words.setdefault(k.lower(), len(words)) if PLAIN.fullmatch(k) else -1 for k in kinds], np.int64)
                made.append(lists_of(pa.array(jaccards(ids[own], sizes, width), mask=firsts_of(sizes)), sizes))
            yield pa.concat_arrays(made)

    return run


def with_overlap(chunked: DataFrame, config: Config) -> DataFrame:
    """``chunked`` with s_, the jaccard index before each token: for chunks that go through Python anyway, since no window then gathers sets of words.
    Before windows the chunks are dealt again."""
    return chunked.withColumn("s_", overlaps(config.context_width)(F.col("tokens")))


def with_continuity(chunked: DataFrame, config: Config) -> DataFrame:
    """``chunked`` (see :func:`gapline.operators.gaps.chunks`) with s_, the continuity before each token; without it for jaccard, which
    windows give as well."""
    if config.continuity == "jaccard":
        return chunked
    model = None if config.continuity == "lexical" else encoders.find_or_warn(chunked.sparkSession, config.continuity)
    if model is None:
        s = of_chunks(config.context_width, word_side, lexical)(plain_words(F.col("tokens")))
    else:
        s = of_chunks(config.context_width, text_side, encoded(model))(F.col("tokens"))
    # plans lose track of partitions where Python runs; without a number of them, those of the windows would be joined by their bytes
    return gaps.dealt(chunked.withColumn("s_", s))
