"""Periodic runs of words, found by block matching.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and at least max(``least``, ``repeats`` * q)
words that no neighbouring word extends. A run of period q with B <= q < 2B (B a power of two; the smallest B, 8, serves all q < 16)
holds a whole block of B words at a multiple of B, and the same words again q later, since it has at least 2B - 1 words besides its last
period. So for each scale B the document's aligned blocks are the keys of an automaton over sequences of word numbers, the document is
searched with it, and each occurrence at a distance that belongs to the scale is extended to both sides as far as words q apart agree.
What is long enough, and has no period that divides q, is a run. No hash decides: word numbers are given by a dictionary.

The automaton is built for ``WINDOW`` words of blocks at a time (or one block, if that is longer), since a block needs to be found again only within
three times its length. Blocks all of whose reach lies in a known run of a period up to B can only find that run again and are left out, so
that a document of one repeated word costs a few extensions. Documents in which no sequence of eight words occurs twice have no run and
aren't searched.

A document is the unit of work; memory is proportional to its words (12 bytes or so for each) and to its distinct words; its text is split in parts of
``PART`` bytes. Null text has no words. Rows are judged on their own, so null or repeated ids are fine; an empty table gives an
empty result; other columns aren't read.
"""

from __future__ import annotations

from array import array
from bisect import bisect_right
from collections.abc import Iterator
from itertools import compress

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import lean
from gapline.llm.textbytes import as_bytes

SMALLEST = 8
WINDOW = 4096
PART = 1 << 20
BLANK = b" \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"
Run = tuple[int, int, int]


def parts(text: bytes) -> Iterator[list[bytes]]:
    """The words of a text, a part at a time; parts end at blanks."""
    a = 0
    while a < len(text):
        z = min(len(text), a + PART)
        while z < len(text) and text[z] not in BLANK:
            z += 1
        yield text[a:z].split()
        a = z


def numbers(text: bytes) -> np.ndarray:
    """A number for each word; equal words have equal numbers."""
    known: dict[bytes, int] = {}
    out = array("i")
    for words in parts(text):
        out.extend([known.setdefault(w, len(known)) for w in words])
    return np.frombuffer(out, np.int32) if len(out) else np.zeros(0, np.int32)


def repeats_any(ids: np.ndarray, size: int) -> bool:
    """False only if no sequence of ``size`` words occurs twice."""
    odd = np.uint64(0x9E3779B97F4A7C15)
    x = ids.astype(np.uint64) * odd
    x ^= x >> np.uint64(29)
    n = len(x) - size + 1
    h = x[:n].copy()
    for k in range(1, size):
        h *= odd
        h += x[k : k + n]
    h.sort()
    return bool((h[1:] == h[:-1]).any())


def stretch(ids: np.ndarray, p: int, q: int) -> tuple[int, int]:
    """The longest [a, z) around p in which words q apart agree; the words at p and p + q do."""
    z, step = p + 1, 64
    while True:
        stop = min(len(ids) - q, z + step)
        differ = np.flatnonzero(ids[z:stop] != ids[z + q : stop + q])
        if len(differ):
            z += int(differ[0])
            break
        z, step = max(z, stop), step * 4
        if z >= len(ids) - q:
            break
    a, step = p, 64
    while a:
        start = max(0, a - step)
        differ = np.flatnonzero(ids[start:a] != ids[start + q : a + q])
        if len(differ):
            a = start + int(differ[-1]) + 1
            break
        a, step = start, step * 4
    return a, z + q


def primes_of(q: int) -> list[int]:
    out, d = [], 2
    while d * d <= q:
        if q % d == 0:
            out.append(d)
            while q % d == 0:
                q //= d
        d += 1
    return [*out, q] if q > 1 else out


def occurrences(ids: np.ndarray, block: int, blocks: list[int], end: int) -> tuple[np.ndarray, np.ndarray]:
    """Places from the first of ``blocks`` (first words of blocks of ``block`` words) up to ``end`` where one of them occurs, and for each place
    the first block with these words. A block is found at its own place too."""
    first = blocks[0]
    words = tuple(ids[first:end].tolist())
    keys = ahocorasick.Automaton(ahocorasick.STORE_INTS, ahocorasick.KEY_SEQUENCE)
    for p in reversed(blocks):  # of equal blocks the first stays
        keys.add_word(words[p - first : p - first + block], p)
    keys.make_automaton()
    found = np.array(list(keys.iter(words)), np.int64)
    return found[:, 0] + first - block + 1, found[:, 1]


def seeds(at: np.ndarray, key: np.ndarray, first: int, block: int, low: int) -> list[tuple[int, int]]:
    """(p, q): the block at p occurs again q words later, low <= q < 2 * block."""
    own = np.full((int(at[-1]) - first) // block + 1, -1, np.int64)
    aligned = at % block == 0
    own[(at[aligned] - first) // block] = key[aligned]
    out = []
    p = (at - low) // block * block
    while True:
        ok = np.flatnonzero((p >= first) & (at - p < 2 * block))
        if not len(ok):
            return out
        ok = ok[own[(p[ok] - first) // block] == key[ok]]
        out += zip(p[ok].tolist(), (at[ok] - p[ok]).tolist(), strict=True)
        p = p - block


def find_runs(ids: np.ndarray, least: int = 24, repeats: int = 3) -> list[Run]:
    """(start, length, period) of all runs, by start and period. ``least`` is at least 3 * SMALLEST, ``repeats`` at least 3."""
    if least < 3 * SMALLEST or repeats < 3:
        raise ValueError(f"least is at least {3 * SMALLEST}, repeats at least 3")
    n = len(ids)
    if n < least or not repeats_any(ids, SMALLEST):
        return []
    runs: set[Run] = set()  # start, end, period
    block = SMALLEST
    while block == SMALLEST or block * repeats <= n:
        low = 1 if block == SMALLEST else block
        last: dict[int, tuple[int, int]] = {}
        window = max(block, WINDOW)
        for w in range(0, n - block - low + 1, window):
            begins = sorted((a, z) for a, z, q in runs if q <= block)
            far = np.maximum.accumulate([z for _, z in begins]).tolist() if begins else []
            some = []
            for p in range(w, min(w + window, n - block - low + 1), block):
                k = bisect_right(begins, (p, n)) if begins else 0
                if not k or far[k - 1] < min(n, p + 3 * block):  # else all that it can find is in a known run
                    some.append(p)
            if not some:
                continue
            at, key = occurrences(ids, block, some, min(n, some[-1] + 3 * block))
            for p, q in seeds(at, key, some[0], block, low):
                a, z = last.get(q, (0, 0))
                if a <= p and p + q + block <= z:
                    continue
                a, z = last[q] = stretch(ids, p, q)
                if z - a < max(least, repeats * q) or (a, z, q) in runs:
                    continue
                if not any((ids[a : z - q // r] == ids[a + q // r : z]).all() for r in primes_of(q)):
                    runs.add((a, z, q))
        block *= 2
    return sorted(((a, z - a, q) for a, z, q in runs), key=lambda r: (r[0], r[2]))


def collapse(text: bytes, n: int, runs: list[Run]) -> bytes:
    """The words joined by a space, without those that a run has after its first period."""
    drop = np.zeros(n + 1, np.int32)
    for a, length, q in runs:
        drop[a + q] += 1
        drop[a + length] -= 1
    keep = (np.cumsum(drop[:-1]) == 0).tolist() if runs else None
    out, k = [], 0
    for words in parts(text):
        out.append(b" ".join(compress(words, keep[k : k + len(words)]) if keep else words))
        k += len(words)
    return b" ".join(x for x in out if x)


def collapse_runs(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", least: int = 24, repeats: int = 3) -> DataFrame:
    """For each row its id (``doc_id``), ``n_words``, its ``runs`` in words, and the text with each run ``collapsed`` to its first period."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            counts, ends, found, texts = [], [0], [], []
            for t in as_bytes(b.column(1)):
                ids = numbers(t)
                runs = find_runs(ids, least, repeats)
                counts.append(len(ids))
                found += runs
                ends.append(len(found))
                texts.append(collapse(t, len(ids), runs))
            each = pa.StructArray.from_arrays(
                [pa.array([r[k] for r in found], pa.int64()) for k in range(3)],
                names=["start", "length", "period"],
            )
            yield pa.RecordBatch.from_arrays(
                [
                    b.column(0),
                    pa.array(counts, pa.int64()),
                    pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each),
                    pa.array(texts, pa.binary()).cast(pa.string()),
                ],
                names=["doc_id", "n_words", "runs", "collapsed"],
            )

    return docs.select(F.col(id_column).cast("long").alias("doc_id"), F.col(text_column).alias("text")).mapInArrow(lean(run), SCHEMA)


def strongest(runs: Column) -> Column:
    """The run with the greatest length / period, compared exactly; of equals the first."""
    none = F.lit(None).cast("struct<start: long, length: long, period: long>")
    return F.aggregate(
        runs,
        none,
        lambda best, r: F.when(best.isNull() | (r.length * best.period > best.length * r.period), r).otherwise(best),
    )
