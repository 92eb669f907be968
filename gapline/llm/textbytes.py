"""Words of whole texts as byte spans with 64-bit hashes, computed for a block of documents at once with numpy.

Texts are handled as UTF-8. A class of word bytes given as a 256-entry table decides words bytewise; this is exact for
classes that hold all or none of the non-ASCII characters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

U = np.uint64
BASE = 0x9E3779B97F4A7C15  # odd, so that it has an inverse modulo 2**64
#: bytes whose hashes are computed at once: what a worker needs beside a text doesn't grow with the text
SEGMENT = 1 << 19
_powers: dict[str, np.ndarray] = {"up": np.ones(1, U), "down": np.ones(1, U)}


def mix(x: np.ndarray) -> np.ndarray:
    """A fixed 64-bit finaliser; a bijection."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


#: a random-looking value for each byte; letters A-Z count as a-z
_FOLD = np.arange(256)
_FOLD[65:91] += 32
BYTE_VALUE = mix((np.arange(256, dtype=U) + U(1)) * U(BASE))
LOWER_VALUE = BYTE_VALUE[_FOLD]

#: word bytes: all but the ASCII blanks 0x20 and 0x09-0x0D
NOT_BLANK = np.ones(256, bool)
NOT_BLANK[[0x20, 9, 10, 11, 12, 13]] = False
#: word bytes: digits, letters, all non-ASCII
ALNUM = np.zeros(256, bool)
ALNUM[0x30:0x3A] = ALNUM[0x41:0x5B] = ALNUM[0x61:0x7B] = True
ALNUM[0x80:] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """BASE**i and BASE**-i modulo 2**64 for i < n. Only tables of at most ``SEGMENT`` powers are kept for the next call."""
    have = len(_powers["up"])
    if have < n:
        size = max(n, min(2 * have, SEGMENT + 1))
        tables = {}
        for key, b in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            steps = np.full(size, U(b))
            steps[0] = 1
            tables[key] = np.multiply.accumulate(steps)
        if size > SEGMENT + 1:
            return tables["up"], tables["down"]
        _powers.update(tables)
    return _powers["up"][:n], _powers["down"][:n]


def as_bytes(column: pa.Array) -> list[bytes]:
    """UTF-8 of each text; null becomes empty."""
    return column.cast(pa.binary()).fill_null(b"").to_pylist()


def blocks(texts: list[bytes], most: int) -> Iterator[tuple[int, int]]:
    """Runs [i, j) of texts with at most ``most`` bytes together; a longer text is alone."""
    i, size = 0, 0
    for j, t in enumerate(texts):
        if size and size + len(t) > most:
            yield i, j
            i, size = j, 0
        size += len(t) + 1
    if i < len(texts):
        yield i, len(texts)


class Block:
    """Texts joined by a blank, with the place of each in ``buf``."""

    def __init__(self, texts: list[bytes]):
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        self.buf = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
        self.begin = np.concatenate([[0], np.cumsum(lengths + 1)[:-1]]).astype(np.int64)
        self.lengths = lengths
        self.n = len(texts)

    def words(self, table: np.ndarray) -> None:
        """Sets starts, ends (byte places) and first: the number of the first word of each text, and the total."""
        m = table[self.buf]
        if self.n > 1:
            m[self.begin[1:] - 1] = False
        m[-1] = False
        d = np.diff(m.view(np.int8), prepend=np.int8(0))
        self.starts, self.ends = np.flatnonzero(d == 1), np.flatnonzero(d == -1)
        self.first = np.append(np.searchsorted(self.starts, self.begin), len(self.starts))

    def prefix(self, values: np.ndarray) -> np.ndarray:
        up, self.down = powers(len(self.buf) + 1)
        out = np.zeros(len(self.buf) + 1, U)
        np.cumsum(values[self.buf] * up[:-1], out=out[1:])
        return out

    def word_hashes(self, values: np.ndarray = LOWER_VALUE) -> np.ndarray:
        """Hashes of the words, for runs of words of at most ``SEGMENT`` bytes at a time."""
        out = np.empty(len(self.starts), U)
        a = 0
        while a < len(out):
            s0 = int(self.starts[a])
            z = max(a + 1, int(np.searchsorted(self.ends, s0 + SEGMENT, "right")))
            e0 = int(self.ends[z - 1])
            up, down = powers(min(e0 - s0, SEGMENT) + 1)
            if e0 - s0 > SEGMENT:  # one word longer than that
                total = e0 - s0
                for k in range(s0, e0, SEGMENT):
                    part = values[self.buf[k : min(e0, k + SEGMENT)]]
                    total += int((part * up[: len(part)]).sum(dtype=U)) * pow(BASE, k - s0, 1 << 64)
                out[a:z] = mix(np.array([total & (1 << 64) - 1], U))
            else:
                p = np.zeros(e0 - s0 + 1, U)
                np.cumsum(values[self.buf[s0:e0]] * up[:-1], out=p[1:])
                s, e = self.starts[a:z] - s0, self.ends[a:z] - s0
                out[a:z] = mix((p[e] - p[s]) * down[s] + (e - s).astype(U))
            a = z
        return out


def window_hashes(h: np.ndarray, size: int) -> np.ndarray:
    """Hash of h[i : i + size] for each i that has so many; order counts."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, U)
    out = np.full(n, U(size))
    for k in range(size):
        out = out * U(0xD6E8FEB86659FD93) + h[k : k + n]
    return mix(out)
