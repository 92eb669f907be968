"""The Ratcliff-Obershelp ratio of many pairs of texts at once.

The ratio is 2 * matched / (both lengths), where the longest common block (the earliest in the left text, then in the right one) is matched
first and what is left of it and right of it is matched the same way. Which cells of the table left x right agree is one number for a
pair, a bit for a cell; a block of k characters is k bits on a diagonal, so the table and itself a diagonal step on has the starts of
blocks of two, and doubling finds the longest block in a few operations on whole tables. The rows are looked up with numpy for all pairs of
a batch together. Texts are ASCII of at most 127 characters on the right and ``LEFT`` on the left; others are left to the standard
library's matcher, which is also the definition: results are equal to it, bit for bit.
"""

from __future__ import annotations

from difflib import SequenceMatcher

import numpy as np

#: rows of tables, of the longest text on the left
LEFT = 256
#: pairs whose tables are made at once
BLOCK = 2048


class Tables:
    """Tables whose rows have ``2 ** bits`` places, for right texts with fewer characters."""

    def __init__(self, bits: int):
        self.bits, self.stride = bits, 1 << bits
        each = sum(1 << (self.stride * r) for r in range(LEFT))
        #: columns before, and from, a place, in all rows; rows before a place
        self.before = [((1 << j) - 1) * each for j in range(self.stride)]
        self.since = [(((1 << self.stride) - 1) ^ ((1 << j) - 1)) * each for j in range(self.stride + 1)]
        self.rows = [(1 << (self.stride * r)) - 1 for r in range(LEFT + 1)]

    def matched(self, table: int) -> int:
        """Characters matched in a table of agreeing cells."""
        bits, last, diagonal = self.bits, self.stride - 1, self.stride + 1
        before, since, rows = self.before, self.since, self.rows
        total = 0
        todo = [table] if table else []
        while todo:
            x = todo.pop()
            z = x & (x >> diagonal)
            if not z:  # single characters only: the first row that has one takes its first; nothing is left of it
                while x:
                    low = (x & -x).bit_length() - 1
                    total += 1
                    x = (x >> ((low | last) + 1)) & since[(low & last) + 1]
                continue
            w = z & (z >> diagonal)  # blocks of three
            if not w:
                k = 2
            else:
                z, k, powers = w, 3, [(1, x), (2, z), (3, w)]
                while w := z & (z >> diagonal * k):
                    z = w
                    k *= 2
                    powers.append((k, w))
                for size, y in reversed(powers):
                    if size < powers[-1][0] and (w := z & (y >> diagonal * k)):
                        z = w
                        k += size
            low = (z & -z).bit_length() - 1
            i, j = low >> bits, low & last
            total += k
            if i and j and (w := x & rows[i] & before[j]):
                todo.append(w)
            if w := (x >> ((i + k) << bits)) & since[j + k]:
                todo.append(w)
        return total

    def make(self, left: list[bytes], right: list[bytes]) -> list[int]:
        """The table of agreeing cells of each pair."""
        n, width = len(left), max(1, *map(len, left))
        a = np.frombuffer(b"".join([x.ljust(width, b"\0") for x in left]), np.uint8).reshape(n, width)
        b = np.frombuffer(b"".join([x.ljust(self.stride, b"\1") for x in right]), np.uint8).reshape(n, self.stride)
        used = (np.bincount(a.ravel(), minlength=256) > 0) & (np.bincount(b.ravel(), minlength=256) > 0)
        place = np.where(used, np.cumsum(used), 0).astype(np.uint8)  # the fillers and what one side lacks agree with nothing
        cells = np.zeros((n, int(used.sum()) + 1, self.stride), bool)
        cells[np.arange(n)[:, None], place[b], np.arange(self.stride)] = True
        cells[:, 0] = False
        rows = np.packbits(cells, axis=2, bitorder="little")[np.arange(n)[:, None], place[a]]
        raw, size = rows.tobytes(), width * self.stride // 8
        return [int.from_bytes(raw[k * size : (k + 1) * size], "little") for k in range(n)]


KINDS = [Tables(6), Tables(7)]


def ratios(left: list[str], right: list[str]) -> list[float]:
    """The ratio of each pair, as ``SequenceMatcher(None, left, right).ratio()`` gives it."""
    out = [0.0] * len(left)
    fast: list[list[int]] = [[] for _ in KINDS]
    for k, (a, b) in enumerate(zip(left, right, strict=True)):
        kind = next((x for x, t in enumerate(KINDS) if len(b) < t.stride), None)
        if kind is not None and len(a) <= LEFT and a.isascii() and b.isascii() and min(a, default="a") > "\1" and min(b, default="a") > "\1":
            fast[kind].append(k)
        else:
            out[k] = SequenceMatcher(None, a, b).ratio()
    for kind, ks in zip(KINDS, fast, strict=True):
        ks.sort(key=lambda k: len(left[k]))  # tables of a block are as high as its longest text
        for z in range(0, len(ks), BLOCK):
            some = ks[z : z + BLOCK]
            made = kind.make([left[k].encode() for k in some], [right[k].encode() for k in some])
            for k, table in zip(some, made, strict=True):
                both = len(left[k]) + len(right[k])
                out[k] = 2.0 * kind.matched(table) / both if both else 1.0
    return out
