"""Removal of repeated substrings: every byte covered by a string of ``depth`` bytes that also starts elsewhere.

The suffixes of all texts are too many to sort at once, so they are dealt into buckets and one block of buckets is sorted
at a time, blockwise:

1. Anchors. Each window of ``depth`` bytes is filed under its least ``GRAM``-byte hash (the leftmost of equals), so equal windows share
   their anchor's hash and their distance from it. An anchor serves a run of neighbouring windows. Hashes that occur at one place only
   are dropped; their windows can't repeat.
2. Contexts. For each anchor that is left, the bytes its windows cover are one context. Equal contexts are aggregated (before they are
   shuffled) to one row, which goes into its block twice if it occurs at two places.
3. Buckets. A bucket is the suffixes with one anchor hash and one distance. :class:`Cover` sorts a block of whole buckets: by bucket and
   by the first and last ``PERIOD`` bytes, and it resolves the longer ties by ranks, computed beforehand, of the suffixes at the
   positions of a difference cover. Any two suffixes meet the cover after the same less than ``PERIOD`` bytes. So memory is a few
   words for each position of the cover and each window of the block, however long the ties. Order between buckets isn't needed.
   Every repeat is found by the blocks.
4. Finer buckets. An anchor hash with more than ``most`` different contexts, counted exactly, is no block for one task. Its windows are
   filed once more under their least hash of a shorter gram beside the anchor, with its distance, as in step 1; the shorter contexts go through
   steps 2 and 3 as contexts of finer buckets. This is repeated for each of ``GRAMS``. Windows that then still share more than ``most`` contexts
   agree in the 120 bytes of their grams; they are contexts of their own, one row each with its digest, so nothing is gathered.
5. The runs of repeated windows go back to their texts.

Equal texts are one text with a count: if it is ``depth`` bytes long and occurs twice, all of it goes. Matches never cross texts. Null
text is empty; an empty table gives an empty result. Rows are judged alike whatever their other columns. A text of any length is handled in overlapping parts of
``BLOCK_BYTES``; beside those a worker holds its bytes once or twice and a few words for each of its anchors.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import discard, lean, materialise
from gapline.llm.textbytes import BASE, BYTE_VALUE, U, Block, as_bytes, blocks, mix

DEPTH = 200
GRAM = 64
#: lengths of the grams by which crowded buckets are dealt again
GRAMS = (32, 16, 8)
PERIOD = 32
BLOCK_BYTES = 1 << 19
SORT_BYTES = 3 << 19
CUT_BYTES = 2 << 20
MOST = 20_000


def difference_cover(v: int) -> np.ndarray:
    """Residues such that each difference modulo v is between two of them: 0 .. r-1 and the multiples of r."""
    r = max(1, round(v**0.5))
    return np.unique(np.concatenate([np.arange(r), np.arange(0, v, r)]))


def meeting(v: int) -> np.ndarray:
    """[a, b]: the least t for which a + t and b + t are both in the cover, modulo v."""
    has = np.zeros(v, bool)
    has[difference_cover(v)] = True
    out = np.full((v, v), -1, np.int64)
    a = np.arange(v)
    for t in range(v - 1, -1, -1):
        h = has[(a + t) % v]
        out[np.ix_(h, h)] = t
    return out


MEETING = meeting(PERIOD)


def dense(*keys: np.ndarray) -> np.ndarray:
    """Rank of each tuple of keys (not negative; the first is the most significant), equal for equals. Neighbouring keys that fit into 64 bits are sorted as one."""
    packed: list[np.ndarray] = []
    used = 65
    for k in keys:
        bits = int(k.max(initial=0)).bit_length()
        k = k.astype(U)
        if used + bits <= 64:
            packed[-1] = packed[-1] << U(bits) | k
            used += bits
        else:
            packed.append(k)
            used = bits
    keys = tuple(packed)
    order = np.argsort(keys[0]) if len(keys) == 1 else np.lexsort(keys[::-1])
    new = np.zeros(len(order), bool)
    for k in keys:
        s = k[order]
        new[1:] |= s[1:] != s[:-1]
    out = np.empty(len(order), np.int64)
    out[order] = np.cumsum(new)
    return out


class Cover:
    """Ranks of the suffixes of ``data`` at the positions of the difference cover, to the depth that windows need."""

    def __init__(self, data: bytes, depth: int):
        self.depth, v = depth, PERIOD
        self.rest = depth - v
        padded = data + b"\0" * (2 * depth + 64)
        # ranks of the first 8 and, by doubling, PERIOD bytes from each place
        self.eight = self.first = dense(np.ndarray((len(padded) - 7,), ">u8", padded, 0, (1,)))
        have = 8
        while have < v:
            self.first = dense(self.first[:-have], self.first[have:])
            have *= 2
        n = (len(data) + v - 1) // v * v
        cover = difference_cover(v)
        self.slot = np.full(v, -1, np.int64)
        self.slot[cover] = np.arange(len(cover)) * (n // v)
        # positions ordered by residue, then by place: p + v is the next slot
        p = (cover[:, None] + np.arange(0, n, v)[None, :]).ravel()
        p = np.minimum(p, len(padded) - 8 - self.rest)
        self.rank = self.prefix(p)
        at = np.arange(len(p))

        def after(ranks: np.ndarray, size: int) -> np.ndarray:
            return ranks[np.minimum(at + size // v, len(p) - 1)]

        first, have = self.rank, v
        while 2 * have <= self.rest:  # doubling
            self.rank = dense(self.rank, after(self.rank, have))
            have *= 2
        while have + v <= self.rest:
            self.rank = dense(self.rank, after(first, have))
            have += v
        if have < self.rest:  # a multiple of 8, as depth and PERIOD are
            self.rank = dense(self.rank, *(self.eight[p + q] for q in range(have, self.rest, 8)))

    def prefix(self, p: np.ndarray) -> np.ndarray:
        return self.first[p]

    def at(self, p: np.ndarray) -> np.ndarray:
        """Ranks of suffixes at cover positions."""
        return self.rank[self.slot[p % PERIOD] + p // PERIOD]

    def repeated(self, start: np.ndarray, bucket: np.ndarray) -> np.ndarray:
        """Which of the windows that begin at ``start`` equal another one of their ``bucket``."""
        out = np.zeros(len(start), bool)
        if not len(start):
            return out
        ends = self.prefix(np.concatenate([start, start + self.rest]))
        group = dense(bucket, ends[: len(start)], ends[len(start) :])
        order = np.argsort(group, kind="stable")
        while len(order):
            g = group[order]
            head = np.concatenate([[True], g[1:] != g[:-1]])
            lead = order[np.maximum.accumulate(np.where(head, np.arange(len(g)), 0))]
            t = MEETING[start[lead] % PERIOD, start[order] % PERIOD]
            same = self.at(start[lead] + t) == self.at(start[order] + t)
            other = same & ~head
            out[order[other]] = True
            out[lead[other]] = True
            order = order[~same]  # what differs from its group's leader is compared with the next one
        return out


def anchors(b: Block, depth: int) -> tuple[np.ndarray, ...]:
    """(text, hash, place in its text, first window, last window) of each anchor of each text, with windows as places too."""
    width = depth - GRAM + 1
    p = b.prefix(BYTE_VALUE)
    n = len(b.buf) - GRAM + 1
    none = tuple(np.zeros(0, np.int64) for _ in range(5))
    if n < width:
        return none
    h = mix((p[GRAM : GRAM + n] - p[:n]) * b.down[:n])
    bits = U(max(1, int(len(b.buf)).bit_length()))
    m = -(-n // width) * width
    x = np.full(m, ~U(0))
    x[:n] = (h >> bits << bits) | np.arange(n, dtype=U)
    up = np.minimum.accumulate(x.reshape(-1, width), axis=1).ravel()
    down = np.minimum.accumulate(x[::-1].copy().reshape(-1, width), axis=1).ravel()[::-1]
    a = np.minimum(down[: n - width + 1], up[width - 1 : n]) & ((U(1) << bits) - U(1))
    new = np.ones(len(a), bool)
    new[1:] = a[1:] != a[:-1]
    new[b.begin[b.begin < len(a)]] = True
    s0 = np.flatnonzero(new)
    s1 = np.append(s0[1:], len(a)) - 1
    t = np.searchsorted(b.begin, s0, "right") - 1
    last = b.begin[t] + b.lengths[t] - depth
    ok = s0 <= last
    t, s0, s1 = t[ok], s0[ok], np.minimum(s1, last)[ok]
    a = a[s0].astype(np.int64)
    return t, h[a].view(np.int64), a - b.begin[t], s0 - b.begin[t], s1 - b.begin[t]


def pieces(texts: list[bytes], depth: int) -> Iterator[tuple[list[bytes], np.ndarray, np.ndarray]]:
    """Blocks of texts, and for each of a block's the number of its text and its place there. A text longer than a block is cut into
    overlapping parts, so that each window is whole in one of them; what a window's anchor is depends on the window alone."""
    for i, j in blocks(texts, BLOCK_BYTES):
        if j - i > 1 or len(texts[i]) <= 2 * BLOCK_BYTES:
            yield texts[i:j], np.arange(i, j), np.zeros(j - i, np.int64)
            continue
        for a in range(0, len(texts[i]) - depth + 1, BLOCK_BYTES):
            yield [texts[i][a : a + BLOCK_BYTES + depth - 1]], np.array([i]), np.array([a])


def find_anchors(docs: DataFrame, depth: int, places: bool) -> DataFrame:
    """fp and occ (a hash of text and place) of each anchor of ``docs`` (tk, text); with ``places`` also tk, s0, s1 and at."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, keys = as_bytes(batch.column(1)), batch.column(0)
            for part, owner, shift in pieces(texts, depth):
                t, fp, at, s0, s1 = anchors(Block(part), depth)
                if not len(t):
                    continue
                own = owner[t]
                at, s0, s1 = (x + shift[t] for x in (at, s0, s1))
                head = np.array([int.from_bytes(keys[k].as_py()[:8], "little") for k in range(owner[0], owner[-1] + 1)], U)
                occ = mix(head[own - owner[0]] + at.astype(U) * U(BASE)).view(np.int64)
                cols = {"fp": pa.array(fp), "occ": pa.array(occ)}
                if places:
                    cols |= {
                        "tk": keys.take(pa.array(own)),
                        "s0": pa.array(s0.astype(np.int32)),
                        "s1": pa.array(s1.astype(np.int32)),
                        "at": pa.array(at.astype(np.int32)),
                    }
                yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return docs.select("tk", "text").mapInArrow(lean(run), "fp long, occ long" + ", tk binary, s0 int, s1 int, at int" * places)


RUNS = pa.list_(pa.struct([("a", pa.int32()), ("z", pa.int32())]))


def runs_of(flags: np.ndarray) -> list[dict]:
    if flags.all():
        return [{"a": 0, "z": len(flags)}] if len(flags) else []
    d = np.diff(flags.astype(np.int8), prepend=0, append=0)
    return [{"a": a, "z": z} for a, z in zip(np.flatnonzero(d == 1).tolist(), np.flatnonzero(d == -1).tolist(), strict=True)]


def sort_block(rows: list[tuple], depth: int) -> list[list[dict]]:
    """Runs of repeated windows of each of ``rows`` (fp, ch, d0, dup, ctx), which hold all contexts of their anchor hashes."""
    klass = np.cumsum([0] + [rows[i][0] != rows[i - 1][0] for i in range(1, len(rows))])
    held = rows + [r for r in rows if r[3]]  # what occurs at two places meets itself
    klass = np.append(klass, klass[[i for i, r in enumerate(rows) if r[3]]])
    size = np.array([len(r[4]) for r in held], np.int64)
    at = np.cumsum(size) - size
    windows = size - depth + 1
    row = np.repeat(np.arange(len(held)), windows)
    k = np.arange(len(row)) - np.repeat(np.cumsum(windows) - windows, windows)
    far = np.array([r[2] for r in held], np.int64)[row] - k  # from the window's begin to its anchor
    flags = Cover(b"".join(r[4] for r in held), depth).repeated(at[row] + k, klass[row] * (depth + 1) + far)
    begins = (np.cumsum(windows) - windows)[: len(rows)].tolist()
    return [runs_of(flags[a : a + w]) for a, w in zip(begins, windows[: len(rows)].tolist(), strict=True)]


def sort_blocks(contexts: DataFrame, depth: int) -> DataFrame:
    """fp, ch, runs for ``contexts`` (fp, ch, d0, dup, ctx), block by block of whole anchor hashes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def done() -> pa.RecordBatch:
            found = sort_block(held, depth)
            return pa.RecordBatch.from_arrays(
                [pa.array([r[0] for r in held], pa.int64()), pa.array([r[1] for r in held], pa.binary()), pa.array(found, RUNS)],
                names=["fp", "ch", "runs"],
            )

        for batch in batches:
            for r in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if size >= SORT_BYTES and r[0] != held[-1][0]:
                    yield done()
                    held, size = [], 0
                held.append(r)
                size += len(r[4]) * (2 if r[3] else 1)
        if held:
            yield done()

    n = max(1, int(contexts.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    dealt = contexts.select("fp", "ch", "d0", "dup", "ctx").repartition(n, "fp").sortWithinPartitions("fp")
    return dealt.mapInArrow(lean(run), "fp long, ch binary, runs array<struct<a:int,z:int>>")


def second_anchors(ctx: bytes, d0: int, marks: list[int], sizes: tuple[int, ...], gram: int, depth: int) -> tuple[np.ndarray, ...]:
    """(hash, place, first window, last window) of the anchors of ``gram`` bytes of a context's windows, clear of the grams at ``d0 + marks`` of ``sizes`` bytes."""
    b = Block([ctx])
    p = b.prefix(BYTE_VALUE)
    n = len(ctx) - gram + 1
    h = mix((p[gram : gram + n] - p[:n]) * b.down[:n])
    x = h >> U(1)
    for m, size in zip(marks, sizes, strict=True):
        x[max(0, d0 + m - gram + 1) : d0 + m + size] = ~U(0)
    a = np.lib.stride_tricks.sliding_window_view(x, depth - gram + 1).argmin(axis=1)
    a += np.arange(len(a))
    s0 = np.flatnonzero(np.diff(a, prepend=-1))
    return h[a[s0]], a[s0], s0, np.append(s0[1:], len(a)) - 1


def deal_again(contexts: DataFrame, depth: int, level: int) -> DataFrame:
    """The parts of ``contexts`` by the anchors of ``GRAMS[level]`` bytes; beyond the last level each window is a part. pf, pch and k0 say what a part was cut from."""
    sizes, gram = (GRAM, *GRAMS[:level]), GRAMS[level] if level < len(GRAMS) else 0

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for fp, ch, d0, dup, marks, ctx in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if gram:
                    h, at, s0, s1 = second_anchors(ctx, d0, marks, sizes, gram, depth)
                    own = mix(mix(h + U(fp & (1 << 64) - 1)) + (at - d0).astype(U) * U(BASE)).view(np.int64)
                    more = [[*marks, a] for a in (at - d0).tolist()]
                else:
                    s0 = s1 = np.arange(len(ctx) - depth + 1)
                    own, more = np.full(len(s0), fp), [marks] * len(s0)
                n = len(s0)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(own),
                        pa.array((d0 - s0).astype(np.int32)),
                        pa.array([dup] * n, pa.bool_()),
                        pa.array(more, pa.list_(pa.int32())),
                        pa.array([ctx[a : z + depth] for a, z in zip(s0.tolist(), s1.tolist(), strict=True)], pa.binary()),
                        pa.array([fp] * n, pa.int64()),
                        pa.array([ch] * n, pa.binary()),
                        pa.array(s0.astype(np.int32)),
                    ],
                    names=["fp", "d0", "dup", "marks", "ctx", "pf", "pch", "k0"],
                )

    schema = "fp long, d0 int, dup boolean, marks array<int>, ctx binary, pf long, pch binary, k0 int"
    return contexts.select("fp", "ch", "d0", "dup", "marks", "ctx").mapInArrow(lean(run), schema).withColumn("ch", F.unhex(F.md5("ctx")))


def repeated_runs(contexts: DataFrame, depth: int, most: int, level: int = 0) -> tuple[DataFrame, list[DataFrame]]:
    """fp, ch, runs of ``contexts`` (fp, ch, d0, dup, marks, ctx; a written table), and the tables that this reads.
    No task gets more than ``most`` contexts of one anchor hash."""
    crowded = contexts.groupBy("fp").count().where(F.col("count") > most).select("fp")
    crowded = materialise(crowded, "crowded")
    if crowded.isEmpty():
        discard(crowded)
        return sort_blocks(contexts, depth).where("size(runs) > 0"), []
    alone = sort_blocks(contexts.join(crowded, "fp", "left_anti"), depth).where("size(runs) > 0")
    parts = materialise(deal_again(contexts.join(crowded, "fp", "left_semi"), depth, level), "parts")
    place = F.xxhash64("pf", "pch", "k0")
    twice = F.max("dup") | (F.min(place) != F.max(place))
    if level < len(GRAMS):
        of = [F.min("d0").alias("d0"), twice.alias("dup"), F.first("marks").alias("marks"), F.first("ctx").alias("ctx")]
        finer = materialise(parts.groupBy("fp", "ch").agg(*of), "finer")
        runs, temps = repeated_runs(finer, depth, most, level + 1)
        temps = [*temps, finer]
    else:  # contexts of one window each: equal ones are one row
        one = F.array(F.struct(F.lit(0).alias("a"), F.lit(1).alias("z")))
        runs, temps = parts.groupBy("fp", "ch").agg(twice.alias("dup")).where("dup").select("fp", "ch", one.alias("runs")), []
    moved = F.transform("runs", lambda r: F.struct((r.a + F.col("k0")).alias("a"), (r.z + F.col("k0")).alias("z")))
    back = parts.select("fp", "ch", "pf", "pch", "k0").join(runs, ["fp", "ch"]).select(F.col("pf").alias("fp"), F.col("pch").alias("ch"), moved.alias("runs"))
    back = back.groupBy("fp", "ch").agg(F.array_sort(F.flatten(F.collect_list("runs"))).alias("runs"))
    return alone.unionByName(back), [*temps, parts, crowded]


def cut_contexts(texts: DataFrame, depth: int) -> DataFrame:
    """fp, tk, s0, d0, ctx for ``texts`` (tk, text, found: array of fp, s0, s1, at)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch.column(1))
            for i, j in blocks(raw, BLOCK_BYTES):
                found = batch.column(2).slice(i, j - i)
                flat, each = found.flatten(), found.value_lengths().to_numpy(zero_copy_only=False)
                fp, s0, s1, at = (flat.field(c).to_numpy(zero_copy_only=False) for c in ("fp", "s0", "s1", "at"))
                if not len(fp):
                    continue
                b = Block(raw[i:j])
                text = np.repeat(np.arange(j - i), each)
                size = s1.astype(np.int64) - s0 + depth
                ends = np.concatenate([[0], np.cumsum(size)])
                p = 0
                while p < len(fp):  # at most CUT_BYTES of contexts at a time
                    q = max(p + 1, int(np.searchsorted(ends, ends[p] + CUT_BYTES, "right")) - 1)
                    some, offset = slice(p, q), ends[p : q + 1] - ends[p]
                    data = b.buf[np.repeat(b.begin[text[some]] + s0[some] - offset[:-1], size[some]) + np.arange(offset[-1])]
                    ctx = pa.Array.from_buffers(pa.binary(), q - p, [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])
                    cols = {
                        "fp": pa.array(fp[some]),
                        "tk": batch.column(0).slice(i, j - i).take(pa.array(text[some])),
                        "s0": pa.array(s0[some]),
                    }
                    cols |= {"d0": pa.array((at[some] - s0[some]).astype(np.int32)), "ctx": ctx}
                    yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
                    p = q

    return texts.select("tk", "text", "found").mapInArrow(lean(run), "fp long, tk binary, s0 int, d0 int, ctx binary")


def inner_characters(text: bytes, a: int, z: int) -> tuple[int, int]:
    """[a, z) without the parts of characters at its ends."""
    while a < z and text[a] & 0xC0 == 0x80:
        a += 1
    while z > a and z < len(text) and text[z] & 0xC0 == 0x80:
        z -= 1
    return a, z


def cut_texts(texts: DataFrame, depth: int, as_text: bool) -> DataFrame:
    """tk, n_removed, n_spans, kept for ``texts`` (tk, text, whole, runs of window starts)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch.column(1))
            for i in range(0, len(raw), 500):
                rows = []
                for tk, text, whole, runs in zip(
                    batch.column(0).slice(i, 500).to_pylist(),
                    raw[i : i + 500],
                    batch.column(2).slice(i, 500).to_pylist(),
                    batch.column(3).slice(i, 500).to_pylist(),
                    strict=True,
                ):
                    spans = [[0, len(text)]] if whole else []
                    for r in [] if whole else sorted((r["a"], r["z"]) for r in runs or ()):
                        if spans and r[0] <= spans[-1][1]:
                            spans[-1][1] = max(spans[-1][1], r[1] - 1 + depth)
                        else:
                            spans.append([r[0], r[1] - 1 + depth])
                    if as_text:
                        spans = [[a, z] for a, z in (inner_characters(text, a, z) for a, z in spans) if a < z]
                    kept, end = [], 0
                    for a, z in spans:
                        kept.append(text[end:a])
                        end = z
                    kept.append(text[end:])
                    rows.append(
                        (
                            tk,
                            sum(z - a for a, z in spans),
                            len(spans),
                            [{"a": a, "z": z} for a, z in spans],
                            b"".join(kept).decode() if as_text else b"".join(kept),
                        )
                    )
                kinds = [pa.binary(), pa.int64(), pa.int64(), RUNS, pa.string() if as_text else pa.binary()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)],
                    names=["tk", "n_removed", "n_spans", "spans", "kept"],
                )

    return texts.select("tk", "text", "whole", "runs").mapInArrow(
        lean(run),
        "tk binary, n_removed long, n_spans long, spans array<struct<a:int,z:int>>, kept " + ("string" if as_text else "binary"),
    )


def find_runs(docs: DataFrame, depth: int, most: int) -> tuple[DataFrame, DataFrame]:
    """For ``docs`` (tk, doc_id, text): the runs of repeated windows (tk, runs), and one row of each text that needs its bytes (tk, text, copies)."""
    seen = find_anchors(docs, depth, False).groupBy("fp").agg(F.min("occ").alias("x"), F.max("occ").alias("y")).where("x <> y").select("fp")
    seen = materialise(seen, "anchors")
    found = find_anchors(docs, depth, True).join(seen, "fp")
    found = found.groupBy("tk").agg(F.collect_set(F.struct("fp", "s0", "s1", "at")).alias("found"))
    copies = docs.groupBy("tk").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("id"))
    need = materialise(copies.join(found, "tk", "left").where("found is not null or copies > 1"), "found")
    discard(seen)
    one = docs.select(F.col("tk").alias("k"), F.col("doc_id").alias("d"), "text")
    texts = need.join(
        one,
        (F.col("tk") == F.col("k")) & F.col("id").eqNullSafe(F.col("d")),
    ).select("tk", "text", "copies", "found").dropDuplicates(["tk"])
    texts = materialise(texts, "texts")
    discard(need)
    rows = materialise(cut_contexts(texts.where("found is not null"), depth).withColumn("ch", F.unhex(F.md5("ctx"))), "contexts")
    occ = F.xxhash64("tk", "s0")
    distinct = rows.groupBy("fp", "ch").agg(
        F.min("d0").alias("d0"), (F.min(occ) != F.max(occ)).alias("dup"), F.array(F.lit(0)).alias("marks"), F.first("ctx").alias("ctx")
    )
    distinct = materialise(distinct, "distinct")
    found, read = repeated_runs(distinct, depth, most)
    runs = materialise(found, "runs")
    for t in (*read, distinct):
        discard(t)
    shift = F.transform("runs", lambda r: F.struct((r.a + F.col("s0")).alias("a"), (r.z + F.col("s0")).alias("z")))
    back = rows.select("fp", "ch", "tk", "s0").join(runs, ["fp", "ch"]).select("tk", shift.alias("runs"))
    back = materialise(back.groupBy("tk").agg(F.flatten(F.collect_list("runs")).alias("runs")), "back")
    discard(rows)
    discard(runs)
    return back, texts


def remove_repeats(docs: DataFrame, depth: int = DEPTH, most: int = MOST, as_text: bool = False) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and others) with n_bytes, n_removed, n_spans, spans (byte ranges) and kept (bytes; null where nothing is removed).
    With ``as_text`` only whole characters are removed and kept is a string. Columns of these names in ``docs`` are replaced."""
    if depth < 2 * GRAM + PERIOD or (depth - PERIOD) % 8:
        raise ValueError(f"depth is at least {2 * GRAM + PERIOD} and a multiple of 8")
    docs = docs.drop("n_bytes", "n_removed", "n_spans", "spans", "kept", "_key", "_tk")
    keyed = docs.select(F.col("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    keyed = keyed.withColumn("tk", F.unhex(F.md5("text")))
    back, texts = find_runs(keyed, depth, most)
    whole = (F.col("copies") > 1) & (F.octet_length("text") >= depth)
    cut = texts.join(back, "tk", "left").where(whole | F.col("runs").isNotNull())
    cut = cut_texts(cut.select("tk", "text", whole.alias("whole"), "runs"), depth, as_text).withColumnRenamed("tk", "_tk")
    out = docs.withColumn("_key", F.unhex(F.md5(F.coalesce("text", F.lit("")))))
    out = out.join(cut, F.col("_key") == F.col("_tk"), "left").drop("_key", "_tk")
    return out.withColumns(
        {
            "n_bytes": F.coalesce(F.octet_length("text"), F.lit(0)).cast("long"),
            "n_removed": F.coalesce("n_removed", F.lit(0)).cast("long"),
            "n_spans": F.coalesce("n_spans", F.lit(0)).cast("long"),
        }
    )
