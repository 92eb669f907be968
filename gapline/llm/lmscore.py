"""Cross-entropy difference: documents scored by a target and a background bigram model that share one vocabulary.

The target is a set of documents, the background all the others, so no document is in both. Both models have the same form,

    P(w | h) = (s * c(h w) + mu * base(w)) / (s * c(h) + mu),

with the same vocabulary (every word of the corpus), the same ``mu`` and the same ``base``, the words' shares in the whole corpus. The counts of
the larger side are scaled down by ``s`` to the size of the smaller one, so that neither is smoothed less than the other. A
document's own counts are taken out of its side before it is scored: it never predicts itself. The score is the mean over a document's words
of the target's loss less the background's, in nats: low scores are like the target.

Counts cover all words of all documents and grow with the input; none is gathered but these, which are bounded by parameters:

1. Words whose share is at least 1 / ``top``, and the counts of what follows them; the executors get these. Rarer words are known too, and told
   from each other; only in ``base`` they share what is left evenly.
2. Bigrams whose share is at least 1 / ``heavy`` (by pigeonhole each of them has half that share in some block of text; those are counted). The
   executors get their counts, so no key of the shuffle holds more than that share of the rows.

All other pairs of a document and a bigram are filed once under a bucket of their bigram (of their first word, if it is rare), packed by
bucket and block of text, and shuffled. There are as many buckets as keep one within ``bucket`` pairs or so. A bucket is sorted in memory, counts its
bigrams and gives sums for documents back, packed by groups of documents, which are shuffled and added up.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. Texts of any length are handled in blocks; a long text's bigrams
are counted at once. A document is a doc_id: rows that share one (or have none) are one document, though each row is a text of its own when own
counts are taken out. Null text or no words: no score (null). Without target documents (or without others) that model is the base alone. An empty
table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapline.llm.shared import discard, lean, materialise
from gapline.llm.textbytes import ALNUM, U, Block, as_bytes, blocks
from gapline.llm.textbytes import mix as scramble

BLOCK_BYTES = 4 << 20
BLOCK_ROWS = 1 << 16
BROADCAST_IDS = 2_000_000  # ids of target documents that are sent to the executors at most
TOP = 1 << 17
HEAVY = 1 << 13
BUCKET = 2_000_000
GROUP = 200_000  # documents whose sums are added up together, or so
SUMMED = 1_000_000  # sums for documents that a task holds back at most
BEGIN = -1  # in place of the hash of the word before the first
NO_ID = -(1 << 63)
#: a bigram of two frequent words is their numbers; others are hashes with this bit
HASHED = U(1 << 63)


def text_blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    for i, j in blocks(texts, BLOCK_BYTES):
        for a in range(i, j, BLOCK_ROWS):
            yield a, min(j, a + BLOCK_ROWS)


def bigrams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first, second, text) of each word: hashes of the word before (or the begin) and of itself."""
    b = Block(texts)
    b.words(ALNUM)
    h = b.word_hashes().view(np.int64)
    n = np.diff(b.first)
    before = np.concatenate([[BEGIN], h])[: len(h)]
    before[b.first[:-1][n > 0]] = BEGIN
    return before, h, np.repeat(np.arange(len(texts)), n)


def key_of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A 64-bit hash of a bigram."""
    return scramble(scramble(a.view(U)) * U(0xD6E8FEB86659FD93) + b.view(U)).view(np.int64)


def flags(column: pa.Array) -> np.ndarray:
    return np.array([bool(x) for x in column.to_pylist()], bool)


def find(sorted_values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Places of ``x`` in ``sorted_values``, -1 where it isn't there."""
    if not len(sorted_values):
        return np.full(len(x), -1)
    k = np.minimum(np.searchsorted(sorted_values, x), len(sorted_values) - 1)
    return np.where(sorted_values[k] == x, k, -1)


@dataclass(frozen=True)
class Models:
    words: np.ndarray  # hashes of frequent words and the begin, sorted
    follow: np.ndarray  # rows of them: words that follow, in the target and in the background
    base: np.ndarray  # mu * base of each, and of a rare word at the end
    scale: tuple[float, float]
    mu: float
    heavy: np.ndarray  # hashes of heavy bigrams, sorted
    counts: np.ndarray  # rows of them: in the target and in the background

    def gain(self, counts: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Columns for target and background: by how much counts (own ones taken out) raise a log probability over the base."""
        return np.log1p(counts * np.array(self.scale) / base[:, None])

    def history(self, counts: np.ndarray) -> np.ndarray:
        """Log of the denominator, for counts of what follows a first word."""
        return np.log(counts * np.array(self.scale) + self.mu)


def own(n: np.ndarray, good: np.ndarray) -> np.ndarray:
    """``n`` in the column of its side."""
    return np.stack([n * good, n * ~good], axis=1)


def count(docs: DataFrame, heavy: int) -> DataFrame:
    """kind, x, n, t, b for ``docs`` (doc_id, text, good). Kind 0: how often each word occurs, and how often a word follows it in the target and in the
    background (the begin of a text is a row too). Kind 1: bigrams with a large share of their block, n of them there."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, good = as_bytes(batch.column(1)), flags(batch.column(2))
            for i, j in text_blocks(texts):
                h, w, doc = bigrams(texts[i:j])
                if not len(w):
                    continue
                side = good[i:j][doc]
                x, inverse = np.unique(np.concatenate([w, h]), return_inverse=True)
                n = np.bincount(inverse[: len(w)], minlength=len(x))
                t = np.bincount(inverse[len(w) :][side], minlength=len(x))
                b = np.bincount(inverse[len(w) :][~side], minlength=len(x))
                key, many = np.unique(key_of(h, w), return_counts=True)
                much = many * 2 * heavy >= len(w)
                kind = np.repeat([0, 1], [len(x), much.sum()]).astype(np.int32)
                none = np.zeros(much.sum(), np.int64)
                cols = [kind, np.append(x, key[much]), np.append(n, many[much]), np.append(t, none), np.append(b, none)]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["kind", "x", "n", "t", "b"])

    rows = docs.mapInArrow(lean(run), "kind int, x long, n long, t long, b long")
    return rows.groupBy("kind", "x").agg(*[F.sum(c).alias(c) for c in "ntb"])


def count_heavy(docs: DataFrame, heavy: np.ndarray) -> np.ndarray:
    """How often each of the ``heavy`` bigrams occurs in the target and in the background."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = np.zeros((len(heavy), 2), np.int64)
        for batch in batches:
            texts, good = as_bytes(batch.column(1)), flags(batch.column(2))
            for i, j in text_blocks(texts):
                h, w, doc = bigrams(texts[i:j])
                k, side = find(heavy, key_of(h, w)), good[i:j][doc]
                out[:, 0] += np.bincount(k[(k >= 0) & side], minlength=len(heavy))
                out[:, 1] += np.bincount(k[(k >= 0) & ~side], minlength=len(heavy))
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(heavy))), pa.array(out[:, 0]), pa.array(out[:, 1])], names=["k", "t", "b"])

    out = np.zeros((len(heavy), 2))
    if len(heavy):
        rows = docs.mapInArrow(lean(run), "k long, t long, b long").groupBy("k").agg(F.sum("t").alias("t"), F.sum("b").alias("b"))
        for r in rows.collect():  # one row for each heavy bigram at most
            out[r["k"]] = r["t"], r["b"]
    return out


def train(docs: DataFrame, mu: float, top: int, heavy: int) -> tuple[Models, int]:
    """The parts of both models that the executors get, and the number of words of ``docs`` (doc_id, text, good)."""
    counts = materialise(count(docs, heavy), "words")
    word = (F.col("kind") == 0) & (F.col("x") != BEGIN)
    total, size = counts.where(word).agg(F.sum("n"), F.count(F.lit(1))).first()
    total = total or 0
    frequent = (F.col("kind") == 0) & ((F.col("x") == BEGIN) | (F.col("n") * top >= total))
    rows = sorted(map(tuple, counts.where(frequent).select("x", "n", "t", "b").collect()))  # ``top`` and the begin at most
    much = counts.where((F.col("kind") == 1) & (F.col("n") * 2 * heavy >= total)).select("x").collect()  # 2 * ``heavy`` at most
    much = np.sort(np.array([r["x"] for r in much], np.int64))
    side = counts.where("kind = 0").agg(F.sum("t"), F.sum("b")).first()
    least = min(x or 0 for x in side)
    scale = tuple(float(least) / x if least and x else 1.0 for x in side)
    words = np.array([r[0] for r in rows], np.int64)
    n = np.array([r[1] for r in rows], float)
    known = words != BEGIN
    rest = size - int(known.sum())
    rare = (total - n[known].sum()) / rest if rest else 0.0
    base = mu * (np.append(n, rare) + 1.0) / (total + size) if total else np.append(n, rare)
    models = Models(words, np.array([r[2:] for r in rows], float).reshape(-1, 2), base, scale, mu, much, count_heavy(docs, much))
    discard(counts)
    return models, total


PACKED = "part long, data binary"
SUMS = "doc_id long, n long, lt double, lb double"


def merged(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    """Sums by document of parts (ids, words, gains in both models)."""
    ids, n, logs = (np.concatenate(x) for x in zip(*parts, strict=True))
    u, inverse = np.unique(ids, return_inverse=True)
    return u, np.bincount(inverse, n, len(u)), np.stack([np.bincount(inverse, x, len(u)) for x in logs.T], axis=1)


def dealt(parts: list[tuple[np.ndarray, ...]], groups: int) -> pa.RecordBatch:
    """Sums by document, packed by ``groups`` of documents: a row holds all that a task has for a group."""
    ids, n, logs = merged(parts)
    group = (scramble(ids.view(U)) % U(groups)).astype(np.int64)
    order = np.argsort(group, kind="stable")
    found, first = np.unique(group[order], return_index=True)
    rows = []
    for a, z in zip(first.tolist(), [*first[1:].tolist(), len(order)], strict=True):
        k = order[a:z]
        rows.append(ids[k].astype("<i8").tobytes() + np.concatenate([n[k], logs[k, 0], logs[k, 1]]).astype("<f8").tobytes())
    return pa.RecordBatch.from_arrays([pa.array(found), pa.array(rows, pa.binary())], names=["part", "data"])


def unpacked(data: bytes) -> tuple[np.ndarray, ...]:
    size = len(data) // 32
    values = np.frombuffer(data, "<f8", 3 * size, 8 * size).reshape(3, size)
    return np.frombuffer(data, "<i8", size), values[0], values[1:].T


def total_sums(packed: DataFrame, parts: int) -> DataFrame:
    """One row for each document from rows of :func:`dealt`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def done() -> pa.RecordBatch:
            ids, n, logs = merged(held)
            cols = [ids, n.astype(np.int64), logs[:, 0], logs[:, 1]]
            return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["doc_id", "n", "lt", "lb"])

        part, held = None, []
        for batch in batches:
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                if k != part and held:
                    yield done()
                    held = []
                part = k
                held.append(unpacked(data.as_py()))
        if held:
            yield done()

    return packed.repartition(parts, "part").sortWithinPartitions("part").mapInArrow(lean(run), SUMS)


def doc_counts(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each word: how often its key occurs in its text; and which words are the first with their key in their text."""
    order = np.lexsort((key, doc))
    k, d = key[order], doc[order]
    new = np.ones(len(k), bool)
    new[1:] = (k[1:] != k[:-1]) | (d[1:] != d[:-1])
    at = np.flatnonzero(new)
    each = np.diff(np.append(at, len(k)))
    n = np.empty(len(k), np.int64)
    n[order] = np.repeat(each, each)
    return n, order[at]


def local_sums(docs: DataFrame, models: Models, groups: int) -> DataFrame:
    """What a document's score has of counts that the executors have: denominators of frequent first words, the base, heavy bigrams."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids, texts, good = batch.column(0).to_numpy(), as_bytes(batch.column(1)), flags(batch.column(2))
            for i, j in text_blocks(texts):
                h, w, doc = bigrams(texts[i:j])
                side = good[i:j][doc]
                logs = np.repeat(np.log(m.base[find(m.words, w)])[:, None], 2, axis=1)
                k = find(m.words, h)
                some = np.flatnonzero(k >= 0)
                n, _ = doc_counts(k[some], doc[some])
                logs[some] -= m.history(m.follow[k[some]] - own(n, side[some]))
                logs[k < 0] -= np.log(m.mu)
                q = find(m.heavy, key_of(h, w))
                some = np.flatnonzero(q >= 0)
                n, _ = doc_counts(q[some], doc[some])
                logs[some] += m.gain(m.counts[q[some]] - own(n, side[some]), m.base[find(m.words, w[some])])
                none = np.zeros(j - i)  # texts without words are rows too
                some = [(ids[i:j][doc], np.ones(len(doc)), logs), (ids[i:j], none, np.stack([none, none], 1))]
                yield dealt(some, groups)

    return docs.mapInArrow(lean(run), PACKED)


def pack(pos: np.ndarray, n: np.ndarray, *keys: np.ndarray) -> bytes:
    """Arrays of one length behind each other; the counts take a byte each if they fit."""
    small = not len(n) or n.max() < 256
    parts = [
        np.array([len(n), 1 if small else 4], "<u4"),
        *(k.astype("<u8") for k in keys),
        pos.astype("<u2"),
        n.astype("u1" if small else "<u4"),
    ]
    return b"".join(p.tobytes() for p in parts)


def unpack(data: bytes, keys: int) -> tuple[np.ndarray, ...]:
    size, width = (int(x) for x in np.frombuffer(data, "<u4", 2))
    at, out = 8, []
    for kind in ("<u8",) * keys + ("<u2", "u1" if width == 1 else "<u4"):
        out.append(np.frombuffer(data, kind, size, at))
        at += out[-1].nbytes
    return tuple(out)


def pairs(docs: DataFrame, models: Models, buckets: int) -> DataFrame:
    """bucket, ids, good, frequent, rare: packed pairs of a text and a bigram that isn't heavy, with a frequent or a rare first word."""
    sent = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = sent.value
        for batch in batches:
            ids, texts, good = batch.column(0).to_numpy(), as_bytes(batch.column(1)), flags(batch.column(2))
            for i, j in text_blocks(texts):
                h, w, doc = bigrams(texts[i:j])
                key = key_of(h, w)
                left = find(m.heavy, key) < 0
                h, w, doc, key = h[left], w[left], doc[left], key[left]
                n, first = doc_counts(key, doc)
                h, w, doc, key, n = h[first], w[first], doc[first], key[first].view(U), n[first]
                p, q = find(m.words, h), find(m.words, w)
                both = (p >= 0) & (q >= 0)
                key = np.where(both, p.astype(U) << U(32) | q.astype(U), key | HASHED)
                second = np.where(q >= 0, q.astype(U), w.view(U) | HASHED)
                bucket = (scramble(np.where(p >= 0, key, h.view(U))) % U(buckets)).astype(np.int64)
                order = np.argsort(bucket, kind="stable")
                edges = np.searchsorted(bucket[order], np.arange(buckets + 1)) if buckets <= len(order) else None
                starts = np.unique(bucket) if edges is None else np.flatnonzero(np.diff(edges))
                rows = []
                for k in starts.tolist():
                    own_rows = order[edges[k] : edges[k + 1]] if edges is not None else order[
                        np.searchsorted(bucket[order], k) : np.searchsorted(bucket[order], k, "right")
                    ]
                    local, pos = np.unique(doc[own_rows], return_inverse=True)
                    f, r = p[own_rows] >= 0, p[own_rows] < 0
                    a, b = own_rows[f], own_rows[r]
                    rows.append(
                        (
                            k,
                            ids[i:j][local].tobytes(),
                            good[i:j][local].tobytes(),
                            pack(pos[f], n[a], key[a]),
                            pack(pos[r], n[b], h[b].view(U), second[b]),
                        )
                    )
                if rows:
                    kinds = [pa.int64(), *[pa.binary()] * 4]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)],
                        names=["bucket", "ids", "good", "frequent", "rare"],
                    )

    return docs.mapInArrow(lean(run), "bucket long, ids binary, good binary, frequent binary, rare binary")


def grouped(n: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """For each row the sum of ``n`` (rows, columns) over the rows with the same keys."""
    order = np.lexsort(keys) if len(keys) > 1 else np.argsort(keys[0], kind="stable")
    new = np.zeros(len(order), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[order][1:] != k[order][:-1]
    at = np.flatnonzero(new)
    out = np.empty(n.shape)
    out[order] = np.repeat(np.add.reduceat(n[order], at, axis=0), np.diff(np.append(at, len(order))), axis=0)
    return out


def bucket_gains(rows: list[tuple[bytes, ...]], m: Models) -> list[tuple[np.ndarray, ...]]:
    """Parts (ids of documents, no words, what they gain in both models) from all rows (ids, good, frequent, rare) of one bucket."""
    if not rows:
        return []
    out: list[tuple[np.ndarray, ...]] = []
    sizes = np.cumsum([0] + [len(r[1]) for r in rows])
    ids = np.frombuffer(b"".join(r[0] for r in rows), np.int64)
    good = np.frombuffer(b"".join(r[1] for r in rows), bool)
    for column, keys in ((2, 1), (3, 2)):
        parts = [unpack(r[column], keys) for r in rows]
        *key, n = (np.concatenate(x) for x in zip(*[(*p[:keys], p[-1].astype(np.int64)) for p in parts], strict=True))
        if not len(n):
            continue
        text = np.concatenate([p[-2].astype(np.int64) + a for p, a in zip(parts, sizes, strict=False)])
        mine = own(n, good[text])
        second = key[-1]
        hashed = second & HASHED > 0
        base = m.base[np.where(hashed, -1, (second & U(0xFFFFFFFF)).astype(np.int64))]
        if keys == 1:
            logs = m.gain(grouped(mine, *key) - mine, base)
        else:
            logs = m.gain(grouped(mine, *key) - mine, base) - np.log1p(
                (grouped(mine, key[0]) - grouped(mine, key[0], text)) * np.array(m.scale) / m.mu
            )
        logs *= n[:, None]
        some = np.flatnonzero(logs.any(axis=1))
        out.append((ids[text[some]], np.zeros(len(some)), logs[some]))
    return [merged(out)] if out else []


def shuffled_sums(packed: DataFrame, models: Models, parts: int, groups: int) -> DataFrame:
    sent = packed.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bucket, held = None, []
        some: list[tuple[np.ndarray, ...]] = []
        for batch in batches:
            for r in range(batch.num_rows):
                k, *row = (c[r].as_py() for c in batch.columns)
                if k != bucket:
                    some += bucket_gains(held, sent.value)
                    if sum(len(x[0]) for x in some) > SUMMED:  # a task's buckets share their documents
                        some = [merged(some)]
                        if len(some[0][0]) > SUMMED // 2:
                            yield dealt(some, groups)
                            some = []
                    bucket, held = k, []
                held.append(tuple(row))
        some += bucket_gains(held, sent.value)
        if some:
            yield dealt(some, groups)

    return packed.repartition(parts, "bucket").sortWithinPartitions("bucket").mapInArrow(lean(run), PACKED)


def score(docs: DataFrame, target: DataFrame, mu: float = 100.0, top: int = TOP, heavy: int = HEAVY, bucket: int = BUCKET) -> DataFrame:
    """doc_id, n_words, loss_target, loss_background, score of each document of ``docs`` (doc_id, text); ``target`` has the doc_ids of the target."""
    if top < 2 * heavy:
        raise ValueError("top is at least twice heavy, so that the words of heavy bigrams are frequent")
    spark = docs.sparkSession
    good = target.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().withColumn("good", F.lit(True))
    if good.count() <= BROADCAST_IDS:  # else both sides are shuffled by doc_id
        good = F.broadcast(good)
    marked = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").join(good, "doc_id", "left")
    marked = marked.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "text", "good")
    models, total = train(marked, mu, top, heavy)
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    buckets = parts * -(-total // (bucket * parts) or 1)
    groups = parts * (-(-docs.count() // (GROUP * parts)) or 1)
    rare = shuffled_sums(pairs(marked, models, buckets), models, parts, groups)
    out = total_sums(local_sums(marked, models, groups).unionByName(rare), parts).withColumnRenamed("n", "n_words")
    n = F.nullif("n_words", F.lit(0))
    loss_t, loss_b = -F.col("lt") / n, -F.col("lb") / n
    doc_id = F.nullif("doc_id", F.lit(NO_ID))
    return out.select(
        doc_id.alias("doc_id"),
        "n_words",
        loss_t.alias("loss_target"),
        loss_b.alias("loss_background"),
        (loss_t - loss_b).alias("score"),
    )


def divide(scored: DataFrame, target: DataFrame) -> float:
    """The score halfway between the mean scores of target documents and of the others; 0 if either has none."""
    good = target.select("doc_id").distinct().withColumn("good", F.lit(True))
    rows = scored.where("score is not null").join(good, "doc_id", "left").groupBy("good").agg(F.avg("score").alias("m")).collect()
    return sum(r["m"] for r in rows) / 2 if len(rows) == 2 else 0.0
