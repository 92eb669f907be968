"""Benchmark decontamination: a prefix-filtered set join of item windows with documents, as tables.

Words are runs of digits, letters and non-ASCII characters, A-Z lower-cased. A window is ``size`` consecutive words of an
item (all its words, if it has fewer). To be inside a document, a window needs all its words there, so a prefix of its rarest words
is all that must be indexed: words are ordered by how often they occur in all documents (counted first, with
partial counts), and each window is filed under its two rarest words and the distance between them (under its one word, if it has no more). A
document looks up its words that are filed as the rarest, and, of those, the words at a filed distance, before a row is made: a window of common
words makes rows where its pair stands, not wherever its rarest word does. What is found is joined with the index by the pair; the length and
positional bounds (the window must begin and end within the document) come next, then all of the window's words, one by one, are compared with the
document's at that place.

Windows, their words' counts, the index and the hits are tables. The executors get two bitmaps, of the rarest words and of the pairs, of ``BITMAP`` bits
whatever the benchmark's size (what only shares a bit is dropped by the join), and the hashes of the benchmark's distinct words, if there are at
most ``BROADCAST_WORDS`` (beyond it all words are counted and joined), with their counts up to ``BROADCAST_COUNTS`` of them (16 MB). The index is broadcast to the join up to ``BROADCAST_BYTES``, as measured;
beyond it the join shuffles. No pair of a document and an item is ever made except for true hits.

Null or blank text has no words: no hit, not contaminated; such items have no window. Passages of items with a null id are hits like
others; they are only missing in the list of items. Rows with one id are judged each on their own; equal rows have equal results. An empty
table of documents gives an empty result, an empty benchmark no hits. A text of any length is read at once; besides it a worker holds a few
numbers for each of its words. Other columns are not read, so their names may clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.shared import discard, lean, materialise
from gapline.llm.textbytes import ALNUM, BASE, Block, as_bytes, blocks, mix

BLOCK_BYTES = 2 << 20
BITMAP = 1 << 27
BROADCAST_WORDS = 1 << 22
BROADCAST_COUNTS = 1 << 20
BROADCAST_BYTES = 32 << 20
U = np.uint64
FOLD = np.arange(256, dtype=np.uint8)
FOLD[65:91] += 32


def parsed(texts: list[bytes]) -> tuple[Block, np.ndarray]:
    b = Block(texts)
    b.words(ALNUM)
    return b, b.word_hashes().view(np.int64)


def strings(b: Block, at: np.ndarray) -> pa.Array:
    """Words of a block, lower-cased, by their numbers."""
    size = b.ends[at] - b.starts[at]
    offset = np.concatenate([[0], np.cumsum(size)])
    data = FOLD[b.buf[np.repeat(b.starts[at] - offset[:-1], size) + np.arange(offset[-1])]]
    return pa.Array.from_buffers(pa.string(), len(at), [None, pa.py_buffer(offset.astype(np.int32)), pa.py_buffer(data)])


def runs(values: pa.Array, size: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(size)]).astype(np.int32)), values)


def spread(first: np.ndarray, size: np.ndarray) -> np.ndarray:
    """first, first + 1, ... for each of ``size``."""
    return np.repeat(first - (np.cumsum(size) - size), size) + np.arange(size.sum())


def item_windows(items: DataFrame, size: int) -> DataFrame:
    """item_id, words, hashes of each window of ``items`` (item_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            for i, j in blocks(texts, BLOCK_BYTES):
                b, h = parsed(texts[i:j])
                n = np.diff(b.first)
                w = np.minimum(n, size)
                each = np.where(n > 0, n - w + 1, 0)
                at = spread(b.first[:-1], each)
                length = np.repeat(w, each)
                words = spread(at, length)
                item = batch.column(0).slice(i, j - i).take(pa.array(np.repeat(np.arange(j - i), each)))
                yield pa.RecordBatch.from_arrays(
                    [item, runs(strings(b, words), length), runs(pa.array(h[words]), length)],
                    names=["item_id", "words", "hashes"],
                )

    rows = items.select(F.col("item_id").cast("string").alias("item_id"), "text").where("text is not null")
    return rows.mapInArrow(lean(run), "item_id string, words array<string>, hashes array<long>")


def count_words(docs: DataFrame, wanted: np.ndarray | None) -> DataFrame:
    """h, n: how often words occur in all documents; with ``wanted`` (sorted hashes), only those."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0 if wanted is None else len(wanted), np.int64)
        for batch in batches:
            texts = as_bytes(batch.column(0))
            for i, j in blocks(texts, BLOCK_BYTES):
                _, h = parsed(texts[i:j])
                if wanted is None:
                    u, n = np.unique(h, return_counts=True)
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(n)], names=["h", "n"])
                elif len(wanted):
                    k = np.minimum(np.searchsorted(wanted, h), len(wanted) - 1)
                    total += np.bincount(k[wanted[k] == h], minlength=len(wanted))
        some = np.flatnonzero(total)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(wanted[some]), pa.array(total[some])], names=["h", "n"])

    return docs.select("text").mapInArrow(lean(run), "h long, n long").groupBy("h").agg(F.sum("n").alias("n"))


def pair_hash(word: np.ndarray, other: np.ndarray, apart: np.ndarray | int) -> np.ndarray:
    """Hash of two words' hashes and the distance from the first to the second."""
    far = (np.asarray(apart) + (1 << 20)).astype(U)
    return mix(word.view(U) * U(BASE) + mix(other.view(U) + far)).view(np.int64)


def filed_under(windows: DataFrame, docs: DataFrame) -> DataFrame:
    """key, word, place, apart, wid, words: each distinct window with the hash and place of its rarest word, the distance from there to the next rarest (0 if
    there is none), and the hash of the pair."""
    distinct = materialise(
        windows.groupBy("wid").agg(F.first(F.struct("words", "hashes")).alias("w")).select("wid", "w.*"),
        "distinct-windows",
    )
    word = distinct.select(F.explode("hashes").alias("h")).distinct()
    some = word.limit(BROADCAST_WORDS + 1).toPandas()["h"].to_numpy(np.int64)
    counts = count_words(docs, np.sort(some) if len(some) <= BROADCAST_WORDS else None)
    counts = F.broadcast(counts) if len(some) <= BROADCAST_COUNTS else counts  # so that a common word's places stay where they are
    places = distinct.select("wid", F.posexplode("hashes").alias("place", "h")).join(counts, "h", "left")
    by_rarity = F.array_sort(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "h", "place")))  # of at most a window's words
    prefix = places.groupBy("wid").agg(by_rarity.alias("r")).select("wid", F.col("r")[0].alias("a"), F.coalesce(F.get("r", F.lit(1)), F.col("r")[0]).alias("b"))
    rows = distinct.join(prefix, "wid").select(
        F.col("a.h").alias("word"), F.col("b.h").alias("other"), F.col("a.place").alias("place"), (F.col("b.place") - F.col("a.place")).alias("apart"), "wid", "words"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            word, other, apart = (b.column(x).to_numpy(zero_copy_only=False) for x in ("word", "other", "apart"))
            cols = {"key": pa.array(pair_hash(word, other, apart)), **{x: b.column(x) for x in ("word", "place", "apart", "wid", "words")}}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    return rows.mapInArrow(lean(run), "key long, word long, place int, apart int, wid string, words array<string>")


def bitmap(index: DataFrame, column: str) -> np.ndarray:
    """Bits of the hashes in ``column``, gathered as at most BITMAP / 2**16 blocks."""
    bit = F.pmod(column, F.lit(BITMAP)).cast("int")
    blocks_ = index.select(
        F.shiftright(bit, 16).alias("block"),
        bit.bitwiseAND(0xFFFF).alias("low"),
    ).groupBy("block").agg(F.collect_set("low").alias("low"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = []
            for low in batch.column(1):
                own = np.zeros(1 << 16, bool)
                own[low.values.to_numpy()] = True
                packed.append(np.packbits(own).tobytes())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], names=["block", "bits"])

    out = np.zeros(BITMAP >> 3, np.uint8)
    for r in blocks_.mapInArrow(lean(run), "block int, bits binary").collect():
        out[r["block"] << 13 : (r["block"] + 1) << 13] = np.frombuffer(r["bits"], np.uint8)
    return out


LOOKED_UP = "doc_id long, row long, n_words long, found array<struct<pos:long,key:long,before:int,near:array<string>>>"


def marked(bits: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set."""
    k = h.view(U) & U(BITMAP - 1)  # as pmod of a power of two
    return (bits[k >> U(3)] >> (7 - (k & U(7))).astype(np.uint8) & 1).astype(bool)


def look_up(docs: DataFrame, words: np.ndarray, pairs: np.ndarray, distances: list[int], size: int) -> DataFrame:
    """For each row of ``docs`` (doc_id, row, text): its number of words, and its words that may be filed (by the bits of ``words``, and of ``pairs`` with the word at one of
    ``distances``), with up to ``size`` - 1 words on either side."""
    sent = docs.sparkSession.sparkContext.broadcast((words, pairs))

    def paired(h: np.ndarray, first: np.ndarray, pairs: np.ndarray, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Those of the words ``p`` that have their other word, each once for each such distance, in order, and the pairs' hashes."""
        doc = np.searchsorted(first, p, "right") - 1
        places, keys = [p[:0]], [h[:0]]
        for d in distances:
            at = p[(p + d >= first[doc]) & (p + d < first[doc + 1])]
            k = pair_hash(h[at], h[at + d], d)
            ok = marked(pairs, k)
            places.append(at[ok])
            keys.append(k[ok])
        p, k = np.concatenate(places), np.concatenate(keys)
        order = np.argsort(p, kind="stable")
        return p[order], k[order]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, pairs = sent.value
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for i, j in blocks(texts, BLOCK_BYTES):
                b, h = parsed(texts[i:j])
                p, keys = paired(h, b.first, pairs, np.flatnonzero(marked(words, h)))
                doc = np.searchsorted(b.first, p, "right") - 1
                low, high = np.maximum(b.first[doc], p - size + 1), np.minimum(b.first[doc + 1], p + size)
                near = runs(strings(b, spread(low, high - low)), high - low)
                found = pa.StructArray.from_arrays(
                    [pa.array(p - b.first[doc]), pa.array(keys), pa.array((p - low).astype(np.int32)), near],
                    names=["pos", "key", "before", "near"],
                )
                cols = [
                    batch.column(0).slice(i, j - i),
                    batch.column(1).slice(i, j - i),
                    pa.array(np.diff(b.first)),
                    runs(found, np.bincount(doc, minlength=j - i)),
                ]
                yield pa.RecordBatch.from_arrays(cols, names=["doc_id", "row", "n_words", "found"])

    return docs.mapInArrow(lean(run), LOOKED_UP)


def decontaminate(
    docs: DataFrame,
    items: DataFrame,
    size: int = 13,
    share: float = 0.05,
    broadcast_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """``docs`` (doc_id, text) judged against ``items`` (item_id, text): doc_id, row (xxhash64 of the text), n_words, n_hit, spans (merged runs of hit words),
    items (ids as strings, sorted), contaminated (n_hit > 0 and n_hit >= share * n_words)."""
    docs = docs.select(F.col("doc_id").cast("long"), F.xxhash64("text").alias("row"), "text")
    windows = materialise(item_windows(items, size).withColumn("wid", F.md5(F.array_join("words", " "))), "windows")
    index = materialise(filed_under(windows, docs), "index")
    distances = sorted(r["apart"] for r in index.select("apart").distinct().collect())  # fewer than 2 * size
    rows = materialise(look_up(docs, bitmap(index, "word"), bitmap(index, "key"), distances, size), "looked-up")
    bytes_ = index.agg(F.sum(F.octet_length(F.array_join("words", " ")) + 200)).first()[0] or 0
    filed = index.select("key", "place", "wid", "words")
    filed = F.broadcast(filed) if bytes_ <= broadcast_bytes else filed
    key = ["doc_id", "row"]
    at = rows.select(*key, F.inline("found")).join(filed, "key")
    n, begin = F.size("words"), F.col("before") - F.col("place")
    fits = (begin >= 0) & (begin + n <= F.size("near"))
    same = F.when(fits, F.slice("near", F.greatest(begin, F.lit(0)) + 1, n) == F.col("words"))
    hits = at.where(same).select(
        *key,
        "wid",
        (F.col("pos") - F.col("place")).alias("a"),
        (F.col("pos") - F.col("place") + n).alias("z"),
    ).distinct()
    hits = materialise(hits, "hits")
    by = Window.partitionBy(*key).orderBy("a", "z")
    beyond = F.max("z").over(by.rowsBetween(Window.unboundedPreceding, -1))
    spans = hits.select(*key, "a", "z").distinct().withColumn("new", F.coalesce(F.col("a") > beyond, F.lit(True)).cast("int"))
    spans = spans.withColumn(
        "run",
        F.sum("new").over(by.rowsBetween(Window.unboundedPreceding, 0)),
    ).groupBy(*key, "run").agg(F.min("a").alias("a"), F.max("z").alias("z"))
    spans = spans.groupBy(*key).agg(
        F.array_sort(F.collect_list(F.struct("a", "z"))).alias("spans"),
        F.sum(F.col("z") - F.col("a")).alias("n_hit"),
    )
    names = windows.where("item_id is not null").select("wid", "item_id").distinct()
    names = hits.select(*key, "wid").distinct().join(names, "wid").select(*key, "item_id").distinct()
    names = names.groupBy(*key).agg(F.array_sort(F.collect_list("item_id")).alias("items"))
    found = materialise(
        spans.join(
            names.select(F.col("doc_id").alias("d"), F.col("row").alias("r"), "items"),
            F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r")),
            "left",
        ).drop("d", "r"),
        "found",
    )
    for x in (windows, index, hits):
        discard(x)
    found = found.toDF("d", "r", "spans", "n_hit", "items")
    out = rows.drop("found").join(found, F.col("doc_id").eqNullSafe(F.col("d")) & F.col("row").eqNullSafe(F.col("r")), "left")
    none = {
        "spans": F.array().cast("array<struct<a:long,z:long>>"),
        "items": F.array().cast("array<string>"),
        "n_hit": F.lit(0).cast("long"),
    }
    out = out.withColumns({k: F.coalesce(k, v) for k, v in none.items()})
    bad = (F.col("n_hit") > 0) & (F.col("n_hit") >= F.lit(share) * F.col("n_words") - 1e-9)
    return out.select("doc_id", "row", "n_words", "n_hit", "spans", "items", bad.alias("contaminated"))
