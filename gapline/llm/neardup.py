"""Near-duplicate groups by min-max hashing.

1. Each document becomes its set of distinct word shingles (hashed to 64 bits); documents with equal sets form a class, found by
   a 128-bit digest of the set with partial aggregation, and one text stands for a class from there on.
2. Under each of ``bands * rows / 2`` permutations both the minimum and the maximum of the set are kept, so a signature of twice
   as many values costs one evaluation a value pair. ``rows`` values make a band; classes that share a band are candidates.
3. Buckets make no pairs: each bucket's members are tied to its smallest class, and the components of these ties are candidate groups.
   A group of at most ``GROUP_ITEMS`` shingles is one block and yields at most one link for each class: overlaps of up to ``GROUP``
   classes are counted by products of incidence matrices, those of more are found by an exact prefix filter in memory (shingles
   ordered by rarity in the group, each set filed under the first ones that a partner must share, bounds by length and position).
4. A larger group is joined by the same filter as tables. Among the sets filed together, one at a time (the one filed with most
   others) is compared with the rest, and links are confirmed on full sets; classes outside the largest component found so take
   their turn, until no pair that could join two components is untested. (A pair within one component can't change the components.)
5. Components: minimum labels along links with pointer jumping, on tables in the shared folder.

Linked: ``100 * overlap >= percent * union``. A pair at the threshold shares no band with a chance of about (1 - s**rows)**bands: 4e-7
for the defaults at 0.85. Documents with fewer words than a shingle have their whole word sequence as the one shingle; without words
(or null text) the set is empty and linked with nothing. Repeated rows of one id are one document if their texts are equal.
A null id counts as larger than any other; a group of null ids alone has a null component and is kept. An empty table gives an empty result.
A worker holds a few words for each word of a text, and one text at a time if it is longer than ``BLOCK_BYTES``. Other columns aren't read.

The two ways of 3 and 4 give the same groups; which one a group takes is decided by ``group_items`` alone, to bound a task's memory.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from gapline.llm.shared import discard, lean, materialise
from gapline.llm.textbytes import BASE, LOWER_VALUE, NOT_BLANK, U, Block, as_bytes, blocks, mix, window_hashes

BLOCK_BYTES = 1 << 20
NO_ID = (1 << 63) - 1
STAR_ROUNDS = 3
GROUP = 256
GROUP_ITEMS = 2_000_000


def shingle_hashes(b: Block, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of each text of ``b`` (with repeats), and where each text's begin."""
    b.words(NOT_BLANK)
    h = b.word_hashes(LOWER_VALUE)
    words = np.diff(b.first)
    n = np.where(words >= size, words - size + 1, (words > 0).astype(words.dtype))
    first = np.concatenate([[0], np.cumsum(n)]).astype(np.int64)
    out = np.zeros(first[-1], U)
    full = np.flatnonzero(words >= size)
    if len(full):
        w = window_hashes(h, size)
        at = np.repeat(b.first[full] - (np.cumsum(n[full]) - n[full]), n[full]) + np.arange(n[full].sum())
        to = np.repeat(first[full] - (np.cumsum(n[full]) - n[full]), n[full]) + np.arange(n[full].sum())
        out[to] = w[at]
    for d in np.flatnonzero((words > 0) & (words < size)).tolist():
        out[first[d]] = window_hashes(h[b.first[d] : b.first[d + 1]], int(words[d]))[0]
    return out, first


def set_digest(distinct: np.ndarray) -> bytes:
    """128 bits and the size: equal for equal sets."""
    return np.array(
        [mix(distinct + U(BASE)).sum(dtype=U), mix(distinct ^ U(0xA5A5A5A5A5A5A5A5)).sum(dtype=U)],
        "<u8",
    ).tobytes() + len(distinct).to_bytes(5, "little")


def signatures(h: np.ndarray, first: np.ndarray, perms: int) -> np.ndarray:
    """(texts, 2 * perms): minimum and maximum under each permutation; ``first`` begins non-empty runs of ``h``."""
    out = np.empty((len(first), 2 * perms), U)
    a = mix(np.arange(1, perms + 1, dtype=U) * U(0xC2B2AE3D27D4EB4F)) | U(1)
    c = mix(np.arange(1, perms + 1, dtype=U) * U(0x165667B19E3779F9))
    x = np.empty_like(h)
    for k in range(perms):
        np.multiply(h, a[k], out=x)
        x ^= c[k]
        out[:, 2 * k] = np.minimum.reduceat(x, first)
        out[:, 2 * k + 1] = np.maximum.reduceat(x, first)
    return out


def sign(docs: DataFrame, size: int, bands: int, rows: int) -> DataFrame:
    """doc_id, th, n, cls, band (array of bucket keys) for each row of ``docs`` (doc_id, th, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(2))
            for i, j in blocks(texts, BLOCK_BYTES):
                h, first = shingle_hashes(Block(texts[i:j]), size)
                count, cls = [], []
                for d in range(j - i):
                    own = np.unique(h[first[d] : first[d + 1]])
                    count.append(len(own))
                    cls.append(set_digest(own))
                has = np.flatnonzero(np.diff(first))
                keys = [None] * (j - i)
                if len(has):
                    s = signatures(h, first[has], bands * rows // 2).reshape(len(has), bands, rows)
                    k = np.zeros((len(has), bands), U)
                    for r in range(rows):
                        k = mix(k * U(BASE) + s[:, :, r])
                    k = mix(k + np.arange(bands, dtype=U) * U(0xD6E8FEB86659FD93)).view(np.int64)
                    for d, own in zip(has.tolist(), k.tolist(), strict=True):
                        keys[d] = own
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(i, j - i),
                        batch.column(1).slice(i, j - i),
                        pa.array(count, pa.int64()),
                        pa.array(cls, pa.binary()),
                        pa.array(keys, pa.list_(pa.int64())),
                    ],
                    names=["doc_id", "th", "n", "cls", "band"],
                )

    return docs.select("doc_id", "th", "text").mapInArrow(lean(run), "doc_id long, th long, n long, cls binary, band array<long>")


def sets_of(texts: DataFrame, size: int) -> DataFrame:
    """cls and its sorted shingle hashes, for rows (cls, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = as_bytes(batch.column(1))
            for i, j in blocks(raw, BLOCK_BYTES):
                h, first = shingle_hashes(Block(raw[i:j]), size)
                sets = [np.unique(h[first[d] : first[d + 1]]).tobytes() for d in range(j - i)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sets, pa.binary())], names=["cls", "items"])

    return texts.select("cls", "text").mapInArrow(lean(run), "cls binary, items binary")


def confirm(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs (a, b) of classes whose full sets overlap enough. A class that stands in many pairs as ``a`` is given to as many
    tasks as it has hundreds of pairs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U), np.frombuffer(y.as_buffer(), U)
                small, large = (p, q) if len(p) <= len(q) else (q, p)
                if 100 * len(small) < percent * len(large):
                    ok.append(False)
                    continue
                k = np.searchsorted(large, small)
                k[k == len(large)] = 0
                both = int((large[k] == small).sum())
                ok.append(100 * both >= percent * (len(p) + len(q) - both))
            m = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(m), batch.column(1).filter(m)], names=["a", "b"])

    parts = pairs.groupBy("a").agg(F.count(F.lit(1)).alias("m")).select(
        "a",
        F.explode(F.sequence(F.lit(0), F.floor(F.col("m") / 100).cast("int"))).alias("part"),
        F.floor(F.col("m") / 100).cast("int").alias("parts"),
    )
    left = parts.join(sets.withColumnRenamed("cls", "a"), "a").select("a", "part", F.col("items").alias("x"))
    share = pairs.join(parts.where("part = 0").select("a", "parts"), "a").withColumn(
        "part",
        F.pmod(F.xxhash64("b"), F.col("parts") + 1).cast("int"),
    )
    right = share.select("a", "part", "b").join(sets.select(F.col("cls").alias("b"), F.col("items").alias("y")), "b")
    both = right.join(left, ["a", "part"]).select("a", "b", "x", "y")
    return both.mapInArrow(lean(run), "a binary, b binary")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """cls, comp for each of ``nodes`` (cls, comp: its label so far, a class): the smallest label along ``links`` (a, b)."""
    # links between labels are enough: nodes with one label stay together
    by = nodes.select("cls", "comp")
    ends = links.join(
        by.select(F.col("cls").alias("a"), F.col("comp").alias("p")),
        "a",
    ).join(by.select(F.col("cls").alias("b"), F.col("comp").alias("q")), "b").where("p <> q").select("p", "q")
    edges = materialise(
        ends.select(F.col("p").alias("u"), F.col("q").alias("v")).unionByName(
            ends.select(F.col("q").alias("u"), F.col("p").alias("v"))
        ).distinct(),
        "edges",
    )
    low = materialise(edges.groupBy("u").agg(F.min("v").alias("near")).select("u", F.least("u", "near").alias("l")), "labels")
    while True:
        up = low.select(F.col("u").alias("v"), F.col("l").alias("lv"))
        near = edges.join(up, "v").groupBy("u").agg(F.min("lv").alias("ln"))
        new = low.join(near, "u", "left").select("u", F.least("l", F.coalesce("ln", "l")).alias("l2"), "l")
        jump = low.select(F.col("u").alias("l2"), F.col("l").alias("lj"))
        new = materialise(
            new.join(jump, "l2", "left").select(
                "u",
                F.least("l2", F.coalesce("lj", "l2")).alias("l"),
                (F.least("l2", F.coalesce("lj", "l2")) != F.col("l")).alias("moved"),
            ),
            "labels",
        )
        discard(low)
        low = new.select("u", "l")
        moved = not new.where("moved").isEmpty()
        low._gapline_path = new._gapline_path
        if not moved:
            break
    out = materialise(
        by.join(low.withColumnRenamed("u", "comp"), "comp", "left").select("cls", F.coalesce("l", "comp").alias("comp")),
        "comp",
    )
    discard(edges)
    discard(low)
    return out


def block_links(items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """Links that tie together the components of sets with enough overlap."""
    n = np.array([len(x) for x in items], np.int64)
    if len(items) == 2:
        both = len(np.intersect1d(items[0], items[1], assume_unique=True))
        overlap = np.array([[n[0], both], [both, n[1]]], float)
    else:
        token, inverse, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
        place = np.cumsum(count > 1) - 1
        row, shared = np.repeat(np.arange(len(items)), n), count[inverse] > 1
        row, col = row[shared], place[inverse[shared]]
        overlap = np.zeros((len(items), len(items)))
        for a in range(0, int((count > 1).sum()), 4096):
            part = (col >= a) & (col < a + 4096)
            x = np.zeros((len(items), 4096), np.float32)
            x[row[part], col[part] - a] = 1
            overlap += x @ x.T
    near = 100 * overlap >= percent * (n[:, None] + n[None, :] - overlap) - 1e-6
    links, left = [], set(range(len(items)))
    while left:
        queue = [left.pop()]
        while queue:
            k = queue.pop()
            for q in [q for q in np.flatnonzero(near[k]).tolist() if q in left]:
                left.discard(q)
                queue.append(q)
                links.append((k, q))
    return links


def prefix_links(items: list[np.ndarray], percent: int) -> list[tuple[int, int]]:
    """The same for many sets, by prefix filter; pairs within a component found so far aren't compared."""
    n = np.array([len(x) for x in items], np.int64)
    token, inverse, count = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    rank = np.empty(len(token), np.int64)
    rank[np.lexsort((token, count))] = np.arange(len(token))
    ranks, common = rank[inverse], count[inverse] > 1
    own, ends = [], np.cumsum(n)
    filed: list[tuple[np.ndarray, np.ndarray]] = []
    for k, e in enumerate(ends.tolist()):
        order = np.argsort(ranks[e - n[k] : e])
        r, c = ranks[e - n[k] : e][order], common[e - n[k] : e][order]
        own.append(np.sort(r))
        head = int(n[k]) - -(-int(n[k]) * percent // 100) + 1
        at = np.flatnonzero(c[:head])
        filed.append((r[at], at))
    sizes = [len(r) for r, _ in filed]
    key, who, place = np.concatenate([r for r, _ in filed]), np.repeat(np.arange(len(items)), sizes), np.concatenate([a for _, a in filed])
    order = np.argsort(key, kind="stable")
    key, who, place = key[order], who[order], place[order]
    comp, links = np.arange(len(items)), []
    for k, (r, at) in enumerate(filed):
        lo, hi = np.searchsorted(key, r), np.searchsorted(key, r, "right")
        if not len(r):
            continue
        idx = np.concatenate([np.arange(a, z) for a, z in zip(lo.tolist(), hi.tolist(), strict=True)])
        mine = np.repeat(at, hi - lo)
        q = who[idx]
        bound = np.minimum(n[k] - mine, n[q] - place[idx])  # overlap from this shingle on, at most
        for y in np.unique(q[(q > k) & (comp[q] != comp[k]) & ((100 + percent) * bound >= percent * (n[k] + n[q]))]).tolist():
            if comp[y] != comp[k]:
                both = len(np.intersect1d(own[k], own[y], assume_unique=True))
                if 100 * both >= percent * (n[k] + n[y] - both):
                    links.append((k, y))
                    comp[comp == comp[y]] = comp[k]
    return links


def links_in_blocks(sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) within each group of ``sets`` (comp, cls, items); the groups are small."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        comp, cls, items = None, [], []

        def done() -> pa.RecordBatch:
            found = (block_links if len(items) <= GROUP else prefix_links)(items, percent)
            return pa.RecordBatch.from_arrays(
                [pa.array([cls[x] for x, _ in found], pa.binary()), pa.array([cls[y] for _, y in found], pa.binary())],
                names=["a", "b"],
            )

        for batch in batches:
            for c, k, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                if c != comp:
                    if len(items) > 1:
                        yield done()
                    comp, cls, items = c, [], []
                cls.append(k)
                items.append(np.frombuffer(x, U))
        if len(items) > 1:
            yield done()

    n = max(1, int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return sets.select("comp", "cls", "items").repartition(n, "comp").sortWithinPartitions("comp").mapInArrow(
        lean(run),
        "a binary, b binary",
    )


def prefixes(sets: DataFrame, percent: int) -> DataFrame:
    """key, cls, deg, n, pos: the filed shingles of each set of ``sets`` (comp, cls, items), with their place in its order by rarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for c, k, x in zip(*(col.to_pylist() for col in batch.columns), strict=True):
                t = np.frombuffer(x, np.int64)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([c] * len(t), pa.binary()),
                        pa.array([k] * len(t), pa.binary()),
                        pa.array(np.full(len(t), len(t))),
                        pa.array(t),
                    ],
                    names=["comp", "cls", "n", "token"],
                )

    rows = sets.select("comp", "cls", "items").mapInArrow(
        lean(run),
        "comp binary, cls binary, n long, token long",
    ).withColumn("key", F.xxhash64("comp", "token")).select("key", "cls", "n")
    rows = materialise(rows, "tokens")
    often = rows.groupBy("key").agg(F.count(F.lit(1)).alias("f"))
    placed = rows.join(often, "key").withColumn("pos", F.row_number().over(Window.partitionBy("cls").orderBy("f", "key")))
    need = F.ceil(F.col("n") * percent / 100.0 - 1e-9)  # the least overlap with any partner
    filed = placed.where((F.col("f") > 1) & (F.col("pos") <= F.col("n") - need + 1))
    most = filed.groupBy("cls").agg(F.sum("f").alias("deg"))
    out = materialise(filed.join(most, "cls").select("key", "cls", "deg", "n", "pos"), "members")
    discard(rows)
    return out


def join_large(sets: DataFrame, percent: int) -> DataFrame:
    """cls, comp of the classes of ``sets`` (comp, cls, items), by links among those of one group."""
    member = prefixes(sets, percent)
    nodes = materialise(sets.select("cls", F.col("cls").alias("comp")), "comp")
    tested: DataFrame | None = None  # (key, cls) that were compared with all of their bucket
    for turn in range(STAR_ROUNDS + 1):
        now = member.join(nodes, "cls")
        now = now.withColumn("was", F.lit(None).cast("boolean")) if tested is None else now.join(
            tested.withColumn("was", F.lit(True)),
            ["key", "cls"],
            "left",
        )
        now = materialise(now.select("key", "cls", "deg", "n", "pos", "comp", F.coalesce("was", F.lit(False)).alias("was")), "now")
        per = now.groupBy("key", "comp").agg(
            F.count(F.lit(1)).alias("c"),
            F.max(F.when(~F.col("was"), F.struct("deg", "cls", "n", "pos"))).alias("best"),
        )
        # the bucket's largest component needs no turn: a pair across components has an end outside it
        sizes = per.groupBy("key").agg(F.max(F.struct("c", "comp")).alias("top"), F.count(F.lit(1)).alias("comps")).where("comps > 1")
        if turn == 0:
            pivot = now.groupBy("key").agg(
                F.max(F.struct("deg", "cls", "n", "pos", "comp")).alias("p")
            ).select("key", "p.cls", "p.n", "p.pos", "p.comp")
        elif turn < STAR_ROUNDS:
            outer = per.join(sizes, "key").where((F.col("comp") != F.col("top.comp")) & F.col("best").isNotNull())
            pivot = outer.groupBy("key").agg(F.max(F.struct("best", "comp")).alias("p")).select(
                "key",
                "p.best.cls",
                "p.best.n",
                "p.best.pos",
                "p.comp",
            )
        else:
            pivot = now.join(sizes, "key").where(
                (F.col("comp") != F.col("top.comp")) & ~F.col("was")
            ).select("key", "cls", "n", "pos", "comp")
        pivot = materialise(pivot.toDF("key", "a", "na", "pa", "ca"), "pivots")
        if pivot.isEmpty():
            break
        other = now.where("not was").select(
            F.col("key").alias("k"),
            F.col("cls").alias("b"),
            F.col("n").alias("nb"),
            F.col("pos").alias("pb"),
            F.col("comp").alias("cb"),
        )
        bound = 1 + F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))  # overlap from this shingle on, at most
        enough = (100 + percent) * bound >= percent * (F.col("na") + F.col("nb"))
        pairs = pivot.join(other, (F.col("key") == F.col("k")) & (F.col("ca") != F.col("cb")) & enough).select("a", "b")
        if turn == STAR_ROUNDS:  # both ends may be pivots here: each pair once
            pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        pairs = materialise(pairs.distinct(), "pairs")
        links = materialise(confirm(pairs, sets.select("cls", "items"), percent), "links")
        new = components(nodes, links)
        for x in (nodes, pairs, links, now):
            discard(x)
        nodes = new
        was = pivot.select("key", F.col("a").alias("cls"))
        tested = was if tested is None else tested.unionByName(was)
    return nodes


def groups(docs: DataFrame, size: int = 5, percent: int = 80, bands: int = 20, rows: int = 4, group_items: int = GROUP_ITEMS) -> DataFrame:
    """doc_id, n_shingles, component_id (smallest doc_id of the group), kept (doc_id = component_id), th (xxhash64 of the text) and first for each row of ``docs``
    (doc_id, text). ``first`` marks one pair of an id and a text in each group, so it tells rows apart that share an id or have none."""
    if rows % 2:
        raise ValueError("rows is even: minima and maxima come in pairs")
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    signed = materialise(sign(own, size, bands, rows), "signed")
    known = signed.where("n > 0").withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID)))
    rep = known.groupBy("cls").agg(F.min(F.struct("doc_id", "th")).alias("rep"), F.first("band").alias("band"))
    rep = materialise(rep.select("cls", F.col("rep.doc_id").alias("doc_id"), F.col("rep.th").alias("th"), "band"), "classes")

    flat = rep.select("cls", F.explode("band").alias("key"))
    tied = flat.groupBy("key").agg(F.min("cls").alias("a"), F.max("cls").alias("z")).where("a <> z").select("key", "a")
    ties = materialise(flat.join(tied, "key").where("a <> cls").select("a", F.col("cls").alias("b")).distinct(), "ties")
    ends = ties.select(F.col("a").alias("cls")).unionByName(ties.select(F.col("b").alias("cls"))).distinct()
    candidates = components(ends.withColumn("comp", F.col("cls")), ties)
    discard(ties)

    need = rep.join(candidates, "cls").select("cls", "comp", "doc_id", "th")
    texts = own.withColumn("doc_id", F.coalesce("doc_id", F.lit(NO_ID))).join(need, ["doc_id", "th"])
    sets = sets_of(texts.select("cls", "text"), size).dropDuplicates(["cls"])
    sets = materialise(sets.join(candidates, "cls"), "sets")
    large = sets.groupBy("comp").agg(
        F.count(F.lit(1)).alias("m"),
        F.sum(F.octet_length("items") / 8).alias("t"),
    ).where((F.col("t") > group_items) & (F.col("m") > 2))
    large = materialise(large.select("comp", F.lit(True).alias("large")), "large")
    sets = sets.join(large, "comp", "left")
    small = sets.where("large is null")
    links = materialise(links_in_blocks(small, percent), "links")
    nodes = components(small.select("cls", F.col("cls").alias("comp")), links)
    discard(links)
    if not large.isEmpty():
        nodes = nodes.unionByName(join_large(sets.where("large"), percent))

    label = rep.join(nodes, "cls", "left").select("cls", F.struct("doc_id", "th").alias("own"), F.coalesce("comp", "cls").alias("comp"))
    smallest = label.groupBy("comp").agg(F.min("own").alias("lead"))
    label = label.join(smallest, "comp").select("cls", "lead")
    # sets without shingles are one key and linked with nothing: they take no part in the join
    some = signed.where("n > 0").select("doc_id", "th", "n", "cls").join(label, "cls").drop("cls")
    none = signed.where("n = 0").select(
        "doc_id",
        "th",
        "n",
        F.struct(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), "th").alias("lead"),
    )
    out = some.select("doc_id", "th", "n", "lead").unionByName(none)
    first = (F.coalesce("doc_id", F.lit(NO_ID)) == F.col("lead.doc_id")) & (F.col("th") == F.col("lead.th"))
    component = F.nullif("lead.doc_id", F.lit(NO_ID))
    out = out.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), "th", first.alias("first"))
    return out.select(
        "doc_id",
        "n_shingles",
        "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"),
        "th",
        "first",
    )
