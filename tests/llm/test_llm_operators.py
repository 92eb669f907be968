"""Each corpus operator against a brute-force version, and on nulls, empty tables, repeated rows and clashing columns."""

import collections
import hashlib
import itertools
import os
import random
import re
import zlib

import numpy as np
import pytest
from gapline.llm import chat, decontam, htmltext, language, lmscore, media, neardup, packing, substrings, textbytes, urlfilter
from pyspark.sql import functions as F

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
#: doc_id, text, and columns whose names operators use inside
SCHEMA = "doc_id long, text string, lang string, row long, band string, tk string, score double"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "en", 1, "x", "y", 0.5) for i, t in rows], SCHEMA)


def words(rng, n, vocab=400):
    return [f"w{rng.randrange(vocab)}" for _ in range(n)]


@pytest.fixture(scope="module")
def rows():
    """Copies, near copies, shared passages, short, empty, null, long and non-ASCII texts; a repeated row."""
    rng = random.Random(5)
    base = words(rng, 120)
    out = [" ".join(base)] * 3 + [" ".join(words(rng, 90)) for _ in range(10)]
    for k in range(12):
        near = list(base)
        for _ in range(rng.randrange(1, 9)):
            near[rng.randrange(len(near))] = f"n{k}{rng.randrange(99)}"
        out.append(" ".join(near))
    passage = " ".join(words(rng, 60))
    out += [" ".join(words(rng, 30)) + " " + passage + " " + " ".join(words(rng, 30)) for _ in range(6)]
    out += [
        "",
        None,
        "one two",
        "One TWO",
        "\u00e9t\u00e9 \u00e9t\u00e9",
        "a" * 700,
        "ab" * 300,
        "\u00e9" * 500,
        "12 34 !!",
        "   \n\t",
        " ".join(words(rng, 4000)),
    ]
    return list(enumerate(out)) + [(3, out[3]), (None, "no id but some words in here"), (None, None)]


def shingle_set(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


@pytest.mark.parametrize("group", [2_000_000, 300])
def test_neardup(spark, rows, group):
    sets = {(i, t): shingle_set(t) for i, t in rows}
    parent = {k: k for k in sets}

    def find(k):
        while parent[k] != k:
            k = parent[k]
        return k

    order = lambda k: (k[0] is None, k[0] or 0, k[1] or "")
    for a, b in itertools.combinations(sorted(sets, key=order), 2):
        both = len(sets[a] & sets[b])
        if sets[a] and sets[b] and 100 * both >= 85 * len(sets[a] | sets[b]):
            x, y = sorted((find(a), find(b)), key=order)
            parent[y] = x
    want = collections.Counter((i, len(sets[i, t]), find((i, t))[0], find((i, t))[0] == i) for i, t in rows)
    got = neardup.groups(frame(spark, rows), percent=85, group_items=group).collect()
    assert collections.Counter((r.doc_id, r.n_shingles, r.component_id, r.kept) for r in got) == want
    leaders = collections.Counter(find(k) for k in sets if sets[k])
    assert len({(r.doc_id, r.th) for r in got if r.first and r.n_shingles}) == len(leaders)
    assert neardup.groups(frame(spark, []), percent=85).count() == 0


@pytest.mark.parametrize("group", [2_000_000, 300])
def test_neardup_chain(spark, group):
    """Links that no single pivot shows: each text is near the next one only."""
    rng = random.Random(2)
    text = words(rng, 150, 10**6)
    chain = []
    for k in range(25):
        text = list(text)
        text[(k * 37) % 150] = f"x{k}"
        text[(k * 37 + 75) % 150] = f"y{k}"
        chain.append((100 - k, " ".join(text)))
    got = {r.doc_id: r.component_id for r in neardup.groups(frame(spark, chain), percent=85, group_items=group).collect()}
    assert set(got.values()) == {76}


def test_neardup_blocks():
    """Both ways of a block give the components of all pairs."""
    rng = np.random.default_rng(3)
    for _ in range(20):
        base = rng.integers(0, 10**6, 60)
        sets = []
        for _ in range(40):
            x = base.copy()
            k = rng.integers(0, 9)
            x[rng.integers(0, 60, k)] = rng.integers(0, 10**6, k)
            sets.append(np.unique(x).astype(np.uint64))
        parts = []
        for links in (neardup.block_links(sets, 85), neardup.prefix_links(sets, 85)):
            comp = list(range(40))
            for a, b in links:
                comp = [comp[a] if c == comp[b] else c for c in comp]
            parts.append([comp.index(c) for c in comp])
        comp = list(range(40))
        for a, b in itertools.combinations(range(40), 2):
            both = len(np.intersect1d(sets[a], sets[b]))
            if 100 * both >= 85 * (len(sets[a]) + len(sets[b]) - both):
                comp = [comp[a] if c == comp[b] else c for c in comp]
        assert parts == [[comp.index(c) for c in comp]] * 2


def brute_cut(texts, depth=200):
    raw = [(t or "").encode() for t in texts]
    seen = collections.Counter(t[i : i + depth] for t in raw for i in range(len(t) - depth + 1))
    out = []
    for t in raw:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - depth + 1):
            if seen[t[i : i + depth]] > 1:
                gone[i : i + depth] = True
        spans = int((np.diff(gone.astype(int), prepend=0) == 1).sum())
        out.append((len(t), int(gone.sum()), spans, bytes(b for b, g in zip(t, gone, strict=True) if not g)))
    return out


@pytest.mark.parametrize("most", [20_000, 1, 0])
def test_substrings(spark, rows, most):
    want = collections.Counter((i, *x) for (i, _), x in zip(rows, brute_cut([t for _, t in rows]), strict=True))
    out = substrings.remove_repeats(frame(spark, rows), most=most).collect()
    assert collections.Counter(
        (r.doc_id, r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept) if r.kept is not None else (r.text or "").encode()) for r in out
    ) == want
    assert substrings.remove_repeats(frame(spark, [])).count() == 0


@pytest.mark.parametrize("most", [6, 2])
def test_substrings_of_crowded_anchors(spark, most):
    """One gram in many surroundings, some of which agree further than others: its buckets are dealt again, level by level."""
    rng = random.Random(8)
    gram = "".join(rng.choices("abcdefgh", k=64))
    sides = [("".join(rng.choices("ijklmnop", k=150)), "".join(rng.choices("qrstuvwx", k=150))) for _ in range(6)]
    texts = []
    for k in range(60):
        left, right = rng.choice(sides)[0], rng.choice(sides)[1]
        cut = rng.randrange(150)
        left = left[:cut] + rng.choice("0123456789") + left[cut + 1 :]
        texts.append(f"{k} {left}{gram}{right[: rng.randrange(60, 150)]} {k}")
    want = brute_cut(texts)
    assert any(x[1] for x in want) and any(not x[1] for x in want)
    out = substrings.remove_repeats(frame(spark, list(enumerate(texts))), most=most).orderBy("doc_id").collect()
    assert [(r.n_bytes, r.n_removed, r.n_spans, bytes(r.kept) if r.kept is not None else r.text.encode()) for r in out] == want


def test_second_anchors():
    """What a window is filed under depends on the window and its first anchor alone, and is clear of it."""
    rng = random.Random(9)
    ctx = bytes(rng.choices(b"abcd", k=336))
    for sizes, marks, gram in (((64,), [0], 32), ((64, 32), [0, -40], 16), ((64, 32, 16), [0, -40, 70], 8)):
        found = {}
        for a, z in ((0, 137), (20, 100), (60, 61)):
            h, at, s0, s1 = substrings.second_anchors(ctx[a : z + 199], 136 - a, marks, sizes, gram, 200)
            for k in range(len(h)):
                assert all(at[k] + gram <= 136 - a + m or at[k] >= 136 - a + m + w for m, w in zip(marks, sizes, strict=True))
                for w in range(s0[k], s1[k] + 1):
                    assert w <= at[k] <= w + 200 - gram
                    assert found.setdefault(w + a, (h[k], at[k] + a)) == (h[k], at[k] + a)


def test_substrings_as_text(spark, rows):
    for r in substrings.remove_repeats(frame(spark, rows), as_text=True).where("kept is not null").collect():
        assert "\ufffd" not in r.kept and len(r.text.encode()) - len(r.kept.encode()) == r.n_removed


def test_word_hashes_in_segments(monkeypatch):
    """Hashes don't depend on how many bytes are handled at once, also for a word longer than that."""
    texts = [b"One two  three", b"x" * 1000 + b" y", b"", "\u00e9t\u00e9 ".encode() * 100, b"A" * 700]

    def hashes():
        b = textbytes.Block(texts)
        b.words(textbytes.ALNUM)
        return b.word_hashes().tolist()

    want = hashes()
    for size in (64, 100, 999):
        monkeypatch.setattr(textbytes, "SEGMENT", size)
        assert hashes() == want


def test_anchors_of_long_texts(monkeypatch):
    """A long text in overlapping parts files each window as the whole text does."""
    rng = random.Random(12)
    texts = [" ".join(words(rng, n)).encode() for n in (3, 900, 40, 2000)] + [b"ab" * 3000]

    def windows():
        found = set()
        for part, owner, shift in substrings.pieces(texts, 200):
            t, fp, at, s0, s1 = substrings.anchors(textbytes.Block(part), 200)
            for k in range(len(t)):
                move = shift[t[k]]
                found |= {(owner[t[k]], w + move, fp[k], at[k] + move) for w in range(s0[k], s1[k] + 1)}
        return found

    want = windows()
    assert {(d, w) for d, w, *_ in want} == {(d, w) for d, t in enumerate(texts) for w in range(len(t) - 199)}
    monkeypatch.setattr(substrings, "BLOCK_BYTES", 700)
    assert windows() == want


def test_texts_of_50_megabytes():
    """One long text goes through each operator's parser in bounded parts."""
    text = b"some words of a long text, " * (50_000_000 // 27)
    n = 6 * (50_000_000 // 27)
    before, after, doc = lmscore.bigrams([text])
    assert len(after) == len(before) == len(doc) == n and len(np.unique(after)) == 6
    b, h = decontam.parsed([b"short", text])
    assert np.diff(b.first).tolist() == [1, n] and len(h) == n + 1
    shingles, first = neardup.shingle_hashes(textbytes.Block([text]), 5)
    assert first.tolist() == [0, n - 4] and len(np.unique(shingles)) == 6
    parts = list(packing.at_blanks(text, 1 << 20))
    assert b"".join(parts) == text and max(map(len, parts)) <= 1 << 20
    assert sum(len(p[0][0]) - 199 for p in substrings.pieces([text], 200)) == len(text) - 199


def test_difference_cover():
    v = 32
    d = substrings.difference_cover(v)
    assert {(a - b) % v for a in d for b in d} == set(range(v))
    t = substrings.meeting(v)
    assert t.min() >= 0 and all((a + t[a, b]) % v in d and (b + t[a, b]) % v in d for a in range(v) for b in range(v))


def item_words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))


@pytest.mark.parametrize("most", [32 << 20, 0])
def test_decontaminate(spark, most):
    rng = random.Random(9)
    items = [(k, " ".join(words(rng, n, 50))) for k, n in enumerate([30, 13, 5, 1, 40, 13])] + [(6, ""), (7, None), (8, "w1 w2 W3")]
    items.append((9, items[0][1]))
    docs = []
    for k in range(30):
        w = words(rng, rng.randrange(0, 200), 50)
        if k % 2:
            x = item_words(items[rng.randrange(len(items))][1])
            w[5:5] = x[: rng.randrange(1, 41)]
        docs.append((k, (", " if k % 3 else "\n").join(w).upper()))
    docs += [(30, None), (31, ""), (0, docs[0][1]), (0, docs[0][1]), (None, docs[3][1])]
    want = collections.Counter()
    for i, text in docs:
        w = item_words(text)
        hit, found = set(), set()
        for k, it in items:
            x = item_words(it)
            n = min(13, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(k))
        want[i, len(w), len(hit), tuple(sorted(found)), bool(hit) and 20 * len(hit) >= len(w)] += 1
    out = decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"), broadcast_bytes=most)
    assert collections.Counter((r.doc_id, r.n_words, r.n_hit, tuple(r["items"]), r.contaminated) for r in out.collect()) == want


def test_decontaminate_items_without_id(spark):
    passage = " ".join(f"p{k}" for k in range(20))
    items = spark.createDataFrame([(None, passage), (None, "q1 q2"), (4, "q1 q2"), (None, None)], "item_id long, text string")
    docs = [(1, f"a b {passage} c"), (2, "x q1 q2"), (3, "clean")]
    got = {r.doc_id: (r.n_hit, list(r["items"]), r.contaminated) for r in decontam.decontaminate(frame(spark, docs), items).collect()}
    assert got == {1: (20, [], True), 2: (2, ["4"], True), 3: (0, [], False)}


def test_decontaminate_common_words_make_rows_only_with_their_pair(spark):
    """Windows of words that all documents are full of, or that repeat: right, and looked up only where the pair stands."""
    items = [(1, "the cat the"), (2, "na na na na"), (3, "of the"), (4, "the")]
    docs = [(1, "the " * 3000 + "cat"), (2, "cat the cat the"), (3, "na " * 5), (4, "the of of the na na na"), (5, "of cat na")]
    got = {
        r.doc_id: (r.n_hit, list(r["items"]))
        for r in decontam.decontaminate(frame(spark, docs), spark.createDataFrame(items[:3], "item_id long, text string")).collect()
    }
    assert got == {1: (0, []), 2: (3, ["1"]), 3: (5, ["2"]), 4: (2, ["3"]), 5: (0, [])}
    got = decontam.decontaminate(frame(spark, docs[3:]), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(r.doc_id, r.n_hit, tuple(r["items"])) for r in got} == {(4, 3, ("3", "4")), (5, 0, ())}

    h = decontam.parsed([b"the cat of"])[1]
    index = spark.createDataFrame([(int(decontam.pair_hash(h[:1], h[1:2], 1)[0]), int(h[0]))], "key long, word long")
    rows = frame(spark, docs).select("doc_id", F.xxhash64("text").alias("row"), "text")
    found = decontam.look_up(rows, decontam.bitmap(index, "word"), decontam.bitmap(index, "key"), [1], 13).collect()
    assert {r.doc_id: [x.pos for x in r.found] for r in found} == {1: [2999], 2: [1], 3: [], 4: [], 5: []}


def test_decontaminate_empty(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert decontam.decontaminate(frame(spark, [(1, "a b")]), none).collect()[0].n_hit == 0
    assert decontam.decontaminate(frame(spark, []), none).count() == 0


def test_packing(spark, rows):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    odd = [
        (
            900,
            "don't <|endoftext|> <|ENDOFTEXT|> \u0130\u00df \u0391\u03a3. a\u0301 \u00c9.\u00c8!? l'\u00e9t\u00e9 \u2026. x\x01y \x01 3.5",
        ),
        (901, "A" * 5000),
    ]
    out = packing.pack(frame(spark, rows + odd)).collect()
    want = collections.Counter()
    for i, t in rows + odd:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for n in packing.pieces(len(ids), 2048):
            want[i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids), ids[at : at + n].tobytes()] += 1
            at += n
        assert at == len(ids)
    assert collections.Counter((r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens, bytes(r.ids)) for r in out) == want
    assert len({r.sequence_id for r in out}) == len(out) and all(r.length & (r.length - 1) == 0 and r.offset == 0 for r in out)
    assert packing.pack(frame(spark, [])).count() == 0


def test_packing_of_long_texts_and_other_tokenizers(spark, monkeypatch):
    """A text in blocks has the ids of the whole text; a tokenizer that keeps case isn't taken for one that folds it."""
    import public_tokenizers
    from tokenizers import Tokenizer

    monkeypatch.setattr(packing, "BLOCK_BYTES", 64)
    text = " ".join(["Some", "words,and", "x" * 300, "\u00e9t\u00e9's", "<|endoftext|>"] * 40) + " \n"
    enc = packing.CachedEncoder(None)
    assert enc.wordwise and enc.ids([text.encode()])[0].tolist() == enc.tok.encode(text, add_special_tokens=False).ids
    file = public_tokenizers.path("byte_bpe_50k.json")
    tok = Tokenizer.from_file(file)
    texts = [(1, "Hello World, hello world"), (2, None), (3, "A  b"), (4, text)]
    got = packing.pack(spark.createDataFrame(texts, "doc_id long, text string"), file).orderBy("doc_id", "start").collect()
    for i, t in texts:
        assert b"".join(bytes(r.ids) for r in got if r.doc_id == i) == np.array(
            [*tok.encode(t or "", add_special_tokens=False).ids, 1],
            "<u4",
        ).tobytes()


def test_packing_of_plain_words():
    """Plain words need the model alone, words end before symbols, and a worker's next task knows the words of the one before."""
    enc = packing.CachedEncoder(None)
    draw = random.Random(3)
    signs = [*"abstreABXYZ'.-_#$%&*()+/=?@[]{}~^<>|,!09 \n", "\u00e9", "\u00c9", "\u00df", "\u00d7", "\u00f7", "\u0301", "\u0338", "\u0101", "\u0130", "\x01"]
    texts = ["".join(draw.choices(signs, k=draw.randint(0, 60))) for _ in range(3000)] + ["<|endoftext|>-a", "it's-'s", "e\u0301#"]
    ids, at = enc.ids([t.encode() for t in texts])
    for k, t in enumerate(texts):
        assert ids[at[k] : at[k + 1]].tolist() == enc.tok.encode(t, add_special_tokens=False).ids, t
    words = ["thing", "été", "straße", "x" * 300]
    want = [np.array(enc.tok.encode(w, add_special_tokens=False).ids, "<u4").tobytes() for w in words]
    few = packing.CachedEncoder(None)
    few.ids([b"thing### thing$$ THING"])
    assert set(few.young) == {b"thing", b"###", b"$$"}
    enc.tok = None
    assert enc.encode([w.encode() for w in words]) == want
    assert packing.encoder_of(None) is packing.encoder_of(None)


def test_batches_of_one_length(spark, rows):
    """Batches are full but for the last one of a bucket and part; a batch smaller than a sequence holds one."""
    for tokens in (1, 64, 1 << 15):
        out = packing.pack(frame(spark, rows).repartition(3), with_ids=False, batch_tokens=tokens).collect()
        by = collections.defaultdict(list)
        for r in out:
            by[r.batch].append(r.length)
        rest = collections.Counter()
        for name, x in by.items():
            assert len(set(x)) == 1 and sum(x) <= max(tokens, x[0]) and name.startswith(f"{x[0].bit_length() - 1}-")
            rest[name.rpartition("-")[0]] += sum(x) < max(tokens, x[0])
        assert max(rest.values()) <= 1
    with pytest.raises(ValueError):
        packing.pack(frame(spark, rows), batch_tokens=0)


def test_media(spark, rows):
    index = media.store(frame(spark, rows))
    out = media.read_back(index).collect()
    want = collections.Counter()
    for i, t in rows:
        raw = (t or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        want[i, len(raw), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-16:])] += 1
    assert collections.Counter((r.doc_id, r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) for r in out) == want
    by = collections.defaultdict(set)
    for r in out:
        by[r.payload_sha256].add((r.media_bytes, r.media_sha256, r.feature))
    assert all(len(x) == 1 for x in by.values())
    meta = media.with_metadata(index).collect()
    assert len(meta) == len(rows) and all(r.width == 192 and r.depth == 8 and r.colour == 0 and r.height * 192 >= r.n_bytes for r in meta)
    assert media.read_back(media.store(frame(spark, []))).count() == 0


def test_media_shards_are_tar(spark, rows):
    import tarfile

    index = media.store(frame(spark, rows))
    for r in index.select("folder", "shard", "digest").distinct().collect():
        with tarfile.open(f"{r.folder.removeprefix('file://')}/{r.shard}") as t:
            assert hashlib.sha256(t.extractfile(f"{r.digest}.png").read()).hexdigest() == r.digest


def test_language(spark):
    rng = random.Random(1)
    syllables = {"aa": ["ka", "ki", "ko"], "bb": ["str", "ung", "sch"], "cc": ["\u00e9l", "\u00e8re", "eau"]}
    rows = [
        (k, " ".join("".join(rng.choices(syllables[c], k=3)) for _ in range(30)), c)
        for k, c in enumerate(rng.choices(sorted(syllables), k=300))
    ]
    rows += [
        (300, None, "aa"),
        (301, "", "bb"),
        (302, "12 --", "cc"),
        (303, rows[0][1], None),
        (303, rows[0][1], None),
        (None, rows[1][1], "aa"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    out = language.identify(docs, language.fit(docs, language.not_held_out(), landmarks=32)).collect()
    truth = {i: c for i, _, c in rows[:300]}
    held = [r for r in out if r.doc_id in truth and zlib.crc32(str(r.doc_id).encode()) % 4 == 2]
    assert held and sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.97 * len(held)
    assert {r.lang_pred for r in out if r.doc_id in (300, 301, 302)} == {"und"} and all(0 <= r.score <= 1 for r in out)
    assert len(out) == len(rows)
    none = docs.where("false")
    assert language.identify(docs, language.fit(none, F.lit(True))).select("lang_pred").distinct().collect()[0][0] == "und"


def test_language_by_brute_force(spark):
    """Kernel, Nystr\u00f6m map and ridge regression in plain form: sets of n-grams, a matrix root, and least squares."""
    rng = random.Random(6)
    syllables = {"aa": ["ka", "ki", "ko", "str"], "bb": ["str", "ung", "sch"], "cc": ["\u00e9l", "\u00e8re", "eau", "ka"]}
    rows = [
        (k, " ".join("".join(rng.choices(syllables[c], k=3)) for _ in range(8)) + ", 12. END", c)
        for k, c in enumerate(rng.choices(sorted(syllables), k=60))
    ]
    width, max_n, ridge = 1 << 12, 3, 1e-2
    model = language.fit(
        spark.createDataFrame(rows, "doc_id long, text string, lang string"),
        F.lit(True),
        landmarks=12,
        max_n=max_n,
        width=width,
        ridge=ridge,
    )

    def places(text):
        plain = bytes(c + 32 if 65 <= c <= 90 else c if c > 127 or 97 <= c <= 122 else 32 for c in b" " + text.encode() + b" ")
        plain = re.sub(b" +", b" ", plain)
        out = set()
        for n in range(1, max_n + 1):
            for k in range(len(plain) - n + 1):
                code = 0
                for c in plain[k : k + n]:
                    code = (code * 257 + c) % 2**32
                out.add(((code * 2654435761 % 2**32) ^ (n * 0x9E3779B1 & 0xFFFFFFFF)) % width)
        return out

    sets = [places(t) for _, t, _ in rows]
    assert all(
        set(np.flatnonzero(language.presence(t.encode(), max_n, width)).tolist()) == s for (_, t, _), s in zip(rows, sets, strict=True)
    )

    def kernel(a, b):
        return len(a & b) / (len(a) * len(b)) ** 0.5

    marks = [
        next(s for s in sets if np.allclose(model.marks[sorted(s), j], len(s) ** -0.5) and model.marks[:, j].astype(bool).sum() == len(s))
        for j in range(12)
    ]
    mm = np.array([[kernel(a, b) for b in marks] for a in marks])
    values, vectors = np.linalg.eigh(mm)
    phi = np.array([[kernel(a, b) for b in marks] for a in sets]) @ vectors @ np.diag(values**-0.5) @ vectors.T
    y = np.array([[float(c == label) for label in model.labels] for *_, c in rows])
    penalty = (ridge * len(rows) / 100) ** 0.5 * np.eye(12)
    w = np.linalg.lstsq(np.concatenate([phi, penalty]), np.concatenate([y, np.zeros((12, 3))]), rcond=None)[0]
    want = phi @ w
    labels, scores = model.score([t.encode() for _, t, _ in rows])
    assert labels == [model.labels[k] for k in want.argmax(1)]
    assert scores == pytest.approx(np.clip(want.max(1), 0, 1).tolist(), abs=1e-3)


def test_language_learns_every_label(spark):
    rng = random.Random(2)
    alphabet = [chr(0x4E00 + k) for k in range(4000)]
    rows = [
        (3 * k + j, " ".join("".join(rng.choices(alphabet[10 * k : 10 * k + 10], k=3)) for _ in range(20)), f"l{k:03}")
        for k in range(350)
        for j in range(3)
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.fit(docs, F.lit(True))
    assert model.labels == sorted({c for _, _, c in rows}) and model.marks.shape[1] >= 350
    truth = {i: c for i, _, c in rows}
    assert sum(r.lang_pred == truth[r.doc_id] for r in language.identify(docs, model).collect()) >= 0.97 * len(rows)
    with pytest.raises(ValueError, match="labels"):
        language.fit(docs, F.lit(True), fit_rows=600)


def brute_scores(rows, target, mu, top):
    """doc_id -> (words, loss of the target's model, loss of the background's)."""
    import math

    texts = [(i, i in target, item_words(t)) for i, t in rows]
    words = collections.Counter(w for *_, x in texts for w in x)
    total = sum(words.values())
    frequent = {w for w, n in words.items() if n * top >= total}
    rare = [n for w, n in words.items() if w not in frequent]
    share = sum(rare) / len(rare) if rare else 0
    base = {w: mu * ((n if w in frequent else share) + 1) / (total + len(words)) for w, n in words.items()}
    pairs = [list(zip([None, *x], x, strict=False)) for *_, x in texts]
    c = [
        collections.Counter(p for (_, good, _), ps in zip(texts, pairs, strict=True) if good == side for p in ps) for side in (True, False)
    ]
    h = [
        collections.Counter(p[0] for (_, good, _), ps in zip(texts, pairs, strict=True) if good == side for p in ps)
        for side in (True, False)
    ]
    sizes = [sum(x.values()) for x in c]
    scale = [min(sizes) / n if min(sizes) else 1.0 for n in sizes]
    out = collections.defaultdict(lambda: [0, 0.0, 0.0])
    for (i, good, _), ps in zip(texts, pairs, strict=True):
        own, first = collections.Counter(ps), collections.Counter(p[0] for p in ps)
        out[i][0] += len(ps)
        for p in ps:
            for k in (0, 1):
                mine = good == (k == 0)
                cp, ch = c[k][p] - mine * own[p], h[k][p[0]] - mine * first[p[0]]
                out[i][1 + k] -= math.log((scale[k] * cp + base[p[1]]) / (scale[k] * ch + mu))
    return out


@pytest.mark.parametrize(("top", "heavy", "bucket"), [(1 << 17, 1 << 13, 2_000_000), (100, 1, 500), (600, 300, 50), (2, 1, 10)])
def test_lmscore(spark, rows, top, heavy, bucket):
    target = {0, 3, 4, 7}
    want = brute_scores(rows, target, 10.0, top)
    scored = lmscore.score(frame(spark, rows), spark.createDataFrame([(i,) for i in target], "doc_id long"), 10.0, top, heavy, bucket)
    got = {r.doc_id: r for r in scored.collect()}
    assert set(got) == set(want)
    for i, (n, t, b) in want.items():
        assert got[i].n_words == n
        if n:
            assert (
                got[i].loss_target,
                got[i].loss_background,
            ) == (pytest.approx(t / n), pytest.approx(b / n)) and got[i].score == pytest.approx((t - b) / n)
        else:
            assert got[i].score is None


def test_lmscore_edges(spark, rows):
    ids = "doc_id long"
    assert lmscore.score(frame(spark, []), spark.createDataFrame([(1,)], ids)).count() == 0
    for target in ([], [(i,) for i, _ in rows if i is not None]):
        want = brute_scores(rows, {i for (i,) in target}, 100.0, 1 << 17)
        for r in lmscore.score(frame(spark, rows), spark.createDataFrame(target, ids)).collect():
            assert r.score is None or r.score == pytest.approx((want[r.doc_id][1] - want[r.doc_id][2]) / r.n_words)


def test_lmscore_tells_words_that_occur_twice(spark, monkeypatch):
    """However many words there are, one that occurs in two documents is told from another."""
    from gapline.llm import queries

    common = [(k, "the " * 2000) for k in range(100)]
    docs = frame(
        spark,
        [*common, (100, "the aa bb"), (101, "the aa bb"), (102, "the cc dd"), (103, "the cc dd"), (104, "the ee"), (105, "ff ee")],
    )
    target = spark.createDataFrame([(100, 1, 0)], "doc_id long, quality int, toxic int")
    monkeypatch.setattr(queries, "table", lambda spark, sf_dir, name: target if name == "labels" else docs)
    got = {r.doc_id: r for r in queries.op1_lmscore(spark, "").collect()}
    assert len(got) == 106 and got[101].score < got[104].score < min(
        got[k].score for k in (100, 102, 103)
    ) and got[102].score == got[103].score
    assert got[101].keep and not got[103].keep


PAGE = """<!DOCTYPE html><html><head><title>T &amp; t</title><style>p{{}}</style><script>var t="</p><p>no";</script></head><body>
<nav><ul><li><a href="/a">Menu one</a></li></ul></nav><div class="cookie-notice">We use cookies, accept them all now please</div>
{0}<footer>&copy; footer words here</footer></body></html>"""


def test_html(spark):
    body = "<h1>Title  of\n it</h1><p>First <b>bold</b> para &lt;x&gt; &eacute;&#233;.</p><div class='ad'>buy this now, buy this now</div><p>Second para<br>goes on here with words"
    want = "Title of it\nFirst bold para <x> \u00e9\u00e9.\nSecond para goes on here with words"
    pages = [
        (1, "u", PAGE.format(f"<article>{body}</article>")),
        (
            2,
            "u",
            PAGE.format(f"<div class=post>{body}</div><section id=comments><p>nice one I liked it very much thanks a lot</p></section>"),
        ),
        (3, None, None),
        (4, "u", ""),
        (5, "u", "plain words only"),
        (6, "u", PAGE.format(f"<article>{body}<form><input>mail me</form></article>")[:-30] + "<p"),
        (1, "u", PAGE.format(f"<article>{body}</article>")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = htmltext.main_text(df, htmltext.learn(df)).collect()
    text = {r.page_id: r.text for r in got}
    assert len(got) == 7 and all(r.n_chars == len(r.text) for r in got)
    assert text == {1: want, 2: want, 3: "", 4: "", 5: "plain words only", 6: want}
    assert htmltext.main_text(df.where("false"), htmltext.learn(df.where("false"))).count() == 0


@pytest.mark.parametrize(
    "around",
    [
        "<body class='no-sidebar'>{}",
        "<body class='comments-open'>{}",
        "<body id=comments>{}",
        "<body><div class='layout has-sidebar'>{}</div>",
        "<body><div id='header-wrap'>{}</div>",
        "<body><div class=comments-wrap>{}</div>",
    ],
)
@pytest.mark.parametrize("inside", ["{}", "<article>{}</article>", "<main>{}</main>"])
def test_html_names_of_layouts_are_no_zones(around, inside):
    w = htmltext.BARE
    text = "Words of the page, more of them and some more to be sure"
    assert htmltext.extract(
        "<html>" + around.format(inside.format(f"<p>{text}</p><div class='site-footer cookie-notice'>no no no</div>")),
        w,
    ) == text


def test_html_articles_leave_outside_zones_only_if_all_are_in_one():
    w = htmltext.BARE
    text = "Words of the page, more of them and some more to be sure"
    for zone in ("<form>{}</form>", "<div class=header>{}</div>", "<section id=comments>{}</section>"):
        assert htmltext.extract(zone.format(f"<p>not this</p><article><p>{text}</p></article>"), w) == text
    assert htmltext.extract(f"<article><p>{text}</p></article><section id=comments><article>nice one</article></section>", w) == text
    assert htmltext.extract(
        f"<div class=header><article><p>{text}</p></article></div><section id=comments><article class=comment>nice one</article></section>",
        w,
    ) == text


def test_html_names_beyond_those_sent(spark):
    """Each of 1,200 tags has its own weight, and so have names: those seen beside articles on enough pages are outside, wherever they stand."""
    tail = "after it words go on and on to the end of this page so that they count"
    n = 1200
    labelled = "<article>" + "".join(f"<x-{k}>w</x-{k}>" * 3 for k in range(n)) + "</article>" + "".join(
        f"<y-{k}>w</y-{k}>" * 4 for k in range(20)
    )
    pages = [(0, "u", labelled)] + [
        (k + 1, "u", f"<div>{tail}" + f"<x-{k}></x-{k}>" * 5 + f"{tail}</div>") for k in range(0, n, 50)
    ] + [(9999, None, None)]
    pages += [(10_000 + k, "u", f"<div class=qqq>Menu {k}</div><article><p>{tail}</p></article>") for k in range(60)]
    pages += [
        (20_000, "u", f"<div><p>{tail}</p><div class='x qqq'>not this</div><p>{tail}</p></div>"),
        (20_001, "u", f"<article><p>{tail}</p><ul id=QQQ><li>no</ul><p>{tail}</p></article>"),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    for kept in (1000, 30, 10**6):
        got = {r.page_id: r.text for r in htmltext.main_text(df, htmltext.learn(df, kept)).collect()}
        assert len(got) == len(pages) and got.pop(9999) == "" and got.pop(0)
        assert {got.pop(k) for k in (20_000, 20_001)} == {f"{tail}\n{tail}"}
        assert {got.pop(10_000 + k) for k in range(60)} == {tail}
        assert {t.count(tail) for t in got.values()} == {2}


def test_html_region_decides():
    text = "Words of the page, more of them and some more to be sure"
    page = f"<article class='post has-header-image with-comments'><p>{text}</p></article><div class='site-info'>Copyright by all of us for ever and ever</div>"
    assert htmltext.extract(page, htmltext.BARE) == text != htmltext.extract(page, htmltext.BARE, whole=True)
    menu = "<div class=m1><ul>" + "<li><a href=/>Go</a></li>" * 9 + "</ul></div>"
    page = f"{menu}<div class=story><p>{text}</p><p>{text} <a href=x>with a link</a> in it</p><ul><li>one</li></ul></div>{menu}"
    assert htmltext.extract(page, htmltext.BARE) == f"{text}\n{text} with a link in it" != htmltext.extract(page, htmltext.BARE, whole=True)
    assert htmltext.extract(
        f"<article><p>{text} <a href=x>and links</a></p><ul><li>one</li></ul></article>",
        htmltext.BARE,
    ) == f"{text} and links\none"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_html_query_on_pages_by_brute_force(spark):
    """Held-out word F1, and every text of the sample pages, whose articles are cut out by hand; the region decides on all of them."""
    import html

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")

    def want(page):
        body = re.search(r"<article>(.*?)</article>", page, re.S)[1].replace("<br>", " ").replace("<b>", "").replace("</b>", "")
        return "\n".join(b for b in (" ".join(html.unescape(x).split()) for x in re.split(r"<[^>]*>", body)) if b)

    train, test = rows.where("page_id % 2 = 0"), rows.where("page_id % 2 = 1")
    w = htmltext.learn(train)
    same = both = mine = theirs = 0
    pages = test.collect()
    for r in pages:
        got, truth = collections.Counter(htmltext.extract(r.html, w).split()), collections.Counter(want(r.html).split())
        both, mine, theirs = both + (got & truth).total(), mine + got.total(), theirs + truth.total()
        same += htmltext.extract(r.html, w, whole=True) == htmltext.extract(r.html, w)
    assert 2 * both / (mine + theirs) > 0.99 and same == 0
    assert all(
        r.text == want(h.html)
        for h, r in zip(
            rows.orderBy("page_id").collect(),
            htmltext.main_text(rows, htmltext.learn(rows)).orderBy("page_id").collect(),
            strict=True,
        )
    )


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_html_weights_carry_over_to_pages_without_articles(spark):
    """Learnt where articles are marked, applied where the same pages mark none; pages that aren't among those learnt from."""
    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").select("page_id", "url", "html")
    w = htmltext.learn(rows.where("page_id % 2 = 0"))
    same = both = mine = theirs = n = 0
    for r in rows.where("page_id % 2 = 1").collect():
        bare = re.sub(r"(</?)article\b", r"\1div", r.html)
        got, want = htmltext.extract(bare, w), htmltext.extract(r.html, w)
        x, y = collections.Counter(got.split()), collections.Counter(want.split())
        both, mine, theirs = both + (x & y).total(), mine + x.total(), theirs + y.total()
        same, n = same + (got == want), n + 1
    assert 2 * both / (mine + theirs) >= 0.95 and same >= 0.95 * n


@pytest.mark.parametrize(
    "name",
    "post-comments comments-area reader-comments blog-sidebar share-buttons cookie-notice-wrapper ad-container comment-thread user-comments commentlist".split(),
)
def test_html_zones_by_a_part_of_their_name(name):
    text = "Words of the page, more of them and some more to be sure"
    zone = f"<div class='{name}'><p>LEAKED words, of which there are some</p></div>"
    for page in ("<article><p>{0}</p>{1}<p>{0}</p></article>", "<div class=content><p>{0}</p><p>{0}</p></div>{1}", "<div><p>{0}</p>{1}<p>{0}</p></div>"):
        assert htmltext.extract(page.format(text, zone), htmltext.BARE) == f"{text}\n{text}"


def test_html_what_stands_between_articles_is_left_out():
    text = "Words of the page, more of them and some more to be sure"
    page = f"<article><p>{text}</p></article><p>in between</p><article><p>{text}</p></article>"
    assert htmltext.extract(page, htmltext.BARE) == f"{text}\n{text}"
    for name in ("entry-header", "has-sidebar", "ad-free", "commentary", "sidebar-layout"):
        assert htmltext.extract(f"<article><div class='{name}'><h1>Title</h1></div><p>{text}</p></article>", htmltext.BARE) == f"Title\n{text}"


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no tables")
def test_html_empty_table_of_pages_as_a_query(spark, tmp_path):
    from gapline.llm import queries

    spark.read.parquet("/root/testdata/sf0.001/pages.parquet").limit(0).write.parquet(f"{tmp_path}/pages.parquet")
    assert queries.op2_html(spark, str(tmp_path)).count() == 0


def _same_model(a, b):
    return a.labels == b.labels and np.array_equal(a.marks, b.marks) and np.allclose(a.weights, b.weights)


@pytest.mark.parametrize("ids", ["null", "one", "few"])
def test_language_with_null_and_repeated_ids(spark, ids):
    """Thousands of rows with one id or none, some of them repeated: every label takes part, whatever the partitioning."""
    rng = random.Random(9)
    text = {lang: [f"{lang}{k} word of{k % 7} {lang * 3} the{k % 11}" for k in range(800)] for lang in ("aa", "bb", "cc")}
    rows = []
    for lang, n in (("aa", 6000), ("bb", 3500), ("cc", 5)):
        for k in range(n):
            rows.append(({"null": None, "one": 7, "few": k % 3}[ids], text[lang][k % (800 if lang != "bb" else 2)], lang))
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = [language.fit(d, F.lit(True), fit_rows=60, landmarks=16, width=1 << 10) for d in (docs.repartition(1), docs.repartition(7, "text"))]
    assert models[0].labels == ["aa", "bb", "cc"] and _same_model(*models)
    got = language.identify(docs, models[0]).groupBy("lang_pred").count().collect()
    assert sum(r["count"] for r in got) == len(rows) and {r.lang_pred for r in got} == {"aa", "bb", "cc"}


def test_language_empty_table_long_texts_and_clashing_columns(spark):
    kind = "doc_id long, text string, lang string, lang_pred int, score string, k string, draw int, below int, rank int"
    rows = [(i, ("le chat " if i % 2 else "the dog ") * (200_000 if i < 2 else 30), "fr" if i % 2 else "en", 1, "x", "k", 1, 2, 3) for i in range(20)]
    docs = spark.createDataFrame(rows, kind)
    model = language.fit(docs, F.lit(True))
    assert {(r.doc_id % 2, r.lang_pred) for r in language.identify(docs, model).collect()} == {(0, "en"), (1, "fr")}
    tagged = language.tag(docs, model)
    assert sorted(tagged.columns) == sorted(docs.columns) and {(r.doc_id % 2, r.lang_pred, r.k, r.rank) for r in tagged.collect()} == {(0, "en", "k", 3), (1, "fr", "k", 3)}
    none = docs.limit(0)
    assert language.identify(none, language.fit(none, F.lit(True))).count() == 0 == language.tag(none, model).count()


def test_best_region_by_brute_force():
    rng = random.Random(3)
    for _ in range(200):
        x = [rng.choice([-3, -1, 0, 1, 2]) for _ in range(rng.randrange(1, 15))]
        a, z = htmltext.best_region(x)
        assert sum(x[a:z]) == max(0, max(sum(x[i:j]) for i in range(len(x)) for j in range(i + 1, len(x) + 1)))


RULES = (
    ("allow", "org", "/"),
    ("block", "example.org", "/es/"),
    ("block", "example.org", "/en/1"),
    ("allow", "com", "/fr/"),
    ("block", "com", "/de/"),
)


def test_urls(spark):
    urls = [
        "http://A.Example.org/es/1",
        "https://example.org/en/12?x#y",
        "http://example.org",
        "http://badexample.org/en/1",
        "http://x.com/fr/",
        "http://x.com/de/9",
        "http://good.net/a",
        "http://bad.net/b",
        "http://\u00c4B.net:80/p?q",
        None,
        "no scheme",
        "://",
        "http://h?x://y/z",
        "http://co.uk/a",
        "http://a.b.co.uk/a",
    ]
    pages = [(k, u) for k, u in enumerate(urls)] + [
        (100 + k, "http://good.net/x") for k in range(40)
    ] + [(200 + k, "http://bad.net/x") for k in range(40)]
    labels = [(100 + k, 1, 0) for k in range(40)] + [(200 + k, 0, 1) for k in range(40)] + [(200, 1, 0), (None, 1, 0), (101, None, None)]
    df = spark.createDataFrame(pages, "page_id long, url string").withColumn("verdict", F.lit("clash"))
    got = {r.page_id: r for r in urlfilter.judge(df, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), RULES).collect()}
    assert len(got) == len(pages)
    for k, u in enumerate(urls):
        rest = u.split("://", 1)[1] if u and "://" in u else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host) :], maxsplit=1)[0]
        host = host.translate(LOWER)
        fit = [r for r in RULES if (host == r[1] or host.endswith("." + r[1])) and path.startswith(r[2])]
        best = max(fit, key=lambda r: len(r[1] + r[2])) if fit else None
        assert (got[k].host, got[k].path, got[k].rule) == (host, path, best[1] + best[2] if best else None)
        if best:
            assert got[k].verdict == best[0]
    assert (got[6].verdict, got[7].verdict, got[9].verdict, got[10].verdict) == ("allow", "block", "block", "block")
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert urlfilter.judge(df, none, RULES).count() == len(pages) and urlfilter.judge(df.where("false"), none).count() == 0


def test_url_posterior(spark):
    """The integral against exact sums of a binomial: for whole numbers, P(beta(a, b) >= x) = P(binomial(a + b - 1, x) < a)."""
    import math

    shapes = [(a, b) for a in (1, 2, 5, 40, 700) for b in (1, 3, 10, 300)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in shapes], "a double, b double")
    for x in (0.3, 0.5, 0.9):
        for r in df.withColumn("m", urlfilter.mass_above(F.col("a"), F.col("b"), x)).collect():
            n = int(r.a + r.b) - 1
            want = sum(
                math.exp(math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(x) + (n - k) * math.log(1 - x))
                for k in range(int(r.a))
            )
            assert r.m == pytest.approx(want, abs=2e-4)


def test_url_suffixes(spark):
    hosts = spark.createDataFrame(
        [(h,) for h in ("a.b.co.uk", "co.uk", "x.site.example.com:80", "example.com", "a.blog.net", "h", "9.example.org.nz", "")],
        "host string",
    )
    own = hosts.withColumn("suffix", urlfilter.suffix_of(F.col("host"))).withColumn(
        "domain",
        urlfilter.domain_of(F.col("host"), F.col("suffix")),
    )
    assert {r.host: (r.suffix, r.domain) for r in own.collect()} == {
        "a.b.co.uk": ("co.uk", "b.co.uk"), "co.uk": ("co.uk", "co.uk"), "x.site.example.com:80": (
            "com",
            "example.com",
        ), "example.com": ("com", "example.com"),
        "a.blog.net": ("net", "blog.net"), "h": ("h", "h"), "9.example.org.nz": ("org.nz", "example.org.nz"), "": ("", ""),
    }
    listed = urlfilter.with_suffixes(hosts, spark.createDataFrame([("blog.net",), ("example.com",), ("com",), ("uk",)], "suffix string"))
    got = {r.host: (r.suffix, r.domain) for r in listed.collect()}
    assert got["x.site.example.com:80"] == (
        "example.com",
        "site.example.com",
    ) and got["a.blog.net"] == ("blog.net", "a.blog.net") and got["example.com"] == ("example.com", "example.com")
    assert got["a.b.co.uk"] == ("uk", "co.uk") and got["9.example.org.nz"] == ("org.nz", "example.org.nz") and len(got) == 8


def test_reply_tree(spark):
    rows = [
        (1, 1, None, "user", "q", 0.0),
        (1, 2, 1, "assistant", "</s>\\b[INST]<|end|>", 1.0),
        (1, 3, 1, "assistant", "better\\", 5.0),
        (1, 4, 3, "user", None, 0.0),
        (1, 5, 3, None, "x", 0.5),
        (2, 1, None, "user", "alone", None),
        (3, 1, 2, "user", "cycle", 0.0),
        (3, 2, 1, "user", "cycle", 0.0),
        (None, 1, None, "assistant", "no id", 0.0),
        (4, 9, 7, "user", "orphan", 0.0),
    ]
    m = spark.createDataFrame(rows, "conv_id long, node long, parent long, role string, text string, score double")
    out = chat.format_paths(m, chat.reply_paths(m))
    out = out.withColumns({"turns": chat.read_turns(F.col("formatted")), "loss": chat.read_loss(F.col("formatted"), F.col("mask"))})
    got = {(r.conv_id, r.branch): r for r in out.collect()}
    assert {k: r.path for k, r in got.items()} == {
        (1, 1): [1, 3, 5],
        (1, 2): [1, 3, 4],
        (1, 3): [1, 2],
        (2, 1): [1],
        (None, 1): [1],
        (4, 1): [9],
    }
    assert [tuple(t) for t in got[1, 3].turns] == [("user", "q"), ("assistant", "</s>\\b[INST]<|end|>")]
    assert [tuple(t) for t in got[1, 2].turns] == [("user", "q"), ("assistant", "better\\"), ("user", "")]
    assert got[1, 3].loss == "</s>\\b[INST]<|end|>" and got[1, 1].loss == "better\\" and got[2, 1].loss == ""
    assert chat.format_paths(m, chat.reply_paths(m), branches=1).count() == 4
    assert chat.format_paths(m.where("false"), chat.reply_paths(m.where("false"))).count() == 0


def test_escapes(spark):
    rng = random.Random(4)
    parts = [*chat.CONTROL, "\\", "\\b", "\\l", "\\k", "<", "[", "b", "l", "|>", "s>", "\u00e9"]
    texts = ["".join(rng.choices(parts, k=rng.randrange(8))) for _ in range(500)]
    df = spark.createDataFrame([(t,) for t in texts], "t string").select("t", chat.escape(F.col("t")).alias("e"))
    for r in df.select("t", "e", chat.unescape(F.col("e")).alias("u")).collect():
        assert r.u == r.t and not any(c in r.e for c in chat.CONTROL)
