"""The registered queries and the pipeline on small tables, against brute force."""

import collections
import hashlib
import itertools
import random
import re
import zlib

import numpy as np
import pytest
from gapline.llm import queries
from gapline.llm.packing import pieces

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, n=5):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def near_groups(docs, percent):
    """doc -> smallest doc of its group."""
    sets = {i: shingles(t) for i, t in docs}
    comp = {i: i for i in sets}
    for a, b in itertools.combinations(sorted(sets), 2):
        both = len(sets[a] & sets[b])
        if both and 100 * both >= percent * len(sets[a] | sets[b]):
            x, y = sorted((comp[a], comp[b]))
            comp = {k: x if v == y else v for k, v in comp.items()}
    return comp


def cover(docs, depth=200):
    raw = {i: (t or "").encode() for i, t in docs}
    seen = collections.Counter(t[k : k + depth] for t in raw.values() for k in range(len(t) - depth + 1))
    out = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - depth + 1):
            if seen[t[k : k + depth]] > 1:
                gone[k : k + depth] = True
        out[i] = gone
    return raw, out


def hits(docs, items, size=13):
    def words(t):
        return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))

    out = {}
    for i, t in docs:
        w, hit, found = words(t), set(), set()
        for k, it in items:
            x = words(it)
            n = min(size, len(x))
            for a in range(len(x) - n + 1 if n else 0):
                for b in range(len(w) - n + 1):
                    if w[b : b + n] == x[a : a + n]:
                        hit.update(range(b, b + n))
                        found.add(str(k))
        out[i] = (len(w), len(hit), found)
    return out


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    rng = random.Random(11)
    words = [f"{a}{b}" for a in ("re", "ti", "on", "an", "th", "er", "éa") for b in ("sta", "ing", "ble", "ent", "ou", "ha")]

    def text(n):
        return " ".join(rng.choices(words, k=n)).capitalize() + "."

    items = [(k, text(n)) for k, n in enumerate([30, 20, 13, 6])]
    base, passage = text(150), text(70)
    docs = [text(rng.randrange(5, 120)) for _ in range(20)] + [base, base]
    for k in range(6):
        near = base.split()
        near[10 * k + 3] = f"Zz{k}"
        docs.append(" ".join(near))
    docs += [text(40) + " " + passage + " " + text(40) for _ in range(4)] + [
        items[0][1],
        text(10) + " " + items[1][1] + " " + text(300),
        None,
        "",
        "12 345",
        "one two",
    ]
    docs = [(i, t, rng.choice(["en", "fr"]), f"src{i % 3}", len(t or "")) for i, t in enumerate(docs)]
    folder = str(tmp_path_factory.mktemp("tables"))
    spark.createDataFrame(
        docs,
        "doc_id long, text string, lang string, source string, n_chars long",
    ).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    spark.createDataFrame(
        [(i, i % 2, int(i % 5 == 0)) for i in range(0, 30, 2)],
        "doc_id long, quality int, toxic int",
    ).write.parquet(f"{folder}/labels.parquet")
    pages = [
        (
            i,
            f"http://h{i % 3}.example.com/en/{i}",
            f"<html><nav><a>Menu {i}</a></nav><article><h1>T {i}</h1><p>{t}</article><footer>Foot</footer></html>" if i % 7 else None,
        )
        for i, t, *_ in docs
    ]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{folder}/pages.parquet")
    turns = [(c, t, "user" if t % 2 == 0 else "assistant", rng.choice([text(5), None, "a</s>\\"])) for c in range(4) for t in range(c + 2)]
    spark.createDataFrame(turns, "conv_id long, turn long, role string, text string").write.parquet(f"{folder}/conversations.parquet")
    return folder, [(i, t) for i, t, *_ in docs], items, turns


def run(spark, tables, name):
    return queries.queries()[name](spark, tables[0]).collect()


def test_op1(spark, tables):
    got = run(spark, tables, "op1_lmscore")
    assert {r.doc_id for r in got} == {i for i, _ in tables[1]}
    assert all((r.score is None) == (r.n_words == 0) and r.keep == (r.score is not None and r.score <= 0) for r in got)


def test_op2(spark, tables):
    for r in run(spark, tables, "op2_html"):
        want = "" if r.page_id % 7 == 0 else "\n".join(
            x for x in (f"T {r.page_id}", " ".join((tables[1][r.page_id][1] or "None").split())) if x
        )
        assert r.text == want and r.n_chars == len(want)


def test_op4(spark, tables):
    comp = near_groups(tables[1], 85)
    assert {
        (r.doc_id, r.n_shingles, r.component_id, r.kept) for r in run(spark, tables, "op4_neardup")
    } == {(i, len(shingles(t)), comp[i], comp[i] == i) for i, t in tables[1]}


def test_op5(spark, tables):
    want = {
        (i, n, h, len(f), hashlib.sha256(",".join(sorted(f)).encode()).hexdigest(), h > 0 and 20 * h >= n)
        for i, (n, h, f) in hits(tables[1], tables[2]).items()
    }
    assert {
        (r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256, r.contaminated) for r in run(spark, tables, "op5_decontaminate")
    } == want


def test_op6(spark, tables):
    by = collections.defaultdict(list)
    for c, _, role, text in [*tables[3], (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]:
        by[c].append((role, text or ""))
    want = set()
    for c, t in by.items():
        loss = "".join(x for role, x in t if role == "assistant")
        want.add(
            (
                c,
                len(t),
                hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in t).encode()).hexdigest(),
                len(loss),
                hashlib.sha256(loss.encode()).hexdigest(),
            )
        )
    assert {(r.conv_id, r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256) for r in run(spark, tables, "op6_chat")} == want


CLASH = "key id k row rows turns loss path parent score bits th place run part at n fp"


@pytest.mark.parametrize("name", ["op6_chat", "op7_media", "op8_substrings", "op11_exactdup", "op12_periodic", "op13_fim", "op9_language"])
def test_empty_tables_and_clashing_columns(spark, tables, tmp_path, name):
    """Columns with the operators' own names change nothing; an empty table gives an empty result (and the planted conversation)."""
    from pyspark.sql import functions as F

    want = sorted(map(str, run(spark, tables, name)))
    for t in ("documents", "conversations"):
        df = spark.read.parquet(f"{tables[0]}/{t}.parquet")
        more = df.withColumns({c: F.lit(f"x{c}") for c in CLASH.split()})
        more.write.parquet(f"{tmp_path}/more/{t}.parquet")
        more.limit(0).write.parquet(f"{tmp_path}/none/{t}.parquet")
    assert sorted(map(str, queries.queries()[name](spark, f"{tmp_path}/more").collect())) == want
    none = queries.queries()[name](spark, f"{tmp_path}/none").collect()
    assert [r.conv_id for r in none] == [-7] if name == "op6_chat" else none == []


@pytest.mark.parametrize("name", ["op6_chat", "op7_media"])
def test_very_long_texts(spark, tmp_path, name):
    text = "word é " * 300_000
    spark.createDataFrame([(1, text), (2, text)], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, 0, "user", "q"), (1, 1, "assistant", text)], "conv_id long, turn long, role string, text string").write.parquet(
        f"{tmp_path}/conversations.parquet"
    )
    got = queries.queries()[name](spark, str(tmp_path)).collect()
    if name == "op6_chat":
        r = next(r for r in got if r.conv_id == 1)
        assert (r.loss_chars, r.loss_sha256) == (len(text), hashlib.sha256(text.encode()).hexdigest())
    else:
        raw = text.encode()
        p = raw + b" " * (-len(raw) % 192)
        assert {(r.doc_id, r.payload_sha256) for r in got} == {(k, hashlib.sha256(p).hexdigest()) for k in (1, 2)}


def test_op1_with_labels_of_both_kinds(spark, tables, tmp_path):
    """Documents like the labelled good ones score lower than those like the others."""
    rng = random.Random(4)
    words = {k: [f"{k}{a}{b}" for a in "xyz" for b in "uvw"] for k in "gb"}
    docs = [(i, " ".join(rng.choices(words["gb"[i % 2]], k=60))) for i in range(80)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1 - i % 2, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = {r.doc_id: r for r in queries.op1_lmscore(spark, str(tmp_path)).collect()}
    assert len(got) == 80
    good, bad = ([got[i].score for i in range(k, 80, 2)] for k in (0, 1))
    assert max(good) < min(bad) and all(got[i].keep == (i % 2 == 0) for i in got)


def png(payload):
    """A gray PNG of 192 samples a line, put together by hand."""

    def chunk(kind, data):
        return len(data).to_bytes(4, "big") + kind + data + zlib.crc32(kind + data).to_bytes(4, "big")

    lines = b"".join(b"\0" + payload[k : k + 192] for k in range(0, len(payload), 192))
    size = (192).to_bytes(4, "big") + (len(payload) // 192).to_bytes(4, "big")
    return b"\x89PNG\r\n\x1a\n" + chunk(
        b"IHDR",
        size + bytes([8, 0, 0, 0, 0]),
    ) + chunk(b"IDAT", zlib.compress(lines, 4)) + chunk(b"IEND", b"")


def features(payload):
    n = len(payload)
    share = [sum(32 * k <= x < 32 * k + 32 for x in payload) * 1000 // n for k in range(8)]
    return f"m{sum(payload) * 1000 // n}-s{sum(x * x for x in payload) * 1000 // n}-" + ".".join(map(str, share))


def test_op7(spark, tables):
    for r in run(spark, tables, "op7_media"):
        raw = (tables[1][r.doc_id][1] or "").encode()
        p = raw + b" " * (-len(raw) % 192 or (0 if raw else 192))
        form = png(p)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (
            len(raw),
            len(p),
            hashlib.sha256(p).hexdigest(),
            zlib.crc32(p[-16:]),
        )
        assert (r.media_bytes, r.media_sha256, r.feature) == (len(form), hashlib.sha256(form).hexdigest(), features(p))


def test_op7_metadata(spark, tables):
    got = run(spark, tables, "op7_media")
    assert len(got) == len(tables[1])
    assert all((r.width, r.height, r.depth, r.colour) == (192, r.payload_bytes // 192, 8, 0) for r in got)


def test_op8(spark, tables):
    raw, gone = cover(tables[1])
    want = set()
    for i, t in raw.items():
        kept = bytes(b for b, g in zip(t, gone[i], strict=True) if not g)
        want.add(
            (i, len(t), int(gone[i].sum()), int((np.diff(gone[i].astype(int), prepend=0) == 1).sum()), hashlib.sha256(kept).hexdigest())
        )
    assert {(r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in run(spark, tables, "op8_substrings")} == want


def test_op9(spark, tables):
    for r in run(spark, tables, "op9_language"):
        text = tables[1][r.doc_id][1]
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
        assert (r.lang_pred == "und") == (not any(c.isalpha() for c in text or "")) and r.lang_pred in ("und", "en", "fr")


def encoded(text):
    import public_tokenizers
    from tokenizers import Tokenizer

    return np.array(
        [*Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")).encode(text or "", add_special_tokens=False).ids, 1],
        "<u4",
    )


def packed(docs):
    out = set()
    for i, t in docs:
        ids, at = encoded(t), 0
        for n in pieces(len(ids), 2048):
            out.add((i, at, n, zlib.crc32(ids[at : at + n].tobytes()), len(ids)))
            at += n
    return out


def test_op10(spark, tables):
    got = run(spark, tables, "op10_packing")
    assert {(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in got} == packed(tables[1])
    assert len({r.sequence_id for r in got}) == len(got)


@pytest.mark.parametrize("labelled", [[], [5]])
def test_language_stage_without_labels(spark, tables, labelled):
    """Unlabelled documents stay; so do all if labels stand on held-out ids alone (5 is one)."""
    import corpus_pipeline
    from pyspark.sql import functions as F

    assert all(zlib.crc32(str(i).encode()) % 4 == 2 for i in labelled)
    docs = spark.read.parquet(f"{tables[0]}/documents.parquet").withColumn("lang", F.when(F.col("doc_id").isin(labelled), F.lit("en")))
    got = corpus_pipeline.language_stage(spark, docs, tables[0]).collect()
    assert sorted(r.doc_id for r in got) == [i for i, t in tables[1] if any(c.isalpha() for c in t or "")]
    assert all(r.text == tables[1][r.doc_id][1] for r in got)


def test_pipeline(spark, tables):
    import corpus_pipeline

    docs = [(i, t) for i, t in tables[1] if any(c.isalpha() for c in t or "")]
    comp = near_groups(docs, 80)
    docs = [(i, t) for i, t in docs if comp[i] == i]
    raw, gone = cover(docs)
    cut = []
    for i, t in raw.items():
        # whole characters only: a character goes if all of its bytes do
        chars, at = [], 0
        for c in t.decode():
            n = len(c.encode())
            if not gone[i][at : at + n].all():
                chars.append(c)
            at += n
        cut.append((i, "".join(chars)))
    found = hits(cut, tables[2])
    clean = [(i, t) for i, t in cut if not (found[i][1] > 0 and 20 * found[i][1] >= found[i][0])]
    assert {
        (r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, tables[0]).collect()
    } == packed(clean)


def brute_pipeline(rows, items):
    """Pieces of the rows (doc_id, text) that the stages leave, each stage in its plainest form. Near copies are told by id and text."""
    rows = [(i, t) for i, t in rows if any(c.isalpha() for c in t or "")]
    rows = list(dict.fromkeys(rows))
    order = sorted(rows, key=lambda r: (r[0] is None, r[0] or 0))
    comp = near_groups(list(enumerate(t for _, t in order)), 80)
    groups = collections.defaultdict(list)
    for k, r in enumerate(order):
        groups[comp[k]].append(r)
    return groups


@pytest.mark.parametrize("empty", ["documents", "benchmark", "labels"])
def test_pipeline_with_empty_tables(spark, tables, tmp_path, empty):
    import corpus_pipeline

    for name in ("documents", "benchmark", "labels"):
        df = spark.read.parquet(f"{tables[0]}/{name}.parquet")
        (df.where("false") if name == empty else df).write.parquet(f"{tmp_path}/{name}.parquet")
    got = corpus_pipeline.run(spark, str(tmp_path))
    assert (got.count() == 0) == (empty == "documents")


def test_neardup_stage_with_null_and_repeated_ids_and_clashing_columns(spark, tables):
    """One row of each group stays, whatever its id; the columns stay those of documents."""
    import corpus_pipeline

    base = tables[1][20][1]
    near = base.replace(base.split()[40], "Zzz")
    other = " ".join(f"o{k}" for k in range(60))
    rows = [(None, base), (None, near), (None, other), (5, base), (5, other), (5, base), (7, near), (None, None)]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", 1, 0.5, "x") for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, th double, first string",
    )
    got = corpus_pipeline.neardup_stage(spark, docs, tables[0])
    assert got.columns == list(corpus_pipeline.COLUMNS)
    texts = [(r.doc_id, r.text) for r in got.collect()]
    groups = brute_pipeline(rows, tables[2])
    assert len(texts) == len(groups) + 1 and (None, None) in texts
    assert sorted(t for i, t in texts if i == 5) == sorted([base, other])


def test_stages_keep_what_has_no_id(spark, tables):
    import corpus_pipeline

    passage = " ".join(f"p{k}" for k in range(80))
    rows = [(None, passage + " one"), (None, "two " + passage), (3, "clean words here"), (3, tables[2][0][1])]
    docs = spark.createDataFrame(
        [(i, t, "en", "s", len(t), 1) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, row long",
    )
    cut = corpus_pipeline.substring_stage(spark, docs, tables[0]).collect()
    assert len(cut) == 4 and all("p40" not in r.text for r in cut) and all(r.n_chars == len(r.text) for r in cut)
    clean = corpus_pipeline.decontamination_stage(spark, docs, tables[0])
    assert clean.columns == list(corpus_pipeline.COLUMNS) and sorted(r.text for r in clean.collect()) == sorted(t for _, t in rows[:3])
