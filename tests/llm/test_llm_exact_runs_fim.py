"""Exact duplicates, periodic runs and fill-in-the-middle against brute force, and their edge cases."""

import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest
from gapline.llm import exactdup, fim, periodic, queries
from pyspark.sql import functions as F

DOCS = "doc_id long, text string, lang string, id string, run int, place long, h1 long, n long, carried string"


def documents(spark, rows, parts=3):
    """Rows with columns whose names the operators use themselves."""
    return spark.createDataFrame([(i, t, "x", "y", 1, 2, 3, 4, "z") for i, t in rows], DOCS).repartition(parts)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


# exact duplicates


def copies(rows):
    groups = {}
    for i, t in rows:
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", " ", t or ""), []).append(i)
    return groups


@pytest.mark.parametrize("fan_in,parts", [(2, 7), (3, 20), (16, 1), (16, 40)])
def test_exact_copies(spark, fan_in, parts):
    rng = random.Random(fan_in)
    rows = [(i, rng.choice(["a b", "a  b", "a\t\nb", " a b", "c", "C", "é", "é", "", None, "a b", f"own {i}"])) for i in range(300)]
    rng.shuffle(rows)
    got = {r.doc_id: r for r in exactdup.find(documents(spark, rows, parts), fan_in=fan_in).collect()}
    assert len(got) == 300
    for text, ids in copies(rows).items():
        for i in ids:
            r = got[i]
            assert (r.keep_id, r.group_size, r.kept, r.text_sha256) == (min(ids), len(ids), i == min(ids), sha(text))


def test_exact_null_and_repeated_ids(spark):
    rows = [(None, "x"), (None, "x"), (5, "x"), (5, "x"), (None, "y"), (None, "y"), (7, None), (7, "")]
    got = exactdup.find(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for key, keep, size in (("x", 5, 4), ("y", None, 2), ("", 7, 2)):
        own = [r for r in got if r.text_sha256 == sha(key)]
        assert len(own) == size and [r.kept for r in own].count(True) == 1
        assert {(r.keep_id, r.group_size) for r in own} == {(keep, size)} and next(r for r in own if r.kept).doc_id == keep


def test_exact_empty_table_and_carried_columns(spark):
    assert exactdup.find(documents(spark, [(1, "a")]).limit(0)).count() == 0
    got = exactdup.find(documents(spark, [(2, "a " * 400_000), (1, "a\n" * 400_000)]), carry=["doc_id", "id", "run"]).collect()
    assert {(r.doc_id, r.kept, r.carried.id, r.carried.run, r.carried.doc_id == r.doc_id) for r in got} == {
        (1, True, "y", 1, True),
        (2, False, "y", 1, True),
    }


def test_exact_hot_copies_are_merged_before_they_meet(spark, monkeypatch):
    """The group of most rows and small groups take different ways back; with no heavy groups all take the join."""
    rows = [(i, "hot" if i % 3 == 0 else f"t {i // 4}") for i in range(900)]
    want = {i: (min(ids), len(ids)) for ids in copies(rows).values() for i in ids}
    for heavy in (1, 4, 4096):
        monkeypatch.setattr(exactdup, "HEAVY", heavy)
        got = exactdup.find(documents(spark, rows, 9)).collect()
        assert {r.doc_id: (r.keep_id, r.group_size) for r in got} == want


def test_exact_same_short_digest_is_not_enough(spark):
    rows = spark.createDataFrame(
        [(k % 2, 7, bytes([k // 2]) * 32, 3, k, k % 4) for k in range(8)], "id long, short long, sha binary, length int, place long, run int"
    )
    got = exactdup.merge_tree(rows, 2).collect()
    assert sorted((bytes(r.sha)[0], r.n, r.first.id, r.first.place) for r in got) == [(k, 2, 0, 2 * k) for k in range(4)]


# periodic runs


def brute_runs(w, least=24, repeats=3):
    found = {}
    for q in range(1, len(w) // repeats + 1):
        same = [w[i] == w[i + q] for i in range(len(w) - q)]
        i = 0
        while i < len(same):
            if same[i]:
                z = i
                while z < len(same) and same[z]:
                    z += 1
                if z - i + q >= max(least, repeats * q) and (i, z + q) not in found:  # a smaller period of the same stretch came first
                    found[i, z + q] = q
                i = z
            i += 1
    return sorted(((a, z - a, q) for (a, z), q in found.items()), key=lambda r: (r[0], r[2]))


def runs_of(w):
    return periodic.find_runs(periodic.numbers(" ".join(w).encode()))


@pytest.mark.parametrize("seed", range(12))
def test_runs_against_brute_force(seed):
    rng = random.Random(seed)
    for _ in range(25):
        w = []
        while len(w) < rng.randrange(40, 700):
            kind = rng.random()
            if kind < 0.4:
                w += rng.choices("abcdefgh", k=rng.randrange(1, 40))
            elif kind < 0.8:
                block = rng.choices("ab" if seed % 2 else "abcde", k=rng.choice([1, 2, 3, 5, 7, 8, 9, 15, 16, 17, 31, 32, 33, 60]))
                w += (block * 9)[: rng.randrange(len(block), 9 * len(block) + 1)]
            else:
                w += w[-rng.randrange(1, 80) :] * rng.randrange(1, 3)
        assert runs_of(w) == brute_runs(w)


def test_runs_of_special_words():
    fib = ["a", "b"]
    while len(fib) < 900:
        fib = [x for c in fib for x in (("a", "b") if c == "a" else ("a",))]
    thue = [str(bin(k).count("1") % 2) for k in range(1024)]
    nested = (["x"] * 30 + ["y"]) * 5 + ["z"] + (["x", "x", "q"] * 40)
    for w in (fib, thue, nested, ["a"] * 23, ["a"] * 24, ["a"] * 25, [str(k % 9) for k in range(26)], [str(k % 9) for k in range(27)]):
        assert runs_of(w) == brute_runs(w)


def test_runs_across_windows_and_in_long_texts(monkeypatch):
    n = 200_000
    assert runs_of(["a"] * n) == [(0, n, 1)]
    block = [f"w{k}" for k in range(21_000)]
    w = ["s", *block * 4, "t", *["u", "v"] * 40]
    assert runs_of(w) == [(1, 84_000, 21_000), (84_002, 80, 2)]
    monkeypatch.setattr(periodic, "WINDOW", 16)
    monkeypatch.setattr(periodic, "PART", 50)
    rng = random.Random(3)
    for _ in range(30):
        w = [x for k in range(6) for x in rng.choices("ab", k=rng.randrange(1, 30)) * rng.randrange(1, 6)]
        assert runs_of(w) == brute_runs(w)


def collapsed(w, runs):
    gone = {i for a, length, q in runs for i in range(a + q, a + length)}
    return " ".join(x for i, x in enumerate(w) if i not in gone)


def test_runs_of_a_table(spark):
    line = "the same line again "
    rows = [
        (1, line * 9),
        (None, None),
        (2, ""),
        (2, " \t "),
        (3, "é é " * 30 + "\x0b\x0cend"),
        (3, "é é " * 30 + "\x0b\x0cend"),
        (4, "no runs here"),
    ]
    got = periodic.collapse_runs(documents(spark, rows)).collect()
    assert len(got) == len(rows)
    for i, t in rows:
        w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
        runs = brute_runs(w)
        assert any((r.doc_id, r.n_words, [tuple(x) for x in r.runs], r.collapsed) == (i, len(w), runs, collapsed(w, runs)) for r in got)
    assert periodic.collapse_runs(documents(spark, rows).limit(0)).count() == 0
    with pytest.raises(ValueError):
        periodic.find_runs(np.zeros(50, np.int32), least=10)


def planted(i, t):
    w = re.findall(r"[^\x20\x09-\x0D]+", t or "")
    h = zlib.crc32(str(i).encode())
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    return w


def test_op12(spark, tmp_path):
    rng = random.Random(5)
    rows = [(i, " ".join(rng.choices([f"w{k}" for k in range(50)], k=rng.randrange(0, 120))) or None) for i in range(150)]
    documents(spark, rows).write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: r for r in queries.op12_periodic(spark, str(tmp_path)).collect()}
    assert len(got) == 150 and sum(r.n_runs > 0 for r in got.values()) > 5
    for i, t in rows:
        w = planted(i, t)
        runs = brute_runs(w)
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2])) if runs else (None, None, None)
        r = got[i]
        assert (r.n_runs, r.start, r.length, r.period) == (len(runs), *best)
        assert r.exponent_milli == (1000 * best[1] // best[2] if runs else None)
        assert r.runs_sha256 == sha("".join(f"{a},{b},{c}\n" for a, b, c in runs))
        assert r.collapsed_sha256 == sha(collapsed(w, runs))


# fill-in-the-middle


def brute_fim(i, t, rate=100, spm=50, seed="7"):
    units = re.findall(r"[^\n]*\n|[^\n]+", t or "")
    h = hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()
    h = [int(h[8 * k : 8 * k + 8], 16) for k in range(4)]
    n = len(units)
    a, z = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = "".join(units[:a]), "".join(units[a:z]), "".join(units[z:])
    if not t or re.search("<[PSM]>", t) or h[2] % 100 >= rate:
        return n, "plain", None, None, t or ""
    if h[3] % 100 < spm:
        return n, "spm", len(p), len(m), f"<S>{s}<P>{p}<M>{m}"
    return n, "psm", len(p), len(m), f"<P>{p}<S>{s}<M>{m}"


def lines(rng, n):
    return "".join(rng.choices(["a", "é", "\n", "\n", "𝄞", "<", "P>", "<P", "S", ">", " word", "\r\n"], k=n))


@pytest.mark.parametrize("chunk_bytes", [1, 7, 64, 1 << 16])
def test_fim_against_brute_force(spark, chunk_bytes):
    rng = random.Random(chunk_bytes)
    rows = [(i, lines(rng, rng.choice([0, 1, 2, 5, 30, 200]))) for i in range(80 if chunk_bytes > 1 else 25)]
    rows += [(1000, None), (1001, "\n"), (1002, "\n\n"), (1003, "x"), (1004, "é" * 100), (1005, "<" * 70 + "M>"), (None, "a\nb\nc\n"), (None, "a\nb\nc\n")]
    out = fim.transform(documents(spark, rows), chunk_bytes=chunk_bytes)
    got = out.withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    assert sorted(((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got), key=str) == sorted(
        ((i, *brute_fim(i, t)) for i, t in rows), key=str
    )
    assert sorted(((r.doc_id, r.back) for r in got), key=str) == sorted(((i, t or "") for i, t in rows), key=str)


def test_fim_rates_and_empty_table(spark):
    rows = [(i, f"a{i}\nb\nc") for i in range(60)]
    got = fim.transform(documents(spark, rows), seed="s", rate=60, spm=20).collect()
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got} == {(i, *brute_fim(i, t, 60, 20, "s")) for i, t in rows}
    assert {r.form for r in got} == {"plain", "psm", "spm"}
    assert fim.transform(documents(spark, rows).limit(0)).count() == 0


def test_fim_composition_is_associative():
    rng = random.Random(1)
    text = lines(rng, 900).encode()
    whole = [x[:, 0] for x in fim.Scan([text]).totals()]
    for _ in range(20):
        a, b = sorted(rng.sample(range(len(text)), 2))
        f, g, h = (fim.Scan([t]).totals() for t in (text[:a], text[a:b], text[b:]))
        for got in (fim.compose(fim.compose(f, g), h), fim.compose(f, fim.compose(g, h))):
            assert all((x[:, 0] == y).all() for x, y in zip(got, whole, strict=True))


def test_fim_long_text(spark):
    rng = random.Random(2)
    t = "".join(rng.choices(["line é\n", "x" * 3000 + "\n", "\n"], k=900))
    rows = [(i, t + str(i)) for i in range(4)]
    got = fim.transform(documents(spark, rows)).collect()
    assert {(r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output) for r in got} == {(i, *brute_fim(i, t)) for i, t in rows}
