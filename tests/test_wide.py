"""Very long records in many tasks: the same results as in one task."""

import random

import numpy as np
import pytest
from gapline.config import Config, Vocabulary
from gapline.operators import decode, gaps, wide
from gapline.plans import segmentation
from gapline.sources.shared import Scope
from pyspark.sql import functions as F

WORDS = Vocabulary.from_texts(task="box nail", cognitive="think know", metacognitive="wait maybe", affective="good bad", structural="then so")
KEYS = "Record_ID string, Source_Row long, Source_Column string, text string"


def text(rng, n, stuck=0.0):
    plain = ["box", "nail", "think", "know", "wait", "maybe", "good", "bad", "then", "so", "the", "is", "red", "falls", "and", "wall", "x", "y"]
    out = []
    while len(out) < n:
        if rng.random() < stuck:
            out += ["the"] * rng.randrange(30, 150)  # nothing can be split there
        out += rng.choices(plain, k=rng.randrange(3, 25)) + rng.choices([".", ",", "?", "|", "", ""], k=1)
    return " ".join(out)


def rows(df):
    return sorted(map(str, df.collect()))


@pytest.mark.parametrize(
    "seed,config",
    [
        (3, Config(continuity="jaccard", min_segment_tokens=4, max_segment_tokens=20, nms_radius=9)),
        (4, Config(continuity="jaccard", sensitivity=9.0, max_segment_tokens=25, max_segments_per_record=0)),
    ],
)
def test_long_records_give_the_same_results(spark, monkeypatch, seed, config):
    rng = random.Random(seed)
    texts = [text(rng, n, stuck) for n, stuck in ((900, 0.0), (700, 0.03), (40, 0.0), (1, 0.0), (500, 0.2))] + ["", None, "a | b c d | ", "wait then so " * 150]
    t = spark.createDataFrame([(f"r{k}", k, "text", x) for k, x in enumerate(texts)], KEYS)
    monkeypatch.setattr(wide, "PIECE", 40)
    seg, bound = segmentation._segment(t, WORDS, config, True, None, None)
    seg2, bound2 = segmentation._segment_long(t, WORDS, config, True, None, None, block=64)
    assert rows(bound2) == rows(bound) and rows(seg2) == rows(seg)
    assert bound.where("forced_max_length_boundary").count() > 3
    spark.catalog.clearCache()


def test_records_are_shared_out_by_their_length(spark):
    rng = random.Random(8)
    t = spark.createDataFrame([(f"r{k}", k, "text", text(rng, n)) for k, n in enumerate((300, 30, 250))] + [("r9", 9, "text", None)], KEYS)
    config = Config(continuity="jaccard", max_segments_per_record=5)
    want = segmentation.segment(t, WORDS, config, long_text=None)
    got = segmentation.segment(t, WORDS, config, long_text=500)
    assert [rows(x) for x in got] == [rows(x) for x in want]
    assert [x.columns for x in got] == [x.columns for x in want]
    spark.catalog.clearCache()


def candidates(spark, ks, n, step):
    at = [(("r", 0, "text", 0), n, step * (i + 1), k) for i, k in enumerate(ks)]
    return spark.createDataFrame([(*k, n, p, v) for k, n, p, v in at], f"{KEYS.replace('text string', 'chunk int')}, n_tokens int, pos int, k long")


@pytest.mark.parametrize("kind", ["falling", "random"])
def test_greedy_choice_across_blocks(spark, kind):
    """A chain of candidates, each too near to the next, which decide one another from one end to the other."""
    m, config = 120, Config(min_segment_tokens=12)
    ks = {"falling": range(m, 0, -1), "random": random.Random(1).sample(range(m), m)}[kind]
    n = 8 * m + 20
    with Scope(spark) as scope:
        got = wide.greedy(candidates(spark, list(ks), n, 8), config, scope, block=48)
        assert sorted(r.pos for r in got.collect()) == decode.greedy_cuts(n, [(k, 8 * (i + 1)) for i, k in enumerate(ks)], 12, 12)


def test_spans_longer_than_a_task_are_split_in_rounds(spark):
    rng = random.Random(6)
    n, config = 1500, Config(min_segment_tokens=5, max_segment_tokens=40)
    key = ("r", 0, "text", 0)
    gap = [(*key, n, p, rng.randrange(50), rng.random() < 0.3 and p % 400 > 120, rng.random() < 0.5 and p % 400 > 120, rng.choice([0, -2, -3])) for p in range(1, n)]
    df = spark.createDataFrame(gap, f"{KEYS.replace('text string', 'chunk int')}, n_tokens int, pos int, k long, free boolean, usable boolean, bonus int")
    table = {c: np.array([g[i] for g in gap]) for c, i in (("k", 6), ("free", 7), ("usable", 8), ("bonus", 9))}
    for chosen in ([], [100, 300, 1300]):
        marks = spark.createDataFrame([(*key, p) for p in chosen], f"{KEYS.replace('text string', 'chunk int')}, pos int")
        with Scope(spark) as scope:
            got = sorted(r.pos for r in wide.forced(df, marks, config, scope, block=100).collect())
        assert got == sorted(decode.forced_cuts(n, chosen, table, 5, 40))


def test_blocks_hold_what_windows_reach(spark):
    df = spark.range(30).select(F.col("id").cast("int").alias("pos"))
    got = {(r.block, r.own): set() for r in wide.in_blocks(df, 3, 10).collect()}
    for r in wide.in_blocks(df, 3, 10).collect():
        got[r.block, r.own].add(r.pos)
    assert got[1, True] == set(range(10, 20)) and got[1, False] == {7, 8, 9, 20, 21, 22}
    with pytest.raises(ValueError):
        wide.in_blocks(df, 11, 10)


def test_a_long_record_runs_in_many_tasks(spark):
    n = 40_000
    t = spark.createDataFrame([("r", 1, "text", " ".join(f"w{k % 97}" for k in range(n)))], KEYS)
    with Scope(spark) as scope:
        tokens = wide.tokens(t, scope, True, piece=1 << 14)
        assert tokens.count() == n and tokens.agg(F.max("pos")).first()[0] == n - 1
        around = wide.in_blocks(tokens, 19, 5000)
        scored = gaps.score(around, WORDS, Config(continuity="jaccard"))
        assert scored.where("own").count() == n - 1
        assert scored.where("own").groupBy("block").count().count() == 8
