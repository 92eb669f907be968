"""Sequence ratios, models for the continuity, and the tagger behind the parser rules."""

import itertools
import json
import math
import random
import re
import time
import warnings
from difflib import SequenceMatcher

import numpy as np
import pyarrow as pa
import pytest
from gapline.config import Config
from gapline.functions import sequence
from gapline.operators import continuity, encoders, gaps, sampling, tagging
from gapline.plans import segmentation
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

KEYS = "Record_ID string, Source_Row long, Source_Column string, text string"


def transcripts(spark, *texts):
    return spark.createDataFrame([(f"r{k}", k, "text", t) for k, t in enumerate(texts)], KEYS)


def ratio(a, b):
    return SequenceMatcher(None, a, b).ratio()


@settings(max_examples=150, deadline=None)
@given(st.lists(st.tuples(st.text("abc d\0\1é", max_size=40), st.text("abc d\0\1é", max_size=40)), max_size=8))
def test_ratio_is_the_standard_one(pairs):
    left, right = [a for a, _ in pairs], [b for _, b in pairs]
    assert sequence.ratios(left, right) == [ratio(a, b) for a, b in pairs]


def test_ratio_of_long_texts_and_wide_alphabets():
    rng = random.Random(4)
    sizes = [0, 1, 62, 63, 64, 65, 126, 127, 128, 129, 199, 200, 255, 256, 257, 400]
    left, right = [], []
    for n, m in itertools.product(sizes, sizes):
        for letters in ("ab", "abcdefghijklmnopqrstuvwxyz 0123456789"):
            left.append("".join(rng.choices(letters, k=n)))
            right.append("".join(rng.choices(letters, k=m)))
    assert sequence.ratios(left, right) == [ratio(a, b) for a, b in zip(left, right, strict=True)]
    assert sequence.ratios([], []) == []


def test_lexical_is_the_default_and_exact(spark):
    t = transcripts(spark, "the cat sat on the mat and then it ran away from the dog. a dog, the cat and I don't know")
    got = gaps.score(gaps.tokens(gaps.chunks(t))).orderBy("gap").collect()
    words = [w for w in t.first().text.replace(".", " .").replace(",", " ,").split()]
    for r in got:
        l, g = ({w.lower() for w in words[a:z] if w.isalnum()} for a, z in ((max(0, r.gap - 12), r.gap), (r.gap, r.gap + 12)))
        want = max(len(l & g) / len(l | g), 0.35 * ratio(" ".join(sorted(l)), " ".join(sorted(g)))) if l and g else 0.0
        assert r.semantic_continuity == pytest.approx(want, abs=5.1e-5)


@pytest.fixture
def model_file(tmp_path):
    path = tmp_path / "model.json"
    path.write_text(json.dumps({"kind": "hashed-projection", "dimensions": 40, "seed": "x"}))
    return str(path)


TEXTS = ("one two three four five six seven eight nine ten eleven twelve thirteen fourteen. , fifteen", "one two one two " * 10, "a . . . . . . . . . . . . . . .", "x")


@pytest.mark.parametrize("scheme", ["", "file://"])
def test_model_continuity(spark, model_file, scheme):
    t = gaps.tokens(gaps.chunks(transcripts(spark, *TEXTS, *TEXTS[:2])))
    got = gaps.score(t, config=Config(continuity=scheme + model_file)).collect()
    own = encoders.HashedProjection(40, "x")
    tokens = {r.Record_ID: [x.token for x in sorted(t.where(F.col("Record_ID") == r.Record_ID).collect(), key=lambda x: x.pos)] for r in t.select("Record_ID").distinct().collect()}
    assert len(got) == sum(len(x) - 1 for x in tokens.values())
    for r in got:
        w = tokens[r.Record_ID]
        a, b = own.encode([" ".join(w[max(0, r.pos - 12) : r.pos]), " ".join(w[r.pos : r.pos + 12])]).astype(float)
        size = math.sqrt(a @ a) * math.sqrt(b @ b)
        assert r.semantic_continuity == pytest.approx((a @ b / size + 1) / 2 if size else 0.0, abs=5.1e-5)


def test_model_encodes_each_distinct_side_once(spark, model_file):
    t = gaps.tokens(gaps.chunks(transcripts(spark, *([TEXTS[1]] * 50))))
    plan = gaps.score(t, config=Config(continuity=model_file))._jdf.queryExecution().toString()
    assert plan.count("MapInArrow") and "BroadcastNestedLoopJoin" not in plan and "CartesianProduct" not in plan
    sides = spark.createDataFrame([(bytes([k % 3]), f"t{k % 3}") for k in range(60)], "key binary, text string")
    found = encoders.vectors(sides, encoders.find(spark, model_file)).collect()
    assert len(found) == 3 and all(len(r.vector) == 40 for r in found)


def test_model_is_loaded_once_for_a_worker(monkeypatch):
    made = []

    class Counting:
        def __init__(self, size):
            made.append(size)

        def encode(self, texts):
            return np.ones((len(texts), 2), np.float32)

    monkeypatch.setitem(encoders.KINDS, "counting", Counting)
    model = encoders.Model("m", json.dumps({"kind": "counting", "size": 7}))
    assert encoders.encoder_of(model) is encoders.encoder_of(model) and made == [7]


def bad_models(tmp_path):
    for name, contents in (("kind", '{"kind": "none"}'), ("json", "{"), ("entries", '{"kind": "hashed-projection"}')):
        path = tmp_path / f"{name}.json"
        path.write_text(contents)
        yield str(path)
    yield str(tmp_path / "missing.json")
    yield "no-such-sentence-encoder"


def test_lexical_takes_the_place_of_a_model_that_cannot_be_loaded(spark, tmp_path):
    t = gaps.tokens(gaps.chunks(transcripts(spark, TEXTS[0])))
    want = sorted((r.gap, r.semantic_continuity, r.semantic_gravity) for r in gaps.score(t, config=Config()).collect())
    for name in bad_models(tmp_path):
        with pytest.raises(encoders.NoEncoder):
            encoders.find(spark, name)
        with pytest.warns(UserWarning, match="lexical continuity is used"):
            got = gaps.score(t, config=Config(continuity=name))
        assert sorted((r.gap, r.semantic_continuity, r.semantic_gravity) for r in got.collect()) == want


@pytest.mark.parametrize("which", ["lexical", "model", "missing"])
def test_continuity_of_chunks_is_that_of_gaps(spark, model_file, monkeypatch, which):
    """Nothing but tokens is shuffled, and blocks don't change results."""
    monkeypatch.setattr(continuity, "BLOCK", 7)
    c = Config(continuity={"lexical": "lexical", "model": model_file, "missing": "missing.json"}[which])
    odd = ["a", "", "<EVENT>", "one <EVENT> two, three . four", "! ? . , ;", "\u00e9t\u00e9 na\u00efve \u00dcber it's A a", " ".join(f"W{k % 9}" for k in range(60))]
    chunked = gaps.chunks(transcripts(spark, *TEXTS, *odd))
    want = gaps.score(gaps.tokens(chunked), config=c, keep=True)
    made = gaps.tokens(continuity.with_continuity(chunked, c))
    got = gaps.score(made, config=c, keep=True)
    assert {x: str(t) for x, t in made.dtypes}["s_"] == "double"
    plan = got._jdf.queryExecution().toString()
    assert "Join" not in plan and "MapInArrow" not in plan
    columns = ["Record_ID", "gap", "s_", "semantic_continuity", "semantic_gravity", "context"]
    rows = sorted(map(tuple, got.select(*columns).collect()))
    assert rows and rows == sorted(map(tuple, want.select(*columns).collect()))


def test_hashed_projection_of_many_texts():
    own = encoders.HashedProjection(40, "x")
    texts = ["", "a b a", "?!", "b", "", "It's a", ""]
    want = [sum((own.of_word(w) for w in encoders.WORD.findall(t.lower())), np.zeros(40, np.float32)) for t in texts]
    assert (own.encode(texts) == np.array(want)).all() and (own.encode(["", "."]) == 0).all() and own.encode([]).shape == (0, 40)


def test_segments_with_a_model(spark, model_file):
    seg, bound = segmentation.segment(transcripts(spark, " ".join(f"w{k % 17}" for k in range(90))), config=Config(continuity=model_file))
    assert seg.count() >= 2 and bound.count() == 89
    spark.catalog.clearCache()


# tagger


def counted(rows, key):
    out = {}
    for x, tag in rows:
        out.setdefault(key(x), {}).setdefault(tag, 0)
        out[key(x)][tag] += 1
    return out


TRAIN = [
    [("The", "DET"), ("red", "ADJ"), ("box", "NOUN"), ("is", "AUX"), ("falling", "VERB"), (".", "PUNCT")],
    [("a", "DET"), ("box", "NOUN"), ("of", "ADP"), ("nails", "NOUN"), ("and", "CONJ"), ("the", "DET"), ("walling", "NOUN")],
    [("it", "PRON"), ("is", "AUX"), ("red", "ADJ")],
]


@pytest.fixture(scope="module")
def model(spark):
    kind = "tagged array<struct<text: string, tag: string>>"
    rows = [(s,) for s in [*TRAIN, [], None, [("odd", None), (None, "X")]]]
    return tagging.train(spark.createDataFrame(rows, kind)).cache()


def test_tagger_counts(model):
    got = {(r.kind, r.key, r.tag): r.n for r in model.collect()}
    each = [(w.lower(), t) for s in TRAIN for w, t in s]
    steps = [(a, b) for s in TRAIN for a, b in itertools.pairwise(["<s>", *[t for _, t in s]])]
    want = {("word", k, t): n for k, row in counted(each, str).items() for t, n in row.items()}
    want |= {("ending", k, t): n for k, row in counted(each, lambda w: w[-3:]).items() for t, n in row.items()}
    want |= {("step", k, t): n for k, row in counted(steps, str).items() for t, n in row.items()}
    assert got == want


def test_tagger_keeps_the_most_frequent_words(spark):
    rows = [([(w, "N") for w in ("a", "a", "b", "b", "c")],)]
    got = tagging.train(spark.createDataFrame(rows, "tagged array<struct<text: string, tag: string>>"), kept=1).collect()
    assert {r.key for r in got if r.kind == "word"} == {"a"} and {r.key for r in got if r.kind == "ending"} == {"a"}


def test_viterbi_against_brute_force(model):
    t = tagging.tagger(model)
    rng = random.Random(2)
    seen = [w for s in TRAIN for w, _ in s] + ["calling", "zzz", "Nails"]
    texts = [rng.choices(seen, k=n) for n in (0, 1, 4, 2, 5, 3, 0, 4)]
    for words, got in zip(texts, t.best(texts), strict=True):
        every = itertools.product(range(len(t.tags)), repeat=len(words))

        def cost(path, words=words):
            return sum(t.steps[b, a] + t.costs(w)[a] for w, a, b in zip(words, path, [-1, *path], strict=False))

        assert len(got) == len(words)
        if words:
            assert cost([t.tags.index(x) for x in got]) == min(map(cost, every))
    assert t.best([["The", "red", "box", "is", "falling"]]) == [["DET", "ADJ", "NOUN", "AUX", "VERB"]]
    assert t.best([]) == []


def test_shallow_structure():
    said = ["The", "red", "box", "lid", "is", "open", ".", "of", "two", "men"]
    tags = ["DET", "ADJ", "NOUN", "NOUN", "AUX", "ADJ", "PUNCT", "ADP", "NUM", "NOUN"]
    got = tagging.shallow(said, tags)
    assert [x["dep"] for x in got] == ["det", "amod", "compound", "dep", "aux", "dep", "dep", "prep", "nummod", "dep"]
    assert [x["noun_chunk"] for x in got] == [1, 1, 1, 1, None, 2, None, None, 3, 3]
    assert [x["sentence"] for x in got] == [0] * 7 + [1] * 3 and [x["ends"] for x in got].index(True) == 6 and got[6]["punct"]


def test_legality_by_a_saved_tagger_or_by_rules_alone(spark, model, tmp_path):
    t = transcripts(spark, "The red box is falling. It don't fall | a box of nails", "", "box")
    chunked = gaps.chunks(t)
    tagging.save(model, f"{tmp_path}/tagger")
    got = {(r.Record_ID, r.gap): r for r in tagging.legality(chunked, f"{tmp_path}/tagger").collect()}
    assert got["r0", 1].spacy_legality == "illegal" and "left_dep_det_needs_head" in got["r0", 1].spacy_legality_reason
    assert got["r0", 2].spacy_inside_noun_chunk and got["r0", 4].spacy_left_pos == "AUX"
    config = Config(continuity="jaccard", min_segment_tokens=2)
    own = segmentation.segment(t, config=config, parser=f"{tmp_path}/tagger")[1].collect()
    assert {r.spacy_legality for r in own} >= {"illegal"}
    rules = sorted(map(tuple, segmentation.segment(t, config=config)[1].collect()), key=str)
    spark.createDataFrame([(1,)], "x int").write.parquet(f"{tmp_path}/other")
    model.limit(0).write.parquet(f"{tmp_path}/empty")
    for bad in ("missing", "other", "empty"):
        with pytest.warns(UserWarning, match="word rules alone"):
            alone = segmentation.segment(t, config=config, parser=f"{tmp_path}/{bad}")[1]
        assert sorted(map(tuple, alone.collect()), key=str) == rules
    spark.catalog.clearCache()


def test_no_warning_without_a_model(spark):
    with warnings.catch_warnings():
        warnings.simplefilter("error", UserWarning)
        gaps.score(gaps.tokens(gaps.chunks(transcripts(spark, "a b c"))), config=Config(continuity="jaccard"))


# context


def test_context_keeps_items_columns_and_takes_time_in_proportion(spark):
    n = 60_000
    row = [F.lit("r").alias("Record_ID"), F.lit(0).cast("long").alias("Source_Row"), F.lit("t").alias("Source_Column")]
    seg = spark.range(n).select(
        *row,
        (F.col("id") + 1).alias("Segment_Index"),
        (F.col("id") * 10).alias("Token_Start"),
        (F.col("id") * 10 + 10).alias("Token_End"),
        F.concat(F.lit("s"), "id").alias("Segment_Text"),
    )
    items = spark.range(n).select(*row, F.col("id").alias("at"), F.concat(F.lit("i"), "id").alias("Annotation_Item_ID"), (F.col("id") * 10 + 10 * (F.col("id") % 2) + 5 * (F.col("id") % 3)).alias("Boundary_Gap"))
    got = sampling.segment_context(items, seg)
    assert got.columns == [*items.columns, "Previous_Segment", "Left_Segment", "Right_Segment"]
    some = {r.at: r for r in got.collect()}
    assert len(some) == n
    for k in (0, 1, 2, 3, 4, 5, 30_000, n - 2, n - 1):
        at, r = some[k].Boundary_Gap, some[k]
        ends, begins = min(at // 10, n) - 1, -(-at // 10)
        assert r.Left_Segment == (f"s{ends}" if ends >= 0 else "") and r.Right_Segment == (f"s{begins}" if begins < n else "")
        assert r.Previous_Segment == (f"s{ends - 1}" if at == 10 * ends + 10 and ends > 0 else "")


def test_a_worker_takes_few_words_apart_at_once():
    """Before, all chunks of an Arrow batch were Python objects at once."""
    import pyarrow as pa

    said = [["a"] * n for n in (3, 0, 5, 9, 1, 1)] + [None]
    b = pa.RecordBatch.from_arrays([pa.array(range(7))] * 4 + [pa.array(said, pa.list_(pa.string()))], names=["w", "x", "y", "z", "words"])
    parts = list(tagging.sliced(iter([b, b.slice(0, 0)]), 8))
    assert [p.num_rows for p in parts] == [3, 1, 3, 0] and pa.Table.from_batches(parts[:3]).to_pylist() == b.to_pylist()


def test_gaps_of_a_parse_do_not_carry_their_chunk(spark):
    """Before, each gap's row held all of the chunk's parsed tokens: the square of its length."""
    chunked = gaps.chunks(transcripts(spark, "the cat sat. it ran"))
    parsed = chunked.select(*gaps.CHUNK, F.transform("tokens", lambda t: F.struct(
        t.alias("text"), F.lit("NOUN").alias("pos"), F.lit("dep").alias("dep"), F.lit(0).alias("sentence"), F.lit(False).alias("ends"), F.lit(False).alias("punct"),
        F.lit(None).cast("int").alias("noun_chunk"))).alias("parsed"))
    got = gaps.parser_features(chunked, parsed)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    made = next(line for line in plan.split("\n") if "Generate inline" in line)
    assert "explode(sequence" not in plan and made and sorted(r["gap"] for r in got.collect()) == [1, 2, 3, 4, 5]


def test_a_parser_where_the_tokens_are_is_that_of_tables(spark, model):
    """Before, words, parses and gaps were tables that were joined to each other."""
    texts = (
        "The red box is falling. It don't fall | a box of nails",
        "box",
        "",
        "the box | is | it is red, the wall's falling! a of the box ; 'tis 12 nails",
        "don’t The Box. . , the of walling",
    )
    unnamed = transcripts(spark, "the red box").withColumn("Record_ID", F.lit(None).cast("string"))
    chunked = gaps.chunks(transcripts(spark, *texts).unionByName(unnamed), False)
    own = tagging.tagger(model)
    beside = tagging.with_parser(chunked, own)
    tabled = gaps.parser_legality(gaps.parser_features(chunked, tagging.parse(tagging.tag(tagging.words(chunked), own))))
    got = sorted(map(tuple, gaps.parser_legality(gaps.features_of(beside)).collect()))
    assert got == sorted(map(tuple, tabled.collect())) and len(got) > 25
    for mode in ("hybrid", "spacy", "rule"):
        config = Config(continuity="jaccard", legality_mode=mode)
        one, other = gaps.score(gaps.tokens(beside), config=config), gaps.score(gaps.tokens(chunked), config=config, parser=tabled)
        assert one.columns == other.columns
        assert sorted(map(tuple, one.collect()), key=str) == sorted(map(tuple, other.collect()), key=str)
        assert "Join" not in one._jdf.queryExecution().optimizedPlan().toString()
    spark.catalog.clearCache()


def test_a_batch_of_several_slices_and_long_chunks(spark, model, monkeypatch):
    rng = random.Random(4)
    seen = [w for s in TRAIN for w, _ in s] + ["don't", ",", "zzz", "Nails"]
    own = tagging.tagger(model)
    monkeypatch.setattr(tagging, "WORDS", 7)
    texts = [rng.choices(seen, k=n) for n in (3, 0, 30, 1, 1, 6, 9)]
    tokens = pa.array(texts, pa.list_(pa.string()))
    said = pa.array([[x for w in t for x in re.findall(tagging.TOKEN, w)] for t in texts], pa.list_(pa.string()))
    parts = list(tagging.cuts(tagging.sizes_of(said), 7))
    assert len(parts) > 3 and [k for a, z in parts for k in range(a, z)] == list(range(len(texts)))
    whole = tagging.placed(tokens, said).tolist()
    for a, z in parts:
        t, s = tokens.slice(a, z - a), said.slice(a, z - a)
        begin = sum(map(len, said.slice(0, a).to_pylist()))
        first = sum(map(len, texts[:a]))
        part = tagging.placed(t, s).tolist()
        assert [p + begin if p >= 0 else -1 for p in part] == whole[first : first + len(part)]
        tags = tagging.tags_of(own, s).to_pylist()
        assert tags == [x for y in own.best(s.to_pylist()) for x in y]
        found = tagging.structure(s.flatten(), pa.array(tags, pa.string()), tagging.sizes_of(s)).to_pylist()
        assert found == [x for y in s.to_pylist() for x in tagging.shallow(y, own.best([y])[0])]


def test_training_takes_time_in_proportion_to_a_chunk(spark):
    """Before, the tags of the whole chunk were made again for each of its words, and the table was read four times."""
    n = 30_000
    at = F.sequence(F.lit(0), F.lit(n - 1))
    row = spark.range(1).select(F.transform(at, lambda k: F.struct(F.concat(F.lit("W"), (k % 7).cast("string")).alias("text"), F.concat(F.lit("T"), (k % 3).cast("string")).alias("tag"))).alias("tagged"))
    began = time.monotonic()
    got = {(r.kind, r.key, r.tag): r.n for r in tagging.train(row.repartition(1)).collect()}
    took = time.monotonic() - began
    assert sum(n for (kind, *_), n in got.items() if kind == "word") == n == sum(n for (kind, *_), n in got.items() if kind == "step")
    assert got["step", "<s>", "T0"] == 1 and got["step", "T2", "T0"] == n // 3 - 1 and ("step", "T0", "T2") not in got
    assert took < 20
    spark.catalog.clearCache()


def test_overlap_of_chunks_is_that_of_windows(spark):
    """Before, sets of words were gathered in windows for each gap."""
    rng = random.Random(6)
    for width in (1, 3, 12):
        sizes = [0, 1, 2, 40, 5, 0, 90]
        lists = [[rng.randrange(-1, 9) for _ in range(n)] for n in sizes]
        got = continuity.jaccards(np.array([x for t in lists for x in t]), np.array(sizes), width).tolist()
        sides = [(set(t[max(0, k - width) : k]) - {-1}, set(t[k : k + width]) - {-1}) for t in lists for k in range(len(t))]
        assert got == [len(a & b) / len(a | b) if a and b else 0.0 for a, b in sides]
    said = ["The", "the", "don't", ",", "<EVENT>", "box", "red", "it", "12", "of"]
    texts = [" ".join(rng.choices(said, k=n)) for n in (1, 2, 30, 70, 3)]
    chunked = gaps.chunks(transcripts(spark, "", *texts), False)
    config = Config(continuity="jaccard", context_width=5)
    beside = gaps.score(gaps.tokens(continuity.with_overlap(chunked, config)), config=config)
    assert sorted(map(tuple, beside.collect()), key=str) == sorted(map(tuple, gaps.score(gaps.tokens(chunked), config=config).collect()), key=str)
