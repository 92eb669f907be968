"""The segmentation library on hand-derived cases, and its invariants."""

import itertools
import random
import re

import numpy as np
import pytest
from gapline import config as C
from gapline.config import Config, Vocabulary
from gapline.functions import text as T
from gapline.operators import agreement, corpus, decode, frames, gaps, qc, sampling
from gapline.plans import segmentation
from gapline.plans.ledger import Ledger, latest_by
from gapline.sources import tables
from gapline.streaming import reviews
from pyspark.sql import functions as F

LOST = "ï¿½"


def one(spark, value, expr):
    return spark.createDataFrame([(value,)], "x string").select(expr(F.col("x")).alias("y")).first()["y"]


@pytest.mark.parametrize(
    ("raw", "want"),
    [
        (f"That{LOST}{LOST}{LOST}s", "That's"),
        ("Interviewee 2: I think", "I think"),
        (None, ""),
        (f"a {LOST} b", "a - b"),
        ("x\x14y \x1cq\x1d", 'x - y "q"'),
        ("â€™tis  so", "'tis so"),
    ],
)
def test_clean(spark, raw, want):
    assert one(spark, raw, T.clean) == want


def test_artifacts(spark):
    assert one(spark, f"a{LOST}{LOST}b Speaker: \x14 Â", T.count_artifacts) == 4


def test_tokens(spark):
    assert one(spark, "a b | c", T.normalize) == "a b <EVENT> c"
    assert one(spark, "I can't, wait <EVENT> ok.", T.tokenize) == ["I", "can't", ",", "wait", "<EVENT>", "ok", "."]
    assert one(spark, "I can't, wait.", lambda x: T.detokenize(T.tokenize(x))) == "I can't, wait."
    assert one(spark, "wait, no", T.cues) == ["wait", "wait no", "no"]
    assert [
        one(spark, x, T.truncated) for x in ("then the rectangl", "it is done.", "we saw it", "", "a thi")
    ] == [True, False, False, False, True]


@pytest.mark.parametrize(
    ("left", "right", "want"),
    [
        ("the", "triangle", "after_function_word"),
        ("i", "think", "after_auxiliary_or_copula"),
        ("big", "triangle", "inside_noun_phrase"),
        ("x", "shape", "inside_compound_word"),
        ("probably", "going", "inside_adverbial_phrase"),
        ("done", "but", "before_connector"),
        ("very", "a", "after_modifier"),
        ("done", ".", "before_punctuation"),
        (".", "but", ""),
    ],
)
def test_rules(spark, left, right, want):
    assert spark.createDataFrame([(left, right)], "a string, b string").select(
        gaps.rule_reason(F.col("a"), F.col("b")).alias("r")
    ).first()["r"] == want


def test_formulas(spark):
    row = spark.range(1).select(
        F.round(gaps.thresholded_drop(F.lit(0.65), 0.35, 0.8), 4).alias("drop"),
        gaps.cue_shift(F.array(F.lit("wait")), F.array().cast("array<string>")).alias("one"),
        F.round(gaps.cue_shift(F.array(F.lit("rotate"), F.lit("turn")), F.array(F.lit("turn"), F.lit("flip"))), 4).alias("two"),
        gaps.vector_similarity(F.array(F.lit(1.0), F.lit(0.0)), F.array(F.lit(0.0), F.lit(2.0))).alias("cos"),
        gaps.vector_similarity(F.array(F.lit(0.0)), F.array(F.lit(1.0))).alias("zero"),
        gaps.lexical(F.array(F.lit("tide")), F.array(F.lit("diet"))).alias("lex"),
    ).first()
    assert (
        row["drop"],
        row["one"],
        row["two"],
        row["cos"],
        row["zero"],
        row["lex"],
    ) == (0.6667, 0.25, 0.6667, 0.5, 0.0, pytest.approx(0.35 * 0.25))


def test_greedy(spark):
    got = spark.sql(
        "select array(struct(1 k, 30 pos), struct(2 k, 20 pos), struct(3 k, 45 pos), struct(4 k, 33 pos)) c"
    ).select(decode.greedy(F.col("c"), F.lit(60), Config()).alias("g")).first()["g"]
    assert got == [30, 45]


def test_classify(spark):
    def kind(*m):
        return tuple(
            spark.range(1).select(
                *[x.alias(n) for n, x in zip("kc", decode.classify([F.lit(v).cast("double") for v in m]), strict=True)]
            ).first()
        )

    assert kind(0.35, 0.32, 0.10, 0.05)[0] == "mixed_cognitive_metacognitive" and kind(0.35, 0.32, 0.10, 0.05)[1] == pytest.approx(0.03)
    assert kind(0.1, 0.19, 0.0, 0.0)[0] == "low_signal" and kind(0.1, 0.1, 0.6, 0.0)[0] == "affective" and kind(
        None,
        None,
        None,
        None,
    )[0] == "low_signal"


def plain_cuts(n, chosen, rows, least, most):
    """Forced boundaries in the plainest form: rows are (pos, k, free, usable, bonus)."""
    added = []
    while True:
        ends = sorted({0, n, *chosen, *added})
        a, z = next(((a, z) for a, z in itertools.pairwise(ends) if z - a > most), (0, 0))
        inside = [r for r in rows if a + least <= r[0] <= z - least]
        best = sorted((r[4], r[1], abs(r[0] - (a + z) / 2), r[0]) for r in [r for r in inside if r[2]] or [r for r in inside if r[3]])
        if not best:
            return added
        added.append(best[0][3])


def columns(rows):
    return {k: np.array([r[i] for r in rows]) for i, k in ((1, "k"), (2, "free"), (3, "usable"), (4, "bonus"))}


def test_forced_cuts():
    rows = [(p, p % 7, p % 5 > 0, True, -3 if p == 41 else 0) for p in range(1, 100)]
    assert decode.forced_cuts(100, [], columns(rows), 12, 60) == [41]  # the sentence end; both spans fit then
    assert decode.forced_cuts(60, [], columns(rows[:59]), 12, 60) == []
    blocked = [(p, 0, False, p == 50, 0) for p in range(1, 100)]
    assert decode.forced_cuts(100, [], columns(blocked), 12, 60) == [50]
    rng = random.Random(6)
    for _ in range(200):
        n = rng.randrange(2, 200)
        rows = [(p, rng.randrange(5), rng.random() < 0.3, rng.random() < 0.5, rng.choice((-3, -2, 0, 0))) for p in range(1, n)]
        chosen = sorted(rng.sample(range(1, n), min(n - 1, rng.randrange(3))))
        assert decode.forced_cuts(n, chosen, columns(rows), 6, 30) == plain_cuts(n, chosen, rows, 6, 30)


def test_greedy_cuts():
    rng = random.Random(8)
    for _ in range(200):
        n, apart = rng.randrange(2, 300), rng.randrange(5, 20)
        candidates = [(rng.randrange(9), p) for p in range(1, n) if rng.random() < 0.3]
        want = []
        for _, p in sorted(candidates):
            if 5 <= p <= n - 5 and all(abs(p - q) >= apart for q in want):
                want.append(p)
        assert decode.greedy_cuts(n, candidates, 5, apart) == sorted(want)


def test_merge_plan():
    rng = random.Random(4)
    for _ in range(300):
        sizes = [rng.randrange(1, 12) for _ in range(rng.randrange(1, 25))]
        values = [rng.choice((float("nan"), rng.randrange(-9999, 9999) / 1e4)) for _ in sizes]
        cap, most = rng.randrange(1, 10), rng.randrange(5, 60)
        left = [([i], s, v) for i, (s, v) in enumerate(zip(sizes, values, strict=True))]
        while len(left) > cap:
            total, i = min((a[1] + b[1], i) for i, (a, b) in enumerate(itertools.pairwise(left)))
            if total > most:
                break
            a, b = left[i : i + 2]
            mean = a[2] if b[2] != b[2] else b[2] if a[2] != a[2] else decode.half_up(a[2], b[2])
            left[i : i + 2] = [(a[0] + b[0], total, mean)]
        runs = decode.merge_plan(sizes, cap, most)
        assert [decode.leaves(r) for r in runs] == [x[0] for x in left]
        assert [repr(decode.joint_mean(r, values)) for r in runs] == [repr(x[2]) for x in left]


@pytest.fixture(scope="module")
def talk(spark):
    rng = random.Random(7)
    words = [
        "rotate",
        "the",
        "shape",
        "wait",
        "maybe",
        "then",
        "it",
        "is",
        "hard",
        "so",
        "piece",
        "fits",
        "left",
        ".",
        ",",
        "I",
        "think",
        "good",
        "no",
        "because",
    ]
    rows = [
        (f"r{k}", k + 2, "text", " ".join(rng.choices(words, k=n)) + (" | " + " ".join(rng.choices(words, k=30)) if k % 3 == 0 else ""))
        for k, n in enumerate([3, 20, 80, 150, 300, 1, 40])
    ]
    rows += [("empty", 20, "text", ""), ("null", 21, "text", None)]
    return spark.createDataFrame(rows, "Record_ID string, Source_Row long, Source_Column string, text string")


def local(spark, df):
    """The same rows, computed once."""
    return spark.createDataFrame(df.collect(), df.schema)


@pytest.fixture(scope="module")
def segmented(spark, talk):
    return tuple(local(spark, x) for x in segmentation.segment(talk, config=Config(continuity="jaccard")))


def test_segments_tile_chunks(spark, talk):
    cfg = Config(continuity="jaccard")
    tokens, scored = (local(spark, x) for x in segmentation.boundary_table(talk, config=cfg))
    seg = decode.segments(tokens, scored).collect()
    size = {}
    for r in tokens.collect():
        size[r.Record_ID, r.chunk] = (r.offset, r.n_tokens)
    for (rec, _), (a, n) in size.items():
        own = sorted((s.Token_Start, s.Token_End) for s in seg if s.Record_ID == rec and a <= s.Token_Start < a + n)
        assert own[0][0] == a and own[-1][1] == a + n and all(x[1] == y[0] for x, y in itertools.pairwise(own))
        if len(own) > 1:
            assert all(z - b >= cfg.min_segment_tokens for b, z in own)
    chosen = [r for r in scored.collect() if r.selected_boundary]
    assert any(r.forced_max_length_boundary for r in chosen) or chosen
    assert all(r.constraint_reason == "" for r in chosen if not r.forced_max_length_boundary)


def test_segment_cap_and_evidence(spark, talk):
    from difflib import SequenceMatcher

    seg, bound = segmentation.segment(
        talk,
        config=Config(max_segments_per_record=2, max_segment_tokens=500),
        vocabulary=Vocabulary.from_texts(task="rotate shape"),
    )
    seg, bound = local(spark, seg), local(spark, bound)
    for r in bound.collect():  # the default continuity, by hand
        sides = [
            sorted({w.lower() for w in x.split() if re.fullmatch("[A-Za-z0-9]+", w.strip(".,;:!?"))} if x.strip() else set())
            for x in r.context.split("<BOUNDARY>")
        ]
        a, b = ([w.strip(".,;:!?") for w in x] for x in sides)
        a, b = sorted(set(a)), sorted(set(b))
        near = len(set(a) & set(b)) / len(set(a) | set(b)) if a and b else 0
        want = max(near, 0.35 * SequenceMatcher(None, " ".join(a), " ".join(b)).ratio()) if a and b else 0
        assert r.semantic_continuity == pytest.approx(want, abs=6e-5)
    per = {r.Record_ID: r["count"] for r in seg.groupBy("Record_ID").count().collect()}
    assert max(per.values()) <= 2 and not {"empty", "null"} & set(per)
    assert bound.columns == [*gaps.RECORD, *segmentation.EVIDENCE] and len(segmentation.EVIDENCE) == 38
    assert all(r.Token_Count == r.Token_End - r.Token_Start for r in seg.collect() if not r.Merged_By_Max_Segment_Count)


def test_partitions_do_not_matter(spark, talk):
    def rows(n):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        return sorted(map(tuple, segmentation.segment(talk.repartition(n), config=Config(continuity="jaccard"))[0].collect()))

    try:
        assert rows(1) == rows(7)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", 2)


def test_parser_features(spark):
    f = spark.createDataFrame(
        [
            ("r", 2, "text", 1, "ADP", "NOUN", "prep", "pobj", "box", False, True, False, False),
            ("r", 2, "text", 2, "NOUN", "NOUN", "x", "y", "box", False, True, False, False),
            ("r", 2, "text", 3, "NOUN", "NOUN", "x", "y", "then", False, True, False, False),
        ],
        "Record_ID string, Source_Row long, Source_Column string, gap int, left_pos string, right_pos string, left_dep string, right_dep string, right_lower string, right_is_punct boolean, same_sentence boolean, sentence_boundary boolean, inside_noun_chunk boolean",
    )
    p = gaps.parser_legality(f)
    assert [(r.spacy_legality, r.spacy_legality_reason) for r in p.orderBy("gap").collect()] == [
        ("illegal", "inside_prepositional_phrase"),
        ("semi_legal", "within_sentence_noncue_gap"),
        ("legal", ""),
    ]
    t = spark.createDataFrame(
        [("r", 2, "text", "one two three four five")],
        "Record_ID string, Source_Row long, Source_Column string, text string",
    )
    got = segmentation.boundary_table(t, config=Config(continuity="jaccard", legality_mode="spacy"), parser=p)[1].orderBy("gap").collect()
    assert [r.boundary_legality for r in got] == ["illegal", "semi_legal", "legal", "legal"] and got[1].legality_penalty == 0.18


def test_alignment(spark):
    """Words and a parser's tokens: the next four tokens are looked at, and a miss moves nothing on."""
    cases = [
        ("I do n't know .", ["I", "don't", "know", "."], [0, None, 3, 4]),
        ("a b c d e f", ["a", "f", "b"], [0, None, 1]),
        ("x y Wait , no", ["Wait", ",", "<EVENT>", "no"], [2, 3, None, 4]),
        ("", ["a"], [None]),
        ("don’t \"stop\"", ["don't", "stop"], [0, 1]),
    ]
    rows = [([(t, "NOUN", "x", 0, False, False, None) for t in text.split()], words) for text, words, _ in cases]
    df = spark.createDataFrame(rows, f"parsed {gaps.PARSED}, words array<string>")
    got = [r.at for r in df.select(gaps.aligned(F.col("words"), F.col("parsed")).alias("at")).collect()]
    assert got == [at for *_, at in cases]


def test_encoder_sees_texts(spark):
    t = spark.createDataFrame(
        [("r", 2, "text", "one two, one two three")],
        "Record_ID string, Source_Row long, Source_Column string, text string",
    )
    tokens = gaps.tokens(gaps.chunks(t))
    vector = lambda x: F.array(F.length(x).cast("double"), F.lit(3.0))
    got = gaps.score(tokens, config=Config(continuity="jaccard"), text_similarity=gaps.encoded_similarity(vector)).orderBy("gap").collect()
    for r in got:
        a, b = ((len(x.strip()), 3.0) for x in r.context.split("<BOUNDARY>"))
        cos = (a[0] * b[0] + 9) / ((a[0] ** 2 + 9) * (b[0] ** 2 + 9)) ** 0.5
        assert r.semantic_continuity == pytest.approx((cos + 1) / 2, abs=6e-5)


def test_row_numbers_follow_the_input(spark):
    df = spark.range(0, 100, 1, 7).where("id % 3 > 0")
    got = [(r.id, r.row) for r in tables.with_row_numbers(df).collect()]
    assert got == [(x, k + 2) for k, x in enumerate(x for x in range(100) if x % 3)]
    assert tables.with_row_numbers(df.where("false")).count() == 0


def test_quality_control(segmented):
    seg, bound = segmented
    m = {r.Metric: r for r in qc.summary(seg, bound).collect()}
    assert set(m) == set(qc.CRITERIA) and m["Event token leakage"].Status == "PASS" and m["Selected illegal boundaries"].Value == 0
    assert {r.Signal for r in qc.signals(seg, bound).collect()} == set(C.SIGNALS)
    with pytest.raises(ValueError, match="misses columns"):
        qc.summary(seg.drop("Segment_Text"), bound)


def test_sampling(spark, segmented):
    seg, bound = segmented
    items = local(spark, sampling.boundary_items(bound))
    n = items.count()
    for size in (1, 5, n, n + 10):
        s = sampling.stratified_sample(items, size).collect()
        assert len({r.Annotation_Item_ID for r in s}) == len(s) == min(size, n)
    ctx = {r.Annotation_Item_ID: r for r in sampling.segment_context(items, seg).collect()}
    by = {}
    for s in seg.orderBy("Segment_Index").collect():
        by.setdefault(s.Record_ID, []).append(s)
    for r in ctx.values():
        own = by[r.Record_ID]
        left = [x for x in own if x.Token_End <= r.Boundary_Gap]
        right = [x for x in own if x.Token_Start >= r.Boundary_Gap]
        assert r.Left_Segment == (left[-1].Segment_Text if left else "") and r.Right_Segment == (right[0].Segment_Text if right else "")
    t = sampling.template(items, "A; B,A")
    assert t.count() == 2 * n and t.columns[:3] == [
        "Annotation_ID",
        "Annotation_Item_ID",
        "Annotator_ID",
    ] and sampling.parse_annotators(" ") == ["Annotator_1"]
    assert sampling.review_progress(t).first()["Completed"] == 0
    assert sampling.for_annotator(t, "B").count() == n and sampling.for_annotator(t, "").count() == 0


def labels(spark, rows):
    return spark.createDataFrame(
        rows,
        "Annotation_ID string, Annotation_Item_ID string, Annotator_ID string, Boundary_Strength_0_3 string, Human_C_t string, Human_M_t string, Human_A_t string, Human_R_t string, Boundary_Context string",
    )


def test_agreement(spark):
    a, b = [1, 1, 0, 0], [1, 0, 0, 0]
    rows = [
        (f"{k}{w}", f"i{k}", w, str(v * 2), str(v), "yes", None, "1.0", "wait no") for k in range(4) for w, v in (("x", a[k]), ("y", b[k]))
    ]
    got = {r.Signal: r for r in agreement.signal_agreement(labels(spark, rows)).collect()}
    assert got["C_t"].Cohen_Kappa == 0.5 and got["C_t"].Exact_Agreement == 0.75 and got["C_t"].Multi_Annotated_Items == 4
    assert got["M_t"].Cohen_Kappa == 1.0 and got["R_t"].Completed_Labels == 8 and "A_t" not in got
    items = {r.Annotation_Item_ID: r for r in agreement.item_agreement(labels(spark, rows)).collect()}
    assert items["i1"].Boundary_Strength_Values == "2, 0" and items["i1"].C_t_Disagreement and not items["i0"].C_t_Disagreement
    assert [r.Annotation_Item_ID for r in agreement.disagreement(labels(spark, rows)).collect()] == ["i1"]


def test_cues(spark):
    rows = [(str(k), f"i{k}", "x", "1", str(int(k < 6)), "0", "0", "0", "wait no" if k < 6 else "then rotate") for k in range(12)]
    cues = agreement.cue_association(labels(spark, rows))
    assert {
        (r.Signal, r.Cue, r.Support, r.Precision, r.Recall, r.Lift) for r in cues.collect()
    } == {("C_t", c, 6, 1.0, 1.0, 2.0) for c in ("wait", "no", "wait no")}
    lists = agreement.recommended(cues)
    assert {r.Signal: (r.words, r.phrases) for r in lists.collect()}["C_t"] == (["no", "wait"], ["wait no"])
    assert '"min_support":5' in agreement.vocabulary_json(lists).first()["vocabulary"]


def test_label_cells(spark):
    df = spark.createDataFrame([("0", "0"), ("1", "1")], "Human_Boundary_Valid string, Confidence_1_3 string")
    out = sampling.migrate(df)
    assert out.columns == ["Boundary_Strength_0_3"] and sorted(r[0] for r in out.collect()) == ["0", "2"]
    bad = labels(
        spark,
        [
            ("a", "i", "x", "4", "1", "1", "1", "1", ""),
            ("b", "i", "x", "3", "maybe", "1", "1", "1", ""),
            ("c", "i", "x", "", "", "", "", "", ""),
        ],
    ).withColumn("Human_Primary_Type", F.lit(""))
    assert sorted(r.Annotation_ID for r in sampling.invalid_labels(bad).collect()) == ["a", "b"]


def test_silver_labels(spark):
    assert [one(spark, x, frames.silver_label) for x in ("then rotate", "wait rotate", "confused wait", "zzz")] == [3, 1, 2, 0]


def test_frame_segments(spark):
    text = "I rotate the shape. I align the triangle. Wait, I think it is wrong. It is frustrating. Let me turn this edge."
    t = spark.createDataFrame([("a", text)], "id string, text string")
    u = frames.units(t, frames.scored_frames(frames.frames(t, 3), task_words=frames.DEMO_T_WORDS), 3, 1, 0.4)
    assert [r.text for r in u.orderBy("unit").collect()] == [
        "I rotate the shape. I align the triangle.",
        "Wait, I think it is wrong. It is frustrating.",
        "Let me turn this edge.",
    ]
    assert frames.frames(t.withColumn("text", F.lit("two words")), 5).count() == 0 and frames.frames(
        t.withColumn("text", F.lit("two words")),
        5,
        short=True,
    ).count() == 1
    q = frames.batch(t).collect()
    assert all(r.Q_S + r.Q_M + r.Q_A + r.Q_T == (r.Dominant_Dim != "None") for r in q)



def test_frames_by_words(spark):
    """A text's words are made plain once; gates that read the frame's text have the same results."""
    rows = [("a", "I think it's wrong-ish, \u0130stanbul\u00a0x \u212aelvin GO fit! rotate 12 -- yay the \u00c9dge edge"), ("b", "1 2 3 4 5 6"), ("c", "too short"), ("d", ""), ("e", "turn the long match align and fit it again stupid hard " * 5)]
    t = spark.createDataFrame(rows, "id string, text string")
    by_text = lambda frame: frames.demo_gates(frame)
    assert frames.frames_for(frames.demo_gates, t, 5).columns == ["id", "i", "words", "n_words"] and "frame" in frames.frames_for(by_text, t, 5).columns
    one, two = (frames.scored_frames(frames.frames_for(g, t, 5), g).select("id", "i", "n_words", "gates", "gravity") for g in (frames.demo_gates, by_text))
    assert sorted(map(tuple, one.collect())) == sorted(map(tuple, two.collect())) and one.count() == sum(max(0, len(x.split(" ")) - 4) for _, x in rows if x.strip()) - 1
    assert sorted(map(tuple, frames.batch(t).collect())) == sorted(map(tuple, frames.batch(t, by_text).collect()))


def test_gates(spark):
    rng = random.Random(1)
    rows = [(k % 4, [float(k % 4 == i) + rng.random() / 10 for i in range(4)]) for k in range(80)]
    v = spark.createDataFrame(rows, "label int, vector array<double>")
    w, b, accuracy = frames.train_gates(v)
    g = v.select("label", frames.linear_gates(F.col("vector"), w, b).alias("g")).collect()
    assert accuracy == 1.0 and all(max(range(4), key=r.g.__getitem__) == r.label and abs(sum(r.g) - 1) < 1e-9 for r in g)


def test_corpus(spark):
    text = "intro\nInterviewer: hi [Pause 3s] there 01:30\nInterviewee 2: I  [Laughter] turn it\r\nInterviewee:   \nInterviewer: ok [unintelligible word]"
    raw = spark.createDataFrame(
        [(text, "et-12", "a.doc", "p", "ok", None)],
        "text string, stem string, file_name string, source_path string, status string, error string",
    )
    p = corpus.prepare(raw)
    t = corpus.turns(p)
    rows = t.orderBy("Turn_Index").collect()
    assert [(r.Turn_Index, r.Speaker, r.Turn_Text) for r in rows] == [
        (1, "Interviewer", "hi <EVENT> there 01:30"),
        (2, "Interviewee", "I <EVENT> turn it"),
        (3, "Interviewer", "ok <EVENT>"),
    ]
    e = corpus.events(t).orderBy("Turn_Index").collect()
    assert (e[0].Event_Type, e[0].Event_Text, e[0].Char_Start, e[0].Char_End) == ("Pause", "[Pause 3s]", 3, 13)
    d = corpus.documents(p, t).first()
    assert (
        d.ID,
        d.Turn_Count,
        d.Interviewee_Turns,
        d.Interviewee_Response,
        d.Unintelligible_Count,
        d.Timestamp_Count,
    ) == ("ET_12", 3, 1, "I <EVENT> turn it", 1, 1)
    assert "- Parsed speaker turns: 3" in corpus.report(corpus.documents(p, t), t, corpus.events(t))
    assert one(
        spark,
        "Interviewee: a  b Interviewer: q Interviewee:  Interviewer: z interviewee: c\nd",
        corpus.legacy_turns,
    ) == ["a b", "c d"]
    assert one(spark, "see ete21-1234 now", T.mentioned_id) == "ETE21_1234"


def test_sources(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿ID,Item 1,Score\n7,café,3\n".encode())
    (tmp_path / "b.csv").write_bytes("ID,Transcript\n8,café\n".encode("cp1252"))
    (tmp_path / "c.jsonl").write_text('﻿{"text": "x", "stem": "s"}\n\n{"text": "y", "stem": "t"}\n')
    a = tables.read_table(spark, str(tmp_path / "a.csv"))
    assert a.columns == ["ID", "Item 1", "Score"] and a.first()["Item 1"] == "café"
    assert tables.read_table(spark, str(tmp_path / "b.csv")).first()["Transcript"] == "café"
    assert tables.read_jsonl(spark, str(tmp_path / "c.jsonl")).count() == 2
    assert tables.infer_id_column(a) == "ID" and tables.infer_text_columns(a, None, "ID") == ["Item 1"]
    with pytest.raises(ValueError, match="unknown kind"):
        tables.read_table(spark, "x.bin")
    with pytest.raises(ValueError, match="no column"):
        tables.infer_id_column(a, "nope")
    cleaned, n = tables.clean_table(spark.createDataFrame([("\x14x", 1)], "a string, b int"))
    assert cleaned.first()["a"] == "- x" and n.first()["artifacts"] == 1
    tables.write_tables(str(tmp_path / "out"), segments=a.select("ID"))
    assert spark.read.parquet(str(tmp_path / "out/segments")).count() == 1
    long = segmentation.long_form(a, "ID", ["Item 1", "Score"])
    assert sorted(map(tuple, long.collect())) == [("7", 2, "Item 1", "café"), ("7", 2, "Score", "3")]


def test_ledger(spark):
    import uuid

    book = Ledger(spark, f"t_{uuid.uuid4().hex[:8]}")
    book.log_event("a", parameters={"x": 1})
    book.log_event("b", status="error", message="no")
    book.save_artifact("s1", "p1")
    book.save_artifact("s1", "p2")
    assert [
        r.operation for r in book.history(1).collect()
    ] == ["b"] and book.artifact_path("s1") == "p2" and book.artifact_path("s2") is None
    book.replace_table("my table!", spark.range(3))
    assert book.read_table("my table!").count() == 3 and book.read_table("none").count() == 0
    df = spark.createDataFrame([(1, 1, "x"), (1, 2, "y"), (2, 1, "z")], "k int, o int, v string")
    assert sorted(r.v for r in latest_by(df, "k", "o").collect()) == ["y", "z"]
    spark.sql(f"DROP DATABASE {book.db} CASCADE")


def test_review_stream(spark, tmp_path):
    (tmp_path / "in").mkdir()
    base = labels(spark, [("a", "i", "x", "", "", "", "", "", ""), ("b", "j", "x", "", "", "", "", "", "")])
    for k, v in enumerate(("1", "3")):
        (tmp_path / "in" / f"{k}.json").write_text(
            f'{{"Annotation_ID": "a", "saved_at": "2024-01-0{k + 1}T00:00:00Z", "Boundary_Strength_0_3": "{v}"}}'
        )
        reviews.keep_reviews(
            reviews.review_stream(spark, str(tmp_path / "in")),
            str(tmp_path / "log"),
            str(tmp_path / "cp"),
        ).awaitTermination(60)
    got = {r.Annotation_ID: r.Boundary_Strength_0_3 for r in reviews.current_labels(spark, base, str(tmp_path / "log")).collect()}
    assert got == {"a": "3", "b": ""}


def exchanges(df) -> int:
    return df._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning")


def test_gaps_are_not_shuffled(spark):
    """Texts are dealt out by record, and chunks with their cuts; no row of a token or gap is (before: joins of the gaps with the chosen places)."""
    t = spark.createDataFrame([("a", 1, "x", "one two three. " * 60), ("b", 2, "x", None)], "Record_ID string, Source_Row long, Source_Column string, text string")
    cut = segmentation.cut_chunks(gaps.chunks(t, False), None, Config(continuity="jaccard"))
    plan = segmentation.evidence(cut, None, Config(continuity="jaccard"))
    assert exchanges(plan) == 2 and exchanges(decode.chunk_segments(cut)) == 2
    assert plan.where("selected_boundary").count() == cut.selectExpr("sum(size(cuts))").first()[0] > 2


def test_segments_of_chunks_equal_those_of_tokens(spark):
    words = "so we turn it and then I think the big square fits. but wait it is hard, okay now flip it".split()
    t = spark.createDataFrame(
        [(f"r{k}", k, "x", " ".join(words[(i * i * k + i) % len(words)] for i in range(30 * k + 2))) for k in range(6)], "Record_ID string, Source_Row long, Source_Column string, text string"
    )
    c = Config(continuity="jaccard", max_segment_tokens=30)
    tokens, scored = segmentation.boundary_table(t, config=c, clean_text=False)
    cut = segmentation.cut_chunks(gaps.chunks(t, False), None, c)
    assert sorted(map(str, decode.chunk_segments(cut).collect())) == sorted(map(str, decode.segments(tokens, scored).collect()))


def test_cue_runs_are_told_apart_before_the_shuffle(spark):
    """Runs go to one shuffle, as sums by run (before: to another by text and run, one row for each)."""
    rows = [("1", "ann", "so so so we turn", "1"), ("1", "ben", "so so so we turn", "0"), ("2", "ann", "so we go", "1"), ("3", "ann", None, None)]
    x = spark.createDataFrame(rows, "Annotation_Item_ID string, Annotator_ID string, Boundary_Context string, Human_C_t string")
    x = x.withColumns({f"Human_{s}": F.lit(None).cast("string") for s in C.SIGNALS[1:]})
    got = agreement.cue_association(x, 1, 0.0, 0.0)
    assert exchanges(got) == 3  # texts, for runs and for the total (one exchange, reused), and runs
    found = {r["Cue"]: (r["Support"], r["Positive_With_Cue"]) for r in got.collect()}
    assert found["so"] == (3, 2) and found["so we"] == (3, 2) and found["so so so"] == (2, 1) and found["go"] == (1, 1) and len(found) == 12
