"""Queries over the supplied tables, one for each operator, and the same in SQL where SQL can say it.

The synthetic prose has few of the default cue words, so the queries pass a vocabulary of frequent words; the operators are the same.
"""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import gapline
from gapline import config as C
from gapline.config import Config, Vocabulary
from gapline.functions import text as T
from gapline.operators import agreement, continuity, corpus, decode, frames, gaps, qc, sampling, tagging, training
from gapline.plans import ledger, segmentation
from gapline.sources import tables, workbook
from gapline.sources.shared import shared_folder

WORDS = Vocabulary.from_texts(
    task="the and that this la der",
    cognitive="is it to with are de le un und die",
    metacognitive="of in en que zu",
    affective="for by du el ist",
    structural="or but on et y",
)
CONFIG = Config(continuity="jaccard")
LOW = Config(continuity="jaccard", max_segments_per_record=6, max_segment_tokens=40)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def transcripts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each turn of a conversation as a transcript."""
    c = table(spark, sf_dir, "conversations")
    return c.select(
        F.concat_ws("_", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("Record_ID"),
        F.col("turn").cast("long").alias("Source_Row"),
        F.lit("text").alias("Source_Column"),
        "text",
    )


def _gaps(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> DataFrame:
    chunked = continuity.with_continuity(gaps.chunks(transcripts(spark, sf_dir), False), config)
    return gaps.score(gaps.tokens(chunked), WORDS, config)


def _cut(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> DataFrame:
    """Chunks with their boundaries."""
    return segmentation.cut_chunks(gaps.chunks(transcripts(spark, sf_dir), False), WORDS, config)


def _segments(spark: SparkSession, sf_dir: str, config: Config = CONFIG) -> tuple[DataFrame, DataFrame]:
    seg, bound = segmentation.segment(transcripts(spark, sf_dir), WORDS, config, clean_text=False)
    return seg, bound


def clean_artifacts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.md5(T.clean(F.col("text"))).alias("cleaned_md5"), T.count_artifacts(F.col("text")).alias("artifacts"))


def tokenize_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.coalesce("text", F.lit(""))).alias("t"))
    return d.select(
        "doc_id",
        F.size("t").alias("n_tokens"),
        F.size(F.filter("t", lambda x: T.is_word(x))).alias("n_words"),
        F.md5(F.array_join("t", " ")).alias("tokens_md5"),
        F.md5(T.detokenize(F.col("t"))).alias("detokenized_md5"),
    )


def truncation_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    return d.select("doc_id", T.truncated(F.col("text")).alias("truncated"))


def _interviews(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as interview documents: users are interviewees, all others interviewers."""
    c = table(spark, sf_dir, "conversations")
    who = F.when(F.col("role") == "user", "Interviewee: ").otherwise("Interviewer: ")
    turn = F.struct(
        "turn",
        F.concat(who, F.coalesce("text", F.lit("")), F.when(F.col("turn") % 3 == 0, " [Pause 3s] ").otherwise("\n")).alias("t"),
    )
    d = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(turn)), lambda x: x.t), "").alias("text"))
    return d.select(
        "text",
        F.concat(F.lit("et-"), F.col("conv_id").cast("string")).alias("stem"),
        F.lit("conversations").alias("file_name"),
        F.lit("").alias("source_path"),
        F.lit("ok").alias("status"),
        F.lit("").alias("error"),
    )


def corpus_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = corpus.turns(corpus.prepare(_interviews(spark, sf_dir)))
    return t.select(
        "ID",
        "Turn_Index",
        "Speaker",
        F.md5("Turn_Text").alias("turn_md5"),
        "Word_Count",
        "Event_Count",
        "Unintelligible_Count",
        "Timestamp_Count",
    )


def corpus_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = corpus.events(corpus.turns(corpus.prepare(_interviews(spark, sf_dir))))
    return e.drop("Mentioned_ID", "Source_File")


def corpus_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = corpus.prepare(_interviews(spark, sf_dir))
    d = corpus.documents(p, corpus.turns(p))
    return d.select(
        "ID",
        "Text_Chars",
        "Text_Words",
        "Turn_Count",
        "Interviewee_Turns",
        "Interviewer_Turns",
        "Interviewee_Words",
        "Unintelligible_Count",
        "Timestamp_Count",
        "Artifact_Count",
        F.md5("Interviewee_Response").alias("response_md5"),
    )


def legacy_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = _interviews(spark, sf_dir)
    said = corpus.legacy_turns(F.col("text"))
    return d.select("stem", F.size(said).alias("Total_Turns"), F.md5(F.array_join(said, " | ")).alias("response_md5"))


SIGNAL_COLUMNS = ("task_density", "metacognitive_reset", "affective_friction", "structural_break")


def gap_density_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select("Record_ID", "gap", *SIGNAL_COLUMNS)


def gap_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select(
        "Record_ID",
        "gap",
        "semantic_continuity",
        "semantic_drop_component",
        "cognitive_cue_shift",
        "cognitive_cue_evidence",
    )


def gap_pressure_gravity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select(
        "Record_ID",
        "gap",
        "cognitive_transition",
        "transition_pressure",
        "raw_semantic_gravity",
        "semantic_gravity",
    )


def gap_legality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _gaps(spark, sf_dir).select(
        "Record_ID",
        "gap",
        "left_token",
        "right_token",
        "rule_constraint_reason",
        "boundary_legality",
        "sentence_boundary_boost",
    )


def valley_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = decode.valleys(_gaps(spark, sf_dir), CONFIG)
    return v.select("Record_ID", "gap", "candidate_boundary", "constraint_blocked")


def boundary_select(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = decode.boundaries(_cut(spark, sf_dir))
    return b.where("not forced_max_length_boundary").select("Record_ID", "gap", "semantic_gravity")


def boundary_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All evidence columns of every gap."""
    return _segments(spark, sf_dir)[1]


def lexical_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity with the sequence ratio, the default."""
    return _gaps(spark, sf_dir, Config(continuity="lexical")).select("Record_ID", "gap", "semantic_continuity", "semantic_gravity")


#: a model in a file: words as random directions
MODEL = os.path.join(os.path.dirname(gapline.__file__), "models", "words16.json")


def encoded_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity by the vectors that a model gives the two sides."""
    return _gaps(spark, sf_dir, Config(continuity=MODEL)).select("Record_ID", "gap", "semantic_continuity", "semantic_gravity")


def segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir)[0]


def forced_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    b = decode.boundaries(_cut(spark, sf_dir, Config(continuity="jaccard", max_segment_tokens=25)))
    return b.where("forced_max_length_boundary").select("Record_ID", "gap", "semantic_gravity")


def cap_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _segments(spark, sf_dir, LOW)[0]


def _greedy_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Segments without forced boundaries."""
    free = Config(continuity="jaccard", max_segment_tokens=1_000_000)
    return decode.chunk_segments(_cut(spark, sf_dir, free))


def segment_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _greedy_segments(spark, sf_dir)
    return s.select(
        "Record_ID",
        "Segment_Index",
        "Token_Start",
        "Token_End",
        "Token_Count",
        F.md5("Segment_Text").alias("text_md5"),
        "Segment_Type",
        "Mean_C_t",
        "Mean_M_t",
        "Mean_A_t",
        "Mean_R_t",
        "Mean_Semantic_Gravity",
    )


def qc_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.summary(*_segments(spark, sf_dir))


def qc_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return qc.signals(*_segments(spark, sf_dir))


def qc_token_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The metrics of whole turns as segments, which SQL can follow."""
    t = transcripts(spark, sf_dir).select("*", F.size(T.tokenize(F.coalesce("text", F.lit("")))).alias("Token_Count"))
    seg = t.select(
        "Record_ID",
        "Source_Column",
        F.lit(1).alias("Segment_Index"),
        F.lit(0).alias("Token_Start"),
        F.col("Token_Count").alias("Token_End"),
        "Token_Count",
        F.col("text").alias("Segment_Text"),
    )
    none = seg.select(
        "Record_ID",
        "Source_Column",
        F.lit(1).alias("gap"),
        F.lit(True).alias("candidate_boundary"),
        (F.col("Token_Count") > 50).alias("selected_boundary"),
    )
    return qc.summary(seg, none).select("Metric", "Value", "Status")


def boundary_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.boundary_items(segmentation.evidence(_cut(spark, sf_dir), WORDS, CONFIG))


def _document_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("Annotation_Item_ID"),
        F.concat_ws("_", "lang", F.when(F.col("n_chars") > 2000, "long").otherwise("short")).alias("Sampling_Stratum"),
    )


def stratified_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 items of a pilot round: the sample is the feature."""
    return sampling.stratified_sample(_document_items(spark, sf_dir), 50, 42)


def template_expand(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.template(_document_items(spark, sf_dir), "Ana, Ben; Ana,Cy").select(
        "Annotation_ID",
        "Annotation_Item_ID",
        "Annotator_ID",
        "Sampling_Stratum",
        "Notes",
    )


def segment_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    seg, bound = _segments(spark, sf_dir)
    items = sampling.boundary_items(bound).select("Annotation_Item_ID", "Record_ID", "Source_Row", "Source_Column", "Boundary_Gap")
    return sampling.segment_context(items, seg).select(
        "Annotation_Item_ID",
        "Previous_Segment",
        "Left_Segment",
        "Right_Segment",
    )


def turn_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    """As-of context of every tenth token place of a conversation among its turns."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("conv_id").alias("Record_ID"),
        F.lit(0).alias("Source_Row"),
        F.lit("text").alias("Source_Column"),
        (F.col("turn") + 1).alias("Segment_Index"),
        (F.col("turn") * 10).alias("Token_Start"),
        (F.col("turn") * 10 + 10).alias("Token_End"),
        F.md5("text").alias("Segment_Text"),
    )
    items = c.select(
        "Record_ID",
        "Source_Row",
        "Source_Column",
        F.explode(F.array(F.col("Token_Start"), F.col("Token_Start") + 5)).alias("Boundary_Gap"),
    )
    items = items.withColumn(
        "Annotation_Item_ID",
        F.concat_ws("_", F.col("Record_ID").cast("string"), F.col("Boundary_Gap").cast("string")),
    )
    return sampling.segment_context(items, c).select("Annotation_Item_ID", "Previous_Segment", "Left_Segment", "Right_Segment")


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two raters of each labelled document, from its quality and toxicity."""
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    who = F.explode(
        F.array(
            F.struct(F.lit("r1").alias("w"), F.col("quality").alias("v"), F.lit(0).alias("k")),
            F.struct(F.lit("r2").alias("w"), (1 - F.col("toxic")).alias("v"), F.lit(1).alias("k")),
        )
    )
    x = lab.select("doc_id", "quality", "toxic", "text", who.alias("r"))
    text = x.select(
        F.concat(F.lit("d_"), F.col("doc_id").cast("string")).alias("Annotation_Item_ID"),
        F.col("r.w").alias("Annotator_ID"),
        "doc_id",
        "text",
        (F.col("r.v") * 2 + F.col("r.k") * F.col("toxic")).cast("string").alias("Boundary_Strength_0_3"),
        F.col("r.v").cast("string").alias("Human_C_t"),
        F.when(F.col("quality") == 1, "yes").otherwise("no").alias("Human_M_t"),
        F.when(F.col("doc_id") % 5 > 0, F.col("toxic").cast("string")).alias("Human_A_t"),
        F.when(F.col("r.k") == 0, F.col("quality").cast("string")).alias("Human_R_t"),
    )
    return text.withColumn("Annotation_ID", F.concat_ws("__", "Annotation_Item_ID", "Annotator_ID"))


def signal_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.signal_agreement(_labels(spark, sf_dir).drop("text"))


def item_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.item_agreement(_labels(spark, sf_dir).drop("text"))


def disagreement_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = agreement.disagreement(_labels(spark, sf_dir).drop("text"))
    return d.select(
        "Annotation_Item_ID",
        "Annotator_Count",
        "Boundary_Strength_Values",
        "C_t_Disagreement",
        F.col("Annotation_ID").alias("First_Annotation"),
    )


def kappa(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = table(spark, sf_dir, "labels").select(F.lit("all").alias("g"), F.col("quality").alias("a"), (1 - F.col("toxic")).alias("b"))
    return agreement.kappa(pairs, ["g"]).select("g", F.round("kappa", 6).alias("kappa"))


def _cues(spark: SparkSession, sf_dir: str, longest: int = 3) -> DataFrame:
    labels = _labels(spark, sf_dir).withColumnRenamed("text", "Boundary_Context")
    return agreement.cue_association(labels, 5, 0.65, 1.05, longest)


def cue_association(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _cues(spark, sf_dir)


def recommended_vocab(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 50 best cues of each signal: a top-k report."""
    return agreement.vocabulary_summary(agreement.recommended(_cues(spark, sf_dir)))


def review_progress(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sampling.review_progress(_labels(spark, sf_dir).drop("text"))


def _frame_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return transcripts(spark, sf_dir).select(F.col("Record_ID").alias("id"), F.coalesce("text", F.lit("")).alias("text"))


#: frequent words in the place of the demonstration's
GATE_WORDS = {"A": ("for", "by", "du", "el", "ist"), "M": ("of", "in", "en", "que", "zu"), "T": ("the", "and", "la", "der", "de")}


@frames.by_words
def _gates(w):
    lit = {k: F.array(*[F.lit(x) for x in v]) for k, v in frames.DEMO_GATES.items()}
    out = lit["S"]
    for k in ("T", "M", "A"):
        out = F.when(F.arrays_overlap(w, F.array(*[F.lit(x) for x in GATE_WORDS[k]])), lit[k]).otherwise(out)
    return out


def silver_label(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _frame_texts(spark, sf_dir).select(
        "id",
        frames.silver_label(F.col("text")).alias("label"),
        frames.has_task(F.col("text")).alias("has_task"),
    )


def sliding_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = frames.frames(_frame_texts(spark, sf_dir), 5, 2)
    return f.groupBy("id").agg(
        F.count(F.lit(1)).alias("n_frames"),
        F.max("i").alias("last"),
        F.md5(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "frame"))), lambda x: x.frame), "|")).alias("frames_md5"),
    )


def frame_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = _frame_texts(spark, sf_dir)
    s = frames.scored_frames(frames.framed_words(t, 5), _gates, GATE_WORDS["T"])
    return frames.units(t, s, 5, 1, 0.35).select("id", "unit", "a", "z", F.md5("text").alias("text_md5"))


def q_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return frames.batch(_frame_texts(spark, sf_dir), _gates)


def gate_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Loss and accuracy of each epoch of the gates' training on vectors, whose labels are dealt to four classes."""
    e = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.pmod("label", F.lit(4)).alias("label"), F.col("embedding").alias("vector"))
    gates = training.train(e, 4, epochs=3, batch=512, rate=0.02)
    rows = [(k + 1, round(a, 6), round(b, 6)) for k, (a, b) in enumerate(zip(gates.losses, gates.accuracies, strict=True))]
    return spark.createDataFrame(rows, "epoch int, loss double, accuracy double")


def embedding_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings")
    weights = [[((i * 7 + k * 3) % 11 - 5) / 10.0 for i in range(64)] for k in range(4)]
    g = frames.linear_gates(F.col("embedding"), weights, [0.1, 0.0, -0.1, 0.2])
    return e.select("vec_id", g.alias("g")).select(
        "vec_id",
        *[F.round(F.col("g")[k], 4).alias(f"g{d}") for k, d in enumerate(frames.DIMENSIONS)],
    )


def cosine_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Continuity of each vector with the next of its label."""
    from pyspark.sql import Window

    e = table(spark, sf_dir, "embeddings").withColumn(
        "next",
        F.lead("embedding").over(Window.partitionBy("label").orderBy("vec_id")),
    ).where("next is not null")
    return e.select("vec_id", F.round(gaps.vector_similarity(F.col("embedding"), F.col("next")), 4).alias("continuity"))


def event_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last 100 events: a top-k report."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "user_id", "event_type")
    return ledger.history(e, 100)


def latest_artifact(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value")
    return ledger.latest_by(e, "user_id", "event_id")


def column_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells of the columns that inference picks, in long form, of the turns under the names that a form export gives its columns."""
    c = table(spark, sf_dir, "conversations").select(
        F.col("turn").alias("Response 1"),
        F.col("role").alias("Choice"),
        F.concat_ws("_", "conv_id", "turn").alias("Student_ID"),
        F.col("text").alias("item 2"),
        F.upper("role").alias("Item 10"),
        F.col("role").alias("Remarks"),
    )
    key = tables.infer_id_column(c)
    cells = segmentation.long_form(c, key, tables.infer_text_columns(c, None, key), row_column="Response 1")
    return cells.select("Record_ID", "Source_Row", "Source_Column", F.md5("text").alias("text_md5"))


#: silver tags to train the tagger on: frequent words, then endings, else NOUN
POS = (
    ("DET", "the a la le der die el"),
    ("AUX", "is are was be ist est"),
    ("ADP", "of in to for with de en du von zu"),
    ("PRON", "it this that il er"),
)
ENDINGS = (("ADV", ("ly",)), ("VERB", ("ing", "ed", "en", "er")), ("ADJ", ("al", "ous", "ich", "que")))


def _silver(low):
    out = F.when(low.rlike("^[^a-z0-9]+$"), "PUNCT").when(low.rlike("^[0-9]+$"), "NUM")
    for tag, these in POS:
        out = out.when(low.isin(*these.split()), tag)
    for tag, ends in ENDINGS:
        out = out.when(low.rlike(f"({'|'.join(ends)})$"), tag)
    return out.otherwise("NOUN")


def _tagger(chunked: DataFrame) -> tagging.Tagger:
    """Trained on silver tags of the even conversations."""
    even = tagging.words(chunked.where(F.substring_index("Record_ID", "_", 1).cast("long") % 2 == 0))
    low = even.select(F.transform("words", F.lower).alias("words"))
    silver = low.select(F.transform("words", lambda w: F.struct(w.alias("text"), _silver(w).alias("tag"))).alias("tagged"))
    return tagging.tagger(tagging.train(silver))


def tagged_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every chunk's words with their tags."""
    chunked = gaps.chunks(transcripts(spark, sf_dir), False)
    t = tagging.tag(tagging.words(chunked), _tagger(chunked))
    pair = F.posexplode(F.arrays_zip("words", "tags")).alias("at", "x")
    return t.select("Record_ID", "chunk", pair).select("Record_ID", "chunk", "at", F.col("x.words").alias("word"), F.col("x.tags").alias("tag"))


def _parsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with a parser's features of their gaps."""
    chunked = gaps.chunks(transcripts(spark, sf_dir), False)
    return tagging.with_parser(chunked, _tagger(chunked))


def parser_legality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Legality of gaps by a parser's tokens, aligned with the text's own."""
    p = gaps.parser_legality(gaps.features_of(_parsed(spark, sf_dir)))
    return p.select(
        "Record_ID",
        F.col("gap").cast("int").alias("gap"),
        "spacy_legality",
        "spacy_legality_reason",
        "spacy_left_pos",
        "spacy_right_dep",
        "spacy_same_sentence",
        "spacy_sentence_boundary",
        "spacy_inside_noun_chunk",
    )


def legality_modes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rules and parser together: legality, penalty and boost of each gap."""
    chunked = continuity.with_overlap(_parsed(spark, sf_dir), CONFIG)
    out = gaps.score(gaps.tokens(gaps.dealt(chunked)), WORDS, CONFIG)
    return out.select(
        "Record_ID",
        "gap",
        "boundary_legality",
        "legality_reason",
        "constraint_reason",
        "legality_penalty",
        "sentence_boundary_boost",
        "semantic_gravity",
    )


def label_migration(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Old validity labels, in several spellings, as strengths."""
    lab = table(spark, sf_dir, "labels")
    old = F.when(F.col("doc_id") % 4 == 0, F.col("quality").cast("double").cast("string")).when(
        F.col("doc_id") % 4 == 1,
        F.when(F.col("quality") == 1, " True ").otherwise("false"),
    ).when(F.col("doc_id") % 4 == 2, F.col("quality").cast("string")).otherwise("")
    return sampling.migrate(lab.select("doc_id", old.alias("Human_Boundary_Valid"), F.lit("2").alias("Confidence_1_3")))


def label_validation(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with cells outside the permitted values, some of them made so."""
    x = _labels(spark, sf_dir).drop("text")
    n = F.col("doc_id") * 2 + (F.col("Annotator_ID") == "r2").cast("int")
    x = x.withColumn("Boundary_Strength_0_3", F.when(n % 11 == 0, "4").when(n % 11 == 1, " ").otherwise(F.col("Boundary_Strength_0_3")))
    x = x.withColumn("Human_M_t", F.when(n % 7 == 0, "maybe").otherwise(F.col("Human_M_t"))).withColumn(
        "Human_Primary_Type",
        F.when(n % 5 == 0, "mixed").when(n % 13 == 0, "other").otherwise(""),
    )
    return sampling.invalid_labels(x).select("Annotation_ID", "Boundary_Strength_0_3", "Human_M_t", "Human_Primary_Type")


def review_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations with the last saved review of each; every third has some."""
    x = _labels(spark, sf_dir).drop("text")
    n = (F.col("doc_id") * 2 + (F.col("Annotator_ID") == "r2").cast("int")) % 3
    saved = F.explode(F.sequence(F.lit(1), F.lit(3))).alias("saved_at")
    reviews = x.where(n == 0).select("Annotation_ID", saved).withColumns(
        {"Boundary_Strength_0_3": F.col("saved_at").cast("string"), "Human_C_t": F.when(F.col("saved_at") == 3, "0").otherwise("1")}
    )
    return sampling.apply_reviews(x, reviews).select("Annotation_ID", "Boundary_Strength_0_3", "Human_C_t", "Human_M_t")


def annotator_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = sampling.review_table(sampling.for_annotator(_labels(spark, sf_dir).drop("text", "doc_id"), " r2 "))
    return x.select("Annotation_ID", "Review_Status")


def label_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells of several spellings as choices, binary labels, strengths and booleans."""
    cell = F.element_at(
        F.array(*[F.lit(x) for x in ("0", "1.0", " True", "false", "yes", "N", "3", "2.0", "", "4", "maybe")]),
        (F.pmod("doc_id", F.lit(11)) + 1).cast("int"),
    )
    x = table(spark, sf_dir, "labels").select("doc_id", cell.alias("cell"))
    return x.select(
        "doc_id",
        T.choice(F.col("cell")).alias("choice"),
        T.binary_label(F.col("cell")).alias("binary"),
        T.strength_label(F.col("cell")).alias("strength"),
        T.as_bool(F.col("cell")).alias("boolean"),
    )


def gate_training_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts with silver labels, as the gates are trained on."""
    c = table(spark, sf_dir, "conversations").select(
        F.concat(F.lit("Interviewee: "), F.col("text")).alias("a"),
        F.when(F.col("turn") % 2 == 0, F.col("role")).alias("b"),
    )
    return frames.training_set(c, ["a", "b"]).groupBy("label").agg(F.count(F.lit(1)).alias("texts"), F.sum(F.length("text")).alias("chars"))


def cleaned_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole table cleaned, with the artifacts found in all its cells."""
    d = table(spark, sf_dir, "documents").select("doc_id", "text", F.concat(F.lit("Speaker 1: "), "source").alias("source"))
    cleaned, found = tables.clean_table(d)
    return cleaned.select("doc_id", F.md5("text").alias("text_md5"), "source").withColumn("artifacts", found.scalar())


def vocabulary_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return agreement.vocabulary_json(agreement.recommended(_cues(spark, sf_dir), 20), 5, 0.65, 1.05)


def corpus_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The lines of the extraction report."""
    p = corpus.prepare(_interviews(spark, sf_dir))
    t = corpus.turns(p)
    lines = corpus.report(corpus.documents(p, t), t, corpus.events(t)).split("\n")
    return spark.createDataFrame(list(enumerate(lines)), "line int, text string")


def document_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids from file names and from the whole texts, in which every third document is mentioned at the end; raw artifacts and words of the texts."""
    d = table(spark, sf_dir, "documents")
    stem = F.concat(F.lit("ete21-"), F.lpad(F.col("doc_id").cast("string"), 4, "0"))
    said = F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit(" see "), stem)).otherwise("")
    text = F.concat(F.coalesce("text", F.lit("")), said, F.when(F.col("doc_id") % 2 == 0, "\x02").otherwise(""))
    return d.select(
        "doc_id",
        T.source_id(stem).alias("id"),
        T.mentioned_id(text).alias("mentioned"),
        T.raw_artifacts(text).alias("artifacts"),
        T.word_count(text).alias("words"),
    )


def source_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Text cells in long form, rows numbered as they are read; read by the table reader."""
    c = tables.read_table(spark, f"{sf_dir}/nation.parquet")
    return segmentation.long_form(
        c,
        "n_nationkey",
        ["n_name", "n_comment"] if "n_comment" in c.columns else ["n_name"],
    ).select("Record_ID", "Source_Row", "Source_Column", F.md5("text").alias("text_md5"))


def workbook_sheets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers and nations written as two sheets of a workbook, read back by name and by number, and joined."""
    path = f"{shared_folder(spark)}/gapline-{uuid.uuid4().hex}.xlsx"
    workbook.write({"customers": table(spark, sf_dir, "customer"), "nations": table(spark, sf_dir, "nation")}, path)
    c, n = tables.read_table(spark, path, "customers"), tables.read_table(spark, path, 1)
    out = c.join(n, F.col("c_nationkey") == F.col("n_nationkey"), "left")
    return out.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment", "n_nationkey", "n_name")


def run_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return segmentation.run_metadata(spark, CONFIG, rows=table(spark, sf_dir, "conversations").count())


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [
        clean_artifacts,
        tokenize_counts,
        truncation_flags,
        corpus_turns,
        corpus_events,
        corpus_documents,
        legacy_turns,
        gap_density_signals,
        gap_continuity,
        gap_pressure_gravity,
        gap_legality_rules,
        valley_candidates,
        boundary_select,
        boundary_evidence,
        lexical_continuity,
        encoded_continuity,
        segments,
        segment_types,
        forced_split,
        cap_merge,
        qc_summary,
        qc_signals,
        qc_token_lengths,
        boundary_items,
        stratified_sample,
        template_expand,
        segment_context,
        turn_context,
        signal_agreement,
        item_agreement,
        disagreement_items,
        kappa,
        cue_association,
        recommended_vocab,
        review_progress,
        silver_label,
        sliding_frames,
        frame_units,
        q_matrix,
        gate_training,
        embedding_gate,
        cosine_continuity,
        event_history,
        latest_artifact,
        column_inference,
        tagged_words,
        parser_legality,
        legality_modes,
        label_migration,
        label_validation,
        review_upsert,
        annotator_rows,
        label_cells,
        gate_training_set,
        cleaned_table,
        vocabulary_json,
        corpus_report,
        document_ids,
        source_rows,
        run_facts,
        workbook_sheets,
    ]
    return {f.__name__: f for f in found}
