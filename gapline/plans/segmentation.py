"""Transcripts to segments: the whole plan, and its tables."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapline.config import Config, Vocabulary
from gapline.operators import continuity, decode, gaps, tagging, wide
from gapline.sources.shared import Scope
from gapline.sources.tables import with_row_numbers

#: boundary table, in order, after the record's keys
EVIDENCE = (
    "gap left_token right_token semantic_continuity task_density cognitive_transition semantic_drop_component cognitive_cue_evidence cognitive_cue_shift "
    "metacognitive_reset affective_friction structural_break transition_pressure raw_semantic_gravity semantic_gravity boundary_legality legality_reason "
    "legality_penalty sentence_boundary_boost rule_constraint_reason spacy_legality spacy_legality_reason spacy_left_pos spacy_right_pos spacy_left_dep "
    "spacy_right_dep spacy_same_sentence spacy_sentence_boundary spacy_inside_noun_chunk local_threshold boundary_margin candidate_boundary "
    "selected_boundary forced_max_length_boundary constraint_blocked constraint_reason review_flag context"
).split()


def long_form(
    df: DataFrame,
    id_column: str | None,
    text_columns: list[str],
    item_column: str | None = None,
    row_column: str | None = None,
) -> DataFrame:
    """Record_ID, Source_Row, Source_Column and text, one row for each text cell. ``row_column`` numbers the source's rows; without one,
    rows are numbered as they are read (2 is the first, as in a sheet with a header)."""
    df = with_row_numbers(df, "_row") if row_column is None else df.withColumn("_row", F.col(row_column))
    record = F.col(id_column).cast("string") if id_column else (F.col("_row") - 1).cast("string")
    if item_column:
        record = F.concat_ws("__", record, F.col(item_column).cast("string"))
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("Source_Column"), F.col(c).alias("text")) for c in text_columns])).alias("cell")
    return df.select(
        record.alias("Record_ID"),
        F.col("_row").cast("long").alias("Source_Row"),
        cells,
    ).select("Record_ID", "Source_Row", "cell.*")


def cut_chunks(
    chunked: DataFrame,
    vocabulary: Vocabulary | None = None,
    config: Config | None = None,
    parser: DataFrame | None = None,
    text_similarity: Callable[[Column, Column], Column] | None = None,
) -> DataFrame:
    """Chunks with their boundaries (:func:`gapline.operators.decode.cuts`). The continuity is kept where it is dear."""
    c = config or Config()
    keep = c.continuity != "jaccard" or text_similarity is not None
    if text_similarity is None:
        chunked = continuity.with_continuity(chunked, c)
    scored = gaps.score(gaps.tokens(chunked), vocabulary, c, parser, text_similarity=text_similarity, keep=keep)
    return gaps.dealt(decode.cuts(decode.valleys(scored, c), c))


def evidence(cut: DataFrame, vocabulary: Vocabulary | None = None, config: Config | None = None, parser: DataFrame | None = None) -> DataFrame:
    """All gaps of :func:`cut_chunks`, scored with their marks: no gap is looked up in another table."""
    c = config or Config()
    return decode.with_marks(decode.valleys(gaps.score(decode.marked_tokens(cut), vocabulary, c, parser), c))


def boundary_table(
    transcripts: DataFrame,
    vocabulary: Vocabulary | None = None,
    config: Config | None = None,
    clean_text: bool = True,
    parser: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """(tokens, gaps with decoded boundaries)."""
    chunked = gaps.chunks(transcripts, clean_text)
    return gaps.tokens(chunked), evidence(cut_chunks(chunked, vocabulary, config, parser), vocabulary, config, parser)


#: characters of a record that one task can hold as tokens and gaps
LONG = 1_000_000

def segment(
    transcripts: DataFrame,
    vocabulary: Vocabulary | None = None,
    config: Config | None = None,
    clean_text: bool = True,
    parser: DataFrame | str | None = None,
    text_similarity: Callable[[Column, Column], Column] | None = None,
    long_text: int | None = LONG,
) -> tuple[DataFrame, DataFrame]:
    """(segments, boundaries) of ``transcripts`` (Record_ID, Source_Row, Source_Column, text).

    Records with more than ``long_text`` characters are shared out to many tasks (:mod:`gapline.operators.wide`), with the same results; they are
    looked for first. None: there are none to look for.
    ``parser`` is the path of a saved tagger (:mod:`gapline.operators.tagging`) or a table of :func:`gapline.operators.gaps.parser_legality`.
    The chunks with their boundaries are kept for both results: tokens and a few numbers for each gap. The wide evidence is scored again if it is
    asked for, by the kept continuity if the sequence ratio, a model or ``text_similarity`` (see
    :func:`gapline.operators.gaps.encoded_similarity`) makes that dear. ``unpersist`` or the catalog's ``clearCache`` releases it."""
    c = config or Config()
    if long_text is not None and not (far := transcripts.where(F.length("text") > long_text)).isEmpty():
        near = transcripts.where(F.length("text").isNull() | (F.length("text") <= long_text))
        seg, bound = _segment(near, vocabulary, c, clean_text, parser, text_similarity)
        seg2, bound2 = _segment_long(far, vocabulary, c, clean_text, parser, text_similarity)
        return decode.cap_segments(seg.unionByName(seg2), c), bound.unionByName(bound2)
    seg, bound = _segment(transcripts, vocabulary, c, clean_text, parser, text_similarity)
    return decode.cap_segments(seg, c), bound


def _segment(transcripts, vocabulary, c: Config, clean_text: bool, parser, text_similarity) -> tuple[DataFrame, DataFrame]:
    chunked = gaps.chunks(transcripts, clean_text)
    if isinstance(parser, str):
        parser = tagging.legality(chunked, parser)
    cut = cut_chunks(chunked, vocabulary, c, parser, text_similarity).persist()
    return decode.chunk_segments(cut), evidence(cut, vocabulary, c, parser).select(*gaps.RECORD, *EVIDENCE)


def _segment_long(transcripts, vocabulary, c: Config, clean_text: bool, parser, text_similarity, block: int = wide.BLOCK) -> tuple[DataFrame, DataFrame]:
    """The same for very long records, a record in many tasks. What it writes to the shared folder stays for the results."""
    scope = Scope(transcripts.sparkSession)
    if isinstance(parser, str):
        parser = tagging.legality(gaps.chunks(transcripts, clean_text), parser)
    tokens = scope.keep(wide.tokens(transcripts, scope, clean_text))
    around = wide.in_blocks(tokens, c.context_width + c.local_radius + 1, block)
    scored = scope.keep(decode.valleys(gaps.score(around, vocabulary, c, parser, text_similarity=text_similarity), c))
    chosen = scope.keep(wide.select(scored, c, scope, block))
    own = wide.numbered(decode.with_scores(tokens, chosen), block)
    return decode.number_segments(decode.segment_bodies(own)), chosen.select(*gaps.RECORD, *EVIDENCE)


def run_metadata(spark, config: Config, **facts: object) -> DataFrame:
    """Field and Value rows of a run."""
    rows = [(k, str(v)) for k, v in (facts | asdict(config)).items()]
    return spark.createDataFrame(rows, "Field string, Value string")
