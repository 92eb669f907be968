"""Reference tables for annotators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

CODEBOOK = (
    ("Boundary_Strength_0_3", "0, 1, 2, 3", "How clearly the process changes at the marked break: 0 not at all, 3 clearly."),
    ("Human_C_t", "0, 1", "The speaker turns to another operation, comparison or plan."),
    ("Human_M_t", "0, 1", "The speaker monitors, doubts or corrects the own thinking."),
    ("Human_A_t", "0, 1", "The speaker voices ease, difficulty or feeling."),
    ("Human_R_t", "0, 1", "A connective or discourse marker opens a new step."),
    ("Human_Primary_Type", "cognitive, metacognitive, affective, structural, task, mixed, none", "The main kind of the change."),
    ("Cue_Span", "text", "Words that show the change."),
    ("Counterexample_or_Exclusion", "text", "Why the cue misleads here, if it does."),
    ("Codebook_Issue", "text", "What the codebook leaves open."),
    ("Notes", "text", "Anything else."),
)
INSTRUCTIONS = (
    ("Task", "Judge the break at the mark between the left and the right segment; the mark isn't part of the text."),
    ("Order", "Read previous, left and right segment first, then the context, then fill in the labels."),
    ("Limits", "Fill in only the label columns; leave ids, context and scores as they are."),
)
SHORT = {"C_t": "cognitive transition", "M_t": "metacognitive reset", "A_t": "affective friction", "R_t": "structural break"}


def codebook(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(CODEBOOK, "Field string, Values string, Meaning string")


def instructions(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(INSTRUCTIONS, "Section string, Instruction string")


def short_labels(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(SHORT.items()), "Signal string, Label string")
