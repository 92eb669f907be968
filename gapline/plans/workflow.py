"""The calibration workflow: each step writes its current tables, its artifact and a log row; a failed step logs the error and raises."""

from __future__ import annotations

from collections.abc import Callable
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapline.config import Config, Vocabulary
from gapline.operators import agreement, qc, sampling
from gapline.plans import codebook, segmentation
from gapline.plans.ledger import Ledger
from gapline.sources import tables

#: current tables of each step
TABLES = {
    0: ("step0_segments", "step0_boundaries", "step0_cleaned_input", "step0_run_metadata"),
    1: ("step1_prevalidation_summary", "step1_signal_saturation_summary"),
    2: ("step2_annotation_items", "step2_codebook"),
    3: ("step3_completed_labels", "step3_signal_agreement", "step3_item_agreement", "step3_disagreement_items"),
    4: ("step4_labeled_rows_for_cue_analysis", "step4_recommended_cues", "step4_vocab_summary"),
}


class Workflow:
    def __init__(self, spark: SparkSession, database: str = "calibration"):
        self.spark, self.ledger = spark, Ledger(spark, database)

    def _step(self, number: int, operation: str, parameters: dict, work: Callable[[], tuple[DataFrame, ...]]) -> tuple[DataFrame, ...]:
        try:
            for name, df in zip(TABLES[number], work(), strict=True):
                self.ledger.replace_table(name, df)
        except Exception as error:
            self.ledger.log_event(operation, parameters=parameters, status="error", message=str(error)[:1000])
            raise
        self.ledger.save_artifact(f"step{number}_{operation}", parameters=parameters)
        self.ledger.log_event(operation, parameters=parameters)
        return tuple(self.ledger.read_table(n) for n in TABLES[number])

    def segment(
        self,
        df: DataFrame,
        id_column: str | None = None,
        text_columns: str | list[str] | None = None,
        item_column: str | None = None,
        row_column: str | None = None,
        vocabulary: Vocabulary | None = None,
        config: Config | None = None,
        clean_text: bool = True,
    ) -> tuple[DataFrame, ...]:
        """Segments, boundaries, cleaned input and run metadata of a table of transcripts."""
        cfg = config or Config()

        def work() -> tuple[DataFrame, ...]:
            cleaned, artifacts = tables.clean_table(df) if clean_text else (df, None)
            id_col = tables.infer_id_column(cleaned, id_column)
            texts = tables.infer_text_columns(cleaned, text_columns, id_col)
            long = segmentation.long_form(cleaned, id_col, texts, item_column, row_column)
            seg, bound = segmentation.segment(long, vocabulary, cfg, clean_text)
            found = artifacts.first()["artifacts"] if artifacts is not None else 0
            meta = segmentation.run_metadata(
                self.spark,
                cfg,
                id_column=id_col,
                text_columns=", ".join(texts),
                clean_text=clean_text,
                encoding_artifacts=found,
            )
            return seg, bound, cleaned, meta

        return self._step(0, "segment", {"id_column": id_column, "text_columns": text_columns}, work)

    def inspect(self) -> tuple[DataFrame, ...]:
        seg, bound = (self.ledger.read_table(n) for n in TABLES[0][:2])
        return self._step(1, "inspect", {}, lambda: (qc.summary(seg, bound), qc.signals(seg, bound)))

    def segment_and_inspect(self, df: DataFrame, **options: Any) -> tuple[DataFrame, ...]:
        return self.segment(df, **options) + self.inspect()

    def make_template(self, sample_size: int = 50, annotators: str = "Annotator_1", seed: int = 42) -> tuple[DataFrame, ...]:
        seg, bound = (self.ledger.read_table(n) for n in TABLES[0][:2])

        def work() -> tuple[DataFrame, ...]:
            sample = sampling.stratified_sample(sampling.boundary_items(bound), sample_size, seed)
            return sampling.template(sampling.segment_context(sample, seg), annotators), codebook.codebook(self.spark)

        return self._step(2, "template", {"sample_size": sample_size, "annotators": annotators, "seed": seed}, work)

    def evaluate(self, labels: DataFrame) -> tuple[DataFrame, ...]:
        if "Annotation_ID" not in labels.columns:
            labels = labels.withColumn("Annotation_ID", F.concat_ws("__", "Annotation_Item_ID", "Annotator_ID"))
        return self._step(
            3,
            "evaluate",
            {},
            lambda: (
                sampling.migrate(labels),
                agreement.signal_agreement(labels),
                agreement.item_agreement(labels),
                agreement.disagreement(labels),
            ),
        )

    def mine_cues(
        self,
        labels: DataFrame,
        min_support: int = 5,
        min_precision: float = 0.65,
        min_lift: float = 1.5,
    ) -> tuple[DataFrame, ...]:
        def work() -> tuple[DataFrame, ...]:
            cues = agreement.cue_association(labels, min_support, min_precision, min_lift)
            return labels, cues, agreement.vocabulary_summary(agreement.recommended(cues))

        return self._step(4, "cues", {"min_support": min_support, "min_precision": min_precision, "min_lift": min_lift}, work)

    def export_reviewed(self, folder: str, labels: DataFrame | None = None, form: str = "parquet") -> str:
        """The reviewed annotations (the current template, or ``labels``) with instructions, codebook and short labels, one folder each, under ``folder``."""
        items = sampling.migrate(self.ledger.read_table("step2_annotation_items") if labels is None else labels)
        if items.isEmpty():
            raise ValueError("there are no annotation items yet")
        book = self.ledger.read_table("step2_codebook")
        book = codebook.codebook(self.spark) if book.isEmpty() else book
        tables.write_tables(
            folder,
            form,
            annotation_items=items,
            instructions=codebook.instructions(self.spark),
            codebook=book,
            short_labels=codebook.short_labels(self.spark),
        )
        self.ledger.save_artifact("step2_reviewed_annotation_template", folder)
        self.ledger.log_event("export_reviewed_template", output_path=folder)
        return folder

    def restore(self) -> dict[str, DataFrame]:
        """The current tables of all steps, the history and the artifacts."""
        return self.ledger.restore(*[n for names in TABLES.values() for n in names])
