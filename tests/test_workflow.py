"""The workflow end to end, and the queries against their SQL on the smallest tables."""

import os
import uuid
from pathlib import Path

import pytest
from gapline.config import Config
from gapline.plans import oracle, queries
from gapline.plans.workflow import Workflow
from pyspark.sql import functions as F

DATA = "/root/testdata/sf0.001"


def test_workflow(spark, tmp_path):
    df = spark.createDataFrame(
        [(f"p{k}", "I rotate the piece and wait. " * 12 + "Then it fits, I think it is good. " * 6) for k in range(3)],
        "ID string, Transcript string",
    )
    flow = Workflow(spark, f"w_{uuid.uuid4().hex[:8]}")
    try:
        seg, bound, cleaned, meta, summary, signals = flow.segment_and_inspect(df, config=Config(continuity="jaccard"))
        assert seg.count() > 3 and bound.count() > 100 and cleaned.count() == 3 and summary.count() == 21 and signals.count() == 4
        assert {r.Field: r.Value for r in meta.collect()}["id_column"] == "ID"
        items, book = flow.make_template(6, "a,b")
        assert items.count() == 12 and book.count() == 10
        cells = {c: F.lit("1") for c in ("Human_C_t", "Human_M_t", "Human_A_t", "Human_R_t")} | {"Boundary_Strength_0_3": F.lit("2")}
        _, agree, per, none = flow.evaluate(items.withColumns(cells))
        assert {r.Cohen_Kappa for r in agree.collect()} == {1.0} and per.count() == 6 and none.count() == 0
        assert flow.mine_cues(items.withColumns(cells), 2, 0.5, 0.5)[1].count() > 0
        folder = flow.export_reviewed(str(tmp_path / "reviewed"), items.withColumns(cells))
        assert spark.read.parquet(f"{folder}/annotation_items").count() == 12
        assert {spark.read.parquet(f"{folder}/{x}").count() for x in ("instructions", "codebook", "short_labels")} == {3, 10, 4}
        with pytest.raises(ValueError, match="misses columns"):
            flow.evaluate(items.select("Annotation_Item_ID", "Annotator_ID"))
        state = flow.restore()
        assert state["history"].first()["status"] == "error" and state["artifacts"].count() == 6 and state[
            "step3_signal_agreement"
        ].count() == 5
    finally:
        spark.sql(f"DROP DATABASE {flow.ledger.db} CASCADE")


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no tables")
@pytest.mark.parametrize(
    "name",
    [
        "clean_artifacts",
        "tokenize_counts",
        "corpus_turns",
        "gap_pressure_gravity",
        "boundary_select",
        "segment_types",
        "turn_context",
        "signal_agreement",
        "cue_association",
        "frame_units",
        "q_matrix",
        "corpus_events",
        "legacy_turns",
        "label_validation",
        "parser_legality",
        "forced_split",
        "embedding_gate",
    ],
)
def test_query_against_sql(spark, name):
    import duckdb

    con = duckdb.connect()
    for p in Path(DATA).glob("*.parquet"):
        con.sql(f"create view {p.stem} as select * from '{p}'")
    got = queries.queries()[name](spark, DATA)
    cols = sorted(got.columns)
    want = con.sql(oracle.oracle_sql()[name])
    assert sorted(want.columns) == cols
    names = want.columns

    def key(row):
        return tuple(str(round(x, 9) if isinstance(x, float) else x) for x in row)

    assert sorted(key(r[c] for c in cols) for r in got.collect()) == sorted(
        key(dict(zip(names, r, strict=True))[c] for c in cols) for r in want.fetchall()
    )


def test_truncation_reads_the_whole_text(spark, monkeypatch):
    from gapline.plans import queries

    texts = [(1, " " * 9_999_997 + "zqx is complete."), (2, " " * 9_999_997 + "zqx. And then came zqx"), (3, None)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    monkeypatch.setattr(queries, "table", lambda *_: docs)
    assert {r.doc_id: r.truncated for r in queries.truncation_flags(spark, "").collect()} == {1: False, 2: True, 3: False}
