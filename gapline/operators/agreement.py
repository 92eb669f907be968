"""Agreement between annotators, and cue words associated with labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline import config as C
from gapline.functions import text as T
from gapline.operators.qc import require
from gapline.operators.sampling import migrate

STRENGTH = "Boundary_Strength_0_3"
LABELS = (STRENGTH, *C.SIGNALS)
#: labels of a signal are fewer than half of this
PAIR = 1 << 32
CONTEXT = ("Cue_Span", "Boundary_Context", "Left_Segment", "Right_Segment")


def labelled(labels: DataFrame) -> DataFrame:
    """Adds the numeric labels ``Boundary_Strength_bin`` and ``C_t_bin`` .. ``R_t_bin``."""
    labels = migrate(labels)
    require(labels, {"Annotation_Item_ID", "Annotator_ID", STRENGTH, *[f"Human_{s}" for s in C.SIGNALS]}, "labels")
    return labels.withColumns(
        {"Boundary_Strength_bin": T.strength_label(F.col(STRENGTH))} | {f"{s}_bin": T.binary_label(F.col(f"Human_{s}")) for s in C.SIGNALS}
    )


def _cells(labels: DataFrame, order: str) -> DataFrame:
    """Signal, item, annotator and label of each filled cell; a pair's first label in ``order`` counts for agreement (first)."""
    cells = F.array(
        *[F.struct(F.lit(s).alias("Signal"), F.col("Boundary_Strength_bin" if s == STRENGTH else f"{s}_bin").alias("v")) for s in LABELS]
    )
    long = labelled(labels).select(
        F.col("Annotation_Item_ID").alias("item"),
        F.col("Annotator_ID").alias("who"),
        F.col(order).alias("o"),
        F.explode(cells).alias("e"),
    ).select("item", "who", "o", "e.*").where("v is not null")
    w = Window.partitionBy("Signal", "item", "who").orderBy("o")
    return long.withColumn("first", F.row_number().over(w) == 1)


def kappa(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Unweighted kappa of (a, b) for each of ``keys``: 1 when expected and observed agreement are 1, null when undefined."""
    n = pairs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("a") == F.col("b")).alias("same"))
    sides = pairs.select(
        *keys,
        F.explode(
            F.array(F.struct(F.lit("a").alias("side"), F.col("a").alias("v")), F.struct(F.lit("b").alias("side"), F.col("b").alias("v")))
        ).alias("e"),
    ).select(*keys, "e.*")
    marginal = sides.groupBy(*keys, "v").agg(F.count_if(F.col("side") == "a").alias("na"), F.count_if(F.col("side") == "b").alias("nb"))
    chance = marginal.groupBy(*keys).agg(F.sum(F.col("na") * F.col("nb")).alias("x"))
    out = n.join(chance, keys) if keys else n.withColumn("one", F.lit(1)).join(chance.withColumn("one", F.lit(1)), "one").drop("one")
    sq = F.col("n") * F.col("n")  # whole numbers: (n * same - x) / (n * n - x)
    value = F.when(F.col("x") == sq, F.when(F.col("same") == F.col("n"), 1.0)).otherwise(
        (F.col("n") * F.col("same") - F.col("x")) / (sq - F.col("x"))
    )
    return out.select(*keys, value.alias("kappa"))


def signal_agreement(labels: DataFrame, order: str = "Annotation_ID") -> DataFrame:
    """For each label: completed labels, mean, items with two annotators or more, their exact agreement, and kappa where the items of
    exactly two annotators involve two annotators in all."""
    cells = _cells(labels, order)
    base = cells.groupBy("Signal").agg(
        F.count(F.lit(1)).alias("Completed_Labels"),
        F.round(F.sum("v") / F.count("v"), 3).alias("Positive_Rate"),
    )
    one = cells.where("first")
    item = one.groupBy("Signal", "item").agg(
        F.count(F.lit(1)).alias("n"),
        (F.min("v") == F.max("v")).alias("same"),
        F.min("who").alias("w1"),
        F.max("who").alias("w2"),
        F.min_by("v", "who").alias("a"),
        F.max_by("v", "who").alias("b"),
    )
    multi = item.where("n >= 2").groupBy("Signal").agg(
        F.count(F.lit(1)).alias("Multi_Annotated_Items"),
        F.round(F.count_if("same") / F.count(F.lit(1)), 3).alias("Exact_Agreement"),
    )
    two = item.where("n = 2")
    lone = two.groupBy("Signal").agg(
        F.min("w1").alias("x1"),
        F.max("w1").alias("x2"),
        F.min("w2").alias("y1"),
        F.max("w2").alias("y2"),
    ).where("x1 = x2 and y1 = y2").select("Signal")
    k = kappa(two.join(lone, "Signal", "left_semi").select("Signal", "a", "b"), ["Signal"])
    out = base.join(multi, "Signal", "left").join(k, "Signal", "left")
    return out.select(
        "Signal",
        "Completed_Labels",
        "Positive_Rate",
        F.coalesce("Multi_Annotated_Items", F.lit(0)).alias("Multi_Annotated_Items"),
        "Exact_Agreement",
        F.round("kappa", 3).alias("Cohen_Kappa"),
    )


def item_agreement(labels: DataFrame, order: str = "Annotation_ID") -> DataFrame:
    """For each item: annotators, its strengths in order, positives and disagreement of each label."""
    rows = labelled(labels)
    values = F.array_sort(
        F.collect_list(
            F.when(F.col("Boundary_Strength_bin").isNotNull(), F.struct(F.col(order).alias("o"), F.col("Boundary_Strength_bin").alias("v")))
        )
    )

    def differs(c: str) -> Column:
        return F.coalesce(F.min(c) != F.max(c), F.lit(False))

    aggs = [
        F.count_distinct("Annotator_ID").alias("Annotator_Count"),
        F.array_join(F.transform(values, lambda x: x.v.cast("string")), ", ").alias("Boundary_Strength_Values"),
        differs("Boundary_Strength_bin").alias("Boundary_Strength_Disagreement"),
    ]
    for s in C.SIGNALS:
        aggs += [F.coalesce(F.sum(f"{s}_bin"), F.lit(0)).alias(f"{s}_Positive_Count"), differs(f"{s}_bin").alias(f"{s}_Disagreement")]
    return rows.groupBy("Annotation_Item_ID").agg(*aggs)


def disagreement(labels: DataFrame, order: str = "Annotation_ID") -> DataFrame:
    """Items with any disagreement, with the item's first annotation."""
    items = item_agreement(labels, order)
    flags = [c for c in items.columns if c.endswith("_Disagreement")]
    w = Window.partitionBy("Annotation_Item_ID").orderBy(order)
    example = migrate(labels).withColumn("rn_", F.row_number().over(w)).where("rn_ = 1").drop("rn_")
    example = example.select(
        *[F.col(c).alias(f"{c}_example") if c in items.columns and c != "Annotation_Item_ID" else F.col(c) for c in example.columns]
    )
    return items.where(reduce(lambda a, b: a | b, [F.col(c) for c in flags])).join(example, "Annotation_Item_ID", "left")


def cue_association(
    labels: DataFrame,
    min_support: int = 5,
    min_precision: float = 0.65,
    min_lift: float = 1.5,
    longest: int = 3,
) -> DataFrame:
    """Signal, Cue, Support, Positive_With_Cue, Precision, Recall, Lift: word runs that go with a positive label.

    Labels are summed by text first, each text's distinct runs count once, and all signals' counts come from one aggregation on the run.
    A text's runs are one array in its task."""
    require(labels, {"Annotation_Item_ID", *[f"Human_{s}" for s in C.SIGNALS]}, "labels")
    text = [c for c in CONTEXT if c in labels.columns]
    if not text:
        raise ValueError("labels need a text column: " + ", ".join(CONTEXT))
    joined = F.concat_ws(" ", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in text])
    bins = {s: T.binary_label(F.col(f"Human_{s}")) for s in C.SIGNALS}
    # labels and positive ones of a signal in one number, n * 2**32 + p: half as wide, and their sums add up alike
    counts = [F.sum(F.when(F.col(s).isNotNull(), F.col(s) + F.lit(PAIR)).otherwise(0)).alias(s) for s in C.SIGNALS]
    # an item's labels by several annotators share its text: it is taken apart once
    texts = labels.select(*[b.cast("long").alias(s) for s, b in bins.items()], joined.alias("text")).groupBy("text").agg(*counts)
    sums = [F.sum(s).alias(s) for s in C.SIGNALS]
    # a text's runs are told apart where it is, so only sums by run are shuffled
    per = texts.select(*C.SIGNALS, F.explode(T.cues(F.col("text"), longest)).alias("Cue")).groupBy("Cue").agg(*sums)
    total = texts.agg(*sums)

    def long(df: DataFrame, *keys: str) -> DataFrame:
        e = F.array(
            *[
                F.struct(F.lit(s).alias("Signal"), F.shiftright(s, 32).alias("n"), F.col(s).bitwiseAND(PAIR - 1).alias("p"))
                for s in C.SIGNALS
            ]
        )
        return df.select(*keys, F.explode(e).alias("e")).select(*keys, "e.*")

    all_rows = long(total).select("Signal", F.col("n").alias("valid"), F.col("p").alias("positive"))
    out = long(per, "Cue").where(F.col("n") >= max(1, min_support)).join(F.broadcast(all_rows), "Signal")  # four rows
    precision = F.col("p") / F.col("n")
    out = out.withColumns(
        {
            "precision_": precision,
            "recall_": F.coalesce(F.col("p") / F.nullif("positive", F.lit(0)), F.lit(0.0)),
            "lift_": precision / F.nullif(F.col("positive") / F.col("valid"), F.lit(0.0)),
        }
    )
    out = out.where((F.col("precision_") >= min_precision) & (F.col("lift_").isNull() | (F.col("lift_") >= min_lift)))
    return out.select(
        "Signal",
        "Cue",
        F.col("n").alias("Support"),
        F.col("p").alias("Positive_With_Cue"),
        F.round("precision_", 3).alias("Precision"),
        F.round("recall_", 3).alias("Recall"),
        F.round("lift_", 3).alias("Lift"),
    )


def recommended(cues: DataFrame, most: int = 50) -> DataFrame:
    """Signal, words and phrases of its ``most`` best cues; a signal without cues has empty lists."""
    w = Window.partitionBy("Signal").orderBy(F.desc("Precision"), F.desc("Lift"), F.desc("Support"), "Cue")
    top = cues.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most)
    phrase = F.contains("Cue", F.lit(" "))

    def listed(which: Column) -> Column:
        return F.transform(F.array_sort(F.collect_list(F.when(which, F.struct("rank", "Cue")))), lambda x: x.Cue)

    lists = top.groupBy("Signal").agg(listed(~phrase).alias("words"), listed(phrase).alias("phrases"))
    names = cues.sparkSession.createDataFrame([(s,) for s in C.SIGNALS], "Signal string")
    empty = F.array().cast("array<string>")
    return names.join(lists, "Signal", "left").select(
        "Signal",
        F.coalesce("words", empty).alias("words"),
        F.coalesce("phrases", empty).alias("phrases"),
    )


def vocabulary_json(lists: DataFrame, min_support: int = 5, min_precision: float = 0.65, min_lift: float = 1.5) -> DataFrame:
    """One row: the recommended vocabulary as JSON."""
    criteria = F.struct(
        F.lit(min_support).alias("min_support"),
        F.lit(min_precision).alias("min_precision"),
        F.lit(min_lift).alias("min_lift"),
    )
    value = F.struct("words", "phrases", F.array().cast("array<string>").alias("exclude_patterns"), criteria.alias("criteria"))
    return lists.agg(F.to_json(F.map_from_entries(F.array_sort(F.collect_list(F.struct("Signal", value.alias("v")))))).alias("vocabulary"))


def vocabulary_summary(lists: DataFrame) -> DataFrame:
    return lists.select(
        "Signal",
        F.array_join("words", ", ").alias("Recommended_Words"),
        F.array_join("phrases", ", ").alias("Recommended_Phrases"),
    )
