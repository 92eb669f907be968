"""Quality control of a segmentation: long-format metrics with a status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline import config as C
from gapline.functions import text as T

# Fixed value: the pattern of marks that mustn't be left in segments.
#: a fixed value: begins of event marks
LEAK = r"(?i)\[(?:Pause|Drawing|End of Audio|Unintelligible)"
#: metric, suggested criterion; fixed values
CRITERIA = {
    "Segments": "Documented",
    "Boundaries": "Documented",
    "Records": "Documented",
    "Median segment tokens": "12-25",
    "Mean segment tokens": "15-30",
    "Short segments < 8 tokens": "< 20-25%",
    "Short segment rate": "< .25",
    "Long segments > 60 tokens": "0 or near 0",
    "Max tokens": "<= L_max",
    "Max segments per record": "<= K_max",
    "Event token leakage": "0",
    "Bracket event leakage": "0",
    "Speaker label leakage": "0",
    "Punctuation-leading segments": "0",
    "Selected boundaries": "Documented",
    "Selected illegal boundaries": "0",
    "Selected semi-legal boundary rate": "<= .15",
    "Mean semantic gravity: selected": "Lower than non-selected",
    "Mean semantic gravity: non-selected": "Higher than selected",
    "Mean transition pressure: selected": "Higher than non-selected",
    "Mean transition pressure: non-selected": "Lower than selected",
}


def require(df: DataFrame, columns: set[str], table: str) -> None:
    if missing := columns - set(df.columns):
        raise ValueError(f"{table} misses columns: {', '.join(sorted(missing))}")


def places(x: Column, digits: int) -> Column:
    """Rounded at the scaled value, which engines do alike."""
    return F.round(x * float(10**digits)) / float(10**digits)


def exact_mean(x: Column, digits: int) -> Column:
    """Rounded mean of values of four places, summed as whole numbers, so the order of rows can't change it."""
    return places(F.sum(F.round(x * 10_000).cast("long")) / F.count(x) / 10_000, digits)


def _long(wide: DataFrame, names: list[str]) -> DataFrame:
    rows = F.array(
        *[
            F.struct(
                F.lit(i).alias("at"),
                F.lit(n).alias("Metric"),
                F.col(f"`{n}`").cast("double").alias("Value"),
                F.lit(CRITERIA[n]).alias("Criterion"),
            )
            for i, n in enumerate(names)
        ]
    )
    return wide.select(F.explode(rows).alias("r")).select("r.*")


def summary(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """at, Metric, Value, Criterion, Status, Status_Note. One pass over each table; the counts per record are aggregated first."""
    require(segments, {"Record_ID", "Source_Column", "Segment_Index", "Token_Start", "Token_End", "Segment_Text"}, "segments")
    require(boundaries, {"Record_ID", "Source_Column", "gap", "candidate_boundary", "selected_boundary"}, "boundaries")
    text = F.coalesce("Segment_Text", F.lit(""))
    n = F.col("Token_Count")
    one = segments.agg(
        F.count(F.lit(1)).alias("Segments"),
        places(F.median("Token_Count"), 2).alias("Median segment tokens"),
        places(F.sum("Token_Count") / F.count("Token_Count"), 2).alias("Mean segment tokens"),
        F.count_if(n < 8).alias("Short segments < 8 tokens"),
        places(F.count_if(n < 8) / F.nullif(F.count(F.lit(1)), F.lit(0)), 3).alias("Short segment rate"),
        F.count_if(n > 60).alias("Long segments > 60 tokens"),
        F.max("Token_Count").alias("Max tokens"),
        F.count_if(F.contains(text, F.lit(C.EVENT))).alias("Event token leakage"),
        F.count_if(text.rlike(LEAK)).alias("Bracket event leakage"),
        F.count_if(text.rlike(T.SPEAKER_LABEL)).alias("Speaker label leakage"),
        F.count_if(text.rlike(r"^\s*[,.;:!?]")).alias("Punctuation-leading segments"),
    )
    per = segments.groupBy("Record_ID").agg(F.count(F.lit(1)).alias("c")).agg(
        F.count(F.lit(1)).alias("Records"),
        F.max("c").alias("Max segments per record"),
    )
    names = list(CRITERIA)[:15]
    sel = T.as_bool(F.col("selected_boundary"))
    aggs = [F.count(F.lit(1)).alias("Boundaries"), F.count_if(sel).alias("Selected boundaries")]
    if "boundary_legality" in boundaries.columns:
        kind = F.coalesce("boundary_legality", F.lit(""))
        aggs += [
            F.count_if((kind == "illegal") & sel).alias("Selected illegal boundaries"),
            places(
                F.count_if((kind == "semi_legal") & sel) / F.greatest(F.lit(1), F.count_if(sel)),
                3,
            ).alias("Selected semi-legal boundary rate"),
        ]
        names += list(CRITERIA)[15:17]
    if {"semantic_gravity", "transition_pressure"} <= set(boundaries.columns):
        for title, col in (("semantic gravity", "semantic_gravity"), ("transition pressure", "transition_pressure")):
            aggs += [
                exact_mean(F.when(sel, F.col(col)), 4).alias(f"Mean {title}: selected"),
                exact_mean(F.when(~sel, F.col(col)), 4).alias(f"Mean {title}: non-selected"),
            ]
        names += list(CRITERIA)[17:]
    two = boundaries.agg(*aggs)
    # three tables of one row each, side by side by a constant key
    wide = one.withColumn("k", F.lit(1)).join(per.withColumn("k", F.lit(1)), "k").join(two.withColumn("k", F.lit(1)), "k").drop("k")
    return with_status(_long(wide, names))


def with_status(metrics: DataFrame) -> DataFrame:
    """Adds Status and Status_Note; ``metrics`` is long, so the two values of a pair meet in a window over all (few) rows."""
    m, v = F.col("Metric"), F.col("Value")
    pair = F.regexp_extract("Metric", "^(Mean .*): (?:non-)?selected$", 1)
    of = Window.partitionBy("pair")
    sides = {
        "a": F.max(F.when(F.endswith(m, F.lit(": selected")), v)).over(of),
        "b": F.max(F.when(F.endswith(m, F.lit(": non-selected")), v)).over(of),
    }
    both = F.when(F.col("pair") != "", F.count(F.lit(1)).over(of))
    out = metrics.withColumn("pair", pair).withColumns(sides | {"both": both})

    def ladder(test: Column, bad: str) -> Column:
        return F.when(test, "PASS").otherwise(bad)

    zero = m.isin(
        "Event token leakage",
        "Bracket event leakage",
        "Speaker label leakage",
        "Punctuation-leading segments",
        "Selected illegal boundaries",
    )
    lower = F.col("pair") == "Mean semantic gravity"
    passes = F.when(lower, F.col("a") < F.col("b")).otherwise(F.col("a") > F.col("b"))
    status = (
        F.when(m.isin("Segments", "Boundaries", "Records", "Selected boundaries"), "INFO")
        .when((F.col("both") == 2) & (F.col("a").isNull() | F.col("b").isNull()), "WARNING")
        .when(F.col("both") == 2, ladder(passes, "WARNING"))
        .when(v.isNull(), "WARNING")
        .when(m == "Median segment tokens", ladder(v.between(12, 25), "WARNING"))
        .when(m == "Mean segment tokens", ladder(v.between(15, 30), "WARNING"))
        .when(m == "Short segment rate", ladder(v <= 0.25, "WARNING"))
        .when(m == "Long segments > 60 tokens", ladder(v == 0, "WARNING"))
        .when(m == "Max tokens", ladder(v <= 60, "WARNING"))
        .when(m == "Max segments per record", ladder(v <= 80, "WARNING"))
        .when(zero, ladder(v == 0, "FAIL"))
        .when(m == "Selected semi-legal boundary rate", ladder(v <= 0.15, "WARNING"))
        .otherwise("INFO")
    )
    out = out.withColumn("Status", status)
    note = F.when(F.col("Status") == "PASS", "Within the suggested range.").when(F.col("Status") == "FAIL", "Must be zero before annotation.").when(
        F.col("Status") == "WARNING",
        "Missing, or outside the suggested range.",
    ).otherwise("Reported for traceability.")
    return out.withColumn("Status_Note", note).drop("pair", "a", "b", "both")


def signals(segments: DataFrame, boundaries: DataFrame) -> DataFrame:
    """Saturation of each signal, with a status."""
    have = [s for s in C.SIGNALS if C.SIGNAL_COLUMNS[s] in boundaries.columns]
    values = boundaries.select(
        F.explode(F.array(*[F.struct(F.lit(s).alias("Signal"), F.col(C.SIGNAL_COLUMNS[s]).alias("v")) for s in have])).alias("e")
    ).select("e.*").where("v is not null")
    per = values.groupBy("Signal").agg(
        exact_mean(F.col("v"), 3).alias("Mean"),
        F.percentile("v", F.lit(0.5)).alias("mid"),
        places(F.percentile("v", F.lit(0.9)), 3).alias("P90"),
        places(F.count_if(F.col("v") > 0.8) / F.count("v"), 3).alias("Pct_High"),
    )

    def cells(s: str) -> Column:
        mean = F.col(f"Mean_{s}") if f"Mean_{s}" in segments.columns else F.lit(None).cast("double")
        kind = F.lower(F.coalesce("Segment_Type", F.lit(""))) if "Segment_Type" in segments.columns else F.lit("")
        return F.struct(
            F.lit(s).alias("Signal"),
            (kind == C.TYPE_NAMES[s]).alias("first"),
            mean.alias("m"),
            F.lit(f"Mean_{s}" in segments.columns).alias("known"),
        )

    seg = segments.select(F.explode(F.array(*[cells(s) for s in have])).alias("e")).select("e.*")
    n = F.greatest(F.lit(1), F.count(F.lit(1)))
    positive = F.when(F.bool_or("known"), F.count_if(F.col("m") >= 0.5)).otherwise(F.count_if("first"))
    seg = seg.groupBy("Signal").agg(
        F.count_if("first").alias("Primary_Segments"),
        places(F.count_if("first") / n, 3).alias("Primary_Rate"),
        positive.alias("Positive_Segments"),
        places(positive / n, 3).alias("Positive_Rate"),
        exact_mean(F.col("m"), 3).alias("Mean_Segment_Signal"),
    )
    out = per.join(seg, "Signal", "left").na.fill(0, ["Primary_Segments", "Primary_Rate", "Positive_Segments", "Positive_Rate"])
    out = out.withColumns({"Median": places(F.col("mid"), 3), "Saturated": F.col("mid") > 0.75})
    bad = F.col("Saturated") | (F.col("Median") > 0.75) | (F.col("Pct_High") > 0.5) | (F.col("Positive_Rate") > 0.6)
    return out.withColumn("Status", F.when(F.col("Median").isNull() | bad, "WARNING").otherwise("PASS")).drop("mid")
