"""Raw interview documents to documents, turns and events."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapline.config import EVENT
from gapline.functions import text as T


def _events(text: Column) -> Column:
    """array of (text, start, end) of event marks; places are those of the text before marks are replaced."""
    marks = F.regexp_extract_all(text, F.lit(T.EVENT_MARK), F.lit(0))
    parts = F.split(text, T.EVENT_MARK)
    start = F.array(F.struct(F.lit("").alias("text"), F.lit(0).alias("start"), F.lit(0).alias("end")))
    pairs = F.arrays_zip(F.slice(parts, F.lit(1), F.size(marks)).alias("part"), marks.alias("mark"))

    def step(acc: Column, x: Column) -> Column:
        a = F.element_at(acc, -1)["end"] + F.length(x.part)
        return F.array_append(acc, F.struct(x.mark.alias("text"), a.alias("start"), (a + F.length(x.mark)).alias("end")))

    found = F.aggregate(pairs, start, step)
    return F.slice(found, F.lit(2), F.size(found) - 1)


def strip_events(text: Column) -> Column:
    out = T.squeeze(F.regexp_replace(text, T.EVENT_MARK, f" {EVENT} "))
    return F.trim(F.regexp_replace(out, rf"(?:\s*{EVENT}\s*)+", f" {EVENT} "))


def prepare(raw: DataFrame) -> DataFrame:
    """Normalised ``raw`` records (text, stem, file_name, source_path, status, error) with their ids."""
    for c in ("text", "stem", "file_name", "source_path", "status", "error"):
        raw = raw.withColumn(c, F.coalesce(F.col(c).cast("string"), F.lit(""))) if c in raw.columns else raw.withColumn(c, F.lit(""))
    body = T.normalize_raw(F.col("text"))
    return raw.select(
        T.source_id(F.col("stem")).alias("ID"),
        F.col("file_name").alias("Source_File"),
        F.col("source_path").alias("Source_Path"),
        F.col("status").alias("Status"),
        F.col("error").alias("Error"),
        body.alias("Full_Text"),
    ).withColumn("Mentioned_ID", T.mentioned_id(F.col("Full_Text")))


def turns(docs: DataFrame) -> DataFrame:
    """One row for each non-empty speaker turn, numbered; Events is an array. Text before the first label is dropped."""
    labels = F.regexp_extract_all("Full_Text", F.lit(T.SPEAKER), F.lit(1))
    parts = F.split("Full_Text", T.SPEAKER)
    pairs = F.arrays_zip(labels.alias("who"), F.slice(parts, F.lit(2), F.greatest(F.size(parts) - 1, F.lit(0))).alias("body"))
    keys = ["ID", "Mentioned_ID", "Source_File", "Source_Path"]
    t = docs.select(*keys, F.posexplode(pairs).alias("at", "p")).select(
        *keys,
        "at",
        F.initcap(F.lower("p.who")).alias("Speaker"),
        T.normalize_raw(F.col("p.body")).alias("Raw_Turn_Text"),
    )
    t = t.withColumn(
        "Turn_Text",
        strip_events(F.col("Raw_Turn_Text")),
    ).where("Turn_Text <> ''").withColumn("Events", _events(F.col("Raw_Turn_Text")))
    t = t.withColumn("Turn_Index", F.row_number().over(Window.partitionBy(*keys).orderBy("at")))
    unclear = F.size(F.filter("Events", lambda e: F.contains(F.lower(e["text"]), F.lit("unintelligible"))))
    return t.select(
        *keys,
        "Turn_Index",
        "Speaker",
        "Turn_Text",
        "Raw_Turn_Text",
        T.word_count(F.col("Turn_Text")).alias("Word_Count"),
        F.size("Events").alias("Event_Count"),
        unclear.alias("Unintelligible_Count"),
        F.regexp_count("Turn_Text", F.lit(T.TIMESTAMP)).alias("Timestamp_Count"),
        "Events",
    )


def events(turn_table: DataFrame) -> DataFrame:
    e = turn_table.select("ID", "Mentioned_ID", "Source_File", "Turn_Index", "Speaker", F.posexplode("Events").alias("at", "e"))
    kind = F.initcap(F.trim(F.regexp_extract("e.text", r"^\[([A-Za-z ]+)", 1)))
    return e.select(
        "ID",
        "Mentioned_ID",
        "Source_File",
        "Turn_Index",
        "Speaker",
        (F.col("at") + 1).alias("Event_Index"),
        F.when(kind == "", "Event").otherwise(kind).alias("Event_Type"),
        F.col("e.text").alias("Event_Text"),
        F.col("e.start").alias("Char_Start"),
        F.col("e.end").alias("Char_End"),
    )


def documents(docs: DataFrame, turn_table: DataFrame) -> DataFrame:
    """One row for each document, with counts and the interviewee's turns joined by `` | ``."""
    keys = ["ID", "Mentioned_ID", "Source_File", "Source_Path"]
    who = F.col("Speaker") == "Interviewee"
    said = F.array_sort(F.collect_list(F.when(who, F.struct("Turn_Index", "Turn_Text"))))
    per = turn_table.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("Turn_Count"),
        F.count_if(who).alias("Interviewee_Turns"),
        F.count_if(F.col("Speaker") == "Interviewer").alias("Interviewer_Turns"),
        F.sum(F.when(who, F.col("Word_Count")).otherwise(0)).alias("Interviewee_Words"),
        F.array_join(F.transform(said, lambda x: x.Turn_Text), " | ").alias("Interviewee_Response"),
    )
    counts = ["Turn_Count", "Interviewee_Turns", "Interviewer_Turns", "Interviewee_Words"]
    out = docs.join(per, keys, "left").na.fill(0, counts).na.fill("", ["Interviewee_Response"])
    text = F.col("Full_Text")
    return out.select(
        "ID",
        "Mentioned_ID",
        "Source_File",
        "Source_Path",
        "Status",
        "Error",
        F.length(text).alias("Text_Chars"),
        T.word_count(text).alias("Text_Words"),
        *counts,
        F.regexp_count(text, F.lit(r"(?i)unintelligible|\[uninte")).alias("Unintelligible_Count"),
        F.regexp_count(text, F.lit(T.TIMESTAMP)).alias("Timestamp_Count"),
        T.raw_artifacts(text).alias("Artifact_Count"),
        "Interviewee_Response",
        "Full_Text",
    )


def legacy_turns(text: Column) -> Column:
    """The interviewee's turns by the older rule: from the label to the next interviewer label or the end, blanks squeezed, empty ones dropped."""
    found = F.regexp_extract_all(text, F.lit(r"(?is)Interviewee:\s*(.*?)(?=Interviewer:|$)"), F.lit(1))
    return F.filter(F.transform(found, T.squeeze), lambda x: x != "")


def report(docs: DataFrame, turn_table: DataFrame, event_table: DataFrame) -> str:
    """Markdown summary: one aggregate of each table."""
    d = docs.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Status") == "ok").alias("ok"),
        F.sum("Interviewee_Words").alias("words"),
        F.count_if(F.col("Interviewee_Turns") == 0).alias("silent"),
        F.count_if(F.col("Artifact_Count") > 0).alias("marred"),
        F.sum("Artifact_Count").alias("artifacts"),
        F.count_if(F.col("Unintelligible_Count") > 0).alias("unclear"),
        F.sum("Unintelligible_Count").alias("unclear_marks"),
    ).first()
    t = turn_table.agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("Speaker") == "Interviewee").alias("ee"),
        F.count_if(F.col("Speaker") == "Interviewer").alias("er"),
    ).first()
    lines = {
        "Source documents": d.n,
        "Successful documents": d.ok,
        "Error documents": d.n - d.ok,
        "Parsed speaker turns": t.n,
        "Event markers": event_table.count(),
        "Interviewee turns": t.ee,
        "Interviewer turns": t.er,
        "Interviewee words": d.words or 0,
        "Documents without interviewee turns": d.silent,
        "Documents with artifacts": d.marred,
        "Artifacts": d.artifacts or 0,
        "Documents with unintelligible markers": d.unclear,
        "Unintelligible markers": d.unclear_marks or 0,
    }
    return "\n".join(["# Extraction report", "", *[f"- {k}: {v}" for k, v in lines.items()]])
