"""Readers, column inference, cleaning of whole tables, and sinks."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as Ty

from gapline.functions import text as T
from gapline.sources import word, workbook

# Column names and patterns of the inference.
ID_NAMES = ("ID", "Id", "id", "Student_ID", "student_id", "Participant", "participant")
TEXT_NAMES = (r"^Interviewee_Response$", r"^Transcript$", r"^Text$", r"^Content$", r"^Item\s*\d+$")
NOT_TEXT = r"choice|choic|score|response\s*\d+|correct"
# end of fixed values
#: characters of windows-1252 where ISO-8859-1 has controls: as read, and as meant
_SEEN = [(chr(b), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
WINDOWS = "".join(a for a, z in _SEEN if z), "".join(z for _, z in _SEEN)


#: bytes that windows-1252 doesn't define, as ISO-8859-1 shows them
UNDEFINED = "[" + "".join(a for a, z in _SEEN if not z) + "]"


def charsets(spark: SparkSession, path: str) -> dict[str, list[str]]:
    """The files at ``path`` by their charset: utf-8, else windows-1252, else ``replace`` (UTF-8 with replacement characters). Lines are checked where they
    are read, large files in many tasks, and folded by file; names of files reach the driver."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), "value")
    bad = ~F.is_valid_utf8("value")
    unknown = F.decode(F.col("value").cast("binary"), "ISO-8859-1").rlike(UNDEFINED)
    found = lines.groupBy("file").agg(F.bool_or(bad).alias("bad"), F.bool_or(unknown).alias("unknown"))
    kind = F.when(~F.col("bad"), "utf-8").when(~F.col("unknown"), "windows-1252").otherwise("replace")
    out: dict[str, list[str]] = {}
    for r in found.select("file", kind.alias("kind")).orderBy("file").collect():
        out.setdefault(r["kind"], []).append(r["file"])
    return out


def read_csv(spark: SparkSession, path: str, multi_line: bool = True) -> DataFrame:
    """CSV files with a header, each in its own charset. With ``multi_line`` cells may hold line ends, and a file is read by one task; without, large
    files are read by many."""
    parts = []
    for kind, files in (charsets(spark, path) or {"utf-8": [path]}).items():
        read = spark.read.option("header", True).option("multiLine", multi_line).option("escape", '"')
        out = read.option("encoding", "ISO-8859-1" if kind == "windows-1252" else "UTF-8").csv(files)
        if kind == "windows-1252":  # the two differ in 27 characters
            name = str.maketrans(*WINDOWS)
            out = out.select(*[F.translate(F.col(f"`{c}`"), *WINDOWS).alias(c.translate(name)) for c in out.columns])
        if kind == "replace":  # lines read without decoding keep their bytes
            out = out.select(*[F.make_valid_utf8(F.col(f"`{c}`")).alias(c) for c in out.columns])
        first = out.columns[0] if out.columns else ""
        parts.append(out.withColumnRenamed(first, first.lstrip("\ufeff")))
    return functools.reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def read_table(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """A table by its suffix: csv (see :func:`read_csv`), parquet, json or jsonl, orc, a workbook (see :mod:`gapline.sources.workbook`; of the older
    binary kind only where a reader for those is installed)."""
    suffix = os.path.splitext(path.rstrip("/"))[1].lower()
    if suffix in (".xlsx", ".xlsm"):
        return workbook.read(spark, path, sheet)
    if suffix == ".xls":
        import pandas as pd  # one small file by its nature: at most 65,536 rows

        return spark.createDataFrame(pd.read_excel(path, sheet_name=sheet or 0).astype(object).where(lambda d: d.notna(), None))
    if suffix == ".csv":
        return read_csv(spark, path)
    if suffix in (".json", ".jsonl"):
        return read_jsonl(spark, path)
    if suffix in (".parquet", ".orc"):
        return spark.read.format(suffix[1:]).load(path)
    raise ValueError(f"unknown kind of table: {suffix}")


RAW = "text string, stem string, file_name string, source_path string, status string, error string"


def read_jsonl(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """One object a line; blank lines and a byte-order mark are skipped."""
    lines = spark.read.text(path).select(F.regexp_replace("value", "^﻿", "").alias("value")).where(F.trim("value") != "")
    if schema is None:
        found = lines.agg(F.schema_of_variant_agg(F.try_parse_json("value")).alias("s")).first()["s"] or ""
        schema = found.replace("OBJECT<", "STRUCT<").replace("VOID", "STRING") if found.startswith("OBJECT<") else RAW
    return lines.select(F.from_json("value", schema).alias("r")).select("r.*")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """Text and word-processor files of a folder as raw records (see :mod:`gapline.sources.word`); a file that can't be read gets status error and the reason."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for place, contents in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                name = place.rsplit("/", 1)[-1]
                try:
                    text, error = word.text_of(name, contents.as_py() or b""), ""
                except Exception as e:  # whatever is wrong with a file is that file's status
                    text, error = "", str(e) or type(e).__name__
                row = (text, re.sub(r"\.[^.]*$", "", name), name, place, "error" if error else "ok", error)
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in row], names=[c.split()[0] for c in RAW.split(", ")])

    return files.mapInArrow(run, RAW)


def infer_id_column(df: DataFrame, wanted: str | None = None) -> str | None:
    if wanted:
        if wanted not in df.columns:
            raise ValueError(f"no column {wanted}")
        return wanted
    return next((c for c in ID_NAMES if c in df.columns), None)


def infer_text_columns(df: DataFrame, wanted: str | list[str] | None = None, id_column: str | None = None) -> list[str]:
    if wanted:
        names = split_columns(wanted) if isinstance(wanted, str) else list(wanted)
        if missing := [c for c in names if c not in df.columns]:
            raise ValueError(f"no columns {', '.join(missing)}")
        return names
    found = [c for p in TEXT_NAMES for c in df.columns if re.search(p, c, re.I)]
    if not found:
        found = [
            f.name
            for f in df.schema.fields
            if isinstance(f.dataType, Ty.StringType)
            and f.name != id_column
            and not re.search(NOT_TEXT, f.name, re.I)
        ]
    if not found:
        raise ValueError("no text column found; name one")
    return list(dict.fromkeys(found))


def split_columns(text: str | None) -> list[str]:
    return [c.strip() for c in (text or "").split(",") if c.strip()]


def clean_table(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """All string columns cleaned, and one row with the number of artifacts found in them."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, Ty.StringType)]
    total = sum((F.coalesce(F.sum(T.count_artifacts(F.col(c))), F.lit(0)) for c in names), F.lit(0))
    return df.withColumns({c: T.clean(F.col(c)) for c in names}), df.agg(total.alias("artifacts"))


def preview(df: DataFrame, rows: int = 10) -> tuple[DataFrame, str | None, list[str]]:
    id_column = infer_id_column(df)
    return df.limit(rows), id_column, infer_text_columns(df, None, id_column)


def with_row_numbers(df: DataFrame, name: str = "row", first: int = 2) -> DataFrame:
    """``df`` with its rows' numbers in the order they are read (2 is the first, as in a sheet with a header). Rows are counted in each part of the input; the
    parts' sizes, a row each, are a broadcast table. The input is read twice and has to be split alike: a table's files, not the result of a shuffle."""
    own = df.withColumns({"_at": F.monotonically_increasing_id(), "_part": F.spark_partition_id()})
    sizes = own.groupBy("_part").agg(F.count(F.lit(1)).alias("n"))
    before = F.sum("n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = F.broadcast(sizes.select("_part", F.coalesce(before, F.lit(0)).alias("_start")))
    place = F.col("_start") + F.col("_at").bitwiseAND((1 << 33) - 1) + first
    return own.join(starts, "_part").withColumn(name, place.cast("long")).drop("_at", "_part", "_start")


def write_tables(folder: str, form: str = "parquet", mark: bool = False, **tables: DataFrame) -> None:
    """One folder for each table (csv with a header and, with ``mark``, a byte-order mark in each file), or, as ``xlsx``, one workbook named ``folder`` with a
    sheet for each."""
    if form == "xlsx":
        workbook.write(tables, folder if folder.endswith(".xlsx") else f"{folder}.xlsx")
        return
    for name, df in tables.items():
        if form == "csv":
            df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0]) if mark and df.columns else df
            df.write.mode("overwrite").option("header", True).csv(f"{folder}/{name}")
        else:
            df.write.mode("overwrite").format(form).save(f"{folder}/{name}")


def output_folder(local: str = "output/calibration", variable: str = "GAPLINE_OUTPUT_DIR") -> str:
    return os.environ.get(variable) or local
