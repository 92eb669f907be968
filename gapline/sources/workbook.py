"""Workbooks (xlsx) without a package: the parts of the zip file, read and written as streams.

Reading: files come through Spark's binary source, so any store and a whole folder will do; each file is one row by its nature (a sheet has at
most 1,048,576 rows) and is parsed by the task that has it. A sheet is named, or given by its number; the first row has the columns' names. A
column is a whole number, a number or a boolean if all its cells are; else it is a string, and so is one whose kind differs between files. Dates become ISO
text, error values null.

Writing: each task writes the rows of its part as a fragment beside the target; the commit joins the fragments in order to one
file, which appears under its name when it is complete. A failed job leaves nothing; a task that ran twice leaves one fragment that counts. Sheets longer than the format
allows, and cells of more than 32,767 characters, are errors: nothing is cut off. The target is a folder that driver and executors share.
"""

from __future__ import annotations

import datetime
import io
import os
import re
import shutil
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as Ty
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINK = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MOST_ROWS, MOST_CHARS, MOST_COLUMNS = 1_048_576, 32_767, 16_384
ROWS = 5_000
#: fixed values: built-in formats of dates and times
DATES = frozenset((*range(14, 23), *range(45, 48)))
CODED = re.compile(r"_x([0-9A-Fa-f]{4})_")
NOT_XML = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\r\ufffe\uffff]")
Cell = str | float | int | bool | None


# reading


def _text(node: ElementTree.Element) -> str:
    """The text of a string item, without its phonetic runs."""
    parts = [t.text or "" for x in node if x.tag != f"{MAIN}rPh" for t in ([x] if x.tag == f"{MAIN}t" else x.iter(f"{MAIN}t"))]
    return CODED.sub(lambda m: chr(int(m[1], 16)), "".join(parts))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = 26 * n + ord(c.upper()) - 64
    return n - 1


class Workbook:
    def __init__(self, contents: bytes):
        self.zip = zipfile.ZipFile(io.BytesIO(contents))
        root = self._root("xl/workbook.xml")
        links = {x.get("Id"): x.get("Target") for x in self._root("xl/_rels/workbook.xml.rels")}
        self.sheets = [(s.get("name"), self._place(links[s.get(LINK)])) for s in root.iter(f"{MAIN}sheet")]
        self.since = datetime.datetime(1904, 1, 1) if any(x.get("date1904") in ("1", "true") for x in root.iter(f"{MAIN}workbookPr")) else datetime.datetime(1899, 12, 30)
        self.strings = self._strings()
        self.dates = self._date_styles()

    @staticmethod
    def _place(target: str) -> str:
        return target.lstrip("/") if target.startswith("/") else f"xl/{target}"

    def _root(self, name: str) -> ElementTree.Element:
        with self.zip.open(name) as f:
            return ElementTree.parse(f).getroot()

    def _strings(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self.zip.namelist():
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, x in ElementTree.iterparse(f):
                if x.tag == f"{MAIN}si":
                    out.append(_text(x))
                    x.clear()
        return out

    def _date_styles(self) -> set[int]:
        if "xl/styles.xml" not in self.zip.namelist():
            return set()
        root = self._root("xl/styles.xml")
        own = {int(x.get("numFmtId")): x.get("formatCode") or "" for x in root.iter(f"{MAIN}numFmt")}
        dated = {k for k, code in own.items() if re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", code), re.I)} | DATES
        formats = root.find(f"{MAIN}cellXfs")
        return {k for k, x in enumerate(formats if formats is not None else ()) if int(x.get("numFmtId") or 0) in dated}

    def sheet(self, which: str | int | None) -> str:
        """The part of a sheet by its name or its number (from 0)."""
        names = [n for n, _ in self.sheets]
        at = 0 if which is None else which if isinstance(which, int) else names.index(which) if which in names else -1
        if not 0 <= at < len(self.sheets):
            raise ValueError(f"no sheet {which!r} among {', '.join(names)}")
        return self.sheets[at][1]

    def _cell(self, c: ElementTree.Element) -> Cell:
        kind, v = c.get("t", "n"), c.find(f"{MAIN}v")
        if kind == "inlineStr":
            found = c.find(f"{MAIN}is")
            return None if found is None else _text(found)
        if v is None or v.text is None or kind == "e":
            return None
        if kind == "s":
            return self.strings[int(v.text)]
        if kind == "b":
            return v.text.strip() in ("1", "true")
        if kind != "n":
            return CODED.sub(lambda m: chr(int(m[1], 16)), v.text)
        x = float(v.text)
        if int(c.get("s") or 0) in self.dates:
            return str(self.since + datetime.timedelta(seconds=round(x * 86_400)))
        whole = re.fullmatch(r"\s*-?\d{1,19}\s*", v.text)
        return int(v.text) if whole and -(1 << 63) <= int(v.text) < 1 << 63 else x

    def rows(self, which: str | int | None) -> Iterator[list[Cell]]:
        """Rows in order, blank ones between others too; cells without a reference follow one another."""
        with self.zip.open(self.sheet(which)) as f:
            at = 0
            steps = ElementTree.iterparse(f, events=("start", "end"))
            _, root = next(steps)
            for event, x in steps:
                if event != "end" or x.tag != f"{MAIN}row":
                    continue
                place = int(x.get("r") or at + 1)
                for _ in range(place - at - 1):
                    yield []
                at = place
                row: list[Cell] = []
                for c in x.iter(f"{MAIN}c"):
                    k = _column(c.get("r")) if c.get("r") else len(row)
                    row += [None] * (k - len(row))
                    row.append(self._cell(c))
                yield row
                x.clear()
                for part in root:
                    if part.tag == f"{MAIN}sheetData":  # rows that are done
                        part.clear()


def names_of(header: list[Cell], width: int) -> list[str]:
    """Column names: blank ones by their place, repeated ones with a number."""
    out: list[str] = []
    for k in range(width):
        cell = header[k] if k < len(header) else None
        name = first = f"Unnamed: {k}" if cell in (None, "") else str(cell)
        n = 0
        while name in out:
            n += 1
            name = f"{first}.{n}"
        out.append(name)
    return out


def kind_of(cell: Cell) -> str:
    return {bool: "boolean", int: "bigint", float: "double"}.get(type(cell), "string")


def joint_kind(a: str, b: str) -> str:
    return a if a == b else "double" if {a, b} == {"bigint", "double"} else "string"


def columns(contents: bytes, sheet: str | int | None) -> list[tuple[str, str]]:
    """Name and kind of each column of a sheet; those without a value are strings."""
    rows = Workbook(contents).rows(sheet)
    header = next(rows, [])
    kinds: dict[int, str] = {}
    width = len(header)
    for row in rows:
        width = max(width, len(row))
        for k, cell in enumerate(row):
            if cell is not None:
                kinds[k] = joint_kind(kinds[k], kind_of(cell)) if k in kinds else kind_of(cell)
    return [(n, kinds.get(k, "string")) for k, n in enumerate(names_of(header, width))]


def _as(cell: Cell, kind: str) -> Cell:
    if cell is None:
        return None
    return float(cell) if kind == "double" else cell if kind in ("bigint", "boolean") else str(cell)


def read(spark: SparkSession, path: str, sheet: str | int | None = None) -> DataFrame:
    """A sheet of the workbook, or of all workbooks of a folder, at ``path``."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.xls[xm]").load(path).select("path", "content")

    def seen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, contents in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = columns(contents, sheet)
                yield pa.RecordBatch.from_pydict({"path": [name] * len(found), "at": range(len(found)), "name": [n for n, _ in found], "kind": [k for _, k in found]})

    kinds: dict[str, str] = {}
    told = files.mapInArrow(seen, "path string, at long, name string, kind string")  # columns of a sheet: at most 16,384
    for r in sorted(told.collect(), key=lambda r: (r["path"], r["at"])):
        kinds[r["name"]] = joint_kind(kinds[r["name"]], r["kind"]) if r["name"] in kinds else r["kind"]
    if not kinds:
        raise ValueError(f"no columns in {path}")
    schema = Ty.StructType([Ty.StructField(n, Ty._parse_datatype_string(k)) for n, k in kinds.items()])
    arrow = [{"string": pa.string(), "bigint": pa.int64(), "double": pa.float64(), "boolean": pa.bool_()}[k] for k in kinds.values()]

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def made(part: list[list[Cell]], own: list[str]) -> pa.RecordBatch:
            place = {n: k for k, n in enumerate(own)}
            cells = [[_as(r[place[n]] if n in place and place[n] < len(r) else None, k) for r in part] for n, k in kinds.items()]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cells, arrow, strict=True)], names=list(kinds))

        for b in batches:
            for contents in b.column(1).to_pylist():
                source = Workbook(contents).rows(sheet)
                header = next(source, [])
                own = names_of(header, max(len(header), len(kinds)))
                part: list[list[Cell]] = []
                for row in source:
                    part.append(row)
                    if len(part) == ROWS:
                        yield made(part, own)
                        part = []
                if part:
                    yield made(part, own)

    return files.mapInArrow(rows, schema)


# writing


def cell_xml(value: object) -> str:
    if value is None:
        return "<c/>"
    if isinstance(value, bool):
        return f'<c t="b"><v>{int(value)}</v></c>'
    if isinstance(value, int) or (isinstance(value, float) and value == value and abs(value) != float("inf")):
        return f"<c><v>{value!r}</v></c>"
    text = str(value)
    if len(text) > MOST_CHARS:
        raise ValueError(f"a cell holds at most {MOST_CHARS} characters; one has {len(text)}: {text[:60]!r}")
    text = re.sub(r"_(?=x[0-9A-Fa-f]{4}_)", "_x005F_", text)
    text = NOT_XML.sub(lambda m: f"_x{ord(m[0]):04X}_", text)
    return f'<c t="inlineStr"><is><t xml:space="preserve">{escape(text)}</t></is></c>'


@dataclass
class Written(WriterCommitMessage):
    part: int
    file: str
    rows: dict[int, int]


def local_path(path: str) -> str:
    found = re.sub(r"^file:(//)?(?=/)", "", path)
    if re.match(r"^[a-zA-Z][a-zA-Z0-9+.-]*://", found):
        raise ValueError(f"workbooks are written to a shared file system, not to {path}")
    return found


class SheetsWriter(DataSourceWriter):
    """Rows (sheet number, cells as XML) to one workbook."""

    def __init__(self, path: str, names: list[str]):
        self.path, self.names = local_path(path), names
        self.folder = f"{self.path}.parts-{uuid.uuid4().hex}"

    def write(self, iterator: Iterator[Row]) -> WriterCommitMessage:
        from pyspark import TaskContext

        task = TaskContext.get()
        os.makedirs(self.folder, exist_ok=True)
        stem, rows, files = f"{self.folder}/{task.partitionId():06d}-{task.taskAttemptId()}", {}, {}
        try:
            for sheet, cells in iterator:
                if sheet not in files:
                    files[sheet] = open(f"{stem}-{sheet}", "w", encoding="utf-8")
                files[sheet].write(f"<row>{cells}</row>\n")
                rows[sheet] = rows.get(sheet, 0) + 1
        finally:
            for f in files.values():
                f.close()
        return Written(task.partitionId(), stem, rows)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        done = sorted((m for m in messages if m is not None), key=lambda m: m.part)
        for k, name in enumerate(self.names):
            if (n := sum(m.rows.get(k, 0) for m in done)) > MOST_ROWS:
                self.abort(messages)
                raise ValueError(f"a sheet holds at most {MOST_ROWS} rows with its header; {name!r} has {n}")
        target = f"{self.folder}.xlsx"
        try:
            with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
                for name, text in frame(self.names).items():
                    z.writestr(name, text)
                for k in range(len(self.names)):
                    with z.open(f"xl/worksheets/sheet{k + 1}.xml", "w", force_zip64=True) as out:
                        out.write(f'<?xml version="1.0" encoding="UTF-8"?>\n<worksheet xmlns="{MAIN[1:-1]}"><sheetData>'.encode())
                        for m in done:
                            if m.rows.get(k):
                                with open(f"{m.file}-{k}", "rb") as part:
                                    shutil.copyfileobj(part, out, 1 << 20)
                        out.write(b"</sheetData></worksheet>")
            os.replace(target, self.path)
        finally:
            if os.path.exists(target):
                os.remove(target)
            self.abort(messages)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        shutil.rmtree(self.folder, ignore_errors=True)


def frame(names: list[str]) -> dict[str, str]:
    """The parts of a workbook besides its sheets."""
    head, rels = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n', "http://schemas.openxmlformats.org/package/2006/relationships"
    office = LINK[1:-3]
    main = "application/vnd.openxmlformats-officedocument.spreadsheetml"
    each = range(1, len(names) + 1)
    sheets = "".join(f'<sheet name={quoteattr(n)} sheetId="{k}" r:id="rId{k}"/>' for k, n in zip(each, names, strict=True))
    return {
        "[Content_Types].xml": f'{head}<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">'
        '<Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>'
        f'<Override PartName="/xl/workbook.xml" ContentType="{main}.sheet.main+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{main}.worksheet+xml"/>' for k in each)
        + "</Types>",
        "_rels/.rels": f'{head}<Relationships xmlns="{rels}"><Relationship Id="rId1" Type="{office}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/workbook.xml": f'{head}<workbook xmlns="{MAIN[1:-1]}" xmlns:r="{office}"><sheets>{sheets}</sheets></workbook>',
        "xl/_rels/workbook.xml.rels": f'{head}<Relationships xmlns="{rels}">'
        + "".join(f'<Relationship Id="rId{k}" Type="{office}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in each)
        + "</Relationships>",
    }


class SheetsSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gapline_workbook"

    def schema(self) -> str:
        return "sheet int, cells string"

    def writer(self, schema: Ty.StructType, overwrite: bool) -> SheetsWriter:
        return SheetsWriter(self.options["path"], self.options["sheets"].split("\n"))


def write(sheets: dict[str, DataFrame], path: str) -> None:
    """A workbook with a sheet for each of ``sheets``, in order; rows in the order of their table's parts. Arrays and the like are written as JSON."""
    bad = [n for n in sheets if not 0 < len(n) <= 31 or re.search(r"[\[\]:*?/\\\n]", n)]
    if bad or not sheets:
        raise ValueError(f"names of sheets have 1 to 31 characters and none of []:*?/\\: {bad}")
    local_path(path)
    spark = next(iter(sheets.values())).sparkSession
    spark.dataSource.register(SheetsSource)
    plain = (Ty.StringType, Ty.NumericType, Ty.BooleanType)
    rows = None
    for k, df in enumerate(sheets.values()):
        if len(df.columns) > MOST_COLUMNS:
            raise ValueError(f"a sheet has at most {MOST_COLUMNS} columns")
        cols = [
            F.col(f"`{f.name}`") if isinstance(f.dataType, plain) and not isinstance(f.dataType, Ty.DecimalType)
            else F.col(f"`{f.name}`").cast("double") if isinstance(f.dataType, Ty.DecimalType)
            else F.to_json(f"`{f.name}`") if isinstance(f.dataType, (Ty.ArrayType, Ty.MapType, Ty.StructType))
            else F.col(f"`{f.name}`").cast("string")
            for f in df.schema.fields
        ]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                lines = ["".join(map(cell_xml, r)) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(lines, pa.string())], names=["cells"])

        header = spark.createDataFrame([("".join(map(cell_xml, df.columns)),)], "cells string").coalesce(1)
        body = df.select(*[c.alias(f"c{i}") for i, c in enumerate(cols)]).mapInArrow(run, "cells string")
        part = header.unionAll(body).select(F.lit(k).alias("sheet"), "cells")
        rows = part if rows is None else rows.unionAll(part)
    rows.write.format("gapline_workbook").option("path", path).option("sheets", "\n".join(sheets)).mode("append").save()
