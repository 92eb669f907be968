"""Workbooks and CSV files: what is written is read back, and files of other programs are read."""

import os
import zipfile
from xml.etree import ElementTree

import pytest
from gapline.sources import tables, workbook
from pyspark.sql import functions as F

MAIN = workbook.MAIN[1:-1]


def test_round_trip(spark, tmp_path):
    rows = [
        (1, "plain", 1.5, True, None),
        (-2, " <b>&\"' \n two\r\n\tlines ", -0.25, False, "x"),
        (None, "\x01 and _x0041_ ￾ é 𝄞", None, None, ""),
        (2**60, None, 1e300, None, "y"),
    ]
    df = spark.createDataFrame(rows, "n long, text string, x double, yes boolean, `odd name` string").coalesce(1)
    more = spark.range(1000).repartition(5).sortWithinPartitions("id").withColumn("a", F.array("id"))
    path = f"{tmp_path}/book.xlsx"
    workbook.write({"first": df, "s & 2": more}, path)
    assert os.listdir(tmp_path) == ["book.xlsx"]
    got = tables.read_table(spark, path)
    assert got.dtypes == [("n", "bigint"), ("text", "string"), ("x", "double"), ("yes", "boolean"), ("odd name", "string")]
    assert [tuple(r) for r in got.collect()] == rows
    for which in ("s & 2", 1):
        second = tables.read_table(spark, path, which)
        assert sorted((r.id, r.a) for r in second.collect()) == [(k, f"[{k}]") for k in range(1000)]
    for bad in ("none", 2, -1):
        with pytest.raises(Exception, match="no sheet"):
            tables.read_table(spark, path, bad).collect()


def test_written_file_is_well_formed(spark, tmp_path):
    path = f"{tmp_path}/b.xlsx"
    tables.write_tables(f"{tmp_path}/b", "xlsx", a=spark.range(3), b=spark.range(2))
    with zipfile.ZipFile(path) as z:
        assert z.testzip() is None
        for name in z.namelist():
            ElementTree.fromstring(z.read(name))
    tables.write_tables(f"{tmp_path}/b", "xlsx", a=spark.range(1))  # replaces it
    assert tables.read_table(spark, path).count() == 1


def test_a_failed_job_leaves_nothing(spark, tmp_path):
    path = f"{tmp_path}/b.xlsx"
    long = spark.range(4).select(F.when(F.col("id") == 3, F.repeat(F.lit("x"), 32_768)).otherwise("y").alias("t"))
    with pytest.raises(Exception, match="32767 characters"):
        workbook.write({"a": long}, path)
    assert not os.path.exists(path)
    for bad in ({}, {"": spark.range(1)}, {"a/b": spark.range(1)}, {"x" * 32: spark.range(1)}):
        with pytest.raises(ValueError):
            workbook.write(bad, path)
    with pytest.raises(ValueError):
        workbook.write({"a": spark.range(1)}, "hdfs://host/b.xlsx")


def test_too_many_rows_are_an_error(tmp_path, monkeypatch):
    monkeypatch.setattr(workbook, "MOST_ROWS", 2)
    w = workbook.SheetsWriter(f"{tmp_path}/b.xlsx", ["a"])
    os.makedirs(w.folder)
    with pytest.raises(ValueError, match="holds at most 2 rows"):
        w.commit([workbook.Written(0, "f", {0: 3})])
    assert os.listdir(tmp_path) == []


def book(path, sheet, strings="", styles="", extra=""):
    """A workbook as other programs write it: shared strings, references, styles."""
    rels = "http://schemas.openxmlformats.org/package/2006/relationships"
    office = workbook.LINK[1:-3]
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{MAIN}" xmlns:r="{office}">{extra}<sheets><sheet name="Data" sheetId="1" r:id="rId9"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{rels}"><Relationship Id="rId9" Type="t" Target="/xl/worksheets/s.xml"/></Relationships>')
        z.writestr("xl/worksheets/s.xml", f'<worksheet xmlns="{MAIN}"><dimension ref="A1"/><sheetData>{sheet}</sheetData></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{MAIN}">{strings}</sst>')
        if styles:
            z.writestr("xl/styles.xml", f'<styleSheet xmlns="{MAIN}">{styles}</styleSheet>')


def test_files_of_other_programs(spark, tmp_path):
    strings = "<si><t>ID</t></si><si><r><t>When</t></r><r><t> it was</t></r><rPh><t>no</t></rPh></si><si><t>a_x000D_b</t></si>"
    styles = '<numFmts><numFmt numFmtId="170" formatCode="yyyy\\-mm"/><numFmt numFmtId="171" formatCode="&quot;day&quot; 0.0"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="170"/><xf numFmtId="171"/><xf numFmtId="14"/></cellXfs>'
    sheet = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="D1" t="str"><f>x</f><v>ID</v></c></row>
<row r="2"><c r="A2"><v>7</v></c><c r="B2" s="1"><v>45000.5</v></c><c r="C2" s="2"><v>3.5</v></c><c r="D2" t="s"><v>2</v></c><c r="E2" t="b"><v>1</v></c></row>
<row r="4"><c r="A4"><v>8</v></c><c r="B4" s="3"><v>1</v></c><c r="C4" t="e"><v>#N/A</v></c><c r="AA4"><v>2</v></c></row>"""
    book(f"{tmp_path}/o.xlsx", sheet, strings, styles)
    got = tables.read_table(spark, f"{tmp_path}/o.xlsx", "Data")
    assert got.columns[:5] == ["ID", "When it was", "Unnamed: 2", "ID.1", "Unnamed: 4"] and len(got.columns) == 27
    assert [k for _, k in got.dtypes[:5]] == ["bigint", "string", "double", "string", "boolean"] and got.dtypes[26][1] == "bigint"
    assert [tuple(r)[:5] for r in got.collect()] == [(7, "2023-03-15 12:00:00", 3.5, "a\rb", True), (None,) * 5, (8, "1899-12-31 00:00:00", None, None, None)]
    assert got.collect()[2][26] == 2


def test_a_folder_of_workbooks(spark, tmp_path):
    head = '<row><c t="inlineStr"><is><t>a</t></is></c><c t="inlineStr"><is><t>{}</t></is></c></row>'
    book(f"{tmp_path}/1.xlsx", head.format("b") + "<row><c><v>1</v></c><c><v>2</v></c></row>")
    book(f"{tmp_path}/2.xlsm", head.format("c") + "<row><c><v>1.5</v></c><c t='inlineStr'><is><t>z</t></is></c></row>", extra='<workbookPr date1904="1"/>')
    (tmp_path / "note.txt").write_text("no workbook")
    got = workbook.read(spark, str(tmp_path))
    assert got.dtypes == [("a", "double"), ("b", "bigint"), ("c", "string")]
    assert sorted(map(tuple, got.collect())) == [(1.0, 2, None), (1.5, None, "z")]
    book(f"{tmp_path}/e.xlsx", "")
    with pytest.raises(ValueError, match="no columns"):
        workbook.read(spark, f"{tmp_path}/e.xlsx")


def test_csv_in_four_charsets(spark, tmp_path):
    folder = tmp_path / "t.csv"
    folder.mkdir()
    (folder / "1.csv").write_bytes("﻿name,x\né,1\n".encode())
    (folder / "2.csv").write_bytes("name,x\nü,2\n".encode())
    (folder / "3.csv").write_bytes("name,x\n“ß”,3\n".encode("cp1252"))
    (folder / "4.csv").write_bytes(b"name,x\nok\xe9\x81,4\n\"two\nlines\",5\n")
    assert {k: len(v) for k, v in tables.charsets(spark, str(folder)).items()} == {"utf-8": 2, "windows-1252": 1, "replace": 1}
    got = tables.read_table(spark, str(folder))
    assert got.columns == ["name", "x"]
    assert sorted(map(tuple, got.collect())) == sorted([("é", "1"), ("ü", "2"), ("“ß”", "3"), ("ok�", "4"), ("two\nlines", "5")])
    (folder / "4.csv").write_bytes(b"name,x\nok\xe9\x81,4\n")
    assert sorted(map(tuple, tables.read_csv(spark, str(folder), multi_line=False).collect())) == sorted(
        [("é", "1"), ("ü", "2"), ("“ß”", "3"), ("ok�", "4")]
    )


def test_csv_with_a_byte_order_mark(spark, tmp_path):
    df = spark.createDataFrame([("é", 1), ("b", 2)], "name string, x int").repartition(2)
    tables.write_tables(str(tmp_path), "csv", mark=True, t=df)
    files = [f for f in os.listdir(f"{tmp_path}/t") if f.endswith(".csv")]
    assert files and all(open(f"{tmp_path}/t/{f}", "rb").read(3) == b"\xef\xbb\xbf" for f in files)
    os.rename(f"{tmp_path}/t", f"{tmp_path}/t.csv")
    assert sorted(map(tuple, tables.read_table(spark, f"{tmp_path}/t.csv").collect())) == [("b", "2"), ("é", "1")]
