"""Workbooks: what is written is read again, and sheets of other makers are read as they are."""

import os
import zipfile

import pytest
from pyspark.sql import functions as F

from catalith.sources import tables
from catalith.sources import workbooks as W

COLUMNS = ["PART_NUMBER", "Dept", "A & B <c>", "Unnamed: 3", *[f"ATTRIBUTE_LABEL {i}" for i in range(1, 249)]]
ODD = ["", " lead and trail ", "a\nb\r\nc\td", "_x000D_ stays", "\x00\x0b\x1f", "<&\"'>", "é ® ™ 日本 😀", "5", "05.0", "TRUE", "#N/A", "x" * 40_000, None]


def rows(n=1_300):
    return [[str(i), ODD[i % len(ODD)], ODD[(i // 3) % len(ODD)], None, *[f"v{i % 7}-{j}" if (i + j) % 3 else None for j in range(248)]] for i in range(n)]


def test_what_is_written_is_read_again(spark, tmp_path):
    data = rows()
    df = spark.createDataFrame([tuple(r) for r in data], ", ".join(f"`{c}` string" for c in COLUMNS)).repartition(3)
    path = f"file://{tmp_path}/out"
    W.write(df, path, "delivery")
    assert len([f for f in os.listdir(tmp_path / "out") if f.endswith(".xlsx")]) == 3 and not [f for f in os.listdir(tmp_path / "out") if f.startswith("_temp")]
    again = W.scan(spark, path, "delivery")
    assert again.columns == COLUMNS == W.headers(spark, path)
    assert sorted(map(tuple, again.collect()), key=lambda r: int(r[0])) == [tuple(r) for r in data]
    some = W.scan(spark, path, columns=["A & B <c>", "nowhere", "PART_NUMBER"])
    assert sorted(map(tuple, some.collect()), key=lambda r: int(r[2])) == [(r[2], None, r[0]) for r in data]
    W.write(df.limit(0), path)
    assert W.scan(spark, path).columns == COLUMNS and W.scan(spark, path).count() == 0


def test_several_files_a_task_and_more_strings_than_are_shared(spark, tmp_path, monkeypatch):
    class Small(W._Writer):
        def write(self, batches):
            W.MOST_ROWS, W.SHARED_MOST = 11, 5
            return super().write(batches)

    monkeypatch.setattr(W, "_Writer", Small)
    monkeypatch.setattr(W.WorkbookSink, "writer", lambda self, schema, overwrite: Small(self.options["path"], schema.names, "s", overwrite))
    W.write(spark.range(35).select(F.col("id").cast("string").alias("id"), F.lit("x").alias("y")).coalesce(1), str(tmp_path / "o"))
    assert len(os.listdir(tmp_path / "o")) in (1, 4)  # by rows of a file, where the worker takes the smaller bounds
    assert sorted(int(r.id) for r in W.scan(spark, str(tmp_path / "o")).collect()) == list(range(35))


def book(path, sheet, strings="", names=("first", "second")):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{W.MAIN}" xmlns:r="{W.LINKS}"><sheets>{"".join(f"""<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i}"/>""" for i, n in enumerate(names))}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", f'<Relationships xmlns="{W.PACKAGE}/relationships"><Relationship Id="rId0" Target="/xl/worksheets/other.xml"/><Relationship Id="rId1" Target="worksheets/own.xml"/></Relationships>')
        z.writestr("xl/worksheets/own.xml", f'<worksheet xmlns="{W.MAIN}"><sheetData>{sheet}</sheetData></worksheet>')
        z.writestr("xl/worksheets/other.xml", f'<worksheet xmlns="{W.MAIN}"><sheetData/></worksheet>')
        if strings:
            z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{W.MAIN}">{strings}</sst>')


def test_sheets_of_other_makers(spark, tmp_path):
    strings = "<si><t>Name</t></si><si><r><t>rich </t></r><r><t>text</t></r><rPh><t>aid</t></rPh></si><si><t/></si>"
    sheet = """<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="s"><v>0</v></c><c t="inlineStr"><is><t>n</t></is></c></row>
        <row r="3"><c r="A3" t="s"><v>1</v></c><c r="B3"><v>5.0</v></c><c r="C3" t="b"><v>1</v></c><c r="D3" t="e"><v>#N/A</v></c></row>
        <row><c r="B4"><v>0.25</v></c><c r="C4" t="str"><f>1+1</f><v>two</v></c><c r="D4"/></row><row r="5"><c r="A5" t="s"><v>2</v></c><c r="B5"><v>12345678901234567890</v></c><c r="C5"><v>1E3</v></c></row>"""
    book(tmp_path / "a.xlsx", sheet, strings)
    (tmp_path / "notes.txt").write_text("no workbook")
    got = W.scan(spark, str(tmp_path), "second")
    assert got.columns == ["Name", "Unnamed: 1", "Name.1", "n"]
    assert [tuple(r) for r in got.collect()] == [(None,) * 4, ("rich text", "5", "True", "#N/A"), (None, "0.25", "two", None), ("", "12345678901234567890", "1000", None)]
    assert W.scan(spark, str(tmp_path), 1, ["n"]).count() == 4 and W.headers(spark, str(tmp_path)) == []
    with pytest.raises(Exception, match="KeyError"):
        W.scan(spark, str(tmp_path), "third").count()


def test_files_with_other_headers_meet_by_name(spark, tmp_path):
    cell = lambda row, *v: f'<row r="{row}">{"".join(f"""<c t="inlineStr"><is><t>{x}</t></is></c>""" for x in v)}</row>'
    book(tmp_path / "a.xlsx", cell(1, "x", "y") + cell(2, "1", "2"))
    book(tmp_path / "b.xlsx", cell(1, "y", "z") + cell(2, "3", "4"))
    got = W.scan(spark, str(tmp_path), "second")
    assert got.columns == ["x", "y", "z"] and sorted(map(tuple, got.collect()), key=str) == [("1", "2", None), (None, "3", "4")]


def test_tables_scan_and_upload_take_workbooks(spark, tmp_path):
    W.write(spark.createDataFrame([("1", "Acme®", None), ("2", None, "x")], "PART_NUMBER string, Dept string, Fine string"), str(tmp_path / "w"))
    scanned = tables.scan(spark, str(tmp_path / "w"), ["Dept", "PART_NUMBER"], "xlsx")
    assert sorted(map(tuple, scanned.collect()), key=str) == [("Acme®", "1"), (None, "2")]
    assert sorted(map(tuple, tables.upload(spark, str(tmp_path / "w"), "xlsx").collect())) == [("1", "Acme®", ""), ("2", "", "x")]


def test_letters_of_columns():
    assert [W.column_letters(i) for i in (0, 25, 26, 701, 702)] == ["A", "Z", "AA", "ZZ", "AAA"]
    assert all(W.column_place(f"{W.column_letters(i)}12") == i for i in range(20_000))
