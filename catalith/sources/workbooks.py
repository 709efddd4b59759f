"""Excel workbooks in and out (O-001, O-004, O-005, O-011).

Reading goes by file: Spark's binary source brings each workbook to a task, from any store that Spark reads, and the task walks the sheet's XML as a stream,
`BATCH` rows at a time. Shared strings are looked up by index; cells of columns that are not asked for are passed over. All values are
strings: numbers as they are written, without a fraction of zero; dates as their serial number; errors as their text, since a bad cell is no reason to lose a row.

Writing is a data source of Spark: each task streams its rows into a workbook of its own under a temporary name, and the driver moves all of them into
place when every task is done, so a task that is run again leaves nothing twice. `repartition(1)` gives one file. Beyond `MOST_ROWS` rows a task begins another file.

Defined cases: a cell that is not there is null, an empty string stays empty; rows left out of a sheet are rows of nulls; repeated headers get .1, .2 and so on, empty ones
`Unnamed: ` and their place; files with other headers are matched by name, columns that a file lacks are null; an empty table gives one workbook with its header; characters that XML cannot hold
are escaped as Excel does it.
"""

from __future__ import annotations

import io
import re
import uuid
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from xml.etree.ElementTree import iterparse
from xml.sax.saxutils import escape, quoteattr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, WriterCommitMessage

from catalith.session import prepare

BATCH, MOST_ROWS, MOST_COLUMNS, SHARED_MOST = 2_000, 1 << 20, 16_384, 100_000
#: Names of the format's parts and kinds.
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
LINKS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_ESCAPED, _NOT_XML = re.compile(r"_x([0-9A-Fa-f]{4})_"), re.compile("[\x00-\x08\x0b\x0c\x0d\x0e-\x1f￾￿]|_(?=x[0-9A-Fa-f]{4}_)")


def column_letters(place: int) -> str:
    """A for 0, Z for 25, AA for 26."""
    letters = ""
    place += 1
    while place:
        place, rest = divmod(place - 1, 26)
        letters = chr(65 + rest) + letters
    return letters


def column_place(reference: str) -> int:
    place = 0
    for c in reference:
        if not c.isalpha():
            break
        place = place * 26 + ord(c.upper()) - 64
    return place - 1


def shown_number(text: str) -> str:
    """A number as it is written, without a fraction of zero."""
    try:
        number = float(text)
    except ValueError:
        return text
    return str(int(number)) if number.is_integer() and abs(number) < 1e15 else text if text.lstrip("-").isdigit() else repr(number)


def unescaped(text: str) -> str:
    return _ESCAPED.sub(lambda m: chr(int(m.group(1), 16)), text) if "_x" in text else text


def escaped(text: str) -> str:
    return escape(_NOT_XML.sub(lambda m: f"_x{ord(m.group()):04X}_", text))


def _text(node) -> str:
    """The text of a string, of all its runs, without its reading aids."""
    found = [node.findtext(f"{{{MAIN}}}t") or ""] if node.find(f"{{{MAIN}}}r") is None else [r.findtext(f"{{{MAIN}}}t") or "" for r in node.iterfind(f"{{{MAIN}}}r")]
    return unescaped("".join(found))


class Workbook:
    """A workbook's sheets, read as streams."""

    def __init__(self, content: bytes):
        self.files = zipfile.ZipFile(io.BytesIO(content))
        names = set(self.files.namelist())
        self.strings = [_text(x) for x in self._parts("xl/sharedStrings.xml", "si")] if "xl/sharedStrings.xml" in names else []
        targets = {x.get("Id"): x.get("Target") for x in self._parts("xl/_rels/workbook.xml.rels", "Relationship", f"{PACKAGE}/relationships")}
        place = lambda t: t.lstrip("/") if t.startswith("/") else f"xl/{t}"
        self.sheets = {x.get("name"): place(targets[x.get(f"{{{LINKS}}}id")]) for x in self._parts("xl/workbook.xml", "sheet")}

    def _parts(self, name: str, tag: str, space: str = MAIN) -> Iterator:
        with self.files.open(name) as stream:
            root = None
            for event, node in iterparse(stream, ("start", "end")):
                root = node if root is None else root
                if event == "end" and node.tag == f"{{{space}}}{tag}":
                    yield node
                    root.clear()

    def _value(self, cell) -> str | None:
        kind, text = cell.get("t", "n"), cell.findtext(f"{{{MAIN}}}v")
        if kind == "inlineStr":
            inside = cell.find(f"{{{MAIN}}}is")
            return "" if inside is None else _text(inside)
        if text is None:
            return None
        if kind == "s":
            return self.strings[int(text)]
        if kind == "b":
            return str(text.strip() == "1")
        return shown_number(text) if kind == "n" else unescaped(text)

    def rows(self, sheet: str | int = 0, wanted: set[int] | None = None) -> Iterator[dict[int, str]]:
        """The cells of each row by place; only the wanted ones. Rows that the sheet leaves out are empty."""
        name = list(self.sheets.values())[sheet] if isinstance(sheet, int) else self.sheets[sheet]
        at = 0
        with self.files.open(name) as stream:
            own, place, data = {}, -1, None
            for event, node in iterparse(stream, ("start", "end")):
                if event == "start":
                    data = node if node.tag == f"{{{MAIN}}}sheetData" else data
                elif node.tag == f"{{{MAIN}}}c":
                    place = column_place(node.get("r")) if node.get("r") else place + 1
                    if wanted is None or place in wanted:
                        value = self._value(node)
                        if value is not None:
                            own[place] = value
                    node.clear()
                elif node.tag == f"{{{MAIN}}}row":
                    number = int(node.get("r") or at + 1)
                    while at < number - 1:
                        at += 1
                        yield {}
                    at = number
                    yield own
                    own, place = {}, -1
                    data.clear()

    def header(self, sheet: str | int = 0) -> list[str]:
        """Column names: the first row, read alone."""
        first = next(self.rows(sheet), {})
        seen: dict[str, int] = {}
        names = []
        for i in range(max(first, default=-1) + 1):
            name = first.get(i) or f"Unnamed: {i}"
            again = seen.get(name, 0)
            seen[name] = again + 1
            names.append(f"{name}.{again}" if again else name)
        return names


def _files(spark: SparkSession, path: str) -> DataFrame:
    return prepare(spark).read.format("binaryFile").option("pathGlobFilter", "*.xlsx").load(path).select("path", "content")


def headers(spark: SparkSession, path: str, sheet: str | int = 0) -> list[str]:
    """O-005. The column names of all workbooks, those of the first file first; no row is read beyond the first."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.record_batch({"path": batch.column("path"), "names": pa.array([Workbook(x.as_py()).header(sheet) for x in batch.column("content")], pa.list_(pa.string()))})

    kinds = _files(spark, path).mapInArrow(rows, "path string, names array<string>").groupBy("names").agg(F.min("path").alias("path"))
    return list(dict.fromkeys(n for r in kinds.orderBy("path").collect() for n in r["names"]))  # one row for each different header


def scan(spark: SparkSession, path: str, sheet: str | int = 0, columns: list[str] | None = None) -> DataFrame:
    """O-001. All rows of all workbooks as strings; with `columns`, only those are read, in that order."""
    names = columns or headers(spark, path, sheet)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                book = Workbook(content.as_py())
                places = {n: i for i, n in enumerate(book.header(sheet))}
                at = [places.get(n) for n in names]
                held: list[dict[int, str]] = []
                stream = book.rows(sheet, {i for i in at if i is not None})
                next(stream, None)
                for row in stream:
                    held.append(row)
                    if len(held) == BATCH:
                        yield _batch(held, names, at)
                        held = []
                yield _batch(held, names, at)

    return _files(spark, path).mapInArrow(rows, ", ".join(f"`{n.replace('`', '``')}` string" for n in names))


def _batch(held: list[dict[int, str]], names: list[str], at: list[int | None]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([row.get(i) for row in held], pa.string()) for i in at], names=names)


class SheetWriter:
    """Streams rows into a workbook."""

    def __init__(self, stream, names: list[str], sheet: str):
        self.files, self.sheet, self.shared, self.row = zipfile.ZipFile(stream, "w", zipfile.ZIP_DEFLATED), sheet, {}, 0
        self.letters = [column_letters(i) for i in range(len(names))]
        self.data = self.files.open("xl/worksheets/sheet1.xml", "w", force_zip64=True)
        self.data.write(f'{_HEAD}<worksheet xmlns="{MAIN}"><sheetData>'.encode())
        self.add([names])

    def _cell(self, letters: str, value: str) -> str:
        place = self.shared.get(value)
        if place is None and len(self.shared) < SHARED_MOST:
            place = self.shared[value] = len(self.shared)
        if place is None:
            return f'<c r="{letters}{self.row}" t="inlineStr"><is><t xml:space="preserve">{escaped(value)}</t></is></c>'
        return f'<c r="{letters}{self.row}" t="s"><v>{place}</v></c>'

    def add(self, rows: list[list[str | None]], letters: list[str] | None = None) -> None:
        """letters: those of the columns that the rows have, if not all."""
        out, letters = [], letters or self.letters
        for row in rows:
            self.row += 1
            out.append(f'<row r="{self.row}">{"".join(self._cell(a, v) for a, v in zip(letters, row, strict=True) if v is not None)}</row>')
        self.data.write("".join(out).encode())

    def close(self) -> None:
        self.data.write(b"</sheetData></worksheet>")
        self.data.close()
        strings = "".join(f'<si><t xml:space="preserve">{escaped(x)}</t></si>' for x in self.shared)
        kind, office = "application/vnd.openxmlformats-officedocument.spreadsheetml", f"{LINKS}/officeDocument"
        parts = {"workbook": "sheet.main", "worksheets/sheet1": "worksheet", "sharedStrings": "sharedStrings"}
        self.files.writestr("xl/sharedStrings.xml", f'{_HEAD}<sst xmlns="{MAIN}">{strings}</sst>')
        self.files.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{MAIN}" xmlns:r="{LINKS}"><sheets><sheet name={quoteattr(self.sheet)} sheetId="1" r:id="rId1"/></sheets></workbook>')
        self.files.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{LINKS}/worksheet" Target="worksheets/sheet1.xml"/><Relationship Id="rId2" Type="{LINKS}/sharedStrings" Target="sharedStrings.xml"/></Relationships>')
        self.files.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{office}" Target="xl/workbook.xml"/></Relationships>')
        kinds = "".join(f'<Override PartName="/xl/{name}.xml" ContentType="{kind}.{what}+xml"/>' for name, what in parts.items())
        self.files.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/>{kinds}</Types>')
        self.files.close()


@dataclass
class Written(WriterCommitMessage):
    files: list[str]


def _store(path: str):
    from pyarrow.fs import FileSystem, LocalFileSystem

    return FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (LocalFileSystem(), path)


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, names: list[str], sheet: str, overwrite: bool):
        if len(names) > MOST_COLUMNS:
            raise ValueError(f"a sheet has at most {MOST_COLUMNS} columns")
        self.path, self.names, self.sheet, self.overwrite, self.temporary = path, names, sheet, overwrite, f"_temporary-{uuid.uuid4().hex}"

    def _open(self) -> tuple[str, object]:
        files, root = _store(self.path)
        files.create_dir(f"{root}/{self.temporary}", recursive=True)
        name = f"part-{uuid.uuid4().hex}.xlsx"
        return name, files.open_output_stream(f"{root}/{self.temporary}/{name}")

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        from pyspark import TaskContext

        done, writer, stream = [], None, None
        part = TaskContext.get().partitionId()
        for batch in batches:
            filled = [i for i, c in enumerate(batch.columns) if c.null_count < len(c)]  # most columns of a wide sheet are empty
            letters = [column_letters(i) for i in filled]
            rows = list(zip(*[batch.column(i).cast(pa.string()).to_pylist() for i in filled], strict=True)) if filled else [()] * batch.num_rows
            while rows:
                if writer is None:
                    name, stream = self._open()
                    done.append(f"{name}|part-{part:06d}-{len(done):04d}-{uuid.uuid4().hex[:12]}.xlsx")
                    writer = SheetWriter(stream, self.names, self.sheet)
                room = MOST_ROWS - writer.row
                writer.add(rows[:room], letters)
                rows = rows[room:]
                if writer.row >= MOST_ROWS:
                    writer.close()
                    stream.close()
                    writer = None
        if writer is not None:
            writer.close()
            stream.close()
        return Written(done)

    def commit(self, messages: list[Written | None]) -> None:
        files, root = _store(self.path)
        made = [f for m in messages if m for f in m.files]
        if not made:  # an empty table has its header all the same
            name, stream = self._open()
            SheetWriter(stream, self.names, self.sheet).close()
            stream.close()
            made = [f"{name}|part-000000-0000-{uuid.uuid4().hex[:12]}.xlsx"]
        if self.overwrite:
            from pyarrow.fs import FileSelector, FileType

            for old in files.get_file_info(FileSelector(root)):
                if old.type == FileType.File and old.base_name.endswith(".xlsx"):
                    files.delete_file(old.path)
        for f in made:
            name, final = f.split("|")
            files.move(f"{root}/{self.temporary}/{name}", f"{root}/{final}")
        files.delete_dir(f"{root}/{self.temporary}")

    def abort(self, messages: list[Written | None]) -> None:
        files, root = _store(self.path)
        if files.get_file_info(f"{root}/{self.temporary}").type.name == "Directory":
            files.delete_dir(f"{root}/{self.temporary}")


class WorkbookSink(DataSource):
    """df.write.format("workbook").option("sheet", name).save(path), once registered."""

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def writer(self, schema, overwrite: bool) -> _Writer:
        return _Writer(self.options["path"], schema.names, self.options.get("sheet", "Sheet1"), overwrite)


def write(df: DataFrame, path: str, sheet: str = "Sheet1", mode: str = "overwrite") -> None:
    """O-011. Rows as workbooks in a folder, one for each partition that has rows."""
    prepare(df.sparkSession).dataSource.register(WorkbookSink)
    df.write.format("workbook").option("sheet", sheet).mode(mode).save(path)
