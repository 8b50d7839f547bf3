"""Workbooks (.xlsx) as a Spark source: spark.read.format("workbook").

The sheet's XML is streamed out of the file, one task for each range of rows; no task holds a sheet, and the driver reads its head alone. Shared texts are held by each task, those that its columns
need. All columns are texts, as a table without types has them.
"""

from __future__ import annotations

import datetime
import posixpath
import re
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StringType, StructField, StructType

#: Names in the parts of a workbook; built-in number formats that show a date or a time.
MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
LINK_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
DATE_FORMATS = {*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)}


def local(path: str) -> str:
    """The path as Python opens it: a folder that the driver and all executors share."""
    return re.sub(r"^file:(//)?(?=/)", "", path)


def column_number(reference: str) -> int:
    """The column, from 0 on, of a cell such as AB12."""
    n = 0
    for ch in reference:
        if not ch.isalpha():
            break
        n = n * 26 + ord(ch.upper()) - 64
    return n - 1


def sheet_parts(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    """(name, part) of the workbook's sheets, in order."""
    links = {x.get("Id"): x.get("Target") for x in ElementTree.fromstring(book.read("xl/_rels/workbook.xml.rels")).iter(f"{LINKS}Relationship")}
    out = []
    for s in ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}sheet"):
        target = links.get(s.get(LINK_ID), "")
        out.append((s.get("name"), target.lstrip("/") if target.startswith("/") else posixpath.normpath(posixpath.join("xl", target))))
    return out


def find_sheet(book: zipfile.ZipFile, sheet: str | None) -> str:
    parts = sheet_parts(book)
    if sheet is None:
        return parts[0][1]
    for i, (name, part) in enumerate(parts):
        if sheet in (name, str(i)):
            return part
    raise ValueError(f"no sheet {sheet!r} among {[n for n, _ in parts]}")


def starts_1904(book: zipfile.ZipFile) -> bool:
    found = next(ElementTree.fromstring(book.read("xl/workbook.xml")).iter(f"{MAIN}workbookPr"), None)
    return found is not None and found.get("date1904") in ("1", "true")


def date_styles(book: zipfile.ZipFile) -> set[int]:
    """Numbers of the cell styles that show a date or a time."""
    if "xl/styles.xml" not in book.namelist():
        return set()
    root = ElementTree.fromstring(book.read("xl/styles.xml"))
    shown = lambda code: re.search(r"[ymdhs]", re.sub(r'"[^"]*"|\\.|\[(?!h+\]|m+\]|s+\])[^\]]*\]', "", code.lower())) is not None
    own = {int(x.get("numFmtId")): shown(x.get("formatCode", "")) for x in root.iter(f"{MAIN}numFmt")}
    formats = [int(x.get("numFmtId", 0)) for cells in root.iter(f"{MAIN}cellXfs") for x in cells.iter(f"{MAIN}xf")]
    return {i for i, f in enumerate(formats) if own.get(f, f in DATE_FORMATS)}


def shared_texts(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    out = []
    with book.open("xl/sharedStrings.xml") as f:
        for _, x in ElementTree.iterparse(f):
            if x.tag == f"{MAIN}si":
                out.append(text_of(x))
                x.clear()
    return out


def text_of(item: ElementTree.Element) -> str:
    """The text of an item and its runs, without what tells how it is read aloud."""
    return "".join(t.text or "" for child in item for t in ([child] if child.tag == f"{MAIN}t" else child.iter(f"{MAIN}t") if child.tag == f"{MAIN}r" else ()))


def date_text(number: float, from_1904: bool) -> str:
    """A day number as a date, with its time if it has one; a number below one day is a time."""
    if 0 <= number < 1:
        return str((datetime.datetime(2000, 1, 1) + datetime.timedelta(seconds=round(number * 86400))).time())
    # 1900 counts as a leap year there: days before March 1900 are one less off
    start = datetime.datetime(1904, 1, 1) if from_1904 else datetime.datetime(1899, 12, 30) if number >= 60 else datetime.datetime(1899, 12, 31)
    try:
        when = start + datetime.timedelta(days=int(number), seconds=round((number - int(number)) * 86400))
    except OverflowError:
        return number_text(str(number))
    return str(when.date()) if when.time() == datetime.time() else str(when)


def number_text(raw: str) -> str:
    if re.fullmatch(r"-?\d+", raw):
        return raw
    x = float(raw)
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def rows_of(path: str, sheet: str | None, first: int, last: int | None, wanted: set[int] | None = None) -> Iterator[dict[int, str]]:
    """The rows numbered first to last, from 0 on, as texts by column; rows that the sheet leaves out are empty. wanted: the columns that are read."""
    with zipfile.ZipFile(local(path)) as book:
        part, texts, dates, early = find_sheet(book, sheet), None, date_styles(book), starts_1904(book)
        with book.open(part) as f:
            at, data = -1, None
            for event, x in ElementTree.iterparse(f, events=("start", "end")):
                if event == "start":
                    if x.tag == f"{MAIN}sheetData":
                        data = x
                    continue
                if x.tag != f"{MAIN}row":
                    continue
                number = int(x.get("r")) - 1 if x.get("r") else at + 1
                for _ in range(max(at + 1, first), number if last is None else min(number, last + 1)):
                    yield {}
                at = number
                if last is not None and at > last:
                    return
                if at >= first:
                    out, column = {}, -1
                    for cell in x.iter(f"{MAIN}c"):
                        column = column_number(cell.get("r")) if cell.get("r") else column + 1
                        if wanted is not None and column not in wanted:
                            continue
                        kind, value = cell.get("t", "n"), cell.find(f"{MAIN}v")
                        if kind == "inlineStr":
                            inline = cell.find(f"{MAIN}is")
                            found = text_of(inline) if inline is not None else None
                        elif value is None or value.text is None or kind == "e":
                            found = None
                        elif kind == "s":
                            texts = shared_texts(book) if texts is None else texts
                            found = texts[int(value.text)]
                        elif kind == "b":
                            found = "True" if value.text == "1" else "False"
                        elif kind == "n":
                            found = date_text(float(value.text), early) if int(cell.get("s", 0)) in dates else number_text(value.text)
                        else:
                            found = value.text
                        if found is not None and found != "":
                            out[column] = found
                    yield out
                data.clear()  # what is read is let go


def last_row(path: str, sheet: str | None) -> int:
    """The last row's number by what the sheet says of itself before its rows; 0 where it says nothing."""
    with zipfile.ZipFile(local(path)) as book, book.open(find_sheet(book, sheet)) as f:
        for event, x in ElementTree.iterparse(f, events=("start",)):
            if x.tag == f"{MAIN}dimension":
                found = re.search(r"(\d+)$", x.get("ref", ""))
                return int(found.group(1)) - 1 if found else 0
            if x.tag == f"{MAIN}sheetData":
                return 0
    return 0


def header(path: str, sheet: str | None) -> list[str]:
    """Names by the first row: a blank one is Unnamed: i, one that comes again gets a number."""
    own = next(rows_of(path, sheet, 0, 0), {})
    out: list[str] = []
    for i in range(max(own, default=-1) + 1):
        name = base = own.get(i) or f"Unnamed: {i}"
        n = 0
        while name in out:
            n += 1
            name = f"{base}.{n}"
        out.append(name)
    return out


class Rows(InputPartition):
    def __init__(self, first: int, last: int | None):
        super().__init__((first, last))
        self.first, self.last = first, last


class WorkbookReader(DataSourceReader):
    def __init__(self, path: str, sheet: str | None, names: list[str], wanted: list[str], rows: int):
        self.path, self.sheet, self.rows = path, sheet, rows
        self.columns = [names.index(w) for w in wanted]

    def partitions(self):
        last = last_row(self.path, self.sheet)
        starts = list(range(1, max(last, 1) + 1, self.rows))
        # the last one has no end: what a sheet says of its size may be wrong
        return [Rows(a, b - 1 if b else None) for a, b in zip(starts, [*starts[1:], None], strict=True)]

    def read(self, partition):
        for row in rows_of(self.path, self.sheet, partition.first, partition.last, set(self.columns)):
            yield tuple(row.get(c) for c in self.columns)


class Workbook(DataSource):
    """Options: path; sheet, by name or number from 0 on (the first); columns, comma-separated or a JSON list (all): only those are read; rowsPerTask (50,000)."""

    @classmethod
    def name(cls):
        return "workbook"

    def _names(self) -> list[str]:
        return header(self.options["path"], self.options.get("sheet"))

    def schema(self):
        import json

        names, wanted = self._names(), self.options.get("columns")
        if wanted:
            wanted = json.loads(wanted) if wanted.startswith("[") else [x.strip() for x in wanted.split(",")]
            if missing := [x for x in wanted if x not in names]:
                raise ValueError(f"no columns {missing} among {names}")
        return StructType([StructField(n, StringType()) for n in wanted or names])

    def reader(self, schema):
        return WorkbookReader(self.options["path"], self.options.get("sheet"), self._names(), schema.names, int(self.options.get("rowspertask", self.options.get("rowsPerTask", 50_000))))


def read_workbook(spark: SparkSession, path: str, sheet: str | int | None = None, columns: list[str] | None = None, rows_per_task: int = 50_000):
    """A sheet of an .xlsx file with a header row, all columns as texts: whole numbers without a point, dates as yyyy-MM-dd, with a time if they have one; blank cells and errors are null. Merged
    cells have their value in the first. The path is of a folder that the driver and the executors share."""
    import json

    spark.dataSource.register(Workbook)
    out = spark.read.format("workbook").option("path", path).option("rowsPerTask", rows_per_task)
    out = out if sheet is None else out.option("sheet", str(sheet))
    return (out if columns is None else out.option("columns", json.dumps(columns))).load()
