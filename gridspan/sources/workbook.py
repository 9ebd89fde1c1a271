"""Workbooks: reading .xlsx files as long cell tables or typed tables, and writing tables to them; pasted text.

Files are read with ``binaryFile``, a task for each file, so many workbooks
are read in parallel and from any store Spark reads. A sheet has at most
1,048,576 rows, which bounds what a task holds.
"""

from __future__ import annotations

import datetime
import decimal
import io
import math
import posixpath
import re
import zipfile
from xml.etree import ElementTree as ET
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..cells import ERRORS, NUM
from ..operators.frames import with_pos

CELLS = "path string, sheet string, row int, col int, kind string, num double, str string, bool boolean, err string, formula string, hidden boolean"
_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main"}
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
MAX_ROWS = 1_048_576


def place(ref: str) -> tuple[int, int]:
    """Row and column, from 1, of an address."""
    letters, digits = re.fullmatch(r"\$?([A-Z]+)\$?([0-9]+)", ref.upper()).groups()
    col = 0
    for ch in letters:
        col = col * 26 + ord(ch) - 64
    return int(digits), col


def letters_of(col: int) -> str:
    out = ""
    while col:
        col, r = divmod(col - 1, 26)
        out = chr(65 + r) + out
    return out


def _strings(book: zipfile.ZipFile) -> list[str]:
    if "xl/sharedStrings.xml" not in book.namelist():
        return []
    root = ET.fromstring(book.read("xl/sharedStrings.xml"))
    return ["".join(t.text or "" for t in si.iter(f"{{{_NS['m']}}}t")) for si in root.findall("m:si", _NS)]


def _sheets(book: zipfile.ZipFile) -> list[tuple[str, str]]:
    rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(book.read("xl/_rels/workbook.xml.rels"))}
    out = []
    for s in ET.fromstring(book.read("xl/workbook.xml")).iter(f"{{{_NS['m']}}}sheet"):
        target = rels[s.get(_REL)].lstrip("/")
        out.append((s.get("name"), target if target.startswith("xl/") else f"xl/{target}"))
    return out


def cells_of(content: bytes):
    """(sheet, row, col, kind, num, str, bool, err, formula, hidden) of every cell of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        strings = _strings(book)
        for sheet, part in _sheets(book):
            hidden = False
            with book.open(part) as stream:
                for event, node in ET.iterparse(stream, ("start", "end")):
                    tag = node.tag.rpartition("}")[2]
                    if event == "start":
                        if tag == "row":
                            hidden = node.get("hidden") in ("1", "true")
                        continue
                    if tag == "row":
                        node.clear()
                    if tag != "c":
                        continue
                    row, col = place(node.get("r"))
                    kind, value = node.get("t", "n"), node.findtext("m:v", None, _NS)
                    formula = node.findtext("m:f", None, _NS)
                    text = "".join(t.text or "" for t in node.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else value
                    if kind == "s" and value is not None:
                        kind, text = "str", strings[int(value)]
                    typed = {"b": "bool", "e": "err", "str": "str", "inlineStr": "str"}.get(kind, "num")
                    if text is None:
                        if formula is not None:
                            yield sheet, row, col, "blank", None, None, None, None, formula, hidden
                        continue
                    yield (sheet, row, col, typed, float(text) if typed == "num" else None, text if typed == "str" else None, text == "1" if typed == "bool" else None, text if typed == "err" else None, formula, hidden)


def read_cells(spark: SparkSession, path: str) -> DataFrame:
    """Every cell of every workbook under a path or pattern."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    kinds = [pa.string(), pa.string(), pa.int32(), pa.int32(), pa.string(), pa.float64(), pa.string(), pa.bool_(), pa.string(), pa.string(), pa.bool_()]
    names = [part.split()[0] for part in CELLS.split(", ")]

    def batch_of(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                rows = []
                for found in cells_of(content):
                    rows.append((file, *found))
                    if len(rows) == 10_000:
                        yield batch_of(rows)
                        rows = []
                if rows:
                    yield batch_of(rows)

    return files.mapInArrow(run, CELLS)


TABLES = "path string, sheet string, name string, area string, header_rows int, total_rows int, columns array<string>"


def tables_of(content: bytes):
    """(sheet, name, area, header rows, total rows, columns) of every table of a workbook."""
    with zipfile.ZipFile(io.BytesIO(content)) as book:
        for sheet, part in _sheets(book):
            folder, file = posixpath.split(part)
            relations = f"{folder}/_rels/{file}.rels"
            for relation in ET.fromstring(book.read(relations)) if relations in book.namelist() else ():
                if relation.get("Type", "").endswith("/table"):
                    target = relation.get("Target")
                    found = ET.fromstring(book.read(target.lstrip("/") if target.startswith("/") else posixpath.normpath(f"{folder}/{target}")))
                    columns = [c.get("name") for c in found.iter(f"{{{_NS['m']}}}tableColumn")]
                    yield sheet, found.get("displayName"), found.get("ref"), int(found.get("headerRowCount", 1)), int(found.get("totalsRowCount", 0)), columns


def read_tables(spark: SparkSession, path: str) -> DataFrame:
    """Every table of every workbook under a path or pattern: its sheet, name, area and columns."""
    files = spark.read.format("binaryFile").load(path).select("path", "content")

    def run(batches):
        for batch in batches:
            for file, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist()):
                names = ("sheet", "name", "area", "header_rows", "total_rows", "columns")
                rows = [{"path": file, **dict(zip(names, found))} for found in tables_of(content)]
                kinds = [pa.string()] * 4 + [pa.int32()] * 2 + [pa.list_(pa.string())]
                yield pa.RecordBatch.from_pylist(rows, pa.schema(list(zip(("path", *names), kinds))))

    return files.mapInArrow(run, TABLES)


def cells_of_tables(cells: DataFrame, tables: DataFrame) -> DataFrame:
    """The cells inside tables, with the table's and the column's name and the row in the table (from 0; header and totals are left out)."""
    corner = lambda i, part: F.regexp_extract("area", r"^\$?([A-Z]+)\$?([0-9]+)(?::\$?([A-Z]+)\$?([0-9]+))?$", 2 * i + part)
    row = lambda i: F.coalesce(corner(i, 2).try_cast("int"), corner(0, 2).cast("int"))
    first = F.aggregate(F.split(corner(0, 1), ""), F.lit(0), lambda acc, x: acc * 26 + F.when(x == "", 0).otherwise(F.ascii(x) - 64))
    edges = tables.select(
        "path", "sheet", F.col("name").alias("table"), "columns", (row(0) + F.col("header_rows")).alias("_top"), (row(1) - F.col("total_rows")).alias("_end"), first.alias("_left"),
    )
    inside = F.col("row").between(F.col("_top"), F.col("_end")) & F.col("col").between(F.col("_left"), F.col("_left") + F.size("columns") - 1)
    found = cells.join(edges, ["path", "sheet"]).where(inside)
    return found.withColumn("column", F.get("columns", F.col("col") - F.col("_left"))).withColumn("table_row", F.col("row") - F.col("_top")).drop("columns", "_top", "_end", "_left")


def table_of(cells: DataFrame, sheet: str, schema: dict[str, str], header_row: int = 1) -> DataFrame:
    """A sheet as a typed table: a column for each name of ``schema`` in the sheet's order, and _pos."""
    rows = cells.where((F.col("sheet") == sheet) & (F.col("row") > header_row))
    pick = {"double": "num", "string": "str", "boolean": "bool", "date": "num"}
    columns = []
    for i, (name, kind) in enumerate(schema.items(), 1):
        value = F.max(F.when(F.col("col") == i, F.col(pick[kind])))
        columns.append((F.date_add(F.expr("DATE'1899-12-30'"), F.floor(value).cast("int")) if kind == "date" else value).alias(name))
    return rows.groupBy("path", "row").agg(*columns).withColumn("_pos", F.col("row") - header_row - 1).drop("row")


def used_area(cells: DataFrame) -> DataFrame:
    return cells.groupBy("path", "sheet").agg(F.min("row").alias("first_row"), F.max("row").alias("last_row"), F.min("col").alias("first_col"), F.max("col").alias("last_col"))


def range_of(cells: DataFrame, sheet: str, area: str) -> DataFrame:
    """The cells of a rectangle such as B2:D9."""
    (r1, c1), (r2, c2) = (place(p) for p in (area.split(":") + area.split(":"))[:2])
    return cells.where((F.col("sheet") == sheet) & F.col("row").between(r1, r2) & F.col("col").between(c1, c2))


_OFFICE = "application/vnd.openxmlformats-officedocument.spreadsheetml"
_PACKAGE = "http://schemas.openxmlformats.org/package/2006"
_DOCUMENT = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
#: Built-in number formats of dates and of dates with a time; fixed values. A cell's style is the place in this list.
_FORMATS = (0, 14, 22)


def _relations(*parts: tuple[str, str]) -> str:
    """A part's relations: (kind, target)."""
    inside = "".join(f'<Relationship Id="rId{i}" Type="{_DOCUMENT}/{kind}" Target="{target}"/>' for i, (kind, target) in enumerate(parts, 1))
    return f'<Relationships xmlns="{_PACKAGE}/relationships">{inside}</Relationships>'


def _quoted(text: str) -> str:
    return escape(text, {'"': "&quot;"})


def _cell_xml(row: int, col: int, value) -> str:
    ref = f"{letters_of(col)}{row}"
    if value is None:
        return ""
    if isinstance(value, bool):
        return f'<c r="{ref}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, float) and not math.isfinite(value):
        return f'<c r="{ref}" t="e"><v>{NUM}</v></c>'
    if isinstance(value, (int, float, decimal.Decimal)):
        return f'<c r="{ref}"><v>{value}</v></c>'
    if isinstance(value, (datetime.date, datetime.datetime)):
        timed = isinstance(value, datetime.datetime)
        moment = value.replace(tzinfo=None) if timed else datetime.datetime(value.year, value.month, value.day)
        return f'<c r="{ref}" s="{2 if timed else 1}"><v>{(moment - datetime.datetime(1899, 12, 30)).total_seconds() / 86400!r}</v></c>'
    return f'<c r="{ref}" t="inlineStr"><is><t xml:space="preserve">{escape(str(value))}</t></is></c>'


def _table_xml(number: int, names: list[str], n_rows: int) -> str:
    area = f"A1:{letters_of(len(names))}{n_rows + 1}"
    columns = "".join(f'<tableColumn id="{i}" name="{_quoted(n)}"/>' for i, n in enumerate(names, 1))
    return f'<table xmlns="{_NS["m"]}" id="{number}" name="Table{number}" displayName="Table{number}" ref="{area}"><autoFilter ref="{area}"/><tableColumns count="{len(names)}">{columns}</tableColumns></table>'


def workbook_bytes(names: list[str], rows, sheet: str = "Sheet1", tables: bool = False) -> bytes:
    """A workbook with one sheet: a header and the rows."""
    return book_bytes({sheet: (names, rows)}, tables)


def book_bytes(sheets: dict, tables: bool = False) -> bytes:
    """A workbook: for each sheet's name its header and rows, marked as a table where asked. Dates have a date format."""
    out = io.BytesIO()
    parts = [f"worksheets/sheet{i}.xml" for i in range(1, len(sheets) + 1)]
    kinds = {"workbook.xml": "sheet.main", "styles.xml": "styles", **{p: "worksheet" for p in parts}}
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as book:
        for i, (names, rows) in enumerate(sheets.values(), 1):
            n_rows = -1
            with book.open(f"xl/{parts[i - 1]}", "w") as part:
                part.write(f'<worksheet xmlns="{_NS["m"]}" xmlns:r="{_DOCUMENT}"><sheetData>'.encode())
                for n_rows, values in enumerate(_chained(names, rows)):
                    part.write((f'<row r="{n_rows + 1}">' + "".join(_cell_xml(n_rows + 1, c, v) for c, v in enumerate(values, 1)) + "</row>").encode())
                part.write(b"</sheetData>")
                if tables and n_rows > 0:
                    part.write(b'<tableParts count="1"><tablePart r:id="rId1"/></tableParts>')
                part.write(b"</worksheet>")
            if tables and n_rows > 0:
                kinds[f"tables/table{i}.xml"] = "table"
                book.writestr(f"xl/tables/table{i}.xml", _table_xml(i, names, n_rows))
                book.writestr(f"xl/worksheets/_rels/sheet{i}.xml.rels", _relations(("table", f"../tables/table{i}.xml")))
        formats = "".join(f'<xf numFmtId="{f}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for f in _FORMATS)
        book.writestr("xl/styles.xml", f'<styleSheet xmlns="{_NS["m"]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="{len(_FORMATS)}">{formats}</cellXfs></styleSheet>')
        listed = "".join(f'<sheet name="{_quoted(n)}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        book.writestr("xl/workbook.xml", f'<workbook xmlns="{_NS["m"]}" xmlns:r="{_DOCUMENT}"><sheets>{listed}</sheets></workbook>')
        book.writestr("xl/_rels/workbook.xml.rels", _relations(*[("worksheet", p) for p in parts], ("styles", "styles.xml")))
        book.writestr("_rels/.rels", _relations(("officeDocument", "xl/workbook.xml")))
        overrides = "".join(f'<Override PartName="/xl/{p}" ContentType="{_OFFICE}.{k}+xml"/>' for p, k in kinds.items())
        book.writestr("[Content_Types].xml", f'<Types xmlns="{_PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/>{overrides}</Types>')
    return out.getvalue()


def _chained(first, rest):
    yield first
    yield from rest


def to_workbooks(df: DataFrame, rows_per_file: int = 100_000, sheet: str = "Sheet1", tables: bool = False) -> DataFrame:
    """Workbooks of up to so many rows (part, content), cut from the partitions as they are; write them with any sink for binaries."""
    names = df.columns
    rows_per_file = min(rows_per_file, MAX_ROWS - 1)

    def run(batches):
        rows, part = [], 0
        for batch in batches:
            rows += [tuple(r.values()) for r in batch.to_pylist()]
            while len(rows) >= rows_per_file:
                yield packed(part, rows[:rows_per_file])
                rows, part = rows[rows_per_file:], part + 1
        if rows:
            yield packed(part, rows)

    def packed(part, rows):
        return pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([workbook_bytes(names, rows, sheet, tables)], pa.binary())], names=["part", "content"])

    return df.mapInArrow(run, "part int, content binary")


def read_pasted(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated text without a header: row, col and the typed cell that each field would become."""
    lines = with_pos(spark.read.text(path).select(F.split("value", "\t", -1).alias("v")), name="row")
    fields = lines.select("row", F.posexplode("v").alias("col", "text"))
    return typed_input(fields, "text")


def typed_input(df: DataFrame, column: str) -> DataFrame:
    """What typing a text into a cell gives: kind, num, str, bool, err and formula."""
    from ..functions.text import VALUE_

    t = F.col(column)
    number = VALUE_(t)
    kind = (
        F.when(t.isNull() | (t == ""), "blank").when(t.startswith("'"), "str").when(t.startswith("=") & (F.length(t) > 1), "formula").when(number.error.isNull(), "num")
        .when(F.upper(t).isin("TRUE", "FALSE"), "bool").when(F.upper(t).isin(*ERRORS), "err").otherwise("str")
    )
    out = df.withColumn("kind", kind)
    return out.withColumns({
        "num": F.when(F.col("kind") == "num", number.raw), "str": F.when(F.col("kind") == "str", F.regexp_replace(t, "^'", "")), "bool": F.when(F.col("kind") == "bool", F.upper(t) == "TRUE"),
        "err": F.when(F.col("kind") == "err", F.upper(t)), "formula": F.when(F.col("kind") == "formula", t.substr(F.lit(2), F.length(t))),
    })
