"""Workbooks: shared strings, tables, several sheets, formats of dates, pasted text."""

import datetime
import io
import zipfile

from pyspark.sql import functions as F

from gridspan.sources import workbook as WB


def _stored(tmp_path, name, content):
    (tmp_path / name).write_bytes(content)
    return f"file://{tmp_path}/*.xlsx"


def test_shared_strings(spark, tmp_path):
    plain = WB.workbook_bytes(["a", "b"], [("x", 1)])
    source, out = zipfile.ZipFile(io.BytesIO(plain)), io.BytesIO()
    with zipfile.ZipFile(out, "w") as book:
        for part in source.namelist():
            body = source.read(part)
            if part.endswith("sheet1.xml"):
                body = body.replace(b't="inlineStr"><is><t xml:space="preserve">x</t></is>', b't="s"><v>1</v>')
            book.writestr(part, body)
        book.writestr("xl/sharedStrings.xml", f'<sst xmlns="{WB._NS["m"]}"><si><t>other</t></si><si><r><t>two </t></r><r><t>runs</t></r></si></sst>')
    cells = WB.read_cells(spark, _stored(tmp_path, "s.xlsx", out.getvalue()))
    assert [(r.kind, r.str) for r in cells.where("row = 2 AND col = 1").collect()] == [("str", "two runs")]


def test_sheets_and_tables(spark, tmp_path):
    day, moment = datetime.date(2024, 2, 29), datetime.datetime(2024, 2, 29, 12)
    book = WB.book_bytes({"One & only": (["k", 'q"uoted'], [(1, day), (2, moment)]), "Two": (["n"], [(7.5,), (float("nan"),)]), "None": (["z"], [])}, tables=True)
    path = _stored(tmp_path, "t.xlsx", book)
    cells, tables = WB.read_cells(spark, path), WB.read_tables(spark, path)
    found = {r.name: r for r in tables.collect()}
    assert [(r.sheet, r.area, r.columns) for _, r in sorted(found.items())] == [("One & only", "A1:B3", ["k", 'q"uoted']), ("Two", "A1:A3", ["n"])]
    inside = WB.cells_of_tables(cells, tables).orderBy("table", "table_row", "column")
    assert [(r.table, r.table_row, r.column, r.num, r.err) for r in inside.collect()] == [
        ("Table1", 0, "k", 1.0, None), ("Table1", 0, 'q"uoted', 45351.0, None), ("Table1", 1, "k", 2.0, None), ("Table1", 1, 'q"uoted', 45351.5, None), ("Table2", 0, "n", 7.5, None), ("Table2", 1, "n", None, "#NUM!"),
    ]
    sheet = zipfile.ZipFile(io.BytesIO(book)).read("xl/worksheets/sheet1.xml").decode()
    assert '<c r="B2" s="1"><v>45351.0</v></c>' in sheet and '<c r="B3" s="2"><v>45351.5</v></c>' in sheet
    assert cells.select("sheet").distinct().count() == 3


def test_far_table_with_totals(spark):
    cells = spark.createDataFrame([("p", "S", r, c, float(r * 100 + c)) for r in range(3, 8) for c in range(27, 31)], "path string, sheet string, row int, col int, num double")
    tables = spark.createDataFrame([("p", "S", "T", "$AB$4:$AC$7", 1, 1, ["a", "b"])], WB.TABLES)
    assert [(r.table_row, r.column, r.num) for r in WB.cells_of_tables(cells, tables).orderBy("num").collect()] == [(0, "a", 528.0), (0, "b", 529.0), (1, "a", 628.0), (1, "b", 629.0)]


def test_books_without_tables(spark, tmp_path):
    path = _stored(tmp_path, "u.xlsx", WB.workbook_bytes(["a"], [(True,)]))
    assert WB.read_tables(spark, path).count() == 0


def test_pasted_rows_are_dense(spark, tmp_path):
    for i in range(3):
        (tmp_path / f"{i}.tsv").write_text("1\tx\n2\ty\n")
    rows = WB.read_pasted(spark, f"file://{tmp_path}/*.tsv").agg(F.sort_array(F.collect_set("row")).alias("r"), F.count(F.lit(1)).alias("n")).first()
    assert rows.r == list(range(6)) and rows.n == 12
