"""Registered queries of the file readers.

The whole ``customer`` table is exported into files of ROWS rows, in each format and with
that format's quirks, and every file is read back; SQL gives the cells that must return.
"""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .sinks.workbook import Sheet, write_workbook
from .sources.grids import read_grid

ROWS = 250
HEADERS = ["编号", "姓名", "部门", "余额"]
GRID = pa.schema([("file", pa.int64()), ("row", pa.int64()), ("cells", pa.list_(pa.string()))])
FOUND = pa.schema([("file", pa.int64()), ("format", pa.string()), ("encoding", pa.string()), ("delimiter", pa.string())])
Rows = list[list[str]]


def exports(spark: SparkSession, sf: str) -> DataFrame:
    """(file, rows): each file's rows in key order, ROWS at most."""
    key = F.col("c_custkey").cast("long")
    cells = F.array(key.cast("string"), "c_name", "c_mktsegment", F.floor("c_acctbal").cast("long").cast("string"))
    rows = spark.read.parquet(f"{sf}/customer.parquet").select((key - key % ROWS).alias("at"), F.struct(key.alias("key"), cells.alias("cells")).alias("r"))
    return rows.groupBy((F.col("at") / ROWS).cast("long").alias("file")).agg(F.transform(F.sort_array(F.collect_list("r")), lambda r: r["cells"]).alias("rows"))


def delimited(rows: Rows, sep: str = ",", encoding: str = "utf-8") -> bytes:
    lines = [sep.join(r) for r in [HEADERS, *rows]]
    return ("\n\n".join([lines[0], "\n".join(lines[1:])]) + "\n").encode(encoding)


def html(rows: Rows) -> bytes:
    body = "".join(f"<tr><td>{k}<td> <b>{n}</b><script>var x = '<td>';</script></td><td colspan=2>&nbsp;{d}<table><tr><td>in</td></tr></table></td><td>{b}" for k, n, d, b in rows)
    return f"<html><body><table><tr>{''.join(f'<th>{h}</th>' for h in HEADERS)}</tr>{body}</table><table><tr><td>2nd</td></tr></table></body></html>".encode()


def spreadsheetml(rows: Rows) -> bytes:
    def cell(text: str, more: str = "", kind: str = "String") -> str:
        return f'<Cell{more}><Data ss:Type="{kind}">{text}</Data></Cell>'

    head = "".join(map(cell, HEADERS))
    body = "".join(f"<Row>{cell(k + '.0', kind='Number')}{cell(n)}{cell(d, ' ss:Index=\"4\"')}{cell(b, ' ss:MergeAcross=\"1\"')}</Row>" for k, n, d, b in rows)
    space = "urn:schemas-microsoft-com:office:spreadsheet"
    return f'<?xml version="1.0"?><Workbook xmlns="{space}" xmlns:ss="{space}"><Worksheet ss:Name="S"><Table><Row>{head}</Row>{body}</Table></Worksheet></Workbook>'.encode()


def ods(rows: Rows) -> bytes:
    def cell(text: str, more: str = "") -> str:
        return f"<table:table-cell{more}><text:p>{text}</text:p></table:table-cell>"

    def typed(kind: str, name: str, value: str) -> str:
        return f'<table:table-cell office:value-type="{kind}" office:{name}="{value}"/>'

    def line(cells: str) -> str:
        return f'<table:table-row>{cells}<table:table-cell table:number-columns-repeated="1000"/></table:table-row>'

    body = "".join(line(typed("float", "value", k + ".0") + cell(n + '<text:s text:c="1"/>' + d) + cell(b, ' table:number-columns-repeated="2"') + typed("date", "date-value", "2024-03-01") + typed("boolean", "boolean-value", "true")) for k, n, d, b in rows)
    spaces = " ".join(f'xmlns:{x}="urn:oasis:names:tc:opendocument:xmlns:{x}:1.0"' for x in ("office", "table", "text"))
    rest = '<table:table-row table:number-rows-repeated="1048000"><table:table-cell table:number-columns-repeated="1024"/></table:table-row>'
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as box:
        box.writestr("content.xml", f'<office:document-content {spaces}><office:body><office:spreadsheet><table:table table:name="S">{line("".join(map(cell, HEADERS)))}{body}{rest}</table:table></office:spreadsheet></office:body></office:document-content>')
    return out.getvalue()


def xlsx(rows: Rows) -> bytes:
    """By the library's own writer, with characters that a workbook can't hold."""
    out = io.BytesIO()
    write_workbook(out, [Sheet("S", HEADERS, [[k, n + "\x01", f" {d}", b] for k, n, d, b in rows]), Sheet("T", ["x"], [["y"]])])
    return out.getvalue()


def read_back(frame: DataFrame, name: str, render: Callable[[Rows], bytes]) -> DataFrame:
    """(file, row, cells) of every file."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for file, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                grid, _ = read_grid(name, render(rows))
                yield pa.RecordBatch.from_pylist([{"file": file, "row": i, "cells": r} for i, r in enumerate(grid)], GRID)

    return frame.mapInArrow(run, "file long, row long, cells array<string>")


#: What each kind of export is called and how it is made.
KINDS: list[tuple[str, Callable[[Rows], bytes]]] = [
    ("a.csv", lambda r: delimited(r, ",", "utf-8-sig")),
    ("a.txt", lambda r: delimited(r, ";", "gb18030")),
    ("a.xls", html),
    ("a.xls", spreadsheetml),
    ("a.ods", ods),
    ("a.xlsx", xlsx),
]


def read_back_sql(cells: str, header: str = "['编号', '姓名', '部门', '余额']") -> str:
    return f"""WITH c AS (SELECT CAST(c_custkey AS BIGINT) AS key, CAST(c_custkey AS VARCHAR) AS k, c_name AS n, c_mktsegment AS d, CAST(CAST(floor(c_acctbal) AS BIGINT) AS VARCHAR) AS b FROM customer)
      SELECT key // {ROWS} AS file, row_number() OVER (PARTITION BY key // {ROWS} ORDER BY key) AS row, {cells} AS cells FROM c
      UNION ALL SELECT DISTINCT key // {ROWS}, 0, {header} FROM c"""


def scan(name: str, render: Callable[[Rows], bytes]):
    return lambda spark, sf: read_back(exports(spark, sf), name, render)


def found_in_files(spark: SparkSession, sf: str) -> DataFrame:
    """Format, encoding and delimiter of each file; the files take turns in the formats."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for file, rows in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                name, render = KINDS[file % len(KINDS)]
                info = read_grid(name, render(rows))[1]
                out.append({"file": file} | {k: info.get(k) for k in ("format", "encoding", "delimiter")})
            yield pa.RecordBatch.from_pylist(out, FOUND)

    return exports(spark, sf).mapInArrow(run, "file long, format string, encoding string, delimiter string")


PLAIN = "[k, n, d, b]"
QUERIES = {
    "scan_delimited": scan("a.csv", lambda r: delimited(r)),
    "scan_delimited_tabs": scan("a.tsv", lambda r: delimited(r, "\t", "utf-8-sig")),
    "scan_delimited_gb18030": scan("a.txt", lambda r: delimited(r, ";", "gb18030")),
    "scan_html_tables": scan("a.xls", html),
    "scan_spreadsheetml": scan("a.xls", spreadsheetml),
    "scan_ods": scan("a.ods", ods),
    "workbook_round_trip": scan("a.xlsx", xlsx),
    "format_sniff": found_in_files,
}
ORACLES = {
    "scan_delimited": read_back_sql(PLAIN),
    "scan_delimited_tabs": read_back_sql(PLAIN),
    "scan_delimited_gb18030": read_back_sql(PLAIN),
    "scan_html_tables": read_back_sql("[k, regexp_replace(n, '\\s+', '', 'g'), regexp_replace(d, '\\s+', '', 'g'), '', b]"),
    "scan_spreadsheetml": read_back_sql("[k, n, '', d, b, '']"),
    "scan_ods": read_back_sql("[k, n || ' ' || d, b, b, '2024-03-01', 'TRUE']"),
    "workbook_round_trip": read_back_sql(PLAIN),
    "format_sniff": f"""SELECT DISTINCT CAST(c_custkey AS BIGINT) // {ROWS} AS file, ['delimited', 'delimited', 'html', 'spreadsheetml', 'ods', 'xlsx/xlsm'][CAST(c_custkey AS BIGINT) // {ROWS} % 6 + 1] AS format,
      ['utf-8-sig', 'gb18030', NULL, NULL, NULL, NULL][CAST(c_custkey AS BIGINT) // {ROWS} % 6 + 1] AS encoding, [',', ';', NULL, NULL, NULL, NULL][CAST(c_custkey AS BIGINT) // {ROWS} % 6 + 1] AS delimiter FROM customer""",
}
