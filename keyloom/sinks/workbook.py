"""Result workbooks: inline strings, styled and frozen header, filter, column widths."""

from __future__ import annotations

import re
import zipfile
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import chain, islice
from xml.sax.saxutils import escape

from ..lexicon import ILLEGAL_XML

HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
DOCS = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
PACKAGE = "http://schemas.openxmlformats.org/package/2006"
KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml"
STYLES = f"""{HEAD}<styleSheet xmlns="{MAIN}"><fonts count="2"><font><sz val="11"/></font><font><b/><sz val="11"/></font></fonts>
<fills count="3"><fill><patternFill patternType="none"/></fill><fill><patternFill patternType="gray125"/></fill><fill><patternFill patternType="solid"><fgColor rgb="FFDCE6F1"/></patternFill></fill></fills>
<borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs>
<cellXfs count="2"><xf xfId="0"/><xf fontId="1" fillId="2" applyFont="1" applyFill="1" xfId="0"/></cellXfs></styleSheet>"""
#: Rows that column widths are measured on.
WIDTH_ROWS = 500


@dataclass
class Sheet:
    name: str
    headers: list[str]
    rows: Iterable[Iterable[object]]


def letters(place: int) -> str:
    out = ""
    while place >= 0:
        place, rest = divmod(place, 26)
        out, place = chr(65 + rest) + out, place - 1
    return out


def safe(value: object) -> str:
    return escape(re.sub(ILLEGAL_XML, "", "" if value is None else str(value)), {'"': "&quot;"})


def widths(headers: list[str], rows: list[list[str]]) -> list[int]:
    longest = [max(map(len, (h, *(r[i] for r in rows if i < len(r))))) for i, h in enumerate(headers)]
    return [min(60, max(8, int(n * 1.6 + 2))) for n in longest]


def cells(number: int, values: Iterable[object], style: str = "") -> str:
    body = "".join(f'<c r="{letters(i)}{number}" t="inlineStr"{style}><is><t xml:space="preserve">{safe(v)}</t></is></c>' for i, v in enumerate(values))
    return f'<row r="{number}">{body}</row>'


def sheet_xml(sheet: Sheet, out) -> int:
    """Stream one sheet; returns its rows. The filter's range comes after the data, as the schema wants."""
    rows: Iterator[list[str]] = (["" if v is None else str(v) for v in r] for r in sheet.rows)
    first = list(islice(rows, WIDTH_ROWS))
    cols = "".join(f'<col min="{i}" max="{i}" width="{w}" customWidth="1"/>' for i, w in enumerate(widths(sheet.headers, first), 1))
    view = '<sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" activePane="bottomLeft" state="frozen"/></sheetView>'
    out.write(f'{HEAD}<worksheet xmlns="{MAIN}"><sheetViews>{view}</sheetViews><cols>{cols}</cols><sheetData>{cells(1, sheet.headers, " s=\"1\"")}'.encode())
    n = 0
    for n, row in enumerate(chain(first, rows), 1):
        out.write(cells(n + 1, (row + [""] * len(sheet.headers))[: len(sheet.headers)]).encode())
    out.write(f'</sheetData><autoFilter ref="A1:{letters(len(sheet.headers) - 1)}{n + 1}"/></worksheet>'.encode())
    return n


def write_workbook(path: str, sheets: list[Sheet]) -> list[int]:
    """Write the sheets in order; rows are streamed, so a DataFrame's ``toLocalIterator`` will do."""
    numbers = range(1, len(sheets) + 1)
    parts = {
        "[Content_Types].xml": f'<Types xmlns="{PACKAGE}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="{KIND}.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{KIND}.styles+xml"/>'
        + "".join(f'<Override PartName="/xl/worksheets/sheet{n}.xml" ContentType="{KIND}.worksheet+xml"/>' for n in numbers)
        + "</Types>",
        "_rels/.rels": f'<Relationships xmlns="{PACKAGE}/relationships"><Relationship Id="rId1" Type="{DOCS}/officeDocument" Target="xl/workbook.xml"/></Relationships>',
        "xl/_rels/workbook.xml.rels": f'<Relationships xmlns="{PACKAGE}/relationships">'
        + "".join(f'<Relationship Id="rId{n}" Type="{DOCS}/worksheet" Target="worksheets/sheet{n}.xml"/>' for n in numbers)
        + f'<Relationship Id="rId{len(sheets) + 1}" Type="{DOCS}/styles" Target="styles.xml"/></Relationships>',
        "xl/workbook.xml": f'<workbook xmlns="{MAIN}" xmlns:r="{DOCS}"><sheets>' + "".join(f'<sheet name="{safe(s.name[:31])}" sheetId="{n}" r:id="rId{n}"/>' for n, s in zip(numbers, sheets)) + "</sheets></workbook>",
    }
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as box:
        for name, text in parts.items():
            box.writestr(name, HEAD + text)
        box.writestr("xl/styles.xml", STYLES)
        counts = []
        for n, sheet in zip(numbers, sheets):
            with box.open(f"xl/worksheets/sheet{n}.xml", "w", force_zip64=True) as out:
                counts.append(sheet_xml(sheet, out))
    return counts
