import io
import zipfile

import pytest

from keyloom.errors import MergeInputError
from keyloom.plans.run import read_all
from keyloom.sources.datasource import register
from keyloom.sources.grids import html_table, read_grid, sniff
from keyloom.sources.reader import ROW, read_csv, read_table

HTML = "<html><table><tr><th colspan=2>姓名信息</th><th>部门</th></tr><tr><td>&nbsp;李四&nbsp;</td><td>x<br>y</td><td>设计部</td></tr><tr><td>张三<td>z<td>产品部<script>var a='<table><tr><td>no</td></tr></table>'</script></table><table><tr><td>2nd</td></tr></table>"
SML = """<?xml version="1.0"?><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet" xmlns:ss="urn:schemas-microsoft-com:office:spreadsheet"><Worksheet ss:Name="表1"><Table>
<Row><Cell><Data ss:Type="String">姓名</Data></Cell><Cell ss:Index="3"><Data ss:Type="String">工号</Data></Cell></Row>
<Row><Cell><Data ss:Type="String">张三</Data></Cell><Cell ss:Index="3"><Data ss:Type="Number">1001</Data></Cell></Row></Table></Worksheet></Workbook>"""
ODS = """<office:document-content xmlns:office="urn:oasis:names:tc:opendocument:xmlns:office:1.0" xmlns:table="urn:oasis:names:tc:opendocument:xmlns:table:1.0" xmlns:text="urn:oasis:names:tc:opendocument:xmlns:text:1.0"><office:body><office:spreadsheet><table:table table:name="S">
<table:table-row><table:table-cell office:value-type="string"><text:p>姓名</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>联系方式</text:p></table:table-cell><table:table-cell office:value-type="string"><text:p>部门</text:p></table:table-cell><table:table-cell table:number-columns-repeated="20"/></table:table-row>
<table:table-row><table:table-cell><text:p>王<text:s text:c="1"/>五</text:p></table:table-cell><table:table-cell office:value-type="float" office:value="13800000001"/><table:table-cell office:value-type="date" office:date-value="2024-03-01"/></table:table-row>
<table:table-row><table:table-cell office:value-type="boolean" office:boolean-value="true"/><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell/></table:table-row>
<table:table-row table:number-rows-repeated="1000"><table:table-cell table:number-columns-repeated="20"/></table:table-row></table:table></office:spreadsheet></office:body></office:document-content>"""


def boxed(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as box:
        for name, text in members.items():
            box.writestr(name, text)
    return out.getvalue()


def xlsx(sheet, shared=""):
    main = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    return boxed(
        **{
            "xl/workbook.xml": f'<workbook {main}><sheets><sheet name="图" sheetId="2" r:id="r2"/><sheet name="数据" sheetId="1" r:id="r1"/></sheets></workbook>',
            "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="chartsheets/sheet1.xml"/></Relationships>',
            "xl/sharedStrings.xml": f"<sst {main}>{shared}</sst>",
            "xl/worksheets/sheet1.xml": f"<worksheet {main}><sheetData>{sheet}</sheetData></worksheet>",
        }
    )


def test_delimited():
    assert read_grid("a.tsv", "姓名\t手机\n张三\t13800000001\n".encode())[1] == {"format": "delimited", "encoding": "utf-8-sig", "delimiter": "\t"}
    assert read_grid("a.txt", "姓名;部门\n李四;设计部\n".encode())[1]["delimiter"] == ";"
    assert read_grid("a.csv", "姓名,部门\n李四,设计部\n\n".encode("gb18030"))[0] == [["姓名", "部门"], ["李四", "设计部"]]


@pytest.mark.parametrize("pad", [0, 1, 2])
def test_a_character_cut_at_the_probe(pad):
    text = "x" * pad + "姓名,部门\n" + "李四,设计部\n" * 2000
    assert sniff("a.csv", text.encode()) == "delimited"
    assert len(read_grid("a.csv", text.encode())[0]) == 2001


def test_html():
    rows, info = read_grid("a.xls", HTML.encode())
    assert info["format"] == "html"
    assert rows == [["姓名信息", "", "部门"], ["李四", "xy", "设计部"], ["张三", "z", "产品部"]]


def test_nested_and_unclosed_tables():
    rows, _ = read_grid("a.xls", b"<table><tr><td>a<table><tr><td>in</table>b<td>c<tr><td>d")
    assert rows == [["a", "c"], ["d"]] or rows == [["ab", "c"], ["d"]]


@pytest.mark.parametrize(
    "page,rows",
    [
        ("<p>x</p><table><td>no row<tr><td>a<th>b</tr><td>after</table>", [["a", "b"]]),
        ("<table><tr></tr><tr><td></td></tr><tr><td colspan=99>w</td><td colspan=x>v</table>", [[""], ["w", *[""] * 63, "v"]]),
        ("<table><tr><td>a</td>loose<td>b</table></table><table><tr><td>2nd</table>", [["a", "b"]]),
        ("</table><table><tr><td>a<style>p{}</style>&amp;<br>b", [["a&b"]]),
        ("<table></table><table><tr><td>2nd</table>", []),
    ],
)
def test_odd_html(page, rows):
    assert html_table("a.xls", page.encode())[0] == rows


def test_rows_are_never_cut():
    row = '<table:table-row table:number-rows-repeated="{}"><table:table-cell><text:p>{}</text:p></table:table-cell></table:table-row>'
    head, tail = ODS[: ODS.index("<table:table-row")], "</table:table></office:spreadsheet></office:body></office:document-content>"
    many = head + row.format(150_000, "a") + row.format(100_500, "b") + row.format(1, "c") + tail
    rows, _ = read_grid("a.ods", boxed(**{"content.xml": many}))
    assert (len(rows), rows[149_999], rows[150_000], rows[-1]) == (250_501, ["a"], ["b"], ["c"])
    with pytest.raises(MergeInputError, match="拒绝读取"):
        read_grid("a.ods", boxed(**{"content.xml": head + row.format(1 << 21, "a") + tail}))


def test_spreadsheetml():
    assert read_grid("a.xls", SML.encode())[0] == [["姓名", "", "工号"], ["张三", "", "1001"]]


def test_ods():
    rows, info = read_grid("a.ods", boxed(**{"content.xml": ODS}))
    assert rows == [["姓名", "联系方式", "部门"], ["王 五", "13800000001", "2024-03-01"], ["TRUE", "a"]]
    assert info["sheet"] == "S"


def test_xlsx():
    cells = '<row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>部门</t></is></c></row><row r="3"><c r="A3"><v>13800000001</v></c><c r="B3" t="b"><v>1</v></c><c r="C3"><v>1.5</v></c><c r="D3" t="e"><v>#N/A</v></c></row>'
    rows, info = read_grid("a.xlsx", xlsx(cells, "<si><r><t>姓</t></r><r><t>名</t></r></si>"))
    assert rows == [["姓名", "", "部门", ""], ["13800000001", "TRUE", "1.5", ""]]
    assert info == {"format": "xlsx/xlsm", "sheet": "数据"}


@pytest.mark.parametrize(
    "name,raw,said",
    [
        ("a.xls", bytes.fromhex("d0cf11e0a1b11ae1") + bytes(1024), "另存为"),
        ("a.xls", b'<?xml version="1.0"?><!DOCTYPE x [<!ENTITY a "b">]><Workbook xmlns="urn:schemas-microsoft-com:office:spreadsheet"/>', "拒绝解析"),
        ("a.pdf", b"a,b\n1,2", "改回正确扩展名"),
        ("a.ods", boxed(other="x"), "content.xml"),
        ("a.xlsx", b"PK\x03\x04broken", "损坏"),
    ],
)
def test_refused(name, raw, said):
    with pytest.raises(MergeInputError, match=said):
        read_grid(name, raw)


def test_read_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("报表,,\n姓名,手机,,手机\n张三,1,,x\n李四,,,\n", "utf-8")
    t = read_table(spark, str(tmp_path / "a.csv"))
    assert t.info.headers == ["姓名", "手机", "手机（2）"]
    assert (t.info.n_rows, t.info.header_row, t.info.encoding) == (2, 2, "utf-8-sig")
    assert [tuple(r) for r in t.df.orderBy(ROW).collect()] == [("张三", "1", "x", 0), ("李四", "", "", 1)]
    with pytest.raises(MergeInputError, match="不存在"):
        read_table(spark, str(tmp_path / "none.csv"))
    (tmp_path / "b.csv").write_text("\n\n")
    with pytest.raises(MergeInputError, match="没有可读取"):
        read_table(spark, str(tmp_path / "b.csv"))
    with pytest.raises(MergeInputError, match="重复"):
        read_all(spark, [str(tmp_path / "a.csv")] * 2)


def test_data_source_and_native_csv(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text("姓名,手机\n张三,1\n李四,\n", "utf-8")
    register(spark)
    got = spark.read.format("officetable").load(str(path)).collect()
    assert [tuple(r) for r in got] == [("张三", "1", 0), ("李四", "", 1)]
    assert [r["姓名"] for r in read_csv(spark, str(path)).df.orderBy(ROW).collect()] == ["张三", "李四"]
