import os
import zipfile

from levelling.sources.delimited import read_points
from levelling.sources.workbook import sheet_rows

CT = """<?xml version="1.0" encoding="UTF-8"?>
<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types">
<Default Extension="xml" ContentType="application/xml"/></Types>"""
WB = """<?xml version="1.0" encoding="UTF-8"?>
<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"
 xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships">
<sheets><sheet name="Arkusz1" sheetId="1" r:id="rId1"/></sheets></workbook>"""
RELS = """<?xml version="1.0" encoding="UTF-8"?>
<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">
<Relationship Id="rId1" Type="worksheet" Target="worksheets/sheet1.xml"/></Relationships>"""
SST = """<?xml version="1.0" encoding="UTF-8"?>
<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><si><t>nr</t></si><si><t>x</t></si>
<si><t>y</t></si><si><t>h</t></si><si><t>P1</t></si></sst>"""
SHEET = """<?xml version="1.0" encoding="UTF-8"?>
<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>
<row r="1"><c r="A1" t="s"><v>0</v></c><c r="B1" t="s"><v>1</v></c><c r="C1" t="s"><v>2</v></c><c r="D1" t="s"><v>3</v></c></row>
<row r="2"><c r="A2" t="s"><v>4</v></c><c r="B2"><v>5958143.5</v></c><c r="C2"><v>7466893.08</v></c><c r="D2"><v>137.9</v></c></row>
<row r="3"><c r="A3"><v>1002</v></c><c r="B3"><v>5955909.72</v></c><c r="C3"><v>7466350.05</v></c><c r="D3"><v>138.82</v></c></row>
</sheetData></worksheet>"""


def make_xlsx(path):
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("[Content_Types].xml", CT)
        z.writestr("xl/workbook.xml", WB)
        z.writestr("xl/_rels/workbook.xml.rels", RELS)
        z.writestr("xl/sharedStrings.xml", SST)
        z.writestr("xl/worksheets/sheet1.xml", SHEET)


def test_sheet_rows(tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "w.xlsx")
    make_xlsx(p)
    rows = sheet_rows(open(p, "rb").read())
    assert rows[0] == ["nr", "x", "y", "h"] and rows[2][0] == "1002"


def test_workbook_points(spark, tmpdir_fresh):
    p = os.path.join(tmpdir_fresh, "w.xlsx")
    make_xlsx(p)
    got = read_points(spark, p).orderBy("row_no").collect()
    assert [(r["id"], r["x"], r["y"], r["h"]) for r in got] == [
        ("P1", 5958143.5, 7466893.08, 137.9), ("1002", 5955909.72, 7466350.05, 138.82)]
