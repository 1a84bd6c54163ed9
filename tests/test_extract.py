"""Extractors over small files made here."""

import io
import zipfile

import pytest

from fathomdex.sources.extract import Options, Page, UnsupportedFormat, extract, register_provider
from fathomdex.sources.extract import base
from fathomdex.sources.extract.documents import rtf_to_text
from fathomdex.sources.extract.mail_and_archives import Message


def zipped(**members):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, content in members.items():
            z.writestr(name, content)
    return out.getvalue()


def texts(name, content, options=Options()):
    return [tuple(p) for p in extract(name, content, options).pages]


@pytest.fixture
def providers():
    before = dict(base._PROVIDERS)
    yield
    base._PROVIDERS.clear()
    base._PROVIDERS.update(before)


def test_plain_html_and_unknown():
    assert texts("a.TXT", b"\xff x ") == [(None, "� x")]
    assert texts("a.md", b"  ") == []
    assert texts("a.htm", b"<p>x</p>y") == [(None, "x\ny")]
    with pytest.raises(UnsupportedFormat):
        extract("a.exe", b"")


@pytest.mark.parametrize(
    "rtf, want",
    [
        (r"{\rtf1 a\'e1\par b}", "aá\nb"),
        (r"{\rtf1 \u225?x\u-10179?\u-8704?}", "áx��"),
        ("{" + chr(92) + "rtf1" + chr(92) + "uc0 " + chr(92) + "u8364 y}", "€y"),
        (r"{\rtf1{\*\gen x}{\pict 89ab}{\fonttbl{\f0 Arial;}}t}", "t"),
        (r"{\rtf1 a\{b\}\\c\tab d}", "a{b}\\c d"),
    ],
)
def test_rtf(rtf, want):
    assert rtf_to_text(rtf) == want


def test_docx():
    xml = '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body><w:p><w:r><w:t>a</w:t><w:tab/><w:t>b</w:t></w:r></w:p><w:p><w:r><w:t>c</w:t></w:r></w:p></w:body></w:document>'
    assert texts("a.docx", zipped(**{"word/document.xml": xml})) == [(None, "a\tb\n\nc")]


def test_presentations_number_notes_first():
    slide = "<a:p><a:t>{}</a:t></a:p>"
    parts = {"ppt/slides/slide10.xml": slide.format("ten"), "ppt/slides/slide2.xml": slide.format("two"), "ppt/notesSlides/notesSlide1.xml": slide.format("note"), "ppt/slides/slide1.xml": "<a/>"}
    assert texts("a.pptx", zipped(**parts)) == [(1, "note"), (2, "two"), (3, "ten")]
    assert texts("a.odt", zipped(**{"content.xml": "<text:p>x</text:p>"})) == [(None, "x")]


def test_csv():
    assert texts("a.csv", b"name,n\nx,1\n\ny,\n") == [(None, "[columnas: name, n]\nname: x | n: 1\nname: y")]
    assert texts("a.csv", b"1;2\n3;4\n") == [(None, "1 | 2\n3 | 4")]
    assert texts("a.tsv", b"a\tb\n") == [(None, "[columnas: a, b]")]
    assert texts("a.csv", b"") == []


def test_xlsx_and_ods():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = zipped(**{
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="E" sheetId="2" r:id="r2"/><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>',
        "xl/sharedStrings.xml": f"<sst {ns}><si><t>hi</t></si></sst>",
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1"><v>5</v></c></row><row r="2"/><row r="3"><c r="B3" t="inlineStr"><is><t>z</t></is></c></row></sheetData></worksheet>',
        "xl/worksheets/sheet2.xml": f"<worksheet {ns}><sheetData/></worksheet>",
    })
    assert texts("a.xlsx", book) == [(1, "[hoja: S]\nhi |  | 5\n | z |")]
    ods = '<o xmlns:table="t" xmlns:text="x"><table:table table:name="T"><table:table-row><table:table-cell><text:p>a</text:p></table:table-cell><table:table-cell table:number-columns-repeated="2"><text:p>b</text:p></table:table-cell></table:table-row></table:table></o>'
    assert texts("a.fods", ods.encode()) == [(1, "[hoja: T]\na | b | b")]
    with pytest.raises(UnsupportedFormat):
        extract("a.xls", b"")


EML = b"""From: A <a@x.org>\r\nTo: b@x.org\r\nSubject: Hi\r\nDate: Tue, 12 Mar 2024 09:41:03 +0100\r\nMIME-Version: 1.0\r\nContent-Type: multipart/mixed; boundary=q\r\n\r\n--q\r\nContent-Type: text/plain\r\n\r\nbody\r\n--q\r\nContent-Type: text/plain\r\nContent-Disposition: attachment; filename=n.txt\r\n\r\nnote\r\n--q\r\nContent-Type: application/octet-stream\r\nContent-Disposition: attachment; filename=n.exe\r\n\r\nxx\r\n--q--\r\n"""


def test_mail():
    got = texts("m.eml", EML)
    assert got[0] == (None, "Asunto: Hi\nDe: A <a@x.org>\nPara: b@x.org\nFecha: 2024-03-12T08:41:03.000Z\n\nbody")
    assert got[1:] == [(None, "[adjunto: n.txt]"), (None, "note")]
    assert texts("z.zip", zipped(**{"m.eml": EML}))[-1] == (None, "[adjuntos: n.txt, n.exe]")


def test_archives():
    inner = zipped(**{"x.txt": "x"})
    z = zipped(**{"a.txt": "A", "b.exe": "B", "c.zip": inner, "d.html": "<p>D</p>", "e.docx": "broken"})
    assert texts("z.zip", z) == [(None, "[archivo: a.txt]"), (None, "A"), (None, "[archivo: d.html]"), (None, "D")]
    assert texts("z.zip", z, Options(archive_members=1)) == [(None, "[archivo: a.txt]"), (None, "A")]
    assert texts("z.zip", z, Options(archive_bytes=1)) == [(None, "[archivo: a.txt]"), (None, "A")]
    broken = extract("z.zip", b"no zip")
    assert broken.pages == [] and not broken.sin_ocr
    assert extract("z.zip", zipped(**{"b.exe": "B"})).sin_ocr


def test_providers(providers):
    assert extract("a.png", b"").sin_ocr
    with pytest.raises(UnsupportedFormat):
        extract("a.pdf", b"")
    register_provider("pdf_text", lambda c, most: (["some  text that is long", "", "x"], 3))
    assert extract("a.pdf", b"").num_pages == 3 and texts("a.pdf", b"") == []
    register_provider("pdf_text", lambda c, most: (["some  text that is long enough for all pages", "", "x"], 3))
    assert texts("a.pdf", b"") == [(1, "some text that is long enough for all pages"), (3, "x")]
    register_provider("pdf_text", lambda c, most: ([""], 1))
    assert extract("a.pdf", b"").sin_ocr
    register_provider("pdf_images", lambda c, dpi, most: [b"1", b"2"])
    register_provider("ocr", lambda image, lang: "  seen \t it" if image == b"2" else "")
    assert texts("a.pdf", b"") == [(2, "seen it")]
    assert texts("a.jpg", b"2") == [(1, "seen it")]
    assert extract("a.jpg", b"2", Options(ocr=False)).sin_ocr
    register_provider("msg", lambda c: Message([("Asunto", "s")], "b", [("t.txt", b"T")]))
    assert texts("m.msg", b"") == [(None, "Asunto: s\n\nb"), (None, "[adjunto: t.txt]"), (None, "T")]
    register_provider("rar", lambda c: iter([("r.txt", b"R")]))
    assert texts("r.rar", b"") == [(None, "[archivo: r.txt]"), (None, "R")]
    assert Page(None, "x") == (None, "x")


@pytest.mark.parametrize(
    "value, code, want",
    [
        ("45000", "m/d/yy", "3/15/23"), ("45000.5", "yyyy-mm-dd hh:mm", "2023-03-15 12:00"), ("45000.75", "d mmm yyyy h:mm AM/PM", "15 Mar 2023 6:00 PM"), ("0.5", "0%", "50%"), ("0.1234", "0.00%", "12.34%"),
        ("1234567.891", "#,##0.00", "1,234,567.89"), ("-5", "#,##0;(#,##0)", "(5)"), ("1234.5", "General", "1234.5"), ("7", "000", "007"), ("3.14159", "0.##", "3.14"), ("12", '0.00" €"', "12.00 €"), ("2.5", "0", "3"),
        ("1.25", "[h]:mm:ss", "30:00:00"), ("0.52", "mm:ss", "28:48"), ("abc", "0.00", "abc"), ("1500", "0.0,", "1.5"), ("12345", "0.00E+00", "1.23E+04"), ("0", '0;-0;"none"', "none"), ("45000", "dddd dd/mm", "Wednesday 15/03"),
    ],
)
def test_numbers_as_shown(value, code, want):
    from fathomdex.sources.extract.numbers import shown

    assert shown(value, code) == want


def test_xlsx_styles_and_ods_repeats():
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    book = zipped(**{
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="S" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f'<styleSheet {ns}><numFmts><numFmt numFmtId="164" formatCode="dd/mm/yyyy"/></numFmts><cellXfs><xf numFmtId="0"/><xf numFmtId="164"/><xf numFmtId="9"/></cellXfs></styleSheet>',
        "xl/worksheets/sheet1.xml": f'<worksheet {ns}><sheetData><row r="1"><c r="A1" s="1"><v>45000</v></c><c r="B1" s="2"><v>0.5</v></c><c r="C1"><v>5</v></c></row></sheetData></worksheet>',
    })
    assert texts("a.xlsx", book) == [(1, "[hoja: S]\n15/03/2023 | 50% | 5")]
    ods = '<o xmlns:table="t" xmlns:text="x"><table:table table:name="T"><table:table-row table:number-rows-repeated="2"><table:table-cell table:number-columns-repeated="2"/><table:table-cell><text:p>b</text:p></table:table-cell><table:table-cell table:number-columns-repeated="900000000"/></table:table-row><table:table-row table:number-rows-repeated="900000000"><table:table-cell table:number-columns-repeated="900000000"/></table:table-row></table:table></o>'
    assert texts("a.fods", ods.encode()) == [(1, "[hoja: T]\n|  | b\n |  | b")]


def test_extraction_holds_few_pages():
    """A batch's pages are handed on as they come, and an RTF file's tokens aren't held."""
    import tracemalloc

    import pyarrow as pa

    from fathomdex.plans import files

    made = []
    make = lambda r: made.append(r["k"]) or (("x.txt", r["text"].encode()) if r["k"] % 2 else ("x.txt", b" "))
    batch = pa.RecordBatch.from_pydict({"k": list(range(400)), "text": ["x" * 40_000] * 400})
    found = files._pages(iter([batch, batch.slice(0, 0), batch.slice(0, 2)]), "k", make, Options())
    first = next(found)
    assert first.num_rows * 40_000 < 2 * files.HELD and len(made) <= 2 * first.num_rows + 1
    rest = [first, *found]
    assert sum(b.num_rows for b in rest) == 201 and all(b.num_rows for b in rest)
    assert [k for b in rest for k in b["k"].to_pylist()] == [*range(1, 400, 2), 1]

    rtf = "{" + r"\rtf1 " + r"a\par " * 100_000 + "}"
    tracemalloc.start()
    try:
        assert rtf_to_text(rtf).count("\n") == 99_999
        assert tracemalloc.get_traced_memory()[1] < 8 * len(rtf)
    finally:
        tracemalloc.stop()


def test_sheets_are_read_alike_whole_or_by_rows(monkeypatch):
    """A small sheet is parsed whole; codes are taken apart once, however many cells have them."""
    from fathomdex.plans import files
    from fathomdex.sources.extract import numbers, sheets

    rows = [[k, k / 7, 40_000 + k] for k in range(300)]
    book = files.xlsx("S", rows, ["General", "#,##0.00;(0.0)", "yyyy-mm-dd"])
    read = []
    pieces = numbers._PIECE
    monkeypatch.setattr(numbers, "_PIECE", type("P", (), {"finditer": staticmethod(lambda code: read.append(code) or pieces.finditer(code))}))
    whole = texts("a.xlsx", book)
    assert len(read) < 10
    assert whole[0][1].split("\n")[8] == "7 | 1.00 | 2009-07-13"
    monkeypatch.setattr(sheets, "SMALL", 0)
    assert texts("a.xlsx", book) == whole
