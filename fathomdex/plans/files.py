"""Files made from table rows, for queries that run the extractors over them."""

from __future__ import annotations

import csv
import io
import zipfile
from collections.abc import Callable, Iterator
from email.message import EmailMessage
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame

from ..sources.extract import Options, extract

Maker = Callable[[dict], tuple[str, bytes]]
#: Rows of a batch that are Python objects at a time, and characters of pages that are held before they are handed on.
ROWS, HELD = 16, 1 << 20


def _rows(batch: pa.RecordBatch) -> Iterator[dict]:
    for k in range(0, batch.num_rows, ROWS):
        yield from batch.slice(k, ROWS).to_pylist()


def _pages(batches: Iterator[pa.RecordBatch], key: str, make: Maker, options: Options) -> Iterator[pa.RecordBatch]:
    """However many rows a batch has, no more than ``HELD`` characters and a file's pages are held."""
    kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
    names = [key, "seq", "page", "texto"]
    for batch in batches:
        found, size = [], 0
        for row in _rows(batch):
            pages = [(row[key], seq, *page) for seq, page in enumerate(extract(*make(row), options).pages)]
            found += pages
            size += sum(len(p[-1]) for p in pages)
            if size >= HELD:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)
                found, size = [], 0
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*found), kinds)], names=names)


def extracted(rows: DataFrame, key: str, make: Maker, options: Options = Options()) -> DataFrame:
    """(key, seq, page, texto): the pages of the file that ``make`` makes of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        return _pages(batches, key, make, options)

    return rows.mapInArrow(run, f"{key} long, seq int, page int, texto string")


def zipped(parts: dict[str, str | bytes]) -> bytes:
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, content in parts.items():
            z.writestr(name, content)
    return out.getvalue()


def docx(texts: list[str]) -> bytes:
    """A paragraph for each text."""
    body = "".join(f'<w:p><w:r><w:t xml:space="preserve">{escape(t)}</w:t></w:r></w:p>' for t in texts)
    return zipped({"word/document.xml": f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{body}</w:body></w:document>'})


def pptx(texts: list[str]) -> bytes:
    """A slide for each text."""
    return zipped({f"ppt/slides/slide{k}.xml": f"<p:sld><a:p><a:r><a:t>{escape(t)}</a:t></a:r></a:p></p:sld>" for k, t in enumerate(texts, 1)})


def delimited(rows: list[list[str]]) -> bytes:
    out = io.StringIO()
    csv.writer(out).writerows(rows)
    return out.getvalue().encode()


def xlsx(title: str, rows: list[list], codes: list[str]) -> bytes:
    """One sheet; each column of numbers has a format code."""
    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    own = "".join(f'<numFmt numFmtId="{200 + k}" formatCode="{escape(c)}"/>' for k, c in enumerate(codes))
    styles = f'<numFmts>{own}</numFmts><cellXfs>{"".join(f"<xf numFmtId={chr(34)}{200 + k}{chr(34)}/>" for k in range(len(codes)))}</cellXfs>'
    data = "".join("<row>" + "".join(f'<c s="{k}"><v>{v!r}</v></c>' for k, v in enumerate(row)) + "</row>" for row in rows)
    return zipped({
        "xl/workbook.xml": f'<workbook {ns}><sheets><sheet name="{escape(title)}" sheetId="1" r:id="r1"/></sheets></workbook>',
        "xl/_rels/workbook.xml.rels": '<Relationships><Relationship Id="r1" Target="worksheets/sheet1.xml"/></Relationships>',
        "xl/styles.xml": f"<styleSheet {ns}>{styles}</styleSheet>", "xl/worksheets/sheet1.xml": f"<worksheet {ns}><sheetData>{data}</sheetData></worksheet>",
    })


def fods(title: str, rows: list[list[str]]) -> bytes:
    cells = lambda row: "".join(f"<table:table-cell><text:p>{escape(c)}</text:p></table:table-cell>" for c in row)
    body = "".join(f"<table:table-row>{cells(row)}</table:table-row>" for row in rows)
    return f'<o xmlns:table="t" xmlns:text="x"><table:table table:name="{escape(title)}">{body}</table:table></o>'.encode()


def eml(subject: str, body: str, attached: dict[str, str]) -> bytes:
    m = EmailMessage()
    m["Subject"], m["From"], m["To"] = subject, "a@example.org", "b@example.org"
    m.set_content(body, cte="base64")
    for name, text in attached.items():
        m.add_attachment(text.encode(), maintype="application", subtype="octet-stream", filename=name)
    return bytes(m)


def rtf(text: str) -> bytes:
    """Letters beyond ASCII as their UTF-16 units, line ends as paragraphs."""
    units = memoryview(text.encode("utf-16-le")).cast("H")
    signs = {ord("\\"): r"\\", ord("{"): r"\{", ord("}"): r"\}", ord("\n"): r"\par "}
    body = "".join(signs.get(u) or (chr(u) if u < 128 else rf"\u{u - 65536 * (u > 32767)}?") for u in units)
    return f"{{\\rtf1{{\\fonttbl{{\\f0 Arial;}}}} {body}}}".encode()
