"""Spreadsheets and delimited files."""

from __future__ import annotations

import csv
import io
import re
import zipfile
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat
from typing import IO
from xml.etree import ElementTree

from .base import Extracted, Options, Page, UnsupportedFormat, extension, extracts, one_page, provider
from .numbers import BUILT_IN, shown
from .plain import trim, utf8

_NUMBER = re.compile(r"-?[0-9.,]+\Z")


def looks_like_header(cells: list[str]) -> bool:
    return any(c and not _NUMBER.match(c) for c in cells)


def guessed_delimiter(text: str) -> str:
    """Of comma, tab, pipe and semicolon, the one that splits the first rows into the most, equally many, cells."""

    def value(d: str) -> tuple[float, float]:
        counts = [len(r) for r, _ in zip((r for r in csv.reader(io.StringIO(text), delimiter=d) if any(r)), range(10))]
        mean = sum(counts) / len(counts) if counts else 0
        uneven = sum(abs(a - b) for a, b in zip(counts, counts[1:]))
        return (mean > 1.99, -uneven, mean)

    best = max(",\t|;", key=value)
    return best if value(best)[0] else ","


@extracts("csv")
def delimited(name: str, content: bytes, options: Options) -> Extracted:
    """Rows as ``column: value | ...`` under a header, else with their cells joined."""
    text = utf8(content)
    csv.field_size_limit(1 << 30)
    delimiter = "\t" if extension(name) == ".tsv" else guessed_delimiter(text)
    rows = [r for r in csv.reader(io.StringIO(text, newline=""), delimiter=delimiter) if r and r != [""]]
    if not rows:
        return one_page(text)
    header = [trim(h) for h in rows[0]]
    labelled = looks_like_header(header)
    if labelled:
        lines = [" | ".join(f"{h}: {c}" for h, c in zip(header, r) if c != "") for r in rows[1:]]
    else:
        lines = [trim(" | ".join(r)) for r in rows]
    head = f"[columnas: {', '.join(header)}]\n" if labelled else ""
    return one_page(head + "\n".join(x for x in lines if x))


def _column(ref: str) -> int:
    n = 0
    for c in ref:
        if not c.isalpha():
            break
        n = n * 26 + ord(c.upper()) - 64
    return n - 1


@lru_cache(maxsize=4096)
def _name(tag: str) -> str:
    return tag.rsplit("}", 1)[-1]


def _local(e: ElementTree.Element) -> str:
    return _name(e.tag)


def _attr(e: ElementTree.Element, name: str) -> str | None:
    return next((v for k, v in e.attrib.items() if _name(k) == name), None)


def _formats(styles: bytes) -> list[str]:
    """The format code of each cell style."""
    root = ElementTree.fromstring(styles)
    own = {e.get("numFmtId"): e.get("formatCode") or "General" for e in root.iter() if _local(e) == "numFmt"}
    cells = next((e for e in root.iter() if _local(e) == "cellXfs"), ())
    return [own.get(x.get("numFmtId")) or BUILT_IN.get(int(x.get("numFmtId") or 0), "General") for x in cells]


def _targets(relations: bytes) -> dict[str | None, str | None]:
    return {_attr(r, "Id"): _attr(r, "Target") for r in ElementTree.fromstring(relations)}


_formats_kept, _targets_kept = lru_cache(maxsize=4)(_formats), lru_cache(maxsize=4)(_targets)
#: Books of one program share these parts: small ones are read once.
SHARED = 1 << 16


#: Bytes of a sheet that is parsed as a whole.
SMALL = 1 << 20


def _rows(part: IO[bytes], size: int) -> Iterator[ElementTree.Element]:
    """The rows of a sheet one after another; of one that isn't small what was read is let go."""
    if size <= SMALL:
        yield from (e for e in ElementTree.parse(part).iter() if _local(e) in ("row", "table-row"))
        return
    for _, e in ElementTree.iterparse(part):
        if _local(e) in ("row", "table-row"):
            yield e
            e.clear()


def xlsx_sheets(content: bytes) -> Iterator[tuple[str, Iterator[list[str]]]]:
    """Sheets in order, with their rows as shown."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        names = set(z.namelist())
        part = lambda name: z.read(name) if name in names else None
        shared = []
        if strings := part("xl/sharedStrings.xml"):
            shared = ["".join(t.text or "" for t in si.iter() if _local(t) == "t") for si in ElementTree.fromstring(strings)]
        styles, relations = part("xl/styles.xml"), z.read("xl/_rels/workbook.xml.rels")
        formats = [] if not styles else (_formats_kept if len(styles) <= SHARED else _formats)(styles)
        targets = (_targets_kept if len(relations) <= SHARED else _targets)(relations)
        book = ElementTree.fromstring(z.read("xl/workbook.xml"))
        since_1904 = any(e.get("date1904") in ("1", "true") for e in book.iter() if _local(e) == "workbookPr")

        def value(c: ElementTree.Element) -> str:
            text, kind = "", c.get("t")
            for v in c:
                if _local(v) == "v":
                    text = v.text or ""
                    break
            if kind == "s" and text:
                return shared[int(text)]
            if kind == "inlineStr":
                return "".join(t.text or "" for t in c.iter() if _local(t) == "t")
            if kind == "b":
                return "TRUE" if text == "1" else "FALSE"
            style = int(c.get("s") or 0)
            return shown(text, formats[style] if style < len(formats) else "General", since_1904) if text and kind in (None, "n") else text

        def cells(row: ElementTree.Element) -> list[str]:
            out: list[str] = []
            for c in row:
                ref = c.get("r")
                k = _column(ref) if ref else len(out)
                text = value(c)
                if k == len(out):
                    out.append(text)
                elif k > len(out):
                    out += [*repeat("", k - len(out)), text]
                elif k >= 0:
                    out[k] = text
            return out

        for sheet in (e for e in book.iter() if _local(e) == "sheet"):
            target = targets[_attr(sheet, "id")].lstrip("/")
            with z.open(target if target in names else f"xl/{target}") as f:
                yield sheet.get("name", ""), map(cells, _rows(f, z.getinfo(f.name).file_size))


#: A sheet has no more columns and rows than this; what a file repeats beyond them isn't there.
COLUMNS, ROWS = 16_384, 1_048_576


def ods_sheets(content: bytes, flat: bool = False) -> Iterator[tuple[str, Iterator[list[str]]]]:
    if flat:
        root = ElementTree.fromstring(content)
    else:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            root = ElementTree.fromstring(z.read("content.xml"))

    def cells(row: ElementTree.Element) -> list[str]:
        out: list[str] = []
        blank = 0  # cells that only count if one with text follows
        for c in (c for c in row if _local(c) in ("table-cell", "covered-table-cell")):
            text, times = "\n".join("".join(p.itertext()) for p in c if _local(p) == "p"), int(_attr(c, "number-columns-repeated") or 1)
            if not text:
                blank = min(COLUMNS, blank + times)
                continue
            out += [""] * min(blank, COLUMNS - len(out))
            out += [text] * min(times, COLUMNS - len(out))
            blank = 0
        return out

    def rows(sheet: ElementTree.Element) -> Iterator[list[str]]:
        left = ROWS
        for row in (e for e in sheet.iter() if _local(e) == "table-row"):
            own, times = cells(row), int(_attr(row, "number-rows-repeated") or 1)
            yield from repeat(own, min(left, times) if own else 0)
            left -= min(left, times)

    for sheet in (e for e in root.iter() if _local(e) == "table"):
        yield _attr(sheet, "name") or "", rows(sheet)


@extracts("sheet")
def spreadsheet(name: str, content: bytes, options: Options) -> Extracted:
    """A page per sheet with text: its name, then rows without blank ones."""
    ext = extension(name)
    if ext in (".xlsx", ".xlsm"):
        sheets = xlsx_sheets(content)
    elif ext in (".ods", ".fods"):
        sheets = ods_sheets(content, ext == ".fods")
    elif read := provider("xls"):
        sheets = read(content)
    else:
        raise UnsupportedFormat("no provider for .xls")
    pages: list[Page] = []
    for title, sheet in sheets:
        rows = [r for r in sheet if any(r)]  # blank ones aren't held
        width = max((len(r) for r in rows), default=0)
        text = trim("\n".join(" | ".join(r + [""] * (width - len(r))) for r in rows))
        if text:
            pages.append(Page(len(pages) + 1, f"[hoja: {title}]\n{text}"))
    return Extracted(pages, len(pages) or None)
