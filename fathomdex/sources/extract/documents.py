"""Plain text, HTML, RTF, and word-processor and presentation files."""

from __future__ import annotations

import io
import re
import zipfile
from xml.etree import ElementTree

from .base import Extracted, Options, Page, extension, extracts, one_page, provider
from .plain import html_to_text, joined_chat, office_xml_to_text, tidy, trim, unit, utf8

_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


@extracts("text")
def plain(name: str, content: bytes, options: Options) -> Extracted:
    text = utf8(content)
    return one_page(joined_chat(text) or text)


@extracts("html")
def html(name: str, content: bytes, options: Options) -> Extracted:
    return one_page(html_to_text(utf8(content)))


@extracts("docx")
def docx(name: str, content: bytes, options: Options) -> Extracted:
    """Each paragraph, followed by a blank line."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    paragraphs = []
    for p in root.iter(f"{_W}p"):
        runs = {f"{_W}t": lambda e: e.text or "", f"{_W}tab": lambda e: "\t", f"{_W}br": lambda e: "\n", f"{_W}cr": lambda e: "\n"}
        paragraphs.append("".join(runs[e.tag](e) for e in p.iter() if e.tag in runs))
    return one_page("".join(f"{p}\n\n" for p in paragraphs).replace("\r\n", "\n"))


@extracts("office")
def office(name: str, content: bytes, options: Options) -> Extracted:
    """Presentations have a page per part with text, notes before slides; other files are one text."""
    slides = extension(name) == ".pptx"
    wanted = re.compile(r"ppt/slides/slide\d+\.xml|ppt/notesSlides/notesSlide\d+\.xml" if slides else r"(?:.*/)?content\.xml", re.I)
    pages: list[Page] = []
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        parts = [i for i in z.infolist() if not i.is_dir() and wanted.fullmatch(i.filename)]
        parts.sort(key=lambda i: [(0, int(x), "") if x.isdigit() else (1, 0, x.lower()) for x in re.findall(r"\d+|\D+", i.filename)])
        for part in parts:
            text = office_xml_to_text(utf8(z.read(part)))
            if text:
                pages.append(Page(len(pages) + 1 if slides else None, text))
    return Extracted(pages, len(pages) if slides else None)


# RTF destinations that hold no text of the document.
_NO_TEXT = frozenset(
    "pict bin object fonttbl colortbl stylesheet info header footer headerl headerr footerl footerr themedata datastore latentstyles listtable listoverridetable rsidtbl".split()
)
_BREAKS = {"par": "\n", "line": "\n", "sect": "\n", "row": "\n", "tab": "\t", "cell": "\t"}
_RTF = re.compile(r"\\([a-zA-Z]+)(-?\d+)? ?|\\'([0-9a-fA-F]{2})|\\([^a-zA-Z'])|([{}])|([\r\n]+)|([^\\{}\r\n]+)|(\\)")


def rtf_to_text(rtf: str) -> str:
    """The text outside of destinations such as pictures and font tables.

    A destination word, or ``\\*``, silences the group that it stands in. Unicode
    characters are followed by as many replacement characters as ``\\uc`` says.
    """
    out: list[str] = []
    groups = [(False, 1)]  # silent, replacements to skip
    skip = 0
    for m in _RTF.finditer(rtf):
        word, number, code, sign, brace, newline, text, _ = m.groups()
        silent, replacements = groups[-1]
        if brace == "{":
            groups.append((silent, replacements))
            skip = 0
        elif brace == "}":
            skip = 0
            if len(groups) > 1:
                groups.pop()
        elif newline:
            continue
        elif skip and (code or sign or text):
            if text:
                taken, skip = min(skip, len(text)), max(0, skip - len(text))
                if text[taken:] and not silent:
                    out.append(text[taken:])
            else:
                skip -= 1
        elif word == "u" and number:
            if not silent:
                out.append(unit(int(number)))
            skip = replacements
        elif word == "uc":
            groups[-1] = (silent, max(0, int(number or 0)))
        elif word in _NO_TEXT or sign == "*":
            groups[-1] = (True, replacements)
        elif not silent:
            if word in _BREAKS:
                out.append(_BREAKS[word])
            elif code:
                out.append(bytes.fromhex(code).decode("latin-1"))
            elif sign and sign in "\\{}":
                out.append(sign)
            elif text:
                out.append(text)
    return tidy("".join(out))


@extracts("rtf")
def rtf(name: str, content: bytes, options: Options) -> Extracted:
    if encapsulated := provider("rtf"):
        text = encapsulated(content)
        if trim(text or ""):
            return one_page(text.replace("\r\n", "\n"))
    return one_page(rtf_to_text(content.decode("latin-1")))


