"""What extractors return, the choice by extension, and providers for formats that need a library."""

from __future__ import annotations

import os
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from typing import NamedTuple

from ...functions.paths import FAMILY_OF


class Page(NamedTuple):
    page: int | None
    text: str


@dataclass
class Extracted:
    pages: list[Page] = field(default_factory=list)
    num_pages: int | None = None
    sin_ocr: bool = False


@dataclass(frozen=True)
class Options:
    max_pages: int = 100_000
    depth: int = 0
    ocr: bool = True
    ocr_lang: str = "spa"
    ocr_dpi: int = 200
    ocr_max_pages: int = 5000
    archive_members: int = 2000
    archive_bytes: int = 500 * 1024 * 1024

    def deeper(self) -> "Options":
        return replace(self, depth=self.depth + 1)


class UnsupportedFormat(ValueError):
    pass


Extractor = Callable[[str, bytes, Options], Extracted]
_EXTRACTORS: dict[str, Extractor] = {}
_PROVIDERS: dict[str, Callable] = {}


def extracts(*families: str) -> Callable[[Extractor], Extractor]:
    def put(f: Extractor) -> Extractor:
        _EXTRACTORS.update(dict.fromkeys(families, f))
        return f

    return put


def register_provider(kind: str, provide: Callable) -> None:
    """Adds what a format needs beyond the standard library.

    pdf_text(content, max_pages) -> (texts of the pages, number of pages);
    pdf_images(content, dpi, max_pages) -> images; ocr(image, lang) -> text;
    heic(content) -> image; msg(content) -> Message; xls(content) -> [(sheet, rows)];
    rar(content), 7z(content) -> iterator of (name, content);
    rtf(content) -> text of encapsulated messages, empty if it isn't one.
    """
    _PROVIDERS[kind] = provide


def provider(kind: str) -> Callable | None:
    return _PROVIDERS.get(kind)


def extension(name: str) -> str:
    return os.path.splitext(name.rsplit("/", 1)[-1])[1].lower()


def extract(name: str, content: bytes, options: Options = Options()) -> Extracted:
    """The pages of a file by its name's extension; members of archives and attachments come here too, one deeper."""
    from . import documents, mail_and_archives, scanned, sheets  # noqa: F401  registers all extractors

    family = FAMILY_OF.get(extension(name))
    if family is None:
        raise UnsupportedFormat(f"unsupported format: {extension(name)}")
    return _EXTRACTORS[family](name, content, options)


def one_page(text: str | None) -> Extracted:
    from .plain import trim

    trimmed = trim(text or "")
    return Extracted([Page(None, trimmed)] if trimmed else [])
