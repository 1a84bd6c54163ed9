"""PDF and images, by way of providers, with character recognition for what holds no text."""

from __future__ import annotations

import re

from .base import Extracted, Options, Page, UnsupportedFormat, extension, extracts, provider
from .plain import tidy, trim

LEAST_CHARS_PER_PAGE = 12


def _recognised(images, options: Options) -> list[Page]:
    read = provider("ocr")
    pages = []
    for number, image in enumerate(images, 1):
        try:
            text = tidy(read(image, options.ocr_lang))
        except Exception:  # a page that can't be recognised is skipped
            continue
        if text:
            pages.append(Page(number, text))
    return pages


@extracts("pdf")
def pdf(name: str, content: bytes, options: Options) -> Extracted:
    """Pages with text keep their numbers. With too little text over the whole file, it counts as scanned."""
    read = provider("pdf_text")
    if read is None:
        raise UnsupportedFormat("no provider for .pdf")
    texts, total = read(content, options.max_pages)
    limit = min(total, options.max_pages)
    cleaned = [trim(re.sub("[ \t]+", " ", t)) for t in texts[:limit]]
    if not limit or sum(map(len, cleaned)) / limit >= LEAST_CHARS_PER_PAGE:
        return Extracted([Page(k, t) for k, t in enumerate(cleaned, 1) if t], total)
    pages = []
    if options.ocr and provider("ocr") and provider("pdf_images"):
        try:
            pages = _recognised(provider("pdf_images")(content, options.ocr_dpi, min(limit, options.ocr_max_pages)), options)
        except Exception:
            pages = []
    return Extracted(pages, total, sin_ocr=not pages)


@extracts("image")
def image(name: str, content: bytes, options: Options) -> Extracted:
    pages = []
    if options.ocr and provider("ocr"):
        try:
            if extension(name) in (".heic", ".heif"):
                content = provider("heic")(content)
            pages = _recognised([content], options)
        except Exception:
            pages = []
    return Extracted(pages, 1, sin_ocr=not pages)
