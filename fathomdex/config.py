"""Settings, and the watched folders (roots)."""

from __future__ import annotations

import json
import os
import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from typing import NamedTuple

PREFIX = "FATHOMDEX_"


class Root(NamedTuple):
    name: str
    path: str


def positive(value: str | None, default: int) -> int:
    """The leading integer of a setting if it is above zero, else the default."""
    found = re.match(r"\s*[+-]?\d+", value or "")
    number = int(found[0]) if found else 0
    return number if number > 0 else default


def parse_folders(several: str | None, single: str | None = None) -> list[str]:
    """A JSON array, or paths separated by newlines, semicolons or commas; else the single folder."""
    if several:
        listed = several.strip()
        if listed.startswith("["):
            try:
                parts = json.loads(listed)
            except ValueError:
                parts = []
        else:
            parts = re.split(r"[\n;,]+", listed)
    else:
        parts = [single] if single else []
    return [p for p in (str(x).strip() for x in parts) if p]


def build_roots(paths: Sequence[str]) -> list[Root]:
    """A root per folder, named by its base name; repeats get -2, -3, ..."""
    roots, used = [], {}
    for path in map(os.path.abspath, paths):
        name = os.path.basename(path) or path
        used[name] = used.get(name, 0) + 1
        roots.append(Root(name if used[name] == 1 else f"{name}-{used[name]}", path))
    return roots


@dataclass(frozen=True)
class Settings:
    folders: tuple[str, ...] = ()
    data_dir: str = os.path.expanduser("~/.local/share/fathomdex")
    chunk_tokens: int = 512
    overlap_tokens: int = 64
    max_pages: int = 100_000
    default_results: int = 5
    max_results: int = 50
    ocr: bool = True
    ocr_lang: str = "spa"
    ocr_dpi: int = 200
    ocr_max_pages: int = 5000
    archive_members: int = 2000
    archive_bytes: int = 500 * 1024 * 1024
    roots: tuple[Root, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "roots", tuple(build_roots(self.folders)))

    @property
    def index_dir(self) -> str:
        return f"{self.data_dir}/index"

    @classmethod
    def from_env(cls, env: Mapping[str, str] | None = None) -> "Settings":
        env = os.environ if env is None else env
        get = lambda key: env.get(PREFIX + key) or None
        return cls(
            folders=tuple(parse_folders(get("FOLDERS"), get("FOLDER"))),
            data_dir=get("DATA_DIR") or cls.data_dir,
            chunk_tokens=positive(get("CHUNK_TOKENS"), cls.chunk_tokens),
            overlap_tokens=positive(get("OVERLAP_TOKENS"), cls.overlap_tokens),
            max_pages=positive(get("MAX_PAGES"), cls.max_pages),
            default_results=positive(get("RESULTS"), cls.default_results),
            ocr=env.get(PREFIX + "OCR") != "false",
            ocr_lang=get("OCR_LANG") or cls.ocr_lang,
            ocr_dpi=positive(get("OCR_DPI"), cls.ocr_dpi),
            ocr_max_pages=positive(get("OCR_MAX_PAGES"), cls.ocr_max_pages),
        )
