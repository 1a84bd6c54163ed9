"""Paths: families of formats, ids, roots and folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..config import Root

# The formats that are read, by family.
FAMILIES = {
    "pdf": (".pdf",),
    "docx": (".docx",),
    "text": (".txt", ".md", ".markdown"),
    "html": (".html", ".htm"),
    "rtf": (".rtf",),
    "office": (".odt", ".odp", ".pptx"),
    "sheet": (".xlsx", ".xls", ".ods", ".xlsm", ".fods"),
    "csv": (".csv", ".tsv"),
    "eml": (".eml",),
    "msg": (".msg",),
    "image": (".jpg", ".jpeg", ".png", ".tiff", ".tif", ".bmp", ".gif", ".heic", ".heif"),
    "archive": (".zip", ".rar", ".7z"),
}
FAMILY_OF = {ext: family for family, exts in FAMILIES.items() for ext in exts}
#: Inside archives and e-mail, everything but archives.
INNER = frozenset(ext for ext, family in FAMILY_OF.items() if family != "archive")


def extension(path: Column) -> Column:
    """From the last dot of the base name on, lower-cased; empty where that dot begins the name."""
    return F.lower(F.regexp_extract(path, r"[^/](\.[^./]*)$", 1))


def family(ext: Column) -> Column:
    """The family of formats, null for unsupported ones."""
    out = F.lit(None).cast("string")
    for name, exts in FAMILIES.items():
        out = F.when(ext.isin(*exts), F.lit(name)).otherwise(out)
    return out


def doc_id(path: Column) -> Column:
    """A document is known by its absolute path."""
    return F.substring(F.sha1(path.cast("binary")), 1, 16)


def base_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)/*$", 1)


def under(path: Column, folder: str) -> Column:
    return (path == folder) | path.startswith(folder.rstrip("/") + "/")


def root_of(path: Column, roots: Sequence[Root]) -> Column:
    """The root that holds the path; of nested ones, the innermost. Roots come from the settings, so they are literals."""
    out = F.lit(None).cast("string")
    for root in sorted(roots, key=lambda r: len(r.path)):
        out = F.when(under(path, root.path), F.lit(root.name)).otherwise(out)
    return out


def logical_path(path: Column, roots: Sequence[Root]) -> Column:
    """``root name/relative path``, or the base name outside all roots."""
    out = base_name(path)
    for root in sorted(roots, key=lambda r: len(r.path)):
        rest = F.ltrim(F.substring(path, len(root.path) + 1, 1 << 20), F.lit("/"))
        inside = F.when(rest == "", F.lit(root.name)).otherwise(F.concat(F.lit(root.name + "/"), rest))
        out = F.when(under(path, root.path), inside).otherwise(out)
    return out


def normal_folder(folder: Column) -> Column:
    return F.regexp_replace(F.replace(folder, F.lit("\\"), F.lit("/")), r"^/+|/+$", "")


def in_folder(path: Column, folder: str | None) -> Column:
    """Whether a logical path is the folder or lies in it; no filter lets all pass, one of only slashes nothing."""
    if not folder:
        return F.lit(True)
    wanted = folder.replace("\\", "/").strip("/")
    own = normal_folder(path)
    return F.coalesce((own == wanted) | own.startswith(wanted + "/"), F.lit(False))
