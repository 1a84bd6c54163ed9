"""The engine's tables. Column names of results are those that clients of such engines read."""

FILES = "path string, size long, mtime_ns long, ext string"
PAGES = "array<struct<page: int, text: string>>"
INDEX = (
    "doc_id string, chunk_id int, vector array<float>, texto string, fichero string, ruta_relativa string, raiz string, "
    "pagina int, fecha_modificacion timestamp"
)
REGISTRY = (
    "path string, doc_id string, raiz string, ruta_relativa string, size long, mtime_ns long, indexed_at timestamp, "
    "num_chunks int, num_pages int, sin_ocr boolean"
)
EXTRACTED = f"path string, pages {PAGES}, num_pages int, sin_ocr boolean, error string"
EVENTS = "path string, kind string, size long, mtime_ns long, ts timestamp, seq long"
