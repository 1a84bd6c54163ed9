"""The engine's operations under the tool names, arguments and result fields that clients know, as plain dicts."""

from __future__ import annotations

import json
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from .engine import Engine, NotFound

# Names of fields in a run's summary.
SUMMARY = {"sin_cambios": "sinCambios", "sin_ocr": "sinOcr", "fragmentos_nuevos": "fragmentosNuevos"}


def _plain(value: Any) -> Any:
    """Times as ISO 8601 in UTC with milliseconds."""
    if isinstance(value, datetime):
        at = value.astimezone(timezone.utc)
        return at.strftime("%Y-%m-%dT%H:%M:%S.") + f"{at.microsecond // 1000:03d}Z"
    return value


def _dict(row) -> dict:
    return {k: _plain(v) for k, v in (row if isinstance(row, dict) else row.asDict()).items()}


def envelope(data: dict, failed: bool = False) -> dict:
    """What a tool returns: readable text and the same as structure."""
    out = {"content": [{"type": "text", "text": json.dumps(data, ensure_ascii=False, indent=2, default=str)}], "structuredContent": data}
    return {**out, "isError": True} if failed else out


class Tools:
    def __init__(self, engine: Engine):
        self.engine = engine
        self.known: dict[str, Callable[[dict], dict]] = {
            "buscar_documentos": self._search, "indexar_carpeta": self._index, "obtener_fragmento": self._chunk, "obtener_documento": self._document,
            "listar_documentos_indexados": self._list, "estado_servidor": lambda args: self.engine.status(),
        }

    def call(self, name: str, args: dict | None = None) -> dict:
        """The envelope of a result; an unknown name, a bad argument or an error gives one with ``isError``."""
        run = self.known.get(name)
        if run is None:
            return envelope({"error": f"unknown tool: {name}"}, True)
        try:
            return envelope(run(args or {}))
        except NotFound as e:
            return envelope({"error": str(e), **{k: v for k, v in (args or {}).items() if k in ("doc_id", "chunk_id")}}, True)
        except Exception as e:
            return envelope({"error": str(e)}, True)

    def _search(self, args: dict) -> dict:
        query = (args.get("query") or "").strip()
        rows = self.engine.search(query, args.get("n_resultados") or None, args.get("carpeta_filtro") or None).collect()
        return {"query": query, "n_resultados": len(rows), "fragmentos": [_dict(r) for r in rows]}

    def _index(self, args: dict) -> dict:
        found = self.engine.index([args["path"]] if args.get("path") else None, bool(args.get("forzar")))
        return {SUMMARY.get(k, k): v for k, v in found.items()}

    def _chunk(self, args: dict) -> dict:
        if not args.get("doc_id") or args.get("chunk_id") is None:
            raise ValueError('"doc_id" and "chunk_id" are needed')
        return _dict(self.engine.chunk(args["doc_id"], int(args["chunk_id"])))

    def _document(self, args: dict) -> dict:
        if not args.get("doc_id"):
            raise ValueError('"doc_id" is needed')
        return _dict(self.engine.document(args["doc_id"], args.get("desde_fragmento"), args.get("max_fragmentos")))

    def _list(self, args: dict) -> dict:
        rows = [_dict(r) for r in self.engine.documents(args.get("carpeta_filtro") or None).collect()]
        return {"total": len(rows), "documentos": rows}
