"""A log of JSON lines that rotates: the file and two older ones, 10 MB each."""

from __future__ import annotations

import json
import logging
import logging.handlers
import os
from datetime import datetime, timezone

MOST_BYTES, OLDER = 10 * 1024 * 1024, 2


class JsonLines(logging.Formatter):
    def format(self, record: logging.LogRecord) -> str:
        at = datetime.fromtimestamp(record.created, timezone.utc).isoformat(timespec="milliseconds").replace("+00:00", "Z")
        line = {"ts": at, "level": record.levelname.lower(), "msg": record.getMessage(), **getattr(record, "extra", {})}
        if record.exc_info:
            line["err"] = self.formatException(record.exc_info)
        return json.dumps(line, ensure_ascii=False, default=str)


def to_file(folder: str, most_bytes: int = MOST_BYTES) -> logging.Logger:
    """The engine's logger, writing to ``fathomdex.log`` in the folder as well."""
    os.makedirs(folder, exist_ok=True)
    log = logging.getLogger("fathomdex")
    path = os.path.abspath(f"{folder}/fathomdex.log")
    if not any(getattr(h, "baseFilename", None) == path for h in log.handlers):
        handler = logging.handlers.RotatingFileHandler(path, maxBytes=most_bytes, backupCount=OLDER, encoding="utf-8")
        handler.setFormatter(JsonLines())
        log.addHandler(handler)
        log.setLevel(logging.INFO)
    return log
