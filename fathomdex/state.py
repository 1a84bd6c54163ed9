"""What an engine is doing, kept in a file so that other processes see it too."""

from __future__ import annotations

import json
import os
import threading
import time
from collections.abc import Callable

#: A file that wasn't renewed for so long is of an engine that is gone.
FRESH_SECONDS = 15.0


class State:
    """``name``: activo, iniciando, indexando or error; ``progress``: files done and in all, while indexing."""

    def __init__(self, data_dir: str):
        self.path = f"{data_dir}/state.json"
        self.name, self.error, self.progress = "activo", None, None

    def set(self, name: str, error: str | None = None, progress: dict | None = None) -> None:
        self.name, self.progress = name, progress
        self.error = error or self.error
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        draft = f"{self.path}.{os.getpid()}-{threading.get_ident()}"
        with open(draft, "w") as f:
            json.dump({"estado": name, "ultimo_error": self.error, "progreso": progress, "pid": os.getpid(), "at": time.time()}, f)
        os.replace(draft, self.path)

    def seen(self) -> dict:
        """estado, and progreso or ultimo_error: this process's own, or that of another which is busy."""
        own = {"estado": self.name, "progreso": self.progress, "ultimo_error": self.error}
        if self.name == "activo":
            try:
                with open(self.path) as f:
                    other = json.load(f)
                if other["pid"] != os.getpid() and other["estado"] in ("iniciando", "indexando") and time.time() - other["at"] < FRESH_SECONDS:
                    own = other
            except (OSError, ValueError, KeyError):
                pass
        shown = {"estado": own["estado"]}
        if own["estado"] == "indexando" and own["progreso"]:
            shown["progreso"] = own["progreso"]
        if own["estado"] == "error" and own["ultimo_error"]:
            shown["ultimo_error"] = own["ultimo_error"]
        return shown


class Reporting:
    """Renews the state with the number of files done while its block runs."""

    def __init__(self, state: State, total: int, done: Callable[[], int], every: float = 1.0):
        self.state, self.total, self.done, self.every = state, total, done, every
        self.stopped = threading.Event()

    def _tell(self) -> None:
        self.state.set("indexando", progress={"procesados": min(self.done(), self.total), "total": self.total, "ficheroActual": None})

    def _run(self) -> None:
        while not self.stopped.wait(self.every):
            self._tell()

    def __enter__(self) -> "Reporting":
        self._tell()
        self.thread = threading.Thread(target=self._run, daemon=True)
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.stopped.set()
        self.thread.join()
