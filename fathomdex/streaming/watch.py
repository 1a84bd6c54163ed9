"""Watching folders: a stream of file changes, applied batch by batch."""

from __future__ import annotations

import json
import logging

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..plans.engine import Engine

log = logging.getLogger("fathomdex")


def file_changes(engine: Engine, settle: float = 1.0) -> DataFrame:
    """The stream of changes in the engine's roots. Files that are there at the start are no changes."""
    s = engine.settings
    reader = engine.spark.readStream.format("fathomdex_changes").option("folders", json.dumps([r.path for r in s.roots]))
    return reader.option("exclude", s.data_dir).option("state", f"{s.data_dir}/watch/listings").option("settle", str(settle)).load()


def watch(engine: Engine, interval: str = "1500 milliseconds", settle: float = 1.0, once: bool = False) -> StreamingQuery:
    """Keeps the index up to date. Batches run one after another; a restart goes on where the last one ended.

    A batch that fails is logged and kept in the status, and the stream goes on: what
    it held isn't registered, so the next full run indexes it. ``engine.stop()`` ends the stream.
    """

    def apply(events: DataFrame, batch: int) -> None:
        if events.isEmpty():
            return
        try:
            log.info("batch %s: %s", batch, engine.apply_changes(events))
            engine.state.set("activo")
            engine.store.merge()
        except Exception as e:
            engine.state.set("error", str(e))
            log.exception("batch %s failed", batch)

    writer = file_changes(engine, settle).writeStream.foreachBatch(apply).option("checkpointLocation", f"{engine.settings.data_dir}/watch/checkpoint")
    engine.stream = (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=interval)).start()
    return engine.stream
