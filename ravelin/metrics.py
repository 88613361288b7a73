"""Timing of pieces of work, and progress of streams, through the standard logging."""

from __future__ import annotations

import logging
import time
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql.streaming import StreamingQueryListener

log = logging.getLogger("ravelin")


@contextmanager
def timed(name: str, into: dict[str, float] | None = None) -> Iterator[None]:
    """Logs the seconds that the block took, also if it fails; ``into`` collects them by name."""
    began = time.perf_counter()
    try:
        yield
    finally:
        seconds = time.perf_counter() - began
        log.info("%s: %.2f s", name, seconds)
        if into is not None:
            into[name] = into.get(name, 0.0) + seconds


class Progress(StreamingQueryListener):
    """Logs rows and milliseconds of every micro-batch: ``spark.streams.addListener(Progress())``."""

    def onQueryStarted(self, event) -> None:
        log.info("stream %s started", event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        log.info("stream %s batch %d: %d rows, %d ms", p.id, p.batchId, p.numInputRows, p.batchDuration)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        log.info("stream %s ended%s", event.id, f": {event.exception}" if event.exception else "")
