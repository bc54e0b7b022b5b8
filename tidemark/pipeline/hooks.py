"""Observers of a run: log lines, spans and metric rows."""

from __future__ import annotations

import logging
import time
from bisect import bisect_left
from dataclasses import dataclass, field
from enum import Enum
from typing import Any, Protocol


class Event(Enum):
    BEFORE_PIPELINE = "before_pipeline"
    AFTER_PIPELINE = "after_pipeline"
    PIPELINE_FAILED = "pipeline_failed"
    BEFORE_STAGE = "before_stage"
    AFTER_STAGE = "after_stage"
    STAGE_FAILED = "stage_failed"


@dataclass(frozen=True)
class Notice:
    """An event: ``status`` is always set for finished stages and pipelines, raised or returned."""

    event: Event
    pipeline: str
    stage: str | None = None
    attempt: int = 1
    status: str | None = None
    error: str | None = None
    seconds: float | None = None


class Hook(Protocol):
    def notify(self, notice: Notice) -> None: ...


class HookManager:
    """Tells hooks in order; a hook that raises is logged and does not stop the run."""

    def __init__(self, hooks: list[Hook] | None = None) -> None:
        self.hooks = list(hooks or [])

    def notify(self, notice: Notice) -> None:
        for hook in self.hooks:
            try:
                hook.notify(notice)
            except Exception:
                logging.getLogger(__name__).exception("hook %s failed", type(hook).__name__)


class LoggingHook:
    def __init__(self, logger: logging.Logger | None = None) -> None:
        self.logger = logger or logging.getLogger("tidemark.pipeline")

    def notify(self, n: Notice) -> None:
        level = logging.ERROR if n.event in (Event.PIPELINE_FAILED, Event.STAGE_FAILED) else logging.INFO
        self.logger.log(level, "%s pipeline=%s stage=%s attempt=%d status=%s seconds=%s error=%s", n.event.value, n.pipeline, n.stage, n.attempt, n.status, n.seconds, n.error)


@dataclass
class Span:
    name: str
    start: float
    end: float | None = None
    attributes: dict[str, Any] = field(default_factory=dict)


class TracingHook:
    """One span per pipeline and per attempt of a stage."""

    def __init__(self) -> None:
        self.spans: list[Span] = []
        self._open: dict[tuple[str, str | None], Span] = {}

    def notify(self, n: Notice) -> None:
        key = (n.pipeline, n.stage)
        if n.event in (Event.BEFORE_PIPELINE, Event.BEFORE_STAGE):
            self._open[key] = Span(n.stage or n.pipeline, time.time(), attributes={"attempt": n.attempt})
            self.spans.append(self._open[key])
        elif key in self._open:
            span = self._open.pop(key)
            span.end = time.time()
            span.attributes |= {"status": n.status, "error": n.error}


class MetricsHook:
    """Counts and a histogram of seconds by stage and status; every attempt is timed by itself."""

    #: Upper bounds of the histogram in seconds.
    BOUNDS = (0.05, 0.1, 0.25, 0.5, 1.0, 2.5, 5.0, 10.0, 30.0, 60.0)

    def __init__(self) -> None:
        self.rows: list[dict[str, Any]] = []
        self.buckets: dict[tuple[str, str], list[int]] = {}

    def notify(self, n: Notice) -> None:
        if n.event in (Event.BEFORE_PIPELINE, Event.BEFORE_STAGE) or n.seconds is None:
            return
        self.rows.append({"ts": time.time(), "pipeline": n.pipeline, "stage_name": n.stage or "", "status": n.status, "attempt": n.attempt, "seconds": n.seconds})
        counts = self.buckets.setdefault((n.stage or n.pipeline, n.status or ""), [0] * (len(self.BOUNDS) + 1))
        counts[bisect_left(self.BOUNDS, n.seconds)] += 1
