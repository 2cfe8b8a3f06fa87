"""Progress of a stage: a payload that a file or a listener takes; failures to write never stop a run."""

from __future__ import annotations

import json
import math
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql.streaming import StreamingQueryListener

# The phases in their order.
PHASES = ("download", "stage", "reconcile", "transcribe-html", "transcribe-images", "apply-projections", "score", "project")


def _half_up(x: float) -> int:
    return math.floor(x + 0.5)


def write_progress(path: str, payload: dict) -> None:
    try:
        with open(path, "w", encoding="utf-8") as f:
            f.write(json.dumps(payload, indent=2, ensure_ascii=False) + "\n")
    except OSError:
        pass


class Tracker:
    """start, update and done of a phase."""

    def __init__(self, path: str, phase: str, total: int = 0, clock: Callable[[], float] = time.time, write: Callable[[str, dict], None] = write_progress):
        self.path, self.phase, self.total, self.clock, self.write = path, phase, total, clock, write
        self.began, self.completed, self.stats = clock(), 0, {}

    def _iso(self, t: float) -> str:
        return datetime.fromtimestamp(t, UTC).isoformat(timespec="milliseconds").replace("+00:00", "Z")

    def _say(self, status: str, **more) -> dict:
        now, done, total = self.clock(), self.completed, self.total
        percentage = 100 if status == "done" else _half_up(done / total * 1000) / 10 if total > 0 else 0
        eta = 0 if status == "done" or done <= 0 else _half_up((now - self.began) * 1000 / done * max(total - done, 0) / 1000)
        payload = {"phase": self.phase, "status": status, "done": done, "total": total, "percentage": percentage, "stats": self.stats, "etaSeconds": eta, "startedAt": self._iso(self.began), "updatedAt": self._iso(now)} | more
        if status == "done":
            payload["finishedAt"] = self._iso(now)
        self.write(self.path, payload)
        return payload

    def start(self) -> dict:
        return self._say("start")

    def update(self, done: int, total: int | None = None, current: str | None = None, stats: dict | None = None) -> dict:
        self.completed, self.total = done, self.total if total is None else total
        self.stats = self.stats | (stats or {})
        return self._say("running", **({"currentItem": current} if current else {}))

    def done(self, stats: dict | None = None) -> dict:
        self.completed, self.stats = self.total or self.completed, self.stats | (stats or {})
        return self._say("done")


class ProgressListener(StreamingQueryListener):
    """Feeds a tracker from a streaming query's own progress."""

    def __init__(self, tracker: Tracker):
        self.tracker, self.rows = tracker, 0

    def onQueryStarted(self, event):
        self.tracker.start()

    def onQueryProgress(self, event):
        self.rows += event.progress.numInputRows
        self.tracker.update(self.rows, current=str(event.progress.batchId))

    def onQueryIdle(self, event):
        pass

    def onQueryTerminated(self, event):
        self.tracker.done()
