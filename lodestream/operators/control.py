"""Stops for queries that take too long or too much: by the driver, and inside the workers."""

from __future__ import annotations

import threading
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import SparkSession

from lodestream.plans import model as m
from lodestream.plans import walk
from lodestream.plans.model import JsonError


@dataclass
class Control:
    """A latch, a deadline and a ceiling, looked at in that order at each poll."""

    cancelled: bool = False
    deadline: float | None = None
    most_bytes: int | None = None
    now: Callable[[], float] = time.monotonic

    def cancel(self) -> None:
        self.cancelled = True

    def poll(self, at: int, held: int = 0) -> None:
        if self.cancelled:
            raise JsonError("Control", "cancelled", at)
        if self.deadline is not None and self.now() > self.deadline:
            raise JsonError("Control", "deadline-exceeded", at)
        if self.most_bytes is not None and held > self.most_bytes:
            raise JsonError("Control", "memory-exceeded", at)


@dataclass(frozen=True)
class Limits:
    """Controls as plain data, for operators over DataFrames: what the reading of one text may take.

    until: a time.time() after which no text is read on; seconds: time for one text; most_bytes: bytes that its answers hold.
    """

    until: float | None = None
    seconds: float | None = None
    most_bytes: int | None = None

    def control(self) -> Control:
        ends = [self.until] if self.until is not None else []
        if self.seconds is not None:
            ends.append(time.time() + self.seconds)
        return Control(deadline=min(ends, default=None), most_bytes=self.most_bytes, now=time.time)


def scan_controlled(src: bytes | str, request: m.Request, control: Control, watch: Callable[[str, int, int], None] | None = None) -> m.Result:
    """As scan(), but gives up where the control says so: it is polled at each step through a container that is read and at
    each span that an answer holds. A held span counts 16 bytes."""
    held = 0

    def seen(event: str, start: int, end: int) -> None:
        nonlocal held
        if event == "hold":
            held += 16
        if event != "skip":
            control.poll(start, held)
        if watch is not None:
            watch(event, start, end)

    control.poll(0)
    return walk.scan(src, request, seen)


@dataclass
class Trace:
    """What one scan did: events (event, demand, kind, start, end, check) and counters.

    mark: one a demand, what it produced and a document's span; skip: a region that was only located; stop: an early end.
    """

    events: list[tuple[str, int | None, str | None, int | None, int | None]] = field(default_factory=list)
    counters: dict[str, int] = field(default_factory=lambda: dict.fromkeys(("demands", "answered", "skips", "skipped_bytes", "polls", "stops"), 0))

    def watch(self, event: str, start: int, end: int) -> None:
        if event == "poll":
            self.counters["polls"] += 1
        elif event == "skip":
            self.events.append(("skip", None, None, start, end))
            self.counters["skips"] += 1
            self.counters["skipped_bytes"] += end - start
        elif event == "stop":
            self.events.append(("stop", None, None, start, None))
            self.counters["stops"] += 1

    def close(self, result: m.Result) -> None:
        kinds = {m.Document: "document", m.Columns: "columns", m.OracleAnswer: "oracle", m.Missing: "missing", m.TypeMismatch: "mismatch"}
        for i, a in enumerate(result.answers):
            span = (a.start, a.end) if isinstance(a, m.Document) else (None, None)
            self.events.append(("mark", i, kinds[type(a)], *span))
            self.counters["answered"] += not isinstance(a, m.Missing)
        self.counters["demands"] = len(result.answers)


def scan_traced(src: bytes | str, request: m.Request, control: Control | None = None) -> tuple[m.Result, Trace]:
    """As scan(), under a control if there is one, with what the reading did."""
    trace = Trace()
    result = walk.scan(src, request, trace.watch) if control is None else scan_controlled(src, request, control, trace.watch)
    trace.close(result)
    return result, trace


@contextmanager
def time_limit(spark: SparkSession, seconds: float) -> Iterator[str]:
    """Spark jobs that start inside are cancelled when the time is over; gives the job group."""
    tag, sc = f"lodestream-{uuid.uuid4().hex}", spark.sparkContext
    sc.setJobGroup(tag, "time limit", interruptOnCancel=True)
    over = threading.Event()

    def watch() -> None:
        # Again and again: a job may start only after the first call.
        wait = seconds
        while not over.wait(wait):
            sc.cancelJobGroup(tag)
            wait = 0.5

    threading.Thread(target=watch, daemon=True).start()
    try:
        yield tag
    finally:
        over.set()
        sc.setLocalProperty("spark.jobGroup.id", None)


def run_or_serial(eligible: bool, parts: Callable[[], Any], serial: Callable[[], Any]) -> Any:
    """The parts' result; where they can't be used or fail, the serial one. Control errors are not retried."""
    if not eligible:
        return serial()
    try:
        return parts()
    except JsonError as error:
        if error.cls == "Control":
            raise
        return serial()
