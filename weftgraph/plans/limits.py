"""Budgets and progress of long jobs: a token bucket for remote services, and counts with an estimate of the rest."""

from __future__ import annotations

import asyncio
import threading
import time
from collections import deque
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field


class RateLimiter:
    """Two buckets, of requests and of tokens, that refill evenly by the minute. ``share`` is a task's part of the budget."""

    def __init__(
        self, requests_per_minute: float = 500, tokens_per_minute: float = 150_000, share: float = 1.0, *,
        clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep,
    ):
        self.most = {"requests": requests_per_minute * share, "tokens": tokens_per_minute * share}
        self.left = dict(self.most)
        self._clock, self._sleep, self._lock = clock, sleep, threading.Lock()
        self._at = clock()
        self.waited, self.granted = 0.0, 0

    def _refill(self) -> None:
        now = self._clock()
        for k, most in self.most.items():
            self.left[k] = min(most, self.left[k] + most * (now - self._at) / 60)
        self._at = now

    def acquire(self, tokens: float = 0) -> float:
        """Waits until a request of so many tokens fits; returns the seconds waited. More than a bucket holds counts as full."""
        tokens = min(tokens, self.most["tokens"])
        one = min(1.0, self.most["requests"])
        waited = 0.0
        while True:
            with self._lock:
                self._refill()
                missing = {"requests": one - self.left["requests"], "tokens": tokens - self.left["tokens"]}
                pause = max(missing[k] / self.most[k] * 60 for k in missing)
                if pause <= 1e-9:
                    self.left["requests"] -= one
                    self.left["tokens"] -= tokens
                    self.granted += 1
                    self.waited += waited
                    return waited
            pause = min(1.0, pause)
            self._sleep(pause)
            waited += pause

    async def acquire_async(self, tokens: float = 0) -> float:
        """``acquire`` for coroutines: others go on while it waits."""
        return await asyncio.to_thread(self.acquire, tokens)

    def report(self, estimated: float, actual: float) -> None:
        """Puts back, or takes, the difference between estimated and actual tokens."""
        with self._lock:
            self.left["tokens"] = min(self.most["tokens"], self.left["tokens"] + estimated - actual)

    def drain(self) -> None:
        """After the service refused a request: both buckets start empty."""
        with self._lock:
            self._refill()
            self.left = dict.fromkeys(self.left, 0.0)

    def stats(self) -> dict:
        with self._lock:
            self._refill()
            return {"granted": self.granted, "waited_seconds": self.waited, **{f"{k}_left": v for k, v in self.left.items()}}


def duration(seconds: float) -> str:
    minutes, rest = divmod(int(seconds), 60)
    hours, minutes = divmod(minutes, 60)
    return f"{hours}h {minutes}m" if hours else f"{minutes}m {rest}s" if minutes else f"{rest}s"


def bar(share: float, width: int = 30) -> str:
    full = round(width * min(1.0, max(0.0, share)))
    return "#" * full + "-" * (width - full)


@dataclass
class Progress:
    """Counts of a job's items, with the time left by the mean of the last twenty."""

    total: int
    on_change: Callable[[str], None] | None = None
    clock: Callable[[], float] = time.monotonic
    done: int = 0
    failed: int = 0
    chunks: int = 0
    last: deque = field(default_factory=lambda: deque(maxlen=20))

    def __post_init__(self):
        self._began = self.clock()

    def start(self) -> None:
        self._began = self.clock()

    def finish(self, chunks: int = 0, error: str | None = None) -> None:
        self.last.append(self.clock() - self._began)
        self.done += error is None
        self.failed += error is not None
        self.chunks += chunks
        if self.on_change:
            self.on_change(self.line() + (f" failed: {error}" if error else ""))

    def finish_all(self, results: Sequence[tuple[int, str | None]]) -> None:
        """Items (chunks, error) that were done together since ``start``; each counts with an even part of the time."""
        each = (self.clock() - self._began) / max(1, len(results))
        for chunks, error in results:
            self.last.append(each)
            self.done += error is None
            self.failed += error is not None
            self.chunks += chunks
        if self.on_change:
            self.on_change(self.line())

    @property
    def share(self) -> float:
        return (self.done + self.failed) / self.total if self.total else 0.0

    @property
    def seconds_left(self) -> float | None:
        if not self.last:
            return None
        return sum(self.last) / len(self.last) * (self.total - self.done - self.failed)

    def line(self) -> str:
        left = self.seconds_left
        rest = "" if left is None else f", {duration(left)} left"
        return f"[{bar(self.share)}] {self.done + self.failed}/{self.total}, {self.failed} failed{rest}"
