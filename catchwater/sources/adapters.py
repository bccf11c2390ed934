"""What keeps a live provider from stalling an analysis; for the driver side of an adapter that fills a provider table.

Executors never call providers: they read tables.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Iterable
from concurrent.futures import ThreadPoolExecutor


class Unavailable(Exception):
    """A provider can't answer; trip says that it should be left alone for a while."""

    def __init__(self, message: str = "", trip: bool = False, retry: bool = True):
        super().__init__(message)
        self.trip, self.retry = trip, retry


def failure(kind: int | str) -> Unavailable:
    """What a failed call means, from its HTTP status or from 'timeout', 'connect' or 'malformed'.

    A provider that limits or refuses calls is left alone for a while, and one that can't be reached is not asked again at once;
    a malformed body will not improve on another try.
    """
    if kind in (429, 503):
        return Unavailable(f"HTTP {kind}", trip=True)
    if kind == "connect":
        return Unavailable("can't be reached", trip=True, retry=False)
    if kind == "malformed":
        return Unavailable("unusable response", retry=False)
    return Unavailable("timed out" if kind == "timeout" else f"HTTP {kind}")


class Deadline:
    """A time budget; each call gets what is left of it, up to a limit."""

    def __init__(self, seconds: float, clock: Callable[[], float] = time.monotonic):
        self.clock, self.end = clock, clock() + seconds

    def left(self, most: float = float("inf")) -> float:
        return max(0.0, min(most, self.end - self.clock()))


class Breaker:
    """After a trip, a provider is closed for some seconds."""

    def __init__(self, seconds: float = 60.0, clock: Callable[[], float] = time.monotonic):
        self.seconds, self.clock, self.until = seconds, clock, {}

    def trip(self, name: str) -> None:
        self.until[name] = self.clock() + self.seconds

    def allows(self, name: str) -> bool:
        return self.clock() >= self.until.get(name, float("-inf"))


class Pace:
    """At most one call in so many seconds; False where the wait would pass the deadline."""

    def __init__(self, seconds: float = 1.0, clock: Callable[[], float] = time.monotonic, sleep: Callable[[float], None] = time.sleep):
        self.seconds, self.clock, self.sleep, self.next = seconds, clock, sleep, float("-inf")

    def wait(self, deadline: Deadline) -> bool:
        pause = self.next - self.clock()
        if pause > deadline.left():
            return False
        if pause > 0:
            self.sleep(pause)
        self.next = self.clock() + self.seconds
        return True


def call(name: str, fetch: Callable[[float], list], breaker: Breaker, deadline: Deadline, tries: int = 2, timeout: float = 10.0) -> list | None:
    """What fetch returns within the deadline; None where the provider is closed, out of time, or fails for good."""
    for _ in range(tries):
        if not breaker.allows(name) or not deadline.left():
            return None
        try:
            return fetch(deadline.left(timeout))
        except Unavailable as e:
            if e.trip:
                breaker.trip(name)
            if not e.retry:
                return None
    return None


def in_batches(points: list, size: int, fetch: Callable[[list], Iterable | None], workers: int = 12) -> list:
    """Results in the order of points, from batches that are fetched at once by some threads; a batch that fails, or answers with another number of results, gives None for each of its points."""

    def one(batch: list) -> list:
        got = fetch(batch)
        got = list(got) if got is not None else []
        return got if len(got) == len(batch) else [None] * len(batch)

    with ThreadPoolExecutor(workers) as pool:
        return [x for part in pool.map(one, [points[k : k + size] for k in range(0, len(points), size)]) for x in part]
