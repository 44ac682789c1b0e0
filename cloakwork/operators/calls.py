"""Calls of an outside service from a task: several in flight, answers in order, one rate and one budget of retries."""

from __future__ import annotations

import random
import threading
import time
from collections import deque
from collections.abc import Callable, Iterable, Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from typing import Any

#: What makes a service's error worth another attempt.
RETRY_STATUS = (429, 500, 502, 503, 504)
RETRY_WORDS = ("throttl", "toomanyrequests", "serviceunavailable", "too many tokens", "rate exceeded", "temporarily unavailable")


def backoff(attempt: int, base: float = 1.0, jitter: float = 0.5, most: float = 16.0) -> float:
    """Seconds before the next attempt: doubling, with jitter, bounded."""
    return min(base * 2 ** (attempt - 1) + random.uniform(0, jitter), most)


def retryable(status: int | None, message: str) -> bool:
    return status in RETRY_STATUS or any(w in (message or "").lower() for w in RETRY_WORDS)


@dataclass
class Answer:
    """What came of one call: a value or the last error, and how often it was tried again."""

    value: Any = None
    retries: int = 0
    error: str | None = None


class Caller:
    """Calls of one task.

    `window` calls are in flight at once and no more are read from the input than that, so memory is bounded and a slow answer holds back at
    most the window. Attempts start no faster than `per_minute` (None: at once), retries too. All calls of a task share `budget` retries,
    so a service that is down isn't asked `attempts` times for every row. check(value) raises where an answer isn't sound; that is an error
    of its row, not a reason to ask again.
    """

    def __init__(
        self, call: Callable[..., Any], check: Callable[[Any], Any] = lambda v: v, window: int = 8, attempts: int = 4, budget: int = 100,
        per_minute: float | None = None, sleep: Callable[[float], None] = time.sleep,
    ):
        self.call, self.check, self.window, self.attempts, self.left, self.sleep = call, check, window, attempts, budget, sleep
        self.pause, self.due, self.lock = 60 / per_minute if per_minute else 0.0, None, threading.Lock()

    def _turn(self) -> None:
        """Waits for this attempt's turn."""
        if not self.pause:
            return
        with self.lock:
            now = time.monotonic()
            at = now if self.due is None else max(now, self.due)
            self.due = at + self.pause
        if at > now:
            self.sleep(at - now)

    def _granted(self) -> bool:
        with self.lock:
            self.left -= 1
            return self.left >= 0

    def one(self, *args: Any) -> Answer:
        for k in range(1, self.attempts + 1):
            self._turn()
            try:
                value = self.call(*args)
            except Exception as e:  # noqa: BLE001  (whatever the service's client raises is this row's error)
                if k == self.attempts or not retryable(getattr(e, "status", None), str(e)) or not self._granted():
                    return Answer(None, k - 1, str(e))
                self.sleep(backoff(k))
                continue
            try:
                return Answer(self.check(value), k - 1)
            except (TypeError, ValueError) as e:
                return Answer(None, k - 1, f"unsound answer: {e}")
        raise AssertionError("unreachable")

    def all(self, items: Iterable[tuple]) -> Iterator[Answer]:
        """Answers in the order of items."""
        with ThreadPoolExecutor(self.window) as pool:
            flying: deque = deque()
            for args in items:
                flying.append(pool.submit(self.one, *args))
                if len(flying) >= self.window:
                    yield flying.popleft().result()
            while flying:
                yield flying.popleft().result()
