"""Calls to remote services: rates, retries, batches by tokens."""

from __future__ import annotations

import time
from collections import deque
from collections.abc import Callable
from dataclasses import dataclass, field


class TooManyRequests(Exception):
    """The service asks to wait."""


@dataclass
class RateLimiter:
    """At most ``rpm`` calls and ``tpm`` tokens in any minute; what is exactly a minute old no longer counts.

    One for each task: give it the whole limit divided by the number of tasks that run at once (``shared``).
    Calls that a service refuses for their rate are tried again after each of ``waits``.
    """

    rpm: int | None = None
    tpm: int | None = None
    waits: tuple[float, ...] = (1, 2, 5, 10)
    clock: Callable[[], float] = time.monotonic
    sleep: Callable[[float], None] = time.sleep
    calls: deque = field(default_factory=deque)  # (time, tokens)

    def shared(self, tasks: int) -> RateLimiter:
        part = lambda x: None if x is None else max(1, x // max(1, tasks))
        return RateLimiter(part(self.rpm), part(self.tpm), self.waits, self.clock, self.sleep)

    def used(self) -> tuple[int, int]:
        """(calls, tokens) of the last minute."""
        now = self.clock()
        while self.calls and self.calls[0][0] <= now - 60:
            self.calls.popleft()
        return len(self.calls), sum(t for _, t in self.calls)

    def delay(self, tokens: int = 0) -> float:
        """Seconds until a call of ``tokens`` fits; a call over the whole limit waits for an empty minute."""
        calls, spent = self.used()
        wait = 0.0
        if self.rpm is not None and calls >= self.rpm:
            wait = self.calls[-self.rpm][0] + 60 - self.clock()
        if self.tpm is not None and tokens and self.calls and spent + tokens > self.tpm:
            freed = 0
            for at, t in self.calls:
                freed += t
                if spent - freed + tokens <= self.tpm or spent == freed:
                    wait = max(wait, at + 60 - self.clock())
                    break
        return max(0.0, wait)

    def run(self, call: Callable, tokens: int = 0):  # type: ignore[no-untyped-def]
        for wait in (*self.waits, None):
            while (seconds := self.delay(tokens)) > 0:
                self.sleep(seconds)
            try:
                out = call()
                self.calls.append((self.clock(), tokens))
                return out
            except TooManyRequests:
                if wait is None:
                    raise
                self.sleep(wait)


def token_batches(texts: list[str], count: Callable[[str], int], budget: int = 100_000, most: int = 8191) -> list[list[int]]:
    """Places of the texts in batches, in order, of at most ``budget`` tokens; a text over ``most`` is an error."""
    out: list[list[int]] = []
    total = 0
    for k, text in enumerate(texts):
        n = count(text)
        if n > most:
            raise ValueError(f"text {k} has {n} tokens, {most} are allowed")
        if not out or total + n > budget:
            out.append([])
            total = 0
        out[-1].append(k)
        total += n
    return out
