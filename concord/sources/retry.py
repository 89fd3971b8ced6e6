"""Faults that pass, and trying again: a live engine may be busy, restarting or out of reach for a moment."""

from __future__ import annotations

import random
import time
from collections.abc import Callable
from typing import TypeVar

T = TypeVar("T")
RETRIES = 3
#: Seconds before the first further try; each next one waits twice as long, up to the most, and up to half as much again.
FIRST, MOST = 0.5, 30.0
#: Words of messages about faults that pass, in lower case.
PASSING = (
    "connection refused", "connection reset", "connection timed out", "communications link failure", "broken pipe", "server closed the connection", "the database system is starting up", "too many connections",
    "deadlock", "lock wait timeout", "could not serialize access", "database is locked", "temporarily unavailable", "read timed out", "terminating connection due to administrator command",
)


def passes(error: BaseException) -> bool:
    """Whether a fault, or what has caused it, is of a kind that passes."""
    seen = []
    while error is not None and error not in seen:
        seen.append(error)
        if isinstance(error, (ConnectionError, TimeoutError)) or any(word in str(error).lower() for word in PASSING):
            return True
        error = error.__cause__ or error.__context__
    return False


def retried(run: Callable[[], T], retries: int = RETRIES, wait: Callable[[float], None] = time.sleep) -> T:
    """The result of ``run``, tried again after faults that pass; other faults and the last one are raised as they are.

    ``run`` must be one that may run twice: reads are, and writes that are one transaction.
    """
    for k in range(retries + 1):
        try:
            return run()
        except Exception as error:
            if k == retries or not passes(error):
                raise
            wait(min(MOST, FIRST * 2**k) * random.uniform(1, 1.5))
    raise AssertionError("unreachable")
