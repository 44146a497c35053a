"""A hybrid clock for the driver: wall time that never stands still or goes back."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class HybridClock:
    """Strictly growing times in microseconds; ``update`` moves it forward to a time seen."""

    def __init__(self, wall: Callable[[], int] = lambda: time.time_ns() // 1000):
        self._wall, self._last, self._lock = wall, 0, threading.Lock()

    def now(self) -> int:
        with self._lock:
            self._last = max(self._wall(), self._last + 1)
            return self._last

    def update(self, seen: int) -> None:
        with self._lock:
            self._last = max(self._last, seen)


def with_default_time(requests: DataFrame, at: str, now: int) -> DataFrame:
    """Requests without a time get ``now``, one and the same for the whole batch."""
    return requests.withColumn(at, F.coalesce(F.col(at), F.lit(now).cast(requests.schema[at].dataType)))
