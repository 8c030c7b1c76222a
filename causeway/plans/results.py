"""Results kept under a key in the shared folder, for as long as they are fresh."""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from causeway.plans.durable import discard, written

#: Hours that a result stays fresh, and results kept at most (fixed values).
HOURS, MOST = 6.0, 64


class Results:
    """Tables by key.  The oldest goes when there are too many, and a stale one is made anew."""

    def __init__(self, spark: SparkSession, hours: float = HOURS, most: int = MOST):
        self.spark, self.hours, self.most = spark, hours, most
        self.kept: dict[str, tuple[float, DataFrame]] = {}

    def get(self, key: str, make: Callable[[], DataFrame], now: float | None = None) -> DataFrame:
        """The table under ``key``; ``make`` is asked where there is none or a stale one."""
        now = time.time() if now is None else now
        found = self.kept.get(key)
        if found and now - found[0] < self.hours * 3600:
            return found[1]
        self.forget(key)
        table = written(make(), "result-" + hashlib.md5(key.encode()).hexdigest()[:12])
        self.kept[key] = (now, table)
        while len(self.kept) > self.most:
            self.forget(min(self.kept, key=lambda k: self.kept[k][0]))
        return table

    def forget(self, key: str | None = None) -> None:
        """Drop one result, or all of them."""
        for k in [key] if key is not None else list(self.kept):
            if found := self.kept.pop(k, None):
                discard(self.spark, found[1])
