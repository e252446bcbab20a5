"""Running counters of a stream: metrics named in its plan, and a listener that adds them up."""

from __future__ import annotations

import threading

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener


def counted(stream: DataFrame, name: str, **metrics: Column) -> DataFrame:
    """stream with a metric of this name in its plan: `rows`, and any further aggregates; no job of its own."""
    return stream.observe(name, F.count(F.lit(1)).alias("rows"), *[c.alias(k) for k, c in metrics.items()])


class Counters(StreamingQueryListener):
    """Sums of the observed metrics of all batches, by query name and metric.

    Add it with spark.streams.addListener. A batch counts once, also where its progress is told again after a restart.
    """

    def __init__(self) -> None:
        self.totals: dict[tuple[str, str, str], int] = {}
        self.batches: dict[str, set[int]] = {}
        self.ended: set[str] = set()
        self._lock = threading.Lock()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        with self._lock:
            seen = self.batches.setdefault(str(p.id), set())
            if p.batchId in seen or not p.observedMetrics:
                return
            seen.add(p.batchId)
            for metric, row in p.observedMetrics.items():
                for field, value in row.asDict().items():
                    key = (p.name, metric, field)
                    self.totals[key] = self.totals.get(key, 0) + (value or 0)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        with self._lock:
            self.ended.add(str(event.id))

    def of(self, query: str, metric: str, field: str = "rows") -> int:
        with self._lock:
            return self.totals.get((query, metric, field), 0)
