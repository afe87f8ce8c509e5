"""Counters, gauges, histograms and percentiles: over DataFrames, and in the driver for the façade."""

from __future__ import annotations

import bisect
import threading
import time
from collections import defaultdict
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.errors import MetricError

BUCKETS = (0.001, 0.005, 0.01, 0.05, 0.1, 0.5, 1.0, 5.0, 10.0)


def counter(df: DataFrame, value: str, *labels: str) -> DataFrame:
    """Sums by label set."""
    return df.groupBy(*labels).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("samples"))


def histogram(df: DataFrame, value: str, buckets: tuple[float, ...], *labels: str) -> DataFrame:
    """Cumulative counts of values up to each bound, the total count and the sum, by label set."""
    counts = [F.count_if(F.col(value) <= b).alias(f"le_{i}") for i, b in enumerate(buckets)]
    return df.groupBy(*labels).agg(*counts, F.count(value).alias("count"), F.sum(value).alias("sum"))


def bucket_percentile(p: float, buckets: tuple[float, ...]) -> Column:
    """The p-quantile (0 to 1) of a histogram row, interpolated within its bucket; the last bound where
    it lies beyond; null without samples."""
    target = F.col("count") * p
    out = F.lit(float(buckets[-1]))
    for i in range(len(buckets) - 1, -1, -1):
        low, below = (buckets[i - 1], F.col(f"le_{i - 1}")) if i else (0.0, F.lit(0))
        inside = F.col(f"le_{i}") - below
        value = F.lit(low) + F.when(inside > 0, (target - below) / inside).otherwise(0.0) * (buckets[i] - low)
        out = F.when(F.col(f"le_{i}") >= target, value).otherwise(out)
    return F.when(F.col("count") > 0, out)


def _escaped(value) -> str:
    """A label's value as the text format wants it."""
    return str(value).replace("\\", "\\\\").replace('"', '\\"').replace("\n", "\\n")


class Registry:
    """Metrics of a running database, rendered in the Prometheus text format."""

    def __init__(self) -> None:
        self._lock = threading.Lock()
        self._values: dict[str, dict[tuple, float]] = defaultdict(lambda: defaultdict(float))
        self._kinds: dict[str, tuple[str, str]] = {}
        self._bounds: dict[str, tuple[float, ...]] = {}
        self._histograms: dict[str, dict[tuple, list[float]]] = defaultdict(dict)

    @staticmethod
    def _labels(labels: dict[str, str]) -> tuple:
        return tuple(sorted(labels.items()))

    def inc(self, name: str, amount: float = 1.0, text: str = "", **labels: str) -> None:
        if amount < 0:
            raise MetricError("a counter cannot decrease")
        with self._lock:
            self._kinds.setdefault(name, ("counter", text))
            self._values[name][self._labels(labels)] += amount

    def set(self, name: str, value: float, text: str = "", **labels: str) -> None:
        with self._lock:
            self._kinds.setdefault(name, ("gauge", text))
            self._values[name][self._labels(labels)] = value

    def add(self, name: str, by: float, text: str = "", **labels: str) -> None:
        """Raises or lowers a gauge."""
        with self._lock:
            self._kinds.setdefault(name, ("gauge", text))
            self._values[name][self._labels(labels)] += by

    def reset(self) -> None:
        """Forgets all values."""
        with self._lock:
            for held in (self._values, self._kinds, self._bounds, self._histograms):
                held.clear()

    def observe(self, name: str, value: float, text: str = "", buckets: tuple[float, ...] = BUCKETS, **labels: str) -> None:
        with self._lock:
            self._kinds.setdefault(name, ("histogram", text))
            bounds = self._bounds.setdefault(name, tuple(sorted(buckets)))
            row = self._histograms[name].setdefault(self._labels(labels), [0.0] * (len(bounds) + 3))
            row[bisect.bisect_left(bounds, value)] += 1
            row[-2] += value
            row[-1] += 1

    @contextmanager
    def timed(self, name: str, **labels: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            self.observe(name, time.perf_counter() - began, **labels)

    def get(self, name: str, **labels: str) -> float:
        return self._values[name].get(self._labels(labels), 0.0) if name in self._values else 0.0

    def percentile(self, name: str, p: float, **labels: str) -> float | None:
        """The p-quantile (0 to 1), interpolated within its bucket."""
        row, bounds = self._histograms[name].get(self._labels(labels)), self._bounds.get(name, ())
        if not row or not row[-1]:
            return None
        target, below = p * row[-1], 0.0
        for i, bound in enumerate(bounds):
            if row[i] and below + row[i] >= target:
                low = bounds[i - 1] if i else 0.0
                return low + (target - below) / row[i] * (bound - low)
            below += row[i]
        return bounds[-1]

    def render(self) -> str:
        """All metrics in the Prometheus text format."""
        out = []
        tags = lambda labels: "{" + ",".join(f'{k}="{_escaped(v)}"' for k, v in labels) + "}" if labels else ""
        with self._lock:
            for name, (kind, text) in sorted(self._kinds.items()):
                out += ["# HELP {} {}".format(name, text.replace("\\", "\\\\").replace("\n", "\\n"))] * bool(text) + [f"# TYPE {name} {kind}"]
                for labels, v in sorted(self._values.get(name, {}).items()):
                    out.append(f"{name}{tags(labels)} {v:g}")
                for labels, row in sorted(self._histograms.get(name, {}).items()):
                    total = 0.0
                    for bound, n in zip([*map(str, self._bounds[name]), "+Inf"], row, strict=False):
                        total += n
                        out.append(f"{name}_bucket{tags((*labels, ('le', bound)))} {total:g}")
                    out += [f"{name}_sum{tags(labels)} {row[-2]:g}", f"{name}_count{tags(labels)} {row[-1]:g}"]
        return "\n".join(out) + "\n" * bool(out)
