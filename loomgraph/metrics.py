"""Metrics of tasks: values by name, and how they add up."""

import time
from dataclasses import dataclass
from threading import Lock

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Kinds in the order they are shown, and which of them keep the least or the greatest value.
ORDER = ("output_rows", "elapsed_compute", "spill_count", "spilled_bytes", "spilled_rows", "mem_used", "count", "gauge", "time", "start_timestamp", "end_timestamp")
TIMESTAMPS = ("start_timestamp", "end_timestamp")


@dataclass(frozen=True)
class Metric:
    task: str
    name: str
    value: int
    kind: str = "count"
    labels: tuple[tuple[str, str], ...] = ()


class MetricsSet:
    """A growing set of metrics; safe to share between threads."""

    def __init__(self) -> None:
        self._metrics: list[Metric] = []
        self._lock = Lock()

    def add(self, task: str, name: str, value: int, kind: str | None = None, **labels: str) -> None:
        with self._lock:
            self._metrics.append(Metric(task, name, int(value), kind or (name if name in ORDER else "count"), tuple(sorted(labels.items()))))

    def counter(self, task: str, name: str, **labels: str) -> "Counter":
        """A counter that only grows."""
        return Counter(self, task, name, "count", labels)

    def gauge(self, task: str, name: str, **labels: str) -> "Gauge":
        """A value that is set, or kept at its greatest."""
        return Gauge(self, task, name, "gauge", labels)

    def _put(self, metric: Metric) -> None:
        """``metric`` in place of that of the same task, name, kind and labels."""
        with self._lock:
            same = lambda m: (m.task, m.name, m.kind, m.labels) == (metric.task, metric.name, metric.kind, metric.labels)
            self._metrics = [m for m in self._metrics if not same(m)] + [metric]

    def timer(self, task: str) -> "Timer":
        return Timer(self, task)

    def __iter__(self):
        return iter(list(self._metrics))

    def sum(self, wanted) -> int | None:
        """The total of the metrics that ``wanted`` accepts; None without any."""
        found = [m.value for m in self if wanted(m)]
        return sum(found) if found else None

    def sum_by_name(self, name: str) -> int | None:
        return self.sum(lambda m: m.name == name)

    def output_rows(self) -> int | None:
        return self.sum_by_name("output_rows")

    def elapsed_compute(self) -> int | None:
        return self.sum_by_name("elapsed_compute")

    def aggregate_by_name(self) -> "MetricsSet":
        """One metric a name: sums, but the least start and the greatest end."""
        out, found = MetricsSet(), {}
        for m in self:
            old = found.get(m.name)
            pick = {"start_timestamp": min, "end_timestamp": max}.get(m.kind, lambda a, b: a + b)
            found[m.name] = Metric("", m.name, m.value if old is None else pick(old.value, m.value), m.kind)
        out._metrics = list(found.values())
        return out

    def sorted_for_display(self) -> "MetricsSet":
        out = MetricsSet()
        out._metrics = sorted(self, key=lambda m: (ORDER.index(m.kind), m.name))
        return out

    def timestamps_removed(self) -> "MetricsSet":
        out = MetricsSet()
        out._metrics = [m for m in self if m.kind not in TIMESTAMPS]
        return out

    def info(self, spark: SparkSession) -> DataFrame:
        """(task_name, metric_name, metric_value), with totals of rows and time under "All"."""
        rows = [(m.task, m.name, m.value) for m in self]
        rows += [("All", n, v) for n, v in (("elapsed_compute", self.elapsed_compute()), ("output_rows", self.output_rows())) if v is not None]
        return spark.createDataFrame(rows, "task_name string, metric_name string, metric_value long")


class Counter:
    def __init__(self, metrics: MetricsSet, task: str, name: str, kind: str, labels: dict[str, str]):
        self.metrics, self.task, self.name, self.kind, self.labels, self.value, self._lock = metrics, task, name, kind, tuple(sorted(labels.items())), 0, Lock()

    def _to(self, value: int) -> None:
        self.value = value
        self.metrics._put(Metric(self.task, self.name, value, self.kind, self.labels))

    def add(self, n: int = 1) -> None:
        with self._lock:
            self._to(self.value + n)


class Gauge(Counter):
    def set(self, value: int) -> None:
        with self._lock:
            self._to(value)

    def set_max(self, value: int) -> None:
        with self._lock:
            self._to(max(self.value, value))


class Timer:
    """Adds start, end and elapsed nanoseconds of a ``with`` block."""

    def __init__(self, metrics: MetricsSet, task: str):
        self.metrics, self.task = metrics, task

    def __enter__(self) -> "Timer":
        self.start = time.time_ns()
        self.metrics.add(self.task, "start_timestamp", self.start)
        return self

    def __exit__(self, *_) -> None:
        end = time.time_ns()
        self.metrics.add(self.task, "end_timestamp", end)
        self.metrics.add(self.task, "elapsed_compute", end - self.start)


def aggregate_metrics(df: DataFrame, name: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """A table of metrics by name: sums, the least start, the greatest end."""
    total = F.when(F.col(name) == "start_timestamp", F.min(value)).when(F.col(name) == "end_timestamp", F.max(value)).otherwise(F.sum(value))
    return df.groupBy(name).agg(total.alias(value))


def sum_metrics(df: DataFrame, names: list[str], name: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """(name, value): the total of each of the named metrics; null for those that there are none of."""
    asked = df.sparkSession.createDataFrame([(n,) for n in names], f"`{name}` string")
    return asked.join(df.where(F.col(name).isin(names)).groupBy(name).agg(F.sum(value).alias(value)), name, "left").select(name, value)


def without_timestamps(df: DataFrame, name: str = "metric_name") -> DataFrame:
    return df.where(~F.col(name).isin(*TIMESTAMPS))


def displayed_metrics(df: DataFrame, name: str = "metric_name", value: str = "metric_value") -> DataFrame:
    """(place, name, value) of metrics that are summed up by name, a few rows, in the order in which they are shown: known kinds first, others as counts, then by name."""
    kind = F.coalesce(F.get(F.map_values(F.map_filter(F.create_map(*[x for i, n in enumerate(ORDER) for x in (F.lit(n), F.lit(i))]), lambda k, _: k == F.col(name))), F.lit(0)), F.lit(ORDER.index("count")))
    place = F.row_number().over(Window.orderBy(kind, name)) - 1
    return df.select(place.cast("long").alias("place"), name, value)


def metric_info(df: DataFrame) -> DataFrame:
    """(task_name, metric_name, metric_value) with the totals of rows and time under "All"."""
    rows = df.select("task_name", "metric_name", "metric_value")
    whole = rows.where(F.col("metric_name").isin("output_rows", "elapsed_compute")).groupBy("metric_name").agg(F.sum("metric_value").alias("metric_value"))
    return rows.unionByName(whole.withColumn("task_name", F.lit("All")))
