"""Sessions: tasks that subscribe to subjects and publish on them, run superstep by superstep."""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Iterator
from concurrent.futures import FIRST_EXCEPTION, ThreadPoolExecutor, wait
from dataclasses import dataclass, field
from functools import reduce

from pyspark import inheritable_thread_target
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .metrics import MetricsSet
from .operators.messages import extend_chunks, has_message_columns, route_messages, summarize
from .sources.readers import ipc_metadata, read_csv_text, read_ipc_stream, read_json_values
from .sources.writers import to_csv_text, to_ipc_stream, to_json_objects
from .storage import state_path, store
from .subjects import BATCH, HIDDEN, ROW, Subject, last_batch, same_schema, visible, with_batches

ON_UPDATE, ALWAYS = "on_update", "always"


@dataclass(frozen=True)
class Subscribe:
    """What a processor reads: a subject, whether only once it was updated, and its last batch or all."""

    subject: str = ""
    when: str = ON_UPDATE
    last: bool = False
    custom: Callable[[Session], DataFrame] | None = field(default=None, compare=False)

    def read(self, session: Session) -> DataFrame | None:
        if self.custom:
            return self.custom(session)
        if not self.subject:
            return None
        df = session.state[self.subject].df
        return last_batch(df) if self.last else df


@dataclass(frozen=True)
class Publish:
    """How a processor's output changes a subject: extend, extend_chunks (of ``column``), replace, replace_last, none or custom."""

    subject: str = ""
    how: str = "extend"
    column: str | None = None
    custom: Callable[[Subject, DataFrame], Subject] | None = field(default=None, compare=False)

    def apply(self, old: Subject, new: DataFrame, path: str | None = None) -> Subject:
        """The subject after the update; it is stored, so its lineage ends here. ``path``: where ``new``, batch and row numbers included, is stored already; it then replaces rows without being written again."""
        path = path if set(HIDDEN) <= set(new.columns) else None
        new = with_batches(new)
        if self.how == "none":
            return old
        if self.how == "custom":
            return self.custom(old, new)
        if self.how == "extend_chunks":
            one = extend_chunks(new, self.column)
            rows = one.select(*[F.col(c) if c in one.columns else F.lit(None).cast(kind).alias(c) for c, kind in old.data.dtypes])
            return self._added(old, with_batches(rows))
        if not same_schema(old.df, new):
            raise ValueError(f"The schema of {old.name} is {old.schema.simpleString()}, not {visible(new).schema.simpleString()}.")
        if self.how == "extend":
            return self._added(old, new)
        if self.how == "replace" and path:
            return Subject(old.name, new.select(*old.df.columns), paths=(path,))
        if self.how == "replace":
            return Subject.stored(old.name, new.select(*old.df.columns))
        if self.how == "replace_last":
            kept = old.df.where(F.col(BATCH) < old.next_batch - 1)
            return self._added(Subject(old.name, kept, old.next_batch - 1), new)
        raise ValueError(f"There is no publication {self.how!r}.")

    @staticmethod
    def _added(old: Subject, new: DataFrame) -> Subject:
        shifted = new.withColumn(BATCH, F.col(BATCH) + old.next_batch)
        return Subject.stored(old.name, shifted.select(*old.df.columns), old)


@dataclass
class Message:
    """A table on its way to a subject; ``df`` has batch and row numbers. ``path``: the folder that it is stored in, if it is."""

    name: str
    subject: str
    publisher: str
    df: DataFrame
    publish: Publish
    path: str | None = None

    def to_ipc(self) -> bytes:
        """The table as an Arrow stream whose schema names the message."""
        return to_ipc_stream(self.df, {"name": self.name, "subject": self.subject, "publisher": self.publisher, "how": self.publish.how, "column": self.publish.column or ""})

    @classmethod
    def from_ipc(cls, spark: SparkSession, data: bytes) -> Message:
        said = ipc_metadata(data)
        return cls(said["name"], said["subject"], said["publisher"], read_ipc_stream(spark, data), Publish(said["subject"], said["how"], said["column"] or None))

    def routed(self) -> list[Message]:
        """The messages that rows (name, publisher, subject, values) stand for; itself, if it has other columns. Such control tables are small."""
        if not {"name", "publisher", "subject", "values"} <= set(self.df.columns):
            return [self]
        spark = self.df.sparkSession
        out = []
        for r in route_messages(self.df).where("subject is not null").collect():
            values = spark.createDataFrame([(r["values"],)], "values string")
            out.append(Message(r["name"], r["subject"], self.publisher, with_batches(values), Publish(r["subject"])))
        return out


class Processor:
    """An operator of a task: from messages to messages, lazily."""

    def __init__(self, name: str, publications: list[Publish] = (), subscriptions: list[Subscribe] = (), forward: list[str] = ()):
        self.name, self.publications, self.subscriptions, self.forward = name, list(publications), list(subscriptions), list(forward)

    def process(self, inbox: dict[str, Message], session: Session, task: str) -> dict[str, Message]:
        raise NotImplementedError

    def message(self, subject: str, df: DataFrame, publish: Publish | None = None) -> Message:
        publish = publish or next((p for p in self.publications if p.subject == subject), Publish(subject))
        return Message(subject, subject, self.name, with_batches(df), publish)

    def forwarded(self, inbox: dict[str, Message]) -> dict[str, Message]:
        return {k: m for k, m in inbox.items() if k in self.forward}


class Echo(Processor):
    """Passes everything on."""

    def process(self, inbox, session, task):
        return dict(inbox)


class FunctionProcessor(Processor):
    """A processor from a function of the inbox's tables to one table, or to a dict of tables by subject."""

    def __init__(self, name: str, function: Callable[..., DataFrame | dict], publications=(), subscriptions=(), forward=()):
        super().__init__(name, publications, subscriptions, forward)
        self.function = function

    def process(self, inbox, session, task):
        made = self.function(**{k.replace("-", "_"): m.df for k, m in inbox.items() if k not in self.forward})
        made = made if isinstance(made, dict) else {self.publications[0].subject: made}
        return self.forwarded(inbox) | {s: self.message(s, df) for s, df in made.items()}


class AddRows(Processor):
    """Appends a given row to every batch; for trials of the scheduler."""

    def __init__(self, name: str, row: dict, publications=(), subscriptions=(), forward=()):
        super().__init__(name, publications, subscriptions, forward)
        self.row = row

    def process(self, inbox, session, task):
        out = {}
        for k, m in inbox.items():
            if set(visible(m.df).columns) != set(self.row):
                continue
            more = m.df.groupBy(BATCH).agg((F.max(ROW) + 1).alias(ROW)).select(*[F.col(c) if c in HIDDEN else F.lit(self.row[c]).cast(dict(m.df.dtypes)[c]).alias(c) for c in m.df.columns])
            out[k] = Message(m.name, m.subject, self.name, m.df.unionByName(more), m.publish)
        return out


class Aggregator(Processor):
    """All messages as one on the first publication's subject; schemas must be equal, and so must their targets."""

    def wanted(self, m: Message) -> bool:
        return True

    def process(self, inbox, session, task):
        found = [m for k, m in inbox.items() if k not in self.forward and self.wanted(m)]
        rest = {k: m for k, m in inbox.items() if m not in found}
        if not found:
            return rest
        for m in found[1:]:
            if not same_schema(found[0].df, m.df):
                raise ValueError(f"The schemas of {found[0].name} and {m.name} differ.")
        target = self.publications[0] if self.publications else found[0].publish
        if not self.publications and any(m.publish != target for m in found):
            raise ValueError("The messages are not for one subject.")
        # batches of one message after those of another
        rows = [m.df.withColumn(BATCH, F.col(BATCH) * len(found) + i) for i, m in enumerate(found)]
        return rest | {target.subject: self.message(target.subject, reduce(DataFrame.unionByName, rows), target)}


class MessageAggregator(Aggregator):
    """The chat messages among its input as one; other tables pass on."""

    def wanted(self, m: Message) -> bool:
        return has_message_columns(m.df)


class Summary(Processor):
    """The one table that is left of its input, besides what it forwards, as one ``tool`` message on the first publication's subject."""

    def __init__(self, name: str, columns: list[str] | None = None, rows: int | None = None, publications=(), subscriptions=(), forward=()):
        super().__init__(name, publications, subscriptions, forward)
        self.columns, self.rows = columns, rows

    def process(self, inbox, session, task):
        left = [m for k, m in inbox.items() if k not in self.forward]
        if len(left) != 1:
            raise ValueError(f"{self.name} sums up one message, not {len(left)}.")
        subject = self.publications[0].subject
        return self.forwarded(inbox) | {subject: self.message(subject, summarize(left[0].df, self.columns, self.rows, stamp=F.lit("")))}


@dataclass
class TaskPlan:
    task_name: str
    processor_names: list[str]
    runtime_env: str = "default"


@dataclass
class RuntimeEnv:
    """Services that processors share, built once."""

    name: str = "default"
    services: dict = field(default_factory=dict)


class SessionBuilder:
    """Collects a session's parts and checks that plans and parts name each other exactly."""

    def __init__(self, name: str):
        self.name, self.plans, self.max_iter = name, None, 25
        self.processors: list[Processor] | None = None
        self.runtime_envs: list[RuntimeEnv] | None = None
        self.state: list[Subject] | None = None
        self.metrics = MetricsSet()

    def with_tasks(self, plans: list[TaskPlan]) -> SessionBuilder:
        self.plans = plans
        return self

    def with_processors(self, processors: list[Processor]) -> SessionBuilder:
        self.processors = processors
        return self

    def with_runtime_envs(self, envs: list[RuntimeEnv]) -> SessionBuilder:
        self.runtime_envs = envs
        return self

    def with_state(self, state: list[Subject]) -> SessionBuilder:
        self.state = state
        return self

    def with_max_iter(self, n: int) -> SessionBuilder:
        self.max_iter = n
        return self

    def build(self, spark: SparkSession) -> Session:
        for part, what in ((self.plans, "tasks"), (self.processors, "processors"), (self.runtime_envs, "runtime environments"), (self.state, "subjects")):
            if part is None:
                raise ValueError(f"The session {self.name} has no {what} yet.")
        planned = {p for plan in self.plans for p in plan.processor_names}
        used = [p for p in self.processors if p.name in planned]
        subjects = {x.subject for p in used for x in [*p.publications, *p.subscriptions] if x.subject}
        for wanted, given, text in (
            (planned, {p.name for p in self.processors}, "processors"),
            ({p.runtime_env for p in self.plans}, {e.name for e in self.runtime_envs}, "runtime environments"),
            (subjects, {s.name for s in self.state}, "subjects"),
        ):
            if wanted != given:
                raise ValueError(f"The {text} of session {self.name} and of its tasks differ: missing {sorted(wanted - given)}, not used {sorted(given - wanted)}.")
        return Session(spark, self)


@dataclass
class Task:
    """Processors in the order they were registered."""

    name: str
    processors: list[Processor]
    env: RuntimeEnv

    @property
    def subscriptions(self) -> list[Subscribe]:
        return list(dict.fromkeys(x for p in self.processors for x in p.subscriptions if x.subject or x.custom))

    @property
    def publications(self) -> list[Publish]:
        return list(dict.fromkeys(x for p in self.processors for x in p.publications if x.subject and x.how != "none"))


class Session:
    """State, tasks and the tracker of which subjects changed since a task last ran."""

    def __init__(self, spark: SparkSession, built: SessionBuilder):
        self.spark, self.name, self.metrics, self.max_iter = spark, built.name, built.metrics, built.max_iter
        envs = {e.name: e for e in built.runtime_envs}
        self.tasks = {p.task_name: Task(p.task_name, [x for x in built.processors if x.name in p.processor_names], envs[p.runtime_env]) for p in built.plans}
        self.state = {s.name: s for s in built.state}
        self.updated: dict[str, dict[str, bool]] = {t: {x.subject: False for x in task.subscriptions if x.when == ON_UPDATE} for t, task in self.tasks.items()}
        self.iter = 0

    # scheduling

    def ready(self) -> list[str]:
        """Tasks all of whose on-update subjects changed; a task without any always is."""
        return sorted(t for t, seen in self.updated.items() if all(seen.values()))

    def mark(self, changed: dict[str, set[str]]) -> None:
        """Tell the subscribers of changed subjects, unless they alone changed it."""
        for subject, publishers in changed.items():
            for task, seen in self.updated.items():
                if subject in seen and publishers - {task}:
                    seen[subject] = True

    def apply(self, messages: list[Message]) -> dict[str, set[str]]:
        """Update the state, in order of message names; messages to unknown subjects are passed over. Gives subject to publishers."""
        changed: dict[str, set[str]] = {}
        for m in sorted((x for m in messages for x in m.routed()), key=lambda m: m.name):
            if m.subject in self.state and m.publish.how != "none":
                self.state[m.subject] = m.publish.apply(self.state[m.subject], m.df, m.path)
                changed.setdefault(m.subject, set()).add(m.publisher)
        return changed

    def _inbox(self, task: Task) -> dict[str, Message]:
        inbox = {}
        for s in task.subscriptions:
            df = s.read(self)
            if df is not None:
                publish = next((p for p in task.publications if p.subject == s.subject), Publish(s.subject, "none"))
                inbox[s.subject or s.custom.__name__] = Message(s.subject, s.subject, task.name, df, publish)
        return inbox

    def _run(self, task: Task) -> list[Message]:
        """A task's messages, each stored; only those to subjects it publishes on, or, of the session's own task, all. What adds no rows is no message."""
        with self.metrics.timer(task.name):
            box = self._inbox(task)
            for p in task.processors:
                box = p.process(box, self, task.name)
            wanted, out = {p.subject for p in task.publications}, []
            for m in box.values():
                if m.subject in wanted or task.name == self.name or any(p.how == "none" and p.subject == m.subject for x in task.processors for p in x.publications):
                    path = state_path(self.spark)
                    df, n = store(m.df, path)
                    self.metrics.add(task.name, "output_rows", n)
                    if n == 0 and m.publish.how not in ("replace", "replace_last"):
                        continue
                    out.append(Message(f"from_{task.name}_on_{m.subject}", m.subject, task.name, df, m.publish, path))
        return out

    def superstep(self, messages: list[Message] = ()) -> dict[str, Message] | None:
        """Apply ``messages``, run the ready tasks side by side and apply what they publish; None if none was ready.

        The output of the task named like the session is returned instead of applied.
        """
        self.mark(self.apply(list(messages)))
        ready = self.ready()
        if not ready:
            for seen in self.updated.values():
                seen.update(dict.fromkeys(seen, False))
            return None
        made = self._side_by_side(ready)
        for t in ready:
            self.updated[t].update(dict.fromkeys(self.updated[t], False))
        made = [m for x in made for m in x]
        own = {m.name: m for m in made if m.publisher == self.name}
        self.mark(self.apply([m for m in made if m.publisher != self.name]))
        self.iter += 1
        return own

    def _side_by_side(self, ready: list[str]) -> list[list[Message]]:
        """The messages of tasks that run at the same time. If one fails, the Spark jobs of the others are cancelled, and its error is raised."""
        tag = f"loomgraph-{uuid.uuid4().hex}"

        def run(name: str) -> list[Message]:
            self.spark.sparkContext.addJobTag(tag)
            try:
                return self._run(self.tasks[name])
            finally:
                self.spark.sparkContext.removeJobTag(tag)

        with ThreadPoolExecutor(max_workers=min(8, len(ready))) as pool:
            running = [pool.submit(inheritable_thread_target(self.spark)(run), t) for t in ready]
            done, rest = wait(running, return_when=FIRST_EXCEPTION)
            failed = next((f.exception() for f in done if f.exception()), None)
            while failed and rest:
                # a task may be between two jobs
                self.spark.sparkContext.cancelJobsWithTag(tag)
                _, rest = wait(rest, timeout=0.5)
            if failed:
                raise failed
        return [f.result() for f in running]

    def stream(self, messages: list[Message] = ()) -> Iterator[dict[str, Message]]:
        """Supersteps until no task is ready or ``max_iter`` is reached; yields the session's own outputs where there are any."""
        messages = list(messages)
        while self.iter < self.max_iter:
            made = self.superstep(messages)
            if made is None:
                return
            if made:
                yield made
            messages = []

    # input and output

    def message(self, subject: str, df: DataFrame, how: str = "extend", column: str | None = None) -> Message:
        return Message(f"from_{self.name}_on_{subject}", subject, self.name, with_batches(df), Publish(subject, how, column))

    def run(self, subject: str, df: DataFrame, how: str = "extend") -> list[dict[str, Message]]:
        """All responses to one input, counting supersteps anew."""
        self.iter = 0
        return list(self.stream([self.message(subject, df, how)]))

    def _put(self, subject: str, df: DataFrame, how: str) -> None:
        self.mark(self.apply([self.message(subject, df, how)]))

    def put_csv(self, subject: str, text: str, how: str = "extend", sep: str = ",", header: bool = True, lenient: bool = False) -> None:
        """CSV rows by the subject's own schema. Tasks run at the next superstep."""
        self._put(subject, read_csv_text(self.spark, text, self.state[subject].schema, sep, header, lenient), how)

    def put_json(self, subject: str, values: str | list, how: str = "extend") -> None:
        self._put(subject, read_json_values(self.spark, values, self.state[subject].schema), how)

    def get_csv(self, subject: str, sep: str = ",", header: bool = True) -> str:
        return to_csv_text(self.state[subject].df, sep, header)

    def get_json(self, subject: str) -> list[dict]:
        return to_json_objects(self.state[subject].df)

    def subjects(self) -> DataFrame:
        """(subject_names, column_names, type_names, num_rows), a row per column."""
        rows = [(s.name, f.name, f.dataType.simpleString(), n) for s in sorted(self.state.values(), key=lambda s: s.name) for n in [s.count_rows()] for f in s.schema]
        return self.spark.createDataFrame(rows, "subject_names string, column_names string, type_names string, num_rows long")

    def tasks_info(self) -> DataFrame:
        """(task_names, processor_names, subject_names, pub_or_sub): - for what is read, + for what is written."""
        rows = [(t, p.name, x.subject, sign) for t in sorted(self.tasks) for p in self.tasks[t].processors for sign, found in (("-", p.subscriptions), ("+", p.publications)) for x in found]
        return self.spark.createDataFrame(rows, "task_names string, processor_names string, subject_names string, pub_or_sub string")

    def metrics_info(self) -> DataFrame:
        return self.metrics.info(self.spark)

    def subject_with_schema(self, df: DataFrame) -> list[str]:
        """Names of the subjects that have the schema of ``df``."""
        return sorted(s.name for s in self.state.values() if same_schema(s.df, df))

    # persistence

    def write_state(self, path: str, tag: str) -> None:
        for s in self.state.values():
            s.df.write.mode("overwrite").parquet(f"{path}/{tag}-{self.name}-{s.name}")

    def read_state(self, path: str, tag: str) -> None:
        for name in self.state:
            self.state[name] = Subject(name, self.spark.read.parquet(f"{path}/{tag}-{self.name}-{name}"))

    def tracker(self) -> DataFrame:
        rows = [(t, s, v) for t, seen in sorted(self.updated.items()) for s, v in sorted(seen.items())]
        return self.spark.createDataFrame(rows, "task_name string, subject_name string, status_value boolean")

    def write_tracker(self, path: str) -> None:
        self.tracker().coalesce(1).write.mode("overwrite").parquet(path)

    def read_tracker(self, path: str) -> None:
        for r in self.spark.read.parquet(path).collect():
            self.updated[r["task_name"]][r["subject_name"]] = r["status_value"]


def config_of(df: DataFrame) -> dict:
    """A one-row config subject as a dict; a ``values`` column holds JSON."""
    row = visible(df).first()
    found = row.asDict(recursive=True) if row else {}
    return json.loads(found["values"]) if set(found) == {"values"} else found


def responses(made: dict[str, Message], name: str) -> dict[str, Message]:
    """Of a superstep's messages those whose name contains the session's."""
    return {k: m for k, m in made.items() if name in k}
