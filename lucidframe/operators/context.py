"""Session of the semantic engine: model, verdict store, indexes, types, counters."""

from __future__ import annotations

import contextlib
import hashlib
import itertools
import logging
import os
import threading
import time
import uuid
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from lucidframe.model.base import Failure, Provider, Request
from lucidframe.operators.types import TypeRegistry

PLAN, STAGE, MODEL = (logging.getLogger(f"lucidframe.{x}") for x in ("plan", "stage", "model"))
IN_BATCH = 64
BATCH_BYTES = 1 << 20  # of texts that a Python worker is sent at a time
ROWS_A_FILE = 500_000
_ids = itertools.count(1)
_small: dict[int, tuple[int, str | None]] = {}  # by session: how many small_batches() are open, and the setting before them
_small_lock = threading.Lock()


def share_package(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path (on a cluster: --py-files)."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        env["PYTHONPATH"] = os.pathsep.join([root, *paths])


@contextlib.contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """While this is open, batches for Python workers end at BATCH_BYTES, else 10,000 texts come at once. Statements side by side share the setting."""
    name, key = "spark.sql.execution.arrow.maxBytesPerBatch", id(spark._jsparkSession)
    with _small_lock:
        depth, before = _small.get(key, (0, None))
        if not depth:
            before = spark.conf.get(name)
            spark.conf.set(name, str(BATCH_BYTES))
        _small[key] = depth + 1, before
    try:
        yield
    finally:
        with _small_lock:
            depth, before = _small.pop(key)
            if depth > 1:
                _small[key] = depth - 1, before
            else:
                spark.conf.set(name, before)


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which all executors see; the warehouse where none is named (tests)."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        named = spark.conf.get("spark.checkpoint.dir", None)
        sc.setCheckpointDir(named or spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints")
    return sc._jsc.sc().getCheckpointDir().get()


@dataclass
class Semantic:
    """root: a folder all executors see; verdicts and indexes are stored below it."""

    spark: SparkSession
    model: Provider
    root: str | None = None
    parallel: int | None = None  # tasks that call the model at a time; the cluster's cores where not given
    types: TypeRegistry = field(default_factory=TypeRegistry)
    indexes: dict = field(default_factory=dict)
    counters: Counter = field(default_factory=Counter)
    plan: list[str] = field(default_factory=list)  # one line a semantic stage, for EXPLAIN
    dry: bool = False  # plan only: no model is called

    def __post_init__(self):
        share_package(self.spark)
        self.parallel = self.parallel or max(1, self.spark.sparkContext.defaultParallelism)
        self.answered = self.spark.sparkContext.accumulator(0)
        self.root = (self.root or f"{shared_folder(self.spark)}/semantic-{uuid.uuid4().hex}").rstrip("/")

    def planned(self, line: str) -> None:
        """A semantic stage of the statement's plan."""
        PLAN.info(line)
        self.plan.append(line)

    def progress(self) -> str:
        """What the running statement has done so far; tasks report their calls when they end."""
        done = {k: v for k, v in self.counters.items() if v}
        answered = int(self.answered.value)
        tracker = self.spark.sparkContext.statusTracker()
        running = [i for i in map(tracker.getStageInfo, tracker.getActiveStageIds()) if i]
        parts = [f"{answered} calls answered"] * bool(answered) + [f"{k} {v:g}" for k, v in done.items()]
        tasks = f"tasks {sum(i.numCompletedTasks for i in running)} of {sum(i.numTasks for i in running)}"
        return ", ".join(parts + [tasks] * bool(running and self.plan))

    def path_exists(self, path: str) -> bool:
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(p)

    def stored(self, df: DataFrame, name: str) -> DataFrame:
        """df written once and read back: models are not called again by retries or second uses."""
        path = f"{self.root}/stages/{next(_ids)}-{name}-{uuid.uuid4().hex[:8]}"
        begun = time.perf_counter()
        with small_batches(self.spark):
            df.write.parquet(path)
        STAGE.info("%s written in %.2f s", name, time.perf_counter() - begun)
        return self.spark.read.schema(df.schema).parquet(path)


class Ticker:
    """Tells the progress of a context's statement every half second, while it changes."""

    def __init__(self, ctx: Semantic, tell: Callable[[str], object], seconds: float = 0.5):
        self.ctx, self.tell, self.seconds = ctx, tell, seconds
        self.over = threading.Event()
        self.thread = threading.Thread(target=self.run, daemon=True)

    def run(self) -> None:
        last = ""
        while not self.over.wait(self.seconds):
            line = self.ctx.progress() if self.ctx.plan else ""
            if line and line != last:
                self.tell(line)
                last = line

    def __enter__(self) -> Ticker:
        self.thread.start()
        return self

    def __exit__(self, *_) -> None:
        self.over.set()
        self.thread.join()


VERDICT = "h long, value string"


class Verdicts:
    """Usable answers by provenance: (type and version, field, model, prompt version) name a folder, the input's hash a row."""

    def __init__(self, ctx: Semantic):
        self.ctx = ctx

    def path(self, kind: str, what: str, version: str) -> str:
        key = "\x1f".join((kind, what, self.ctx.model.model_id, version))
        return f"{self.ctx.root}/verdicts/{hashlib.md5(key.encode()).hexdigest()}"

    def has(self, kind: str, what: str, version: str) -> bool:
        return self.ctx.path_exists(self.path(kind, what, version))

    def read(self, kind: str, what: str, version: str, wanted: DataFrame) -> DataFrame:
        """h, value of those that are wanted (h)."""
        spark = self.ctx.spark
        if not self.has(kind, what, version):
            return spark.createDataFrame([], VERDICT)
        stored = spark.read.schema(VERDICT).parquet(self.path(kind, what, version))
        return stored.join(wanted.select("h"), "h", "left_semi").dropDuplicates(["h"])

    def add(self, kind: str, what: str, version: str, rows: DataFrame, n: int | None = None) -> None:
        """Store rows; n, if known, bounds the number of files."""
        rows = rows.select("h", "value")
        if n is not None:
            rows = rows.coalesce(max(1, min(self.ctx.parallel, -(-n // ROWS_A_FILE))))
        rows.write.mode("append").parquet(self.path(kind, what, version))


def ask(ctx: Semantic, requests: DataFrame, build: Callable[[str, object], Request], parse: Callable[[str], str | None], extra: str | None = None, name: str = "answers") -> DataFrame:
    """h, value: a model call for each row of requests (h, input and perhaps one column more, given to build()); value is null where
    the call failed or its answer is unusable. Stored before it is used."""
    model, answered = ctx.model, ctx.answered

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, IN_BATCH):
                part = batch.slice(at, IN_BATCH)
                more = part.column(2).to_pylist() if extra else [None] * part.num_rows
                asked = [build(t, m) for t, m in zip(part.column(1).to_pylist(), more)]
                answers = model.complete(asked)
                answered.add(len(answers))
                for a in answers:
                    if isinstance(a, Failure):
                        MODEL.warning("%s: %s", model.model_id, a.reason)
                values = [None if isinstance(a, Failure) else parse(a) for a in answers]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(values, pa.string())], ["h", "value"])

    columns = ["h", "input"] + ([extra] if extra else [])
    answers = requests.select(*columns).repartition(ctx.parallel).mapInArrow(run, VERDICT)
    return ctx.stored(answers, name)
