"""Jobs: queued, running, then succeeded, failed, cancelled or (after a restart) interrupted.

A job has a folder with job.json, progress.log and its result as Parquet; job.json is written aside and renamed.
"""

from __future__ import annotations

import itertools
import json
import threading
import time
import uuid
from concurrent.futures import ThreadPoolExecutor
from dataclasses import asdict, dataclass, fields

from pyspark.sql import DataFrame

from lucidframe.errors import SemanticError
from lucidframe.operators.context import Ticker
from lucidframe.sql.desugar import plain
from lucidframe.sql.tokens import closing, tokenize, value_of

FINAL = ("succeeded", "failed", "cancelled", "interrupted")
DDL = ("CREATE", "DROP", "ALTER", "INSERT", "COPY")


@dataclass
class Job:
    job_id: str
    status: str
    sql: str
    submitted_at: float
    started_at: float | None = None
    finished_at: float | None = None
    rows: int | None = None
    command_tag: str | None = None
    error: str | None = None
    progress: str | None = None
    index_hits: int = 0
    rows_pruned: int = 0
    model_calls: int = 0
    cache_hits: int = 0
    extract_model_calls: int = 0
    result_path: str | None = None


SCHEMA = "job_id string, status string, sql string, submitted_at timestamp, started_at timestamp, finished_at timestamp, rows long, command_tag string, error string, progress string, index_hits long, rows_pruned long, model_calls long, cache_hits long, extract_model_calls long, result_path string"


class Folder:
    """Small files below a path, on whatever file system Hadoop finds it."""

    def __init__(self, spark, path: str):
        self.jvm, self.gateway = spark.sparkContext._jvm, spark.sparkContext._gateway
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        base = self.jvm.org.apache.hadoop.fs.Path(path)
        self.fs = base.getFileSystem(self.conf)
        self.path = self.fs.makeQualified(base).toString()
        self.fs.mkdirs(base)

    def at(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")

    def names(self) -> list[str]:
        return sorted(x.getPath().getName() for x in self.fs.listStatus(self.at(".")))

    def read(self, name: str) -> str | None:
        if not self.fs.exists(self.at(name)):
            return None
        source = self.fs.open(self.at(name))
        try:
            return bytes(source.readAllBytes()).decode()
        finally:
            source.close()

    def write(self, name: str, text: str) -> None:
        """Written aside and renamed, so that no reader sees a part."""
        new = self.at(f"{name}.{uuid.uuid4().hex[:8]}.new")
        out = self.fs.create(new, True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        rename = self.jvm.org.apache.hadoop.fs.Options.Rename
        how = self.gateway.new_array(rename, 1)
        how[0] = rename.OVERWRITE
        self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(self.fs.getUri(), self.conf).rename(new, self.at(name), how)

    def drop(self, name: str) -> None:
        self.fs.delete(self.at(name), True)


class Jobs:
    """make(): an engine for one job; folder: where jobs live, on a file system all executors see."""

    def __init__(self, spark, make, folder: str, most: int = 4):
        self.spark, self.make = spark, make
        self.files = Folder(spark, folder)
        self.folder = self.files.path
        self.logs: dict[str, list[str]] = {}
        self.jobs: dict[str, Job] = {}
        self.lock = threading.RLock()
        self.pool = ThreadPoolExecutor(most)
        self.numbers = itertools.count(1)
        self.recover()

    def recover(self) -> None:
        known = {f.name for f in fields(Job)}
        for name in self.files.names():
            text = self.files.read(f"{name}/job.json")
            if text is None:
                continue
            job = Job(**{k: v for k, v in json.loads(text).items() if k in known})
            if job.status not in FINAL:
                job.status, job.error, job.result_path = "interrupted", "the server stopped while the job ran", None
                job.finished_at = time.time()
                self.files.drop(f"{name}/result")
                self.save(job)
            self.jobs[job.job_id] = job

    def save(self, job: Job) -> None:
        self.files.write(f"{job.job_id}/job.json", json.dumps(asdict(job)))

    def note(self, job: Job, line: str) -> None:
        with self.lock:
            if line == job.progress:
                return
            job.progress = line
            self.logs.setdefault(job.job_id, []).append(line)
            self.files.write(f"{job.job_id}/progress.log", "".join(x + "\n" for x in self.logs[job.job_id]))

    def submit(self, sql: str) -> str:
        with self.lock:
            job = Job(f"job_{int(time.time() * 1000)}_{next(self.numbers):04}", "queued", sql, time.time())
            self.jobs[job.job_id] = job
            self.save(job)
            self.pool.submit(self.run, job)
        return job.job_id

    def run(self, job: Job) -> None:
        with self.lock:
            if job.status != "queued":
                return
            job.status, job.started_at = "running", time.time()
            self.save(job)
        sc = self.spark.sparkContext
        sc.setJobGroup(job.job_id, job.sql[:200], interruptOnCancel=True)
        error, rows, path = None, None, None
        counters: dict = {}
        try:
            engine = self.make()
            self.note(job, "started")
            with Ticker(engine.ctx, lambda line: job.status == "running" and self.note(job, line)):
                df = engine.sql(job.sql)
                if tokenize(job.sql)[0].word not in DDL:
                    path = f"{self.folder}/{job.job_id}/result"
                    df.write.parquet(path)
                    rows = self.spark.read.schema(df.schema).parquet(path).count()
            counters = dict(engine.ctx.counters)
        except Exception as e:
            error = str(e)[:2000] or type(e).__name__
        with self.lock:
            if job.status == "cancelled":  # a cancel beats the end
                self.files.drop(f"{job.job_id}/result")
                return
            job.status, job.error, job.finished_at = ("failed" if error else "succeeded"), error, time.time()
            if not error:
                job.rows, job.result_path = rows, path
                job.command_tag = f"SELECT {rows}" if path else " ".join(t.word for t in tokenize(job.sql)[:2])
            for k in ("index_hits", "rows_pruned", "model_calls", "cache_hits", "extract_model_calls"):
                setattr(job, k, int(counters.get(k, 0)))
            self.note(job, job.status)
            self.save(job)

    def cancel(self, job_id: str) -> None:
        with self.lock:
            job = self.jobs.get(job_id)
            if job is None:
                raise SemanticError(f"there is no such job: {job_id}")
            if job.status in FINAL:
                raise SemanticError(f"job {job_id} has already finished: {job.status}")
            job.status, job.finished_at = "cancelled", time.time()
            self.save(job)
        self.spark.sparkContext.cancelJobGroup(job_id)

    def wait(self, job_id: str, seconds: float = 120) -> Job:
        end = time.time() + seconds
        while time.time() < end:
            with self.lock:  # a status is seen when it is saved
                if self.jobs[job_id].status in FINAL:
                    break
            time.sleep(0.05)
        return self.jobs[job_id]

    def table(self) -> DataFrame:
        from datetime import datetime, timezone

        at = lambda x: None if x is None else datetime.fromtimestamp(round(x, 3), timezone.utc)
        with self.lock:
            rows = [tuple(at(v) if k.endswith("_at") else v for k, v in asdict(j).items()) for j in self.jobs.values()]
        return self.spark.createDataFrame(rows, SCHEMA)

    def result(self, job_id: str) -> DataFrame:
        job = self.jobs.get(job_id)
        if job is None:
            raise SemanticError(f"job_result: there is no job {job_id}")
        if job.status not in FINAL:
            raise SemanticError(f"job_result: job {job_id} has not finished: {job.status}")
        if job.status != "succeeded":
            raise SemanticError(f"job_result: job {job_id} has no result: {job.status}")
        if job.result_path is None:
            raise SemanticError(f"job_result: job {job_id} was a statement without rows")
        return self.spark.read.parquet(job.result_path)


class JobEngine:
    """An engine's sql() plus SUBMIT, CANCEL JOB, the view jobs and job_result('id')."""

    def __init__(self, engine, jobs: Jobs):
        self.engine, self.jobs = engine, jobs

    def sql(self, sql: str) -> DataFrame:
        tokens = tokenize(sql)
        spark = self.engine.spark
        if tokens and tokens[0].word == "SUBMIT":
            body = sql[tokens[0].end :].strip().rstrip(";")
            if not body:
                raise SemanticError("expected SUBMIT statement")
            return spark.createDataFrame([(self.jobs.submit(body),)], "job_id string")
        if tokens and tokens[0].word == "CANCEL":
            rest = [t for t in tokens if t.text != ";"]
            if len(rest) != 3 or rest[1].word != "JOB" or rest[2].kind not in ("word", "string"):
                raise SemanticError("expected CANCEL JOB 'id'")
            self.jobs.cancel(value_of(rest[2]) if rest[2].kind == "string" else rest[2].text)
            return spark.createDataFrame([], "result string")
        for i, t in enumerate(tokens[:-1]):
            if t.word == "JOB_RESULT" and tokens[i + 1].text == "(":
                end = closing(tokens, i + 1)
                if end != i + 3 or tokens[i + 2].kind != "string":
                    raise SemanticError("job_result takes one job id in quotes")
                view = self.engine.view(self.jobs.result(value_of(tokens[i + 2])))
                return self.sql(sql[: t.start] + view + sql[tokens[end].end :])
        if any(t.word == "JOBS" for t in tokens):
            self.jobs.table().createOrReplaceTempView("jobs")
        return self.engine.sql(sql)


__all__ = ["Job", "JobEngine", "Jobs", "plain"]
