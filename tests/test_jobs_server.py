import json
import socket
import struct
import threading
import time

import pytest

from lucidframe.errors import SemanticError
from lucidframe.jobs.registry import JobEngine, Jobs
from lucidframe.model.base import Mock
from lucidframe.operators.context import Semantic
from lucidframe.server.wire import Server, rendered
from lucidframe.sql.engine import Engine


@pytest.fixture
def made(spark, tmp_path):
    spark.createDataFrame([(1, "a price"), (2, "b"), (3, None)], "id long, body string").createOrReplaceTempView("notes")
    ctx = Semantic(spark, Mock())

    def make():
        return Engine(Semantic(spark, ctx.model, ctx.root, types=ctx.types, indexes=ctx.indexes))

    jobs = Jobs(spark, make, str(tmp_path / "jobs"), most=1)
    return JobEngine(Engine(ctx), jobs)


def test_a_job_runs_detached_and_keeps_its_result(made):
    (job,) = made.sql("SUBMIT SELECT id FROM notes WHERE body MEANS 'price';").first()
    done = made.jobs.wait(job)
    assert (done.status, done.rows, done.command_tag, done.model_calls) == ("succeeded", 1, "SELECT 1", 2), done.error
    assert [r.id for r in made.sql(f"SELECT id FROM job_result('{job}')").collect()] == [1]
    row = made.sql(f"SELECT * FROM jobs WHERE job_id = '{job}'").first()
    assert len(row) == 16 and row.status == "succeeded" and row.sql == "SELECT id FROM notes WHERE body MEANS 'price'"
    (bad,) = made.sql("SUBMIT SELECT nope FROM notes").first()
    assert made.jobs.wait(bad).status == "failed" and "nope" in made.jobs.jobs[bad].error
    (ddl,) = made.sql("SUBMIT CREATE SEMANTIC INDEX ON notes(body)").first()
    assert made.jobs.wait(ddl).status == "succeeded"
    for sql, text in ((f"SELECT * FROM job_result('{bad}')", "no result: failed"), (f"SELECT * FROM job_result('{ddl}')", "without rows"), ("SELECT * FROM job_result('x')", "no job x"), ("SELECT * FROM job_result(1)", "one job id"), ("CANCEL JOB 'x'", "no such job"), ("CANCEL JOB", "expected CANCEL JOB"), (f"CANCEL JOB '{job}'", "already finished")):
        with pytest.raises(SemanticError, match=text):
            made.sql(sql)


def test_cancelled_while_queued_never_starts(made):
    gate = threading.Event()
    made.jobs.pool.submit(gate.wait)
    job = made.jobs.submit("SELECT 1 AS x")
    with pytest.raises(SemanticError, match="not finished"):
        made.jobs.result(job)
    made.sql(f"CANCEL JOB {job}")
    gate.set()
    time.sleep(0.3)
    assert made.jobs.jobs[job].status == "cancelled" and made.jobs.jobs[job].started_at is None


def test_restart_interrupts_what_was_running(made):
    job = made.jobs.submit("SELECT 1 AS x")
    made.jobs.wait(job)
    files = made.jobs.files
    assert files.fs.exists(files.at(f"{job}/result"))
    files.write(f"{job}/job.json", json.dumps(json.loads(files.read(f"{job}/job.json")) | {"status": "running"}))
    again = Jobs(made.engine.spark, made.jobs.make, made.jobs.folder)
    assert again.jobs[job].status == "interrupted" and not files.fs.exists(files.at(f"{job}/result"))
    assert files.read(f"{job}/progress.log").splitlines()[0] == "started" and files.read(f"{job}/none") is None


class Client:
    def __init__(self, port):
        self.s = socket.create_connection(("127.0.0.1", port), 60)
        self.s.sendall(struct.pack("!ii", 8, 80877103))
        assert self.s.recv(1) == b"N"
        body = struct.pack("!i", 196608) + b"user\0me\0\0"
        self.s.sendall(struct.pack("!i", len(body) + 4) + body)
        self.until_ready()

    def exactly(self, n):
        out = b""
        while len(out) < n:
            out += self.s.recv(n - len(out))
        return out

    def until_ready(self):
        out = []
        while True:
            kind = self.exactly(1)
            (n,) = struct.unpack("!i", self.exactly(4))
            body = self.exactly(n - 4)
            out.append((kind.decode(), body))
            if kind == b"Z":
                return out

    def query(self, sql):
        body = sql.encode() + b"\0"
        self.s.sendall(b"Q" + struct.pack("!i", len(body) + 4) + body)
        return self.until_ready()


def cells(body):
    (n,), at, out = struct.unpack("!h", body[:2]), 2, []
    for _ in range(n):
        (size,) = struct.unpack("!i", body[at : at + 4])
        at += 4
        out.append(None if size < 0 else body[at : at + size].decode())
        at += max(0, size)
    return out


def test_wire(made):
    server = Server(("127.0.0.1", 0), made)
    threading.Thread(target=server.serve_forever, daemon=True).start()
    c = Client(server.server_address[1])
    got = c.query("SELECT id, body, id = 1 AS one FROM notes WHERE id <> 2 ORDER BY id; SET x = 1")
    assert [cells(b) for k, b in got if k == "D"] == [["1", "a price", "t"], ["3", None, "f"]]
    assert [b for k, b in got if k == "C"] == [b"SELECT 2\0", b"SET\0"]
    got = c.query("SELECT id FROM notes WHERE body MEANS 'price'")
    assert any(k == "N" and b"SemanticFilter [price]" in b for k, b in got) and any(k == "N" and b"model_calls 2" in b for k, b in got)
    got = c.query("SELECT nope; SELECT 1")
    assert [k for k, _ in got] == ["E", "Z"]
    assert [k for k, _ in c.query("")] == ["I", "Z"]
    assert any(b"pg_catalog" in b for k, b in c.query("SELECT * FROM pg_catalog.pg_class") if k == "E")
    assert [cells(b) for k, b in c.query("SHOW server_version") if k == "D"] == [["16.0"]]
    job = [cells(b) for k, b in c.query("SUBMIT SELECT 5 AS x") if k == "D"][0][0]
    assert made.jobs.wait(job).status == "succeeded"
    assert [cells(b) for k, b in c.query(f"SELECT x FROM job_result('{job}')") if k == "D"] == [["5"]]
    server.shutdown()


def test_cells():
    import datetime

    assert rendered(datetime.datetime(2024, 1, 2, 3, 4, 5, 6)) == b"2024-01-02 03:04:05.000006"
    assert rendered([1, "é"]) == '[1, "é"]'.encode() and rendered(None) is None and rendered(True) == b"t"


class Slow(Mock):
    def complete(self, requests):
        time.sleep(0.4)
        return super().complete(requests)


def slow_engine(spark, tmp_path):
    spark.createDataFrame([(i, f"text {i}") for i in range(40)], "id long, body string").createOrReplaceTempView("slowly")
    ctx = Semantic(spark, Slow(), parallel=20)

    def make():
        return Engine(Semantic(spark, ctx.model, ctx.root, 20, types=ctx.types, indexes=ctx.indexes))

    return JobEngine(Engine(ctx), Jobs(spark, make, str(tmp_path / "jobs")))


def test_progress_while_a_statement_runs_and_clients_side_by_side(spark, tmp_path):
    made = slow_engine(spark, tmp_path)
    with Server(("127.0.0.1", 0), made) as server:
        threading.Thread(target=server.serve_forever, daemon=True).start()
        slow, quick = Client(server.server_address[1]), Client(server.server_address[1])
        took = {}

        def run(name, client, sql):
            begun = time.time()
            took[name] = (client.query(sql), time.time() - begun, time.time())

        first = threading.Thread(target=run, args=("slow", slow, "SELECT count(*) AS n FROM slowly WHERE body MEANS 'text 1'"))
        first.start()
        time.sleep(0.3)
        run("quick", quick, "SELECT 1 AS x")
        first.join()
        server.shutdown()
    notices = [body.decode(errors="replace") for kind, body in took["slow"][0] if kind == "N"]
    assert any("tasks " in x for x in notices) and any("model_calls 40" in x for x in notices)
    assert took["quick"][2] < took["slow"][2]
    job = made.jobs.submit("SELECT EXTRACT(a TEXT 'x' FROM body) AS a, CAST(id AS INT) AS b FROM slowly WHERE body MEANS 'text 2'")
    done = made.jobs.wait(job)
    assert done.status == "succeeded" and done.model_calls == 40 and done.extract_model_calls == 11, done
    assert len(made.jobs.files.read(f"{job}/progress.log").splitlines()) > 2


def test_indexes_are_reopened(spark):
    from lucidframe.operators.index import create_index, open_indexes

    ctx = Semantic(spark, Mock())
    create_index(ctx, spark.createDataFrame([("a",)], "body string"), "some_notes", "body")
    again = Semantic(spark, Mock(), ctx.root)
    assert open_indexes(again) == ["some_notes.body"] and list(again.indexes) == [("some_notes", "body")]
    assert open_indexes(Semantic(spark, Mock(embed_id="other"), ctx.root)) == []


def test_providers_of_the_command_line(monkeypatch):
    from lucidframe.server.wire import provider

    monkeypatch.setenv("VOYAGE_API_KEY", "k")
    assert provider("ollama", None, None, "voyage").embed_id == "voyage-3.5"
