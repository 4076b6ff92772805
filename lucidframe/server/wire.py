"""PostgreSQL simple-query protocol over one Spark session; trust authentication.

Results are drawn partition by partition, not collected whole. The first error ends the rest of a string of statements.
"""

from __future__ import annotations

import argparse
import datetime
import decimal
import json
import logging
import re
import socketserver
import struct

from pyspark.sql import types as T

from lucidframe.errors import SemanticError
from lucidframe.operators.context import Semantic, Ticker
from lucidframe.sql.tokens import split_statements, tokenize

log = logging.getLogger("lucidframe.server")
OIDS = {T.BooleanType: 16, T.ShortType: 21, T.ByteType: 21, T.IntegerType: 23, T.LongType: 20, T.DecimalType: 1700, T.FloatType: 700, T.DoubleType: 701, T.StringType: 25, T.TimestampNTZType: 1114, T.TimestampType: 1184, T.DateType: 1082}
CHATTER = ("SET", "BEGIN", "START", "COMMIT", "END", "ROLLBACK", "ABORT", "DISCARD", "RESET")
SHOWN = {"SERVER_VERSION": "16.0", "CLIENT_ENCODING": "UTF8", "TRANSACTION_ISOLATION": "read committed", "STANDARD_CONFORMING_STRINGS": "on", "DATESTYLE": "ISO, MDY", "TIMEZONE": "UTC"}


def rendered(value) -> bytes | None:
    """A cell as text."""
    if value is None:
        return None
    if isinstance(value, bool):
        return b"t" if value else b"f"
    if isinstance(value, datetime.datetime):
        return value.strftime("%Y-%m-%d %H:%M:%S.%f").encode()
    if isinstance(value, (str, int, float, decimal.Decimal, datetime.date)):
        return str(value).encode()
    if isinstance(value, (bytes, bytearray)):
        return b"\\x" + bytes(value).hex().encode()
    plain = lambda v: v.asDict(True) if hasattr(v, "asDict") else str(v)
    if isinstance(value, list):
        value = [plain(v) if hasattr(v, "asDict") else v for v in value]
    return json.dumps(value.asDict(True) if hasattr(value, "asDict") else value, default=str, ensure_ascii=False).encode()


def message(kind: bytes, body: bytes = b"") -> bytes:
    return kind + struct.pack("!i", len(body) + 4) + body


def fields(kind: bytes, **parts: str) -> bytes:
    return message(kind, b"".join(k.encode() + v.encode() + b"\0" for k, v in parts.items()) + b"\0")


def tag_of(sql: str, rows: int) -> str:
    words = [t.word for t in tokenize(sql)[:3]]
    if words[0] in ("SELECT", "WITH", "VALUES", "SUBMIT", "EXPLAIN", "SHOW", "DESCRIBE", "TABLE"):
        return f"SELECT {rows}"
    if words[0] == "INSERT":
        return f"INSERT 0 {rows}"
    return " ".join(w for w in words[:2] if w)


class Handler(socketserver.StreamRequestHandler):
    def handle(self) -> None:
        try:
            if self.startup():
                while self.request_once():
                    pass
        except (ConnectionError, struct.error):
            pass

    def read(self, n: int) -> bytes:
        data = self.rfile.read(n)
        if len(data) < n:
            raise ConnectionError
        return data

    def startup(self) -> bool:
        while True:
            size, code = struct.unpack("!ii", self.read(8))
            self.read(size - 8)
            if code in (80877103, 80877104):  # encryption is declined
                self.wfile.write(b"N")
                continue
            if code == 80877102:
                return False
            break
        out = message(b"R", struct.pack("!i", 0))
        for k, v in (("server_version", "16.0"), ("client_encoding", "UTF8"), ("DateStyle", "ISO, MDY"), ("standard_conforming_strings", "on")):
            out += message(b"S", k.encode() + b"\0" + v.encode() + b"\0")
        self.wfile.write(out + message(b"K", struct.pack("!ii", 1, 1)) + message(b"Z", b"I"))
        return True

    def request_once(self) -> bool:
        kind = self.read(1)
        (size,) = struct.unpack("!i", self.read(4))
        body = self.read(size - 4)
        if kind == b"X":
            return False
        if kind == b"Q":
            self.query(body[:-1].decode())
        else:
            self.error("only simple queries are supported", "0A000")
        self.wfile.write(message(b"Z", b"I"))
        return True

    def error(self, text: str, code: str = "42601") -> None:
        self.wfile.write(fields(b"E", S="ERROR", C=code, M=text))

    def notice(self, text: str) -> None:
        self.wfile.write(fields(b"N", S="NOTICE", C="00000", M=text))

    def query(self, text: str) -> None:
        try:
            statements = split_statements(text)
        except SemanticError as e:
            return self.error(str(e))
        if not statements:
            self.wfile.write(message(b"I"))
        for sql in statements:
            try:
                self.statement(sql)
            except Exception as e:  # any statement's failure is the client's to see
                log.info("statement failed: %s", e)
                return self.error(str(e).split("\nJVM stacktrace")[0][:4000] or type(e).__name__)

    def statement(self, sql: str) -> None:
        words = [t.word for t in tokenize(sql)]
        if words[0] in CHATTER:
            self.wfile.write(message(b"C", words[0].encode() + b"\0"))
            return
        if words[0] == "SHOW" and len(words) > 1 and "_".join(words[1:]) in SHOWN:
            self.describe([("_".join(words[1:]).lower(), 25)])
            self.rows([[SHOWN["_".join(words[1:])]]])
            self.wfile.write(message(b"C", b"SHOW\0"))
            return
        if re.search(r"\bpg_catalog\b", sql):
            raise SemanticError("pg_catalog is not available; use SHOW TABLES or DESCRIBE")
        engine, ctx = self.server.fresh()
        told = 0

        def tell(line: str) -> None:
            nonlocal told
            for x in [*ctx.plan[told:], line]:
                self.notice(x)
            told = len(ctx.plan)

        with Ticker(ctx, tell):
            df = engine.sql(sql)
        changed = [f"{k} {v:g}" for k, v in ctx.counters.items() if v]
        for line in [*ctx.plan[told:], *([", ".join(changed)] if changed else [])]:
            self.notice(line)
        n = 0
        if words[0] not in ("CREATE", "CANCEL", "DROP", "INSERT", "ALTER"):
            self.describe([(f.name, OIDS.get(type(f.dataType), 25)) for f in df.schema])
            for row in df.toLocalIterator():
                self.rows([row])
                n += 1
        self.wfile.write(message(b"C", tag_of(sql, n).encode() + b"\0"))

    def describe(self, columns: list[tuple[str, int]]) -> None:
        body = struct.pack("!h", len(columns))
        for name, oid in columns:
            body += name.encode() + b"\0" + struct.pack("!ihihih", 0, 0, oid, -1, -1, 0)
        self.wfile.write(message(b"T", body))

    def rows(self, rows) -> None:
        out = b""
        for row in rows:
            cells = [rendered(v) for v in row]
            out += message(b"D", struct.pack("!h", len(cells)) + b"".join(struct.pack("!i", -1) if c is None else struct.pack("!i", len(c)) + c for c in cells))
        self.wfile.write(out)


class Server(socketserver.ThreadingTCPServer):
    allow_reuse_address = True
    daemon_threads = True

    def __init__(self, address: tuple[str, int], engine):
        self.engine = engine
        super().__init__(address, Handler)

    def fresh(self):
        """(engine, context) of one statement: plan and counters are its own; types, indexes and the Spark session are shared, so clients run side by side."""
        given = getattr(self.engine, "engine", self.engine)
        old = given.ctx
        ctx = Semantic(old.spark, old.model, old.root, old.parallel, types=old.types, indexes=old.indexes)
        own = type(given)(ctx)
        return (type(self.engine)(own, self.engine.jobs) if own is not given and given is not self.engine else own), ctx


def provider(name: str, model: str | None, embed_model: str | None, embedder: str = "ollama"):
    from lucidframe.model import http
    from lucidframe.model.base import Mock

    if name == "mock":
        return Mock()
    if embedder == "voyage":
        http.key_from("VOYAGE_API_KEY")
        if name == "anthropic":
            http.key_from("ANTHROPIC_API_KEY")
        asked = (http.Anthropic if name == "anthropic" else http.Ollama)(*[x for x in (model,) if x])
        return http.Paired(asked, http.Voyage(*[x for x in (embed_model,) if x]))
    if name == "ollama":
        return http.Ollama(*[x for x in (model,) if x]) if not embed_model else http.Ollama(model or "qwen3:4b", embed_model)
    if name == "anthropic":
        http.key_from("ANTHROPIC_API_KEY")
        return http.Paired(http.Anthropic(*[x for x in (model,) if x]), http.Ollama(embed_id=embed_model or "nomic-embed-text"))
    raise SemanticError(f"unknown provider {name}")


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(description="Serve semantic SQL over the PostgreSQL protocol.")
    p.add_argument("--host", default="127.0.0.1")
    p.add_argument("--port", type=int, default=5433)
    p.add_argument("--provider", default="ollama", choices=("ollama", "anthropic", "mock"))
    p.add_argument("--model")
    p.add_argument("--embed-provider", default="ollama", choices=("ollama", "voyage"))
    p.add_argument("--embed-model")
    p.add_argument("--root", help="shared folder of verdicts and indexes")
    p.add_argument("--jobs-dir", help="shared folder of jobs; by default below the root")
    p.add_argument("--max-jobs", type=int, default=4)
    a = p.parse_args(argv)
    logging.basicConfig(level=logging.INFO)
    from pyspark.sql import SparkSession

    from lucidframe.jobs.registry import JobEngine, Jobs
    from lucidframe.operators.index import open_indexes
    from lucidframe.sql.engine import Engine

    spark = SparkSession.builder.appName("lucidframe").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    ctx = Semantic(spark, provider(a.provider, a.model, a.embed_model, a.embed_provider), a.root)
    log.info("indexes opened: %s", ", ".join(open_indexes(ctx)) or "none")

    def make() -> Engine:
        return Engine(Semantic(spark, ctx.model, ctx.root, types=ctx.types, indexes=ctx.indexes))

    engine = JobEngine(Engine(ctx), Jobs(spark, make, a.jobs_dir or f"{ctx.root}/jobs", a.max_jobs))
    with Server((a.host, a.port), engine) as server:
        log.info("listening on %s:%s", *server.server_address)
        server.serve_forever()


if __name__ == "__main__":
    main()
