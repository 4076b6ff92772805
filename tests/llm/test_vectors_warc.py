import random

import numpy as np
import pytest

from lucidframe.llm import vectors as V
from lucidframe.llm import warc as A


def brute(rows, t):
    out = {}
    for i, (a, x) in enumerate(rows):
        for b, y in rows[:i]:
            if a is None or b is None or a == b or not x or not y or len(x) != len(y):
                continue
            x_, y_ = np.array(x, float), np.array(y, float)
            if not (np.isfinite(x_).all() and np.isfinite(y_).all() and x_.any() and y_.any()):
                continue
            c = x_ @ y_ / np.linalg.norm(x_) / np.linalg.norm(y_)
            if c >= t - 1e-12:
                out[min(a, b), max(a, b)] = max(out.get((min(a, b), max(a, b)), -1), c)
    return out


def joined(rows, t):
    ids = {i for i, _ in rows if i is not None}
    root, links = {i: i for i in ids}, dict.fromkeys(ids, 0)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in brute(rows, t):
        links[a] += 1
        links[b] += 1
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {i: (find(i), links[i]) for i in ids}


def clustered(dim, seed, n=60):
    rng, rows = np.random.default_rng(seed), []
    for _ in range(n):
        base = rng.normal(size=dim)
        for _ in range(rng.integers(1, 6)):
            rows.append((len(rows), [float(np.float32(v)) for v in base * rng.choice([1, 3]) + rng.normal(size=dim) * rng.choice([0, 0.1, 0.3, 0.6])]))
    return rows


def result(df, **how):
    out = V.near_vectors(df, **how)
    assert out.columns == ["vec_id", "class_id", "links"]
    rows = out.collect()
    assert len(rows) == len({r.vec_id for r in rows})
    return {r.vec_id: (r.class_id, r.links) for r in rows}


@pytest.mark.parametrize("dim,t,cell,most", [(64, 0.975, 3000, 16000), (64, 0.9, 20, 16000), (64, 0.95, 20, 4), (16, 0.95, 30, 9), (3, 0.99, 10, 16000), (1, 0.9, 3000, 16000), (70, 0.5, 50, 12)])
def test_classes_links_and_pairs_as_by_brute_force(spark, monkeypatch, dim, t, cell, most):
    monkeypatch.setattr(V, "CELL_ROWS", cell)
    monkeypatch.setattr(V, "CELL_MOST", most)
    rows = clustered(dim, dim)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    assert result(df, t=t) == joined(rows, t)
    got, want = {(r.vec_a, r.vec_b): r.cosine for r in V.near_pairs(df, t=t).collect()}, brute(rows, t)
    least = {}
    for i, v in rows:
        least.setdefault(tuple(v), i)
    assert got == pytest.approx({k: x for k, x in want.items() if set(k) <= set(least.values())})


def test_its_sql_on_near_vectors(spark):
    import duckdb
    import pyarrow as pa

    rows = clustered(64, 5)
    con = duckdb.connect()
    con.register("embeddings", pa.table({"vec_id": pa.array([i for i, _ in rows]), "embedding": pa.array([v for _, v in rows], pa.list_(pa.float32()))}))
    want = {r[0]: r[1:] for r in con.sql(V.ORACLE_SQL).fetchall()}
    assert want == result(spark.createDataFrame(rows, "vec_id long, embedding array<float>")) and sum(n for _, n in want.values()) > 40


def test_copies_of_a_vector_by_number_of_vectors():
    rng = np.random.default_rng(1)
    x = V.unit(rng.normal(size=(2000, 64)), 64)
    copies = [sum(len(r) for _, r, _ in V.placed(x, V.cuts(64), 64, 0.975, V.grid(n, 64, 0.975))) / 2000 for n in (50_000, 500_000, 5_000_000, 500_000_000)]
    assert copies[0] < 25 and copies[2] < 110 and copies[3] < 220


def test_odd_vectors(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, [2.0, 4.0]), (3, None), (4, []), (5, [0.0, 0.0]), (6, [nan, 1.0]), (7, [inf, 1.0]), (None, [1.0, 2.0]), (1, [1.0, 2.0]), (8, [1.0, 2.0, 0.0]), (9, [1.0, 2.0, 0.0]), (10, [-1.0, -2.0])]
    rows += [(12, [1e200, 2e200]), (13, [1e-200, 2e-200]), (14, [1e308, -1e308]), (15, [5e-310, -5e-310])]
    df = spark.createDataFrame([(i, v, "c", 0) for i, v in rows] + [(11, [None, 1.0], "c", 0)], "vec_id long, embedding array<double>, cell string, a int")
    alone = {i: (i, 0) for i in (3, 4, 5, 6, 7, 10, 11)}
    assert result(df) == alone | {1: (1, 3), 2: (1, 3), 12: (1, 3), 13: (1, 3), 8: (8, 1), 9: (8, 1), 14: (14, 1), 15: (14, 1)}
    assert sorted((r.vec_a, r.vec_b, round(r.cosine, 9)) for r in V.near_pairs(df).collect()) == [(1, 2, 1.0), (1, 12, 1.0), (1, 13, 1.0), (2, 12, 1.0), (2, 13, 1.0), (12, 13, 1.0), (14, 15, 1.0)]
    assert result(df.limit(0)) == {} and V.near_pairs(df.limit(0)).count() == 0


def test_an_id_with_two_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (1, [0.0, 1.0]), (2, [0.0, 3.0]), (3, [2.0, 0.0])], "vec_id long, embedding array<double>")
    assert result(df) == {1: (1, 2), 2: (1, 1), 3: (1, 1)}


def random_origin(rng, page):
    body = bytes(rng.randrange(256) for _ in range(rng.choice([0, 1, 999, 1000, 1001, 5000, 20_000])))
    return body, A.segments_of(page, rng.choice([None, f"http://x/{page}"]), body, rng.choice([50, 500, 2048]), rng.choice([7, 1000]))


def reassembled(spark, records, extra=None):
    rows = [(bytearray(r) if r is not None else None, "x", "y") for r in records]
    out = A.reassemble(A.parse(spark.createDataFrame(rows, "record binary, origin string, status string")))
    return {r.origin: r for r in out.collect()}


def test_segments_in_any_order_and_repeated(spark):
    rng = random.Random(3)
    bodies, records = {}, []
    for page in range(60):
        bodies[page], parts = random_origin(rng, page)
        records += parts + rng.sample(parts, len(parts) // 3)
    rng.shuffle(records)
    got = reassembled(spark, records)
    assert len(got) == 60
    for page, body in bodies.items():
        r = got[f"<urn:page:{page}:1>"]
        assert r.status == "ok" and r.http_status == 200 and bytes(r.body) == body


def test_what_is_wrong_is_named(spark):
    body = b"x" * 5000
    parts = lambda k: A.segments_of(k, "u", body, 1000, 700)
    missing, no_first, conflict, length, no_total, chunked = (parts(k) for k in range(6))
    records = missing[:2] + missing[3:] + no_first[1:]
    records += conflict + [conflict[2].replace(b"xxxx", b"xxyx", 1)]
    records += length[:-1] + [length[-1].replace(b"Total-Length: 5", b"Total-Length: 6")]
    records += no_total[:-1]
    records += [p.replace(b"\r\n2bc\r\n", b"\r\n2bd\r\n", 1) for p in chunked]
    records += [None, b"", b"junk", b"WARC/1.0\r\nWARC-Type: response\r\n\r\nxx", parts(7)[0][:-300], b"WARC/1.1\r\nWARC-Type: continuation\r\nWARC-Record-ID: <q>\r\nContent-Length: 0\r\n\r\n"]
    got = {k.split(":")[2]: r for k, r in reassembled(spark, records).items()}
    assert {k: r.status for k, r in got.items()} == {"0": "missing", "1": "missing", "2": "conflict", "3": "length", "4": "no_total", "5": "chunked"}
    assert all(r.body is None for r in got.values())
    assert A.reassemble(A.parse(spark.createDataFrame([], "record binary"))).count() == 0


def test_chunked_framing():
    assert A.unchunk(b"4\r\nWiki\r\n5;x=1\r\npedia\r\n0\r\nTrailer: 1\r\n\r\n") == b"Wikipedia"
    assert A.unchunk(b"0\r\n\r\n") == b""
    for bad in (b"", b"4\r\nWik", b"4\r\nWikix\r\n0\r\n\r\n", b"z\r\n", b"4\r\nWiki\r\n0\r\n", b"-1\r\n\r\n"):
        with pytest.raises(A.Broken):
            A.unchunk(bad)
    assert A.http_body(b"HTTP/1.0 404 Not Found\r\nContent-Length: 2\r\n\r\nno") == (404, b"no")
    assert A.http_body(b"plain block") == (None, b"plain block")


def test_unsegmented_records_and_pages_of_any_content(spark):
    record = b"WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <r>\r\nX: a\r\n b\r\nContent-Length: 5\r\n\r\nhello\r\n\r\n"
    r = reassembled(spark, [record, record])["<r>"]
    assert (r.status, bytes(r.body), r.n_segments, r.target) == ("ok", b"hello", 1, None)
    pages = [(1, "http://a", "é" * 30_000), (2, None, ""), (3, "http://b", None), (None, "http://c", "x"), (-4, "http://d", "<p>\r\n0\r\n\r\n</p>"), (1, "http://a", "é" * 30_000)]
    out = A.pages_reassembled(spark.createDataFrame([(*p, "o") for p in pages], "page_id long, url string, html string, origin string"))
    assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(((i, u, "ok", 200, h) for i, u, h in pages), key=str)


def test_numbers_out_of_range(spark):
    head = b"WARC/1.0\r\nWARC-Type: response\r\nWARC-Record-ID: <%s>\r\n%sContent-Length: %d\r\n\r\n%s\r\n\r\n"
    odd = [b"WARC-Segment-Number: 99999999999\r\n", b"WARC-Segment-Number: -1\r\n", b"WARC-Segment-Number: 1\r\nWARC-Segment-Total-Length: 99999999999999999999\r\n", b"WARC-Segment-Number: " + b"9" * 5000 + b"\r\n", b"WARC-Segment-Number: 1_0\r\n"]
    records = [head % (b"%d" % i, x, 2, b"no") for i, x in enumerate(odd)]
    blocks = [b"HTTP/1.1 99999999999 OK\r\n\r\nx", b"HTTP/1.1 " + b"1" * 5000 + b" OK\r\n\r\nx", b"HTTP/1.1\r\n\r\nx", b"HTTP/1.1 200 OK\r\nTransfer-Encoding: chunked\r\n\r\n" + b"f" * 9000 + b"\r\nx"]
    records += [head % (b"b%d" % i, b"", len(x), x) for i, x in enumerate(blocks)]
    got = reassembled(spark, records)
    assert {k: (r.status, r.http_status, r.body and bytes(r.body)) for k, r in got.items()} == {"<b0>": ("ok", None, b"x"), "<b1>": ("ok", None, b"x"), "<b2>": ("ok", None, b"x"), "<b3>": ("chunked", None, None)}


def test_archives_of_records_and_gzip_members(spark, tmp_path):
    import gzip

    rng = random.Random(8)
    bodies, records = {}, []
    for page in range(20):
        bodies[page], parts = random_origin(rng, page)
        records += parts
    (tmp_path / "a.warc").write_bytes(b"".join(records[::2]))
    (tmp_path / "b.warc.gz").write_bytes(b"".join(gzip.compress(r) for r in records[1::2]) + gzip.compress(b"x" * 99)[:-20])
    (tmp_path / "c.warc").write_bytes(b"junk\r\n\r\n" + records[0])
    (tmp_path / "d.warc").write_bytes(b"")
    raw = A.archive_records(spark, str(tmp_path))
    got = {r.origin: r for r in A.reassemble(A.parse(raw)).collect()}
    assert {int(k.split(":")[2]): bytes(r.body) for k, r in got.items()} == bodies and all(r.status == "ok" for r in got.values())
    assert A.parse(raw).where("status = 'bad'").count() == 2
