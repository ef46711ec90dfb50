import json

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from novelspark.operators import novelty, packing
from novelspark.operators import selection, traces
from novelspark.sources import archives, embeddings_file, ordered_text, snapshots, spans
from novelspark.streaming.novelty import answer_cache_stream, first_fit_stream, metric_cache_stream


def test_vector_files(spark, tmp_path):
    rows = pd.DataFrame({"label": [1, 2], "lang": [0, 3], "norm": np.array([1.0, 2.0], np.float32), "x": [np.array([1.0, 2.0]), np.array([3.0, -0.0])]})
    (tmp_path / "a.bin").write_bytes(embeddings_file.encode(rows, 2, b"TEST"))
    got = embeddings_file.read_vectors(spark, str(tmp_path), b"TEST").orderBy("seq").collect()
    assert [(r.label, r.lang, r.norm, r.x) for r in got] == [(1, 0, 1.0, [1.0, 2.0]), (2, 3, 2.0, [3.0, 0.0])]
    with pytest.raises(ValueError):
        embeddings_file.decode((tmp_path / "a.bin").read_bytes()[:-1], b"TEST")
    files = embeddings_file.vector_files(spark.createDataFrame([(1, 0, 1.0, [1.0, 2.0]), (2, 3, 2.0, [3.0, 0.0])], "label bigint, lang bigint, norm float, x array<double>"), 2, b"TEST").collect()
    assert sum(len(embeddings_file.decode(bytes(f.content), b"TEST")) for f in files) == 2
    (tmp_path / "raw").mkdir()
    (tmp_path / "raw" / "b.bin").write_bytes(np.arange(6, dtype="<f8").tobytes())
    assert [r.x for r in embeddings_file.read_float64(spark, str(tmp_path / "raw"), 3).orderBy("seq").collect()] == [[0.0, 1.0, 2.0], [3.0, 4.0, 5.0]]


def test_snapshots():
    s = snapshots.IntervalState(0.0, 1.0, 0.1, [(-0.0, 0.2), (0.5, 0.6)], 7, 2, 9)
    raw = snapshots.dump_intervals(s, b"TESTTEST")
    assert snapshots.load_intervals(raw, b"TESTTEST") == s
    for bad in (raw[:-1], raw[:20] + b"x" + raw[21:]):
        with pytest.raises(ValueError):
            snapshots.load_intervals(bad, b"TESTTEST")
    with pytest.raises(ValueError):
        snapshots.load_intervals(snapshots.dump_intervals(snapshots.IntervalState(0, 1, 0.1, [(0.0, 0.5), (0.5, 0.6)]), b"TESTTEST"), b"TESTTEST")


def test_spans(spark, tmp_path):
    otlp = {"resourceSpans": [{"resource": {"attributes": [{"key": "service.name", "value": {"stringValue": "s"}}]}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "a", "parentSpanId": "", "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "status": {"code": 2}, "attributes": [{"key": "k", "value": {"intValue": "3"}}]}]}]}]}
    (tmp_path / "o.json").write_text(json.dumps(otlp))
    r = spans.read_otlp(spark, str(tmp_path / "o.json")).first()
    assert (r.trace_id, r.parent_span_id, r.service, r.start_ns, r.end_ns, r.status_code, r.attributes) == ("t", None, "s", 5, 9, 2, {"k": "3"})
    jaeger = {"data": [{"traceID": "t", "processes": {"p": {"serviceName": "s"}}, "spans": [{"traceID": "t", "spanID": "b", "operationName": "n", "processID": "p", "startTime": 2, "duration": 3, "references": [{"refType": "CHILD_OF", "spanID": "a"}], "tags": [{"key": "error", "type": "bool", "value": "true"}]}]}]}
    (tmp_path / "j.json").write_text(json.dumps(jaeger))
    r = spans.read_jaeger(spark, str(tmp_path / "j.json")).first()
    assert (r.span_id, r.parent_span_id, r.service, r.start_ns, r.end_ns, r.status_code) == ("b", "a", "s", 2000, 5000, 2)


def _run(out, tmp_path, name):
    q = out.writeStream.format("parquet").option("path", str(tmp_path / name)).option("checkpointLocation", str(tmp_path / f"{name}-check")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None


def test_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(1)
    rows = [(i, "ab"[i % 2], float(v)) for i, v in enumerate(rng.uniform(0, 20, 80))]
    df = spark.createDataFrame(rows, "seq bigint, k string, v double")
    df.where("seq < 40").coalesce(1).write.parquet(str(tmp_path / "in"))
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run(first_fit_stream(read(), "k", "seq", "v", 1.0), tmp_path, "out")
    df.where("seq >= 40").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    _run(first_fit_stream(read(), "k", "seq", "v", 1.0), tmp_path, "out")  # goes on from the checkpoint
    got = {r.seq: r.is_novel for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.seq: r.is_novel for r in packing.first_fit(df, "seq", novelty.vector("v"), 1.0, keys=["k"]).collect()}
    assert got == want


def test_answer_cache(spark, tmp_path):
    rows = [(0, "k", "a", 0.0), (1, "k", "b", 1.0), (2, "k", "a", 2.0), (3, "k", "c", 3.0), (4, "k", "b", 4.0), (5, "k", "a", 20.0)]
    df = spark.createDataFrame(rows, "seq bigint, k string, item string, at double")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    _run(answer_cache_stream(stream, "k", "seq", "item", "at", ttl=10.0, limit=2), tmp_path, "out")
    got = [r.hit for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    assert got == [False, False, True, False, False, False]


def test_metric_cache(spark, tmp_path):
    """Nearness, payloads, expiry and the least recently used entry, over two batches."""
    rows = [
        (0, [1.0, 0.0], "one", 0.0), (1, [0.99, 0.1], "x", 1.0), (2, [0.0, 1.0], "two", 2.0), (3, [-1.0, 0.0], "three", 3.0),
        (4, [1.0, 0.0], "again", 4.0), (5, [0.0, 1.0], "y", 5.0), (6, [0.1, 1.0], "z", 30.0),
    ]
    df = spark.createDataFrame([(i, "k", v, p, t) for i, v, p, t in rows], "seq bigint, k string, v array<double>, p string, at double")
    read = lambda: spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    for part, mode in (("seq < 4", "error"), ("seq >= 4", "append")):
        df.where(part).coalesce(1).write.mode(mode).parquet(str(tmp_path / "in"))
        _run(metric_cache_stream(read(), "k", "seq", "v", "p", "at", 0.2, "l2", ttl=10.0, limit=2, compute=str.upper), tmp_path, "out")
    got = [(r.hit, r.payload) for r in spark.read.parquet(str(tmp_path / "out")).orderBy("seq").collect()]
    # 3 drives out "one" (0, last read by 1); 4 drives out "two"; 5 drives out "three"; at 30 all are expired
    assert got == [(False, "ONE"), (True, "ONE"), (False, "TWO"), (False, "THREE"), (False, "AGAIN"), (False, "Y"), (False, "Z")]


def test_vector_stream_equals_batch(spark, tmp_path):
    rng = np.random.default_rng(2)
    rows = [(i, "ab"[i % 2], v.tolist()) for i, v in enumerate(rng.uniform(0, 3, (60, 3)))]
    df = spark.createDataFrame(rows, "seq bigint, k string, v array<double>")
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    _run(first_fit_stream(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "k", "seq", "v", 1.0, distance="l2"), tmp_path, "out")
    got = {r.seq: r.is_novel for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    want = {r.seq: r.is_novel for r in packing.first_fit(df, "seq", F.col("v"), 1.0, 3, "l2", keys=["k"]).collect()}
    assert got == want


def test_span_attributes_of_all_kinds(spark, tmp_path):
    values = [
        {"key": "k", "value": {"intValue": "3"}}, {"key": "k", "value": {"stringValue": "later"}}, {"key": "list", "value": {"arrayValue": {"values": [{"stringValue": "a"}, {"intValue": "2"}]}}},
        {"key": "map", "value": {"kvlistValue": {"values": [{"key": "x", "value": {"boolValue": True}}]}}}, {"key": "raw", "value": {"bytesValue": "AQI="}},
    ]
    otlp = {"resourceSpans": [{"resource": {"attributes": []}, "scopeSpans": [{"spans": [{"traceId": "t", "spanId": "a", "name": "n", "startTimeUnixNano": "5", "endTimeUnixNano": "9", "attributes": values}]}]}]}
    (tmp_path / "o.json").write_text(json.dumps(otlp))
    got = spans.read_otlp(spark, str(tmp_path / "o.json")).first().attributes
    assert got["k"] == "later" and got["raw"] == "AQI=" and "a" in got["list"] and "2" in got["list"] and "x" in got["map"]


def test_call_archives(spark, tmp_path):
    import io
    import tarfile

    rng = np.random.default_rng(0)
    want = []
    for a in range(2):
        with tarfile.open(tmp_path / f"calls-{a}.tar.gz", "w:gz") as tar:
            for m in range(2):
                lines = ["traceid,timestamp,rpcid,um,rpctype,dm,interface,rt"] if m == 0 else []
                for k in range(40):
                    row = [f"t{a}{m}{k % 7}", "5", f"0.{k}", "U", str(rng.choice(["rpc", "mc", "http"])), f"D{k % 3}", "i", "" if k == 3 else str(k / 2)]
                    lines.append(",".join(row if m == 0 else ["9", *row]))
                    want.append((row[0], row[2], "U", row[4], row[5], float(row[7] or 0), f"part{m}.csv"))
                lines += ["short,line", "t,1,0,U,rpc,D,i,no number", ""]
                raw = "\n".join(lines).encode()
                info = tarfile.TarInfo(f"part{m}.csv")
                info.size = len(raw)
                tar.addfile(info, io.BytesIO(raw))
            other = tarfile.TarInfo("notes.txt")
            tar.addfile(other, io.BytesIO(b""))
    calls = archives.read_calls(spark, f"file://{tmp_path}")
    got = calls.collect()
    assert sorted((r.trace, r.rpcid, r.um, r.rpctype, r.dm, r.rt, r.member) for r in got) == sorted(want)
    assert calls.rdd.getNumPartitions() == 2 and {r.archive.rsplit("/", 1)[1] for r in got} == {"calls-0.tar.gz", "calls-1.tar.gz"}
    plain = spark.createDataFrame([w[:6] for w in want], "trace string, rpcid string, um string, rpctype string, dm string, rt double")
    tree = lambda df: sorted(map(str, traces.call_tree(df).collect()))
    assert tree(calls.select(*plain.columns)) == tree(plain)


def test_ordered_text(spark, tmp_path):
    rows = [(i, f"v{i % 7}, \"x\"", None if i % 5 == 0 else i / 4) for i in np.random.default_rng(1).permutation(900).tolist()]
    df = spark.createDataFrame(rows, "i bigint, name string, v double").repartition(5)
    for n in (100, 10_000):
        ordered_text.write_csv(df, ["i"], f"file://{tmp_path}/csv{n}", lines_a_part=n)
        ordered_text.merged(spark, f"file://{tmp_path}/csv{n}", f"file://{tmp_path}/csv{n}.csv")
    text = (tmp_path / "csv100.csv").read_text()
    assert text == (tmp_path / "csv10000.csv").read_text()
    assert len(list((tmp_path / "csv100").glob("part-*"))) > 3
    back = pd.read_csv(tmp_path / "csv100.csv", escapechar="\\")
    assert back["i"].tolist() == list(range(900)) and list(back.columns) == ["i", "name", "v"]
    want = {i: (name, v) for i, name, v in rows}
    assert all(r.name_ == want[r.i][0] and (r.v == want[r.i][1] or want[r.i][1] is None) for r in back.rename(columns={"name": "name_"}).itertuples())
    lines = [r.value for r in ordered_text.read_text(spark, f"file://{tmp_path}/csv100").orderBy("part", "line").collect()]
    assert lines == text.splitlines()


def test_wcnf_file(spark, tmp_path):
    points = spark.createDataFrame([(i, [float(v)]) for i, v in enumerate([0, 1, 2, 5])], "i bigint, x array<double>")
    cover = selection.edges(points, "linf", 1.0)
    ordered_text.write_wcnf(selection.wcnf(points, cover), f"file://{tmp_path}/w", lines_a_part=3)
    ordered_text.merged(spark, f"file://{tmp_path}/w", f"file://{tmp_path}/w.wcnf")
    near = [[0, 1], [0, 1, 2], [1, 2], [3]]
    hard = ["5 " + " ".join(str(j + 1) for j in row) + " 0" for row in near]
    apart = ["5 -1 -2 0", "5 -2 -3 0"]
    soft = [f"1 -{i} 0" for i in range(1, 5)]
    assert (tmp_path / "w.wcnf").read_text() == "\n".join(["p wcnf 4 10 5", *hard, *apart, *soft]) + "\n"


def test_net_files(spark, tmp_path):
    import struct
    import zlib

    from novelspark.sources import net_files

    rng = np.random.default_rng(0)
    a, b = rng.bytes(1000), rng.bytes(77)
    assert net_files.combined(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
    x, r = rng.standard_normal((57, 3)), rng.random(57)
    net = spark.createDataFrame([(i, float(q), v.tolist()) for i, (q, v) in enumerate(zip(r, x, strict=True))], "slot bigint, radius double, x array<double>").repartition(4)
    state = net_files.NetState("l2", 0.25, (-9.0,) * 3, (9.0,) * 3, 100, 60, 120, 58, 3, 0, "vptree", 4096)
    for n in (10, 1000):
        net_files.write_net(net, state, f"file://{tmp_path}/net{n}", b"TESTPACK", rows_a_part=n)
        raw = (tmp_path / f"net{n}").read_bytes()
        assert zlib.crc32(raw[:-4]) == struct.unpack("<I", raw[-4:])[0] and len(raw) == 104 + 48 + 57 * 32 + 4
        got, rows = net_files.read_net(spark, f"file://{tmp_path}/net{n}", b"TESTPACK", rows_a_part=20)
        assert got == state
        assert [(w.slot, w.radius, w.x) for w in rows.orderBy("slot").collect()] == [(i, float(r[i]), x[i].tolist()) for i in range(57)]
    assert (tmp_path / "net10").read_bytes() == raw and {p.name for p in tmp_path.iterdir()} == {"net10", "net1000"}
    # version 1: no radii
    old = struct.pack("<8sHHId8QIIQ", b"TESTPACK", 1, 104, 0, 0.5, 2, 9, 4, 9, 4, 4, 0, 0, 1, 0, 0) + struct.pack("<4d", 0, 0, 1, 1) + np.arange(8.0).tobytes()
    (tmp_path / "old").write_bytes(old + struct.pack("<I", zlib.crc32(old)))
    got, rows = net_files.read_net(spark, f"file://{tmp_path}/old", b"TESTPACK", rows_a_part=3)
    assert (got.distance, got.backend) == ("linf", "linear")
    assert [(w.slot, w.radius, w.x) for w in rows.orderBy("slot").collect()] == [(i, 0.5, [2.0 * i, 2.0 * i + 1]) for i in range(4)]
    for broken in (raw[:-1], raw[:200] + b"x" + raw[201:], b"OTHERMAG" + raw[8:], raw[:8] + b"\x03" + raw[9:]):
        (tmp_path / "bad").write_bytes(broken)
        with pytest.raises(ValueError):
            net_files.read_net(spark, f"file://{tmp_path}/bad", b"TESTPACK")
    with pytest.raises(ValueError, match="gaps"):
        net_files.write_net(net.where("slot != 5"), state, f"file://{tmp_path}/gap", b"TESTPACK")
