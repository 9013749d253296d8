"""Streams in many batches, stopped and started again, against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from geoloom.plans.streams import KEYED, LOCAL_SESSIONS
from geoloom.streaming import oplog


@pytest.fixture()
def own(spark):
    """A session of its own, as the settings of a stream stay there."""
    session = spark.newSession()
    session.conf.set("spark.sql.shuffle.partitions", "4")
    for k, v in (KEYED | LOCAL_SESSIONS).items():
        session.conf.set(k, v)
    return session


def run_in_parts(own, tmp_path, rows, schema, build, parts=3):
    """Write the rows file by file and run the stream to the end of each part, from its checkpoint."""
    source, out = str(tmp_path / "in"), str(tmp_path / "run")
    size = -(-len(rows) // (2 * parts))
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    result = None
    for k in range(0, len(files), 2):
        for one in files[k : k + 2]:
            own.createDataFrame(one, schema).coalesce(1).write.mode("append").parquet(source)
        stream = own.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(source)
        result = oplog.run_to_table(build(stream), out)
    return result


def test_live_set_over_restarts(own, tmp_path):
    rng = random.Random(3)
    rows = []
    for seq in range(240):
        op = rng.choice(["insert", "insert", "delete", "query"])
        x, y = rng.uniform(-20, 20), rng.uniform(-20, 20)
        w = 9.0 if op == "query" else rng.choice([0.5, 3.0])
        rows.append((seq, op, 10_000 + seq if op == "query" else rng.randint(0, 12), x + w, y, x, y + w))
    got = run_in_parts(own, tmp_path, rows, "seq long, op string, id long, x1 double, y1 double, x2 double, y2 double", lambda s: oplog.live_set_answers(s, 4.0, shares=3))
    want, live = [], {}
    for _, op, i, x2, y1, x1, y2 in rows:
        if op == "insert":
            live[i] = (x1, y1, x2, y2)
        elif op == "delete":
            live.pop(i, None)
        else:
            want += [(i, j) for j, b in live.items() if b[0] <= x2 and x1 <= b[2] and b[1] <= y2 and y1 <= b[3]]
    assert want and sorted(map(tuple, got.collect())) == sorted(want)


def test_closed_boxes_leave_the_state(own, tmp_path):
    """One object that moves all the time: the cells hold one open box in the end."""
    rows = [(seq, "insert", 1, float(seq % 7) * 10, 0.0, float(seq % 7) * 10 + 1, 1.0) for seq in range(60)] + [(60, "query", 99, -5.0, -5.0, 100.0, 100.0)]
    got = run_in_parts(own, tmp_path, rows, "seq long, op string, id long, x1 double, y1 double, x2 double, y2 double", lambda s: oplog.live_set_answers(s, 10.0))
    assert [tuple(r) for r in got.collect()] == [(99, 1)]
    state = own.read.format("statestore").option("operatorId", 0).option("stateVarName", "boxes").load(str(tmp_path / "run" / "state"))
    assert state.count() == 1


def test_versions_over_restarts(own, tmp_path):
    rng = random.Random(4)
    rows = [(seq, rng.choice(["insert", "insert", "delete"]), rng.choice([1, 1, 2, 3]), 10 * (seq // 2), float(seq)) for seq in range(120)]
    got = run_in_parts(own, tmp_path, rows, "seq long, op string, id long, t long, value double", oplog.closed_versions)
    want, last = [], {}
    for seq, op, i, t, value in rows:
        if i in last and last[i][1] == "insert":
            want.append((i, last[i][0], last[i][2], t, last[i][3]))
        last[i] = (seq, op, t, value)
    assert sorted(map(tuple, got.collect())) == sorted(want)


def test_sessions_over_restarts(own, tmp_path):
    rng = random.Random(5)
    t, rows = 0, []
    for seq in range(200):
        t += rng.choice([5, 20, 400])
        rows.append((seq, t, rng.randint(0, 1), 1.0))
    rows.append((999, t + 100_000, 5, 1.0))  # the watermark passes all sessions
    rows.append((1000, t + 100_001, 5, 1.0))

    def build(stream):
        at = stream.withColumn("at", F.timestamp_seconds("t"))
        return oplog.cell_sessions(at, "at", F.col("c"), "60 seconds", "10 seconds")

    got = run_in_parts(own, tmp_path, rows, "seq long, t long, c int, value double", build)
    want = []
    for c in (0, 1):
        times = [r[1] for r in rows if r[2] == c]
        start = times[0]
        n = 0
        for a, b in zip(times, [*times[1:], None]):
            n += 1
            if b is None or b - a >= 60:
                want.append((start, a + 60, c, n))
                start, n = b, 0
    found = got.select(F.unix_seconds("start"), F.unix_seconds("end"), "cell", "n").where("cell < 2")
    assert sorted(map(tuple, found.collect())) == sorted(want)


def test_queries_meet_only_boxes_that_were_open(monkeypatch):
    """Boxes that follow each other: a cell compares its queries with those open meanwhile, and takes a query as it comes."""
    import numpy as np
    import pandas as pd

    n, sizes, floor = 4000, [], np.floor
    monkeypatch.setattr(np, "floor", lambda v: sizes.append(v.size) or floor(v))
    share = oplog.CellShare(10.0)
    share._boxes = type("Held", (), {"iterator": lambda self: iter(())})()
    opened = pd.DataFrame({"id": np.arange(n), "since": 4 * np.arange(n), "x1": 1.0, "y1": 1.0, "x2": 2.0, "y2": 2.0})
    end = {(i, 4 * i): 4 * i + 2 for i in range(n) if i != 7}
    asked = pd.DataFrame({"id": 10_000 + np.arange(n), "seq": 4 * np.arange(n) + 1, "x1": 0.0, "y1": 0.0, "x2": 5.0, "y2": 5.0}).sample(frac=1, random_state=1)
    got = pd.concat(list(share._answers((0, 0, 0), opened, end, asked)))
    want = {(10_000 + i, i) for i in range(n)} | {(10_000 + i, 7) for i in range(7, n)}
    assert len(got) == len(want) and set(zip(got["query_id"], got["id"])) == want
    assert sum(sizes) < n * n / 2


def test_only_changes_are_keyed_by_id(own, tmp_path):
    """Queries have no state: the changes hold a row for each object and none for a query."""
    rows = [(0, "insert", 1, 0.0, 0.0, 1.0, 1.0)] + [(s, "query", 100 + s, 0.0, 0.0, 5.0, 5.0) for s in range(1, 40)]
    rows += [(40, "query", None, 0.0, 0.0, 5.0, 5.0), (41, "delete", 1, None, None, None, None)]
    schema = "seq long, op string, id long, x1 double, y1 double, x2 double, y2 double"
    own.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = oplog.live_set_answers(own.readStream.schema(schema).parquet(str(tmp_path / "in")), 10.0)
    got = oplog.run_to_table(stream, str(tmp_path / "run"))
    assert sorted(map(tuple, got.collect())) == [(100 + s, 1) for s in range(1, 40)]
    changes = own.read.format("statestore").option("operatorId", 1).option("stateVarName", "last").load(str(tmp_path / "run" / "state"))
    assert [r.key.id for r in changes.collect()] == [1]
    assert "Union" in stream._jdf.queryExecution().analyzed().toString()
