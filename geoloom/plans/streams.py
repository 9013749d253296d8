"""Streaming queries over the events, run to the end of the data."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geoloom.plans.bindings import with_sql
from geoloom.plans.registry import micros, query
from geoloom.session import checkpoint_root, range_partitions
from geoloom.streaming import oplog

# keyed processors need this state store
KEYED = {
    "spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
}
# sessions of a hot cell are merged inside each task before the shuffle
LOCAL_SESSIONS = {"spark.sql.streaming.sessionWindow.merge.sessions.in.local.partition": "true"}


def _stream(spark, sf):
    schema = spark.read.parquet(f"{sf}/events.parquet").schema
    reader = spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet")
    return reader.option("maxFilesPerTrigger", 64).parquet(sf)


def _run(spark, sf, name, build, conf=None):
    """Run a stream in a session of its own, with state partitions sized to the data.

    The settings are that session's alone, so streams that run at the same time do not disturb each other.
    """
    own = spark.newSession()
    own.conf.set("spark.sql.shuffle.partitions", str(range_partitions(own.read.parquet(f"{sf}/events.parquet"))))
    for k, v in (conf or {}).items():
        own.conf.set(k, v)
    stream = build(own)
    path = f"{checkpoint_root(spark)}/{name}-{uuid.uuid4().hex}"
    oplog.run_to_table(stream, path)
    return spark.read.schema(stream.schema).parquet(f"{path}/out")


# users are objects, purchases are queries; an error deletes the object, other events move it
@query(
    "stream_oplog_state",
    with_sql("ev")
    + ", ch AS (SELECT event_id, user_id, event_type, value AS x, CAST(event_id % 101 AS DOUBLE) AS y, LEAD(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS upto FROM ev WHERE event_type <> 'purchase'), "
    "q AS (SELECT event_id AS query_id, value - 15 AS x1, value + 15 AS x2, event_id % 101 - 15 AS y1, event_id % 101 + 15 AS y2 FROM ev WHERE event_type = 'purchase') "
    "SELECT query_id, user_id AS id FROM q JOIN ch ON event_id < query_id AND (upto IS NULL OR upto > query_id) AND event_type <> 'error' AND x <= x2 AND x1 <= x + 8 AND y <= y2 AND y1 <= y + 6",
)
def stream_oplog_state(spark, sf):
    e, v, kind = F.col("event_id"), F.col("value"), F.col("event_type")
    is_q = kind == "purchase"
    y = (e % 101).cast("double")

    def build(own):
        log = _stream(own, sf).select(
            e.alias("seq"),
            F.when(is_q, oplog.QUERY).when(kind == "error", oplog.DELETE).otherwise(oplog.INSERT).alias("op"),
            F.when(is_q, e).otherwise(F.col("user_id")).alias("id"),
            F.when(is_q, v - 15).otherwise(v).alias("x1"),
            F.when(is_q, y - 15).otherwise(y).alias("y1"),
            F.when(is_q, v + 15).otherwise(v + 8).alias("x2"),
            F.when(is_q, y + 15).otherwise(y + 6).alias("y2"),
        )
        return oplog.live_set_answers(log, 30.0)

    return _run(spark, sf, "oplog", build, KEYED)


@query(
    "stream_versions",
    with_sql("ev", "vers") + "SELECT user_id AS id, event_id AS seq, valid_from, valid_to, value FROM vers WHERE valid_to IS NOT NULL",
)
def stream_versions(spark, sf):
    def build(own):
        log = _stream(own, sf).select(
            F.col("event_id").alias("seq"),
            F.when(F.col("event_type") == "error", oplog.DELETE).otherwise(oplog.INSERT).alias("op"),
            F.col("user_id").alias("id"),
            micros("ts").alias("t"),
            "value",
        )
        return oplog.closed_versions(log)

    return _run(spark, sf, "versions", build, KEYED)


def _timed(spark, sf):
    """Events with a zoned time (microseconds since 1970), which watermarks need."""
    return _stream(spark, sf).withColumn("at", F.timestamp_micros(micros("ts")))


def _us(c):
    return F.unix_micros(c)


WIN = with_sql("ev") + ", m AS (SELECT MAX(t) - 7200000000 AS wm FROM ev) "


# a window is final once its end lies behind the last time minus two hours
@query(
    "stream_cell_windows",
    WIN + "SELECT t // 21600000000 * 21600000000 AS start_us, user_id % 16 AS cell, COUNT(*) AS n, round(SUM(value), 4) AS total FROM ev, m "
    "GROUP BY 1, 2, wm HAVING t // 21600000000 * 21600000000 + 21600000000 <= wm".replace("HAVING t // 21600000000 * 21600000000", "HAVING MIN(t) // 21600000000 * 21600000000"),
)
def stream_cell_windows(spark, sf):
    out = _run(spark, sf, "windows", lambda own: oplog.cell_windows(_timed(own, sf), "at", F.col("user_id") % 16, "6 hours", None, "2 hours", "event_id"))
    return out.select(_us("start").alias("start_us"), "cell", "n", F.round("total", 4).alias("total"))


@query(
    "stream_cell_sliding",
    WIN + ", s AS (SELECT (t // 10800000000 - i) * 10800000000 AS start_us, user_id % 16 AS cell, value, wm FROM ev, m, range(0, 2) r(i)) "
    "SELECT start_us, cell, COUNT(*) AS n, round(SUM(value), 4) AS total FROM s WHERE start_us + 21600000000 <= wm GROUP BY 1, 2",
)
def stream_cell_sliding(spark, sf):
    out = _run(spark, sf, "sliding", lambda own: oplog.cell_windows(_timed(own, sf), "at", F.col("user_id") % 16, "6 hours", "3 hours", "2 hours", "event_id"))
    return out.select(_us("start").alias("start_us"), "cell", "n", F.round("total", 4).alias("total"))


@query(
    "stream_cell_sessions",
    WIN + ", g AS (SELECT user_id % 16 AS cell, t, CASE WHEN t - LAG(t) OVER (PARTITION BY user_id % 16 ORDER BY t) < 3600000000 THEN 0 ELSE 1 END AS cut FROM ev), "
    "k AS (SELECT cell, t, SUM(cut) OVER (PARTITION BY cell ORDER BY t ROWS UNBOUNDED PRECEDING) AS sid FROM g) "
    "SELECT MIN(t) AS start_us, MAX(t) + 3600000000 AS end_us, cell, COUNT(*) AS n FROM k, m GROUP BY cell, sid, wm HAVING MAX(t) + 3600000000 <= wm",
)
def stream_cell_sessions(spark, sf):
    out = _run(spark, sf, "sessions", lambda own: oplog.cell_sessions(_timed(own, sf), "at", F.col("user_id") % 16, "1 hour", "2 hours"), LOCAL_SESSIONS)
    return out.select(_us("start").alias("start_us"), _us("end").alias("end_us"), "cell", "n")
