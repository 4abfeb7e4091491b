"""Queries on the log of events as a stream: state in place, windows of event time, and a log with commits."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..sources import records, scratch
from ..streaming import progress, state
from .catalog import _stream
from .registry import ORACLES, query, table


@query(ORACLES["latest_prediction"])
def state_latest(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "event_type", "value")
    with state.rocksdb(spark):
        last = progress.drained(state.latest(rows, "user_id"), "update", ["user_id"])
    return last.withColumnRenamed("seq", "event_id")


@query(ORACLES["stream_breaker"])
def state_breaker(spark, sf_dir):
    rows = _stream(spark, sf_dir).select("user_id", F.col("event_id").alias("seq"), "is_error")
    with state.rocksdb(spark):
        return progress.drained(state.breaker(rows, "user_id", 3), "update", ["user_id"]).select("user_id", "longest", "tripped")


def _timed(spark, sf_dir):
    """The stream with instants, whatever the session's time zone: the table's times are of no zone, and taken as UTC."""
    since = "timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast(ts AS timestamp_ntz))"
    return _stream(spark, sf_dir).withColumn("ts", F.timestamp_micros(F.expr(since)))


def _said(instant: str, form: str) -> F.Column:
    return F.date_format(F.expr(f"timestampadd(MICROSECOND, unix_micros({instant}), timestamp_ntz'1970-01-01 00:00:00')"), form)


_CLOSED = "(SELECT max(ts) FROM events) - INTERVAL 1 HOUR"


@query(f"""WITH e AS (SELECT *, CASE WHEN ts - lag(ts) OVER w <= INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
  s AS (SELECT user_id, min(ts) AS a, max(ts) + INTERVAL 30 MINUTE AS b, count(*) AS n, count(*) FILTER (event_type = 'error') AS errors FROM (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS session FROM e) GROUP BY user_id, session)
  SELECT user_id, strftime(a, '%Y-%m-%d %H:%M:%S.%f') AS start, strftime(b, '%Y-%m-%d %H:%M:%S.%f') AS stop, n::BIGINT AS n, errors::BIGINT AS errors FROM s WHERE b <= date_trunc('milliseconds', {_CLOSED})""")
def event_sessions(spark, sf_dir):
    """Sessions of users that are closed once all events have come."""
    found = progress.drained(progress.sessions(_timed(spark, sf_dir)), "append", ["user_id", "start"])
    return found.withColumns({c: _said(c, "yyyy-MM-dd HH:mm:ss.SSSSSS") for c in ("start", "stop")})


@query(f"""WITH w AS (SELECT to_timestamp(7200 * (epoch_us(ts) // 7200000000 - unnest([0, 1, 2])))::TIMESTAMP AS a, event_type FROM events)
  SELECT strftime(a, '%Y-%m-%d %H:%M') AS start, event_type, count(*)::BIGINT AS n FROM w WHERE a + INTERVAL 6 HOUR <= date_trunc('milliseconds', {_CLOSED}) GROUP BY ALL""")
def sliding_counts(spark, sf_dir):
    """Windows of six hours every two hours, as far as they are closed."""
    found = progress.drained(progress.windowed_counts(_timed(spark, sf_dir), "6 hours", slide="2 hours"), "append", ["start", "event_type"])
    return found.select(_said("start", "yyyy-MM-dd HH:mm").alias("start"), "event_type", "n")


@query("SELECT event_id, user_id, event_type, value, 1 + event_id % 2 AS part FROM events")
def record_log(spark, sf_dir):
    """Events written to a log with commits, one half by a batch and one by a stream, and read back."""
    spark.dataSource.register(records.Records)
    uri = scratch.new_dir(spark, "records")
    shape = lambda rows: rows.select("event_id", "user_id", "event_type", "value", (1 + F.col("event_id") % 2).alias("part"))
    first = shape(table(spark, sf_dir, "events")).where("part = 1")
    first.write.format("records").mode("append").save(uri)
    second = shape(_stream(spark, sf_dir)).where("part = 2")
    second.writeStream.format("records").option("path", uri).option("checkpointLocation", f"{uri}/state").trigger(availableNow=True).start().awaitTermination()
    return records.read(spark, uri, first.schema)
