"""Queries on merged logs and wrapped texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import text
from ..operators import predictions
from .registry import query, table


@query("""WITH a AS (SELECT * FROM events WHERE event_id % 3 <> 0), b AS (SELECT event_id, user_id, event_type, CASE WHEN event_id % 5 = 0 THEN NULL ELSE value END AS value, CASE WHEN event_id % 5 = 0 THEN 'torn' END AS error FROM events WHERE event_id % 3 <> 1)
  SELECT coalesce(a.event_id, b.event_id) AS seq, coalesce(a.user_id, b.user_id) AS id, coalesce(a.event_type, b.event_type) AS event_type, CASE WHEN a.event_id IS NULL THEN b.value ELSE a.value END AS value,
    CASE WHEN a.event_id IS NULL THEN b.error END AS error FROM a FULL OUTER JOIN b ON a.event_id = b.event_id""")
def merged_log(spark, sf_dir):
    """Two copies of a log, each with records that the other has not; every fifth of the second is an error."""
    rows = table(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.col("user_id").alias("id"), "event_type", "value", F.lit(None).cast("string").alias("error"))
    torn = F.col("seq") % 5 == 0
    second = rows.where("seq % 3 <> 1").withColumns({"value": F.when(~torn, F.col("value")), "error": F.when(torn, "torn")})
    return predictions.merged_logs(second, rows.where("seq % 3 <> 0"))


def _width_sql(t: str) -> str:
    classes = " + ".join(f"(length({t}) - length(translate({t}, {_quoted(alike)}, ''))) * {width - text.COMMON_WIDTH}" for alike, width in text.NARROW_AND_WIDE.items())
    return f"(length({t}) * {text.COMMON_WIDTH} + {classes})"


def _quoted(said: str) -> str:
    return "'" + said.replace("'", "''") + "'"


@query(f"""WITH RECURSIVE p AS (SELECT conv_id || ':' || turn AS id, unnest(string_split(text, chr(10))) AS said, unnest(range(len(string_split(text, chr(10))))) AS par FROM conversations),
  q AS (SELECT id, par, string_split(said, ' ') AS w FROM p),
  f(id, par, w, i, line, wide, no, done) AS (SELECT id, par, w, 1::BIGINT, w[1], {_width_sql("w[1]")}::BIGINT, 0, NULL::VARCHAR FROM q
    UNION ALL SELECT id, par, w, i + 1, CASE WHEN line = '' THEN w[i + 1] WHEN wide + 280 + {_width_sql("w[i + 1]")} <= 30000 THEN line || ' ' || w[i + 1] ELSE w[i + 1] END,
      CASE WHEN line <> '' AND wide + 280 + {_width_sql("w[i + 1]")} <= 30000 THEN wide + 280 ELSE 0 END + {_width_sql("w[i + 1]")},
      CASE WHEN line <> '' AND wide + 280 + {_width_sql("w[i + 1]")} > 30000 THEN no + 1 ELSE no END, CASE WHEN line <> '' AND wide + 280 + {_width_sql("w[i + 1]")} > 30000 THEN line END FROM f WHERE i < len(w)),
  l AS (SELECT id, par, no - 1 AS no, done AS line FROM f WHERE done IS NOT NULL UNION ALL SELECT id, par, no, line FROM f WHERE i = len(w))
  SELECT id, (row_number() OVER (PARTITION BY id ORDER BY par, no) - 1)::INTEGER AS ord, line FROM l""")
def wrapped_lines(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select(F.concat_ws(":", "conv_id", "turn").alias("id"), "text")
    return rows.select("id", F.posexplode(text.wrapped(F.col("text"), F.lit(30_000))).alias("ord", "line"))
