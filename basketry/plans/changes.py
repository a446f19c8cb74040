"""Changes of users' states that expect a state, with undoing ones: what is accepted, and what is left."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from basketry.operators.durable import cut
from basketry.operators.versions import guarded
from basketry.plans.fixtures import table

#: The state that all users begin with.
FIRST = "view"


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every event as a change to its type, which expects the type of the user's event two before it; one of small value undoes the user's last event but one."""
    c = F.col
    w = Window.partitionBy("user_id").orderBy("event_id")
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value", F.lag("event_type", 2, FIRST).over(w).alias("before"), F.lag("event_id", 2).over(w).alias("target"))
    undo = (c("value") < UNDO) & c("target").isNotNull()
    return rows.select(c("user_id").alias("key"), c("event_id").alias("at"), F.when(~undo, c("before")).alias("expected"), F.when(~undo, c("event_type")).alias("value"), F.when(undo, c("target")).alias("undoes"))


#: Events of a smaller value undo another.
UNDO = 4.0


def guarded_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every change with what it expects and gives, and whether it is accepted."""
    changes = _changes(spark, sf_dir)
    told = guarded(changes, changes.select("key").distinct().withColumn("value", F.lit(FIRST)), cut)
    return told.select(F.col("key").alias("user_id"), F.col("at").alias("event_id"), "previous", "next", "accepted")


def guarded_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per user: the state that accepted changes leave, how many were accepted and refused, and the last accepted one."""
    c = F.col
    rows = guarded_changes(spark, sf_dir)
    return rows.groupBy("user_id").agg(F.coalesce(F.max_by("next", F.when(c("accepted"), c("event_id"))), F.lit(FIRST)).alias("current"), F.count_if("accepted").alias("accepted"), F.count_if(~c("accepted")).alias("refused"), F.max(F.when(c("accepted"), c("event_id"))).alias("last"))


_REPLAY = f"""
WITH RECURSIVE e AS (SELECT user_id, event_id, event_type, value, lag(event_type, 2, '{FIRST}') OVER w AS before, lag(event_id, 2) OVER w AS target, row_number() OVER w AS i FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id)),
t AS MATERIALIZED (SELECT *, value < {UNDO} AND target IS NOT NULL AS undo FROM e),
state(user_id, event_id, i, current, trail, previous, next, accepted) AS (
  SELECT DISTINCT user_id, CAST(NULL AS BIGINT), CAST(0 AS BIGINT), '{FIRST}', [{{'id': CAST(-1 AS BIGINT), 'p': '', 'n': '', 'ok': false}}], '', '', false FROM t
  UNION ALL
  SELECT user_id, event_id, i, CASE WHEN ok THEN n ELSE current END, list_append(trail, {{'id': event_id, 'p': p, 'n': n, 'ok': ok}}), p, n, ok
  FROM (SELECT *, p = current AND (NOT undo OR h.ok) AS ok FROM (SELECT *, CASE WHEN undo THEN h.n ELSE before END AS p, CASE WHEN undo THEN h.p ELSE event_type END AS n
    FROM (SELECT t.user_id, t.event_id, t.i, t.undo, t.before, t.event_type, s.current, s.trail, list_filter(s.trail, lambda x: x.id = t.target)[1] AS h FROM state s JOIN t ON s.user_id = t.user_id AND t.i = s.i + 1))))"""

QUERIES = {
    "guarded_changes": (guarded_changes, f"{_REPLAY} SELECT user_id, event_id, previous, next, accepted FROM state WHERE i > 0"),
    "guarded_states": (guarded_states, f"""{_REPLAY} SELECT user_id, coalesce(arg_max(next, event_id) FILTER (accepted), '{FIRST}') AS current, count(*) FILTER (accepted) AS accepted, count(*) FILTER (NOT accepted) AS refused, max(event_id) FILTER (accepted) AS last FROM state WHERE i > 0 GROUP BY user_id"""),
}
