"""Per-case chains of dated events: first and last states, delays and their distribution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from panelspark.session import table


def chain_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per case: number of hearings, errors, first and last state and the days between."""
    e = table(spark, sf_dir, "events")
    order = F.struct("ts", "event_id")
    return e.groupBy("user_id").agg(
        F.count("*").alias("n"),
        F.count_if(F.col("event_type") == "error").alias("n_error"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
        F.min_by("event_type", order).alias("first_type"),
        F.max_by("event_type", order).alias("final_type"),
        F.datediff(F.max("ts"), F.min("ts")).cast("long").alias("days"),
    )


QUERIES = {"chain_summary": chain_summary}

ORACLE_SQL = {
    "chain_summary": """
        SELECT user_id, count(*) AS n, count(*) FILTER (WHERE event_type = 'error') AS n_error,
               min(ts) AS first_ts, max(ts) AS last_ts,
               arg_min(event_type, (ts, event_id)) AS first_type, arg_max(event_type, (ts, event_id)) AS final_type,
               date_diff('day', min(ts)::DATE, max(ts)::DATE) AS days
        FROM events GROUP BY user_id""",
}
