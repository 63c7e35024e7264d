"""Queries of the streaming operators over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from binomia.plans import q_corpus
from binomia.streaming import events as S


def _stream(spark, sf):
    s = S.event_stream(spark, f"{sf}/events.parquet")
    return s.withColumn("k", F.get_json_object("props", "$.k").cast("long")).withColumn("session", F.date_trunc("day", "ts"))


def stream_e1_sessions(spark, sf):
    """Which of a session's visits comes first depends on the order of reading; sessions don't."""
    return S.run_available(S.once_a_session(_stream(spark, sf)), "append").select("user_id", "session")


ANY_ORDER = 86_400.0 * 36_500  # files come in any order of time


def stream_e2_rate_limit(spark, sf):
    return S.throttled(_stream(spark, sf), 3600.0, ANY_ORDER).accepted().groupBy("user_id").agg(F.count("*").alias("accepted"), F.sum("event_id").alias("event_ids"))


def stream_e5_counters(spark, sf):
    return S.run_available(S.counters(_stream(spark, sf), F.col("k") * 10), "complete")


def stream_e6_dashboard(spark, sf):
    visits = q_corpus.visits_of(S.event_stream(spark, f"{sf}/events.parquet"))
    return S.dashboard(visits, F.col("k") * 10).shown()


QUERIES = {f.__name__: f for f in (stream_e1_sessions, stream_e2_rate_limit, stream_e5_counters, stream_e6_dashboard)}
ORACLES = {
    "stream_e1_sessions": "SELECT DISTINCT user_id, date_trunc('day', ts) AS session FROM events",
    "stream_e2_rate_limit": q_corpus.ORACLES["e2_rate_limit"],
    "stream_e5_counters": q_corpus.ORACLES["e5_counters"],
    "stream_e6_dashboard": q_corpus.ORACLES["a17_dashboard"],
}
