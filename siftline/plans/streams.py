"""Queries that run a stream to its end and return its table."""

from __future__ import annotations

from pyspark.sql import functions as F

from siftline import fixed
from siftline.operators import findings as op
from siftline.plans import triage
from siftline.streaming import stateful
from siftline.streaming import streams as st


def _events(spark, sf):
    return st.file_stream(spark, f"{sf}/events.parquet")


def _findings(events):
    """Findings that arrive as events, without a flow."""
    pick = lambda values, i: F.element_at(F.array(*map(F.lit, values)), (i + 1).cast("int"))
    return events.select(
        F.col("event_id").alias("id"), pick(["CWE-89", "CWE-400", ""], F.col("user_id") % 3).alias("cwe_id"), pick(fixed.SEVERITIES, F.col("user_id") % 5).alias("severity"), ((F.col("event_id") * 37 % 101) / 100).alias("confidence"),
        F.lit(None).cast("array<struct<file_path:string,line:int>>").alias("taint_flow"), F.lit(None).cast("array<string>").alias("corroborating_tools"), F.lit(None).cast("map<string,string>").alias("tool_verdicts"),
    )


def stream_findings_route(spark, sf):
    routed = st.route(_findings(_events(spark, sf)), op.route_sast).select("id", F.round("total", 6).alias("total"), "escalated")
    return st.run_append(routed, "routed")


def stream_cve_upsert(spark, sf):
    """The latest value of each user: every batch is reduced to a row a user, and the last version counts."""
    e = _events(spark, sf).select(F.col("user_id").alias("id"), F.col("event_id").alias("version"), F.round("value", 4).alias("value"))
    return st.run_latest(e, "upserts", ["id"], "append", "version").select("id", "version", "value")


def quota_windows(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    out = st.run_latest(st.quota_windows(e, "ts", "event_type", 6), "quotas", ["event_type", "start"])
    return out.select("event_type", F.unix_timestamp("start").alias("start"), "n", "over")


def stream_response_dedup(spark, sf):
    e = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp")).withColumn("hash", F.sha2(F.concat_ws("|", "event_type", "props"), 256))
    return st.run_append(st.dedup_responses(e, "ts", "hash", "30 days").select("hash", "event_type"), "deduplicated").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_admission(spark, sf):
    """Which requests the budgets of one a minute and sixty a day admit, by type."""
    x = st.run_append(stateful.admit(_events(spark, sf), "ts", "event_type", "event_id", 1, 60), "admitted", rocks=True)
    return x.select("id", F.col("key").alias("event_type"), "admitted", F.round("wait", 3).alias("wait"), "day_left")


def stream_response_cache(spark, sf):
    """Hits, misses and evictions of a cache of the forty answers used last, by type."""
    x = st.run_append(stateful.cached(_events(spark, sf), "ts", "event_type", "event_id", "props", 40), "cached", rocks=True)
    return x.select("id", F.col("key").alias("event_type"), "hit", F.col("evicted").isNotNull().alias("evicts"))


def stream_stage_counts(spark, sf):
    routed = op.route_sast(_findings(_events(spark, sf))).select(F.when(F.col("escalated"), "graph").otherwise("sast").alias("stage"))
    return st.run_latest(st.stage_counts(routed, "stage"), "counts", ["stage"]).select("stage", "n")


QUERIES = {"stream_findings_route": stream_findings_route, "stream_cve_upsert": stream_cve_upsert, "quota_windows": quota_windows, "stream_response_dedup": stream_response_dedup, "stream_stage_counts": stream_stage_counts, "stream_admission": stream_admission, "stream_response_cache": stream_response_cache}

_D = triage.D
_ROUTED = f"""e AS (SELECT event_id AS id, greatest(0, least(1, {_D(0.4)} * greatest(0, least(1, 1 - CAST(event_id * 37 % 101 AS DOUBLE) / 100)) + {_D(0.2)} * [{_D(0.15)}, {_D(0.85)}, {_D(1)}][CAST(user_id % 3 + 1 AS INTEGER)] + [{_D(0.15)}, {_D(0.1)}, {_D(0)}, {_D(-0.05)}, {_D(0)}][CAST(user_id % 5 + 1 AS INTEGER)])) AS total FROM events)"""
SQL = {
    "stream_findings_route": f"WITH {_ROUTED} SELECT id, round(total, 6) AS total, round(total, 9) >= {_D(0.5)} AS escalated FROM e",
    "stream_cve_upsert": "SELECT user_id AS id, max(event_id) AS version, round(arg_max(value, event_id), 4) AS value FROM events GROUP BY 1",
    "quota_windows": "SELECT event_type, CAST(epoch(time_bucket(INTERVAL 1 MINUTE, ts)) AS BIGINT) AS start, count(*) AS n, count(*) > 6 AS over FROM events GROUP BY 1, 2",
    "stream_response_dedup": "SELECT event_type, count(DISTINCT props) AS n FROM events GROUP BY 1",
    "stream_stage_counts": f"WITH {_ROUTED} SELECT CASE WHEN round(total, 9) >= {_D(0.5)} THEN 'graph' ELSE 'sast' END AS stage, count(*) AS n FROM e GROUP BY 1",
    # The budgets request by request: each request's state from the state before.
    "stream_admission": """WITH RECURSIVE e AS (SELECT event_id, event_type, epoch_us(ts) AS us, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
        s AS (SELECT event_type, event_id, n, us, us AS ms, us AS ds, 0 AS ml, 59 AS dl, true AS admitted, 0.0::DOUBLE AS wait FROM e WHERE n = 1
          UNION ALL SELECT event_type, event_id, n, us, ms, ds, ml - ok::INT, dl - ok::INT, ok, CASE WHEN ok THEN 0 WHEN dl <= 0 THEN (86400000000 - (us - ds)) / 1e6 ELSE greatest((60000000 - (us - ms)) / 1e6, 0.1) END
            FROM (SELECT *, ml > 0 AND dl > 0 AS ok FROM (SELECT e.event_type, e.event_id, e.n, e.us, CASE WHEN e.us - ms >= 60000000 THEN e.us ELSE ms END AS ms, CASE WHEN e.us - ds >= 86400000000 THEN e.us ELSE ds END AS ds,
              CASE WHEN e.us - ms >= 60000000 THEN 1 ELSE ml END AS ml, CASE WHEN e.us - ds >= 86400000000 THEN 60 ELSE dl END AS dl FROM s JOIN e ON e.event_type = s.event_type AND e.n = s.n + 1) q) r)
        SELECT event_id AS id, event_type, admitted, round(wait, 3) AS wait, dl::INT AS day_left FROM s""",
    # A prompt is held if fewer than forty others were used since its last use; each miss beyond the fortieth evicts one.
    "stream_response_cache": """WITH e AS (SELECT event_id, event_type, props, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS n FROM events),
        p AS (SELECT *, lag(n) OVER (PARTITION BY event_type, props ORDER BY n) AS before FROM e),
        h AS (SELECT p.event_id, p.event_type, p.n, p.before IS NOT NULL AND count(DISTINCT e.props) < 40 AS hit FROM p LEFT JOIN e ON e.event_type = p.event_type AND e.n > p.before AND e.n < p.n GROUP BY p.event_id, p.event_type, p.n, p.before)
        SELECT event_id AS id, event_type, hit, NOT hit AND count(*) FILTER (NOT hit) OVER (PARTITION BY event_type ORDER BY n) > 40 AS evicts FROM h""",
}
