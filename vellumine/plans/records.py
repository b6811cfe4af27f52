"""Queries over keyed records and events, with SQL that another engine can run."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import history as H
from ..operators.nested import instant
from ..session import table


def _events(s: SparkSession, d: str) -> DataFrame:
    """Job events, repeated rows once."""
    return table(s, d, "job_events").dropDuplicates(["sequence", "job_id", "event_type", "created_at"])


def ordered_jobs(s: SparkSession, d: str) -> DataFrame:
    return H.latest(table(s, d, "jobs").select("id", "order_index", instant(F.col("updated_at")).alias("at")), "id", [F.col("at"), F.col("order_index")], ["order_index", "at"]).select("id", "order_index", F.date_format("at", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("at")).orderBy("order_index", "id")


def typed_events(s: SparkSession, d: str) -> DataFrame:
    return _events(s, d).where(F.col("event_type").isNotNull()).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("job_id").alias("jobs"), F.min("sequence").alias("first"), F.max("sequence").alias("last"))


def bounded_history(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select("sequence", "job_id", "event_type")
    return H.bounded(e, [F.desc("sequence"), F.col("job_id"), F.col("event_type")], 200)


def recent_by_job(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).where("job_id is not null").select("job_id", "sequence", "event_type")
    return H.bounded_by(e, "job_id", [F.desc("sequence"), F.col("event_type")], 20).groupBy("job_id").agg(F.count(F.lit(1)).alias("kept"), F.min("sequence").alias("oldest"))


def orphan_events(s: SparkSession, d: str) -> DataFrame:
    jobs = table(s, d, "jobs").select(F.col("id").alias("job_id"))
    return H.without(_events(s, d).where("job_id is not null"), jobs, "job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("n"))


def reviews_of_jobs(s: SparkSession, d: str) -> DataFrame:
    jobs = table(s, d, "jobs").select(F.col("id").alias("job_id"))
    return H.having(table(s, d, "reviews").select("id", "job_id").distinct(), jobs, "job_id").groupBy("job_id").agg(F.count(F.lit(1)).alias("reviews"))


def transition_counts(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).select(F.col("payload.from_status").alias("a"), F.col("payload.to_status").alias("b"))
    return H.transitions(e, "a", "b")


def transition_audit(s: SparkSession, d: str) -> DataFrame:
    e = _events(s, d).where("job_id is not null and payload.stage is not null").select(F.concat_ws("/", "job_id", "payload.stage").alias("key"), "sequence", F.col("payload.from_status").alias("a"), F.col("payload.to_status").alias("b"))
    return H.audit(e, "key", "sequence", "a", "b").groupBy("expected", "stated").agg(F.count(F.lit(1)).alias("n"))


def state_spans(s: SparkSession, d: str) -> DataFrame:
    return H.spans(table(s, d, "events").where("user_id is not null"), "user_id", "ts", "event_type")


def rate_estimate(s: SparkSession, d: str) -> DataFrame:
    return H.estimate(table(s, d, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity", "l_extendedprice", 30.0, 1000.0)


def cohort_report(s: SparkSession, d: str) -> DataFrame:
    return H.cohorts(table(s, d, "events"), ["event_type"], "value", F.col("value") > 50)


def baseline_regressions(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").withColumn("late", F.col("ts") >= F.lit("2024-01-16").cast("timestamp"))
    m = e.groupBy("event_type", "late").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("user_id").alias("users"))
    return H.regressions(m.where("not late"), m.where("late"), "event_type", ["n", "users"])


def spread_sample(s: SparkSession, d: str) -> DataFrame:
    return H.spread_sample(table(s, d, "documents").where("text is not null").select("source", "doc_id"), "source", "doc_id", 5)


def score_budget(s: SparkSession, d: str) -> DataFrame:
    o = table(s, d, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return H.budget(o, "o_custkey", "o_totalprice", "o_orderkey", 6, 0.25).select("o_custkey", "o_orderkey")


def cache_eviction(s: SparkSession, d: str) -> DataFrame:
    c = table(s, d, "documents").where("n_chars is not null and created_at is not null").select("source_format", "doc_id", "n_chars", "created_at")
    return H.evict(c, "source_format", "n_chars", "created_at", "doc_id", 100_000)


def snapshot_changes(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("user_id is not null")
    half = F.lit("2024-01-16").cast("timestamp")
    last = lambda x: x.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("state"))
    return H.changes(last(e.where(F.col("ts") < half)), last(e), "user_id", ["state"])


def last_purchase(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").where("user_id is not null")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'purchase'").groupBy("user_id", "ts").agg(F.max("value").alias("value"))
    return H.as_of(left, right, "user_id", "ts", "value").select("event_id", F.col("last_value").alias("last_value"))


def user_sessions(s: SparkSession, d: str) -> DataFrame:
    return H.sessions(table(s, d, "events").where("user_id is not null"), "user_id", "ts", 1800)


def hourly_counts(s: SparkSession, d: str) -> DataFrame:
    e = table(s, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 4).alias("total"))
    return e.select(F.col("w.start").alias("hour"), "event_type", "n", "total")


def spend_by_region(s: SparkSession, d: str) -> DataFrame:
    r, n, c, o = (table(s, d, t) for t in ("region", "nation", "customer", "orders"))
    j = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    return j.groupBy("r_name", "o_orderpriority").agg(F.count(F.lit(1)).alias("orders"), F.round(F.sum("o_totalprice"), 2).alias("total"))


EVENTS = "(SELECT DISTINCT ON (sequence, job_id, event_type, created_at) * FROM job_events)"
_AT = "CAST(updated_at AS TIMESTAMPTZ) AT TIME ZONE 'UTC'"

SQL: dict[str, str] = {
    "ordered_jobs": f"SELECT id, first(order_index ORDER BY {_AT} DESC, order_index DESC) AS order_index, strftime(max({_AT}), '%Y-%m-%d %H:%M:%S.%f') AS at FROM jobs WHERE id IS NOT NULL GROUP BY id",
    "typed_events": f"SELECT event_type, count(*) AS n, count(DISTINCT job_id) AS jobs, min(sequence) AS first, max(sequence) AS last FROM {EVENTS} WHERE event_type IS NOT NULL GROUP BY event_type",
    "bounded_history": f"SELECT sequence, job_id, event_type FROM {EVENTS} ORDER BY sequence DESC, job_id, event_type LIMIT 200",
    "recent_by_job": f"""
        SELECT job_id, count(*) AS kept, min(sequence) AS oldest FROM (SELECT job_id, sequence FROM {EVENTS} WHERE job_id IS NOT NULL
            QUALIFY row_number() OVER (PARTITION BY job_id ORDER BY sequence DESC, event_type) <= 20) GROUP BY job_id""",
    "orphan_events": f"SELECT job_id, count(*) AS n FROM {EVENTS} WHERE job_id IS NOT NULL AND job_id NOT IN (SELECT id FROM jobs WHERE id IS NOT NULL) GROUP BY job_id",
    "reviews_of_jobs": "SELECT job_id, count(*) AS reviews FROM (SELECT DISTINCT id, job_id FROM reviews) WHERE job_id IN (SELECT id FROM jobs) GROUP BY job_id",
    "transition_counts": f"SELECT payload.from_status AS from_state, payload.to_status AS to_state, count(*) AS n FROM {EVENTS} WHERE payload.from_status IS NOT NULL AND payload.to_status IS NOT NULL GROUP BY ALL",
    "transition_audit": f"""
        SELECT expected, stated, count(*) AS n FROM (
            SELECT payload.from_status AS stated, lag(payload.to_status) OVER (PARTITION BY job_id, payload.stage ORDER BY sequence) AS expected
            FROM {EVENTS} WHERE job_id IS NOT NULL AND payload.stage IS NOT NULL AND payload.from_status IS NOT NULL AND payload.to_status IS NOT NULL)
        WHERE expected IS NOT NULL AND expected <> stated GROUP BY ALL""",
    "state_spans": """
        SELECT event_type AS state, count(*) AS visits, round(sum(d) / 1000000.0::DOUBLE, 3) AS seconds FROM (
            SELECT event_type, epoch_us(lead(ts) OVER (PARTITION BY user_id ORDER BY ts, event_type)) - epoch_us(ts) AS d FROM events WHERE user_id IS NOT NULL) GROUP BY event_type""",
    "rate_estimate": """
        WITH g AS (SELECT l_returnflag, l_linestatus, count(*) AS samples, median(l_extendedprice / l_quantity) AS mid, quantile_cont(l_extendedprice / l_quantity, [0.25, 0.75]) AS q
                   FROM lineitem WHERE l_quantity > 0 AND l_extendedprice IS NOT NULL GROUP BY ALL),
        m AS (SELECT *, greatest(15.0::DOUBLE, round_even(8 + (mid * samples + 1000.0::DOUBLE * greatest(0, 3 - samples)) / (samples + greatest(0, 3 - samples)) * 30.0::DOUBLE, 0)) AS likely FROM g)
        SELECT l_returnflag, l_linestatus, samples,
            greatest(10.0::DOUBLE, round(least(CASE WHEN samples >= 4 THEN (8 + q[1] * 30.0::DOUBLE) * 0.85::DOUBLE ELSE likely * 0.65::DOUBLE END, likely), 3)) AS lower, likely,
            round(greatest(likely, CASE WHEN samples >= 4 THEN (8 + q[2] * 30.0::DOUBLE) * 1.2::DOUBLE ELSE likely * 1.55::DOUBLE END), 3) AS upper FROM m""",
    "cohort_report": "SELECT event_type, count(*) AS n, count(*) FILTER (value > 50) AS good, round(median(value), 6) AS median, max(value) AS greatest FROM events GROUP BY event_type",
    "baseline_regressions": """
        WITH m AS (SELECT event_type, ts >= TIMESTAMP '2024-01-16' AS late, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY ALL),
        x AS (SELECT event_type, late, 'n' AS field, n::DOUBLE AS v FROM m UNION ALL SELECT event_type, late, 'users', users::DOUBLE FROM m)
        SELECT a.event_type, a.field, a.v AS expected, b.v AS actual FROM x a LEFT JOIN x b ON a.event_type = b.event_type AND a.field = b.field AND b.late WHERE NOT a.late AND a.v IS DISTINCT FROM b.v""",
    "spread_sample": """
        SELECT source, doc_id FROM (SELECT source, doc_id, count(*) OVER (PARTITION BY source) AS n, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r FROM documents WHERE text IS NOT NULL)
        WHERE r = 0 OR floor(r * 5 / n) <> floor((r - 1) * 5 / n)""",
    "score_budget": """
        SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, count(*) OVER (PARTITION BY o_custkey) AS n, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders)
        WHERE r <= least(6, greatest(1, ceil(n * 0.25::DOUBLE)))""",
    "cache_eviction": """
        SELECT source_format, doc_id FROM (SELECT source_format, doc_id, sum(n_chars) OVER (PARTITION BY source_format ORDER BY created_at DESC, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS kept
            FROM documents WHERE n_chars IS NOT NULL AND created_at IS NOT NULL) WHERE kept > 100000""",
    "snapshot_changes": """
        WITH a AS (SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS state FROM events WHERE user_id IS NOT NULL AND ts < TIMESTAMP '2024-01-16' GROUP BY user_id),
        b AS (SELECT user_id, first(event_type ORDER BY ts DESC, event_id DESC) AS state FROM events WHERE user_id IS NOT NULL GROUP BY user_id)
        SELECT coalesce(a.user_id, b.user_id) AS user_id, CASE WHEN a.user_id IS NULL THEN 'added' WHEN b.user_id IS NULL THEN 'removed' ELSE 'changed' END AS change
        FROM a FULL JOIN b ON a.user_id = b.user_id WHERE a.state IS DISTINCT FROM b.state""",
    "last_purchase": """
        SELECT l.event_id, r.value AS last_value FROM (SELECT * FROM events WHERE event_type = 'error' AND user_id IS NOT NULL) l
        ASOF LEFT JOIN (SELECT user_id, ts, max(value) AS value FROM events WHERE event_type = 'purchase' AND user_id IS NOT NULL GROUP BY ALL) r ON l.user_id = r.user_id AND l.ts >= r.ts""",
    "user_sessions": """
        SELECT user_id, min(ts) AS started, max(ts) AS ended, count(*) AS n FROM (
            SELECT user_id, ts, sum(opens) OVER (PARTITION BY user_id ORDER BY ts) AS k FROM (
                SELECT user_id, ts, (lag(ts) OVER (PARTITION BY user_id ORDER BY ts) IS NULL OR ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) >= INTERVAL 30 MINUTE)::INT AS opens FROM events WHERE user_id IS NOT NULL))
        GROUP BY user_id, k""",
    "hourly_counts": "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL",
    "spend_by_region": """
        SELECT r_name, o_orderpriority, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey GROUP BY ALL""",
}

QUERIES = {
    f.__name__: f
    for f in (
        ordered_jobs, typed_events, bounded_history, recent_by_job, orphan_events, reviews_of_jobs, transition_counts, transition_audit, state_spans, rate_estimate,
        cohort_report, baseline_regressions, spread_sample, score_budget, cache_eviction, snapshot_changes, last_purchase, user_sessions, hourly_counts, spend_by_region,
    )
}
