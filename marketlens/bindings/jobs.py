"""Job runs, logs and their status."""

from __future__ import annotations

from pyspark.sql import functions as F

from marketlens.bindings.roles import LINES_SQL, RUNS_SQL, job_runs, log_lines, show_ts, stamp, table
from marketlens.functions import scores, times
from marketlens.operators import aggregates, filters, windows
from marketlens.plans import jobs
from marketlens.sources import logs

_TS = "%Y-%m-%d %H:%M:%S"


def _catalogue(spark, sf):
    """Known jobs: the event types and the market segments, which never run."""
    kinds = table(spark, sf, "events").select(F.col("event_type").alias("job")).distinct()
    never = table(spark, sf, "customer").select(F.lower("c_mktsegment").alias("job")).distinct()
    rows = kinds.unionByName(never)
    return rows.select("job", F.concat(F.lit("job "), "job").alias("label"), F.when(F.col("job") == "view", 0).when(F.col("job") == "click", 24).otherwise(100).alias("cadence_h"))


_JOB_AS_OF = "2024-02-02"


def _status(spark, sf):
    return aggregates.job_status(_catalogue(spark, sf), job_runs(spark, sf), stamp(_JOB_AS_OF))


def job_status(spark, sf):
    return _status(spark, sf).select("job", "label", "status", show_ts("last_run").alias("last_run"), "age_hours", "summary")


def overall_status(spark, sf):
    return aggregates.overall_status(_status(spark, sf))


_STATUS = RUNS_SQL + f""",
jobs AS (
  SELECT DISTINCT event_type AS job, CASE event_type WHEN 'view' THEN 0 WHEN 'click' THEN 24 ELSE 100 END AS cadence FROM events
  UNION ALL SELECT DISTINCT lower(c_mktsegment), 100 FROM customer),
newest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY id DESC) AS rn FROM runs) x WHERE rn = 1),
aged AS (
  SELECT jobs.job, cadence, id, status, ended_at, counts, error, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '{_JOB_AS_OF}') - epoch_us(ended_at)) / 3600000000.0::DOUBLE) AS age
  FROM jobs LEFT JOIN newest USING (job)),
status AS (
  SELECT job, 'job ' || job AS label, CASE WHEN id IS NULL THEN 'unknown' WHEN cadence > 0 AND age > cadence * 2 AND status = 'ok' THEN 'warn' ELSE status END AS status,
         strftime(ended_at, '{_TS}') AS last_run, CASE WHEN id IS NOT NULL THEN age END AS age_hours,
         CASE WHEN id IS NULL THEN 'no run recorded' WHEN error IS NOT NULL THEN error ELSE 'k=' || regexp_extract(counts, '(\\d+)', 1) END AS summary
  FROM aged)"""


def job_transitions(spark, sf):
    return windows.status_transitions(job_runs(spark, sf)).select("id", "job", "status", "prev_status", "alert")


def job_history(spark, sf):
    rows = aggregates.job_history(job_runs(spark, sf), "click")
    return rows.select("id", "status", show_ts("ended_at").alias("ended_at"), scores.counts_text(F.col("counts")).alias("counts"))


def record_jobs(spark, sf):
    """Runs of the second half of the month recorded after those of the first; strange states count as errors."""
    runs = job_runs(spark, sf)
    first = runs.where(F.col("ended_at") < stamp("2024-01-16"))
    later = runs.where(F.col("ended_at") >= stamp("2024-01-16")).withColumn("status", F.when(F.col("status") == "warn", "broken").otherwise(F.col("status")))
    return jobs.record_jobs(first, later).select("id", "job", "status", "alert", show_ts("ended_at").alias("ended_at"))


def alert_set_changed(spark, sf):
    runs = job_runs(spark, sf)
    catalogue = _catalogue(spark, sf)
    before = aggregates.job_status(catalogue, runs.where(F.col("ended_at") < stamp("2024-01-16")), stamp("2024-01-16"))
    return windows.alert_set_changed(_status(spark, sf), before)


def recent_errors(spark, sf):
    rows = job_runs(spark, sf).where(F.col("status") == "error")
    return filters.recent_errors(rows.select("ended_at", "id"), "ended_at", stamp("2024-01-31"), 72).select("id")


def age_hours(spark, sf):
    return job_runs(spark, sf).select("id", times.age_hours(F.col("ended_at"), stamp("2024-01-15")).alias("age_hours"))


def backoff(spark, sf):
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.count("*").alias("blocks"))
    return rows.select("l_orderkey", times.backoff_seconds(F.col("blocks") - 1).alias("seconds"))


def _log_jobs(spark, sf):
    """The document sources as jobs: patterns and ages depend on the source's number."""
    number = F.regexp_extract("job", r"(\d+)", 1).cast("int")
    rows = table(spark, sf, "documents").select(F.col("source").alias("job")).distinct()
    none = F.lit(None).cast("string")
    return rows.select(
        "job", F.lit(10.0).alias("cadence_h"), F.when(number > 15, 30.0).otherwise(5.0).alias("age_h"), F.when(number < 3, "token = ").otherwise(none).alias("error_re"),
        F.when(number.between(3, 6), r"\d{4}").otherwise(none).alias("problem_re"), F.when(number > 8, "the").otherwise(none).alias("ok_re"),
    )


def log_status(spark, sf):
    return aggregates.job_log_status(log_lines(spark, sf), _log_jobs(spark, sf))


def log_overall(spark, sf):
    return aggregates.overall_log_status(log_status(spark, sf))


_FATAL = "(?i)traceback \\(most recent call last\\)|exit code [1-9]|another job is already running|unhandledexception|\\bfatal\\b|\\bcritical\\b|killed|\\boom\\b|segmentation fault|modulenotfounderror"
_ISSUE = "(?i)\\[error\\]|\\[warning\\]|\\berrore\\b|\\bwarn(ing)?\\b|\\bfailed\\b|429|too many requests|timeout|attenzione"
_LOGS = LINES_SQL + f""",
num AS (SELECT DISTINCT source AS job, CAST(regexp_extract(source, '(\\d+)', 1) AS INT) AS k FROM documents),
flags AS (
  SELECT job, k, line_no, trim(line) AS t, k < 3 AND regexp_matches(line, '(?i)token = ') AS e, regexp_matches(line, '{_FATAL}') AS f,
         k BETWEEN 3 AND 6 AND regexp_matches(line, '\\d{{4}}') AS p, k > 8 AND regexp_matches(line, '(?i)the') AS ok, regexp_matches(line, '{_ISSUE}') AS i
  FROM lines JOIN num USING (job)),
found AS (
  SELECT job, any_value(k) AS k, bool_or(e) AS e, bool_or(f) AS f, bool_or(p) AS p, bool_or(ok) AS ok, bool_or(i) AS i,
         arg_min(t, line_no) FILTER (e) AS el, arg_min(t, line_no) FILTER (f) AS fl, arg_min(t, line_no) FILTER (p) AS pl, arg_min(t, line_no) FILTER (i) AS il,
         arg_max(t, line_no) FILTER (t <> '') AS last
  FROM flags GROUP BY job),
log_status AS (
  SELECT job, CASE WHEN e OR f THEN 'error' WHEN p THEN 'warn' WHEN k > 15 THEN 'stale' WHEN k > 8 THEN CASE WHEN ok THEN 'ok' ELSE 'warn' END WHEN i THEN 'warn' ELSE 'ok' END AS status,
         substr(coalesce(CASE WHEN e THEN el WHEN f THEN fl WHEN p THEN pl WHEN k > 15 THEN 'stale' WHEN k > 8 OR NOT i THEN last ELSE il END, ''), 1, 200) AS summary
  FROM found)"""


def last_segment(spark, sf):
    rows = aggregates.last_segment(log_lines(spark, sf), ["job"], "line_no", marker=r"token = ")
    return rows.groupBy("job").agg(F.count("*").alias("lines"), F.min("line_no").alias("first_line"))


def tail_lines(spark, sf):
    """Last turns of every conversation; turns are numbered without gaps."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", F.col("text").alias("line"))
    return aggregates.tail_lines(rows, ["conv_id"], "turn", 2).select("conv_id", "turn")


def first_match(spark, sf):
    return logs.first_match_line(log_lines(spark, sf), ["job"], r"\d{4}")


def started_at(spark, sf):
    return logs.started_at(log_lines(spark, sf), ["job"], pattern=r"token = \"(\w{6})")


def archived_runs(spark, sf):
    rows = table(spark, sf, "documents").select(F.col("source").alias("folder"), F.concat(F.lit("#"), F.col("doc_id").cast("string"), F.lit("/run.log")).alias("path"), F.explode(F.split("text", "\n")).alias("line"))
    return aggregates.archived_runs(rows.withColumn("line", F.regexp_replace("line", "token = \"", "error:")))


def coverage(spark, sf):
    """Daily figures of the events as verification coverage."""
    rows = table(spark, sf, "events").groupBy(F.to_date("ts").alias("date")).agg(
        F.avg(F.when(F.col("event_type") == "view", 100.0).otherwise(0.0)).alias("coverage_pct"), F.count("*").alias("verified"), F.lit(0).cast("long").alias("skipped"),
        F.sum((F.col("event_type") == "purchase").cast("long")).alias("sold_new"),
    )
    return logs.coverage_summary(rows)


QUERIES = {
    "job_status": (job_status, f"WITH {_STATUS} SELECT * FROM status"),
    "overall_status": (overall_status, f"WITH {_STATUS} SELECT CASE WHEN bool_or(status = 'error') THEN 'error' WHEN bool_or(status = 'warn') THEN 'warn' ELSE 'ok' END AS overall FROM status"),
    "job_transitions": (
        job_transitions,
        f"WITH {RUNS_SQL}, p AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY id) AS prev_status FROM runs) SELECT id, job, status, prev_status, status IN ('warn', 'error') AND status IS DISTINCT FROM prev_status AS alert FROM p",
    ),
    "job_history": (
        job_history,
        f"WITH {RUNS_SQL} SELECT id, status, strftime(ended_at, '{_TS}') AS ended_at, 'k=' || regexp_extract(counts, '(\\d+)', 1) AS counts FROM runs WHERE job = 'click' ORDER BY id DESC",
    ),
    "record_jobs": (
        record_jobs,
        f"WITH {RUNS_SQL}, l AS (SELECT (SELECT max(id) FROM runs WHERE ended_at < TIMESTAMP '2024-01-16') + row_number() OVER (ORDER BY ended_at, job) AS id, job, CASE status WHEN 'warn' THEN 'error' ELSE status END AS status, ended_at, true AS late FROM runs WHERE ended_at >= TIMESTAMP '2024-01-16'), a AS (SELECT id, job, status, ended_at, false AS late FROM runs WHERE ended_at < TIMESTAMP '2024-01-16' UNION ALL SELECT * FROM l), p AS (SELECT *, lag(status) OVER (PARTITION BY job ORDER BY id) AS prev FROM a) SELECT id, job, status, late AND status IN ('warn', 'error') AND status IS DISTINCT FROM prev AS alert, strftime(ended_at, '{_TS}') AS ended_at FROM p",
    ),
    "alert_set_changed": (
        alert_set_changed,
        f"WITH {_STATUS}, early AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY job ORDER BY id DESC) AS rn FROM runs WHERE ended_at < TIMESTAMP '2024-01-16') x WHERE rn = 1), before AS (SELECT jobs.job, CASE WHEN cadence > 0 AND status = 'ok' AND (epoch_us(TIMESTAMP '2024-01-16') - epoch_us(ended_at)) / 3600000000.0 > cadence * 2 THEN 'warn' ELSE status END AS status FROM jobs JOIN early USING (job)), a AS (SELECT job, status FROM status WHERE status IN ('warn', 'error')), b AS (SELECT job, status FROM before WHERE status IN ('warn', 'error')), d AS (SELECT count(*) AS differences FROM ((SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL (SELECT * FROM b EXCEPT ALL SELECT * FROM a)) z), n AS (SELECT count(*) AS bad_jobs FROM a) SELECT differences, bad_jobs, differences > 0 AS changed, differences > 0 AND bad_jobs > 0 AS fires FROM d, n",
    ),
    "recent_errors": (
        recent_errors,
        f"WITH {RUNS_SQL} SELECT id FROM runs WHERE status = 'error' AND ended_at >= TIMESTAMP '2024-01-31' - INTERVAL 72 HOUR",
    ),
    "age_hours": (age_hours, "SELECT event_id AS id, greatest(0.0::DOUBLE, (epoch_us(TIMESTAMP '2024-01-15') - epoch_us(ts)) / 3600000000.0::DOUBLE) AS age_hours FROM events"),
    "backoff_seconds": (
        backoff,
        "SELECT l_orderkey, CAST(CASE WHEN count(*) <= 1 THEN 0 ELSE least(300, 30 * pow(2, count(*) - 2)) END AS BIGINT) AS seconds FROM lineitem GROUP BY 1",
    ),
    "log_status": (log_status, f"WITH {_LOGS} SELECT job, status, summary FROM log_status"),
    "log_overall": (log_overall, f"WITH {_LOGS} SELECT first(status ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'stale' THEN 1 WHEN 'warn' THEN 2 WHEN 'unknown' THEN 3 ELSE 4 END) AS overall FROM log_status"),
    "last_segment": (
        last_segment,
        f"WITH {LINES_SQL}, s AS (SELECT job, max(line_no) AS start FROM lines WHERE line LIKE '%token = %' GROUP BY 1) SELECT job, count(*) AS lines, min(line_no) AS first_line FROM lines LEFT JOIN s USING (job) WHERE start IS NULL OR line_no >= start GROUP BY 1",
    ),
    "tail_lines": (tail_lines, "SELECT conv_id, turn FROM conversations JOIN (SELECT conv_id, max(turn) AS top FROM conversations GROUP BY 1) x USING (conv_id) WHERE turn > top - 2"),
    "first_match_line": (
        first_match,
        f"WITH {LINES_SQL}, m AS (SELECT job, arg_min(line, line_no) AS line FROM lines WHERE regexp_matches(line, '\\d{{4}}') GROUP BY 1) SELECT j.job, substr(trim(line), 1, 200) AS first_match FROM (SELECT DISTINCT source AS job FROM documents) j LEFT JOIN m USING (job)",
    ),
    "started_at": (
        started_at,
        f"WITH {LINES_SQL}, m AS (SELECT job, arg_min(nullif(regexp_extract(line, 'token = \"(\\w{{6}})', 1), ''), line_no) FILTER (regexp_extract(line, 'token = \"(\\w{{6}})', 1) <> '') AS started_at FROM lines GROUP BY 1) SELECT job, started_at FROM m",
    ),
    "archived_runs": (
        archived_runs,
        "WITH d AS (SELECT source AS folder, doc_id, regexp_matches(replace(text, 'token = \"', 'error:'), '(?i)##\\[error\\]|exit code [1-9]|\\bfailed\\b|\\berror:\\b') AS failed, row_number() OVER (PARTITION BY source ORDER BY doc_id DESC) AS rn, count(*) OVER (PARTITION BY source) AS runs FROM documents) SELECT folder, runs, doc_id AS last_run, CASE WHEN failed THEN 'error' ELSE 'ok' END AS status FROM d WHERE rn = 1",
    ),
    "coverage_summary": (
        coverage,
        "WITH d AS (SELECT CAST(ts AS DATE) AS day, avg(CASE WHEN event_type = 'view' THEN 100.0 ELSE 0.0 END) AS pct, count(*) AS n, count(*) FILTER (event_type = 'purchase') AS s FROM events GROUP BY 1) SELECT count(*) AS runs, min(pct) AS min_pct, avg(pct) AS mean_pct, max(pct) AS max_pct, CAST(sum(n) AS BIGINT) AS verified, CAST(sum(s) AS BIGINT) AS sold_new FROM d",
    ),
}
