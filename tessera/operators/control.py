"""Jobs, anomalies and access attempts as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

PAGE_ROWS = 40
WINDOW_SECONDS, MAX_FAILURES = 900, 8
_WINDOWS_PER_SLICE = 24


def job_history(jobs: DataFrame, users: DataFrame, anomalies: DataFrame, limit: int, only_user: int | None = None, search: str = "", to_review: bool = False) -> DataFrame:
    """The latest jobs with their user and how many anomalies they have; filtered before the limit."""
    if only_user is not None:
        jobs = jobs.where(F.col("user_id") == only_user)
    if search:
        jobs = jobs.where(F.contains(F.lower("file"), F.lit(search.lower())))
    if to_review:
        jobs = jobs.where("state = 'da_rivedere'")
    out = jobs.join(users, "user_id").orderBy(F.desc("created"), F.desc("job_id")).limit(limit)
    shown = F.broadcast(out.select("job_id"))  # ``limit`` rows
    counts = anomalies.join(shown, "job_id", "left_semi").groupBy("job_id").agg(F.count("*").alias("n_anomalies"))
    return out.join(counts, "job_id", "left").withColumn("n_anomalies", F.coalesce("n_anomalies", F.lit(0)))


def anomalies_by_field(anomalies: DataFrame) -> DataFrame:
    """How many anomalies each field has; ``first_id`` orders them by first appearance."""
    return anomalies.groupBy("field").agg(F.count("*").alias("n"), F.min("id").alias("first_id"))


def anomaly_page(anomalies: DataFrame, page: int, rows: int = PAGE_ROWS) -> DataFrame:
    """A page of anomalies, those to correct first."""
    return anomalies.orderBy("severity", "id").offset(page * rows).limit(rows)


def job_states(anomalies: DataFrame) -> DataFrame:
    """Anomalies of each job by severity; any to correct leaves the job to be reviewed."""
    out = anomalies.groupBy("job_id").agg(F.count_if(F.col("severity") == "correggi").alias("to_correct"), F.count_if(F.col("severity") == "informativa").alias("informative"))
    return out.withColumn("state", F.when(F.col("to_correct") > 0, "da_rivedere").otherwise("pronto"))


def orphan_inputs(deleted: DataFrame, remaining: DataFrame) -> DataFrame:
    """Files of deleted jobs that no other job reads."""
    return deleted.select("file").distinct().join(remaining.select("file"), "file", "left_anti")


def throttle(attempts: DataFrame, seconds: int = WINDOW_SECONDS, failures: int = MAX_FAILURES) -> DataFrame:
    """Adds ``recent`` (failures of the key in the last ``seconds``, since its last success) and ``refused``.

    attempts: (key, at in whole seconds, id, failed). A key's attempts are cut into slices of time; each slice also
    has the attempts just before it, so that a key with very many attempts is dealt over many tasks. A failure is
    followed by a row of its own where it leaves the window, so all is counted by running sums: work doesn't grow with
    how many attempts a window has.
    """
    size = _WINDOWS_PER_SLICE * seconds
    number = F.floor(F.col("at") / size)
    late = F.pmod(F.col("at"), F.lit(size)) >= size - seconds
    slices = F.when(late, F.array(F.struct(number.alias("slice"), F.lit(True).alias("own")), F.struct((number + 1).alias("slice"), F.lit(False).alias("own")))).otherwise(
        F.array(F.struct(number.alias("slice"), F.lit(True).alias("own")))
    )
    rows = attempts.select("*", F.inline(slices))
    failed = F.coalesce(F.col("failed").cast("int"), F.lit(0))
    ended = F.col("at") + seconds
    moments = F.array(F.struct(F.col("at").alias("_at"), F.lit(1).alias("_kind")), F.when((failed == 1) & (F.floor(ended / size) <= F.col("slice")), F.struct(ended.alias("_at"), F.lit(0).alias("_kind"))))
    rows = rows.select("*", F.inline(F.array_compact(moments)))
    is_attempt = F.col("_kind") == 1
    running = Window.partitionBy("key", "slice").orderBy("_at", "_kind", "id").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"_failed": F.sum(F.when(is_attempt, failed).otherwise(0)).over(running), "_gone": F.sum(F.when(is_attempt, 0).otherwise(1)).over(running)})
    rows = rows.withColumn("_cleared", F.max(F.when(is_attempt & ~F.col("failed"), F.col("_failed"))).over(running)).where(is_attempt)
    recent = F.col("_failed") - F.greatest("_gone", F.coalesce("_cleared", F.lit(0)))
    return rows.where("own").withColumn("recent", recent).withColumn("refused", F.col("recent") >= failures).drop("slice", "own", "_at", "_kind", "_failed", "_gone", "_cleared")


def delete_jobs(tables: dict[str, DataFrame], ids: DataFrame, key: str = "job_id") -> dict[str, DataFrame]:
    """Each table without the rows of the deleted jobs; dependents go with their jobs."""
    gone = ids.select(key).distinct()
    return {name: df.join(gone, key, "left_anti") for name, df in tables.items()}


def decided(anomalies: DataFrame, decisions: DataFrame) -> DataFrame:
    """Anomalies with what was decided for their key and field, where something was."""
    known = decisions.select(F.col("key").alias("_key"), F.col("field").alias("_field"), F.col("value").alias("decision"))
    return anomalies.join(known, (F.col("key") == F.col("_key")) & (F.col("field") == F.col("_field")), "left").drop("_key", "_field")


def log_tail(log: DataFrame, at: str, key: str, n: int = 10) -> DataFrame:
    """The latest entries; of one moment, those of the highest key."""
    return log.orderBy(F.desc(at), F.desc(key)).limit(n)


def expired(work: DataFrame, at: str, now, days: int = 7) -> DataFrame:
    """Work left lying for longer than ``days``."""
    return work.where(F.col(at) < F.lit(now).cast("timestamp") - F.expr(f"INTERVAL {days} DAYS"))
