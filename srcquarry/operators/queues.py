"""State changes of queues (jobs, exports) as tables before and after; a row changes only from the state it has to be in.

Rows have id, status, run_at and created_run_id; an unknown id changes nothing. Taking rows under a lock is the host's:
``claim`` is what one claim of several rows changes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F


def _changed(jobs: DataFrame, other: DataFrame, when: str, new: dict[str, Column]) -> DataFrame:
    """``jobs`` with the columns of ``new`` where ``other`` (id, ...) names a row that is in the state ``when``."""
    j = jobs.join(other.withColumn("__named", F.lit(True)), "id", "left")
    hit = F.coalesce(F.col("__named") & (F.col("status") == when), F.lit(False))
    return j.select(*[F.when(hit, new[c]).otherwise(F.col(c)).alias(c) if c in new else F.col(c) for c in jobs.columns])


def _link(other: DataFrame, runs: DataFrame) -> DataFrame:
    """One row of ``other`` (id, run_id, ...) for each id, the smallest, with ``__run``, the run if it exists."""
    other = other.groupBy("id").agg(F.min(F.struct(*[c for c in other.columns if c != "id"])).alias("__one")).select("id", "__one.*")
    known = runs.select(F.col("run_id"), F.col("run_id").alias("__run")).distinct()
    return other.join(known, "run_id", "left").drop("run_id")


def claim(jobs: DataFrame, now: Column, n: int = 1, busy: str = "running") -> DataFrame:
    """The ``n`` oldest pending rows that are due become ``busy`` (a bounded top list, no sort of the queue)."""
    due = jobs.filter((F.col("status") == "pending") & (F.col("run_at") <= now)).orderBy("run_at", "id").limit(n).select("id")
    return _changed(jobs, due, "pending", {"status": F.lit(busy)})


def settle(jobs: DataFrame, done: DataFrame, runs: DataFrame) -> DataFrame:
    """Running rows named in ``done`` (id, run_id, ok) are completed or failed; the run is kept if it exists, else emptied."""
    return _changed(jobs, _link(done, runs), "running", {"status": F.when(F.col("ok"), "completed").otherwise("failed"), "created_run_id": F.col("__run")})


def reschedule(jobs: DataFrame, again: DataFrame, runs: DataFrame) -> DataFrame:
    """Running rows named in ``again`` (id, run_id, next_run_at) are pending anew; an unknown run leaves the one before."""
    new = {"status": F.lit("pending"), "run_at": F.col("next_run_at"), "created_run_id": F.coalesce("__run", "created_run_id")}
    return _changed(jobs, _link(again, runs), "running", new)


def cancel(jobs: DataFrame, ids: DataFrame) -> DataFrame:
    """Pending rows named in ``ids`` are cancelled."""
    return _changed(jobs, ids.select("id").distinct(), "pending", {"status": F.lit("cancelled")})
