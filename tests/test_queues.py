"""State changes of queues against small cases."""

from pyspark.sql import functions as F

from srcquarry.operators import queues as Q

JOB = "id string, status string, run_at int, created_run_id string"


def jobs(spark):
    rows = [("a", "pending", 5, None), ("b", "pending", 3, None), ("c", "running", 1, "r0"), ("d", "completed", 1, "r1"), ("e", "pending", 3, None), ("f", None, None, None), ("g", "pending", None, None)]
    return spark.createDataFrame(rows, JOB)


def state(df):
    return {r.id: (r.status, r.run_at, r.created_run_id) for r in df.collect()}


def test_claim_takes_the_oldest_due(spark):
    before, got = state(jobs(spark)), state(Q.claim(jobs(spark), F.lit(4), 1))
    assert got == before | {"b": ("running", 3, None)}
    assert state(Q.claim(jobs(spark), F.lit(4), 9, "processing")) == before | {"b": ("processing", 3, None), "e": ("processing", 3, None)}
    assert state(Q.claim(jobs(spark), F.lit(0), 9)) == before and Q.claim(jobs(spark).limit(0), F.lit(4)).count() == 0


def test_only_running_jobs_end_and_links_need_a_run(spark):
    runs = spark.createDataFrame([("r1",), ("r1",), ("r2",)], "run_id string")
    done = spark.createDataFrame([("c", "r2", False), ("c", "r2", False), ("a", "r1", True), ("x", "r1", True), (None, "r1", True)], "id string, run_id string, ok boolean")
    before = state(jobs(spark))
    assert state(Q.settle(jobs(spark), done, runs)) == before | {"c": ("failed", 1, "r2")}
    again = spark.createDataFrame([("c", "gone", 9), ("d", "r1", 9)], "id string, run_id string, next_run_at int")
    assert state(Q.reschedule(jobs(spark), again, runs)) == before | {"c": ("pending", 9, "r0")}
    assert state(Q.cancel(jobs(spark), done.select("id"))) == before | {"a": ("cancelled", 5, None)}
