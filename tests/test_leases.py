"""Leases as a stream: against a loop over the words, over a restart, with timers."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from lodestone.streaming import leases

SCHEMA = "job long, event_id long, ts timestamp, worker string"
START = datetime(2024, 1, 1, tzinfo=timezone.utc)


def made(n, seed):
    rng = random.Random(seed)
    at = [0] * 6
    out = []
    for k in range(n):
        job = rng.randrange(6)
        at[job] += rng.choice([10, 60, 119, 121, 400]) if rng.random() < 0.9 else 0
        out.append((job, k, START + timedelta(seconds=at[job]), rng.choice("ab")))
    return out


def looped(words, lease=120, recoveries=3):
    state, out = {}, {}
    for job, k, ts, worker in sorted(words, key=lambda w: (w[2], w[1])):
        s = state.setdefault(job, {"holder": worker, "token": 0, "until": ts - timedelta(seconds=1), "taken": -1, "bad": False})
        if s["bad"]:
            outcome = "refused"
        elif ts <= s["until"]:
            outcome = "renewed" if worker == s["holder"] else "fenced"
        elif s["taken"] >= recoveries:
            outcome, s["bad"] = "quarantined", True
        else:
            outcome = "claimed" if s["token"] == 0 else "recovered"
            s.update(holder=worker, token=s["token"] + 1, taken=s["taken"] + 1)
        if outcome in ("claimed", "recovered", "renewed"):
            s["until"] = ts + timedelta(seconds=lease)
        out[k] = (job, outcome, s["token"], s["until"])
    return out


def run(spark, source, folder, late="1 second"):
    stream = spark.readStream.schema(SCHEMA).parquet(source)
    out = leases.lease_outcomes(stream, late=late)
    query = out.writeStream.format("parquet").option("checkpointLocation", f"{folder}/checkpoint").option("path", f"{folder}/rows").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.parquet(f"{folder}/rows")


def outcomes(rows):
    return {r.event_id: (r.job, r.outcome, r.token, r.until) for r in rows.where("event_id is not null").select("*", F.unix_micros("lease_until").alias("until")).collect()}


def test_a_restart_goes_on_with_the_leases(spark, tmp_path):
    words = sorted(made(240, 1), key=lambda w: (w[2], w[1]))
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    want = {k: (*v[:3], int(v[3].timestamp()) * 1_000_000) for k, v in looped(words).items()}
    assert {v[1] for v in want.values()} == {"claimed", "renewed", "fenced", "recovered", "quarantined", "refused"}
    for part in (words[:100], words[100:]):  # two runs over one checkpoint; the second knows what the first one left
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(source)
        rows = run(spark, source, folder, late="10 hours")
    assert outcomes(rows) == want and rows.count() == len(words)


def test_a_lease_that_ran_out_is_told_by_a_timer(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "out")
    spark.createDataFrame([(1, 0, START, "a"), (2, 1, START + timedelta(hours=1), "a")], SCHEMA).coalesce(1).write.parquet(source)
    rows = run(spark, source, folder)
    told = rows.where("outcome = 'expired'").collect()
    assert [(r.job, r.worker, r.token, r.event_id) for r in told] == [(1, "a", 1, None)]


@pytest.mark.parametrize("state, now, outcome", [(None, 0, "claimed"), (("a", 1, 10, 0, False), 10, "renewed"), (("b", 1, 10, 0, False), 10, "fenced"), (("b", 1, 10, 0, False), 11, "recovered"), (("b", 4, 10, 3, False), 11, "quarantined"), (("a", 4, 10, 3, True), 5, "refused")])
def test_decisions(state, now, outcome):
    assert leases.decide(state, "a", now, 100, 3)[0] == outcome
