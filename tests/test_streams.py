"""The live loop's state over restarts and its timer, against the batch replay."""

import datetime

from pyspark.sql import functions as F

from panelspark.operators import adaptive
from panelspark.streaming import trials as live

SCHEMA = "rater string, step int, choice string, ts timestamp"
START = datetime.datetime(2024, 1, 1)


def pool_of(spark):
    values = spark.createDataFrame([(axis, v) for axis in "xy" for v in (-2.0, -1.0, 0.0, 1.5)], "axis string, value double")
    return [r.asDict() for r in adaptive.trial_pool(values).collect()]


def add(spark, folder, rows):
    data = [(r, s, c, START + datetime.timedelta(minutes=m)) for r, s, c, m in rows]
    spark.createDataFrame(data, SCHEMA).coalesce(1).write.mode("append").json(folder)


def run(spark, tmp_path, pool, name, timeout):
    stream = spark.readStream.schema(SCHEMA).json(str(tmp_path / "in"))
    out = live.live_trials(stream, pool, 6, timeout=timeout)
    q = out.writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).queryName(name).start()
    q.processAllAvailable()
    q.stop()


def test_state_survives_a_restart_and_equals_the_replay(spark, tmp_path):
    pool, folder = pool_of(spark), str(tmp_path / "in")
    said = {"u1": ["A", "B", "TIE", "A", "ABSTAIN", "B"], "u2": ["B", "B", "A", "ABSTAIN", "A", "A"]}
    for low, high in ((0, 2), (2, 3), (3, 6)):  # each part is read by a query of its own, from the state of the one before
        add(spark, folder, [(r, i, c, i) for r, choices in said.items() for i, c in list(enumerate(choices))[low:high]])
        run(spark, tmp_path, pool, f"part{low}", None)
    got = {(r.rater, r.step): r for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    answers = spark.createDataFrame([(r, i, c) for r, choices in said.items() for i, c in enumerate(choices)], "rater string, position int, choice string")
    replayed = adaptive.replay(answers, pool, 6).collect()
    assert len(got) == len(replayed) == 12
    for r in replayed:
        if r.step:  # the answer before it was given this trial
            shown = got[r.rater, r.step - 1]
            assert (shown.trial_id, shown.axis, shown.a, shown.b) == (r.trial_id, r.axis, r.a, r.b)
    assert {got[r, 5].status for r in said} == {"complete"} and {got[r, 4].status for r in said} == {"repeat"}


def test_a_timer_closes_a_study(spark, tmp_path):
    pool, folder = pool_of(spark), str(tmp_path / "in")
    add(spark, folder, [("u1", 0, "A", 0), ("u2", 0, "A", 0), ("u2", 3, "A", 1)])
    run(spark, tmp_path, pool, "first", "30 minutes")
    add(spark, folder, [("u1", 1, "B", 25)])
    run(spark, tmp_path, pool, "second", "30 minutes")
    add(spark, folder, [("u3", 0, "A", 40)])  # the watermark passes u2's timer, not u1's, which its second answer moved
    run(spark, tmp_path, pool, "third", "30 minutes")
    add(spark, folder, [("u2", 1, "B", 41)])
    run(spark, tmp_path, pool, "fourth", "30 minutes")
    got = sorted((r.rater, r.step, r.status) for r in spark.read.parquet(str(tmp_path / "out")).select("rater", "step", F.col("status")).collect())
    assert got == [("u1", 0, "next"), ("u1", 1, "next"), ("u2", 0, "next"), ("u2", 1, "mismatch"), ("u2", 1, "timeout"), ("u2", 3, "mismatch"), ("u3", 0, "next")]
