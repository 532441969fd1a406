"""The split scan of automata against a fold, with one key that holds most rows."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from regionspark import dims
from regionspark.operators import batch, registry
from regionspark.plans import automata
from regionspark.streaming import jobs


def fold(machine, rows, key, symbol):
    state, out = {}, []
    for r in rows:
        s = state.get(key(r), 0)
        out.append((*r, s))
        state[key(r)] = machine.moves[symbol(r)][s]
    return out


@pytest.mark.parametrize("partitions,hot", [("7", 0.9), ("3", 1.0), ("12", 0.0)])
def test_states_equal_a_fold(spark, partitions, hot):
    rng = random.Random(3)
    machine = automata.Machine([[rng.randrange(5) for _ in range(5)] for _ in range(4)])
    rows = [("hot" if rng.random() < hot else rng.choice(["a", "b", None, "z"]), i, rng.randrange(4)) for i in range(900)]
    df = spark.createDataFrame(rows, "k string, i long, s int").withColumn("row", F.col("i")).withColumn("key", F.lit("clash")).repartition(5)
    before = {c: spark.conf.get(c) for c in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    try:
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
        out = automata.states_before(df, ["k"], ["i"], F.col("s"), machine)
        got = [(r.k, r.i, r.s, r.state) for r in out.collect()]
    finally:
        for c, v in before.items():
            spark.conf.set(c, v)
    assert sorted(got, key=lambda r: r[1]) == fold(machine, rows, lambda r: r[0], lambda r: r[2])
    assert out.columns == [*df.columns, "state"]


def test_batches_smaller_than_stretches(spark):
    machine = automata.Machine([[1, 2, 0], [0, 0, 2]])
    rows = [(i // 400, i, i % 7 % 2) for i in range(1000)]
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
        out = automata.states_before(spark.createDataFrame(rows, "k long, i long, s int"), ["k"], ["i"], F.col("s"), machine).collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)
    assert sorted(map(tuple, out), key=lambda r: r[1]) == fold(machine, rows, lambda r: r[0], lambda r: r[2])
    assert automata.states_before(spark.createDataFrame([], "k long, i long, s int"), ["k"], ["i"], F.col("s"), machine).count() == 0
    with pytest.raises(ValueError):
        automata.Machine([[0, 3]])


def test_stage_monitor_equals_the_fold(spark):
    rng = random.Random(5)
    at = dt.datetime(2024, 1, 1)
    stage = lambda i: rng.choice([dims.STAGES[i % 5], "other", None])
    rows = [(None if i % 50 == 0 else i // 40, i, at + dt.timedelta(seconds=i), rng.choice(["advance"] * 9 + ["complete", "fail", None]), stage(i)) for i in range(600)]
    rows += [(99, 1000 + i, at, e, s) for i, (e, s) in enumerate([*(("advance", s) for s in dims.STAGES), ("complete", None), ("advance", "ocr")])]
    df = spark.createDataFrame(rows, "job_id long, id long, ts timestamp, event string, stage string")
    got = batch.stage_monitor(df, ["job_id"], ["ts", "id"]).select("job_id", "id", "violation").collect()
    want = jobs.batch(df, ["job_id"], jobs.stages, "job_id long, id long, violation boolean").collect()
    assert sorted(map(str, got)) == sorted(map(str, want)) and {r.id: r.violation for r in got if r.id >= 1000} == {**{1000 + i: False for i in range(6)}, 1006: True}


def test_binder_outcomes_equal_the_fold(spark):
    rng = random.Random(7)
    at = dt.datetime(2024, 1, 1)
    rows = [(rng.choice([None, 1, 2, 3, 4]), i, at + dt.timedelta(hours=rng.randrange(99)), "disable" if rng.random() < 0.04 else "activate", f"d{rng.randrange(3)}", 1 + i % 2) for i in range(300)]
    rows += [(9, 901, at, "disable", None, None), (9, 902, at, "activate", "d", 1)]
    df = spark.createDataFrame(rows, "code long, id long, ts timestamp, event string, device string, days int")
    want = jobs.batch(df, ["code"], jobs.binder, "code long, id long, outcome string").collect()
    assert sorted(map(str, registry.binder_outcomes(df).collect())) == sorted(map(str, want))
