"""X1-X4 on keyed state: against the batch twins over several runs from one checkpoint, repeated micro-batches, idle keys."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from regionspark import dims, session
from regionspark.streaming import jobs, state

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LIMITS = {"s0": (2, 30.0), "s1": (1, 50.0)}
JOBS = {
    "limiter": (lambda: state.Limiter(LIMITS), "scope string, identity string", ["scope", "identity"], lambda i: (f"s{i % 2}", f"k{i % 5}"), "", lambda i: ()),
    "stages": (lambda: state.Stages(1e6), "job_id long", ["job_id"], lambda i: (i % 9,), ", event string, stage string", lambda i: ("complete" if i % 31 == 0 else "advance", dims.STAGES[i // 9 % 5])),
    "binder": (lambda: state.Binder(1e9), "code long", ["code"], lambda i: (i % 7,), ", event string, device string, days int", lambda i: ("disable" if i % 83 == 0 else "activate", f"d{i % 3}", i % 2)),
    "progress": (lambda: state.Progress(1e6), "batch_id long", ["batch_id"], lambda i: (i % 3,), ", item long, status string", lambda i: (i % 11, ["running", *dims.TERMINAL][i % 4])),
}
FOLDS = {"limiter": jobs.scoped_limiter(LIMITS), "stages": jobs.stages, "binder": jobs.binder}


@pytest.fixture
def rocks(spark):
    setting = "spark.sql.streaming.stateStore.providerClass"
    spark.conf.set(setting, session.SETTINGS[setting])
    yield spark
    spark.conf.unset(setting)


def feed(spark, folder, k, rows, schema):
    folder.mkdir(exist_ok=True)
    spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(folder.parent / f"new{k}"))
    for f in (folder.parent / f"new{k}").glob("part-*.parquet"):
        f.rename(folder / f"{k}-{f.name}")


def run(spark, tmp_path, schema, keys, job, late="0 seconds"):
    rows = spark.readStream.schema(schema).parquet(str(tmp_path / "in"))
    query = state.write_updates(state.keyed(rows, keys, job, late), str(tmp_path / "out"), str(tmp_path / "cp"), availableNow=True)
    query.awaitTermination(180)
    assert query.exception() is None
    return query


@pytest.mark.parametrize("name", sorted(JOBS))
def test_restarts_equal_batch(rocks, tmp_path, name):
    make, key_schema, keys, key, more, payload = JOBS[name]
    schema = f"{key_schema}, id long, ts timestamp{more}"
    data = [(*key(i), i, START + dt.timedelta(seconds=3 * i), *payload(i)) for i in range(160)]
    for k in range(3):  # each run starts from the checkpoint of the one before
        feed(rocks, tmp_path / "in", k, data[54 * k : 54 * k + 54], schema)
        run(rocks, tmp_path, schema, keys, make())
    all_rows = rocks.createDataFrame(data, schema)
    if name == "progress":
        got = state.latest(rocks, str(tmp_path / "out"), make().schema, keys)
        last = all_rows.groupBy("batch_id", "item").agg(F.max_by("status", "id").alias("status"))
        want = last.groupBy("batch_id").agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in dims.TERMINAL])
        assert sorted(got.select(want.columns).collect()) == sorted(want.collect())
        assert all(r.finished == r.completed + r.failed + r.cancelled and r.progress == r.finished / r.total for r in got.collect())
    else:
        got = rocks.read.schema(make().schema).parquet(str(tmp_path / "out")).drop("epoch")
        assert sorted(got.collect()) == sorted(jobs.batch(all_rows, keys, FOLDS[name], make().schema).collect())


def test_a_repeated_micro_batch_replaces_itself(rocks, tmp_path):
    make, key_schema, keys, key, more, payload = JOBS["limiter"]
    schema = f"{key_schema}, id long, ts timestamp{more}"
    feed(rocks, tmp_path / "in", 0, [(*key(i), i, START + dt.timedelta(seconds=3 * i)) for i in range(40)], schema)
    run(rocks, tmp_path, schema, keys, make())
    before = sorted(rocks.read.parquet(str(tmp_path / "out")).collect())
    for commit in (tmp_path / "cp" / "commits").iterdir():  # as if the driver had gone after the write and before the commit
        commit.unlink()
    run(rocks, tmp_path, schema, keys, make())
    assert sorted(rocks.read.parquet(str(tmp_path / "out")).collect()) == before and len(before) == 40


def test_idle_keys_expire(rocks, tmp_path):
    schema = "job_id long, id long, ts timestamp, event string, stage string"
    row = lambda job, i, s: (job, i, START + dt.timedelta(seconds=s), "advance", dims.STAGES[0])
    rows_kept = []
    for k, some in enumerate(([row(1, 1, 0), row(2, 2, 0)], [row(2, 3, 50)], [row(3, 4, 1000)], [row(1, 5, 1001), row(3, 6, 1002)])):
        feed(rocks, tmp_path / "in", k, some, schema)
        query = run(rocks, tmp_path, schema, ["job_id"], state.Stages(100))
        rows_kept.append(query.lastProgress["stateOperators"][0]["numRowsTotal"])
    out = {r.id: r.violation for r in rocks.read.schema(state.Stages.schema).parquet(str(tmp_path / "out")).collect()}
    assert out == {1: False, 2: False, 3: True, 4: False, 5: False, 6: True}  # job 1 starts anew, job 3 goes on
    assert rows_kept[-1] <= rows_kept[1]


def test_limits_by_scope(spark):
    assert state.policies(spark) == {s: (n, float(w)) for s, n, w in dims.RATE_POLICIES}
    with pytest.raises(ValueError):
        state.Limiter({"a": (0, 1.0)})
