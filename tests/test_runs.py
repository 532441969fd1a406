"""The data source of runs: partitions, checks, and a stream of new run folders."""

import json

import pytest
from pyspark.sql import types as T

from regionspark.sources import runs

CASE = "case_id string NOT NULL, n long, box array<double>, font struct<size:double,name:string>, _run string"


@pytest.fixture(scope="module")
def source(spark):
    return runs.register(spark)


def put(folder, name, value, done=False):
    folder.mkdir(parents=True, exist_ok=True)
    (folder / name).write_text(value if isinstance(value, str) else json.dumps(value))
    if done:
        (folder / "_SUCCESS").write_text("")


def load(spark, path, schema=CASE, **options):
    return spark.read.format("region_runs").schema(schema).options(records="cases", **options).load(f"file://{path}")


def test_a_folder_is_read_in_several_partitions(source, tmp_path):
    for i in range(20):
        put(tmp_path / f"run{i % 3}", f"{i:02}.json", {"cases": [{"case_id": f"{i}/{k}", "n": k, "box": [1, 2.5], "font": {"size": 3, "else": 0}, "more": []} for k in range(150)]})
    put(tmp_path / "_staged", "x.json", {"cases": [{"case_id": "hidden"}]})
    one = (tmp_path / "run0" / "00.json").stat().st_size
    df = load(source, tmp_path, runbytes=3 * one)
    got = df.collect()
    assert 6 <= df.rdd.getNumPartitions() <= 10 and len(got) == 3000 and {r._run for r in got} == {"run0", "run1", "run2"}
    row = next(r for r in got if r.case_id == "7/149")
    assert (row.n, row.box, row.font.size, row.font.name, row._run) == (149, [1.0, 2.5], 3.0, None, "run1")
    assert runs.refuse_repeated(df, "case_id") is df
    put(tmp_path / "run9", "a.json", {"cases": [{"case_id": "7/149"}]})
    with pytest.raises(ValueError, match="more than once: 7/149"):
        runs.refuse_repeated(load(source, tmp_path), "case_id")


def test_records_are_checked(source, tmp_path):
    bad = {"a": {"cases": [{"case_id": "good"}, {"n": 1}, {"case_id": 5}, {"case_id": "x", "n": 2**63}, {"case_id": "x", "n": True}, {"case_id": "x", "box": [1, "2"]}, {"case_id": "x", "font": []}, "no"]}, "b": "[]", "c": "{", "d": {"cases": None}, "e": ""}
    for name, value in bad.items():
        put(tmp_path, f"{name}.json", value)
    got = load(source, tmp_path, CASE.replace(" NOT NULL", "") + ", _file string, _problem string", required="case_id").orderBy("_file").collect()
    assert [r.case_id for r in got if r._problem is None] == ["good"]
    said = [r._problem for r in got if r._problem]
    assert said[:8] == ["cases[1].case_id is missing", "cases[2].case_id is no string", "cases[3].n is no bigint", "cases[4].n is no bigint", "cases[5].box[1] is no double", "cases[6].font is no object", "cases[7] is no object", "no JSON object"]
    assert said[8].startswith("no JSON: ") and said[9] == "cases is no array" and said[10].startswith("no JSON: ") and len(said) == 11
    with pytest.raises(Exception, match="case_id is missing"):
        load(source, tmp_path).collect()
    with pytest.raises(Exception, match="use option required"):
        load(source, tmp_path, CASE + ", _problem string").collect()
    (tmp_path / "none").mkdir()
    assert load(source, tmp_path / "none").count() == load(source, tmp_path / "nowhere").count() == 0
    with pytest.raises(Exception, match="needs a schema"):
        source.read.format("region_runs").load(f"file://{tmp_path}")


def test_misfit_of_types():
    m = T.MapType(T.StringType(), T.IntegerType(), False)
    assert runs.misfit({"a": 1}, m) is None and runs.misfit({"a": None}, m) == "record.a is missing" and runs.misfit([], m) == "record is no object"
    assert runs.shaped({"a": 1}, m) == [("a", 1)] and runs.misfit(1, T.BooleanType()) == "record is no boolean" and runs.misfit(-(2**31), T.IntegerType()) is None
    assert runs.misfit("2020-01-01", T.DateType()) == "record: type date is not read"


def test_a_stream_gives_each_complete_run_once(source, tmp_path):
    path, sink, state = tmp_path / "runs", tmp_path / "out", tmp_path / "state"
    path.mkdir()

    def step():
        rows = source.readStream.format("region_runs").schema(CASE).option("records", "cases").load(f"file://{path}")
        query = rows.writeStream.format("parquet").option("checkpointLocation", f"file://{state}").trigger(availableNow=True).start(f"file://{sink}")
        query.awaitTermination()
        return sorted(r.case_id for r in source.read.schema("case_id string").parquet(f"file://{sink}").collect())

    put(path / "001", "a.json", {"cases": [{"case_id": "1"}]}, True)
    put(path / "002", "a.json", {"cases": [{"case_id": "2"}]})
    assert step() == ["1"]
    put(path / "002", "b.json", {"cases": [{"case_id": "2b"}]}, True)
    put(path / "004", "a.json", {"cases": [{"case_id": "4"}]}, True)
    assert step() == ["1", "2", "2b", "4"]  # a new query goes on where the last one ended
    assert step() == ["1", "2", "2b", "4"]
    put(path / "003", "late.json", {"cases": [{"case_id": "3"}]}, True)
    with pytest.raises(Exception, match="came or went below"):
        step()
