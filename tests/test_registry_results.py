"""Numbers of configuration versions, manual regions through P1, the canonical signature, results that are replaced as a whole."""

import hashlib
import json
import random

import pytest
from pyspark.sql import functions as F

from regionspark.functions import geometry as g
from regionspark.operators import evaluate, registry
from regionspark.plans import units
from regionspark.sources import scans


def test_a_rollback_makes_a_version(spark):
    steps = [("create", None), ("publish", 1), ("create", None), ("rollback", 2), ("publish", 2), ("rollback", 1), ("publish", 3), ("rollback", 3), ("rollback", 9), ("publish", None), ("create", 7)]
    log = spark.createDataFrame([(k, i, a, v) for k in ("a", None) for i, (a, v) in enumerate(steps)], "scope string, seq long, action string, version int")
    out = registry.config_versions(log).where("scope = 'a'").orderBy("seq").collect()
    assert [(r.outcome, r.made, r.source_version, r.status) for r in out] == [
        ("ok", 1, None, None), ("ok", 1, None, "superseded"), ("ok", 2, None, None), ("conflict", None, None, None), ("ok", 2, None, "superseded"), ("ok", 3, 1, "superseded"),
        ("conflict", None, None, None), ("ok", 4, 3, "published"), ("not_found", None, None, None), ("not_found", None, None, None), ("ok", 5, None, None),
    ]
    assert registry.config_versions(log).where("scope is null").count() == len(steps)


def test_manual_regions_run_p1(spark):
    rows = [(1, "source_text", "Hello", "", "", "en"), (2, "source_text", "Bonjour", "", "", "fr"), (3, "auto", "", "", "  ", "en"), (4, "translated_text", "", " given ", "", "en"), (5, "source_text", "X100", "", "", "en"), (6, "auto", "", "", "Lost", "en")]
    specs = spark.createDataFrame([(*r, r[5]) for r in rows], "spec_id long, mode string, source_text string, translated_text string, recognised_text string, ocr_language string, recognised_language string")
    specs = specs.withColumn("box", g.box(F.lit(50.0), F.lit(50.0), F.lit(20.0), F.lit(20.0), F.lit(0.0))).withColumn("width", F.lit(100)).withColumn("height", F.lit(100))
    items = spark.createDataFrame([(1, "Salut", None, None), (5, "x", None, None)], "spec_id long, translated_text string, source_language string, error_code string")
    out = {r.spec_id: (r.displayed_source, r.text, r.code) for r in units.manual_units(specs, items, "fr").collect()}
    skipped = "manual_translation_skipped"
    assert out == {1: ("Hello", "Salut", None), 2: ("Bonjour", None, skipped), 3: ("", None, "manual_ocr_empty"), 4: ("given", "given", None), 5: ("X100", None, skipped), 6: ("Lost", None, skipped)}


def test_canonical_signature(spark):
    rng, lines = random.Random(2), "array<struct<text_start:int,text_end:int,direction:string,clusters:array<struct<text_start:int,text_end:int>>>>"
    rows = [(rng.choice(["qt", "hb", "other"]), rng.choice(['a"b', "é", "z\\", "字", *map(str, range(30))]), f"{i:03}", [(i, i + 2, "rtl", [(0, i), (i, 9)])] * rng.randint(0, 2)) for i in range(120)]
    df = spark.createDataFrame(rows, f"backend string, case_id string, path string, lines {lines}").repartition(5)
    canonical = {"qt": {}, "hb": {}, "none": {}}
    for backend, case, _, own in sorted(rows, key=lambda r: r[2]):
        if backend in canonical:
            canonical[backend][case] = {"lines": [{"range": [a, b], "direction": d, "clusters": [list(c) for c in cs]} for a, b, d, cs in own]}
    want = hashlib.sha256(json.dumps(canonical, ensure_ascii=False, sort_keys=True, separators=(",", ":")).encode()).hexdigest()
    out = evaluate.canonical_signature(df, ("qt", "none", "hb")).collect()
    assert [(r.n, r.signature) for r in out] == [(len(canonical["qt"]) + len(canonical["hb"]), want)]
    empty = hashlib.sha256(b'{"hb":{},"qt":{}}').hexdigest()
    assert evaluate.canonical_signature(df.limit(0), ("qt", "hb")).collect()[0].signature == empty


def test_canonical_signature_sorts_before_its_one_task(spark, monkeypatch):
    """Pieces that are cut anywhere give one digest, and the last task reads them without a sort or a shuffle of its own."""
    line = F.array(F.struct(F.lit(0).alias("text_start"), F.lit(9).alias("text_end"), F.lit("ltr").alias("direction"), F.array(F.struct(F.lit(0).alias("text_start"), F.lit(9).alias("text_end"))).alias("clusters")))
    df = spark.range(0, 500, 1, 7).select(F.when(F.col("id") % 3 == 0, "b").otherwise("a").alias("backend"), F.col("id").cast("string").alias("case_id"), line.alias("lines"), F.lit("p").alias("path"))
    want = evaluate.canonical_signature(df, ("a", "b", "c"))
    plan = want._jdf.queryExecution().optimizedPlan().toString()
    assert "Sort" not in plan and "Repartition" not in plan
    monkeypatch.setattr(evaluate, "PIECE", 50)
    assert want.collect() == evaluate.canonical_signature(df.repartition(3), ("c", "b", "a")).collect()


def test_results_are_replaced_as_a_whole(spark, tmp_path):
    path, schema = f"file://{tmp_path}/results", "id long, version int"
    rows = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(20)], "id long, batch_id string")
    load = lambda: sorted(map(tuple, scans.load_results(spark, path, schema).collect()))
    scans.write_results(rows.withColumn("version", F.lit(1)), path)
    before = load()
    assert before == sorted((i, 1, "ab"[i % 2]) for i in range(20))
    bad = F.when(F.col("id") == 18, F.raise_error(F.lit("lost"))).otherwise(2).cast("int")
    with pytest.raises(Exception, match="lost"):
        scans.write_results(rows.repartition(4).withColumn("version", bad), path)
    assert load() == before  # a reader sees the old rows after a write that failed on its way
    scans.write_results(rows.where("batch_id = 'a'").withColumn("version", F.lit(3)), path)
    open_ = scans.load_results(spark, path, schema)
    scans.clear_results(spark, path, "b")
    assert load() == [(i, 3, "a") for i in range(0, 20, 2)]
    scans.write_results(rows.limit(0).withColumn("version", F.lit(4)), path)
    assert scans.vacuum_results(spark, path) >= 1 and load() == [(i, 3, "a") for i in range(0, 20, 2)] and open_.columns == ["id", "version", "batch_id"]


def test_sketches_merge_within_the_error(spark):
    rows = spark.range(60_000).select((F.col("id") % 3).alias("k"), (F.col("id") % 7).alias("day"), F.when(F.col("id") % 11 == 0, None).otherwise(F.exp((F.col("id") * 7919 % 10_007) / 900)).alias("v"))  # skewed
    stored = evaluate.repair_sketches(rows, ["k", "day"], "v")
    assert stored.agg(F.max(F.length("sketch"))).collect()[0][0] < 50_000
    exact = {r.k: r for r in evaluate.repair_summary(rows.where("v is not null"), ["k"], "v").collect()}
    values = {k: sorted(r.v for r in rows.where(f"k = {k} and v is not null").collect()) for k in range(3)}
    for r in evaluate.sketched_summary(stored, ["k"]).collect():
        assert r.n == exact[r.k].n and r.max == exact[r.k].max and abs(r.mean / exact[r.k].mean - 1) < 1e-9
        for got, rank in ((r.median, 0.5), (r.p95, 0.95)):
            assert abs(sum(v <= got for v in values[r.k]) / r.n - rank) < evaluate.RANK_ERROR
    few = evaluate.sketched_summary(evaluate.repair_sketches(spark.createDataFrame([(1, 5.0), (1, None), (1, 7.0), (1, 9.0)], "k long, v double"), ["k"], "v"), ["k"]).collect()
    assert [(x.n, x.median, x.p95, x.max) for x in few] == [(3, 7.0, 9.0, 9.0)]
