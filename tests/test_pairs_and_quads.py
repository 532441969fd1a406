"""Pairs of boxes and grown polygons: what their plans must not hold, and values against plain Python."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from regionspark.catalog import evaluation as catalog
from regionspark.functions import geometry as g
from regionspark.operators import checks, evaluate
from regionspark.plans import boxes

REGION = "sample_id long, seq int, polygon array<struct<x:double,y:double>>"
#: Bytecodes of a method above which the JVM does not compile it.
COMPILED = 8000


def explained(df, mode):
    return df.sparkSession._jvm.PythonSQLUtils.explainString(df._jdf.queryExecution(), mode)


def rectangle(x, y, w, h):
    return [(x, y), (x + w, y), (x + w, y + h), (x, y + h)]


def test_pairs_are_compared_in_compiled_code(spark):
    """A guard: the join alone was short enough before (4541), with the filters of G5 on IoU it was not (11866)."""
    rows = spark.range(50).select((F.col("id") % 5).alias("k"), "id", F.struct(*[F.col("id").cast("double").alias(c) if c[:3] == "min" else (F.col("id") + 7.0).alias(c) for c in boxes._BOUNDS]).alias("box"))
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        out = boxes.overlapping(rows, rows, ["k"], ("id", "id")).select("k", "left", "right", g.bbox_iou(F.col("left_box"), F.col("right_box")).alias("iou"))
        sizes = [int(x) for x in re.findall(r"maxMethodCodeSize:(\d+)", explained(out, "codegen"))]
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sizes and max(sizes) < COMPILED


def test_a_filter_on_iou_stays_out_of_the_join(spark):
    rng = random.Random(9)
    rows = lambda: spark.createDataFrame([(s, i, rectangle(0.0, rng.uniform(0, 300), 50.0, 30.0)) for s in range(3) for i in range(15)], REGION)
    expected, found = rows(), rows()
    pairs = evaluate.score_pairs(expected, found)
    assert "Join" not in explained(pairs.where("iou >= 0.5"), "simple")
    top = lambda r: r.polygon[0].y
    both = [(a, b, 30 - abs(top(a) - top(b))) for a in expected.collect() for b in found.collect() if a.sample_id == b.sample_id]
    want = {(a.sample_id, a.seq, b.seq): both / (60 - both) for a, b, both in both if both > 0}
    got = {(r.sample_id, r.seq_e, r.seq_p): r.iou for r in pairs.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    assert pairs.where("iou >= 0.5").count() == sum(v >= 0.5 for v in want.values())


def test_recognition_reads_pairs_whose_iou_is_known(spark):
    """G4's own filters must not bring the formula back into the join."""
    rows = spark.createDataFrame([(s, i, rectangle(0.0, 40.0 * i, 50.0, 30.0)) for s in range(2) for i in range(6)], REGION)
    found = rows.where("seq <> 4").withColumn("polygon", F.transform("polygon", lambda p: g.point(p["x"], p["y"] + 10 * (F.col("seq") % 3))))
    matched = evaluate.match_greedily(evaluate.score_pairs(rows, found))
    assert "Join" not in explained(matched, "simple")
    assert sorted((r.sample_id, r.seq_e, r.seq_p) for r in matched.collect()) == [(s, i, i) for s in range(2) for i in (0, 1, 3)]


def test_shifted_regions_are_made_without_lambdas(spark, tmp_path):
    spark.createDataFrame([(i, "en", "ab\n\u00e9\n\nabcd\nx") for i in range(4)], "doc_id long, lang string, text string").write.parquet(f"{tmp_path}/documents.parquet")
    expected, found = catalog._shifted(spark, str(tmp_path))
    assert "lambda" not in explained(found, "simple")
    moved = {(r.sample_id, r.seq): [(p.x, p.y + 10.0 * (r.seq % 3)) for p in r.polygon] for r in expected.collect()}
    assert len(moved) == 16 and {(r.sample_id, r.seq): [(p.x, p.y) for p in r.polygon] for r in found.collect()} == moved


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        before, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(before[j] + 1, row[-1] + 1, before[j - 1] + (x != y)))
    return row[-1]


def test_texts_that_begin_or_end_the_other_stay_in_the_jvm(spark, monkeypatch):
    rng = random.Random(13)
    text = lambda: "".join(rng.choice("ab\u00e9\U0001f600") for _ in range(rng.randrange(6)))
    pairs = [(text(), text()) for _ in range(300)] + [(a, a + text()) for a in map(str, range(50))] + [("", ""), ("aba", "ab"), ("", "\U0001f600a"), (None, "a"), ("", None), ("ab\u00e9", None), (None, None)]
    df = spark.createDataFrame([(i, *p) for i, p in enumerate(pairs)], "i int, a string, b string").localCheckpoint()
    plain = lambda a, b: (None if a is None else max(1, len(a))) if b is None else None if a is None else distance(a, b)
    got = {r.i: r.e for r in df.select("i", evaluate.character_errors(F.col("a"), F.col("b"), ends=True).alias("e")).collect()}
    want = {i: 1 if p == (None, None) else plain(*p) for i, p in enumerate(pairs)}  # greatest() skips a null
    assert got == want
    monkeypatch.setattr(evaluate, "edit_distance", lambda a, b: F.when(a.isNotNull() | b.isNotNull(), -1))
    got = {r.i: r.e for r in df.where("a is not null and b is not null").select("i", evaluate.character_errors(F.col("a"), F.col("b"), ends=True).alias("e")).collect()}
    ends = lambda a, b: a.startswith(b) or a.endswith(b)
    assert got == {i: want[i] if ends(a, b) or ends(b, a) else -1 for i, (a, b) in enumerate(pairs) if a is not None and b is not None}


@pytest.mark.parametrize("where", [None, "apart"])
def test_a_condition_on_ids_holds_in_cells_and_without(spark, where):
    rng = random.Random(3)
    corners = [(rng.uniform(0, 90), rng.uniform(0, 90)) for _ in range(120)]
    rows = [("few" if i % 4 == 0 else "many", i, (x, y, x + 9.0, y + 9.0)) for i, (x, y) in enumerate(corners)]
    df = spark.createDataFrame(rows, "k string, id long, box struct<min_x:double,min_y:double,max_x:double,max_y:double>").localCheckpoint()
    out = boxes.overlapping(df, df, ["k"], ("id", "id"), dense=70, where=where and F.col("left") < F.col("right"), plain=True)
    meet = lambda a, b: min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])
    assert sorted((r.k, r.left, r.right) for r in out.collect()) == sorted((k, i, j) for k, i, a in rows for q, j, b in rows if k == q and meet(a, b) and (not where or i < j))


def ordered(p):
    if len(set(p)) < 4:
        return None
    cx, cy = sum(x for x, _ in p) / 4, sum(y for _, y in p) / 4
    p = [p[i] for i in sorted(range(4), key=lambda i: (math.atan2(p[i][1] - cy, p[i][0] - cx), i))]
    at = min(range(4), key=lambda i: (p[i][0] + p[i][1], p[i][1], i))
    p = p[at:] + p[:at]
    area = sum(p[i][0] * p[(i + 1) % 4][1] - p[(i + 1) % 4][0] * p[i][1] for i in range(4)) / 2
    return None if abs(area) < 1e-6 else [p[0], p[3], p[2], p[1]] if area < 0 else p


def extended(p, before, after, n, width, height):
    (x0, y0), (x1, y1) = p[:2]
    length = max(1.0, math.sqrt((x1 - x0) ** 2 + (y1 - y0) ** 2))
    by = [-length / n * before * 1.1, length / n * after * 1.1]
    clamp = lambda v, most: max(0.0, v) if most is None else min(most - 1.0, max(0.0, v))
    return ordered([(clamp(x + (x1 - x0) / length * by[i], width), clamp(y + (y1 - y0) / length * by[i], height)) for (x, y), i in zip(p, (0, 1, 1, 0))])


def test_quads_against_plain_python(spark):
    rng = random.Random(12)
    point = lambda: (float(rng.randrange(-3, 40)), float(rng.randrange(-3, 40)))
    quads = [[point() for _ in range(4)] for _ in range(400)] + [rectangle(2.0, 3.0, 9.0, 4.0)[::-1], [(1.0, 1.0)] * 4, [(0.0, 0.0), (1.0, 1.0), (2.0, 2.0), (3.0, 3.0)]]
    rows = [(i, q, rng.randrange(3), rng.randrange(3), rng.randrange(1, 5), rng.choice([30, 60, None]), 25) for i, q in enumerate(quads)]
    odd = [(1000, None, 1, 1, 3, 30, 30), (1001, quads[0][:3], 1, 1, 3, 30, 30), (1002, [], 1, 1, 3, 30, 30), (1003, [*quads[0][:3], None], 1, 1, 3, 30, 30), (1004, [*quads[0][:3], (1.0, None)], 1, 1, 3, 30, 30), (1005, [*quads[0], (5.0, 5.0)], 1, None, 3, 30, 30)]
    df = spark.createDataFrame([v for pair in zip(rows, odd * 80) for v in pair], "i int, q array<struct<x:double,y:double>>, a int, b int, n int, w int, h int").coalesce(1)
    out = df.select("i", "a", "b", "n", "w", "h", "q", g.order_quad(F.col("q")).alias("o"), g.extend_quad(F.col("q"), F.col("a"), F.col("b"), F.col("n"), F.col("w"), F.col("h")).alias("e"))
    plain = lambda q: q and [(p.x, p.y) for p in q]
    got = {r.i: (plain(r.o), plain(r.e)) for r in out.collect()}
    assert got == {i: (ordered(q), extended(q, a, b, n, w, h)) for i, q, a, b, n, w, h in rows} | {r[0]: (None, None) for r in odd}


def test_polygons_are_grown_without_lambdas(spark):
    df = spark.range(5).select(F.array(*[g.point(F.col("id") + x, F.lit(y)) for x, y in rectangle(0.0, 0.0, 5.0, 5.0)]).alias("q"))
    out = df.select(g.bbox(g.extend_quad(F.col("q"), F.lit(1), F.lit(0), F.lit(3), F.lit(99), F.lit(99))).alias("b"))
    assert "lambda" not in explained(out, "simple") and out.count() == 5


def test_refinements_against_all_neighbours(spark):
    rng = random.Random(5)
    rows = []
    for image in range(12):
        for seq in range(12):
            text = "abc"
            rows.append((image, seq, text, 0.9, rectangle(rng.uniform(0, 300), rng.choice([0.0, 20.0, 35.0]), rng.uniform(30, 80), 20.0), rng.choice(["abcd", "xabc", "abcde", "xyz", "abc", None]), rng.choice([0.899, 0.8]), 400, 100))
    df = spark.createDataFrame(rows, "image_id long, seq int, text string, confidence double, polygon array<struct<x:double,y:double>>, candidate string, candidate_confidence double, width int, height int")
    box = lambda q: (min(x for x, _ in q), min(y for _, y in q), max(x for x, _ in q), max(y for _, y in q))
    area = lambda a, b: max(0.0, min(a[2], b[2]) - max(a[0], b[0])) * max(0.0, min(a[3], b[3]) - max(a[1], b[1]))
    want = {}
    for image, seq, text, confidence, q, candidate, then, w, h in rows:
        ok = candidate and text in candidate and 1 <= len(candidate) - len(text) <= 2 and then + 0.005 >= confidence
        new = ok and extended(q, candidate.index(text), len(candidate) - len(text) - candidate.index(text), len(text), w, h)
        free = new and all(area(box(new), box(o[4])) <= area(box(q), box(o[4])) + 1 for o in rows if o[0] == image and o[1] != seq)
        want[image, seq] = (True, candidate, then, new) if free else (False, text, confidence, q)
    out = checks.accept_refinement(df).collect()
    assert len(out) == len(rows) and 5 < sum(v[0] for v in want.values()) < 60
    assert {(r.image_id, r.seq): (r.accepted, r.text, r.confidence, [(p.x, p.y) for p in r.polygon]) for r in out} == want
