"""Overlapping boxes against all pairs, in crowds, strips and stacks."""

import random

import pytest
from pyspark.sql import functions as F

from regionspark.plans import boxes, groups

SIDE = "k string, id long, box struct<min_x:double,min_y:double,max_x:double,max_y:double>"


def make(rng, n, kind):
    out = []
    for i in range(n):
        x, y = {"page": (rng.uniform(-500, 4000), rng.uniform(-500, 4000)), "mixed": (rng.uniform(-50, 300), rng.uniform(-50, 60)), "strip": (rng.uniform(0, 20000), 5.0), "crowd": (rng.uniform(0, 60), rng.uniform(0, 60)), "lines": (0.0, 3.0 * i), "stack": (7.0, 7.0)}[kind]
        w, h = {"page": (rng.uniform(1, 900), rng.uniform(1, 90)), "lines": (5000.0, 4.0)}.get(kind, (rng.choice([0.0, 1.0, 4.0]), rng.uniform(0.5, 5)))
        out.append((rng.choice(["a", "b", None]) if kind == "page" else f"few {i % 7}" if kind == "mixed" and i % 9 == 0 else "a", i, (x, y, x + w, y + h)))
    return out


@pytest.mark.parametrize("kind,dense", [("page", 20), ("page", 256), ("mixed", 12), ("strip", 8), ("crowd", 8), ("lines", 8), ("stack", 8)])
def test_all_pairs(spark, kind, dense):
    rng = random.Random(4)
    n = 60 if kind == "stack" else 200
    left, right = make(rng, n, kind), make(rng, n, kind)
    right += [("a", 900, None), ("a", 901, (1.0, 1.0, None, 2.0)), left[0]]
    out = boxes.overlapping(spark.createDataFrame(left, SIDE), spark.createDataFrame(right, SIDE), ["k"], ("id", "id"), dense=dense)
    got = sorted((r.k, r.left, r.right) for r in out.collect())

    def meet(a, b):
        return all(v is not None for v in (*a, *b)) and min(a[2], b[2]) > max(a[0], b[0]) and min(a[3], b[3]) > max(a[1], b[1])

    assert got == sorted((k, i, j) for k, i, a in left for q, j, b in right if k is not None and k == q and b and meet(a, b))


def test_a_crowded_strip_costs_no_quadratic_task(spark):
    n = 100_000
    rows = spark.range(n).select(F.lit("a").alias("k"), "id", F.struct(*[(F.col("id") * 0.25 + d).alias(c) if c.endswith("x") else F.lit(e).alias(c) for c, d, e in (("min_x", 0.0, 0.0), ("min_y", 0.0, 1.0), ("max_x", 0.2, 0.0), ("max_y", 0.0, 3.0))]).alias("box"))
    leaves = boxes._leaves(rows.select(F.struct("k").alias("key"), F.lit(0).alias("side"), "id", "box"), 256)
    each = leaves.groupBy(*boxes._CELL).count().agg(F.max("count"), F.sum("count")).collect()[0]
    assert each[0] <= 256 and each[1] < 1.05 * n
    assert boxes.overlapping(rows, rows, ["k"], ("id", "id")).count() == n


@pytest.mark.parametrize("small", [0, 5, 100_000])
def test_groups_in_one_pass_and_in_rounds(spark, small):
    rng = random.Random(small)
    layers = [(i, s) for i in (1, 2, 3, None) for s in range(30)]
    pairs = [(i, *sorted(rng.sample(range(30), 2))) for i, n in ((1, 4), (2, 25), (3, 0)) for _ in range(n)] + [(2, k, k + 1) for k in range(20, 29)][::-1]
    out = groups.visual_groups(spark.createDataFrame(layers, "image_id long, seq int"), spark.createDataFrame(pairs, "image_id long, a int, b int").repartition(3), small)
    want = {(i, s): s for i, s in layers}
    for _ in range(30):
        for i, a, b in pairs:
            want[i, a] = want[i, b] = min(want[i, a], want[i, b])
    assert {(r.image_id, r.seq): r.component for r in out.collect()} == want and out.count() == len(layers)
