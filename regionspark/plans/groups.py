"""Paragraphs and visual groups."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from regionspark.functions import geometry as g
from regionspark.plans import boxes
from regionspark.session import shared_dir, written


def paragraphs(rows: DataFrame, cjk: Column, least: int = 10) -> DataFrame:
    """W3 on translated regions (image_id, seq, text, target_language, polygon): paragraph number per image. A row continues
    the row before it if both are long texts of the script (cjk), upright, alike in height, flush left, close and
    overlapping. Windows run inside an image."""
    w = W.partitionBy("image_id").orderBy("seq")
    b = g.quad_to_box(F.col("polygon"))
    rows = rows.withColumn("_b", b).withColumn("_ok", (F.length("text") >= least) & cjk)
    rows = rows.withColumn("_p", F.lag(F.struct("_b", "_ok", "target_language")).over(w))
    a, c = F.col("_p._b"), F.col("_b")
    low, high = F.least(a["height"], c["height"]), F.greatest(a["height"], c["height"])
    left = lambda x: x["center_x"] - x["width"] / 2
    right = lambda x: x["center_x"] + x["width"] / 2
    gap = (c["center_y"] - c["height"] / 2) - (a["center_y"] + a["height"] / 2)
    joins = (
        (F.col("_p.target_language") == F.col("target_language")) & F.col("_p._ok") & F.col("_ok") & (F.abs(a["rotation_degrees"]) <= 3) & (F.abs(c["rotation_degrees"]) <= 3) & (high <= low * 1.35)
        & (F.abs(left(a) - left(c)) <= high * 0.25) & (gap >= -0.2 * low) & (gap <= high * 0.35) & (F.least(right(a), right(c)) - F.greatest(left(a), left(c)) >= F.least(a["width"], c["width"]) * 0.65)
    )
    return rows.withColumn("paragraph", F.sum(F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)).over(w)).drop("_b", "_ok", "_p")


def paragraph_boxes(rows: DataFrame) -> DataFrame:
    """Bounds and text of each paragraph, its lines in order."""
    b = rows.withColumn("_b", g.bbox(F.col("polygon")))
    ordered = F.array_sort(F.collect_list(F.struct("seq", "text")))  # a paragraph's lines
    return b.groupBy("image_id", "paragraph").agg(F.min("_b.min_x").alias("min_x"), F.min("_b.min_y").alias("min_y"), F.max("_b.max_x").alias("max_x"), F.max("_b.max_y").alias("max_y"), F.array_join(F.transform(ordered, lambda x: x["text"]), " ").alias("text"))


def mask_bounds(erased: DataFrame) -> DataFrame:
    """Per image the bounds of all points of its erased polygons."""
    p = erased.select("image_id", F.explode("polygon").alias("p"))
    return p.groupBy("image_id").agg(F.min("p.x").alias("min_x"), F.min("p.y").alias("min_y"), F.max("p.x").alias("max_x"), F.max("p.y").alias("max_y"))


#: Half width and height of a layer's reach, in its heights: two layers that look alike differ in height by a factor of 1.3
#: at most, so their reaches overlap where their centres are within the limits of visual_pairs.
REACH_X, REACH_Y = 0.37, 1.21


def visual_pairs(layers: DataFrame) -> DataFrame:
    """J14 on layers (image_id, seq, box struct, font_family, r, g, b, bg_r, bg_g, bg_b, chroma, texture, has_path): pairs (a < b)
    that look alike. Pairs meet by image and font where their reaches overlap, in cells that are cut where layers are dense."""
    b, seq = F.col("box"), layers.schema["seq"].dataType
    reach = F.struct((b["center_x"] - b["height"] * REACH_X).alias("min_x"), (b["center_y"] - b["height"] * REACH_Y).alias("min_y"), (b["center_x"] + b["height"] * REACH_X).alias("max_x"), (b["center_y"] + b["height"] * REACH_Y).alias("max_y"))
    look = F.struct("seq", "box", "r", "g", "b", "bg_r", "bg_g", "bg_b", "chroma", "texture")
    rows = layers.where("not has_path").select("image_id", "font_family", look.alias("look"), reach.alias("reach"))
    pairs = boxes.overlapping(rows, rows, ["image_id", "font_family"], ("look", "look"), ("reach", "reach"))
    A, C = F.col("left"), F.col("right")
    ah, ch = A["box"]["height"], C["box"]["height"]
    low, high = F.least(ah, ch), F.greatest(ah, ch)
    turn = lambda x: F.abs(x["box"]["rotation_degrees"])
    gap = F.abs(A["box"]["center_y"] - C["box"]["center_y"]) - (ah + ch) / 2
    dist = lambda names: F.sqrt(sum(((A[n] - C[n]) * (A[n] - C[n]) for n in names[1:]), (A[names[0]] - C[names[0]]) * (A[names[0]] - C[names[0]])))
    ground = dist(["bg_r", "bg_g", "bg_b"])
    alike = (
        (A["seq"] < C["seq"]) & (high <= low * 1.3) & (turn(A) <= 3) & (turn(C) <= 3) & (F.abs(A["box"]["rotation_degrees"] - C["box"]["rotation_degrees"]) <= 3) & (F.abs(A["box"]["center_x"] - C["box"]["center_x"]) <= high * 0.65)
        & (gap >= -0.35 * low) & (gap <= high * 1.25) & (dist(["r", "g", "b"]) <= 25) & (F.abs(A["texture"] - C["texture"]) <= 35) & ((ground <= 35) | ((A["chroma"] <= 25) & (C["chroma"] <= 25) & (ground <= 60)))
    )
    return pairs.where(alike).select("image_id", A["seq"].cast(seq).alias("a"), C["seq"].cast(seq).alias("b")).distinct()


#: Pairs of an image up to which one task joins them at once.
SMALL = 100_000


def visual_groups(layers: DataFrame, pairs: DataFrame, small: int = SMALL) -> DataFrame:
    """(image_id, seq, component): smallest seq reachable over the pairs. Images of at most `small` pairs are finished in
    one pass over their sorted pairs, one image after another; the others go through _rounds(), whose work is spread over
    all tasks. Layers without a pair are components of their own."""
    seq = layers.schema["seq"].dataType
    pairs = written(pairs.select("image_id", F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")))
    large = written(pairs.groupBy("image_id").agg(F.count("*").alias("n")).where(F.col("n") > small).select("image_id"))
    few = pairs.join(large, "image_id", "left_anti")
    labels = _joined(few)
    if not large.isEmpty():
        labels = labels.unionByName(_rounds(pairs.join(large, "image_id", "left_semi")))
    labels = labels.select("image_id", F.col("seq").cast(seq).alias("seq"), F.col("component").cast(seq).alias("component"))
    return layers.select("image_id", "seq").join(labels, ["image_id", "seq"], "left").select("image_id", "seq", F.coalesce("component", "seq").alias("component"))


def _joined(pairs: DataFrame) -> DataFrame:
    """(image_id, seq, component) of pairs (image_id, a, b): every image's pairs are joined as they come, with the lower root
    above; a task holds one image at a time."""
    schema = T.StructType([pairs.schema["image_id"], T.StructField("seq", T.LongType()), T.StructField("component", T.LongType())])
    arrow = to_arrow_schema(schema)

    def run(batches):
        image, above, out = None, {}, ([], [], [])

        def root(x: int) -> int:
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        def finish() -> None:
            for x in above:
                out[0].append(image)
                out[1].append(x)
                out[2].append(root(x))

        for batch in batches:
            for own, a, b in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own != image:
                    finish()
                    image, above = own, {}
                x, y = root(above.setdefault(a, a)), root(above.setdefault(b, b))
                above[max(x, y)] = min(x, y)
            if len(out[0]) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)
                out = ([], [], [])
        finish()
        yield pa.RecordBatch.from_arrays([pa.array(v, f.type) for v, f in zip(out, arrow)], schema=arrow)

    return pairs.repartition("image_id").sortWithinPartitions("image_id").mapInArrow(run, schema)


def _rounds(pairs: DataFrame) -> DataFrame:
    """The same by rounds over all tasks. Each takes the least label of the neighbours, hooks the seq that is a label to the
    least one found under it, takes that label's label, and is checkpointed; it ends when no label moves, however many rounds
    that takes."""
    spark = pairs.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isEmpty():
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    both = pairs.union(pairs.select("image_id", "b", "a")).distinct().checkpoint()
    labels = both.groupBy("image_id", F.col("a").alias("seq")).agg(F.least("seq", F.min("b")).alias("component")).checkpoint()
    moved = True
    while moved:
        near = both.join(labels.withColumnRenamed("seq", "b"), ["image_id", "b"]).groupBy("image_id", F.col("a").alias("seq")).agg(F.min("component").alias("near"))
        step = labels.join(near, ["image_id", "seq"]).select("image_id", "seq", F.col("component").alias("was"), F.least("component", "near").alias("now")).checkpoint()
        hooks = step.groupBy("image_id", F.col("was").alias("seq")).agg(F.min("now").alias("hook"))
        hooked = step.join(hooks, ["image_id", "seq"], "left").select("image_id", "seq", "was", F.least("now", "hook").alias("now"))
        above = hooked.select("image_id", F.col("seq").alias("now"), F.col("now").alias("above"))
        new = hooked.join(above, ["image_id", "now"], "left").select("image_id", "seq", F.least("now", "above").alias("component"), (F.least("now", "above") < F.col("was")).alias("moved")).checkpoint()
        labels, moved = new.drop("moved"), new.where("moved").limit(1).count()
    return labels


def group_consensus(layers: DataFrame, image_width: Column) -> DataFrame:
    """G16 on layers with component, box, font_size, font_stretch: groups of two or more share the least size and stretch;
    of three or more also a width (1.25 of the widest, within the image) and the median centre, kept inside."""
    keys = ["image_id", "component"]
    wide = F.least(image_width, F.max("box.width") * 1.25)
    each = layers.groupBy(*keys).agg(F.count("*").alias("_n"), F.min("font_size").alias("_size"), F.min("font_stretch").alias("_stretch"), wide.alias("_w"), F.median("box.center_x").alias("_x"))
    rows = layers.join(each, keys)
    x = F.least(F.greatest(F.col("_x"), F.col("_w") / 2), image_width - F.col("_w") / 2)
    pick = lambda n, new, old: F.when(F.col("_n") >= n, new).otherwise(old)
    box = g.box(pick(3, x, F.col("box.center_x")), F.col("box.center_y"), pick(3, F.col("_w"), F.col("box.width")), F.col("box.height"), F.col("box.rotation_degrees"))
    return rows.select("image_id", "seq", "component", box.alias("box"), pick(2, F.col("_size"), F.col("font_size")).alias("font_size"), pick(2, F.col("_stretch"), F.col("font_stretch")).alias("font_stretch"))
