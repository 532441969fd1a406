"""Pairs of boxes that overlap, by cells that are cut in two where they are dense.

A key of few boxes pairs all of them: that is bounded and needs no cells. Boxes of the other keys start in cells of one size. A cell that holds too many boxes is halved along the axis that fewer of them
cross, and so on, so that a crowded strip or page costs no quadratic task and empty space no cells. Cells do not overlap, and
a pair is taken only in the cell of its reference point, the corner of its common part that is nearest to the origin, so it
comes once.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark.session import written

#: Cells are 2^START pixels wide and high at first and 2^LEAST at least; boxes that a key may hold without cells, and that a
#: cell may hold before it is cut.
START, LEAST, DENSE = 10, 2, 256


def _cells(low: Column, high: Column, level: Column) -> Column:
    size = F.pow(F.lit(2.0), level)
    return F.sequence(F.floor(low / size), F.floor(high / size))


def _placed(rows: DataFrame) -> DataFrame:
    """rows (key, side, id, box) in the cells of first size that they touch."""
    box, level = F.col("box"), F.lit(START)
    out = rows.select("*", level.alias("lx"), level.alias("ly"), F.explode(_cells(box["min_x"], box["max_x"], level)).alias("ix"))
    return out.select("*", F.explode(_cells(box["min_y"], box["max_y"], level)).alias("iy"))


_CELL = ("key", "lx", "ly", "ix", "iy")


def _middle(level: str, place: str) -> Column:
    return (F.col(place) + 0.5) * F.pow(F.lit(2.0), F.col(level))


def _crowded(placed: DataFrame, dense: int) -> DataFrame:
    """(cell, cut) of the cells to be cut, and by which axis. A cut that more than half of the boxes would cross gains nothing, so
    such a cell stays. Counts are combined before the shuffle."""
    crosses = lambda axis: F.count_if((F.col(f"box.min_{axis}") < _middle(f"l{axis}", f"i{axis}")) & (F.col(f"box.max_{axis}") >= _middle(f"l{axis}", f"i{axis}")))
    cells = placed.groupBy(*_CELL).agg(F.count("*").alias("n"), crosses("x").alias("x"), crosses("y").alias("y")).where(F.col("n") > dense)
    can = {a: F.when((F.col(f"l{a}") > LEAST) & (2 * F.col(a) <= F.col("n")), F.col(a)) for a in "xy"}
    cut = F.when(can["x"] <= F.coalesce(can["y"], F.col("n")), "x").when(can["y"].isNotNull(), "y")
    return cells.select(*_CELL, cut.alias("cut")).where("cut is not null")


def _halved(placed: DataFrame) -> DataFrame:
    """placed with `cut`, in the halves that the boxes touch."""
    def halves(axis: str) -> Column:
        low = F.when(F.col(f"box.min_{axis}") < _middle(f"l{axis}", f"i{axis}"), 2 * F.col(f"i{axis}"))
        high = F.when(F.col(f"box.max_{axis}") >= _middle(f"l{axis}", f"i{axis}"), 2 * F.col(f"i{axis}") + 1)
        return F.array_compact(F.array(low, high))

    rows = placed.withColumn("i", F.explode(F.when(F.col("cut") == "x", halves("x")).otherwise(halves("y"))))
    x = F.col("cut") == "x"
    return rows.select("key", "side", "id", "box", F.when(x, F.col("lx") - 1).otherwise(F.col("lx")).alias("lx"), F.when(x, F.col("ly")).otherwise(F.col("ly") - 1).alias("ly"), F.when(x, F.col("i")).otherwise(F.col("ix")).alias("ix"), F.when(x, F.col("iy")).otherwise(F.col("i")).alias("iy"))


def _leaves(rows: DataFrame, dense: int) -> DataFrame:
    """rows in cells that are not crowded, or that no cut helps."""
    placed, done = _placed(rows), []
    while True:
        crowded = written(_crowded(placed, dense))
        if crowded.isEmpty():
            done.append(placed)
            break
        marked = placed.join(crowded, list(_CELL), "left")
        done.append(marked.where("cut is null").drop("cut"))
        placed = written(_halved(marked.where("cut is not null")))  # the crowded part only
    out = done[0]
    for part in done[1:]:
        out = out.unionByName(part)
    return out


def overlapping(left: DataFrame, right: DataFrame, keys: list[str], ids: tuple[str, str], boxes: tuple[str, str] = ("box", "box"), dense: int = DENSE, where: Column | None = None, plain: bool = False) -> DataFrame:
    """(keys, left id, right id, left box, right box as `left`, `right`, `left_box`, `right_box`) of all pairs within a key
    whose boxes share an area and for whose `left` and `right` `where` holds. Rows whose key, or a bound of whose box, is null
    are in no pair; equal rows pair each. plain: boxes are columns of written tables, which may be read more than once."""
    def side(df: DataFrame, n: int) -> DataFrame:
        b = F.col(boxes[n])
        whole = F.struct(*[b[c].cast("double").alias(c) for c in _BOUNDS])
        return df.select(F.struct(*[F.col(k) for k in keys]).alias("key"), F.lit(n).alias("side"), F.col(ids[n]).alias("id"), whole.alias("box"))

    same = left.select(F.col(ids[0]).alias("id")).schema[0].dataType == right.select(F.col(ids[1]).alias("id")).schema[0].dataType
    if not same:
        raise ValueError("both sides need ids of one type")
    # written, as boxes come from polygons and each step below reads them; filtered after that, or the filters work them out again
    rows = side(left, 0).unionByName(side(right, 1))
    rows = (rows if plain else written(rows)).where("box.max_x > box.min_x and box.max_y > box.min_y")
    for k in keys:
        rows = rows.where(F.col(f"key.{k}").isNotNull())
    many = written(rows.groupBy("key").count().where(F.col("count") > dense).select("key"))
    if many.isEmpty():
        return _pairs(rows, ["key"], where)
    own = _reference("x") & _reference("y")
    cells = _pairs(_leaves(rows.join(many, "key", "left_semi"), dense), list(_CELL), own if where is None else where & own)
    return _pairs(rows.join(many, "key", "left_anti"), ["key"], where).unionByName(cells)


def _reference(axis: str) -> Column:
    """Whether the corner of the common part lies in the pair's cell."""
    return F.floor(F.greatest(f"a_min_{axis}", f"b_min_{axis}") / F.pow(F.lit(2.0), F.col(f"l{axis}"))) == F.col(f"i{axis}")


_BOUNDS = ("min_x", "min_y", "max_x", "max_y")


def _pairs(rows: DataFrame, on: list[str], where: Column | None = None) -> DataFrame:
    """The bounds are compared as plain columns: the join evaluates little code for a pair, which the JVM compiles; areas of
    structs in the condition made a method too long for that."""
    side = lambda n, own, name: rows.where(F.col("side") == n).select(*on, F.col("id").alias(name), *[F.col(f"box.{c}").alias(f"{own}_{c}") for c in _BOUNDS])
    meet = [F.col(f"{p}_min_{c}") < F.col(f"{q}_max_{c}") for c in "yx" for p, q in ("ab", "ba")]
    pairs = side(0, "a", "left").join(side(1, "b", "right"), on).where(meet[0] & meet[1] & meet[2] & meet[3])
    box = lambda own: F.struct(*[F.col(f"{own}_{c}").alias(c) for c in _BOUNDS])
    return (pairs if where is None else pairs.where(where)).select("key.*", "left", "right", box("a").alias("left_box"), box("b").alias("right_box"))
