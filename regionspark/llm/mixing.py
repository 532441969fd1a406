"""Operator 7, mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from regionspark.llm.common import load, n_words, written

#: Weights of the sources in code point order, repeating (fixed values of the contract).
WEIGHTS = (5, 2, 1)
SHARE = 1.5
EPOCHS = 2
#: Words of a packet of the document that is in service when the budget ends, so a source comes this near its target.
PACKET = 1
_BLANK = r"\x20\x09-\x0D"


def targets(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target, budget) for items (source, size). Sources share `share` times all sizes by weight; a target
    stops at `epochs` times its source's size and the excess is shared by weight again. Sorted by the fill level at
    which each source stops, the final level is the first one that leaves its source below its stop, which is
    the highest such level, as each later one takes off more than its share. The windows run
    over one row per source, never over documents."""
    sizes = items.groupBy("source").agg(F.sum("size").alias("source_size"))
    everything = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    rank = (F.row_number().over(W.orderBy(F.asc_nulls_last("source"))) - 1) % len(weights)
    rows = sizes.withColumn("weight", F.get(F.array(*[F.lit(w) for w in weights]), rank).cast("long"))
    rows = rows.withColumn("stop", epochs * F.col("source_size")).withColumn("level", F.col("stop") / F.col("weight"))
    order = W.orderBy("level", F.asc_nulls_last("source"))
    rows = rows.withColumn("total", F.sum("source_size").over(everything))
    rows = rows.withColumn("below", F.sum("stop").over(order) - F.col("stop")).withColumn("open", F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    rows = rows.withColumn("fill", (share * F.col("total") - F.col("below")) / F.col("open"))
    rows = rows.withColumn("final", F.max(F.when(F.col("fill") <= F.col("level"), F.col("fill"))).over(everything))
    return rows.select("source", "source_size", F.least(F.col("stop").cast("double"), F.col("final") * F.col("weight")).alias("target"), F.floor(share * F.col("total")).alias("budget"))


def _items(docs: DataFrame) -> DataFrame:
    """(doc_id, source, mark, size, copies): rows that agree in doc_id, source and text are one entry of the queue."""
    rows = docs.select("doc_id", "source", F.xxhash64("text").alias("mark"), n_words(F.col("text")).alias("words"))
    return rows.groupBy("doc_id", "source", "mark", "words").agg(F.count("*").alias("copies")).select("doc_id", "source", "mark", "words", "copies", (F.col("words") * F.col("copies")).alias("size"))


def schedule(items: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """The mix: (doc_id, source, mark, epoch, at, words, finish, position) for items (doc_id, source, mark, size).

    Within its source each document is queued in a shuffled order (MD5 of its id, so reruns agree), once per epoch. Its
    virtual finish time is the source's words up to its end over the source's target, so that at time 1 all sources have
    used up the budget; a document that would begin then or later is not queued. The one that a source has in service at
    time 1 is queued in packets of PACKET words with finish times of their own, as the cut falls among these. All entries
    are range-sorted by finish time and truncated where the running total reaches the budget, inside an entry if need be.
    Running sums are made in two levels (sums of 4096 slices of the order, then inside a slice), so a source with a third
    of all rows is spread over 4096 groups.
    """
    want = targets(items, weights, share, epochs)
    queued = items.where("size > 0").withColumn("turn", F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))).withColumn("slice", F.substring("turn", 1, 3))
    sums = queued.groupBy("source", "slice").agg(F.sum("size").alias("part"))
    ahead = W.partitionBy("source").orderBy("slice").rowsBetween(W.unboundedPreceding, -1)
    sums = sums.withColumn("ahead", F.coalesce(F.sum("part").over(ahead), F.lit(0))).drop("part")
    sums = sums.join(want.withColumnRenamed("source", "_s"), F.col("source").eqNullSafe(F.col("_s"))).select(F.col("source").alias("_s"), F.col("slice").alias("_c"), "ahead", "source_size", "target", "budget")
    order = ["turn", F.asc_nulls_last("doc_id"), "size", "mark"]
    inside = W.partitionBy("source", "slice").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    rows = queued.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("slice") == F.col("_c")))
    rows = rows.withColumn("begin", F.col("ahead") + F.coalesce(F.sum("size").over(inside), F.lit(0)))
    rows = rows.withColumn("epoch", F.explode(F.sequence(F.lit(1), F.lit(epochs)))).withColumn("begin", F.col("begin") + (F.col("epoch") - 1) * F.col("source_size")).where("begin < target")
    some = F.least(F.col("size").cast("double"), F.col("target") - F.col("begin"))  # words before time 1
    packets = F.when(F.col("begin") + F.col("size") > F.col("target"), F.ceil(some / PACKET)).otherwise(1)
    rows = rows.withColumn("packets", packets.cast("int")).withColumn("k", F.explode(F.sequence(F.lit(0), F.col("packets") - 1)))
    rows = rows.withColumn("at", F.when(F.col("begin") + F.col("size") > F.col("target"), F.col("k").cast("long") * PACKET).otherwise(F.lit(0).cast("long")))
    rows = rows.withColumn("words", F.when(F.col("begin") + F.col("size") > F.col("target"), F.least(F.lit(PACKET).cast("long"), F.col("size") - F.col("at"))).otherwise(F.col("size")))
    rows = rows.withColumn("finish", (F.col("begin") + F.col("at") + F.col("words")) / F.col("target"))
    rows = written(rows.select("doc_id", "source", "mark", "size", "turn", "epoch", "at", "words", "finish", "budget", F.floor(F.least(F.col("finish"), F.lit(2.0)) * 4096).cast("int").alias("band")))
    bands = rows.groupBy("band").agg(F.sum("words").alias("part"))
    bands = bands.withColumn("before", F.coalesce(F.sum("part").over(W.orderBy("band").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))).drop("part")
    ordered = W.partitionBy("band").orderBy("finish", F.asc_nulls_last("source"), *order, "epoch", "at").rowsBetween(W.unboundedPreceding, -1)
    rows = rows.join(bands, "band").withColumn("position", F.col("before") + F.coalesce(F.sum("words").over(ordered), F.lit(0)))
    rows = rows.withColumn("words", F.least(F.col("words"), F.col("budget") - F.col("position"))).where("words > 0")
    return rows.select("doc_id", "source", "mark", "epoch", "at", "words", "finish", "position")


def _taken(items: DataFrame, **options) -> DataFrame:
    """items with `taken`: words of each of an entry's copies, an equal share rounded down."""
    sums = schedule(items, **options).groupBy(F.col("doc_id").alias("_d"), F.col("source").alias("_s"), F.col("mark").alias("_m")).agg(F.sum("words").alias("_taken"))
    rows = items.join(sums, F.col("doc_id").eqNullSafe(F.col("_d")) & F.col("source").eqNullSafe(F.col("_s")) & (F.col("mark") == F.col("_m")), "left")
    return rows.select("doc_id", "source", "mark", "words", "copies", F.floor(F.coalesce("_taken", F.lit(0)) / F.col("copies")).cast("long").alias("taken"))


def mix(docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, epochs: int = EPOCHS) -> DataFrame:
    """One row per document: doc_id, source, size, source_size, target, taken (words, repeats counted).

    Null texts have size 0 and take nothing; a null source is a source of its own, last in order; a null doc_id is an id
    like any other. Rows that repeat doc_id, source and text are queued as one document of their joint size and take equal
    shares, rounded down, so none exceeds `epochs` times its size. Other columns are ignored. An empty table gives no rows.
    """
    items = written(_items(docs))
    rows = _taken(items, weights=weights, share=share, epochs=epochs)
    want = targets(items, weights, share, epochs).withColumnRenamed("source", "_s")
    rows = rows.join(want, F.col("source").eqNullSafe(F.col("_s")), "left").withColumn("copy", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.select("doc_id", "source", F.col("words").alias("size"), "source_size", "target", "taken")


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with the columns of docs: one row per epoch, and what is left of the words taken
    as a text cut after its last taken word, white space before it kept. n_chars, if there, is counted again for cut
    texts. Nulls and repeated rows as in mix()."""
    takes = _taken(written(_items(docs)), **options).where("taken > 0").select(F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("mark").alias("m"), "words", "taken")
    packed = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id"), F.col("source").alias("own"), F.xxhash64("text").alias("mark"))
    joined = packed.join(takes, F.col("id").eqNullSafe(F.col("d")) & F.col("own").eqNullSafe(F.col("s")) & (F.col("mark") == F.col("m")))
    whole, rest = F.floor(F.col("taken") / F.col("words")).cast("int"), (F.col("taken") % F.col("words")).cast("int")
    times = joined.select("row", F.explode(F.concat(F.array_repeat(F.lit(0), whole), F.when(rest > 0, F.array(rest)).otherwise(F.array().cast("array<int>")))).alias("cut"))
    # split at the ends of words: each part is a word with the white space before it
    head = F.array_join(F.slice(F.split(F.col("row.text"), rf"(?<=[^{_BLANK}])(?=[{_BLANK}])"), 1, F.col("cut")), "")
    text = F.when(F.col("cut") > 0, head).otherwise(F.col("row.text"))
    new = {"text": text, **({"n_chars": F.when(F.col("cut") > 0, F.length(text).cast("long")).otherwise(F.col("row.n_chars"))} if "n_chars" in docs.columns else {})}
    return times.select(*[new.get(c, F.col(f"row.`{c}`")).alias(c) for c in docs.columns])


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(load(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
WITH i AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size, md5(doc_id::VARCHAR) AS turn FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM i GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::BIGINT] AS weight FROM s),
l AS (SELECT *, 2 * source_size AS stop, 2 * source_size / weight::DOUBLE AS level FROM w),
f AS (SELECT *, (1.5 * (sum(source_size) OVER ())::DOUBLE - (sum(stop) OVER (ORDER BY level, source NULLS LAST) - stop)::DOUBLE)
                / (sum(weight) OVER (ORDER BY level, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))::DOUBLE AS fill FROM l),
t AS (SELECT source, source_size, least(stop::DOUBLE, (max(CASE WHEN fill <= level THEN fill END) OVER ()) * weight) AS target FROM f),
q AS (SELECT i.*, t.source_size, t.target, sum(size) OVER (PARTITION BY i.source ORDER BY turn, doc_id) - size AS begin0
      FROM i JOIN t ON i.source IS NOT DISTINCT FROM t.source),
e AS (SELECT q.*, epoch, (begin0 + (epoch - 1) * source_size)::BIGINT AS begin_ FROM q, (VALUES (1), (2)) v(epoch) WHERE size > 0),
k AS (SELECT *, CASE WHEN begin_ + size > target THEN ceil(least(size::DOUBLE, target - begin_))::BIGINT ELSE 1 END AS packets FROM e WHERE begin_ < target),
p AS (SELECT *, unnest(range(packets)) AS n FROM k),
z AS (SELECT *, CASE WHEN begin_ + size > target THEN n ELSE 0 END AS at_, CASE WHEN begin_ + size > target THEN 1 ELSE size END AS part FROM p),
o AS (SELECT *, sum(part) OVER (ORDER BY (begin_ + at_ + part) / target, source NULLS LAST, turn, doc_id, epoch, at_) - part AS position FROM z),
x AS (SELECT doc_id, sum(least(part, greatest(0, (SELECT floor(1.5 * sum(size)) FROM i) - position)))::BIGINT AS taken FROM o GROUP BY doc_id)
SELECT q.doc_id, size, source_size, target, coalesce(x.taken, 0)::BIGINT AS taken FROM q LEFT JOIN x ON x.doc_id = q.doc_id
"""
