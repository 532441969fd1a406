"""Shared helpers: scratch tables in the cluster's shared folder, word hashing on Arrow buffers, connected components."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
_CLEAN_UP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
#: Bytes of text handled at once inside a task; a longer text is handled alone.
CHUNK_BYTES = 1 << 18


#: Rows of an Arrow batch where each row carries a whole text.
BATCH_ROWS = 2000
_BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def small_batches(spark: SparkSession) -> None:
    """Texts reach Python BATCH_ROWS at a time from now on, so that a worker's memory does not grow with 10 000 of them."""
    spark.conf.set(_BATCH, str(min(BATCH_ROWS, int(spark.conf.get(_BATCH)))))


def load(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir; a temporary one only where the session names none (tests, local mode)."""
    found = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        found = "file://" + tempfile.mkdtemp(prefix="regionspark-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def written(df: DataFrame, *more: DataFrame) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors. The write's
    own shuffle files go as soon as it has ended. Frames after df are shares of the same table, written one after another,
    so the disk holds the shuffle files of one at a time."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/t-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEAN_UP, "false")
    spark.conf.set(_CLEAN_UP, "true")
    try:
        for share in (df, *more):
            share.write.mode("append").option("parquet.enable.dictionary", "false").parquet(path)  # mostly hashes
    finally:
        spark.conf.set(_CLEAN_UP, before)
    out = spark.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def dropped(df: DataFrame) -> None:
    """Delete what written() made, once nothing reads it any more."""
    jvm = df.sparkSession._jvm
    path = jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def let(value: Column, body) -> Column:
    """body(value) with value evaluated once a row, however often body names it."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """Array of the words of a text; null gives an empty array."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SPACE), "")


def n_words(text: Column) -> Column:
    return F.size(words(text)).cast("long")


# --- word hashes on Arrow buffers -------------------------------------------------------------------------------------

_M = (1 << 64) - 1
_ODD = 0x9E3779B97F4A7C15
_POW = np.empty(0, np.uint64)
_INV = np.empty(0, np.uint64)
_TABLE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64)
_LOWER = _TABLE.copy()
_LOWER[65:91] = _TABLE[97:123]
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (multiply and shift rounds)."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    global _POW, _INV
    if len(_POW) < n:
        n = max(n, CHUNK_BYTES + 1)
        inverse = pow(_ODD, -1, 1 << 64)
        p, q = np.full(n, _ODD, np.uint64), np.full(n, inverse, np.uint64)
        p[0] = q[0] = 1
        _POW, _INV = np.multiply.accumulate(p), np.multiply.accumulate(q)
    return _POW, _INV


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string array, and its offsets in them; a null is empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    texts = texts.cast(pa.large_string()).fill_null("")
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if not len(texts) or texts.buffers()[2] is None:
        return np.empty(0, np.uint8), np.zeros(len(texts) + 1, np.int64)
    return np.frombuffer(texts.buffers()[2], np.uint8)[offsets[0] : offsets[-1]], offsets - offsets[0]


def word_bounds(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of all words; words end where their text ends."""
    inside = ~_IS_SPACE[data]
    starts, ends = inside.copy(), np.zeros(len(data), bool)
    starts[1:] &= ~inside[:-1]
    edges = offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(data))]
    starts[edges] = inside[edges]
    ends[:-1] = inside[:-1] & (~inside[1:] | starts[1:])
    ends[-1:] = inside[-1:]
    return np.flatnonzero(starts), np.flatnonzero(ends) + 1


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, lower: bool = False) -> np.ndarray:
    """64-bit hashes of data[start:end]: differences of one running polynomial sum, so no loop over words."""
    power, inverse = _powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_LOWER if lower else _TABLE)[data] * power[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * inverse[starts] + (ends - starts).astype(np.uint64))


def chunks(offsets: np.ndarray, size: int = CHUNK_BYTES):
    """Row ranges of about size bytes."""
    i, n = 0, len(offsets) - 1
    while i < n:
        j = max(i + 1, int(np.searchsorted(offsets, offsets[i] + size, "right")) - 1)
        yield i, min(j, n)
        i = min(j, n)


def hashed_texts(texts: pa.Array, lower: bool = False):
    """For each chunk of rows: first row, number of rows, word hashes, row of each word (from 0), bytes, word starts, row offsets."""
    data, offsets = text_bytes(texts)
    for i, j in chunks(offsets):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = word_bounds(part, off)
        row = np.searchsorted(off, starts, "right") - 1
        yield i, j - i, word_hashes(part, starts, ends, lower), row, part, starts, off


def binaries(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    """A binary array: row k holds values[offsets[k]:offsets[k + 1]]."""
    width = values.dtype.itemsize
    return pa.Array.from_buffers(pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64) * width), pa.py_buffer(np.ascontiguousarray(values))]).cast(pa.binary())


def lists(values: np.ndarray, offsets: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.ascontiguousarray(offsets, np.int32)), pa.array(values.view(np.int64)))


# --- connected components ---------------------------------------------------------------------------------------------


def components(edges: DataFrame) -> DataFrame:
    """(id, component) of every id in edges (a, b): component is the smallest id reachable.

    Each round points every id at the smallest label seen among its neighbours, the id that is a label also at the
    smallest one that any id under it has found (hooking), and then every id at its label's own label (pointer jumping),
    so chains shrink quickly in any order of ids. It ends when no label moves, however many rounds that takes. Each
    round is written to the shared folder. Aggregates are combined before the shuffle; the joins read written tables, so
    Spark splits the partition of an id with very many edges (skew join).
    """
    both = written(edges.select("a", "b").union(edges.select(F.col("b"), F.col("a"))).where("a <> b").distinct())
    labels = written(both.groupBy(F.col("a").alias("id")).agg(F.least(F.col("id"), F.min("b")).alias("component")))
    moved = True
    while moved:
        near = both.join(labels, both.b == labels.id).groupBy("a").agg(F.min("component").alias("near"))
        step = written(labels.join(near, labels.id == near.a).select("id", F.col("component").alias("was"), F.least("component", "near").alias("now")))
        hooks = step.groupBy(F.col("was").alias("root")).agg(F.min("now").alias("hook"))
        hooked = step.join(hooks, step.id == hooks.root, "left").select("id", "was", F.least("now", "hook").alias("now"))
        up = hooked.select(F.col("id").alias("now"), F.col("now").alias("above"))
        new = written(hooked.join(up, "now", "left").select("id", F.least("now", "above").alias("component"), (F.least("now", "above") < F.col("was")).alias("moved")))
        moved = new.where("moved").limit(1).count()
        dropped(labels)
        dropped(step)
        scratch, labels = new._scratch, new.select("id", "component")
        labels._scratch = scratch
    dropped(both)
    return labels
