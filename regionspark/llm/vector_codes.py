"""Operator 12, vector code compression: product quantisation with LAESA pivots.

The distances of every part to a few fixed pivots are computed once and stored. In each round only the codebook's entries are
measured against the pivots; by the triangle inequality the differences are lower bounds for all distances of parts to entries,
in whose order the exact integer distances are evaluated until no bound is below the best one.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionspark.llm.common import dropped, load, small_batches, written

PARTS, ENTRIES, ROUNDS, SCALE = 4, 256, 4, 1024
#: Pivots of each part position, taken from the first codebook; bytes of a block of bounds.
PIVOTS, BLOCK = 8, 1 << 22
#: Relative slack of a stored pivot distance (float32), so that no bound exceeds the distance it bounds.
SLACK = 1e-6


@dataclass(frozen=True)
class Codebooks:
    """entries[part]: integer components, a row per entry; pivots[part]: the fixed pivots."""

    entries: tuple[np.ndarray, ...]
    pivots: tuple[np.ndarray, ...]

    def digest(self) -> str:
        return hashlib.sha256(",".join(str(x) for part in self.entries for x in part.ravel().tolist()).encode()).hexdigest()

    def replaced(self, entries: tuple[np.ndarray, ...]) -> Codebooks:
        return Codebooks(entries, self.pivots)


def _squares(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    d = a - b
    return (d * d).sum(axis=-1)


def far_apart(points: np.ndarray, n: int) -> np.ndarray:
    """n of the points, each the farthest from those chosen before (the first of equals)."""
    chosen = points[:1]
    near = _squares(points, points[:1])
    while len(chosen) < min(n, len(points)):
        at = int(near.argmax())
        chosen = np.concatenate([chosen, points[at : at + 1]])
        near = np.minimum(near, _squares(points, points[at]))
    return chosen


def pivot_distances(parts: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    """Distances of rows to pivots as float32: rows x pivots."""
    return np.sqrt(np.stack([_squares(parts, p) for p in pivots], axis=1).astype(np.float64)).astype(np.float32)


def nearest(parts: np.ndarray, to_pivots: np.ndarray, entries: np.ndarray, pivots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The index of the nearest entry of each row (the lower of equals) and its squared distance."""
    index, best = np.zeros(len(parts), np.int64), np.full(len(parts), np.iinfo(np.int64).max)
    of_entries = pivot_distances(entries, pivots)
    high, low = of_entries * np.float32(1 + SLACK), of_entries * np.float32(1 - SLACK)
    step = max(1, BLOCK // (4 * len(entries)))
    for k in range(0, len(parts), step):
        x, d = parts[k : k + step], to_pivots[k : k + step]
        below, above = d * np.float32(1 - SLACK), d * np.float32(1 + SLACK)
        bound = np.zeros((len(x), len(entries)), np.float32)
        for p in range(d.shape[1]):
            np.maximum(bound, below[:, p, None] - high[None, :, p], out=bound)
            np.maximum(bound, low[None, :, p] - above[:, p, None], out=bound)
        order = bound.argsort(axis=1)
        live, at, own, near = np.arange(len(x)), 0, np.zeros(len(x), np.int64), np.full(len(x), np.iinfo(np.int64).max)
        limit = np.full(len(x), np.inf)
        while len(live) and at < len(entries):
            entry = order[live, at]
            open_ = bound[live, entry] <= limit[live]  # the next lowest bound; all later ones are no lower
            live, entry = live[open_], entry[open_]
            exact = _squares(x[live], entries[entry])
            better = (exact < near[live]) | (exact == near[live]) & (entry < own[live])
            won = live[better]
            near[won], own[won] = exact[better], entry[better]
            limit[won] = np.sqrt(near[won].astype(np.float64)) * (1 + SLACK)
            at += 1
        index[k : k + step], best[k : k + step] = own, near
    return index, best


def kept(vectors: DataFrame, vector: str = "embedding") -> DataFrame:
    """The rows whose vector is there and has finite components only."""
    return vectors.where(F.col(vector).isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))))


def _whole(vectors: pa.Array, size: int) -> np.ndarray:
    """floor(1024 x) of all components: rows x size."""
    flat = vectors.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    whole = np.floor(flat * SCALE)
    if len(whole) and np.abs(whole).max() >= _most(size):
        raise ValueError("a component is too large for exact distances in 64 bits")
    return whole.astype(np.int64).reshape(-1, size)


def _most(size: int) -> float:
    """Components below it keep squared distances of vectors of this size, and sums of 2^20 of their parts, in 64 bits."""
    return min(2.0**42, (2.0**62 / max(size, 1)) ** 0.5 / 2)


def fit_start(rows: DataFrame, order: str = "vec_id", vector: str = "embedding") -> tuple[int, Codebooks] | None:
    """(size of a vector, first codebooks) from the ENTRIES kept rows of smallest id; null ids come last, equal ids in the
    order of their vectors. None if no row is kept. Vectors of another size than the first one's are passed over."""
    first = rows.orderBy(F.asc_nulls_last(order), vector).limit(1).collect()
    if not first:
        return None
    size = len(first[0][vector])
    some = rows.where(F.size(vector) == size).orderBy(F.asc_nulls_last(order), vector).limit(ENTRIES).select(vector).toArrow()
    whole = _whole(some.column(0).combine_chunks(), size) if size else np.zeros((some.num_rows, 0), np.int64)
    entries = tuple(np.ascontiguousarray(x) for x in np.array_split(whole, PARTS, axis=1))
    return size, Codebooks(entries, tuple(far_apart(e, PIVOTS) for e in entries))


def _read(batch: pa.RecordBatch, size: int) -> tuple[list[np.ndarray], list[np.ndarray]]:
    """The parts of a batch's vectors and their stored pivot distances."""
    n = batch.num_rows
    whole = _whole(batch.column("_v"), size) if size else np.zeros((n, 0), np.int64)
    stored = batch.column("_d").flatten().to_numpy(zero_copy_only=False)
    return np.array_split(whole, PARTS, axis=1), np.split(stored.reshape(n, -1), PARTS, axis=1) if n else [stored.reshape(0, 0)] * PARTS


def with_pivot_distances(rows: DataFrame, books: Codebooks, size: int, vector: str) -> DataFrame:
    """rows with `_d` array<float>: the distances of each part to its position's pivots, part by part."""

    @F.arrow_udf("array<float>")
    def measured(vectors: pa.Array) -> pa.Array:
        whole = _whole(vectors, size) if size else np.zeros((len(vectors), 0), np.int64)
        flat = np.concatenate([pivot_distances(x, p) for x, p in zip(np.array_split(whole, PARTS, axis=1), books.pivots)], axis=1)
        ends = np.arange(len(flat) + 1, dtype=np.int32) * flat.shape[1]
        return pa.ListArray.from_arrays(pa.array(ends), pa.array(flat.ravel()))

    return rows.withColumn("_d", measured(vector))


def sums(rows: DataFrame, books: Codebooks, size: int) -> list:
    """One assignment round: how many parts chose each entry (place -1) and the sums of their components, as rows (slot, place, total). Each
    task adds its rows up first and passes on one row per entry and component, so nothing grows with the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = [np.zeros(len(e), np.int64) for e in books.entries]
        total = [np.zeros(e.shape, np.int64) for e in books.entries]

        def flushed() -> pa.RecordBatch:
            slot = np.concatenate([np.repeat(p * ENTRIES + np.arange(len(t)), 1 + t.shape[1]) for p, t in enumerate(total)])
            place = np.concatenate([np.tile(np.arange(-1, t.shape[1]), len(t)) for t in total])
            value = np.concatenate([np.concatenate([c[:, None], t], axis=1).ravel() for c, t in zip(n, total)])
            for x in (*n, *total):
                x[:] = 0
            return pa.RecordBatch.from_arrays([pa.array(slot), pa.array(place), pa.array(value)], names=["slot", "place", "total"])

        seen = 0
        for batch in batches:
            if seen + batch.num_rows > 1 << 20:
                yield flushed()
                seen = 0
            seen += batch.num_rows
            for p, (x, d) in enumerate(zip(*_read(batch, size))):
                index, _ = nearest(x, d, books.entries[p], books.pivots[p])
                n[p] += np.bincount(index, minlength=len(n[p]))
                for c in range(x.shape[1]):
                    np.add.at(total[p][:, c], index, x[:, c])
        yield flushed()

    out = rows.select("_v", "_d").mapInArrow(run, "slot long, place long, total long")
    return out.groupBy("slot", "place").agg(F.sum(F.col("total").cast("decimal(38,0)")).alias("total")).collect()  # 256 rows a component


def moved(books: Codebooks, rows: list) -> Codebooks:
    """Each entry becomes the floor of its parts' mean; an entry that none chose stays."""
    got = {(r.slot, r.place): int(r.total) for r in rows}
    entries = []
    for p, e in enumerate(books.entries):
        new = e.copy()
        for i in range(len(e)):
            if n := got.get((p * ENTRIES + i, -1), 0):
                new[i] = [got[p * ENTRIES + i, c] // n for c in range(e.shape[1])]
        entries.append(new)
    return books.replaced(tuple(entries))


def codes(rows: DataFrame, books: Codebooks, size: int) -> DataFrame:
    """rows (_v, _d, ...) with `code` and `error` in their place."""
    rest = [f for f in rows.schema.fields if f.name not in ("_v", "_d")]
    names = [f.name for f in rest]
    hexed = np.array([f"{i:02x}" for i in range(ENTRIES)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            code, error = np.full(batch.num_rows, "", "U8"), np.zeros(batch.num_rows, np.int64)
            for p, (x, d) in enumerate(zip(*_read(batch, size))):
                index, best = nearest(x, d, books.entries[p], books.pivots[p])
                code, error = np.char.add(code, hexed[index]), error + best
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names], pa.array(code.tolist(), pa.string()), pa.array(error)], names=[*names, "code", "error"])

    return rows.mapInArrow(run, T.StructType([*rest, T.StructField("code", T.StringType()), T.StructField("error", T.LongType())]))


def compress(vectors: DataFrame, vector: str = "embedding", order: str = "vec_id", rounds: int = ROUNDS) -> DataFrame:
    """(row, code, error, codebooks_sha256): row holds the input's columns, so their names cannot clash.

    Rows whose vector is null or holds null or non-finite components go. The codebooks start from the 256 smallest ids (see
    fit_start), of fewer rows if there are no more; a repeated row counts as often as it stands there. Equal distances go to
    the lower entry. A vector of another size than the first one's has a null code and error; a size that 4 does not divide
    gives the first parts one component more. A component whose distances would leave 64 bits raises an error. An empty table gives
    no rows. Every round is one pass over the written vectors that brings back 256 rows a component.
    """
    small_batches(vectors.sparkSession)
    plain = kept(vectors, vector).select(F.struct(*[F.col(f"`{c}`") for c in vectors.columns]).alias("row"), F.col(f"`{order}`").alias("_o"), F.col(f"`{vector}`").alias("_v"))
    start = fit_start(plain, "_o", "_v")
    if start is None:
        return plain.select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"), F.lit(None).cast("string").alias("codebooks_sha256")).limit(0)
    size, books = start
    fits = F.size("_v") == size
    rows = written(with_pivot_distances(plain.where(fits).select("row", "_v"), books, size, "_v"))
    for _ in range(rounds):
        books = moved(books, sums(rows, books, size))
    coded = codes(rows, books, size).select("row", "code", "error")
    other = plain.where(~fits).select("row", F.lit(None).cast("string").alias("code"), F.lit(None).cast("long").alias("error"))
    out = written(coded.unionByName(other))
    dropped(rows)
    digest: Column = F.lit(books.digest())
    done = out.withColumn("codebooks_sha256", digest)
    done._scratch = out._scratch
    return done


def label_errors(coded: DataFrame, label: str = "label") -> DataFrame:
    """coded (row, error ...) with label_error: the sum of the errors of all rows of equal label, nulls together. Sums are
    combined before the shuffle; the join reads a written table, so Spark splits the partition of a label with very many rows."""
    per = coded.groupBy(F.col(f"row.`{label}`").alias("_l")).agg(F.sum("error").alias("label_error"))
    return coded.join(per, F.col(f"row.`{label}`").eqNullSafe(F.col("_l")), "left").drop("_l")


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = label_errors(compress(load(spark, sf_dir, "embeddings")))
    return rows.select(F.col("row.vec_id").alias("vec_id"), "code", "error", "label_error", "codebooks_sha256")


_NEAREST = """
d{r} AS MATERIALIZED (SELECT p.k, p.part, e.i, list_sum(list_transform(list_zip(p.v, e.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p JOIN e{r} e ON e.part = p.part),
a{r} AS MATERIALIZED (SELECT k, part, min(d)::BIGINT AS d, arg_min(i, (d, i)) AS i FROM d{r} GROUP BY k, part)"""
_MEANS = """
m{r} AS (SELECT part, i, list(m ORDER BY c) AS v FROM (
    SELECT a.part, a.i, c, (sum(x) - ((sum(x) % count(*)) + count(*)) % count(*)) // count(*) AS m
    FROM (SELECT a{q}.part, a{q}.i, unnest(p.v) AS x, generate_subscripts(p.v, 1) AS c FROM a{q} JOIN p USING (k, part)) a GROUP BY a.part, a.i, c) GROUP BY part, i),
e{r} AS MATERIALIZED (SELECT e.part, e.i, coalesce(m.v, e.v) AS v FROM e{q} e LEFT JOIN m{r} m ON m.part = e.part AND m.i = e.i)"""
ORACLE = (
    """
WITH v AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS k, vec_id, label, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::HUGEINT) AS w FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
p AS MATERIALIZED (SELECT k, part, w[part * len(w) // 4 + 1 : (part + 1) * len(w) // 4] AS v FROM v, range(4) t(part)),
e0 AS MATERIALIZED (SELECT part, k - 1 AS i, v FROM p WHERE k <= 256),"""
    + _NEAREST.format(r=0)
    + ","
    + ",".join(_MEANS.format(r=r, q=r - 1) + "," + _NEAREST.format(r=r) for r in range(1, ROUNDS + 1))
    + f""",
s AS (SELECT sha256(string_agg(x, ',' ORDER BY part, i, c)) AS h FROM (SELECT part, i, unnest(v)::VARCHAR AS x, generate_subscripts(v, 1) AS c FROM e{ROUNDS})),
c AS (SELECT k, string_agg(format('{{:02x}}', i), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM a{ROUNDS} GROUP BY k)
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, h AS codebooks_sha256 FROM v JOIN c USING (k), s
"""
)
