"""Operator 4, document fingerprints: SimHash over five-word shingles, and search by permuted block tables."""

from __future__ import annotations

import hashlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm.common import chunks, load, mix, text_bytes, word_bounds, word_hashes, written

BITS = 128
K = 5
#: Bits in which near fingerprints may differ.
RADIUS = 3
#: Bytes of text whose votes are counted at once in a task.
VOTE_BYTES = 1 << 17
_C1, _C2 = np.uint64(0xA0761D6478BD642F), np.uint64(0xE7037ED1A0B428DB)


def fingerprints(texts: pa.Array, bits: int = BITS, k: int = K) -> np.ndarray:
    """(rows, bits / 8) bytes: the signs of the votes of each text's distinct k-word shingles (all words as one shingle
    where there are fewer), each weighted 1 + log2 of how often it occurs; a draw, as in an empty text, gives 0 bits."""
    data, offsets = text_bytes(texts)
    out = np.zeros((len(offsets) - 1, bits // 8), np.uint8)
    for i, j in chunks(offsets, VOTE_BYTES):
        part, off = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        starts, ends = word_bounds(part, off)
        row = np.searchsorted(off, starts, "right") - 1
        h = word_hashes(part, starts, ends, True)
        size = np.bincount(row, minlength=j - i)
        first = np.concatenate([[0], np.cumsum(size)])[:-1]
        g = h.copy()
        for step in range(1, k):  # a shingle reaches to the k-th word or the end of its text
            left = np.flatnonzero((row[:-step] == row[step:]) if len(h) > step else np.zeros(0, bool))
            g[left] = mix(g[left] * _C1 + h[left + step] * _C2 + np.uint64(step))
        keep = np.arange(len(h)) - first[row] < np.maximum(size[row] - k + 1, 1)
        g, r = g[keep], row[keep]
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        at = np.flatnonzero(new)
        if not len(at):
            continue
        weight = 1 + np.log2(np.diff(np.append(at, len(g)))).astype(np.float32)
        g, r = g[at], r[at]
        begin = np.flatnonzero(np.concatenate([[True], r[1:] != r[:-1]]))
        total = np.add.reduceat(weight, begin)
        for word in range(bits // 64):
            ones = np.unpackbits(mix(g + np.uint64(word) * _C2).view(np.uint8).reshape(-1, 8), axis=1).astype(np.float32)
            votes = 2 * np.add.reduceat(ones * weight[:, None], begin, axis=0) - total[:, None]
            out[i + r[begin], word * 8 : word * 8 + 8] = np.packbits(votes > 1e-4, axis=1)
    return out


def _hex(rows: np.ndarray) -> pa.Array:
    width = rows.shape[1]
    text = np.frombuffer(rows.tobytes().hex().encode(), np.uint8)
    return pa.Array.from_buffers(pa.large_string(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int64) * 2 * width), pa.py_buffer(text)]).cast(pa.string())


def simhash(docs: DataFrame, text: str = "text", out: str = "fingerprint", bits: int = BITS, k: int = K) -> DataFrame:
    """docs with `out`: the text's fingerprint in hexadecimal. A null, empty or blank text has all bits 0; equal texts
    have equal fingerprints; a column already named `out` is replaced. No shuffle."""
    @F.pandas_udf("string")
    def own(texts: pd.Series) -> pd.Series:
        return pd.Series(_hex(fingerprints(pa.array([x if isinstance(x, str) else None for x in texts], pa.large_string()), bits, k)).to_pylist(), dtype=object)

    return docs.withColumn(out, own(F.col(text)))


def distance(a: Column | str, b: Column | str, bits: int = BITS) -> Column:
    """Hamming distance of two fingerprints in hexadecimal."""
    a, b = (F.col(x) if isinstance(x, str) else x for x in (a, b))
    part = lambda x, i: F.conv(F.substring(x, 8 * i + 1, 8), 16, 10).cast("long")
    total = F.lit(0)
    for i in range(bits // 32):
        total = total + F.bit_count(part(a, i).bitwiseXOR(part(b, i)))
    return total


def likeness(a: Column | str, b: Column | str, bits: int = BITS) -> Column:
    """The cosine that the distance stands for, 0 where it would be negative: 1 for equal fingerprints, about 0 for unrelated ones."""
    return F.greatest(F.lit(0.0), F.cos(F.lit(np.pi) * distance(a, b, bits) / bits))


def near_prints(prints: DataFrame, wanted: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """(fingerprint, wanted, distance): the fingerprints of prints within `radius` bits of each one of wanted (columns
    fingerprint; nulls are left out, repeated ones count once).

    The fingerprint is cut into `blocks` blocks (radius + 2 by default); with at most radius wrong bits some
    blocks - radius blocks are right, so there is one table per choice of that many blocks, keyed by them. wanted must be few
    beside prints.
    """
    blocks = blocks or radius + 2
    edges = [round(i * bits / 4 / blocks) for i in range(blocks + 1)]
    tables = list(combinations(range(blocks), blocks - radius))

    def keyed(rows: DataFrame, name: str) -> DataFrame:
        cut = lambda t: F.concat(*[F.substring(name, edges[b] + 1, edges[b + 1] - edges[b]) for b in t])
        each = F.array(*[F.struct(F.lit(i).alias("table"), cut(t).alias("value")) for i, t in enumerate(tables)])
        return rows.where(F.col("fingerprint").isNotNull()).select(F.col("fingerprint").alias(name)).distinct().select(name, F.explode(each).alias("k")).select(name, "k.*")

    away = distance("fingerprint", "wanted", bits)
    return keyed(prints, "fingerprint").join(keyed(wanted, "wanted"), ["table", "value"]).where(away <= radius).select("fingerprint", "wanted").distinct().withColumn("distance", away)


def near(prints: DataFrame, queries: DataFrame, radius: int = RADIUS, blocks: int | None = None, bits: int = BITS) -> DataFrame:
    """(query_id, doc_id, distance): all rows of prints (doc_id, fingerprint) within `radius` bits of each query. Rows with equal
    fingerprints are one entry of the tables, so copies do not multiply the candidates. Null ids and fingerprints are left
    out."""
    known = "doc_id is not null and fingerprint is not null"
    d, q = prints.where(known).select("doc_id", "fingerprint"), queries.where(known).select(F.col("doc_id").alias("query_id"), F.col("fingerprint").alias("wanted"))
    pairs = near_prints(d, q.select(F.col("wanted").alias("fingerprint")), radius, blocks, bits)
    return q.join(pairs, "wanted").join(d, "fingerprint").select("query_id", "doc_id", "distance")


def with_near_counts(rows: DataFrame, is_query: Column, radius: int = RADIUS, bits: int = BITS) -> DataFrame:
    """rows (fingerprint, ...) with near_docs: how many other rows have a fingerprint within `radius` bits; null where is_query is
    not true or the fingerprint is null. Counted by fingerprint, so that groups of copies are never paired."""
    columns = rows.columns
    rows = rows.select(F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row"), "fingerprint", F.coalesce(is_query, F.lit(False)).alias("asked"))
    asked, sizes = rows.where("asked"), rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    found = near_prints(sizes, asked, radius, None, bits).join(sizes, "fingerprint").groupBy("wanted").agg((F.sum("n") - 1).alias("near_docs"))
    counted = asked.join(found, asked.fingerprint == found.wanted, "left").select("row", "near_docs")
    others = rows.where("not asked").select("row", F.lit(None).cast("long").alias("near_docs"))
    return others.union(counted).select(*[F.col(f"row.`{c}`").alias(c) for c in columns], "near_docs")


# --- the query: a text, its edited form and the next document ---------------------------------------------------------

_SCHEMA = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, next_fingerprint string"


def _edited(bits: int, k: int):
    """Over rows (slot, doc_id, text) sorted by slot and falling doc_id: a row's next is the row after it in its slot.
    A row marked `copied` only serves as the next of the row before it."""

    def finish(rows: list[tuple]) -> pa.RecordBatch:
        texts, edited, nexts = [r[1] for r in rows], [], [r[2] for r in rows]
        for text, after in zip(texts, nexts):
            n = len(text) // 3
            edited.append(text[: len(text) - n] + after[:n])
        every = fingerprints(pa.array(texts + edited + nexts[-1:], pa.large_string()), bits, k)
        n = len(rows)
        prints = [_hex(every[:n]), _hex(every[n : 2 * n]), _hex(np.concatenate([every[1:n], every[2 * n :]]))]
        # rows of one call follow each other, so the next document's own fingerprint is the following row's
        sha = [hashlib.sha256(x.encode()).hexdigest() for x in edited]
        return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), pa.array([len(x) for x in texts], pa.int64()), pa.array(sha), *prints], names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "next_fingerprint"])

    def run(batches):
        held, ready, size = None, [], 0
        for batch in batches:
            for slot, doc_id, text, copied in zip(*(c.to_pylist() for c in batch.columns)):
                text = text or ""
                if held is not None and held[0] == slot:
                    ready.append((held[1], held[2], text))
                    size += len(text)
                elif ready:
                    yield finish(ready)
                    ready, size = [], 0
                held = None if copied else (slot, doc_id, text)
                if size > 1 << 20:
                    yield finish(ready)
                    ready, size = [], 0
        if ready:
            yield finish(ready)

    return run


def edited_fingerprints(docs: DataFrame, bits: int = BITS, k: int = K) -> DataFrame:
    """(doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, next_fingerprint) for docs (doc_id, text).

    Documents are dealt into ranges of doc_id (bounds from all ids), so texts move once. The highest id of a range is
    also sent to the range above, where it follows that range's last document; the highest id of all follows the
    lowest. Null texts are empty; a single document follows itself; rows without doc_id come after all others; rows of
    one doc_id follow each other by a hash of their texts.
    """
    spark = docs.sparkSession
    rank = F.coalesce("doc_id", F.lit(-(1 << 63)))
    docs = docs.select("doc_id", "text", rank.alias("rank"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("rank", [i / parts for i in range(1, parts)], 100 * parts).alias("c")).collect()[0].c if parts > 1 else None
    bounds = sorted({int(c) for c in cuts or []}, reverse=True)
    falling = F.array(*[F.lit(c) for c in bounds]).cast("array<long>")
    # slot: how many bounds are not below the id, by steps that halve; 0 holds the highest ids
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(len(bounds).bit_length()))]).cast("array<int>")
    slot = F.aggregate(steps, F.lit(0), lambda at, step: F.when(F.coalesce(F.get(falling, at + step - 1) >= F.col("rank"), F.lit(False)), at + step).otherwise(at))
    tops = docs.groupBy(slot.alias("slot")).agg(F.max("rank").alias("top")).orderBy("slot").collect()  # one row a slot
    if not tops:
        return spark.createDataFrame([], _SCHEMA)
    before = {t.top: tops[i - 1].slot for i, t in enumerate(tops)}  # the first follows the last
    also = F.create_map(*[F.lit(x).cast(t) for kv in before.items() for x, t in zip(kv, ("long", "int"))])
    again = F.try_element_at(also, F.col("rank"))
    places = F.array_compact(F.array(F.struct(slot.alias("slot"), F.lit(False).alias("copied")), F.when(again.isNotNull(), F.struct(again.alias("slot"), F.lit(True).alias("copied")))))
    rows = docs.select("doc_id", "rank", "text", F.explode(places).alias("s")).select("s.slot", "doc_id", "rank", "text", "s.copied")
    dealt = rows.repartitionById(parts, "slot").sortWithinPartitions("slot", "copied", F.desc("rank"), F.xxhash64("text"), "text")
    return dealt.select("slot", "doc_id", "text", "copied").mapInArrow(_edited(bits, k), _SCHEMA)


def op4_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Besides the likenesses, near_docs: for ids divisible by 20, how many other documents lie within RADIUS bits."""
    rows = written(edited_fingerprints(load(spark, sf_dir, "documents")))
    rows = with_near_counts(rows, F.col("doc_id") % 20 == 0)
    return rows.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness("fingerprint", "edited_fingerprint").alias("near_edited"), likeness("fingerprint", "next_fingerprint").alias("near_next"), "near_docs")
