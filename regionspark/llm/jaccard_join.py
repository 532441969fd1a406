"""Operator 5, n-gram Jaccard join by parity sketches.

Every distinct shingle set gets, for its size band, a bit sketch: a shingle's hash names a block and a bit in it, and
the bits of all shingles are XORed. A differing shingle flips one bit, so the Hamming distance of two sketches is at
most the symmetric difference of the sets, and with at most d differences one of d + 1 blocks is untouched. Equal
blocks are joined (pigeonhole), pairs are checked by size and by the Hamming distance of a short sketch, then by the
sets themselves. Sets are 64-bit hashes of shingles.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm.common import binaries, components, dropped, hashed_texts, lists, load, mix, written

#: 64-bit words of the short sketch that is compared before the sets are.
SHORT = 8
#: Shares in which the sketches, and then their blocks, are shuffled.
SHARES = 4
_C1, _C2, _C3 = (np.uint64(x) for x in (0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3))


def bands(percent: int, largest: int) -> np.ndarray:
    """Lower bounds of size bands such that sets that can link are in the same band or in neighbouring ones."""
    out = [1]
    while out[-1] <= largest:
        out.append(max(out[-1] + 1, (out[-1] - 1) * 100 // percent + 1))
    return np.array(out, np.int64)


def differences(percent: int, bounds: np.ndarray) -> np.ndarray:
    """Most differing shingles of a linked pair whose smaller set is in the band: size * (1 - J) / J, rounded down."""
    return (bounds[1:] - 1) * (100 - percent) // percent


def shingle_sets(texts: pa.Array, k: int, lower: bool):
    """For each chunk of rows: first row, number of rows, sorted distinct shingle hashes, offsets of the rows in them."""
    for first, n, h, row, _, _, _ in hashed_texts(texts, lower):
        size = np.bincount(row, minlength=n)
        at = np.concatenate([[0], np.cumsum(size)])
        if k > 1 and len(h):
            last = len(h) - k + 1
            g = h[: max(last, 0)].copy()
            for j in range(1, k):
                g = mix(g * _C1 + h[j : j + len(g)] * _C2 + _C3)
            keep = row[: len(g)] == row[k - 1 : k - 1 + len(g)]
            g, r = g[keep], row[: len(g)][keep]
            for x in np.flatnonzero((size > 0) & (size < k)):  # fewer words: the whole sequence is one shingle
                v = np.array([size[x]], np.uint64)
                for w in range(at[x], at[x + 1]):
                    v = mix(v * _C2 + h[w : w + 1] * _C3)
                g, r = np.append(g, v), np.append(r, x)
        else:
            g, r = h, row
        order = np.lexsort((g, r))
        g, r = g[order], r[order]
        new = np.ones(len(g), bool)
        new[1:] = (g[1:] != g[:-1]) | (r[1:] != r[:-1])
        g, r = g[new], r[new]
        yield first, n, g, np.concatenate([[0], np.cumsum(np.bincount(r, minlength=n))]).astype(np.int64)


def block_counts(d: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Blocks of a sketch per band, and how many of them a set may leave out: beyond the d + 1 of the pigeonhole there
    are as many as are likely to be empty (mean and three deviations, for the band's smallest size), so that empty
    blocks, which all sets share, need not be joined."""
    empty = (d + 1) * np.exp(-bounds[:-1] / (d + 1))
    spare = np.ceil(empty + 3 * np.sqrt(empty)).astype(np.int64) + 1
    return d + 1 + spare, spare


def _sums(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(values, dtype=np.uint64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def _block_keys(g: np.ndarray, offsets: np.ndarray, band: np.ndarray, d: np.ndarray, counts: np.ndarray, spare: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Keys of the sets' blocks under the given band of each set (band < 0 or d = 0: none), and the offsets of the sets."""
    n = len(offsets) - 1
    size = np.diff(offsets)
    blocks = np.where((band >= 0) & (size > 0), counts[np.maximum(band, 0)], 0)
    blocks[(band >= 0) & (d[np.maximum(band, 0)] == 0)] = 0  # only equal sets link; those are one class already
    base = np.concatenate([[0], np.cumsum(blocks)]).astype(np.int64)
    r = np.repeat(np.arange(n), size)
    use = blocks[r] > 0
    h, r = mix(g[use] ^ _C3), r[use]
    at = base[r] + ((h >> np.uint64(32)) * blocks[r].astype(np.uint64) >> np.uint64(32)).astype(np.int64)
    parity, held = np.zeros(base[-1], np.uint64), np.bincount(at, minlength=base[-1])
    np.bitwise_xor.at(parity, at, np.uint64(1) << (h & np.uint64(63)))
    whole = np.zeros(base[-1], np.uint64)
    np.bitwise_xor.at(whole, at, mix(h))  # a block of few shingles has few bits: the XOR of its hashes goes with them
    own = np.repeat(np.arange(n), blocks)
    index = np.arange(base[-1]) - base[own]
    keys = mix(mix(mix(parity * _C1 + held.astype(np.uint64)) + whole) * _C2 + index.astype(np.uint64) * _C3 + band[own].astype(np.uint64))
    weak = held == 0
    few = np.bincount(own[weak], minlength=n) <= spare[np.maximum(band, 0)]
    keep = ~(weak & few[own])
    return keys[keep], np.concatenate([[0], np.cumsum(np.bincount(own[keep], minlength=n))]).astype(np.int64)


def _marks(k: int, lower: bool):
    def run(batches):
        for batch in batches:
            for first, n, g, offsets in shingle_sets(batch.column(1), k, lower):
                sums = [pa.array(_sums(x, offsets).view(np.int64)) for x in (mix(g + _C1), mix(g ^ _C2))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), pa.array(np.diff(offsets)), *sums], names=["doc_id", "n_shingles", "h1", "h2"])

    return run


def _sketches(percent: int, k: int, lower: bool):
    def run(batches):
        for batch in batches:
            for first, n, g, offsets in shingle_sets(batch.column(1), k, lower):
                size = np.diff(offsets)
                bounds = bands(percent, int(size.max(initial=1)) + 1)
                d = differences(percent, bounds)
                band = np.searchsorted(bounds, size, "right") - 1
                counts, spare = block_counts(d, bounds)
                low, high = (_block_keys(g, offsets, x, d, counts, spare) for x in (band, band - 1))
                many = np.concatenate([[0], np.cumsum(np.diff(low[1]) + np.diff(high[1]))])
                keys = np.empty(many[-1], np.uint64)
                for values, off, shift in ((low[0], low[1], many[:-1]), (high[0], high[1], many[:-1] + np.diff(low[1]))):
                    own = np.repeat(np.arange(n), np.diff(off))
                    keys[shift[own] + np.arange(len(values)) - off[:-1][own]] = values
                r = np.repeat(np.arange(n), size)
                short = np.zeros(n * SHORT, np.uint64)
                h = mix(g * _C2 + _C1)
                np.bitwise_xor.at(short, r * SHORT + (h >> np.uint64(61)).astype(np.int64), np.uint64(1) << (h & np.uint64(63)))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(first, n), pa.array(size), lists(short, np.arange(n + 1) * SHORT), lists(keys, many)],
                    names=["doc_id", "n_shingles", "short", "keys"],
                )

    return run


def _sets(k: int, lower: bool):
    def run(batches):
        for batch in batches:
            for first, n, g, offsets in shingle_sets(batch.column(1), k, lower):
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, n), binaries(g, offsets)], names=["id", "members"])

    return run


def _checked(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3)):
                x, y = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = len(x) + len(y) - len(np.union1d(x, y))
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(ok, pa.bool_()))

    return run


def _verified(pairs: DataFrame, docs: DataFrame, percent: int, k: int, lower: bool) -> DataFrame:
    """The pairs (a, b) whose sets link, by the sets of the documents they name."""
    ids = pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct()
    texts = docs.join(ids, docs.doc_id == ids.id).select("id", "text")
    sets = written(texts.mapInArrow(_sets(k, lower), "id long, members binary"))
    left, right = sets.select(F.col("id").alias("a"), F.col("members").alias("x")), sets.select(F.col("id").alias("b"), F.col("members").alias("y"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "x", "y")
    out = written(joined.mapInArrow(_checked(percent), "a long, b long"))
    dropped(sets)
    return out


def _side(x: str) -> list[Column]:
    return [F.col("id").alias(x), F.col("n_shingles").alias(f"size_{x}"), F.col("short").alias(f"short_{x}")]


def _close(percent: int) -> Column:
    """Whether sizes and the Hamming distance of the short sketches allow a and b to link."""
    away = reduce(lambda n, m: n + m, [F.bit_count(F.get("short_a", i).bitwiseXOR(F.get("short_b", i))) for i in range(SHORT)])
    small = F.least("size_a", "size_b")
    return (100 * small >= percent * F.greatest("size_a", "size_b")) & (percent * away <= (100 - percent) * small)


def _shares(h: Column) -> list[Column]:
    return [F.pmod(h, F.lit(SHARES)) == i for i in range(SHARES)]


def _sketched(docs: DataFrame, heads: DataFrame, percent: int, k: int, lower: bool) -> DataFrame:
    """(id, n_shingles, short, keys) of the documents that name a class and have blocks to join."""
    every = docs.mapInArrow(_sketches(percent, k, lower), "doc_id long, n_shingles long, short array<long>, keys array<long>").where(F.size("keys") > 0)
    return every.join(heads, "doc_id", "left_semi").withColumnRenamed("doc_id", "id")


def _met(blocks: DataFrame) -> DataFrame:
    """The blocks (id, key) that more than one sketch has, with the number n of those."""
    return blocks.join(blocks.groupBy("key").agg(F.count("*").alias("n")).where("n > 1"), "key")


def linked(docs: DataFrame, percent: int = 80, k: int = 5, lower: bool = True) -> DataFrame:
    """(doc_id, n_shingles, class_id, component_id) for docs (doc_id, text): documents link when
    100 * intersection >= percent * union of their sets of distinct k-word shingles.

    Words are runs of anything but ASCII white space, A-Z lower-cased if `lower`; fewer than k words are one shingle.
    A null, empty or blank text has the empty set, links with nothing and is its own class and component. Equal sets
    are one class, named by its smallest doc_id, before anything is compared, so copies are never paired. A class is
    first checked against one hub, the class that leads most of its buckets (a bucket is led by the class that meets
    most others; an unedited original leads its copies). Then classes of different components that share a bucket are
    compared by the short sketches inside the join, which lets only close pairs out, and checked, so no link is lost. doc_id is the key (long); other columns are ignored.
    """
    docs = docs.select("doc_id", "text")
    base = written(docs.mapInArrow(_marks(k, lower), "doc_id long, n_shingles long, h1 long, h2 long"))
    # written, so that the joins with it have exchanges on both sides and the rows of a class of very many copies are split
    classes = written(base.where("n_shingles > 0").groupBy("n_shingles", "h1", "h2").agg(F.min("doc_id").alias("class_id")))
    heads = classes.select(F.col("class_id").alias("doc_id"))
    # both are shuffled share by share: the shuffle files of all blocks at once take three times the disk of the sketches
    full = written(*[_sketched(docs.where(x), heads, percent, k, lower) for x in _shares(F.xxhash64("doc_id"))])
    blocks = full.select("id", F.explode("keys").alias("key"))
    met = written(*[_met(blocks.where(x)) for x in _shares(F.col("key"))])
    sizes = written(full.select("id", "n_shingles", "short"))
    dropped(full)
    popular = met.groupBy("id").agg(F.sum("n").alias("popular"))
    hubs = met.join(popular, "id").groupBy("key").agg(F.max(F.struct("popular", (-F.col("id")).alias("id"))).alias("hub")).select("key", (-F.col("hub.id")).alias("hub"))
    often = met.join(hubs, "key").where("hub <> id").groupBy("id", "hub").agg(F.count("*").alias("n"))
    best = often.groupBy("id").agg(F.max(F.struct("n", (-F.col("hub")).alias("hub"))).alias("m")).select("id", (-F.col("m.hub")).alias("hub"))
    best = best.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    pairs = written(best.join(sizes.select(*_side("b")), "b").join(sizes.select(*_side("a")), "a").where(_close(percent)).select("a", "b"))
    edges = _verified(pairs, docs, percent, k, lower)
    labels = components(edges)
    named = met.join(labels, "id", "left").select("key", "id", F.coalesce("component", "id").alias("label"))
    mixed = named.groupBy("key").agg(F.min("label").alias("p"), F.max("label").alias("q")).where("p < q").select("key")
    rest = written(named.join(mixed, "key").join(sizes, "id"))
    x = rest.select("key", F.col("label").alias("p"), *_side("a"))
    y = rest.select(F.col("key").alias("key_b"), F.col("label").alias("q"), *_side("b"))
    apart = (F.col("key") == F.col("key_b")) & (F.col("a") < F.col("b")) & (F.col("p") != F.col("q"))
    more = written(x.join(y, apart & _close(percent)).select("a", "b").distinct().join(pairs, ["a", "b"], "left_anti"))
    if more.limit(1).count():
        further = _verified(more, docs, percent, k, lower)
        dropped(labels)
        labels = components(edges.union(further))
        dropped(further)
    for done in (met, sizes, rest, pairs, more, edges):
        dropped(done)
    named = classes.join(labels, classes.class_id == labels.id, "left").select("n_shingles", "h1", "h2", "class_id", F.coalesce("component", "class_id").alias("component_id"))
    own = base.where("n_shingles > 0").join(named, ["n_shingles", "h1", "h2"]).select("doc_id", "n_shingles", "class_id", "component_id")
    out = written(own.union(base.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("class_id"), F.col("doc_id").alias("component_id"))))
    for done in (base, classes, labels):
        dropped(done)
    return out


def one_of_each(docs: DataFrame, percent: int = 80, k: int = 5) -> DataFrame:
    """The documents without the near duplicates: of each component the one with the smallest doc_id stays."""
    gone = linked(docs, percent, k).where("component_id <> doc_id").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(load(spark, sf_dir, "documents"), percent=90, k=3).select("doc_id", "n_shingles", "component_id")


ORACLE = r"""
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM (
        SELECT doc_id, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM d)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
e AS (SELECT x.doc_id AS a, y.doc_id AS b FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id JOIN n p ON p.doc_id = x.doc_id JOIN n q ON q.doc_id = y.doc_id
      GROUP BY x.doc_id, y.doc_id, p.n, q.n HAVING 100 * count(*) >= 90 * (p.n + q.n - count(*))),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM documents UNION SELECT e.b, r.root FROM r JOIN e ON e.a = r.doc_id)
SELECT r.doc_id, coalesce(any_value(n.n), 0)::BIGINT AS n_shingles, min(root) AS component_id FROM r LEFT JOIN n ON n.doc_id = r.doc_id GROUP BY r.doc_id
"""
