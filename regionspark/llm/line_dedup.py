"""Operator 9, line dedup by an exact set-similarity join (prefix, positional and length filters, then the sets)."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm.common import binaries, dropped, hashed_texts, let, load, mix, written
from regionspark.llm.jaccard_join import _checked, _sums

#: Word counts are kept for so many hash values: a table of fixed size, whatever the corpus; it travels in slices.
RARITY, SLICE = 1 << 19, 1 << 11
#: Words whose counts a task adds to its table at once.
GATHER = 1 << 21
PERCENT = 80
#: Prefix entries that are joined at once, and entries of one word beyond which it is split into cells.
PART, CELL = 300_000, 20_000
#: Pairs that are compared at once in a task.
PAIRS = 1 << 21
#: Bits by which a scan recognises the lines it has to return, and lines up to which it is used (16 bits a line); where
#: there are more, the texts are joined to them instead.
MARKS = 1 << 25
MARKED = MARKS // 16
MIN_WORDS = 5
_A = np.uint64(0x9FB21C651E98DF25)


def _counted(df: DataFrame, values, size: int) -> np.ndarray:
    """How often each number below `size` comes up in all rows; values(batch) yields arrays of such numbers. Tasks add up
    their own counts and send slices of the table; slices are added as they come in, so no task holds more than one table."""

    def count(batches):
        total, held, n = np.zeros(size, np.int64), [], 0
        for batch in batches:
            for some in values(batch):
                held.append(some.astype(np.int32))
                n += len(some)
                if n > GATHER:
                    total += np.bincount(np.concatenate(held), minlength=size)
                    held, n = [], 0
        total += np.bincount(np.concatenate([np.zeros(0, np.int32), *held]), minlength=size)
        yield sent(total, np.flatnonzero(total.reshape(-1, SLICE).any(axis=1)))

    def sent(total, slices):
        return pa.RecordBatch.from_arrays([pa.array(slices.astype(np.int32)), binaries(total.reshape(-1, SLICE)[slices].ravel(), np.arange(len(slices) + 1) * SLICE)], names=["slice", "counts"])

    def add(batches):
        total, seen = np.zeros(size, np.int64), set()
        for batch in batches:
            for k, counts in zip(batch.column(0).to_pylist(), batch.column(1)):
                total[k * SLICE : (k + 1) * SLICE] += np.frombuffer(counts.as_buffer(), np.int64)
                seen.add(k)
        yield sent(total, np.array(sorted(seen), np.int64))

    schema = "slice int, counts binary"
    out = np.zeros(size, np.int64)
    for x in df.mapInArrow(count, schema).repartition("slice").mapInArrow(add, schema).collect():  # size / SLICE rows
        out[x.slice * SLICE : (x.slice + 1) * SLICE] = np.frombuffer(x.counts, np.int64)
    return out


def rarity(docs: DataFrame) -> np.ndarray:
    """Rank of each of RARITY hash values by how often words with it occur in all texts, rarest first."""
    total = _counted(docs.select("text"), lambda batch: ((h & np.uint64(RARITY - 1)) for _, _, h, *_ in hashed_texts(batch.column(0), True)), RARITY)
    rank = np.empty(RARITY, np.uint32)
    rank[np.lexsort((np.arange(RARITY), total))] = np.arange(RARITY, dtype=np.uint32)
    return rank


def _line_sets(texts: pa.Array, rank: np.ndarray):
    """For each chunk of rows: first row, row and number of each line with words, its words, distinct words sorted by
    rarity, offsets of the lines in them."""
    for first, n, h, row, data, starts, off in hashed_texts(texts, True):
        if not len(h):
            continue
        breaks = np.zeros(len(data) + 1, np.int32)
        np.cumsum(data == 10, out=breaks[1:])
        number = breaks[starts] - breaks[off[row]]
        new = np.ones(len(h), bool)
        new[1:] = (row[1:] != row[:-1]) | (number[1:] != number[:-1])
        line = np.cumsum(new) - 1
        key = line * RARITY + rank[(h & np.uint64(RARITY - 1)).astype(np.int64)]
        bits = len(h).bit_length()
        if int(key[-1]).bit_length() + 21 + bits < 63:  # sorting numbers is faster than sorting places by them
            packed = np.sort(key << bits | np.arange(len(h)))
            order, key = packed & ((1 << bits) - 1), packed >> bits
        else:
            order = np.argsort(key)
            key = key[order]
        same = np.flatnonzero(key[1:] == key[:-1])
        tied = np.union1d(same, same + 1)  # words of one hash value are put in order by their whole hashes
        own = order[tied]
        order[tied] = own[np.lexsort((h[own], key[tied]))]
        g, at = h[order], key // RARITY
        fresh = np.ones(len(g), bool)
        fresh[1:] = (g[1:] != g[:-1]) | (at[1:] != at[:-1])
        g, at = g[fresh], at[fresh]
        yield first, row[new], number[new], np.bincount(line), g, np.concatenate([[0], np.cumsum(np.bincount(at))]).astype(np.int64)


def _prefixes(rank, percent: int, least: int):
    def run(batches):
        for batch in batches:
            for first, row, number, n_words, g, offsets in _line_sets(batch.column(1), rank.value):
                size = np.diff(offsets)
                long = n_words >= least
                least_size = -(-size * percent // 100)
                alone = (least_size == size) & (100 * size // percent == size)  # no set of another size or with other words can link
                prefix = np.where(long & ~alone, size - least_size + 1, 0)
                within = np.arange(len(g)) - np.repeat(offsets[:-1], size)
                kept = g[within < np.repeat(prefix, size)]
                spot, other = mix(g), mix(g + _A)
                bit, upper = np.uint64(1) << (spot & np.uint64(63)), spot >> np.uint64(63)
                sketch = [np.bitwise_xor.reduceat(np.where(upper == half, bit, 0), offsets[:-1]).view(np.int64) for half in (0, 1)]
                ends = np.concatenate([[0], np.cumsum(prefix)])
                leads = [pa.array((np.minimum.reduceat(x, offsets[:-1]) ^ tag).view(np.int64), mask=alone) for x, tag in ((other, np.uint64(0)), (spot, _A))]
                out = pa.RecordBatch.from_arrays(
                    [batch.column(0).take(pa.array(first + row)), pa.array(number.astype(np.int32)), pa.array(size.astype(np.int32)),
                     pa.array(_sums(spot, offsets).view(np.int64)), pa.array(_sums(other, offsets).view(np.int64)), *map(pa.array, sketch), *leads,
                     pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array((kept >> np.uint64(33)).astype(np.int32)))],
                    names=["doc_id", "line", "size", "h1", "h2", "sketch", "sketch2", "lead1", "lead2", "prefix"],
                )
                yield out.filter(pa.array(long))

    return run


def _spot(doc_id: np.ndarray, line: np.ndarray | int = 0) -> np.ndarray:
    """Place of a line, or of a document (line 0), among MARKS bits."""
    return (mix(doc_id.astype(np.int64).view(np.uint64) * _A + np.asarray(line, np.int64).view(np.uint64)) & np.uint64(MARKS - 1)).astype(np.int64)


def _marks(spots: DataFrame) -> np.ndarray:
    """The bits of lines (doc_id, line) and of their documents. Bits are gathered into 64-bit words before they come
    here, so MARKS / 64 rows at most."""

    def place(batches):
        for batch in batches:
            doc, line = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            at = np.unique(np.concatenate([_spot(doc, line + 1), _spot(doc)]))
            yield pa.RecordBatch.from_arrays([pa.array((at >> 6).astype(np.int32)), pa.array((np.uint64(1) << (at & 63).astype(np.uint64)).view(np.int64))], names=["word", "bits"])

    words = spots.mapInArrow(place, "word int, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits")).toPandas()
    out = np.zeros(MARKS // 64, np.int64)
    out[words["word"].to_numpy(np.int64)] = words["bits"].to_numpy(np.int64)
    return out


def _picked(ids, lines, g, offsets, mine):
    size = np.diff(offsets)[mine]
    pick = np.repeat(offsets[:-1][mine] - np.concatenate([[0], np.cumsum(size)])[:-1], size) + np.arange(size.sum())
    return pa.RecordBatch.from_arrays([pa.array(ids[mine]), pa.array(lines[mine].astype(np.int32)), binaries(g[pick], np.concatenate([[0], np.cumsum(size)]))], names=["doc_id", "line", "members"])


def _wanted_sets(rank, marks):
    """The sets of the lines that the marks name; the marks may name others too."""

    def run(batches):
        bits = np.unpackbits(marks.value.view(np.uint8), bitorder="little").view(bool)
        for batch in batches:
            batch = batch.filter(pa.array(bits[_spot(batch.column(0).to_numpy())]))
            ids = batch.column(0).to_numpy()
            for first, row, number, _, g, offsets in _line_sets(batch.column(1), rank.value):
                yield _picked(ids[first + row], number, g, offsets, np.flatnonzero(bits[_spot(ids[first + row], number.astype(np.int64) + 1)]))

    return run


def _listed_sets(rank):
    """The sets of the lines whose numbers come with the texts."""

    def run(batches):
        for batch in batches:
            ids, wanted = batch.column(0).to_numpy(), batch.column(2).combine_chunks() if isinstance(batch.column(2), pa.ChunkedArray) else batch.column(2)
            owner = np.repeat(np.arange(len(ids)), wanted.value_lengths().to_numpy())
            listed = owner << 32 | wanted.flatten().to_numpy().astype(np.int64)
            for first, row, number, _, g, offsets in _line_sets(batch.column(1), rank.value):
                yield _picked(ids[first + row], number, g, offsets, np.flatnonzero(np.isin((first + row) << 32 | number, listed)))

    return run


def _earlier():
    """Whether line b comes before the other."""
    return (F.col("doc_b") < F.col("doc_id")) | ((F.col("doc_b") == F.col("doc_id")) & (F.col("line_b") < F.col("line")))


def _away():
    return F.bit_count(F.col("sketch").bitwiseXOR(F.col("sketch_b"))) + F.bit_count(F.col("sketch2").bitwiseXOR(F.col("sketch2_b")))


def _score():
    """Sketch distance per mille of both sizes: the lower, the likelier a link."""
    return F.floor(1000 * _away() / (F.col("size") + F.col("size_b"))).cast("int")


def _near(percent: int):
    """Whether sizes and the Hamming distance of the 128-bit parity sketches allow two lines to link."""
    return (100 * F.least("size", "size_b") >= percent * F.greatest("size", "size_b")) & ((100 + percent) * _away() <= (100 - percent) * (F.col("size") + F.col("size_b")))


def _matched(pairs: DataFrame, docs: DataFrame, rank, percent: int, single: bool = False) -> DataFrame:
    """(doc_id, line) of the later lines of those pairs (doc_id, line: later, doc_b, line_b: earlier, score) whose sets
    link. Of each line the most promising pair is checked first, and only lines that it leaves open meet their others;
    single: there is but one pair a line."""
    spots = written(pairs.select("doc_id", "line").union(pairs.select("doc_b", "line_b")).distinct())
    schema = "doc_id long, line int, members binary"
    if spots.count() <= MARKED:
        sets = written(docs.mapInArrow(_wanted_sets(rank, docs.sparkSession.sparkContext.broadcast(_marks(spots))), schema))
    else:
        listed = spots.groupBy(F.col("doc_id").alias("_id")).agg(F.collect_list("line").alias("lines"))  # a document's own lines
        sets = written(docs.join(listed, docs.doc_id == F.col("_id")).select("doc_id", "text", "lines").mapInArrow(_listed_sets(rank), schema).distinct())
    dropped(spots)
    later, earlier = sets.withColumnRenamed("members", "x"), sets.select(F.col("doc_id").alias("doc_b"), F.col("line").alias("line_b"), F.col("members").alias("y"))

    def linked(some: DataFrame) -> DataFrame:
        joined = some.join(later, ["doc_id", "line"]).join(earlier, ["doc_b", "line_b"])
        return written(joined.select("doc_id", "line", "x", "y").mapInArrow(_checked(percent), "a long, b int").distinct().toDF("doc_id", "line"))

    if single:
        out = linked(pairs)
        dropped(sets)
        return out
    best = written(pairs.groupBy("doc_id", "line").agg(F.min(F.struct("score", "doc_b", "line_b")).alias("m")).select("doc_id", "line", "m.doc_b", "m.line_b"))
    first = linked(best)
    others = pairs.drop("score").join(best, ["doc_id", "line", "doc_b", "line_b"], "left_anti").join(first, ["doc_id", "line"], "left_anti")
    out = written(first.union(linked(others)))
    for done in (sets, best, first):
        dropped(done)
    return out


#: A word of a line's prefix: flags are 1 for an open line (no match yet), 2 and 4 for the sides of the join that it stands
#: on (2: as the smaller set, 4: as the larger one).
_ENTRY = np.dtype([("word", "<i4"), ("cell", "<i4"), ("line", "<i4"), ("size", "<i4"), ("pos", "<i4"), ("flags", "<i4"), ("doc", "<i8"), ("s1", "<u8"), ("s2", "<u8")])


def _buckets(words: np.ndarray) -> np.ndarray:
    return words & np.int32(RARITY - 1)


def _spread(percent: int, parts: int, entries):
    """Rows (part, rows): the prefix entries of lines, packed, by the part in which they meet their word's others.

    A word of up to CELL entries has one cell. One of more has a grid: open lines as the smaller set against all as the
    larger one, and the closed ones as the smaller set against the open ones, each side cut into shares of about CELL, so
    every pair of lines of which one is open meets in one cell, and no cell is larger than two shares."""

    def run(batches):
        every, opened = entries.value
        shares = [np.maximum(-(-n // CELL), 1) for n in (every, opened, every - opened)]
        for batch in batches:
            doc, line, size, s1, s2, is_open = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(6))
            prefix = batch.column(6)
            many = prefix.value_lengths().to_numpy()
            owner = np.repeat(np.arange(len(doc)), many)
            e = np.zeros(len(owner), _ENTRY)
            e["word"] = prefix.flatten().to_numpy()
            e["pos"] = np.arange(len(owner)) - np.repeat(np.cumsum(many) - many, many)
            for name, column in (("doc", doc), ("line", line), ("size", size), ("s1", s1.view(np.uint64)), ("s2", s2.view(np.uint64))):
                e[name] = column[owner]
            # the smaller set of a pair meets the larger one within its first size - ceil(2 J / (1 + J) * size) + 1 words
            small = e["pos"] < e["size"] + 2 * percent * e["size"].astype(np.int64) // -(100 + percent) + 1
            e["flags"] = is_open[owner] | small << 1 | 4
            at = _buckets(e["word"])
            hot = every[at] > CELL
            out = [e[~hot]]
            if hot.any():
                e, at = e[hot], at[hot]
                where = mix(e["doc"].view(np.uint64) * _A + e["line"].astype(np.uint64))
                all_, open_, closed = (x[at] for x in shares)
                now, less = (e["flags"] & 1) > 0, (e["flags"] & 2) > 0
                for grid, side, pick, own, other in ((0, 2, less & now, open_, all_), (0, 4, np.ones(len(e), bool), all_, open_), (1, 2, less & ~now, closed, open_), (1, 4, now, open_, closed)):
                    k = np.flatnonzero(pick)
                    copies = np.repeat(k, other[k])
                    turn = np.arange(len(copies)) - np.repeat(np.cumsum(other[k]) - other[k], other[k])
                    mine = (where[copies] % own[copies].astype(np.uint64)).astype(np.int64)
                    first, second = (mine, turn) if side == 2 else (turn, mine)
                    more = e[copies]
                    more["flags"] = more["flags"] & 1 | side
                    more["cell"] = (1 + grid + 2 * (first * np.where(grid, open_, all_)[copies] + second)) & 0x7FFFFFFF
                    out.append(more)
            e = np.concatenate(out)
            part = (mix(e["word"].astype(np.uint64) << np.uint64(32) | e["cell"].astype(np.uint64)) % np.uint64(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))])
            full = np.flatnonzero(np.diff(ends))
            data, bounds = e[order].tobytes(), np.append(ends[full], ends[-1]) * _ENTRY.itemsize
            rows = pa.Array.from_buffers(pa.large_binary(), len(full), [None, pa.py_buffer(bounds.astype(np.int64)), pa.py_buffer(data)]).cast(pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(full.astype(np.int32)), rows], names=["part", "rows"])

    return run


def _met(e: np.ndarray, percent: int):
    """Pairs (doc_id, line, doc_b, line_b, score) of a part's entries that share a word and pass the length, positional and
    sketch filters, the later line first; it is open."""
    e = e[np.lexsort((e["size"], e["cell"], e["word"]))]
    new = np.ones(len(e), bool)
    new[1:] = (e["word"][1:] != e["word"][:-1]) | (e["cell"][1:] != e["cell"][:-1])
    place = np.cumsum(new) << 32 | e["size"]
    for opened in (1, 0):  # open lines as the smaller set against all, closed ones against open ones
        a = np.flatnonzero((e["flags"] & 3) == (2 | opened))
        b = np.flatnonzero((e["flags"] & 4 > 0) & ((e["flags"] & 1 > 0) | (opened == 1)))
        low = np.searchsorted(place[b], place[a])
        many = np.searchsorted(place[b], (place[a] & ~0xFFFFFFFF) | 100 * e["size"][a].astype(np.int64) // percent, "right") - low
        total = np.concatenate([[0], np.cumsum(many)])
        i = 0
        while i < len(a):
            j = max(i + 1, int(np.searchsorted(total, total[i] + PAIRS, "right")) - 1)
            n = many[i:j]
            x = np.repeat(a[i:j], n)
            y = b[np.repeat(low[i:j] - (total[i:j] - total[i]), n) + np.arange(total[j] - total[i])]
            i = j
            both = e["size"][x].astype(np.int64) + e["size"][y]
            left = np.minimum(e["size"][x] - e["pos"][x], e["size"][y] - e["pos"][y])
            ok = np.flatnonzero((100 + percent) * left.astype(np.int64) >= percent * both)
            x, y, both = x[ok], y[ok], both[ok]
            away = np.bitwise_count(e["s1"][x] ^ e["s1"][y]).astype(np.int64) + np.bitwise_count(e["s2"][x] ^ e["s2"][y])
            ok = np.flatnonzero((100 + percent) * away <= (100 - percent) * both)
            x, y, score = x[ok], y[ok], 1000 * away[ok] // both[ok]
            before = (e["doc"][x] < e["doc"][y]) | ((e["doc"][x] == e["doc"][y]) & (e["line"][x] < e["line"][y]))
            x, y = np.where(before, y, x), np.where(before, x, y)  # x is the later one
            ok = ((e["flags"][x] & 1) > 0) & ((e["doc"][x] != e["doc"][y]) | (e["line"][x] != e["line"][y]))
            x, y = x[ok], y[ok]
            yield pa.RecordBatch.from_arrays([pa.array(e["doc"][x]), pa.array(e["line"][x]), pa.array(e["doc"][y]), pa.array(e["line"][y]), pa.array(score[ok].astype(np.int32))], names=["doc_id", "line", "doc_b", "line_b", "score"])


def _meet(percent: int):
    def run(batches):
        part, held = None, []
        for batch in batches:
            for k, rows in zip(batch.column(0).to_pylist(), batch.column(1)):
                if k != part and held:
                    yield from _met(np.concatenate(held), percent)
                    held = []
                part = k
                held.append(np.frombuffer(rows.as_buffer(), _ENTRY))
        if held:
            yield from _met(np.concatenate(held), percent)

    return run


def _prefix_pairs(marked: DataFrame, percent: int) -> DataFrame:
    """Candidate pairs of lines (doc_id, line, size, sketch, sketch2, open, prefix) of which the later one is open: prefix
    entries travel packed, by parts of words, and meet in sorted arrays."""

    def values(batch):
        prefix, is_open = batch.column(1), batch.column(0).to_numpy(zero_copy_only=False)
        at = _buckets(prefix.flatten().to_numpy())
        yield at
        yield at[np.repeat(is_open, prefix.value_lengths().to_numpy())] + RARITY

    counts = _counted(marked.select("open", "prefix"), values, 2 * RARITY)
    parts = int(-(-counts[:RARITY].sum() // PART)) or 1
    entries = marked.sparkSession.sparkContext.broadcast((counts[:RARITY], counts[RARITY:]))
    spread = marked.select("doc_id", "line", "size", "sketch", "sketch2", "open", "prefix").mapInArrow(_spread(percent, parts, entries), "part int, rows binary")
    return spread.repartition("part").sortWithinPartitions("part").mapInArrow(_meet(percent), "doc_id long, line int, doc_b long, line_b int, score int").distinct()


def repeated_lines(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc_id, lines): numbers (from 0, ascending) of the lines of docs (doc_id, text) that repeat an earlier line.

    A line repeats an earlier one, in order of (doc_id, line number), when the Jaccard similarity of their sets of
    words (A-Z lower-cased) is percent / 100 or more, whether or not the earlier one repeats another itself. Lines
    of fewer than min_words words are neither compared nor listed (1 takes every line that has a word). Rows without a
    doc_id are ignored.

    Lines with equal sets are one class before the join; a set so small that only an equal one can link (at 0.8 up to
    three words) needs no more than that. Words are ordered by rarity; two linked lines share a word
    among the first size - ceil(J * size) + 1 of the larger set and fewer of the smaller (prefix filter); position and
    length filters and a parity sketch's Hamming distance act inside the join. Before that a line is checked against the
    first line that has the same smallest word hash, by two ways of hashing, and a line that has its match there only serves as the
    earlier side afterwards: variants of one line are not paired throughout, and no match is lost.
    """
    spark = docs.sparkSession
    docs = docs.select("doc_id", "text").where("doc_id is not null")
    rank = spark.sparkContext.broadcast(rarity(docs))
    full = written(docs.mapInArrow(_prefixes(rank, percent, min_words), "doc_id long, line int, size int, h1 long, h2 long, sketch long, sketch2 long, lead1 long, lead2 long, prefix array<int>"))
    heads = full.groupBy("h1", "h2", "size").agg(F.min(F.struct("doc_id", "line", "sketch", "sketch2", "lead1", "lead2", "prefix")).alias("head"))
    heads = written(heads.select("h1", "size", "head.*"))
    led = heads.select("doc_id", "line", "size", "sketch", "sketch2", F.explode(F.array("lead1", "lead2")).alias("lead")).where("lead is not null")
    leaders = led.groupBy("lead").agg(F.min(F.struct("doc_id", "line", "size", "sketch", "sketch2")).alias("m"), F.count("*").alias("n")).where("n > 1")
    # written first, so that both sides of the join come from exchanges and a hot lead's lines are split. Where a hash
    # join is asked for here and below, the hashed side has one row a key.
    leaders = written(leaders.select("lead", F.col("m.doc_id").alias("doc_b"), F.col("m.line").alias("line_b"), F.col("m.size").alias("size_b"), F.col("m.sketch").alias("sketch_b"), F.col("m.sketch2").alias("sketch2_b")))
    near = led.join(leaders.hint("shuffle_hash"), "lead").where(_near(percent) & _earlier()).select("doc_id", "line", F.struct(_score().alias("score"), "doc_b", "line_b").alias("m"))
    firsts = written(near.groupBy("doc_id", "line").agg(F.min("m").alias("m")).select("doc_id", "line", "m.doc_b", "m.line_b", "m.score"))  # the more promising leader
    dropped(leaders)
    early = _matched(firsts, docs, rank, percent, single=True)
    found = early.withColumn("hit", F.lit(True))
    ready = heads.where(F.size("prefix") > 0).select("doc_id", "line", "size", "sketch", "sketch2", "prefix")
    marked = written(ready.join(found.hint("shuffle_hash"), ["doc_id", "line"], "left").select(*ready.columns, F.col("hit").isNull().alias("open")))
    rest = written(_prefix_pairs(marked, percent).join(firsts.drop("score"), ["doc_id", "line", "doc_b", "line_b"], "left_anti"))
    dropped(marked)
    late = _matched(rest, docs, rank, percent)
    for done in (firsts, rest):
        dropped(done)
    # a line goes if it does not lead its class or if a match was found for it
    class_of = ["doc_id", "line", "h1"]
    own = full.select(*class_of, F.lit(0).alias("head")).union(heads.select(*class_of, F.lit(1))).repartition("doc_id").groupBy(*class_of).agg(F.max("head").alias("head"))
    gone = own.where("head = 0").select("doc_id", "line").union(early).union(late)
    out = written(gone.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines")))  # a document's own lines
    for done in (full, heads, early, late):
        dropped(done)
    return out


def without_repeats(docs: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS) -> DataFrame:
    """docs with the repeated lines taken out of `text` (other lines stay as they are, joined by \\n) and the columns
    n_lines and n_removed (long). Null texts stay null with 0 lines; an empty text is one line; rows without doc_id and
    other columns stay unchanged; rows that share a doc_id are treated as one document, line by line."""
    gone = repeated_lines(docs, percent, min_words)
    joined = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col("doc_id").alias("id")).join(gone.withColumnRenamed("doc_id", "other").hint("shuffle_hash"), F.col("id") == F.col("other"), "left")
    text = F.col("row.text")
    split = F.split(text, "\n", -1)
    kept = let(split, lambda x: F.array_join(F.transform(F.array_except(F.sequence(F.lit(0), F.size(x) - 1), F.col("lines")), lambda i: F.get(x, i)), "\n"))
    named = [F.when(F.col("lines").isNull(), text).otherwise(kept).alias(c) if c == "text" else F.col(f"row.`{c}`") for c in docs.columns if c not in {"n_lines", "n_removed"}]
    return joined.select(*named, F.when(text.isNull(), 0).otherwise(F.size(split)).cast("long").alias("n_lines"), F.coalesce(F.size("lines"), F.lit(0)).cast("long").alias("n_removed"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return without_repeats(load(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_removed", "text")


ORACLE = r"""
WITH x AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents),
l AS (SELECT doc_id, unnest(ls) AS s, generate_subscripts(ls, 1) AS i FROM x),
w AS (SELECT doc_id, i, s, regexp_extract_all(translate(s, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM l),
c AS (SELECT doc_id, i, list_sort(list_distinct(w)) AS w FROM w WHERE len(w) >= 5),
h AS (SELECT w, min((doc_id, i)) AS head, len(w) AS n FROM c GROUP BY w),
t AS (SELECT head, n, unnest(w) AS t FROM h),
f AS (SELECT t, count(*) AS c FROM t GROUP BY t),
p AS (SELECT head, n, t, row_number() OVER (PARTITION BY head ORDER BY f.c, t) AS k FROM t JOIN f USING (t)),
q AS (SELECT * FROM p WHERE k <= n - ceil(0.8 * n) + 1),
cand AS (SELECT DISTINCT a.head AS a, b.head AS b FROM q a JOIN q b ON a.t = b.t AND b.head < a.head AND 100 * least(a.n, b.n) >= 80 * greatest(a.n, b.n)),
hit AS (SELECT DISTINCT a FROM cand JOIN h x ON x.head = a JOIN h y ON y.head = b WHERE 100 * len(list_intersect(x.w, y.w)) >= 80 * (x.n + y.n - len(list_intersect(x.w, y.w)))),
gone AS (SELECT c.doc_id, c.i FROM c JOIN h ON c.w = h.w LEFT JOIN hit ON hit.a = h.head WHERE hit.a IS NOT NULL OR (c.doc_id, c.i) <> h.head),
k AS (SELECT l.doc_id, string_agg(l.s, chr(10) ORDER BY l.i) FILTER (gone.i IS NULL) AS t, count(*) AS n, count(gone.i) AS g
      FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT x.doc_id, coalesce(k.n, 0)::BIGINT AS n_lines, coalesce(k.g, 0)::BIGINT AS n_removed, CASE WHEN x.text IS NOT NULL THEN coalesce(k.t, '') END AS text FROM x LEFT JOIN k USING (doc_id)
"""
