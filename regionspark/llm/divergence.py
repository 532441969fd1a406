"""Operator 13, source divergence audit on run-length columns.

Each (lang, source) group has a column: the count of every kept term of its language. The vocabulary is put in an order in
which equal counts stand together, each column is stored as runs, and two columns are compared by walking the union of their
run boundaries: the difference of a stretch is taken once and multiplied by its length.
"""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window as W
from pyspark.sql import functions as F

from regionspark.llm.common import dropped, load, small_batches, written

LEAST_DOCS, TOP, SMOOTH, SCALE = 30, 50, 5, 1_000_000_000
#: Terms of a block of a column; sources of a tile of pairs. A task of pairs holds 2 * TILE blocks.
BLOCK, TILE = 1 << 12, 16
#: Columns of fewest distinct counts by which the vocabulary is ordered first.
LEAD = 8
#: Distinct terms that a task counts before it passes them on; bytes of text that it splits at once.
HELD, SLICE = 200_000, 1 << 22
#: Every byte that is no part of a term becomes a space, A-Z become small (fixed values of the contract).
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))


def _words(text: bytes) -> Iterator[list[bytes]]:
    at = 0
    while at < len(text):
        end = text.find(b" ", at + SLICE)
        end = len(text) if end < 0 else end
        yield text[at:end].split()
        at = end


def term_counts(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs) of docs (lang, source, text), summed up inside each task; a key comes once a task, or a few
    times where its terms are many."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        occurrences, holders, held = defaultdict(Counter), defaultdict(Counter), 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (lang, source), counts in occurrences.items():
                terms = pa.array(counts.keys(), pa.binary()).cast(pa.string())
                within = holders[lang, source]
                columns = [pa.array([lang] * len(terms), pa.string()), pa.array([source] * len(terms), pa.string()), terms, pa.array(counts.values(), pa.int64()), pa.array(map(within.__getitem__, counts.keys()), pa.int64(), size=len(terms))]
                yield pa.RecordBatch.from_arrays(columns, names=["lang", "source", "term", "n", "docs"])
            occurrences.clear()
            holders.clear()

        for batch in batches:
            langs, sources, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2).cast(pa.large_binary())
            for lang, source, text in zip(langs, sources, texts):
                counts, seen = occurrences[lang, source], set()
                before = len(counts)
                for words in _words(text.as_buffer().to_pybytes().translate(_TERMS)):
                    counts.update(words)
                    seen.update(words)
                holders[lang, source].update(seen)
                held += len(counts) - before
                if held > HELD:
                    yield from flushed()
                    held = 0
        yield from flushed()

    rows = docs.select(*[F.coalesce(F.col(f"`{c}`").cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    return rows.mapInArrow(run, "lang string, source string, term string, n long, docs long")


def kept_counts(counts: DataFrame, least_docs: int = LEAST_DOCS) -> DataFrame:
    """(lang, source, term, n, n_lang): counts of the terms that enough documents of the language hold. One exchange by
    (lang, term) serves the sums of groups and of languages."""
    each = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    of_term = W.partitionBy("lang", "term")
    each = each.withColumn("n_lang", F.sum("n").over(of_term)).withColumn("docs", F.sum("docs").over(of_term))
    return each.where(F.col("docs") >= least_docs).select("lang", "source", "term", "n", "n_lang")


def _before(value: str, *order: str) -> Column:
    """Running sum of the earlier rows of the language."""
    return F.coalesce(F.sum(value).over(W.partitionBy("lang").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))


def placed(kept: DataFrame, leads: DataFrame) -> DataFrame:
    """(lang, term, at, size): the vocabulary of each language in clustering order, numbered from 0, and its size.

    leads: (lang, source, lead), the groups of fewest distinct counts, numbered from 0. Sorting by the counts of these one after
    another leaves the fewest runs in them, and by the total clusters the rare terms of the others. One global sort; the
    numbers come from the sort's partitions, so no language is numbered in one task.
    """
    marked = kept.join(leads, ["lang", "source"], "left")
    keys = [F.coalesce(F.max(F.when(F.col("lead") == i, F.col("n"))), F.lit(0)).alias(f"c{i}") for i in range(LEAD)]
    words = marked.groupBy("lang", "term").agg(F.max("n_lang").alias("n_lang"), *keys)
    ordered = written(words.orderBy("lang", *[f"c{i}" for i in range(LEAD)], "n_lang", "term").select("lang", "term", F.monotonically_increasing_id().alias("id")))
    piece = F.shiftright("id", 33).alias("piece")
    pieces = ordered.groupBy("lang", piece).agg(F.min("id").alias("first"), F.count("*").alias("n"))
    pieces = pieces.select(F.col("lang").alias("_l"), F.col("piece").alias("_p"), "first", _before("n", "piece").alias("before"), F.sum("n").over(W.partitionBy("lang")).alias("size"))
    joined = ordered.join(pieces, (F.col("lang") == F.col("_l")) & (F.shiftright("id", 33) == F.col("_p")))
    out = written(joined.select("lang", "term", (F.col("before") + F.col("id") - F.col("first")).alias("at"), "size"))
    dropped(ordered)
    return out


def share(n: Column, total: Column, size: Column) -> Column:
    """1 + floor(10^9 (n + 5) / (total + 5 size)), exactly."""
    whole = (n + SMOOTH).cast("decimal(20,0)") * F.lit(SCALE).cast("decimal(10,0)")
    return F.call_function("div", whole, (total + SMOOTH * size).cast("decimal(20,0)")) + 1


def run_lengths(columns: DataFrame) -> DataFrame:
    """(lang, source, block, runs array<struct<start, end, p>>) of columns (lang, source, at, n, p): stretches of neighbouring
    terms of one count other than 0, cut at the ends of blocks. One exchange; a task sorts blocks, not columns."""
    order = W.partitionBy("lang", "source", "block").orderBy("at")
    rows = columns.withColumn("block", F.floor(F.col("at") / BLOCK))
    goes_on = (F.lag("at").over(order) == F.col("at") - 1) & (F.lag("n").over(order) == F.col("n"))
    rows = rows.withColumn("new", F.when(F.coalesce(goes_on, F.lit(False)), 0).otherwise(1)).withColumn("run", F.sum("new").over(order))
    runs = rows.groupBy("lang", "source", "block", "run").agg(F.min("at").alias("start"), (F.max("at") + 1).alias("end"), F.first("p").alias("p"))
    return runs.groupBy("lang", "source", "block").agg(F.sort_array(F.collect_list(F.struct("start", "end", "p"))).alias("runs"))


def _column(start: int, end: int, base: int, runs: pa.StructScalar) -> tuple[np.ndarray, np.ndarray]:
    """Boundaries of a block's stretches, from start on, and the value of each; base where there is no run."""
    first, last, p = (runs.field(k).to_numpy(zero_copy_only=False) for k in range(3))
    edges = np.unique(np.concatenate([[start], first, last]))
    edges = edges[edges < end]
    value = np.full(len(edges), base, np.int64)
    value[np.searchsorted(edges, first)] = p
    return edges, value


def distance(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], end: int) -> int:
    """Sum of |p - q| over all terms of a block, from the intersected runs of two columns."""
    edges = np.union1d(a[0], b[0])
    if not len(edges):
        return 0
    p, q = (value[np.searchsorted(own, edges, "right") - 1] for own, value in (a, b))
    return int((np.abs(p - q) * np.diff(np.append(edges, end))).sum())


def _tile(rows: pa.Table) -> pa.Table:
    """All pairs of sources of one block and tile pair, each once: the lower numbered source first."""
    table = rows.combine_chunks()
    names, number, t, u = table["source"].to_pylist(), table["number"].to_pylist(), table["t"][0].as_py(), table["u"][0].as_py()
    runs = table["runs"].chunk(0) if table.num_rows else None
    start = table["block"][0].as_py() * BLOCK
    end = min(start + BLOCK, table["size"][0].as_py())
    columns = [_column(start, end, base, runs[k].values) for k, base in enumerate(table["base"].to_pylist())]
    left, right, value = [], [], []
    for i, a in enumerate(number):
        for j, b in enumerate(number):
            if a < b and a // TILE == t and b // TILE == u:
                left.append(names[i])
                right.append(names[j])
                value.append(distance(columns[i], columns[j], end))
    lang = pa.array([table["lang"][0].as_py()] * len(left), pa.string())
    return pa.table({"lang": lang, "a": pa.array(left, pa.string()), "b": pa.array(right, pa.string()), "value": pa.array(value, pa.int64())})


def pair_values(groups: DataFrame, runs: DataFrame) -> DataFrame:
    """(lang, source, item, value) for all pairs of sources of a language. groups: (lang, source, number from 0, of, size, base).

    Pairs are dealt out by block of terms and by two tiles of TILE sources, so a task holds 2 * TILE blocks however many
    terms or sources a language has."""
    blocks = F.sequence(F.lit(0).cast("long"), F.greatest(F.lit(0).cast("long"), F.floor((F.col("size") - 1) / BLOCK)))
    every = groups.withColumn("block", F.explode(blocks)).join(runs, ["lang", "source", "block"], "left")
    own = F.floor(F.col("number") / TILE)
    tiles = F.sequence(F.lit(0).cast("long"), F.floor((F.col("of") - 1) / TILE))
    dealt = every.select("lang", "source", "number", "size", "base", "block", F.coalesce("runs", F.array().cast("array<struct<start:bigint,end:bigint,p:bigint>>")).alias("runs"), own.alias("own"), F.explode(tiles).alias("other"))
    dealt = dealt.select("lang", "source", "number", "size", "base", "block", "runs", F.least("own", "other").alias("t"), F.greatest("own", "other").alias("u"))
    each = dealt.groupBy("lang", "block", "t", "u").applyInArrow(_tile, "lang string, a string, b string, value long")
    sums = each.groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item"))))
    return sums.select("lang", both.alias("x"), "value").select("lang", "x.source", "x.item", "value")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of docs (lang, source, text ...).

    Part `pair`: each other source of the language with the distance of the two groups; part `term`: the terms that the group
    uses more than its language, the `top` of them. Null text, lang and source are empty strings, so groups of null and ''
    are one. A group without terms has pairs, too, and in a language without kept terms all distances are 0. Ties rank by
    item. Repeated rows count each. Columns other than the three are ignored. An empty table gives no rows.
    """
    small_batches(docs.sparkSession)
    groups = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source")).distinct()
    kept = written(kept_counts(term_counts(docs), least_docs))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"), F.approx_count_distinct("n").alias("kinds"))
    totals = written(totals)  # a row a group
    leads = totals.select("lang", "source", (F.row_number().over(W.partitionBy("lang").orderBy("kinds", "source")) - 1).alias("lead")).where(F.col("lead") < LEAD)
    at = placed(kept, leads)
    of_lang = totals.groupBy("lang").agg(F.sum("total").alias("total_lang")).join(at.groupBy("lang").agg(F.max("size").alias("size")), "lang")
    facts = groups.join(totals.select("lang", "source", "total"), ["lang", "source"], "left").join(of_lang, "lang", "left")
    facts = facts.select("lang", "source", *[F.coalesce(c, F.lit(0).cast("long")).alias(c) for c in ("total", "total_lang", "size")])
    base = F.when(F.col("size") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("size"))).otherwise(F.lit(0).cast("long"))
    number = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1  # over a row a group
    facts = written(facts.withColumn("base", base).withColumn("number", number.cast("long")).withColumn("of", F.count("*").over(W.partitionBy("lang"))))
    rows = kept.join(at.select("lang", "term", "at"), ["lang", "term"]).join(facts.select("lang", "source", "total", "total_lang", "size"), ["lang", "source"])
    columns = written(rows.select("lang", "source", "term", "at", "n", share(F.col("n"), F.col("total"), F.col("size")).alias("p"), share(F.col("n_lang"), F.col("total_lang"), F.col("size")).alias("q")))
    for x in (kept, totals, at):
        dropped(x)
    pairs = pair_values(facts.drop("total", "total_lang"), run_lengths(columns))
    terms = columns.where("n > 0 and p > q").select("lang", "source", F.col("term").alias("item"), (F.col("p") - F.col("q")).alias("value"))
    rank = F.row_number().over(W.partitionBy("lang", "source").orderBy(F.desc("value"), "item"))
    pairs = pairs.withColumn("rank", rank).withColumn("part", F.lit("pair"))
    terms = terms.withColumn("rank", rank).where(F.col("rank") <= top).withColumn("part", F.lit("term"))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int").alias("rank"))


def op13_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(load(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT doc_id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term, count(*)::HUGEINT AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT doc_id) >= 30),
l AS (SELECT lang, count(*)::HUGEINT AS v, sum(n_lang)::HUGEINT AS total_lang FROM k GROUP BY lang),
c AS MATERIALIZED (SELECT g.lang, g.source, k.term, n_lang, v, total_lang, coalesce(x.n, 0)::HUGEINT AS n
      FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN (SELECT lang, source, term, count(*) AS n FROM w GROUP BY ALL) x ON x.lang = g.lang AND x.source = g.source AND x.term = k.term),
p AS MATERIALIZED (SELECT *, 1 + (1000000000::HUGEINT * (n + 5)) // (sum(n) OVER (PARTITION BY lang, source) + 5 * v)::HUGEINT AS p,
             1 + (1000000000::HUGEINT * (n_lang + 5)) // (total_lang + 5 * v) AS q FROM c),
a AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, sum(abs(a.p - b.p))::BIGINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
e AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
      LEFT JOIN a x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
u AS (SELECT * FROM e UNION ALL SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 50
"""
