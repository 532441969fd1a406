"""Operator 10, quality classifier by co-training of a text view and a metadata view."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.llm.common import chunks, load, mix, text_bytes

#: Most labelled rows that the classifiers learn from and are calibrated on (lowest hashes of doc_id); bounds what is
#: broadcast. Everything else, pseudo-labels included, comes from all documents.
LABELLED = 20_000
#: Hash values of byte trigrams (text view) and of metadata fields.
TEXT, META = 1 << 16, 1 << 12
ROUNDS = 2
CONFIDENT = 0.95
#: Weight of a pseudo-labelled document beside a labelled one.
PSEUDO = 0.5
BINS = 64
#: By crc32(doc_id) mod 5: labels of fold 4 only calibrate, those of fold 3 are used for nothing but measuring.
FOLDS, CALIBRATION, HELD_OUT = 5, 4, 3


@dataclass
class View:
    """Naive Bayes over hashed features: log odds per feature, and the calibrated probability of each score bin."""

    odds: np.ndarray
    edges: np.ndarray = field(default_factory=lambda: np.zeros(0))
    chance: np.ndarray = field(default_factory=lambda: np.full(1, 0.5))

    def probability(self, score: np.ndarray) -> np.ndarray:
        return self.chance[np.searchsorted(self.edges, score, "right")]


def _log_odds(counts: np.ndarray) -> np.ndarray:
    """counts: (2, features), smoothed by 1."""
    share = (counts + 1) / (counts.sum(axis=1, keepdims=True) + counts.shape[1])
    return np.log(share[1]) - np.log(share[0])


def _isotonic(good: np.ndarray, total: np.ndarray) -> np.ndarray:
    """Non-decreasing probabilities per bin: neighbouring bins that break the order are pooled."""
    prior = (good.sum() + 1) / (total.sum() + 2)
    pools: list[list[float]] = []
    for g, n in zip(good, total):
        pools.append([g, n, 1])
        while len(pools) > 1 and pools[-2][0] * pools[-1][1] >= pools[-1][0] * pools[-2][1]:
            g2, n2, k2 = pools.pop()
            pools[-1] = [pools[-1][0] + g2, pools[-1][1] + n2, pools[-1][2] + k2]
    return np.concatenate([np.full(k, (g + prior) / (n + 1)) for g, n, k in pools])


def _meta_fields(docs: DataFrame) -> Column:
    """Metadata of a document as hashes: source, language, length, lines, length of a line (in powers of 1.5)."""
    n, lines = F.coalesce(F.length("text"), F.lit(0)), F.regexp_count(F.coalesce("text", F.lit("")), F.lit("\n")) + 1
    band = lambda x: F.floor(F.log(1.5, x + 1)).cast("string")
    fields = {c: F.coalesce(F.col(c).cast("string"), F.lit("")) if c in docs.columns else F.lit("") for c in ("source", "lang")}
    fields |= {"length": band(n), "lines": band(lines), "line": band(n / lines)}
    return F.array(*[F.xxhash64(F.lit(k), v) for k, v in fields.items()])


def _trigrams(texts: pa.Array):
    """For chunks of rows: first row, number of rows, hashed byte trigram of each place, its row."""
    data, offsets = text_bytes(texts)
    for i, j in chunks(offsets):
        part = data[offsets[i] : offsets[j]].astype(np.uint32)
        row = np.repeat(np.arange(j - i), np.diff(offsets[i : j + 1]))
        if len(part) < 3:
            yield i, j - i, np.zeros(0, np.int64), np.zeros(0, np.int64)
            continue
        same = row[2:] == row[:-2]
        code = (part[:-2] | part[1:-1] << np.uint32(8) | part[2:] << np.uint32(16)) * np.uint32(0x9E3779B1)
        yield i, j - i, (code >> np.uint32(16)).astype(np.int64)[same], row[2:][same]


def _scores(texts: pa.Array, meta: np.ndarray, views: list[View]) -> np.ndarray:
    """(2, rows): mean log odds of the text's trigrams, sum of the metadata's; 0 for an empty text."""
    out = np.zeros((2, len(meta)))
    for first, n, code, row in _trigrams(texts):
        total = np.bincount(row, views[0].odds[code], minlength=n)
        out[0, first : first + n] = total / np.maximum(np.bincount(row, minlength=n), 1)
    out[1] = views[1].odds[meta].sum(axis=1)
    return out


def _columns(batch) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    ids = batch.column(0).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False)
    meta = batch.column(2).flatten().to_numpy().view(np.uint64).reshape(len(ids), -1)
    return batch.column(1), (mix(meta) & np.uint64(META - 1)).astype(np.int64), ids


def _labels(ids: np.ndarray, known: tuple[np.ndarray, np.ndarray]) -> np.ndarray:
    """1, 0, or -1 where the id has no label among those known (sorted ids, labels)."""
    if not len(known[0]):
        return np.full(len(ids), -1)
    at = np.minimum(np.searchsorted(known[0], ids), len(known[0]) - 1)
    return np.where(known[0][at] == ids, known[1][at], -1)


def _count(shared):
    """Feature counts per view and class: of labelled rows, and of others by what the other view is sure of."""

    def run(batches):
        views, known, held = shared.value
        text, meta_counts = np.zeros((2, TEXT)), np.zeros((2, META))
        for batch in batches:
            texts, meta, ids = _columns(batch)
            label = _labels(ids, known)
            weight = np.zeros((2, 2, len(ids)))  # view, class, row
            for c in (0, 1):
                weight[:, c] = label == c
            if views:
                free = (label < 0) & (_labels(ids, held) < 0)
                chance = [v.probability(s) for v, s in zip(views, _scores(texts, meta, views))]
                for view, other in ((0, 1), (1, 0)):
                    weight[view, 1] += PSEUDO * (free & (chance[other] >= CONFIDENT))
                    weight[view, 0] += PSEUDO * (free & (chance[other] <= 1 - CONFIDENT))
            for c in (0, 1):
                for k in range(meta.shape[1]):
                    meta_counts[c] += np.bincount(meta[:, k], weight[1, c], minlength=META)
            for first, n, code, row in _trigrams(texts):
                for c in (0, 1):
                    w = weight[0, c, first : first + n]
                    if w.any():
                        text[c] += np.bincount(code, w[row], minlength=TEXT)
        for view, counts in enumerate((text, meta_counts)):
            for c in (0, 1):
                some = np.flatnonzero(counts[c])
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(some), view * 2 + c, np.int32)), pa.array(some.astype(np.int32)), pa.array(counts[c][some])], names=["part", "feature", "n"])

    return run


def _scored(shared):
    def run(batches):
        views, known, _ = shared.value
        for batch in batches:
            texts, meta, ids = _columns(batch)
            s = _scores(texts, meta, views)
            p = [v.probability(x) for v, x in zip(views, s)]
            label = _labels(ids, known)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(s[0]), pa.array(s[1]), pa.array(p[0]), pa.array(p[1]), pa.array(label.astype(np.int32))], names=["doc_id", "s_text", "s_meta", "p_text", "p_meta", "label"])

    return run


def train(docs: DataFrame, labels: DataFrame, rounds: int = ROUNDS, labelled: int = LABELLED) -> list[View]:
    """Views [text, metadata] for docs (doc_id, text, source, lang) and labels (doc_id, quality 0 or 1).

    Round 0 learns from labelled rows. In each later round every other document that one view is sure of, after
    calibration, teaches the other; documents of the calibration and held-out folds that have labels teach nothing. Each
    later round is one pass that returns counts of fixed-size tables; the first one and the calibrations read only labelled
    documents' texts; texts are never shuffled. Rows without doc_id or quality are not labels; of repeated ids the lowest
    quality counts.
    """
    spark = docs.sparkSession
    rows = docs.select("doc_id", "text", _meta_fields(docs).alias("meta"))
    named = labels.where("doc_id is not null and quality is not null").groupBy("doc_id").agg(F.min("quality").alias("quality"))
    total = named.count()
    share = F.xxhash64("doc_id").bitwiseAND(F.lit((1 << 53) - 1)) / F.lit(float(1 << 53))
    some = named.where(share * max(total, 1) < 1.1 * labelled + 50).orderBy(share, "doc_id").limit(labelled)
    some = some.withColumn("fold", F.crc32(F.col("doc_id").cast("string")) % FOLDS).toPandas().sort_values("doc_id")  # at most `labelled` rows
    pick = lambda keep: (some.doc_id.to_numpy(np.int64)[keep], (some.quality.to_numpy()[keep] > 0).astype(np.int64))
    fold = some.fold.to_numpy(np.int64)
    known, held, apart = pick((fold != CALIBRATION) & (fold != HELD_OUT)), pick(fold == CALIBRATION), pick((fold == CALIBRATION) | (fold == HELD_OUT))
    of = lambda ids: rows.join(F.broadcast(spark.createDataFrame([(int(x),) for x in ids[0]], "id long")), F.col("doc_id") == F.col("id"), "left_semi")  # at most `labelled` ids
    teachers, judges = of(known), of(held)
    views: list[View] = []
    for turn in range(rounds + 1):
        shared = spark.sparkContext.broadcast((views, known, apart))
        counts = (rows if views else teachers).mapInArrow(_count(shared), "part int, feature int, n double").groupBy("part", "feature").agg(F.sum("n").alias("n")).toPandas()  # 2 * (TEXT + META) rows at most
        tables = [np.zeros((2, TEXT)), np.zeros((2, META))]
        part, feature = counts.part.to_numpy(np.int64), counts.feature.to_numpy(np.int64)
        for view in (0, 1):
            mine = part // 2 == view
            tables[view][part[mine] % 2, feature[mine]] = counts.n.to_numpy()[mine]
        views = [View(_log_odds(t)) for t in tables]
        shared = spark.sparkContext.broadcast((views, held, known))
        check = judges.mapInArrow(_scored(shared), "doc_id long, s_text double, s_meta double, p_text double, p_meta double, label int").where("label >= 0").toPandas()  # held labels only
        for view, column in zip(views, ("s_text", "s_meta")):
            score = check[column].to_numpy()
            if len(score):
                view.edges = np.unique(np.quantile(score, np.linspace(0, 1, BINS + 1)[1:-1]))
                at = np.searchsorted(view.edges, score, "right")
                size = len(view.edges) + 1
                view.chance = _isotonic(np.bincount(at, check.label.to_numpy(), minlength=size), np.bincount(at, minlength=size).astype(float))
    return views


def score(docs: DataFrame, views: list[View]) -> DataFrame:
    """(doc_id, p_text, p_meta, score, good) for every document: each view's calibrated probability of good quality, their
    combination (mean log odds, the text view counting by its spread), and whether it is 0.5 or more. Null and empty
    texts are scored like any other; rows are independent; an empty table gives no rows."""
    shared = docs.sparkSession.sparkContext.broadcast((views, (np.zeros(0, np.int64), np.zeros(0, np.int64)), None))
    rows = docs.select("doc_id", "text", _meta_fields(docs).alias("meta")).mapInArrow(_scored(shared), "doc_id long, s_text double, s_meta double, p_text double, p_meta double, label int")
    spread = [float(np.std(np.log(v.chance) - np.log1p(-np.clip(v.chance, 0, 1 - 1e-9)))) for v in views]
    share = [s / sum(spread) for s in spread] if sum(spread) > 0 else [0.5, 0.5]
    logit = lambda c: F.log(F.col(c) / (1 - F.col(c)))
    both = 1 / (1 + F.exp(-(share[0] * logit("p_text") + share[1] * logit("p_meta"))))
    return rows.select("doc_id", "p_text", "p_meta", both.alias("score")).withColumn("good", F.col("score") >= 0.5)


def op10_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return score(docs, train(docs, load(spark, sf_dir, "labels")))
