"""Evaluation of recognition, repair and layout runs (G4-G13, J13) and pixel statistics."""

from __future__ import annotations

import hashlib
import json

import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from regionspark.functions import geometry as g
from regionspark.functions.edit_distance import edit_distance
from regionspark.functions.text import boundaries_are_graphemes
from regionspark.plans import boxes
from regionspark.session import written


def score_pairs(expected: DataFrame, predicted: DataFrame) -> DataFrame:
    """J13 on (sample_id, seq, polygon): overlapping expected and predicted regions of a sample with their IoU. Pairs are
    found in cells that are cut where regions are dense, so neither a long nor a crowded sample pairs all its regions."""
    side = lambda df: df.select("sample_id", F.col("seq").cast("long").alias("seq"), g.bbox(F.col("polygon")).alias("box"))
    pairs = boxes.overlapping(side(expected), side(predicted), ["sample_id"], ("seq", "seq"))
    types = [df.schema["seq"].dataType for df in (expected, predicted)]
    out = pairs.select("sample_id", F.col("left").cast(types[0]).alias("seq_e"), F.col("right").cast(types[1]).alias("seq_p"), g.bbox_iou(F.col("left_box"), F.col("right_box")).alias("iou"))
    # written, or Spark moves each filter on IoU, as a copy of its formula, into the join: a method too long for the JVM to compile
    out = written(out)
    return out.where("iou > 0")


def match_greedily(pairs: DataFrame, threshold: float = 0.5) -> DataFrame:
    """G5 on (sample_id, seq_e, seq_p, iou): expected regions in order take the best unused prediction (ties: the higher
    index) of IoU threshold or more. Pairs are walked in that order; of a sample only the predictions in use are kept, so
    a sample of very many regions takes time in proportion."""
    rows = pairs.where(F.col("iou") >= threshold).select("sample_id", F.col("seq_e").cast("bigint").alias("seq_e"), F.col("seq_p").cast("bigint").alias("seq_p"), "iou")
    out = T.StructType(rows.schema.fields[:3])

    def run(batches):
        sample, used, last = None, set(), None
        for batch in batches:
            keep = []
            for own, e, p in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if own != sample:
                    sample, used, last = own, set(), None
                free = e != last and p not in used
                if free:
                    used.add(p)
                    last = e
                keep.append(free)
            yield batch.filter(pa.array(keep, pa.bool_())).select([0, 1, 2])

    return rows.repartition("sample_id").sortWithinPartitions("sample_id", "seq_e", F.desc("iou"), F.desc("seq_p")).mapInArrow(run, out)


def character_errors(expected: Column, found: Column, ends: bool = False) -> Column:
    """Edit distance; an unmatched text costs its length, one at least. Equal texts do not leave the JVM; with `ends`, nor do
    texts of which one begins or ends the other: they differ by what the longer one has more. That works `found` out several
    times, so it is for cheap expressions."""
    same, more = expected == found, F.lit(0)
    if ends:
        same = found.startswith(expected) | found.endswith(expected) | expected.startswith(found) | expected.endswith(found)
        more = F.abs(F.length(found) - F.length(expected))
    distance = F.when(same, more).otherwise(edit_distance(F.when(~same, expected), F.when(~same, found) if ends else found))
    return F.when(found.isNull(), F.greatest(F.lit(1), F.length(expected))).otherwise(distance)


def recognition_metrics(samples: DataFrame, least_recall: float = 0.9, least_accuracy: float = 0.9) -> DataFrame:
    """G4 on (language, sample_id, n_expected, n_matched, n_chars, n_errors, elapsed_ms, rss, failed): per language."""
    each = samples.groupBy("language").agg(
        F.count("*").alias("samples"), F.sum("n_expected").alias("expected"), F.sum("n_matched").alias("matched"), F.sum("n_chars").alias("characters"), F.sum("n_errors").alias("errors"),
        F.avg("elapsed_ms").alias("mean_elapsed_ms"), F.max("rss").alias("max_rss"), F.count_if("failed").alias("n_failed"),
    )
    each = each.withColumn("recall", F.try_divide("matched", "expected")).withColumn("accuracy", F.greatest(F.lit(0.0), 1 - F.try_divide("errors", "characters")))
    good = (F.col("recall") >= least_recall) & (F.col("accuracy") >= least_accuracy)
    return each.withColumn("verdict", F.when(F.col("recall").isNull() | F.col("accuracy").isNull(), "not_evaluated").when(good, "passed").otherwise("failed"))


def failed_samples(samples: DataFrame) -> DataFrame:
    """(language, sample_id) of failed samples, as rows, as there may be many."""
    return samples.where("failed").select("language", "sample_id").distinct()


def repair_summary(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Count, mean, median, 95th percentile (linear), maximum and sum."""
    return runs.groupBy(*keys).agg(F.count("*").alias("n"), F.avg(value).alias("mean"), F.median(value).alias("median"), F.percentile(value, F.lit(0.95)).alias("p95"), F.max(value).alias("max"), F.sum(value).alias("sum"))


#: Size of a quantile sketch, and the share of its rows by which a rank may be off (99 of 100 times; far more than it is as a rule).
SKETCH, RANK_ERROR = 1000, 0.01


def repair_sketches(runs: DataFrame, keys: list[str], value: str) -> DataFrame:
    """G7 in a form that can be stored and merged: (keys, n, total, max, sketch), the sketch (KLL) a few kilobytes however
    many values there are; combined before the shuffle. Null values are left out, as in repair_summary's measures."""
    v = F.col(value).cast("double")
    return runs.where(v.isNotNull()).groupBy(*keys).agg(F.count("*").alias("n"), F.sum(v).alias("total"), F.max(v).alias("max"), F.kll_sketch_agg_double(v, SKETCH).alias("sketch"))


def sketched_summary(sketches: DataFrame, keys: list[str]) -> DataFrame:
    """G7 from stored sketches of any finer keys: (keys, n, mean, median, p95, max, sum). median and p95 are values of the data
    whose rank is within RANK_ERROR of the one asked for; repair_summary gives the exact ones, which hold all distinct values
    of a group in one task."""
    each = sketches.groupBy(*keys).agg(F.sum("n").alias("n"), F.sum("total").alias("sum"), F.max("max").alias("max"), F.kll_merge_agg_double("sketch").alias("_s"))
    at = lambda rank: F.kll_sketch_get_quantile_double("_s", F.lit(rank))
    return each.select(*keys, "n", (F.col("sum") / F.col("n")).alias("mean"), at(0.5).alias("median"), at(0.95).alias("p95"), "max", "sum")


def risk_flags(ssim: Column, mae: Column, gmsd: Column) -> Column:
    """G8."""
    return F.array_compact(F.array(F.when(ssim < 0.95, "low_ssim"), F.when(mae > 10, "high_mae"), F.when(gmsd > 0.2, "high_gmsd")))


def layout_violations(layouts: DataFrame) -> DataFrame:
    """G9 on (case_id, text, width, lines array<struct<text_start,text_end,direction,clusters array<struct<text_start,text_end,
    glyph_ids array<int>>>>>, ink_bounds array<double>): names of the broken rules per layout."""
    lines, n = F.col("lines"), F.length("text")
    clusters = F.flatten(F.transform(lines, lambda x: x["clusters"]))
    ranged = F.forall(clusters, lambda c: (c["text_start"] >= 0) & (c["text_start"] < c["text_end"]) & (c["text_end"] <= n))
    bounds = F.flatten(F.transform(lines, lambda x: F.array(x["text_start"], x["text_end"])))
    ink = F.col("ink_bounds")  # left, top, width, height
    bad = [(F.exists(clusters, lambda c: F.array_contains(c["glyph_ids"], 0)), "missing_glyph"), (~boundaries_are_graphemes(F.col("text"), bounds), "splits_grapheme"), (~ranged, "range"), ((ink[0] < -1) | (ink[0] + ink[2] > F.col("width") + 1), "outside")]
    return layouts.select("case_id", F.array_compact(F.array(*[F.when(b, name) for b, name in bad])).alias("violations"))


def comparison_report(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """One row: cases of each side, common cases, missing pairs, matches of each field and, where both sides carry
    `violations` (G9), how many layouts of common cases break a rule."""
    from regionspark.operators.routing import compare_backends

    both = compare_backends(left, right, key, fields).agg(F.count("*").alias("common"), *[F.count_if(F.col(f"{f}_match")).alias(f"{f}_matches") for f in fields])
    a, b = left.agg(F.countDistinct(key).alias("n_left")), right.agg(F.countDistinct(key).alias("n_right"))
    out = both.join(F.broadcast(a)).join(F.broadcast(b)).withColumn("missing_pairs", F.greatest("n_left", "n_right") - F.col("common"))  # one row each
    if "violations" not in left.columns or "violations" not in right.columns:
        return out
    side = lambda df, other: df.join(other.select(key).distinct(), key, "left_semi").select((F.size("violations") > 0).alias("bad"))
    broken = side(left, right).union(side(right, left)).agg(F.count_if("bad").alias("structural_violations"))
    return out.join(F.broadcast(broken))


def evidence_gate(runs: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """Named boolean aggregates over a run as rows (check, ok) and an overall row."""
    row = runs.agg(*[c.alias(n) for n, c in checks.items()])
    every = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("ok")) for n in checks], F.struct(F.lit("passed").alias("check"), F.array_min(F.array(*[F.coalesce(F.col(n), F.lit(False)) for n in checks])).alias("ok")))
    return row.select(F.explode(every).alias("r")).select("r.*")


def layout_signature(layouts: DataFrame, group: str, fields: list[str]) -> DataFrame:
    """Per group a SHA-256 that does not depend on the order of rows: hashes of the rows' JSON, summed in eight 32-bit
    words and hashed again, so no group's payloads or hashes are gathered."""
    digest = F.sha2(F.to_json(F.struct(*fields)), 256)
    words = [F.sum(F.conv(F.substring("_d", 8 * i + 1, 8), 16, 10).cast("decimal(20,0)")).alias(f"w{i}") for i in range(8)]
    return layouts.select(group, digest.alias("_d")).groupBy(group).agg(F.count("*").alias("n"), *words).select(group, "n", F.sha2(F.concat_ws("|", F.col("n").cast("string"), *[F.col(f"w{i}").cast("string") for i in range(8)]), 256).alias("signature"))


def canonical_signature(layouts: DataFrame, backends: tuple[str, ...], order: str = "path") -> DataFrame:
    """G12 as a whole document has it: one row (n, signature), the SHA-256 of the canonical JSON of all layouts (backend, case_id,
    lines array<struct<text_start,text_end,direction,clusters array<struct<text_start,text_end>>>>, `order`): backends and
    cases by name, of a repeated case the last one by `order`, backends without a case as empty objects.

    The digest is sequential by its nature. The rows are sorted, made JSON and joined to pieces of PIECE characters in all tasks and
    written in their order; one task reads the pieces, file after file, and holds one batch of them and 32 bytes."""
    pair = lambda x: F.array(x["text_start"], x["text_end"])
    lines = F.transform("lines", lambda x: F.struct(F.transform(x["clusters"], pair).alias("clusters"), x["direction"].alias("direction"), pair(x).alias("range")))
    last = layouts.where(F.col("backend").isin(*backends)).groupBy("backend", "case_id").agg(F.max_by("lines", order).alias("lines"))
    rows = last.select("backend", F.col("case_id").cast("string").alias("case_id"), F.to_json(F.struct(lines.alias("lines"))).alias("json"))
    names = sorted(backends)

    def joined(batches):
        own, held, size = None, [], 0

        def piece() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict({"backend": [own], "n": [len(held)], "text": [",".join(held)]})

        for batch in batches:
            for backend, case, text in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if held and (backend != own or size >= PIECE):
                    yield piece()
                    held, size = [], 0
                own = backend
                held.append(json.dumps(case, ensure_ascii=False) + ":" + text)
                size += len(held[-1])
        if held:
            yield piece()

    pieces = written(rows.orderBy("backend", "case_id").mapInArrow(joined, "backend string, n long, text string"))

    def run(batches):
        for _ in batches:
            pass
        digest, at, n, own = hashlib.sha256(b"{"), -1, 0, None

        def opened(to: int) -> None:
            nonlocal at
            while at < to:
                at += 1
                digest.update((("}," if at else "") + json.dumps(names[at], ensure_ascii=False) + ":{").encode())

        for backend, count, text in _in_order(pieces_at):
            opened(names.index(backend))
            digest.update((("," if backend == own else "") + text).encode())
            own, n = backend, n + count
        opened(len(names) - 1)
        digest.update(b"}}" if names else b"}")
        yield pa.RecordBatch.from_pydict({"n": [n], "signature": [digest.hexdigest()]})

    pieces_at = pieces._scratch
    return layouts.sparkSession.range(0, 1, 1, 1).mapInArrow(run, "n long, signature string")


#: Characters of a piece of the canonical JSON, and how many pieces are read at a time.
PIECE, PIECES = 1 << 20, 8


def _in_order(folder: str):
    """(backend, n, text) of the pieces in a folder that Spark wrote in order: part after part, row after row."""
    system, path = fs.FileSystem.from_uri(folder)
    files = system.get_file_info(fs.FileSelector(path))
    for f in sorted(x.path for x in files if x.base_name.startswith("part-")):
        with system.open_input_file(f) as source:
            for batch in pq.ParquetFile(source).iter_batches(PIECES, columns=["backend", "n", "text"]):
                yield from zip(*(batch.column(i).to_pylist() for i in range(3)))


def versions_agree(sources: DataFrame, version: str, pattern: str) -> DataFrame:
    """One row: whether all sources carry one version of the right form."""
    return sources.agg(F.coalesce((F.min(version) == F.max(version)) & F.bool_and(F.col(version).isNotNull() & F.col(version).rlike(pattern)), F.lit(False)).alias("agree"), F.count("*").alias("n"))


# --- pixels: (region, x, y, r, g, b, zone ...) ------------------------------------------------------------------------

RGB = ("r", "g", "b")


def background(pixels: DataFrame, key: str = "region_id") -> DataFrame:
    """Median colour, chroma (spread of the medians) and texture (mean population deviation)."""
    out = pixels.groupBy(key).agg(*[F.median(c).alias(c) for c in RGB], *[F.stddev_pop(c).alias(f"_s{c}") for c in RGB])
    return out.select(key, *RGB, (F.greatest(*RGB) - F.least(*RGB)).alias("chroma"), ((F.col("_sr") + F.col("_sg") + F.col("_sb")) / 3).alias("texture"))


def _distance(a: list[Column], b: list[Column]) -> Column:
    return F.sqrt(sum(((x - y) * (x - y) for x, y in zip(a[1:], b[1:])), (a[0] - b[0]) * (a[0] - b[0])))


def foreground(pixels: DataFrame, key: str = "region_id") -> DataFrame:
    """The tail of luminance (7.5 % darkest or lightest) whose median colour is farther from the border's; nearer than
    32 it is black or white by contrast. Two passes; pixels carry `border` boolean."""
    lum = F.col("r") * 0.2126 + F.col("g") * 0.7152 + F.col("b") * 0.0722
    rows = pixels.withColumn("_l", lum)
    cut = rows.groupBy(key).agg(F.percentile("_l", F.lit(0.075)).alias("_lo"), F.percentile("_l", F.lit(0.925)).alias("_hi"))
    rows = rows.join(cut, key)
    tail = lambda cond, n: [F.median(F.when(cond, F.col(c))).alias(f"{n}{c}") for c in RGB]
    out = rows.groupBy(key).agg(*tail(F.col("_l") <= F.col("_lo"), "d"), *tail(F.col("_l") >= F.col("_hi"), "w"), *tail(F.col("border"), "e"))
    cols = lambda n: [F.col(f"{n}{c}") for c in RGB]
    dark, light = _distance(cols("d"), cols("e")), _distance(cols("w"), cols("e"))
    edge = F.array(*cols("e"))
    black, white = F.array(*[F.lit(0.0)] * 3), F.array(*[F.lit(255.0)] * 3)
    plain = F.when(g.contrast_ratio(black, edge) >= g.contrast_ratio(white, edge), black).otherwise(white)
    color = F.when(F.greatest(dark, light) < 32, plain).when(dark >= light, F.array(*cols("d"))).otherwise(F.array(*cols("w")))
    return out.select(key, color.alias("color"))


def image_errors(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """G19 on pixels (image_id, x, y, r, g, b, a, masked) against (image_id, x, y, r, g, b, a)."""
    other = b.select(*keys, *[F.col(c).alias(f"_{c}") for c in (*RGB, "a")])
    delta = [F.abs(F.col(c) - F.col(f"_{c}")) for c in RGB]
    rows = a.join(other, keys).withColumn("_sq", sum((d * d for d in delta[1:]), delta[0] * delta[0]) / 3).withColumn("_abs", sum(delta[1:], delta[0]) / 3).withColumn("_most", F.greatest(*delta))
    out = rows.groupBy("image_id").agg(F.avg("_sq").alias("mse"), F.avg(F.when(F.col("masked"), F.col("_abs"))).alias("masked_mae"), F.count_if(~F.col("masked") & (F.col("_most") > 0)).alias("outside_changed_pixels"),
        F.coalesce(F.max(F.when(~F.col("masked"), F.col("_most"))), F.lit(0)).alias("outside_max_delta"), F.bool_and(F.col("a") == F.col("_a")).alias("alpha_preserved"))
    return out.withColumn("psnr_db", F.when(F.col("mse") == 0, 100.0).otherwise(10 * F.log10(F.lit(65025.0) / F.col("mse"))))


def smooth_background(pixels: DataFrame, key: str = "region_id", spread: float = 18, far: float = 60, least: int = 32) -> DataFrame:
    """G20 on pixels with ring and mask booleans: replace is true where the ring is large and even (90 % within `spread` of
    its median colour) and the repair is far from it (85th percentile over `far`)."""
    ring = pixels.where("ring").groupBy(key).agg(*[F.median(c).alias(f"_{c}") for c in RGB], F.count("*").alias("n_ring"))
    rows = pixels.join(ring, key).withColumn("_d", _distance([F.col(c) for c in RGB], [F.col(f"_{c}") for c in RGB]))
    out = rows.groupBy(key).agg(F.first("n_ring").alias("n_ring"), F.percentile(F.when(F.col("ring"), F.col("_d")), F.lit(0.9)).alias("ring_p90"), F.percentile(F.when(F.col("mask"), F.col("_d")), F.lit(0.85)).alias("repair_p85"))
    return out.withColumn("replace", F.coalesce((F.col("n_ring") >= least) & (F.col("ring_p90") <= spread) & (F.col("repair_p85") > far), F.lit(False)))
