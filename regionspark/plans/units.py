"""Translation units: P1 (classification), P2 (batched external calls), P3 (retry), P5 (manual regions)."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window as W
from pyspark.sql import functions as F

from regionspark.functions import geometry as g
from regionspark.functions import spans as s
from regionspark.functions.text import script_language, strip
from regionspark.session import written

MAX_ITEMS, MAX_CHARS, MAX_ITEM = 100, 20_000, 5_000
#: Items that one task packs into batches.
ITEMS_PER_BUCKET = 10_000


def prepare(regions: DataFrame, brands: list[str] | None = None) -> DataFrame:
    """Regions (…, text) with spans and masked text."""
    rows = s.find_spans(regions, "text", brands).withColumn("spans", s.resolve_spans(F.col("candidates"))).drop("candidates")
    return rows.withColumn("masked", s.mask_text(F.col("text"), F.col("spans")))


def unit_status(language: Column, masked: Column, called: Column, error: Column, detected: Column, restored: Column, target: str, source: str | None, detects: bool) -> Column:
    """P1's precedence as one expression. source is the language filter, if there is one; detects: the provider reports
    languages, so the filter waits for its answer; called: whether the provider answered for the text; detected: the
    language that it reports, or else the region's."""
    out = F.when(s.fully_protected(masked), "skipped_protected").when(~called | error.isNotNull(), "failed")
    out = out.when(~detected.eqNullSafe(F.lit(source)) if source else detected.eqNullSafe(F.lit(target)), "skipped_language")
    out = out.when(restored.isNull(), "failed").otherwise("translated")
    return F.when(~language.eqNullSafe(F.lit(source)), "skipped_language").otherwise(out) if source and not detects else out


def classify_units(regions: DataFrame, provider_items: DataFrame, keys: list[str], target: str, source: str | None = None, detects: bool = False, brands: list[str] | None = None) -> DataFrame:
    """Regions (keys, text, language_code) and provider items (keys, translated_text, source_language, error_code) to
    units (keys, source_text, language_code, translated_text, status, error_code); texts that are not translated stay as
    they were, a null translation is an empty one, and language_code is the detected one once the provider has answered."""
    items = provider_items.select(*keys, "translated_text", "source_language", "error_code", F.lit(True).alias("_called"))
    rows = prepare(regions, brands).join(items, keys, "left")
    called = F.coalesce("_called", F.lit(False))
    detected = F.coalesce("source_language", "language_code")
    rows = rows.withColumn("_restored", s.restore_text(F.coalesce("translated_text", F.lit("")), F.col("spans")))
    rows = rows.withColumn("status", unit_status(F.col("language_code"), F.col("masked"), called, F.col("error_code"), detected, F.col("_restored"), target, source, detects))
    early = (F.col("status") == "skipped_protected") | ((F.col("status") == "skipped_language") & ~F.col("language_code").eqNullSafe(F.lit(source)) if source and not detects else F.lit(False))
    code = F.when(F.col("status") == "failed", F.when(~called, "missing_item").otherwise(F.coalesce("error_code", F.lit("placeholder_damaged"))))
    return rows.select(*keys, F.col("text").alias("source_text"), F.when(early, F.col("language_code")).otherwise(detected).alias("language_code"),
        F.when(F.col("status") == "translated", F.col("_restored")).otherwise(F.col("text")).alias("translated_text"), "status", code.alias("error_code"))


def batch_keys(items: DataFrame, order: list[str], buckets: int | None = None, by: list[str] | None = None) -> DataFrame:
    """P2 packing: batch_key per item (text) so that a batch has at most 100 items and 20 000 characters: inside a hash
    bucket by running characters in steps of 15 000 (an item adds 5 000 at most), then by hundreds. Buckets hold about
    ITEMS_PER_BUCKET items however many there are, unless their number is given. Items that differ in `by` share no batch."""
    buckets = buckets or -(-max(items.count(), 1) // ITEMS_PER_BUCKET)
    by = by or []
    bucket = F.pmod(F.xxhash64(*order), F.lit(buckets)).cast("int")
    before = F.coalesce(F.sum(F.length("text")).over(W.partitionBy("_b", *by).orderBy(*order).rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    rows = items.withColumn("_b", bucket).withColumn("_c", F.floor(before / 15_000))
    rank = F.row_number().over(W.partitionBy("_b", *by, "_c").orderBy(*order)) - 1
    return rows.withColumn("batch_key", F.concat_ws("-", "_b", *by, "_c", F.floor(rank / MAX_ITEMS))).drop("_b", "_c")


def translate_batches(items: DataFrame, client: Callable[..., list[str]], order: list[str], by: list[str] | None = None) -> DataFrame:
    """P2 on items (order columns, text): client translates the texts of one batch; an exception or a wrong count fails the
    batch's items, texts over 5 000 characters fail beforehand. Adds translated_text and error_code. Run it after the
    filters that spare calls: Catalyst pushes nothing through it. With `by` a batch has one value of these columns, which
    the client gets after the texts."""
    by = by or []
    small = batch_keys(items.where(F.length("text") <= MAX_ITEM), order, by=by)
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema) + ", translated_text string, error_code string"

    def call(pdf: pd.DataFrame) -> pd.DataFrame:
        texts = pdf["text"].tolist()
        try:
            out = list(client(texts, *[pdf[c].iloc[0] for c in by]))
            error = None if len(out) == len(texts) else "invalid_response"
        except Exception as e:  # a provider's failure is data here
            error = getattr(e, "code", "provider_failed")
        done = [None] * len(texts) if error else out
        return pdf.drop(columns=["batch_key"]).assign(translated_text=pd.Series(done, index=pdf.index, dtype=object), error_code=error)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for pdf in batches:  # rows come sorted by batch, so only the last batch of an Arrow batch may go on
            pdf = pdf if held is None else pd.concat([held, pdf])
            groups = [x for _, x in pdf.groupby("batch_key", sort=False)]
            for x in groups[:-1]:
                yield call(x)
            held = groups[-1] if groups else None
        if held is not None:
            yield call(held)

    called = small.repartition("batch_key").sortWithinPartitions("batch_key", *order).mapInPandas(run, schema)
    long = items.where(F.length("text") > MAX_ITEM).select(*items.columns, F.lit(None).cast("string").alias("translated_text"), F.lit("item_too_long").alias("error_code"))
    return called.unionByName(long)


def retry_script_mismatches(units: DataFrame, client: Callable[[list[str], str], list[str]], keys: list[str], target: str) -> DataFrame:
    """Units (keys, text, detected, translated_text, error_code) that the provider took for the target language though
    their script says otherwise go through once more with the script's language as source; one pass, never a loop. The others
    stay where they are; no unit is joined."""
    other = F.when(F.col("detected") == target, script_language(F.col("text"), F.col("detected")))
    rows = units.select(*keys, "text", "detected", "translated_text", "error_code", other.alias("_o")).withColumn("_d", F.when(F.col("_o") != target, F.col("_o"))).drop("_o")
    rows = written(rows)  # the scripts are looked for once; counting, packing and the others read the result
    again = translate_batches(rows.where("_d is not null").select(*keys, "text", F.col("_d").alias("detected")), client, keys, by=["detected"])
    return rows.where("_d is null").drop("_d").unionByName(again)


def manual_regions(specs: DataFrame) -> DataFrame:
    """P5 on specs (spec_id, mode auto|source_text|translated_text, box, width, height, source_text, translated_text,
    recognised_text, unit_status, unit_text): the displayed source, the text and a code: box_outside, manual_ocr_empty,
    manual_translation_skipped or null."""
    source = strip(F.when(F.col("mode") == "auto", F.col("recognised_text")).otherwise(F.col("source_text")))
    source = F.coalesce(source, F.lit(""))
    direct = F.col("mode") == "translated_text"
    code = F.when(~g.box_inside(F.col("box"), F.col("width"), F.col("height")), "box_outside").when((F.col("mode") == "auto") & (source == ""), "manual_ocr_empty").when(~direct & (F.coalesce("unit_status", F.lit("")) != "translated"), "manual_translation_skipped")
    shown = F.when(source == "", strip(F.col("translated_text"))).otherwise(source)
    text = F.when(direct, strip(F.col("translated_text"))).otherwise(F.col("unit_text"))
    return specs.withColumn("code", code).select("spec_id", shown.alias("displayed_source"), F.when(F.col("code").isNull(), text).alias("text"), "code")


def manual_units(specs: DataFrame, provider_items: DataFrame, target: str, source: str | None = None, detects: bool = False, brands: list[str] | None = None) -> DataFrame:
    """P5 with its P1: specs (as in manual_regions, without the unit's columns, but with ocr_language and
    recognised_language) and provider items by spec_id. What is shown goes through P1 as a region of its own, in the language of the
    filter or else of the recognition (auto: the one it found); specs that give their translation are left out of it."""
    typed = strip(F.col("source_text"))
    text = F.coalesce(F.when(F.col("mode") == "auto", strip(F.col("recognised_text"))).otherwise(F.when(typed != "", typed).otherwise(strip(F.col("translated_text")))), F.lit(""))
    language = F.when(F.col("mode") == "auto", F.col("recognised_language")).otherwise(F.coalesce(F.lit(source), F.col("ocr_language")))
    regions = specs.where("mode <> 'translated_text'").select("spec_id", text.alias("text"), language.alias("language_code")).where("text <> ''")
    units = classify_units(regions, provider_items, ["spec_id"], target, source, detects, brands).select("spec_id", F.col("status").alias("unit_status"), F.col("translated_text").alias("unit_text"))
    return manual_regions(specs.drop("unit_status", "unit_text").join(units, "spec_id", "left"))
