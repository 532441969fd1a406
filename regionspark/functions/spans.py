"""Protected spans: A24-A30."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark.functions.dictionary import Dictionary

# What is protected, in order of precedence.
RULES = (
    ("url", re.compile(r"https?://[^\s]+|www\.[^\s]+|\b(?:[A-Za-z0-9-]+\.)+(?:com|net|org|cn|io|co|shop)\b(?:/[^\s]*)?", re.I)),
    ("sku", re.compile(r"\bSKU(?:[:#\s-]*)(?=[A-Z0-9._/-]*\d)[A-Z0-9][A-Z0-9._/-]*\b", re.I)),
    ("model", re.compile(r"\b(?=[A-Za-z0-9._/-]*[A-Za-z])(?=[A-Za-z0-9._/-]*\d)[A-Za-z0-9]+(?:[._/-][A-Za-z0-9]+)*\b")),
    ("number", re.compile(r"(?<![\w])\d+(?:[.,]\d+)*(?:%|[xX]\d+)?(?![\w])")),
)
#: Characters by which texts and brands meet.
GRAM = 8
PLACEHOLDER = r'<x id="\d+"/>'
SPAN = "start int, end int, text string, kind string, ord int"


_SPANS = f"array<struct<{','.join(x.replace(' ', ':') for x in SPAN.split(', '))}>>"


def find_spans(df: DataFrame, text: str, brands: list[str] | None = None, out: str = "candidates") -> DataFrame:
    """Df with `out`, an array of candidate spans (offsets in code points, kind, ord: rule order); every brand
    gives its own ones. brands are a parameter list (term_matches takes a table); whole texts that are a part of a brand (A26) count. Texts that cannot match (no digit, dot, www or
    brand) go to Python as nulls."""
    terms = sorted({b.strip() for b in brands or () if b.strip()}, key=lambda b: (-len(b), b))

    @F.pandas_udf(_SPANS)
    def spans(texts: pd.Series) -> pd.Series:
        rows, words = [], Dictionary(terms, "brand")
        for t in texts:
            found = [] if t is None else [{"start": m.start(), "end": m.end(), "text": m.group(), "kind": k, "ord": i} for i, (k, p) in enumerate(RULES) for m in p.finditer(t)]
            if t and terms:
                found += [{"start": a, "end": b, "text": t[a:b], "kind": "brand", "ord": len(RULES)} for a, b, _ in words.find(t)]
            rows.append(found)
        return pd.Series(rows)

    needs = F.col(text).rlike(r"(?i)[0-9]|\p{Nd}|www\.|\.(?:com|net|org|cn|io|co|shop)\b|https?://") if not terms else F.lit(True)
    none = F.array().cast(_SPANS)
    found = F.coalesce(spans(F.when(needs, F.col(text))), none)
    if not terms:
        return df.withColumn(out, found)
    own = _key(F.col(text))
    part = (F.length(own) >= _least(own)) & F.exists(F.array(*[_key(F.lit(b)) for b in terms]), lambda b: (F.length(b) > F.length(own)) & F.contains(b, own))
    whole = F.array(F.struct(F.lit(0).alias("start"), F.length(text).alias("end"), F.col(text).alias("text"), F.lit("brand").alias("kind"), F.lit(len(RULES)).alias("ord"))).cast(_SPANS)
    return df.withColumn(out, found).withColumn(out, F.concat(F.col(out), F.when(part, whole).otherwise(none)))


def resolve_spans(candidates: Column) -> Column:
    """By start, longer first, rule order; what overlaps an earlier choice is skipped."""
    order = F.array_sort(F.transform(candidates, lambda s: F.struct(s["start"].alias("start"), (s["start"] - s["end"]).alias("less"), s["ord"].alias("ord"), s["end"].alias("end"), s["text"].alias("text"), s["kind"].alias("kind"))))
    kind = "array<struct<start:int,end:int,text:string,kind:string>>"
    keep = lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end"), s["text"].alias("text"), s["kind"].alias("kind"))
    last = lambda acc: F.coalesce(F.get(acc, F.size(acc) - 1)["end"], F.lit(0))
    return F.aggregate(order, F.array().cast(kind), lambda acc, s: F.when((F.size(acc) == 0) | (s["start"] >= last(acc)), F.concat(acc, F.array(keep(s))).cast(kind)).otherwise(acc))


def placeholder(i: Column) -> Column:
    return F.concat(F.lit('<x id="'), i.cast("string"), F.lit('"/>'))


def mask_text(text: Column, spans: Column) -> Column:
    """The text with its spans as numbered placeholders."""
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(0).alias("i"))
    step = lambda s, p: F.struct(F.concat(s["out"], F.substring(text, s["at"] + 1, p["start"] - s["at"]), placeholder(s["i"])).alias("out"), p["end"].alias("at"), (s["i"] + 1).alias("i"))
    return F.aggregate(spans, start, step, lambda s: F.concat(s["out"], F.substring(text, s["at"] + 1, F.length(text))))


def fully_protected(masked: Column) -> Column:
    """No letter or digit outside placeholders; an empty text is protected too."""
    return ~F.regexp_replace(masked, PLACEHOLDER, "").rlike(r"[\p{L}\p{N}]")


def restore_text(translated: Column, spans: Column) -> Column:
    """Placeholders back to their texts; null (placeholder_damaged) unless each occurs exactly once."""
    n = lambda i: (F.length(translated) - F.length(F.replace(translated, placeholder(i), F.lit("")))) / F.length(placeholder(i))
    whole = F.forall(F.transform(spans, lambda s, i: n(i) == 1), lambda ok: ok)
    start = F.struct(translated.alias("t"), F.lit(0).alias("i"))
    step = lambda a, s: F.struct(F.replace(a["t"], placeholder(a["i"]), s["text"]).alias("t"), (a["i"] + 1).alias("i"))
    return F.when(whole, F.aggregate(spans, start, step, lambda a: a["t"]))


def _key(text: Column) -> Column:
    """Letters and digits, lower case, with ß as ss."""
    return F.replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}]", "")), F.lit("ß"), F.lit("ss"))


def _least(key: Column) -> Column:
    """Fewest characters of a part of a brand: three of ASCII, two with others."""
    return F.when(key.rlike(r"^[\x00-\x7F]*$"), 3).otherwise(2)


def brand_fragments(df: DataFrame, text: str, brands: DataFrame) -> DataFrame:
    """(text, brand) where the whole text is a proper part of a brand name, three ASCII characters or two others at
    least. Texts up to GRAM characters meet the brand parts of just their length; longer ones meet by their first GRAM
    characters and are then looked for in the brand, so a brand of n characters is GRAM * n keys at most."""
    keyed = brands.select("brand", _key(F.col("brand")).alias("_b"))
    cut = keyed.select("brand", "_b", F.explode(F.sequence(F.lit(2), F.lit(GRAM))).alias("_n")).where(F.length("_b") >= F.col("_n"))
    cut = cut.select("brand", "_b", F.explode(F.sequence(F.lit(1), F.length("_b") - F.col("_n") + 1)).alias("_i"), "_n").select("brand", "_b", F.expr("substring(_b, _i, _n)").alias("_p")).distinct()
    rows = df.withColumn("_k", _key(F.col(text)))
    rows = rows.where(F.length("_k") >= _least(F.col("_k"))).withColumn("_g", F.substring("_k", 1, GRAM))
    inside = (F.length("_k") < F.length("_b")) & ((F.length("_k") <= GRAM) | F.contains("_b", "_k"))
    return rows.join(cut, rows._g == F.col("_p")).where(inside).select(*df.columns, "brand")
