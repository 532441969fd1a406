"""Text expressions: normalisation, scripts, graphemes, glossary, code mapping."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from regionspark import dims

#: White space of the reference's splitting, as a character class (Java's \s lacks most of it). Fixed value.
BLANK = "[\\x{09}-\\x{0D}\\x{1C}-\\x{20}\\x{85}\\x{A0}\\x{1680}\\x{2000}-\\x{200A}\\x{2028}\\x{2029}\\x{202F}\\x{205F}\\x{3000}]"
# Code point ranges of scripts.
HANGUL, THAI, DEVANAGARI, BENGALI, CYRILLIC, ARABIC = "가-\\x{D7AF}", "\\x{0E00}-\\x{0E7F}", "\\x{0900}-\\x{097F}", "\\x{0980}-\\x{09FF}", "\\x{0400}-\\x{052F}", "\\x{0600}-\\x{06FF}"
HAN, KANA = "\\x{3400}-\\x{9FFF}\\x{F900}-\\x{FAFF}", "\\x{3040}-\\x{30FF}"
HAN_BASIC = "\\x{4E00}-\\x{9FFF}"
SCRIPTS = ((HANGUL, "ko"), (THAI, "th"), (DEVANAGARI, "hi"), (BENGALI, "bn"), (CYRILLIC, "ru"))
FIRST = ((ARABIC, "ar"), (DEVANAGARI, "hi"), (THAI, "th"), (KANA, "ja"), (HANGUL, "ko"), (HAN_BASIC, "zh-Hans"))


def _nfc(text: Column) -> Column:
    @F.pandas_udf("string")
    def nfc(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: unicodedata.normalize("NFC", t), na_action="ignore")

    return nfc(text)


def strip(text: Column) -> Column:
    """The text without white space of any kind at its ends."""
    return F.regexp_replace(text, f"^{BLANK}+|{BLANK}+\\z", "")


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, BLANK + "+", " "))


def normalize_text(text: Column) -> Column:
    """A1: NFC, white space runs as one space, trimmed. Texts of ASCII alone go to Python as nulls."""
    return collapse(F.coalesce(_nfc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text))


def script_language(text: Column, fallback: Column) -> Column:
    """A2: language of the first script, in fixed precedence, of which the text has a character; null if none."""
    out = None
    for cls, code in SCRIPTS:
        out = F.when(text.rlike(f"[{cls}]"), code) if out is None else out.when(text.rlike(f"[{cls}]"), code)
    keep = lambda codes, code: F.when(fallback.isin(*codes), fallback).otherwise(code)
    return out.when(text.rlike(f"[{ARABIC}]"), keep(("ar", "fa", "ur"), "ar")).when(text.rlike(f"[{HAN}]"), keep(("zh-Hans", "zh-Hant", "ja"), "zh-Hans"))


def first_script_language(text: Column) -> Column:
    """A3: language of the first character of any known script; en if there is none."""
    first = F.regexp_extract(text, "[" + "".join(c for c, _ in FIRST) + "]", 0)
    out = None
    for cls, code in FIRST:
        out = F.when(first.rlike(f"[{cls}]"), code) if out is None else out.when(first.rlike(f"[{cls}]"), code)
    return out.otherwise("en")


def contains_cjk(text: Column) -> Column:
    """A4."""
    return text.rlike(f"[{HAN}]")


def requires_char_wrap(text: Column) -> Column:
    """A4: no white space and a Han, Kana or Hangul character."""
    return ~text.rlike(BLANK) & text.rlike(f"[{HAN}{KANA}{HANGUL}]")


#: A run of printable ASCII, up to where the next character may join its last one, or one grapheme: \X once for each character
#: costs far more. Of graphemes of several characters only a carriage return with a line feed is ASCII.
_PIECE = r"[ -~]+(?=[ -~]|\z)|\X"


def _pieces(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(_PIECE), 0)


def _plain(piece: Column) -> Column:
    return (F.length(piece) == F.octet_length(piece)) & (piece != "\r\n")


def graphemes(text: Column) -> Column:
    """A5: extended grapheme clusters."""
    return F.flatten(F.transform(_pieces(text), lambda p: F.when(_plain(p), F.split(p, "")).otherwise(F.array(p))))


def grapheme_marks(text: Column) -> Column:
    """A5: for each code point '1' if a grapheme ends after it, else '0'. One scan of the text, in time of its length; flags
    pair their regional indicators from the first of a run on."""
    marks = F.transform(_pieces(text), lambda g: F.when(_plain(g), F.repeat(F.lit("1"), F.length(g))).otherwise(F.concat(F.repeat(F.lit("0"), F.length(g) - 1), F.lit("1"))))
    return F.when(F.length(text) > 0, F.split(F.array_join(marks, ""), "")).otherwise(F.when(text.isNotNull(), F.array().cast("array<string>")))


def grapheme_ends(text: Column) -> Column:
    """A5: offsets (code points) at which a grapheme ends."""
    return F.array_compact(F.transform(grapheme_marks(text), lambda mark, i: F.when(mark == "1", i + 1)))


def boundaries_are_graphemes(text: Column, bounds: Column) -> Column:
    """A5: whether all bounds (array of int) are grapheme boundaries of the text: 0 or the end of a grapheme. The ends are
    found once a text, so many bounds cost no more scans."""
    return ends_hold(grapheme_ends(text), bounds)


def ends_hold(ends: Column, bounds: Column) -> Column:
    """A5: boundaries_are_graphemes by the grapheme_ends of the text, for several questions about one."""
    wrong = F.size(F.array_except(bounds, F.concat(F.array(F.lit(0)), F.coalesce(ends, F.array().cast("array<int>"))))) > 0
    return F.when(bounds.isNotNull() & ~F.exists(bounds, lambda b: b.isNull()), ~wrong)


def glossary_translate(masked: Column, target: str, glossary: list[tuple[str, str]]) -> Column:
    """Terms replaced longest first, whole words, any case, outside placeholders; a text without a term is marked.
    The glossary is a parameter, not data."""
    import re

    terms = sorted(glossary, key=lambda t: -len(t[0]))

    def swap(segment: Column) -> Column:
        for source, to in terms:
            segment = F.regexp_replace(segment, rf"(?iU)(?<![\p{{L}}\p{{N}}_]){re.escape(source)}(?![\p{{L}}\p{{N}}_])", to.replace("\\", "\\\\").replace("$", "\\$"))
        return segment

    parts = F.split(masked, r'(?=<x id="\d+"/>)|(?<="/>)')
    done = F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r'^<x id="\d+"/>$'), p).otherwise(swap(p))), "")
    return F.when(done != masked, done).otherwise(F.concat(F.lit(f"【模拟 {target}】"), masked))


def normalize_correlation_id(value: Column, fresh: Column | None = None) -> Column:
    """The id if it is well formed, else a new one (fresh, by default random)."""
    return F.when(value.rlike(r"^[A-Za-z0-9._-]{1,64}\z"), value).otherwise(F.regexp_replace(F.uuid(), "-", "") if fresh is None else fresh)


def outcome_class(error: Column) -> Column:
    """HTTP status of a domain error by its kind's name."""
    return F.when(error.endswith("NotFound"), 404).when(error.endswith("Conflict"), 409).otherwise(422)


def provider_outcome(status: Column) -> tuple[Column, Column]:
    """(error code, retryable) of a provider's HTTP status."""
    code = (
        F.when(status.isin(401, 403), "provider_authentication_failed").when(status == 429, "provider_rate_limited")
        .when(status.isin(408, 500, 503), "provider_unavailable").when(status == 400, "provider_rejected_request").otherwise("provider_failed")
    )
    return code, status.isin(429, 408, 500, 503)


def backend_outcome(status: Column) -> Column:
    """A9, client side."""
    return (
        F.when(status == 401, "backend_authentication_failed").when(status == 429, "backend_rate_limited")
        .when(status.isin(408, 500, 502, 503, 504), "backend_unavailable").when(status.isin(400, 413, 422), "backend_rejected_request").otherwise("backend_failed")
    )


def retry_after(header: Column) -> Column:
    """Seconds to wait, 0 to 2; null if the header is no number."""
    return F.least(F.lit(2.0), F.greatest(F.lit(0.0), header.try_cast("double")))


def to_provider_language(df: DataFrame, column: str, out: str) -> DataFrame:
    """A10: left join with the 25-row dimension; unknown codes pass through."""
    dim = dims.languages(df.sparkSession).select(F.col("language_code").alias("_c"), F.col("provider_code").alias("_p"))
    return df.join(F.broadcast(dim), df[column] == F.col("_c"), "left").withColumn(out, F.coalesce("_p", column)).drop("_c", "_p")


def from_provider_language(df: DataFrame, column: str, out: str) -> DataFrame:
    """A10, reverse, in any case; the first language of a provider code wins."""
    dim = dims.languages(df.sparkSession).groupBy(F.lower("provider_code").alias("_p")).agg(F.min_by("language_code", "ord").alias("_c"))
    return df.join(F.broadcast(dim), F.lower(df[column]) == F.col("_p"), "left").withColumn(out, F.coalesce("_c", column)).drop("_c", "_p")
