"""Fixed domains as small dimension tables. Each is a constant here, so its size is known where it is broadcast."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Language codes, recognition profiles, provider codes, targets, rate policies, stages, statuses.
LANGUAGES = ("zh-Hans", "zh-Hant", "ru", "ja", "ko", "en", "th", "ar", "vi", "it", "de", "id", "pt-PT", "fil", "pt-BR", "pl", "ms", "hi", "es", "fr", "bn", "ur", "tr", "fa", "sw")
PROFILES = ("ppocrv6-common-small", "ppocrv5-cyrillic-mobile", "ppocrv5-korean-mobile", "ppocrv5-thai-mobile", "ppocrv5-arabic-mobile", "ppocrv5-devanagari-mobile")
PROFILE_OF = {"ru": PROFILES[1], "ko": PROFILES[2], "th": PROFILES[3], "ar": PROFILES[4], "ur": PROFILES[4], "fa": PROFILES[4], "hi": PROFILES[5], "bn": None}
PROVIDER_CODES = {"pt-BR": "pt", "pt-PT": "pt-pt"}
TARGETS = (("windows", "x86_64"), ("macos", "arm64"))
RATE_POLICIES = (("translation", 60, 60), ("client-config", 120, 60), ("model-manifest", 120, 60), ("activation", 20, 60), ("admin-api", 120, 60), ("admin-login", 10, 300))
STAGES = ("ocr", "translation", "inpainting", "layout", "rendering")
TERMINAL = ("completed", "failed", "cancelled")


def profile_of(code: str) -> str | None:
    return PROFILE_OF.get(code, PROFILES[0])


def languages(spark: SparkSession) -> DataFrame:
    """(language_code, ord, profile_id, provider_code): 25 rows; profile_id is null where recognition is unsupported."""
    return spark.createDataFrame([(c, i, profile_of(c), PROVIDER_CODES.get(c, c)) for i, c in enumerate(LANGUAGES)], "language_code string, ord int, profile_id string, provider_code string")


def profiles(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PROFILES], "profile_id string")


def targets(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(TARGETS), "platform string, architecture string")


def rate_policies(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(list(RATE_POLICIES), "scope string, max_requests int, window_s int")


def values_sql(name: str, columns: str, rows) -> str:
    """A common table expression that holds a dimension, for the SQL twins of the queries."""
    lit = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return f"{name}({columns}) AS (VALUES " + ", ".join("(" + ", ".join(map(lit, r)) + ")" for r in rows) + ")"


LANGUAGES_SQL = values_sql("languages", "language_code, ord, profile_id, provider_code", [(c, i, profile_of(c), PROVIDER_CODES.get(c, c)) for i, c in enumerate(LANGUAGES)])
