"""Routing, lookups and set comparisons."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W
from pyspark.sql import functions as F

from regionspark import dims


def route_profiles(rows: DataFrame, language: str) -> DataFrame:
    """profile_id by language; unsupported languages stay with a reason. The dimension has 25 rows."""
    dim = dims.languages(rows.sparkSession).select(F.col("language_code").alias("_c"), "profile_id")
    reason = F.when(F.col("_c").isNull(), "unknown_language").when(F.col("profile_id").isNull(), "unsupported_language")
    return rows.join(F.broadcast(dim), rows[language] == F.col("_c"), "left").withColumn("reason", reason).drop("_c")


def coverage_matrix(baseline: DataFrame, supported: DataFrame, key: str) -> DataFrame:
    """Every baseline key with whether it is supported."""
    have = supported.select(F.col(key).alias("_k")).distinct()
    return baseline.join(have, baseline[key] == F.col("_k"), "left").withColumn("supported", F.col("_k").isNotNull()).drop("_k")


def coverage_mismatch(expected: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Keys on one side only: missing or extra."""
    a, b = expected.select(key).distinct().withColumn("_a", F.lit(1)), found.select(key).distinct().withColumn("_b", F.lit(1))
    return a.join(b, key, "full_outer").where("_a is null or _b is null").select(key, F.when(F.col("_b").isNull(), "missing").otherwise("extra").alias("problem"))


def required_models(profiles: DataFrame, installed: DataFrame) -> DataFrame:
    """Profiles (profile_id, det, cls, rec) to one row per needed model with its active version, null if none."""
    need = profiles.select("profile_id", F.explode(F.array(*[F.struct(F.lit(r).alias("role"), F.col(r).alias("model_id")) for r in ("det", "cls", "rec")])).alias("m")).select("profile_id", "m.*")
    return need.join(installed.select("model_id", F.col("version").alias("active_version")), "model_id", "left")


def erase_set(regions: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """Regions whose unit is translated."""
    return regions.join(units.where(F.col("status") == "translated").select(*keys), keys, "left_semi")


def without_erase(regions: DataFrame, units: DataFrame, image: str) -> DataFrame:
    """Images of which nothing is to be erased."""
    return regions.select(image).distinct().join(units.where(F.col("status") == "translated").select(image), image, "left_anti")


def unit_regions(units: DataFrame, regions: DataFrame, keys: list[str]) -> DataFrame:
    """Units with their region; units without one are dropped."""
    return units.join(regions, keys)


def join_by_position(requests: DataFrame, responses: DataFrame) -> DataFrame:
    """J7 on (request_id, pos, ...): requests with the response at their position; where the counts differ the whole
    request fails and has no answer. Counts are aggregated, not windowed, so a large request is no single task."""
    count = lambda df, n: df.groupBy("request_id").agg(F.count("*").alias(n))
    both = count(requests, "_n").join(count(responses, "_m"), "request_id", "left").select("request_id", F.coalesce(F.col("_n") == F.col("_m"), F.lit(False)).alias("complete"))
    return requests.join(both, "request_id").join(responses, ["request_id", "pos"], "left").withColumn("answer", F.when(F.col("complete"), F.col("answer")))


def compare_backends(left: DataFrame, right: DataFrame, key: str, fields: list[str]) -> DataFrame:
    """Cases that both have, with whether each field agrees."""
    a, b = left.select(key, *[F.col(f).alias(f"{f}_left") for f in fields]), right.select(key, *[F.col(f).alias(f"{f}_right") for f in fields])
    return a.join(b, key).select("*", *[F.col(f"{f}_left").eqNullSafe(F.col(f"{f}_right")).alias(f"{f}_match") for f in fields])


def resolve_preference(preferences: DataFrame, available: DataFrame) -> DataFrame:
    """J15 on preferences (query, rank, name) and available (name): the first preferred name there is, in any case, else the
    alphabetically first, with degraded and reason."""
    have = available.groupBy(F.lower("name").alias("_l")).agg(F.max("name").alias("_name"))
    hit = preferences.join(have, F.lower("name") == F.col("_l"), "left")
    best = hit.groupBy("query").agg(F.min(F.when(F.col("_name").isNotNull(), F.struct("rank", "_name"))).alias("m"))
    default = available.agg(F.min(F.struct(F.lower("name").alias("l"), "name")).alias("d"))  # one row
    rows = best.join(F.broadcast(default))
    found = F.col("m").isNotNull()
    reason = F.when(~found, "script_unavailable").when(F.col("m.rank") > 0, "preferred_unavailable")
    return rows.select("query", F.coalesce("m._name", "d.name").alias("resolved"), (~found | (F.col("m.rank") > 0)).alias("degraded"), reason.alias("reason"))


def top_candidates(queries: DataFrame, names: DataFrame, k: int = 8) -> DataFrame:
    """T3 on queries (query, tokens array: a bounded dimension) and names (name, supports array of query): the k names with
    most token hits, then by name; a fallback row where none qualifies."""
    rows = names.select("name", F.explode("supports").alias("query")).join(F.broadcast(queries), "query")
    hits = F.size(F.filter("tokens", lambda t: F.contains(F.lower(F.col("name")), t)))
    rank = F.row_number().over(W.partitionBy("query").orderBy(F.desc("hits"), F.lower("name"), "name"))
    top = rows.withColumn("hits", hits).withColumn("rank", rank).where(F.col("rank") <= k).select("query", "rank", "name", "hits")
    none = queries.join(top, "query", "left_anti").select("query", F.lit(1).alias("rank"), F.lit("default").alias("name"), F.lit(0).alias("hits"))
    return top.unionByName(none)
