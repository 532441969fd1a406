"""Inputs that the queries derive from the driver's tables, and the same derivations as SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from regionspark.functions import geometry as g


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region per line of documents: image_id, seq, text, language_code, polygon (40 high steps, 10 wide characters;
    its points rotated by image_id % 4)."""
    docs = table(spark, sf_dir, "documents")
    rows = docs.select(F.col("doc_id").alias("image_id"), F.col("lang").alias("language_code"), F.posexplode(F.split("text", "\n", -1)).alias("seq", "text"))
    w, y, k = 10.0 * F.length("text"), 40.0 * F.col("seq"), (F.col("image_id") % 4).cast("int")
    quad = F.array(g.point(F.lit(0.0), y), g.point(w, y), g.point(w, y + 30), g.point(F.lit(0.0), y + 30))
    return rows.withColumn("polygon", F.concat(F.slice(quad, k + 1, 4), F.slice(quad, F.lit(1), k)))


REGIONS_SQL = """lines AS (SELECT doc_id AS image_id, lang AS language_code, unnest(string_split(text, chr(10))) AS text, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS seq FROM documents),
corners AS (SELECT *, 10.0::DOUBLE * length(text) AS w, 40.0::DOUBLE * seq AS y FROM lines),
regions AS (SELECT image_id, language_code, seq, text, w, y, list_concat(q[k + 1:], q[:k]) AS p
            FROM (SELECT *, [{'x': 0.0::DOUBLE, 'y': y}, {'x': w, 'y': y}, {'x': w, 'y': y + 30}, {'x': 0.0::DOUBLE, 'y': y + 30}] AS q, image_id % 4 AS k FROM corners))"""
