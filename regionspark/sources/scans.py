"""Sources S1-S5 and sinks S6-S8."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Fixed value: image formats by suffix.
SUFFIXES = {".png": "PNG", ".jpg": "JPEG", ".jpeg": "JPEG", ".webp": "WEBP"}
MANIFEST = "dataset_kind string, adapter string, samples array<struct<id:string,image:string,language_code:string,script:string,license:string,expected_regions:array<struct<polygon:array<array<double>>,text:string,difficulty:string>>>>"
LAYOUT_CASES = "schema_version int, languages array<struct<language_code:string,font_file:string,direction:string,alignment:string,width:int,height:int,font_size:double,cases:array<struct<id:string,text:string,width:int,height:int,direction:string,font_size:double,alignment:string>>>>"


def suffix(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"(\.[^./]+)$", 1))


def first_images(files: DataFrame, path: str, n: int = 100) -> DataFrame:
    """S1, T4 on a catalogue of paths: supported suffixes in any case, by name, the first n (1 to 100)."""
    if not 1 <= n <= 100:
        raise ValueError("n must be from 1 to 100")
    name = F.lower(F.element_at(F.split(F.col(path), "/"), -1))
    kind = None
    for s, f in SUFFIXES.items():
        kind = F.when(suffix(F.col(path)) == s, f) if kind is None else kind.when(suffix(F.col(path)) == s, f)
    return files.withColumn("file_format", kind).where("file_format is not null").orderBy(name, path).limit(n)


def scan_images(spark: SparkSession, path: str, n: int = 100) -> DataFrame:
    """(source_path, file_size, file_format) of a folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "false").load(path).select(F.col("path").alias("source_path"), F.col("length").alias("file_size"))
    return first_images(files, "source_path", n)


def sniff_format(df: DataFrame, path: str = "path", content: str = "content") -> DataFrame:
    """Format by magic bytes, mismatch code against the suffix, and a PNG's size from its header."""
    head = F.hex(F.substring(F.col(content), 1, 32))
    found = F.when(head.startswith("89504E470D0A1A0A"), "PNG").when(head.startswith("FFD8FF"), "JPEG").when(head.startswith("52494646") & (F.substring(head, 17, 8) == "57454250"), "WEBP")
    named = F.create_map(*[F.lit(x) for kv in SUFFIXES.items() for x in kv])
    number = lambda at: F.when(F.col("detected") == "PNG", F.conv(F.substring(head, at, 8), 16, 10).cast("int"))
    out = df.withColumn("detected", found)
    return out.select(F.col(path), "detected", F.when(~F.coalesce(F.col("detected") == F.try_element_at(named, suffix(F.col(path))), F.lit(False)), "extension_content_mismatch").alias("code"), number(33).alias("width"), number(41).alias("height"))


def read_region_manifest(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """S3: samples, and the sample ids that occur more than once."""
    rows = spark.read.json(path, schema=MANIFEST, multiLine=True).select(F.explode("samples").alias("s")).select("s.*")
    return rows, rows.groupBy("id").count().where("count > 1").select("id")


def read_layout_cases(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """One row per case, what a case leaves out coming from its language; and the case ids that occur more than once,
    with which the file is refused."""
    rows = spark.read.json(path, schema=LAYOUT_CASES, multiLine=True).select(F.explode("languages").alias("l")).select("l", F.explode("l.cases").alias("c"))
    both = [F.coalesce(F.col(f"c.{f}"), F.col(f"l.{f}")).alias(f) for f in ("direction", "alignment", "width", "height", "font_size")]
    cases = rows.select(F.col("c.id").alias("case_id"), F.col("l.language_code").alias("language_code"), F.col("c.text").alias("text"), *both)
    return cases, cases.groupBy("case_id").count().where("count > 1").select("case_id")


def read_runs(spark: SparkSession, glob: str, schema: str) -> DataFrame:
    """Result files of all backends, the backend from the file's folder."""
    rows = spark.read.json(glob, schema=schema, multiLine=True).select("*", F.col("_metadata.file_path").alias("_f"))
    return rows.withColumn("backend", F.element_at(F.split("_f", "/"), -2)).drop("_f")


def review_sheet(df: DataFrame, backend: str, strategy: str, scores: list[str]) -> DataFrame:
    """Rows of one backend and strategy with blank score columns."""
    return df.where((F.col("backend") == backend) & (F.col("strategy") == strategy)).select("*", *[F.lit(None).cast("string").alias(c) for c in scores])


def write_review_sheet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path, header=True)


def write_report(df: DataFrame, path: str) -> None:
    """S7."""
    df.write.mode("overwrite").json(path)


def _files(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p, p.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())


def _commit(changes: DataFrame, path: str) -> None:
    """Append changes (key, run) to the folder of commits. The commit is written beside its place and moved there in one step, which
    fails if another writer has taken the number; then the next one is tried."""
    spark = changes.sparkSession
    staged, fs = _files(spark, f"{path}/staged/{uuid.uuid4().hex}")
    changes.coalesce(1).write.json(staged.toString())
    commits, _ = _files(spark, f"{path}/commits")
    fs.mkdirs(commits)
    n = max([int(x.getPath().getName().split("=")[1]) for x in fs.listStatus(commits)], default=0)
    while True:
        n += 1
        place, _ = _files(spark, f"{path}/commits/n={n}")
        if not fs.exists(place) and fs.rename(staged, place):
            return


def write_results(df: DataFrame, path: str, key: str = "batch_id") -> None:
    """Replaces the partitions that df has rows for and leaves the others. The rows are written to a run's folder of their own and
    count from the commit that names it; a write that fails before that changes nothing for a reader."""
    run = uuid.uuid4().hex
    df.write.partitionBy(key).parquet(f"{path}/runs/run={run}")
    written = df.sparkSession.read.schema(df.schema).parquet(f"{path}/runs/run={run}").select(F.col(key).cast("string").alias(key)).distinct()
    _commit(written.withColumn("run", F.lit(run)), path)


def clear_results(spark: SparkSession, path: str, batch: str, key: str = "batch_id") -> None:
    """Drops one batch, by a commit that names no run for it; readers that have begun keep their rows."""
    _commit(spark.createDataFrame([(batch, "")], f"{key} string, run string"), path)


def _current(spark: SparkSession, path: str, key: str) -> DataFrame:
    rows = spark.read.schema(f"{key} string, run string, n long").json(f"{path}/commits")
    return rows.groupBy(key).agg(F.max_by("run", "n").alias("run")).where("run <> ''")


def load_results(spark: SparkSession, path: str, schema: str, key: str = "batch_id") -> DataFrame:
    """The rows of each batch's last committed run. schema: the columns but the key. Runs are folders, so those that no
    commit names are pruned by the join."""
    rows = spark.read.schema(f"{schema}, run string, {key} string").parquet(f"{path}/runs")
    return rows.join(_current(spark, path, key), ["run", key], "left_semi").select(*[c for c in rows.columns if c not in ("run", key)], key)


def vacuum_results(spark: SparkSession, path: str, key: str = "batch_id") -> int:
    """Deletes the runs that no batch's last commit names, and what failed writes left; how many. Not while a write is going on."""
    runs, fs = _files(spark, f"{path}/runs")
    live = {r.run for r in _current(spark, path, key).select("run").distinct().toLocalIterator()}
    gone = [x.getPath() for x in fs.listStatus(runs) if x.getPath().getName().removeprefix("run=") not in live]
    for p in gone:
        fs.delete(p, True)
    fs.delete(_files(spark, f"{path}/staged")[0], True)
    return len(gone)
