"""A data source for folders of run results, manifests and case files (S3-S5): format `region_runs`, batch and stream.

    register(spark)
    spark.read.format("region_runs").schema("case_id string NOT NULL, n long, _run string").option("records", "cases").load(path)

Each JSON file holds one object; option `records` names its array of records, without it the object is the record. Files
are dealt to partitions in runs of `runbytes` bytes (32 MiB by default), so that a folder of many small files costs few tasks and
no task reads more than that and one file. Records are checked against the schema: fields that may not be null, and those that option `required` lists
(`a,b`), have to be there, and values have to be of the field's type; further fields are left out. A record that fails stops the read with its file and place, or, if
the schema has a column `_problem`, gives a row of nulls that says what is wrong (`required` takes the place of NOT NULL then). Columns `_file` and `_run` (the file's
folder) are filled if the schema has them. A file that is no JSON object counts as one record that fails. Nothing is read from
hidden files and folders (`_` or `.` in front); an empty folder gives no rows.

As a stream the source gives the records of new run folders, the folders directly below the path, once their writer has put `_SUCCESS` into
them. Their names have to rise, as numbers of equal width or timestamps do; a run that turns up with a name below one that has
been read stops the stream, so none is passed over in silence.
"""

from __future__ import annotations

import json
import posixpath
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema

RUN_BYTES = 32 << 20
#: Records in a batch that is handed to Spark.
BATCH = 1000
OWN = ("_file", "_run", "_problem")
_INTEGERS = {T.ByteType: 7, T.ShortType: 15, T.IntegerType: 31, T.LongType: 63}


@dataclass
class Files(InputPartition):
    paths: list[str]


def misfit(value, kind: T.DataType, nullable: bool = True, at: str = "record") -> str | None:
    """What is wrong with a JSON value as a value of the type, by its place; None if it fits."""
    if value is None:
        return None if nullable else f"{at} is missing"
    if isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            return f"{at} is no object"
        return next((m for f in kind.fields if (m := misfit(value.get(f.name), f.dataType, f.nullable, f"{at}.{f.name}"))), None)
    if isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            return f"{at} is no array"
        return next((m for i, v in enumerate(value) if (m := misfit(v, kind.elementType, kind.containsNull, f"{at}[{i}]"))), None)
    if isinstance(kind, T.MapType):
        if not isinstance(value, dict):
            return f"{at} is no object"
        return next((m for k, v in value.items() if (m := misfit(v, kind.valueType, kind.valueContainsNull, f"{at}.{k}"))), None)
    if isinstance(kind, T.BooleanType):
        good = isinstance(value, bool)
    elif type(kind) in _INTEGERS:
        bound = 1 << _INTEGERS[type(kind)]
        good = isinstance(value, int) and not isinstance(value, bool) and -bound <= value < bound
    elif isinstance(kind, (T.FloatType, T.DoubleType)):
        good = isinstance(value, (int, float)) and not isinstance(value, bool)
    elif isinstance(kind, T.StringType):
        good = isinstance(value, str)
    else:
        return f"{at}: type {kind.simpleString()} is not read"
    return None if good else f"{at} is no {kind.simpleString()}"


def shaped(value, kind: T.DataType):
    """A value that fits, with the fields of the type only and whole numbers as doubles where the type says so."""
    if value is None:
        return None
    if isinstance(kind, T.StructType):
        return {f.name: shaped(value.get(f.name), f.dataType) for f in kind.fields}
    if isinstance(kind, T.ArrayType):
        return [shaped(v, kind.elementType) for v in value]
    if isinstance(kind, T.MapType):
        return [(k, shaped(v, kind.valueType)) for k, v in value.items()]
    return float(value) if isinstance(kind, (T.FloatType, T.DoubleType)) else value


class _Folder:
    """What the batch and the stream reader share: the files of a path and their records."""

    def __init__(self, options, schema: T.StructType):
        if "path" not in options:
            raise ValueError("region_runs needs a path")
        self.path, self.records, self.run_bytes = options["path"], options.get("records"), int(options.get("runbytes", RUN_BYTES))
        required = [n for n in options.get("required", "").split(",") if n]
        fields = [f for f in schema.fields if f.name not in OWN]
        if "_problem" in schema.names and not all(f.nullable for f in fields):
            raise ValueError("columns that may not be null leave no row to report a problem in; use option required")
        self.schema, self.wanted = schema, T.StructType([T.StructField(f.name, f.dataType, f.nullable and f.name not in required) for f in fields])

    def files_below(self, folder: str, system: fs.FileSystem) -> list[fs.FileInfo]:
        found = system.get_file_info(fs.FileSelector(folder, recursive=True, allow_not_found=True))
        seen = lambda p: not any(x[:1] in ("_", ".") for x in p[len(folder) :].split("/"))
        return sorted((f for f in found if f.type == fs.FileType.File and f.path.endswith(".json") and seen(f.path)), key=lambda f: f.path)

    def dealt(self, files: list[fs.FileInfo]) -> list[Files]:
        out, size = [], self.run_bytes
        for f in files:
            if size >= self.run_bytes:
                out.append(Files([]))
                size = 0
            out[-1].paths.append(f.path)
            size += f.size
        return out

    def read(self, partition: Files):
        system, _ = fs.FileSystem.from_uri(self.path)
        arrow, rows = to_arrow_schema(self.schema), []
        for path in partition.paths:
            for row in self._rows(system, path):
                rows.append(row)
                if len(rows) == BATCH:
                    yield pa.RecordBatch.from_pylist(rows, arrow)
                    rows = []
        if rows:
            yield pa.RecordBatch.from_pylist(rows, arrow)

    def _rows(self, system: fs.FileSystem, path: str):
        own = {"_file": path, "_run": posixpath.basename(posixpath.dirname(path))}
        named = {k: v for k, v in own.items() if k in self.schema.names}
        with system.open_input_stream(path) as f:
            text = f.read()
        try:
            whole = json.loads(text)
            problem = None if isinstance(whole, dict) else "no JSON object"
            records = [whole] if self.records is None else whole.get(self.records) if isinstance(whole, dict) else None
            if problem is None and not isinstance(records, list):
                problem = f"{self.records} is no array"
        except ValueError as e:  # UnicodeDecodeError too
            problem = f"no JSON: {e}"
        for i, record in enumerate([None] if problem else records):
            wrong = problem or misfit(record, self.wanted, False, f"{self.records or 'record'}[{i}]")
            if wrong is None:
                yield shaped(record, self.wanted) | named
            elif "_problem" in self.schema.names:
                yield named | {"_problem": wrong}
            else:
                raise ValueError(f"{path}: {wrong}")


class _Reader(_Folder, DataSourceReader):
    def partitions(self):
        system, folder = fs.FileSystem.from_uri(self.path)
        return self.dealt(self.files_below(folder, system)) or [Files([])]


class _StreamReader(_Folder, DataSourceStreamReader):
    """An offset is the name of the last run that has been read and how many were complete up to it."""

    def _complete(self) -> list[str]:
        system, folder = fs.FileSystem.from_uri(self.path)
        below = system.get_file_info(fs.FileSelector(folder, allow_not_found=True))
        names = sorted(f.base_name for f in below if f.type == fs.FileType.Directory and f.base_name[:1] not in ("_", "."))
        marks = system.get_file_info([f"{folder.rstrip('/')}/{n}/_SUCCESS" for n in names])
        return [n for n, m in zip(names, marks) if m.type == fs.FileType.File]

    def initialOffset(self) -> dict:
        return {"last": "", "runs": 0}

    def latestOffset(self) -> dict:
        names = self._complete()
        return {"last": names[-1], "runs": len(names)} if names else self.initialOffset()

    def partitions(self, start: dict, end: dict):
        if start["last"] == end["last"] and start["runs"] == end["runs"]:
            return []
        names = self._complete()
        new = [n for n in names if start["last"] < n <= end["last"]]
        if sum(n <= start["last"] for n in names) > start["runs"] or len(new) != end["runs"] - start["runs"]:
            raise ValueError(f"runs of {self.path} came or went below {end['last']} after it had been read")
        system, folder = fs.FileSystem.from_uri(self.path)
        return self.dealt([f for n in new for f in self.files_below(f"{folder.rstrip('/')}/{n}", system)])


class RegionRuns(DataSource):
    @classmethod
    def name(cls) -> str:
        return "region_runs"

    def schema(self):
        raise ValueError("region_runs needs a schema: its records are checked against it")

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.options, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _StreamReader(self.options, schema)


def register(spark: SparkSession) -> SparkSession:
    spark.dataSource.register(RegionRuns)
    return spark


def refuse_repeated(rows: DataFrame, key: str) -> DataFrame:
    """rows, if no value of the key occurs twice; an error that names up to ten of them otherwise. Null keys are no ids."""
    twice = rows.where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").orderBy(key).limit(10).collect()
    if twice:
        raise ValueError(f"{key} occurs more than once: " + ", ".join(str(r[0]) for r in twice))
    return rows
