"""Sources and sinks: snapshot tables, artifact files, an object store, fixtures and reports.

A snapshot table is a folder of versions. A version is a folder of Parquet that is complete before a one-line pointer names it, and pointers
are created by a rename that fails where the version exists: readers resolve the pointer once, and of two writers one wins.
"""

from __future__ import annotations

import json
import re
import uuid

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.sources import pdf

SAFE_KEY = re.compile(r"[A-Za-z0-9][A-Za-z0-9._-]*(/[A-Za-z0-9][A-Za-z0-9._-]*)*")


class Files:
    """Calls of the file system that a path belongs to."""

    def __init__(self, spark: SparkSession, root: str):
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self.path(root).getFileSystem(self._conf)

    def path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def read(self, p: str) -> bytes:
        stream = self.fs.open(self.path(p))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def put_if_absent(self, p: str, content: bytes) -> bool:
        """Whether p was written: False if it exists. Readers never see a part of it."""
        target = self.path(p)
        if self.fs.exists(target):
            return False
        part = self.path(f"{target.getParent().toString()}/.part-{uuid.uuid4().hex}")
        out = self.fs.create(part, False)
        try:
            out.write(bytearray(content))
        finally:
            out.close()
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(target.toUri(), self._conf)
        options = self._jvm.org.apache.hadoop.fs.Options
        kinds = self._gateway_array(options)
        try:
            context.rename(self.fs.makeQualified(part), self.fs.makeQualified(target), kinds)
        except Exception as e:
            self.fs.delete(part, False)
            if "FileAlreadyExists" in str(e):
                return False
            raise
        return True

    def _gateway_array(self, options):
        from pyspark import SparkContext

        kinds = SparkContext._active_spark_context._gateway.new_array(options.Rename, 1)
        kinds[0] = options.Rename.NONE
        return kinds

    def names(self, p: str) -> list[str]:
        where = self.path(p)
        return sorted(s.getPath().getName() for s in self.fs.listStatus(where)) if self.fs.exists(where) else []


class VersionTaken(RuntimeError):
    pass


class SnapshotTable:
    """A table whose every change is a new version."""

    def __init__(self, spark: SparkSession, root: str, schema: StructType | str):
        self.spark, self.root = spark, root.rstrip("/")
        self.schema = spark.createDataFrame([], schema).schema
        self.files = Files(spark, self.root)

    def version(self) -> int:
        return max((int(n) for n in self.files.names(f"{self.root}/versions") if n.isdigit()), default=0)

    def read(self, version: int | None = None) -> DataFrame:
        version = self.version() if version is None else version
        if not version:
            return self.spark.createDataFrame([], self.schema)
        folder = json.loads(self.files.read(f"{self.root}/versions/{version}"))["folder"]
        return self.spark.read.schema(self.schema).parquet(f"{self.root}/{folder}")

    def replace(self, rows: DataFrame, parent: int | None = None) -> int:
        """rows as the version after parent (by default the newest); another writer's version in between is an error."""
        parent = self.version() if parent is None else parent
        folder = f"data-{uuid.uuid4().hex}"
        rows.select(*self.schema.names).write.parquet(f"{self.root}/{folder}")
        if not self.files.put_if_absent(f"{self.root}/versions/{parent + 1}", json.dumps({"folder": folder}).encode()):
            raise VersionTaken(f"version {parent + 1} of {self.root}")
        return parent + 1

    def append_new(self, rows: DataFrame, keys: list[str]) -> int:
        """Append rows; one whose key is there already, or twice in rows, is an error."""
        old = self.read()
        both = old.select(*keys).unionByName(rows.select(*keys))
        if not both.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1").isEmpty():
            raise ValueError(f"a key of {keys} is there already")
        return self.replace(old.unionByName(rows.select(*self.schema.names)))

    def insert_or_ignore(self, rows: DataFrame, keys: list[str]) -> DataFrame:
        """Append the rows whose keys are new; rows with replayed, whether the key was there before."""
        old = self.read()
        same = F.lit(True)
        for k in keys:
            same = same & F.col(f"n.{k}").eqNullSafe(F.col(f"o.{k}"))
        known = old.select(*keys).distinct().withColumn("replayed", F.lit(True))
        told = rows.alias("n").join(known.alias("o"), same, "left").select("n.*", F.coalesce("o.replayed", F.lit(False)).alias("replayed"))
        fresh = told.where("not replayed").dropDuplicates(keys).select(*self.schema.names)
        self.replace(old.unionByName(fresh))
        return told

    def replace_scope(self, scope: DataFrame, rows: DataFrame) -> int:
        """Delete the rows of the scopes (one row each) and add rows: a scope without rows is emptied."""
        same = F.lit(True)
        for k in scope.columns:
            same = same & F.col(f"t.{k}").eqNullSafe(F.col(f"s.{k}"))
        kept = self.read().alias("t").join(scope.distinct().alias("s"), same, "left_anti")
        return self.replace(kept.unionByName(rows.select(*self.schema.names)))

    def upsert(self, rows: DataFrame, keys: list[str]) -> int:
        return self.replace_scope(rows.select(*keys), rows)


def artifacts(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    """JSON artifacts, one a file; what does not parse, or breaks the schema's types, is an error."""
    return spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").json(path)


def binaries(spark: SparkSession, path: str) -> DataFrame:
    """path, content of files."""
    return spark.read.format("binaryFile").load(path).select("path", "content")


class ObjectStore:
    """Content under safe keys; a key is written once."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root, self.files = spark, root.rstrip("/"), Files(spark, root)

    def _place(self, key: str) -> str:
        if not SAFE_KEY.fullmatch(key) or ".." in key:
            raise ValueError(f"unsafe key {key!r}")
        return f"{self.root}/{key}"

    def put(self, key: str, content: bytes) -> bool:
        return self.files.put_if_absent(self._place(key), content)

    def get(self, key: str) -> bytes:
        return self.files.read(self._place(key))

    def exists(self, key: str) -> bool:
        return self.files.fs.exists(self.files.path(self._place(key)))

    def delete(self, key: str) -> bool:
        return self.files.fs.delete(self.files.path(self._place(key)), False)

    def keys(self) -> DataFrame:
        """object_key of all objects; listed by Spark, so their number is no matter to the driver's Python."""
        found = self.spark.read.format("binaryFile").option("recursiveFileLookup", True).load(self.root)
        root = self.files.fs.makeQualified(self.files.path(self.root)).toUri().getPath()
        return found.select(F.regexp_replace(F.regexp_replace("path", "^[a-z]+:/*", "/"), f"^{re.escape(root)}/", "").alias("object_key"))


def load_fixtures(table: SnapshotTable, rows: DataFrame, keys: list[str], expected: int) -> int:
    """Upsert rows by keys, the last of equal ones, and verify how many the table has then."""
    from pyspark.sql.window import Window

    last = Window.partitionBy(*keys).orderBy(F.desc("ord"))
    newest = rows.withColumn("r_", F.row_number().over(last)).where("r_ = 1").drop("r_")
    table.upsert(newest, keys)
    n = table.read().count()
    if n != expected:
        raise ValueError(f"{n} rows, expected {expected}")
    return n


def write_report(spark: SparkSession, root: str, name: str, rows: DataFrame, most: int = 10000) -> None:
    """A small table as JSON and as Markdown; more than most rows are an error."""
    found = rows.limit(most + 1).collect()
    if len(found) > most:
        raise ValueError(f"a report of more than {most} rows")
    head = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    files = Files(spark, root)
    files.put_if_absent(f"{root}/{name}.json", json.dumps([r.asDict(True) for r in found], sort_keys=True, default=str).encode())
    files.put_if_absent(f"{root}/{name}.md", (head + "".join(f"| {' | '.join(map(str, r))} |\n" for r in found)).encode())


def native_pages(files: DataFrame) -> DataFrame:
    """document_id, page_count, page, width, height, runs (ord, font_size, x0, y0, text) of PDFs (files: document_id, content).

    A file that can't be read is an error; width and height are null where the file doesn't say them.
    """
    run = "array<struct<ord:int,font_size:double,x0:double,y0:double,text:string>>"

    def pages(content: pa.Array) -> pa.Array:
        out = []
        for c in content:
            found = pdf.read(c.as_py() or b"")
            out.append([{"page": k, "width": w, "height": h, "runs": [dict(zip(("ord", "font_size", "x0", "y0", "text"), r, strict=True)) for r in runs]} for k, w, h, runs in found])
        number = pa.float64()
        line = pa.list_(pa.struct([("ord", pa.int32()), ("font_size", number), ("x0", number), ("y0", number), ("text", pa.string())]))
        return pa.array(out, pa.list_(pa.struct([("page", pa.int32()), ("width", number), ("height", number), ("runs", line)])))

    parsed = F.arrow_udf(pages, f"array<struct<page:int,width:double,height:double,runs:{run}>>")("content")
    return files.select("document_id", parsed.alias("pages")).select("document_id", F.size("pages").alias("page_count"), F.inline("pages"))


def native_runs(files: DataFrame) -> DataFrame:
    """document_id, page, ord, font_size, x0, y0, text of PDFs (files: document_id, content); blank runs are left out."""
    return native_pages(files).select("document_id", "page", F.inline("runs"))


def span_box(text: Column, x0: Column, y0: Column, size: Column) -> list[Column]:
    return [x0.alias("x0"), y0.alias("y0"), (x0 + F.length(text) * size * 0.5).alias("x1"), (y0 + size * 1.2).alias("y1")]


def native_spans(runs: DataFrame) -> DataFrame:
    """runs as spans: box, full confidence, the identity transform and the page's own space."""
    identity = F.array(*[F.lit(x) for x in (1.0, 0.0, 0.0, 1.0, 0.0, 0.0)])
    return runs.select("document_id", "ord", "page", "text", *span_box(F.col("text"), F.col("x0"), F.col("y0"), F.col("font_size")), F.lit(1.0).alias("confidence"), F.concat(F.lit("page-"), "page").alias("coordinate_space"), identity.alias("transform_to_source"))
