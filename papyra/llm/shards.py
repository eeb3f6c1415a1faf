"""Sharding by size-tiered compaction, in DataFrame functions and file system calls only.

Arrivals are appended as small immutable shards, one Parquet file for each task's rows. Compaction puts shards into
tiers by the logarithm of their size; as soon as a tier has ``fanout`` shards, runs of neighbouring ones merge, and the
merged run counts in its own, higher tier, until no tier has enough or files reach the target size. Only the outcome of
that plan is written: each new file is made by one task that reads its shards and shuffles nothing, whatever the number
of merges it stands for. Files at or over the target are left alone.

A version of the table is one manifest, a text file with a line for each shard. A version is committed by renaming a
complete manifest to its number, which fails if that number exists: of two writers one wins and the other has changed
nothing that readers see. Shards are never changed; those that no version names are garbage.

All rows and columns are kept as they are: nulls, repeated rows, long texts. The manifest's first line is the table's
schema, the union of all arrivals': a column that only some of them have is null in the others' rows, and an arrival whose
column has another type than the table's is refused. An empty table gives a version without rows.
"""

from __future__ import annotations

import json
import math
from concurrent.futures import ThreadPoolExecutor
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from papyra.llm.store import new_folder

TARGET = 128 << 20
FANOUT = 4
#: Files that one job writes at most, so that plans stay small, and jobs that run side by side.
WAVE, SIDE_BY_SIDE = 64, 8


def plan_merges(sizes: list[int], target: int = TARGET, fanout: int = FANOUT, least: int = 1 << 16) -> list[list[int]]:
    """Groups of positions in sizes that are to become one file each; positions in no group stay."""
    tier = lambda n: int(math.log(max(n, least) / least, fanout) + 1e-9)
    runs: dict[int, list[tuple[int, list[int]]]] = {}
    for i, n in enumerate(sizes):
        if n < target:
            runs.setdefault(tier(n), []).append((n, [i]))
    done: list[list[int]] = []

    def put(level: int, total: int, merged: int, ids: list[int]) -> None:
        """A run goes up only if it merged others, so there are fewer with each step; full and lone ones are done."""
        if total >= target or merged < 2:
            done.append(ids)
        else:
            runs.setdefault(max(level + 1, tier(total)), []).append((total, ids))

    level = 0
    while level <= max(runs, default=-1):
        here = runs.pop(level, [])
        if len(here) < fanout:
            done += [ids for _, ids in here]
            here = []
        bag, total, merged = [], 0, 0
        for n, ids in here:
            if bag and total + n > 1.25 * target:
                put(level, total, merged, bag)
                bag, total, merged = [], 0, 0
            bag, total, merged = bag + ids, total + n, merged + 1
            if tier(total) > level and total >= min(target, fanout * least) and total >= (fanout - 0.5) * n:
                put(level, total, merged, bag)
                bag, total, merged = [], 0, 0
        if bag:
            put(level, total, merged, bag)
        level += 1
    return [ids for ids in done if len(ids) > 1]


class ShardedTable:
    """A folder of shards and manifests on any file system that Spark can write."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        self._jvm = spark.sparkContext._jvm
        self._conf = spark.sparkContext._jsc.hadoopConfiguration()
        self._fs = self._path(self.root).getFileSystem(self._conf)

    def _path(self, p: str):
        return self._jvm.org.apache.hadoop.fs.Path(p)

    def versions(self) -> list[int]:
        where = self._path(f"{self.root}/manifest")
        found = self._fs.listStatus(where) if self._fs.exists(where) else []
        return sorted(int(s.getPath().getName()) for s in found if s.getPath().getName().isdigit())

    def shards(self, version: int | None = None) -> list[dict]:
        """path and bytes of each shard of a version, by default the newest."""
        return [x for x in self._lines(version) if "path" in x]

    def schema(self, version: int | None = None) -> StructType:
        """The columns of a version, by default the newest."""
        found = [x["schema"] for x in self._lines(version) if "schema" in x]
        return StructType.fromJson(found[0]) if found else StructType()

    def _lines(self, version: int | None) -> list[dict]:
        have = self.versions()
        if not have:
            return []
        name = f"{self.root}/manifest/{have[-1] if version is None else version:010d}"
        stream = self._fs.open(self._path(name))
        try:
            text = self._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
        finally:
            stream.close()
        return [json.loads(x) for x in text.splitlines()]

    def _commit(self, schema: StructType, shards: list[dict], parent: int) -> int:
        temporary = self._path(new_folder(self.spark, "manifest"))
        temporary = self._path(f"{self.root}/manifest/.{temporary.getName()}")
        out = self._fs.create(temporary, False)
        try:
            out.write(bytearray("".join(json.dumps(s) + "\n" for s in [{"schema": schema.jsonValue()}, *shards]).encode()))
        finally:
            out.close()
        fc = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._path(self.root).toUri(), self._conf)
        none = self.spark.sparkContext._gateway.new_array(self._jvm.org.apache.hadoop.fs.Options.Rename, 1)
        none[0] = self._jvm.org.apache.hadoop.fs.Options.Rename.NONE
        fc.rename(self._fs.makeQualified(temporary), self._fs.makeQualified(self._path(f"{self.root}/manifest/{parent + 1:010d}")), none)
        return parent + 1

    def _written(self, folder: str) -> list[dict]:
        found = [s for s in self._fs.listStatus(self._path(folder)) if s.getPath().getName().startswith("part-")]
        return [{"path": s.getPath().toString(), "bytes": s.getLen()} for s in sorted(found, key=lambda s: s.getPath().getName())]

    def append(self, rows: DataFrame) -> int:
        """Write rows as new shards and commit them."""
        have = self.versions()
        schema = union_schema(self.schema(), rows.schema)
        folder = new_folder(self.spark, "arrivals").rpartition("/")[2]
        folder = f"{self.root}/shards/{folder}"
        rows.write.option("compression", "zstd").parquet(folder)
        return self._commit(schema, self.shards() + self._written(folder), have[-1] if have else 0)

    def compact(self, target: int = TARGET, fanout: int = FANOUT) -> int:
        """Merge similarly sized shards and commit; the newest version, if there is nothing to merge."""
        version = self.versions()[-1]
        shards, schema = self.shards(version), self.schema(version)
        groups = plan_merges([s["bytes"] for s in shards], target, fanout)
        if not groups:
            return version

        def wave(k: int) -> list[dict]:
            folder = f"{self.root}/shards/" + new_folder(self.spark, "merged").rpartition("/")[2]
            parts = [self.spark.read.schema(schema).parquet(*[shards[i]["path"] for i in g]).coalesce(1) for g in groups[k : k + WAVE]]
            reduce(DataFrame.union, parts).write.option("compression", "zstd").parquet(folder)
            return self._written(folder)

        with ThreadPoolExecutor(SIDE_BY_SIDE) as pool:
            made = [x for found in pool.map(wave, range(0, len(groups), WAVE)) for x in found]
        gone = {i for g in groups for i in g}
        return self._commit(schema, [s for i, s in enumerate(shards) if i not in gone] + made, version)

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version; None if it has no shard."""
        paths = [s["path"] for s in self.shards(version)]
        return self.spark.read.schema(self.schema(version)).parquet(*paths) if paths else None


def union_schema(have: StructType, more: StructType) -> StructType:
    """have with the columns that only more has; every column may be null."""
    known = {f.name.lower(): f for f in have.fields}
    out = StructType(list(have.fields))
    for f in more.fields:
        old = known.get(f.name.lower())
        if old is None:
            out.add(f.name, f.dataType, True)
        elif old.dataType != f.dataType:
            raise ValueError(f"column {f.name} is {f.dataType.simpleString()} and the table's is {old.dataType.simpleString()}")
    return out


def shard(docs: DataFrame, root: str | None = None, target: int = TARGET, fanout: int = FANOUT, id_col: str = "doc_id") -> DataFrame:
    """Append docs to the table at root, compact it, and say where each row is: doc_id, shard, shard_bytes, version."""
    table = ShardedTable(docs.sparkSession, root or new_folder(docs.sparkSession, "sharded"))
    table.append(docs)
    version = table.compact(target, fanout)
    rows = table.read(version)
    where = rows.metadataColumn("_metadata")
    return rows.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.regexp_extract(where["file_path"], "([^/]+/[^/]+)$", 1).alias("shard"), where["file_size"].alias("shard_bytes"), F.lit(version).cast("long").alias("version"))


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard(spark.read.parquet(f"{sf_dir}/documents.parquet"))
