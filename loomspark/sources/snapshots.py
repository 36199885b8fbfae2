"""Tables that change by commits: a reader sees the state before a commit or the one after it, never part of one.

A table is a folder. ``data/commit=<id>/part=<name>`` holds the rows that a commit gives to a part (a source, a segment of
an index, a batch of a stream); ``log`` holds a row for each part that a commit sets or removes. A commit first writes its
data, where no reader looks yet, and then appends its log rows as one file, which Spark's committer moves into place at
once: that is the moment at which it counts. A part's rows are those of the last commit that names it. A writer that dies
before leaves the old state and an unused folder, which ``vacuum`` deletes; repeating a commit of a part gives the same
state, so that a batch of a stream may be written again. There is one writer at a time; readers need no lock.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Live parts (a name and a commit each) that are broadcast, by which Spark prunes folders as it reads.
BROADCAST_PARTS = 100_000
LOG = "version bigint, commit string, part string, removed boolean"


def part_name(key: Column) -> Column:
    """A part for each value of a column; null is a part of its own."""
    return F.when(key.isNull(), F.lit("n")).otherwise(F.concat(F.lit("v"), key.cast("string")))


class SnapshotTable:
    def __init__(self, spark: SparkSession, path: str, schema: str | StructType, folders: tuple[str, ...] = ()):
        """``schema``: that of the rows; ``folders``: columns of it that become folders below a part."""
        self.spark, self.path, self.folders = spark, path.rstrip("/"), folders
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema

    def _exists(self, path: str) -> bool:
        jvm = self.spark._jvm
        where = jvm.org.apache.hadoop.fs.Path(path)
        return where.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(where)

    def log(self, version: int | None = None) -> DataFrame:
        if not self._exists(f"{self.path}/log"):
            return self.spark.createDataFrame([], LOG)
        rows = self.spark.read.schema(LOG).parquet(f"{self.path}/log")
        return rows if version is None else rows.where(F.col("version") <= version)

    def version(self) -> int:
        """The last commit's number; 0 of a table without any."""
        return self.log().agg(F.max("version")).first()[0] or 0

    def live(self, version: int | None = None) -> DataFrame:
        """(part, commit, version) of the parts that the state at a version (by default the last) consists of.

        The version stands in the plan, so that what Spark has cached of another state is not taken for this one.
        """
        last = self.log(self.version() if version is None else version).groupBy("part").agg(F.max(F.struct("version", "commit", "removed")).alias("last"))
        # A comparison, so that the planner takes the live parts for a filter of folders.
        return last.where("not last.removed and last.version > 0").select("part", "last.commit", "last.version")

    def read(self, version: int | None = None, versions: bool = False) -> DataFrame:
        """The rows of a state; ``versions``: with the number of the commit that they are from, and their ``part``.

        Folders of other commits are pruned by the join with the live parts.
        """
        live = self.live(version)
        shown = [*(F.col(c) for c in self.schema.fieldNames()), *([F.col("version"), F.col("part")] if versions else [])]
        if not self._exists(f"{self.path}/data"):
            return self.spark.createDataFrame([], self.schema).withColumns({"version": F.lit(0).cast("long"), "part": F.lit("")}).select(*shown)
        schema = StructType([f for f in self.schema if f.name not in self.folders]).add("commit", "string").add("part", "string")
        for c in self.folders:
            schema = schema.add(c, self.schema[c].dataType)
        rows = self.spark.read.schema(schema).option("basePath", f"{self.path}/data").parquet(f"{self.path}/data")
        few = live.count() <= BROADCAST_PARTS
        return rows.join(F.broadcast(live) if few else live, ["commit", "part"]).select(*shown)

    def _write_data(self, rows: DataFrame, commit: str) -> None:
        folder = f"{self.path}/data/commit={commit}"
        rows.select(*(F.col(c) for c in self.schema.fieldNames()), F.col("part")).write.partitionBy("part", *self.folders).parquet(folder)

    def _append_log(self, rows: DataFrame) -> None:
        rows.coalesce(1).write.mode("append").parquet(f"{self.path}/log")

    def commit(self, rows: DataFrame | None, part: Column | str, removed: Iterable[str] | DataFrame = ()) -> int:
        """Set the parts that occur in ``rows`` to those rows and remove the parts ``removed``; the new version.

        ``part``: a column that names each row's part, or one name for all, which is then set even if there are no rows.
        """
        commit, version = uuid.uuid4().hex, self.version() + 1
        gone = removed.select("part") if isinstance(removed, DataFrame) else self.spark.createDataFrame([(p,) for p in removed], "part string")
        changes = gone.withColumn("removed", F.lit(True))
        if rows is not None:
            rows = rows.withColumn("part", F.lit(part) if isinstance(part, str) else part)
            self._write_data(rows, commit)
            if isinstance(part, str):
                parts = self.spark.createDataFrame([(part,)], "part string")
            else:
                written = self.spark.read.schema("part string").option("basePath", f"{self.path}/data/commit={commit}").parquet(f"{self.path}/data/commit={commit}")
                parts = written.select("part").distinct()
            changes = changes.join(parts, "part", "left_anti").unionByName(parts.withColumn("removed", F.lit(False)))
        self._append_log(changes.select(F.lit(version).cast("long").alias("version"), F.lit(commit).alias("commit"), "part", "removed"))
        return version

    def replace(self, rows: DataFrame, key: str, removed: DataFrame | None = None) -> int:
        """Set the rows of every value of ``key`` that occurs, and remove those of the values in ``removed`` (a column of that name)."""
        gone = () if removed is None else removed.select(part_name(F.col(key)).alias("part")).distinct()
        return self.commit(rows, part_name(F.col(key)), gone)

    def vacuum(self) -> list[str]:
        """Delete the folders of commits of which nothing is live; their names. No commit may be under way."""
        if not self._exists(f"{self.path}/data"):
            return []
        live = {r[0] for r in self.live().select("commit").distinct().collect()}
        jvm = self.spark._jvm
        root = jvm.org.apache.hadoop.fs.Path(f"{self.path}/data")
        fs = root.getFileSystem(self.spark._jsc.hadoopConfiguration())
        gone = [p for p in (s.getPath() for s in fs.listStatus(root)) if p.getName().removeprefix("commit=") not in live]
        for p in gone:
            fs.delete(p, True)
        return [p.getName() for p in gone]
