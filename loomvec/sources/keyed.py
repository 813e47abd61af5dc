"""Keyed tables on plain Parquet: upsert, insert-if-absent and delete without rewriting what is there.

A commit writes one folder of changed rows (or tombstones) and then a small file, named by the next number, that lists the folders of
which the table now consists. That file is created only if it isn't there, so of two writers one fails and nothing of it is seen. A read takes the last
list, and each key's newest change. After COMPACT_AFTER changes a commit merges them, into one folder of changes while they are few beside the rest,
else into a new whole. All files go through Spark and Hadoop's file system, so any storage that Spark reads will do.
"""

from __future__ import annotations

import json
import uuid
from functools import reduce
from operator import and_

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomvec.sources.schemas import CHANGE_LOG

COMPACT_AFTER = 16
#: Changes are merged into the whole once they hold this share of its bytes.
WHOLE_SHARE = 0.25


def newest(rows: DataFrame, keys: list[str], by: str) -> DataFrame:
    """Each key's row with the largest ``by``; nulls are keys like any other."""
    w = Window.partitionBy(*keys).orderBy(F.col(by).desc())
    return rows.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


class KeyedTable:
    def __init__(self, spark: SparkSession, path: str, schema: StructType, keys: list[str]):
        self.spark, self.path, self.schema, self.keys = spark, str(path).rstrip("/"), schema, keys
        self._p = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._p(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _numbers(self) -> list[int]:
        if not self._fs.exists(self._p(self.path)):
            return []
        names = (s.getPath().getName() for s in self._fs.listStatus(self._p(self.path)))
        return sorted(int(n[2:]) for n in names if n.startswith("c-"))

    def _list(self, number: int) -> list[str]:
        """The table's folders after a commit: the whole one, then changes, oldest first."""
        stream = self._fs.open(self._p(f"{self.path}/c-{number}"))
        try:
            return json.loads(stream.readUTF())
        finally:
            stream.close()

    def folders(self) -> list[str]:
        numbers = self._numbers()
        return self._list(numbers[-1]) if numbers else []

    def _log(self, folders: list[str]) -> DataFrame:
        return self.spark.read.schema(StructType([*self.schema.fields, *CHANGE_LOG.fields])).parquet(*[f"{self.path}/{n}" for n in folders])

    def read(self) -> DataFrame:
        names = self.folders()
        if not names:
            return self.spark.createDataFrame([], self.schema)
        return self._merged(self._log(names[:1]), self._log(names[1:]) if names[1:] else None).select(*self.schema.names)

    def _merged(self, whole: DataFrame, later: DataFrame | None) -> DataFrame:
        """The whole commit's rows but for keys that later ones have changed: only those, few beside the whole, are put in order."""
        whole = whole.where(~F.col("__gone"))
        if later is None:
            return whole
        changed = later.select(*[F.col(k).alias(f"__{k}") for k in self.keys]).distinct()
        same = reduce(and_, (F.col(k).eqNullSafe(F.col(f"__{k}")) for k in self.keys))
        return whole.join(changed, same, "left_anti").unionByName(newest(later, self.keys, "__seq").where(~F.col("__gone")))

    def _bytes(self, folders: list[str]) -> int:
        return sum(self._fs.getContentSummary(self._p(f"{self.path}/{n}")).getLength() for n in folders)

    def _commit(self, rows: DataFrame, gone: bool | None = False, merge: bool = True) -> None:
        """``gone``: whether the rows are tombstones; None if they say so themselves, as ``__gone``. Without ``merge`` no changes are merged, however many."""
        numbers = self._numbers()
        number, names = (numbers[-1] + 1, self._list(numbers[-1])) if numbers else (0, [])
        said = F.col("__gone") if gone is None else F.lit(gone)
        rows = rows.select(*[F.col(f.name).cast(f.dataType).alias(f.name) for f in self.schema], F.lit(number).cast("long").alias("__seq"), said.alias("__gone"))
        folder, after = f"d-{uuid.uuid4().hex}", []
        if names and (not merge or len(names) <= COMPACT_AFTER):
            after = names
        elif names and self._bytes(names[1:]) < WHOLE_SHARE * self._bytes(names[:1]):
            after, rows = names[:1], newest(self._log(names[1:]).unionByName(rows), self.keys, "__seq")
        elif names:
            rows = self._merged(self._log(names[:1]), self._log(names[1:]).unionByName(rows))
        rows.write.parquet(f"{self.path}/{folder}")
        try:
            stream = self._fs.create(self._p(f"{self.path}/c-{number}"), False)
        except Py4JJavaError as e:
            self._fs.delete(self._p(f"{self.path}/{folder}"), True)
            raise RuntimeError(f"another writer has made commit {number} of {self.path}") from e
        stream.writeUTF(json.dumps([*after, folder]))
        stream.close()
        if names and after != names:
            self._clean(numbers)

    def _clean(self, before: list[int]) -> None:
        """At a merge, lists before the last one go, and folders that only they name: a read that began before this merge finds all it needs."""
        kept = {n for number in [before[-1], before[-1] + 1] for n in self._list(number)}
        for number in before[:-1]:
            for n in self._list(number):
                if n not in kept:
                    self._fs.delete(self._p(f"{self.path}/{n}"), True)
        for number in before[:-1]:
            self._fs.delete(self._p(f"{self.path}/c-{number}"), False)

    def upsert(self, rows: DataFrame, last_by: str | None = None, unique: bool = False, merge: bool = True) -> None:
        """Rows take the place of any with their key; of several with one key, the last by ``last_by``. ``unique`` says that there are none.

        A run that makes many commits leaves merging to the next one (``merge``), else the table would be rewritten again and again as it grows.
        """
        self._commit(rows if unique else newest(rows, self.keys, last_by) if last_by else rows.dropDuplicates(self.keys), merge=merge)

    def apply(self, rows: DataFrame) -> None:
        """Upserts and deletes in one commit: rows, one for each key, with ``__gone``."""
        self._commit(rows, None)

    def insert_if_absent(self, rows: DataFrame) -> None:
        self._commit(rows.dropDuplicates(self.keys).join(self.read().select(*self.keys), self.keys, "left_anti"))

    def delete(self, keys: DataFrame) -> None:
        """Remove the rows with these keys; keys that aren't there don't matter."""
        empty = [F.col(f.name) if f.name in self.keys else F.lit(None).cast(f.dataType).alias(f.name) for f in self.schema]
        self._commit(keys.select(*self.keys).distinct().select(*empty), True)
