"""Tables whose rows hold from one version to another: append-only, read as of any version.

A commit replaces the rows of a scope (such as the files that changed) by new ones and makes one version of it. What it
writes is only what differs: rows that came (`added`) and rows that went (`removed`), each in a folder of the
version; the version counts once it stands in the log, which is written last. A commit of a batch that the log has already does
nothing, so that a batch can be run again.

Rows are sets: equal rows are one, known by 128 bits of all their columns. A version before the first is empty; a
later one than the last is the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from loomspark.sources.scratch import by_size, stored

HASH = ["x_a", "x_b"]


class Versions:
    """A versioned table with the given columns and key, in a folder."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: list[str]):
        self.spark, self.path, self.key = spark, path, key
        self.schema = StructType.fromDDL(schema) if isinstance(schema, str) else schema
        self.columns = self.schema.fieldNames()

    def _table(self, kind: str, schema: str) -> DataFrame:
        self._make(kind)
        return self.spark.read.schema(schema).option("basePath", f"{self.path}/{kind}").parquet(f"{self.path}/{kind}")

    def _make(self, kind: str) -> None:
        where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{kind}")
        where.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).mkdirs(where)

    def log(self) -> DataFrame:
        """(version, batch) of every commit."""
        return self._table("log", "version long, batch long")

    def latest(self) -> int:
        return self.log().agg(F.max("version")).first()[0] or 0

    def _added(self) -> DataFrame:
        columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in self.schema.fields)
        return self._table("added", f"{columns}, x_a long, x_b long, version long")

    def _removed(self) -> DataFrame:
        kinds = {f.name: f.dataType.simpleString() for f in self.schema.fields}
        return self._table("removed", ", ".join(f"`{k}` {kinds[k]}" for k in self.key) + ", x_a long, x_b long, since long, version long")

    def _hashed(self, rows: DataFrame) -> DataFrame:
        # nulls leave no trace in these hashes, so their places go in too
        values = [*self.columns, F.concat(*[F.isnull(c).cast("int").cast("string") for c in self.columns])]
        return rows.select(*self.columns, F.xxhash64(*values).alias("x_a"), F.xxhash64(F.lit(1), *values).alias("x_b"))

    def _rows(self, version: int | None = None, scope: DataFrame | None = None) -> DataFrame:
        """The rows of a version with their hashes and the version that added them; with a scope those that agree with one of its rows."""
        last = self.latest()
        version = last if version is None else min(version, last)
        added, gone = (rows.filter(F.col("version") <= version) for rows in (self._added(), self._removed()))
        if scope is not None:  # before what is gone is looked for
            scope = by_size(scope.distinct())
            added = added.join(scope, scope.columns, "left_semi")
            gone = gone.join(scope, scope.columns, "left_semi") if set(scope.columns) <= set(self.key) else gone
        gone = gone.select(*HASH, F.col("since").alias("version"))
        return added.join(by_size(gone), [*HASH, "version"], "left_anti")

    def as_of(self, version: int | None = None) -> DataFrame:
        return self._rows(version).select(*self.columns)

    def history(self) -> DataFrame:
        """All rows with valid_from and valid_to, the first version in which a row no longer holds (null: it still does)."""
        last = self.latest()
        added = self._added().filter(F.col("version") <= last).withColumnRenamed("version", "valid_from")
        gone = self._removed().filter(F.col("version") <= last).select(*HASH, F.col("since").alias("valid_from"), F.col("version").alias("valid_to"))
        return added.join(by_size(gone), [*HASH, "valid_from"], "left").select(*self.columns, "valid_from", "valid_to")

    def commit(self, new: DataFrame, scope: DataFrame | None, batch: int | None = None, distinct: bool = False) -> int:
        """Rows that agree with one of scope (on all its columns; None: all rows) become `new`, of which the caller may know that no two are equal (distinct); returns the version."""
        known = self.log().filter(F.col("batch") == batch).agg(F.max("version")).first()[0] if batch is not None else None
        if known:
            return known
        version = self.latest() + 1
        came, went = f"{self.path}/added/version={version}", f"{self.path}/removed/version={version}"
        new = self._hashed(new) if distinct else self._hashed(new).distinct()
        if version == 1:  # there is nothing that could go
            new.write.mode("overwrite").parquet(came)
        else:
            old, new = stored(self._rows(scope=scope), "old"), stored(new, "new")
            new.join(by_size(old.select(*HASH)), HASH, "left_anti").write.mode("overwrite").parquet(came)
            gone = old.join(by_size(new.select(*HASH)), HASH, "left_anti").select(*self.key, *HASH, F.col("version").alias("since"))
            gone.write.mode("overwrite").parquet(went)
        self.spark.createDataFrame([(version, batch)], "version long, batch long").coalesce(1).write.mode("append").parquet(f"{self.path}/log")
        return version

    def changes(self, before: int, after: int) -> DataFrame:
        """(key, status, old, new): keys whose row was added, removed or changed from one version to another; only keys that a commit in between touched are compared. Each key has one row in a version."""
        between = (F.col("version") > before) & (F.col("version") <= after)
        touched = self._added().filter(between).select(*self.key).union(self._removed().filter(between).select(*self.key)).distinct()
        side = lambda v, name: self._rows(v).join(touched, self.key, "left_semi").select(*self.key, F.struct(*self.columns, *HASH).alias(name))
        both = side(before, "old").join(side(after, "new"), self.key, "full")
        status = F.when(F.col("old").isNull(), "added").when(F.col("new").isNull(), "removed").otherwise("changed")
        differ = F.col("old").isNull() | F.col("new").isNull() | (F.col("old.x_a") != F.col("new.x_a")) | (F.col("old.x_b") != F.col("new.x_b"))
        return both.filter(differ).select(*self.key, status.alias("status"), "old", "new")


def last_of_each(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row of each key with the highest order; of equal ones the greatest row."""
    values = [c for c in rows.columns if c not in (key, order)]
    best = rows.groupBy(key).agg(F.max(F.struct(order, *values)).alias("x_best"))
    return best.select(key, "x_best.*")

