"""A store of table versions: each change writes a new folder, then one small file names it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..scratch import get_text, put_text, remove


class Store:
    """Tables below ``path``, on any file system that Spark reads. One writer at a time.

    A version is a folder of Parquet files; ``CURRENT`` names it and the versions that are still kept.  It is replaced by one
    overwriting rename, so readers see the old version or the new one, and a failed write leaves the old one in place.  The last
    ``keep`` versions stay for readers that still hold them; older ones are removed.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3) -> None:
        self.spark, self.path, self.keep = spark, path.rstrip("/"), max(1, keep)

    def _versions(self, table: str) -> list[str]:
        return (get_text(self.spark, f"{self.path}/{table}/CURRENT") or "").split()

    def version(self, table: str) -> str | None:
        """The name of the current version; None for a table that was never written."""
        return next(iter(self._versions(table)), None)

    def read(self, table: str, schema: str) -> DataFrame:
        """The current version, or an empty table of ``schema``; columns that the version lacks are null."""
        v = self.version(table)
        return self.spark.read.schema(schema).parquet(f"{self.path}/{table}/{v}") if v else self.spark.createDataFrame([], schema)

    def write(self, table: str, df: DataFrame, partition_by: list[str] | None = None) -> str:
        v = f"v-{uuid.uuid4().hex}"
        out = df.write
        (out.partitionBy(*partition_by) if partition_by else out).parquet(f"{self.path}/{table}/{v}")
        versions = [v, *self._versions(table)]
        put_text(self.spark, f"{self.path}/{table}/CURRENT", "\n".join(versions[: self.keep]))
        for old in versions[self.keep :]:
            remove(self.spark, f"{self.path}/{table}/{old}")
        return v

    def append(self, table: str, df: DataFrame) -> None:
        """Rows added to the current version's folder."""
        v = self.version(table)
        if v is None:
            self.write(table, df)
        else:
            df.write.mode("append").parquet(f"{self.path}/{table}/{v}")

    def migrate(self, table: str, schema: str) -> list[str]:
        """Brings a table to ``schema``: creates it empty, or writes it anew with the columns it lacks as nulls; what was changed.

        Columns that ``schema`` doesn't name are kept.
        """
        wanted = self.spark.createDataFrame([], schema)
        v = self.version(table)
        if v is None:
            self.write(table, wanted)
            return [f"{table} created"]
        stored = self.spark.read.parquet(f"{self.path}/{table}/{v}")
        missing = [f for f in wanted.schema.fields if f.name not in stored.columns]
        if missing:
            self.write(table, stored.withColumns({f.name: F.lit(None).cast(f.dataType) for f in missing}))
        return [f"{table}.{f.name} added" for f in missing]
