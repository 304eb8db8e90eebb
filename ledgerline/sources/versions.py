"""Tables of what is derived from documents, replaced together: readers see all of a replacement or none of it.

Each table lies in parts by document, and a part in versions. New versions of the parts that a replacement touches are written
beside the old ones, table by table; then one small file is replaced that says which version of each part counts. A run that fails
between two tables leaves everything as it was, and the next one overwrites what it left.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .pointer import Pointer


class DerivedTables:
    """`schemas` has each table's columns as DDL, document_id long among them."""

    def __init__(self, spark: SparkSession, folder: str, schemas: dict[str, str], parts: int = 16):
        self.spark, self.folder, self.schemas, self.parts = spark, folder, schemas, parts
        self.part = F.pmod(F.xxhash64(F.col("document_id")), F.lit(parts)).cast("int")
        self._pointer = Pointer(spark, f"{folder}/versions")

    def _versions(self) -> dict[int, int]:
        return {int(k): v for k, v in self._pointer.read({}).items()}

    def _counts(self, versions: dict[int, int]) -> Column:
        """Whether a part's version is the one that counts; on partition columns alone, so other folders aren't read."""
        now = F.lit(False)
        for version in sorted(set(versions.values())):
            now = now | ((F.col("version") == version) & F.col("part").isin([p for p, v in versions.items() if v == version]))
        return now

    def _read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        versions = {p: v for p, v in self._versions().items() if parts is None or p in parts}
        kind = f"{self.schemas[name]}, version int, part int"
        if not versions:
            return self.spark.createDataFrame([], kind)
        return self.spark.read.schema(kind).parquet(f"{self.folder}/{name}").where(self._counts(versions))

    def read(self, name: str) -> DataFrame:
        return self._read(name).drop("version", "part")

    def replace(self, documents: DataFrame, rows: dict[str, DataFrame]) -> None:
        """Put `rows` in place of all rows, in every table, of `documents` (document_id); a table that isn't given loses theirs.

        Rows of other documents are refused by the join: they aren't written.
        """
        ids = documents.select("document_id").distinct()
        touched = sorted(r.part for r in ids.select(self.part.alias("part")).distinct().collect())  # `parts` at most
        if not touched:
            return
        versions = self._versions()
        version = max(versions.values(), default=0) + 1
        for name, kind in self.schemas.items():
            columns = [c.split()[0] for c in kind.split(", ")]
            kept = self._read(name, touched).select(columns).join(ids, "document_id", "left_anti")
            new = kept if name not in rows else kept.select(columns).unionByName(rows[name].join(ids, "document_id", "left_semi").select(columns))
            self._write(new.withColumn("part", self.part), name, version)
        self._pointer.switch({str(p): v for p, v in (versions | {p: version for p in touched}).items()})

    def _write(self, rows: DataFrame, name: str, version: int) -> None:
        rows.repartitionById(self.parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}/version={version}")

    def clean(self) -> None:
        """Delete versions that no part counts any more; to be called when no reader of them is left."""
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        used = set(self._versions().values())
        for name in self.schemas:
            fs = path(self.folder).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
            for at in fs.listStatus(path(f"{self.folder}/{name}")) if fs.exists(path(f"{self.folder}/{name}")) else []:
                if int(at.getPath().getName().removeprefix("version=")) not in used:
                    fs.delete(at.getPath(), True)
