"""Tables that grow by batches: each batch is a delta of few files, and deltas are folded together before they become many.

A table has parts, by the hash of a key, so that a reader of some keys opens their parts only. Under its folder lie `base`,
`recent` and single deltas, each with one file a part; a small file `current` names the base and the recent folder that count and
the last batch that they hold. Once there are MOST deltas, or a run ends, the deltas and `recent` are folded into a new `recent`;
when that is more than half as large as the base, all is folded into a new base. A lone delta of a table in which every row counts
isn't written again: its folder becomes the new one. So at rest a part has two files at most, while
batches come MOST more, and a row is written again some few times for each doubling of the table, however many batches there were.

A new folder is complete before `current` is replaced, and what it replaces is deleted after; a run that breaks off between leaves
the table as it was, and the next one begins anew. A batch that runs again overwrites its own delta, or, if that is folded
already, changes nothing.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.pointer import Pointer

MOST = 8


class Deltas:
    """`schema` is the rows' as DDL; they also get `batch` long. `fold` gives, of all rows so far, those that still count."""

    def __init__(self, spark: SparkSession, folder: str, schema: str, key: Column, parts: int = 16, fold: Callable[[DataFrame], DataFrame] | None = None, most: int = MOST):
        self.spark, self.folder, self.most, self.parts = spark, folder, most, parts
        self.schema, self.fold, self._folds = f"{schema}, batch long", fold or (lambda rows: rows), fold is not None
        self.part = F.pmod(F.xxhash64(key), F.lit(parts)).cast("int")
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._pointer = Pointer(spark, f"{folder}/current")
        self._path, self._fs = path, path(folder).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    # what is there

    def _current(self) -> dict:
        return self._pointer.read({"base": None, "recent": None, "upto": -1})

    def _complete(self, name: str) -> bool:
        return self._fs.exists(self._path(f"{self.folder}/{name}/_SUCCESS"))

    def _deltas(self, after: int) -> list[int]:
        """Batches with a complete delta that isn't folded yet."""
        if not self._fs.exists(self._path(self.folder)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._path(self.folder))]
        return sorted(n for n in (int(x[6:]) for x in names if x.startswith("delta-")) if n > after and self._complete(f"delta-{n}"))

    def _read(self, names: list[str], parts: list[int] | None) -> DataFrame:
        kind = f"{self.schema}, part int"
        if not names:
            return self.spark.createDataFrame([], kind)
        rows = [self.spark.read.schema(kind).parquet(f"{self.folder}/{name}") for name in names]
        return reduce(DataFrame.unionByName, [r if parts is None else r.where(F.col("part").isin(parts)) for r in rows])

    def rows(self, parts: list[int] | None = None) -> DataFrame:
        """All rows of some parts (None: of all), folded or not."""
        now = self._current()
        names = [n for n in (now["base"], now["recent"]) if n] + [f"delta-{n}" for n in self._deltas(now["upto"])]
        return self._read(names, parts)

    def read(self, parts: list[int] | None = None) -> DataFrame:
        """The rows that count, with their batch."""
        return self.fold(self.rows(parts).drop("part"))

    def parts_of(self, keys: DataFrame) -> list[int]:
        """The parts, `parts` at most, that rows with these keys are in."""
        return sorted(r.part for r in keys.select(self.part.alias("part")).distinct().collect())

    def files(self) -> dict[str, int]:
        """Data files by part."""
        out: dict[str, int] = {}
        walk = self._fs.listFiles(self._path(self.folder), True)
        while walk.hasNext():
            at = walk.next().getPath()
            if at.getName().endswith(".parquet"):
                part = at.getParent().getName()
                out[part] = out.get(part, 0) + 1
        return out

    # changes

    def _write(self, rows: DataFrame, name: str) -> None:
        placed = rows.drop("part").withColumn("part", self.part)
        placed.repartitionById(self.parts, "part").write.mode("overwrite").partitionBy("part").parquet(f"{self.folder}/{name}")

    def append(self, rows: DataFrame, number: int) -> None:
        """Batch `number`'s rows, in place of those that it wrote before."""
        now = self._current()
        if number > now["upto"]:
            self._write(rows.withColumn("batch", F.lit(number).cast("long")), f"delta-{number}")
            if len(self._deltas(now["upto"])) >= self.most:
                self.compact()

    def compact(self) -> None:
        now = self._current()
        deltas = self._deltas(now["upto"])
        if not deltas:
            return
        upto, old = deltas[-1], [n for n in (now["base"], now["recent"]) if n]
        young = ([now["recent"]] if now["recent"] else []) + [f"delta-{n}" for n in deltas]
        size = lambda name: self._fs.getContentSummary(self._path(f"{self.folder}/{name}")).getLength()
        whole = not now["base"] or 2 * sum(map(size, young)) > size(now["base"])
        gone = (old if whole else [n for n in [now["recent"]] if n]) + [f"delta-{n}" for n in deltas]
        sources = old[:1] * whole * bool(now["base"]) + young
        if len(sources) == 1 and not self._folds:
            name = gone.pop()  # one delta of rows that all count: it is the folder as it lies
        else:
            name = f"{'base' if whole else 'recent'}-{upto}"
            self._write(self.fold(self._read(sources, None).drop("part")), name)
        self._pointer.switch({"base": name if whole else now["base"], "recent": None if whole else name, "upto": upto})
        for n in gone:
            self._fs.delete(self._path(f"{self.folder}/{n}"), True)
