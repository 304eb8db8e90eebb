"""A small JSON file that names what counts, replaced as a whole."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Pointer:
    def __init__(self, spark: SparkSession, at: str):
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._at, self._new = self._path(at), self._path(f"{at}.new")
        self._fs = self._at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def read(self, default: dict) -> dict:
        """What was switched to last. A switch that broke off after the old file was deleted counts; one whose file isn't whole doesn't."""
        for at in (self._at, self._new):
            if self._fs.exists(at):
                stream = self._fs.open(at)
                try:
                    return json.loads(bytes(stream.readAllBytes()).decode())
                except json.JSONDecodeError:
                    pass
                finally:
                    stream.close()
        return default

    def switch(self, now: dict) -> None:
        stream = self._fs.create(self._new, True)
        stream.write(bytearray(json.dumps(now).encode()))
        stream.close()
        if not self._fs.rename(self._new, self._at):  # file systems that don't replace a file by renaming
            self._fs.delete(self._at, False)
            self._fs.rename(self._new, self._at)
