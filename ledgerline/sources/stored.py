"""Tables of a relational store: read by ranges of a key in parallel, appended in batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ROWS = 200_000  # of a range, about


def read_table(spark: SparkSession, url: str, table: str, key: str = "id", rows: int = ROWS, **options: str) -> DataFrame:
    """A table as of its smallest and largest key, read in ranges of about `rows` keys, each by a query of its own.

    Rows without a key come with the first range. Filters and columns are left to the store. A table without keys is read
    by one query.
    """
    name = spark._jvm.org.apache.spark.sql.jdbc.JdbcDialects.get(url).quoteIdentifier(key)
    bounds = spark.read.jdbc(url, f"(select min({name}) as low, max({name}) as high, count(*) as n from {table}) b", properties=options)
    low, high, n = bounds.toDF("low", "high", "n").first()
    if low is None:
        return spark.read.jdbc(url, table, properties=options)
    return spark.read.jdbc(url, table, column=key, lowerBound=int(low), upperBound=int(high) + 1, numPartitions=max(1, -(-int(n) // rows)), properties=options)


def append_table(rows: DataFrame, url: str, table: str, batch: int = 10_000, connections: int = 16, **options: str) -> None:
    """Add rows in batches over at most `connections` connections; no rows make no change."""
    few = rows.coalesce(connections)
    few.write.mode("append").option("batchsize", batch).jdbc(url, table, properties=options)


def lookup(stored: DataFrame, key: str, values: list) -> DataFrame:
    """Rows with one of a few key values, by a predicate that the store or the file's statistics can use."""
    return stored.where(F.col(key).isin(values))
