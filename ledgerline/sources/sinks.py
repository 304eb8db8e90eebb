"""Tables written out and read back: appended batches, replaced partitions, CSV by ticker, graphs as JSON lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.graph import first_edges, upsert_nodes, valid_edges

CSV_COLUMNS = ["period", "revenue", "revenue_growth", "net_profit", "profit_growth", "operating_profit", "operating_margin", "eps", "currency"]
NODE = "id string, label string, type string, color string, size int, company_id long, properties string"
EDGE = "id string, source string, target string, label string, company_id long, properties string"


def append(rows: DataFrame, table: str, *by: str) -> None:
    """Add a batch of rows in one write, partitioned by the given columns. A batch of no rows adds nothing."""
    rows.write.mode("append").partitionBy(*by).parquet(table)


def replace(rows: DataFrame, table: str, *by: str) -> None:
    """Write rows in place of the partitions that they fall into; other partitions stay."""
    rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(table)


def write_csv(rows: DataFrame, folder: str, columns: list[str] = CSV_COLUMNS) -> None:
    """A folder with one CSV file for each ticker, with a header; nulls are empty. Without rows there is one file with the header alone."""
    options = {"header": True, "quoteAll": False, "emptyValue": "", "nullValue": ""}
    if rows.isEmpty():
        rows.select(*columns).limit(0).coalesce(1).write.mode("overwrite").options(**options).csv(folder)
    else:
        tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))  # the number of files, not of bytes, is the work: tasks aren't merged
        rows.select("ticker", *columns).repartition(tasks, "ticker").write.mode("overwrite").partitionBy("ticker").options(**options).csv(folder)


def read_csv(spark: SparkSession, folder: str, columns: list[str] = CSV_COLUMNS) -> DataFrame:
    """(ticker, columns) of write_csv's folders, all as text."""
    return spark.read.schema(", ".join(f"{c} string" for c in [*columns, "ticker"])).option("header", True).csv(folder).select("ticker", *columns)


def save_graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    """JSON lines under nodes/ and edges/, and one line with version, time and counts under summary/."""
    line = lambda rows: F.to_json(F.struct(*rows.columns)).alias("value")
    nodes.select(line(nodes)).write.mode("overwrite").text(f"{folder}/nodes")
    edges.select(line(edges)).write.mode("overwrite").text(f"{folder}/edges")
    spark = nodes.sparkSession
    types = spark.read.schema(NODE).json(f"{folder}/nodes").groupBy("type").agg(F.count("*").alias("n"))
    total = spark.read.schema(EDGE).json(f"{folder}/edges").agg(F.count("*").alias("total_edges"))
    counts = types.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total_nodes"), F.map_from_entries(F.array_sort(F.collect_list(F.struct("type", "n")))).alias("nodes_by_type"))
    summary = counts.crossJoin(total).select(F.lit("2.0").alias("version"), F.current_timestamp().alias("updated_at"), F.struct("total_nodes", "total_edges", "nodes_by_type").alias("summary"))  # one row each
    summary.coalesce(1).write.mode("overwrite").json(f"{folder}/summary")


def load_graph(spark: SparkSession, folder: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of save_graph's files, with the rules for nodes and edges applied again: lines that repeat an id count once."""
    nodes = upsert_nodes(spark.read.schema(NODE).json(f"{folder}/nodes").withColumn("seq", F.lit(0)))
    edges = spark.read.schema(EDGE).json(f"{folder}/edges").drop("id").withColumn("seq", F.lit(0))
    return nodes, first_edges(valid_edges(edges, nodes))
