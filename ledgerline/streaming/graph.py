"""The graph kept up to date by a stream of changed companies: each batch's nodes and edges are merged by the upsert rules."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..operators.changes import CHANGE, company_changes  # noqa: F401  a stream's schema
from ..operators.graph import valid_edges
from ..sources.sinks import EDGE, NODE
from .deltas import Deltas

def _kept(rows: DataFrame, pick: Callable[[Column, Column], Column]) -> DataFrame:
    """A row of each id, picked by (batch, seq), then by its columns. Rows are dealt by id before they are compared, as upsert_nodes does: few ids repeat."""
    rest = [c for c in rows.columns if c != "id"]
    order = ["batch", "seq", *(c for c in rest if c not in ("batch", "seq"))]
    return rows.repartition("id").groupBy("id").agg(pick(F.struct(*rest), F.struct(*order)).alias("r")).select("id", "r.*")


class GraphTable:
    """Nodes and edges under a folder, as tables of deltas. The last write of a node and the first of an edge count."""

    def __init__(self, spark: SparkSession, folder: str, parts: int = 16, most: int = 8):
        self.nodes = Deltas(spark, f"{folder}/nodes", f"{NODE}, seq long", F.col("id"), parts, lambda rows: _kept(rows, F.max_by), most)
        self.edges = Deltas(spark, f"{folder}/edges", f"{EDGE}, seq long", F.col("id"), parts, lambda rows: _kept(rows, F.min_by), most)

    def append(self, nodes: DataFrame, edges: DataFrame, number: int) -> None:
        columns = lambda schema: [c.split()[0] for c in schema.split(", ")]
        self.nodes.append(nodes.select(*columns(NODE), F.col("seq").cast("long").alias("seq")), number)
        keyed = edges.withColumn("id", F.concat_ws("_", "source", "label", "target"))
        self.edges.append(keyed.select(*columns(EDGE), F.col("seq").cast("long").alias("seq")), number)

    def compact(self) -> None:
        self.nodes.compact()
        self.edges.compact()

    def read(self) -> tuple[DataFrame, DataFrame]:
        """(nodes, edges) as of the last batch; edges stay hidden while an end is missing, and come up with it."""
        nodes = self.nodes.read().drop("batch", "seq")
        return nodes, valid_edges(self.edges.read().drop("batch", "seq"), nodes)

    def read_nodes(self, ids: DataFrame) -> DataFrame:
        """The nodes of some ids (id): only their parts are opened."""
        wanted = ids.select("id").distinct()
        return self.nodes.read(self.nodes.parts_of(wanted)).drop("batch", "seq").join(wanted, "id", "left_semi")


def run_graph(
    spark: SparkSession, source: str, schema: T.StructType, folder: str, derive: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = company_changes, files_per_batch: int = 64, parts: int = 16, most: int = 8
) -> tuple[DataFrame, DataFrame]:
    """Merge all new files of `source` into the graph under `folder`; derive(batch) gives the batch's nodes and edges with seq."""
    table = GraphTable(spark, folder, parts, most)

    def take(batch: DataFrame, number: int) -> None:
        batch = batch.persist()
        GraphTable(batch.sparkSession, folder, parts, most).append(*derive(batch), number)
        batch.unpersist()

    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)
    stream.writeStream.foreachBatch(take).option("checkpointLocation", f"{folder}/progress").trigger(availableNow=True).start().awaitTermination()
    table.compact()
    return table.read()
