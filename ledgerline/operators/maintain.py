"""Keeping tables current as dataflow: matching, de-duplication, upserts, status changes, cascades."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def caseless(text: Column) -> Column:
    return F.collate(text, "UNICODE_CI")


def match_companies(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds match_id to incoming (ticker, name): the stored company with the ticker, else with the name, without regard to case."""
    by_ticker = stored.where("ticker is not null").groupBy(caseless(F.col("ticker")).alias("t")).agg(F.min("id").alias("by_ticker"))
    by_name = stored.groupBy(caseless(F.col("name")).alias("n")).agg(F.min("id").alias("by_name"))
    out = incoming.join(by_ticker, caseless(F.col("ticker")) == F.col("t"), "left").join(by_name, caseless(F.col("name")) == F.col("n"), "left")
    return out.withColumn("match_id", F.coalesce("by_ticker", "by_name")).drop("t", "n", "by_ticker", "by_name")


def first_of_hash(documents: DataFrame) -> DataFrame:
    """Adds first_id, the least id with the same content; a document without a hash is its own first."""
    first = documents.where("file_hash is not null").groupBy("file_hash").agg(F.min("id").alias("first_id"))
    return documents.join(first, "file_hash", "left").withColumn("first_id", F.coalesce("first_id", "id"))


def plan_intake(incoming: DataFrame, stored: DataFrame) -> DataFrame:
    """Adds action: reuse a processed twin (or the batch's first), reprocess a failed one, else new.

    busy: a stored twin that is still being worked on holds the hash, so nothing can be added. Without a hash: new.
    """
    state = F.when(F.col("status") == "processed", 3).when(F.col("status") == "failed", 1).otherwise(2)
    known = stored.groupBy("file_hash").agg(F.max(state).alias("k"))
    out = first_of_hash(incoming).join(known, "file_hash", "left")
    action = F.when(F.col("k") == 3, "reuse").when(F.col("id") != F.col("first_id"), "reuse").when(F.col("k") == 2, "busy").when(F.col("k") == 1, "reprocess").otherwise("new")
    return out.withColumn("action", action).drop("k", "first_id")


def upsert_companies(stored: DataFrame, incoming: DataFrame, given: tuple[str, ...] = ("about", "sector", "ratios_json"), order: str = "new_id") -> DataFrame:
    """Stored companies with the supplied fields of incoming (id null if new, new_id), and the new ones.

    Incoming rows are applied in the order of `order`: of several for one company each field's last supplied value counts,
    and fields that are null or empty leave what is stored. New rows that share a ticker, or a name, without regard to
    case, are one company, with the first one's id, name and ticker. Of `given`, the stored table's columns count; other
    stored columns stay, and are null for new companies.
    """
    given = tuple(c for c in given if c in stored.columns and c in incoming.columns)
    matched = match_companies(incoming, stored)
    supplied = {c: F.max_by(c, F.when(F.nullif(c, F.lit("")).isNotNull(), F.col(order))) for c in given}
    last = [supplied[c].alias(f"new_{c}") for c in given]
    fresh = matched.where("match_id is not null").groupBy(F.col("match_id").alias("m")).agg(*last)
    kept = stored.join(fresh, F.col("id") == F.col("m"), "left").select(*(F.coalesce(f"new_{c}", c).alias(c) if c in given else F.col(c) for c in stored.columns))

    new = matched.where("match_id is null").withColumn("root", F.col(order))
    for key in ("ticker", "name", "ticker"):  # rows that share one of these have the least root
        value = F.nullif(F.col(key), F.lit(""))
        least = new.where(value.isNotNull()).groupBy(caseless(value).alias("k")).agg(F.min("root").alias("r"))
        new = new.join(least, caseless(value) == F.col("k"), "left").withColumn("root", F.least("root", F.coalesce("r", "root"))).drop("k", "r")
    made = new.groupBy("root").agg(F.min_by("new_id", order).alias("id"), F.min_by("name", order).alias("name"), F.min_by("ticker", order).alias("ticker"), *(F.coalesce(supplied[c], F.max_by(c, order)).alias(f"new_{c}") for c in given))
    rest = [F.col(f"new_{c}").alias(c) if c in given else F.col(c) if c in ("id", "name", "ticker") else F.lit(None).cast(stored.schema[c].dataType).alias(c) for c in stored.columns]
    return kept.unionByName(made.select(*rest))


def set_status(documents: DataFrame, changes: DataFrame) -> DataFrame:
    """Applies changes (id, new_status, at), the latest of each id: at is taken where the new status is a final one, else what is stored stays."""
    last = changes.groupBy("id").agg(F.max_by(F.struct("new_status", "at"), F.struct("at", "new_status")).alias("c")).select("id", "c.*")
    stored = documents if "processed_at" in documents.columns else documents.withColumn("processed_at", F.lit(None).cast(changes.schema["at"].dataType))
    out = stored.join(last, "id", "left")
    final = F.col("new_status").isin("processed", "failed")
    return out.withColumn("status", F.coalesce("new_status", "status")).withColumn("processed_at", F.coalesce(F.when(final, F.col("at")), "processed_at")).drop("new_status", "at")


def look_up(keys: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, key, id): the rows of each kind's table (key, id) that the asked-for keys (kind, key) have; keys compare without regard to case."""
    out = []
    for kind, rows in tables.items():
        asked = keys.where(F.col("kind") == kind).select("kind", "key").distinct()
        out.append(asked.join(rows.select(caseless(F.col("key").cast("string")).alias("k"), "id"), caseless(F.col("key")) == F.col("k")).select("kind", "key", "id"))
    return reduce(DataFrame.unionByName, out)


def audit_rows(documents: DataFrame, counts: DataFrame) -> DataFrame:
    """Log rows (document_id, stage, status, message) of documents (id, file_name, file_hash, status), derived from what their stages made.

    `counts` has document_id, n_chunks, n_risks and n_metrics. A failed document has its failure only.
    """
    d = documents.join(counts.withColumnRenamed("document_id", "id"), "id", "left").fillna(0, ["n_chunks", "n_risks", "n_metrics"])
    ok = F.col("status") == "processed"
    row = lambda stage, status, message: F.struct(F.lit(stage).alias("stage"), status.alias("status"), message.alias("message"))
    got = row("download_and_hash", F.when(F.col("status") == "failed", "failed").otherwise("success"), F.concat(F.lit("Downloaded "), "file_name", F.lit(" with hash "), F.coalesce(F.left("file_hash", F.lit(16)), F.lit(""))))
    made = row("graph_ingestion", F.lit("success"), F.concat("n_chunks", F.lit(" chunks, "), "n_metrics", F.lit(" metrics, "), "n_risks", F.lit(" risks")))
    return d.select(F.col("id").alias("document_id"), F.inline(F.when(ok, F.array(got, made)).otherwise(F.array(got))))


def without(children: DataFrame, gone: DataFrame, key: str = "document_id") -> DataFrame:
    """Children whose parent isn't among gone (id)."""
    return children.join(gone.select(F.col("id").alias(key)), key, "left_anti")


def orphaned(logs: DataFrame, documents: DataFrame) -> DataFrame:
    """Logs with document_id null where the document is no more."""
    alive = documents.select(F.col("id").alias("d"))
    out = logs.join(alive, F.col("document_id") == F.col("d"), "left")
    return out.withColumn("document_id", F.col("d")).drop("d")


def latest(rows: DataFrame, key: str, order: str) -> DataFrame:
    """The row with the largest `order` per key; no window, so partial aggregation runs before the shuffle."""
    rest = [c for c in rows.columns if c != key]
    return rows.groupBy(key).agg(F.max_by(F.struct(*rest), order).alias("r")).select(key, "r.*")


def ranked(rows: DataFrame, key: str, *order) -> DataFrame:
    return rows.withColumn("nth", F.row_number().over(Window.partitionBy(key).orderBy(*order)))
