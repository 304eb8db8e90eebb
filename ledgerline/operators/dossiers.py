"""Dossiers of all companies: nested, one row a company, or as five tables in folders of company groups."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S


def gathered(rows: DataFrame, name: str, order: list[Column], *fields) -> DataFrame:
    """(company_id, name): the rows' fields as an array of structs in order; partial arrays are put together before the shuffle."""
    entry = F.struct(F.struct(*(c.alias(f"o{i}") for i, c in enumerate(order))).alias("order"), F.struct(*fields).alias("entry"))
    return rows.groupBy("company_id").agg(F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["entry"]).alias(name))


def nested(companies: DataFrame, metrics: DataFrame, risks: DataFrame, documents: DataFrame) -> DataFrame:
    """(id, name, ticker, metrics, risks, documents, currency, latest_period): arrays of structs, by period, page and id; empty where there is nothing.

    One pass over each child. A company is one row; for one whose lists may not fit a row there are the tables of `sheets`.
    """
    fin = gathered(metrics, "metrics", [F.col("period"), F.col("id")], "period", "revenue", "revenue_growth", "net_profit", "operating_margin", "currency")
    risk = gathered(risks, "risks", [F.col("page_number"), F.col("id")], "risk", "description", "page_number", F.col("file_name").alias("source_doc"))
    docs = gathered(documents, "documents", [F.col("id")], "id", "file_name", "document_type", "report_period", "status")
    out = companies.select("id", "name", "ticker")
    for child in (fin, risk, docs):
        out = out.join(child.withColumnRenamed("company_id", "id"), "id", "left")
    filled = [F.coalesce(c, F.array().cast(child.schema[c].dataType)).alias(c) for c, child in (("metrics", fin), ("risks", risk), ("documents", docs))]
    first, last = F.get("metrics", F.lit(0)), F.element_at("metrics", -1)
    out = out.select("id", "name", "ticker", *filled)
    some = F.size("metrics") > 0
    return out.withColumn("currency", F.coalesce(F.when(some, first["currency"]), F.lit("USD"))).withColumn("latest_period", F.coalesce(F.when(some, last["period"]), F.lit("Latest")))


def sheets(companies: DataFrame, metrics: DataFrame, risks: DataFrame, documents: DataFrame, content: DataFrame) -> dict[str, DataFrame]:
    """The five tables of a dossier, each with company_id: overview, metrics, risks, registry and extracted content (document_id, text)."""
    count = lambda rows, name: rows.groupBy("company_id").agg(F.count("*").alias(name))
    last = metrics.groupBy("company_id").agg(F.max("period").alias("latest"), F.max_by("currency", "period").alias("own"))
    c = companies.withColumnRenamed("id", "company_id").join(count(documents, "documents"), "company_id", "left").join(count(risks, "risks"), "company_id", "left").join(last, "company_id", "left")
    overview = c.select("company_id", "name", "ticker", F.coalesce("sector", F.lit("N/A")).alias("sector"), F.coalesce("documents", F.lit(0)).alias("n_documents"), F.coalesce("risks", F.lit(0)).alias("n_risks"), F.coalesce("own", F.lit("USD")).alias("currency"), F.coalesce("latest", F.lit("N/A")).alias("latest_period"))
    period = F.coalesce("latest", F.lit("Latest")).alias("period")
    registry = documents.select("company_id", F.col("id").alias("document_id"), "file_name", F.coalesce("document_type", F.lit("annual_report")).alias("document_type"), F.coalesce("report_period", F.lit("Latest")).alias("report_period"), F.upper("status").alias("status"), F.concat(F.left("file_hash", F.lit(16)), F.lit("...")).alias("hash"))
    return {
        "overview": overview,
        "metrics": metrics.select("company_id", "period", "revenue", "revenue_growth", "net_profit", "operating_profit", "operating_margin", "currency"),
        "risks": risks.join(last.select("company_id", "latest"), "company_id", "left").select("company_id", F.col("id").alias("risk_id"), "risk", "description", "page_number", period),
        "registry": registry,
        "content": content.select("company_id", "document_id", S.truncated(F.col("text")).alias("text")),
    }


def write_sheets(tables: dict[str, DataFrame], folder: str, groups: int = 16) -> None:
    """Each table under its name, in folders of company groups by hash: a company's dossier is read from one folder a table.

    Rows of a group are dealt to the group's tasks by company and row, so that a company with many rows is written by several.
    """
    for name, rows in tables.items():
        grouped = rows.withColumn("company_group", F.pmod(F.xxhash64("company_id"), F.lit(groups)).cast("int"))
        grouped.hint("rebalance", "company_group").write.mode("overwrite").partitionBy("company_group").parquet(f"{folder}/{name}")


def company_sheet(sheet: DataFrame, company_id: int, groups: int = 16) -> DataFrame:
    """One company's rows of a table that write_sheets wrote; only its group's folder is read."""
    group = F.pmod(F.xxhash64(F.lit(company_id).cast(sheet.schema["company_id"].dataType)), F.lit(groups)).cast("int")
    return sheet.where((F.col("company_group") == group) & (F.col("company_id") == company_id)).drop("company_group")
