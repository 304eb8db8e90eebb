"""Changed companies as graph increments, and baseline companies that join a graph which lacks them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import COLORS
from ..sources.scratch import staged
from .graph import edge_rows, find_companies, first_edges, node_rows, upsert_nodes, valid_edges

#: A changed company with what is known of it; all but its name may be missing.
CHANGE = (
    "id long, name string, ticker string, website string, "
    "documents array<struct<id: long, file_name: string, document_type: string, report_period: string, file_hash: string, status: string>>, "
    "financial_data array<struct<id: long, period: string, revenue: decimal(20,4), revenue_growth: decimal(10,4), net_profit: decimal(20,4), operating_margin: decimal(10,4), eps: decimal(10,4), currency: string>>, "
    "risks array<struct<id: long, risk: string, description: string, page_number: int, source_doc: string>>"
)


def company_changes(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of changed companies (CHANGE): companies, their documents, metrics and risks, and the edges to these.

    What has no id gets one of its company's: company_file, company_period or company_ and a risk's first six letters. Of
    entries of a list with one id the later one's node and the first one's edge count.
    """
    text = lambda c, default: F.coalesce(c, F.lit(default))
    name = lambda c, n: c.alias(n)
    cid = F.coalesce(F.col("id"), F.lit(999).cast("long"))
    own = batch.withColumn("company_id", cid).withColumn("ticker", S.ticker_or_name(F.col("ticker"), F.col("name")))
    of = lambda column: own.select("company_id", F.posexplode_outer(column).alias("pos", "x")).where("x is not null").select("company_id", F.col("pos").cast("long").alias("seq"), "x.*")
    ident = lambda *rest: F.coalesce(F.col("id").cast("string"), F.concat(F.col("company_id"), F.lit("_"), *rest))
    source = F.concat(F.lit("comp_"), "company_id")

    docs = of("documents").withColumn("key", ident(text(F.col("file_name"), "doc"))).withColumn("period", text(F.nullif("report_period", F.lit("")), "Latest"))
    call = S.is_concall(F.col("document_type"), F.col("file_name"))
    fin = of("financial_data").withColumn("period", text(F.col("period"), "Latest")).withColumn("currency", text(F.col("currency"), "USD"))
    fin = fin.withColumn("key", ident(F.col("period"))).withColumn("shown", S.money_short(F.col("revenue"), F.col("currency")))
    risks = of("risks").withColumn("risk", text(F.col("risk"), "Risk Factor")).withColumn("page", F.coalesce("page_number", F.lit(1)))
    risks = risks.withColumn("key", ident(F.left("risk", F.lit(6))))

    document = [name(F.col("key"), "document_id"), "company_id", name(text(F.col("file_name"), "report.pdf"), "file_name"), name(text(F.col("document_type"), "annual_report"), "document_type"), "period", name(text(F.col("file_hash"), ""), "file_hash"), name(text(F.col("status"), "processed"), "status")]
    metric = [
        name(F.col("key"), "metric_id"), "company_id", "period", "revenue", name(F.col("shown"), "revenue_formatted"), "revenue_growth", name(S.percent(F.col("revenue_growth"), "+"), "revenue_growth_pct"),
        "net_profit", "operating_margin", name(S.percent(F.col("operating_margin")), "operating_margin_pct"), "eps", "currency",
    ]
    risk = [name(F.col("key"), "risk_id"), "company_id", name(F.col("risk"), "category"), name(text(F.col("description"), ""), "description"), name(F.col("page"), "page_number"), name(text(F.col("source_doc"), "Filing.pdf"), "source_doc")]
    color = F.when(call, COLORS["guidance"]).otherwise(COLORS["document"])
    nodes = node_rows(own, "comp_", F.col("company_id"), F.col("ticker"), "company", F.lit(0), ["company_id", "name", "ticker", name(text(F.col("website"), ""), "website")])
    nodes = nodes.unionByName(node_rows(docs, "doc_", F.col("key"), F.concat(F.when(call, "Concall ").otherwise("Report "), "period"), "document", F.col("seq"), document, color=color))
    nodes = nodes.unionByName(node_rows(fin, "fin_", F.col("key"), F.concat("period", F.lit(": "), "shown"), "metric", F.col("seq"), metric))
    nodes = nodes.unionByName(node_rows(risks, "risk_", F.col("key"), S.risk_label(F.col("risk"), F.col("page")), "risk", F.col("seq"), risk))
    to = lambda prefix: F.concat(F.lit(prefix), "key")
    edges = edge_rows(docs, source, to("doc_"), F.when(call, "CONCALL_FILED").otherwise("ANNUAL_FILING"), F.col("seq"), "period")
    edges = edges.unionByName(edge_rows(fin, source, to("fin_"), F.lit("REPORTED_FINANCIALS"), F.col("seq"), "period"))
    edges = edges.unionByName(edge_rows(risks, source, to("risk_"), F.lit("HAS_RISK"), F.col("seq"), name(F.col("risk"), "category"), "page"))
    return nodes.withColumn("seq", F.col("seq").cast("long")), edges.withColumn("seq", F.col("seq").cast("long"))


#: Baseline companies get ids from here on, so that they never take a stored company's.
BASELINE_IDS = 1_000_000_000


def absent(baseline: DataFrame, companies: DataFrame) -> DataFrame:
    """Baseline companies that the cascading lookup of their ticker doesn't find among companies (id, ticker, name); one without a ticker isn't looked up."""
    asked = baseline.where("ticker is not null").select(F.col("ticker").alias("q")).distinct()
    known = find_companies(asked, companies).select(F.col("q").alias("known"))
    return baseline.join(known, F.col("ticker") == F.col("known"), "left_anti")


def add_baseline(nodes: DataFrame, edges: DataFrame, companies: DataFrame, baseline: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) with what `baseline` (CHANGE) tells of companies that `companies` lacks.

    Their ids are moved to a range of their own, and so are those of their documents, metrics and risks. What the graph has stays: a
    baseline node or edge of a stored id is an earlier write of the node and a later one of the edge. An empty baseline adds nothing.
    """
    moved = absent(baseline, companies).withColumn("id", F.col("id") + BASELINE_IDS)
    for entries in ("documents", "financial_data", "risks"):
        moved = moved.withColumn(entries, F.transform(entries, lambda x: x.withField("id", x["id"] + BASELINE_IDS)))
    more_nodes, more_edges = company_changes(staged(moved, "baseline"))
    order = lambda rows, seq: rows.withColumn("seq", F.lit(seq).cast("long"))
    columns = [c for c in nodes.columns if c != "seq"]
    both = order(nodes.select(columns), 1).unionByName(order(more_nodes.select(columns), 0))
    out = staged(upsert_nodes(both), "with-baseline")
    shared = [c for c in more_edges.columns if c != "seq" and c in edges.columns]
    return out, first_edges(valid_edges(order(edges.select(shared), 0).unionByName(order(more_edges.select(shared), 1)), out))
