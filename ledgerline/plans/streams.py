"""Queries of the streaming operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.values import RISKS
from ..sources.domain import Domain
from ..sources.scratch import shared_path
from ..streaming.graph import run_graph
from ..streaming.intake import run_intake
from .catalog import query, quoted, short_money
from .filings import RISK_CTES
from .graphs import base_tables


def _taken_in(d: Domain) -> dict[str, DataFrame]:
    """The stream reads the folder, and of its files those of `documents`, be it one file or a folder of parts."""
    return run_intake(d.spark, d.folder, d.table("documents").schema, shared_path(d.spark, "intake"), "documents.parquet")


@query("select file_hash, any_value(strlen(text))::bigint n_bytes from reports group by 1")
def stream_intake(d: Domain) -> DataFrame:
    return _taken_in(d)["stored"].select("file_hash", "n_bytes")


_HIT = " + ".join(f"bool_or(regexp_matches(low, {quoted(p)}))::int" for _, p in RISKS)


@query(rf""", firsts as (select min(doc_id) id, trim(regexp_replace(any_value(coalesce(text, '')), '\s+', ' ', 'g')) t from documents group by sha256(coalesce(text, ''))),
raw as (select id, (off // 2000 + 1)::int page_number, substr(t, off + 1, 2000) as text from (select *, unnest(range(0, greatest(length(t), 1), 2000)) off from firsts)),
cuts as (select id, count(*) n from (select id, trim(substr(text, off + 1, 1000)) c from (select *, unnest(range(0, length(text), 850)) off from raw where page_number <= 60)) where length(c) >= 50 group by 1),
found as (select id, {_HIT} k from (select *, lower(text) low from raw) where not (contains(low, 'table of contents') or contains(low, 'index') and length(text) < 300) group by 1)
select id document_id, coalesce(n, 0)::bigint n_chunks, least(6, greatest(1, coalesce(k, 0)))::bigint n_risks,
  coalesce(n, 0) || ' chunks, 0 metrics, ' || least(6, greatest(1, coalesce(k, 0))) || ' risks' message from firsts left join cuts using (id) left join found using (id)""")
def stream_tables(d: Domain) -> DataFrame:
    """What the stream stored of each document: chunks, risks and the last log row."""
    t = _taken_in(d)
    count = lambda name, out: t[name].groupBy("document_id").agg(F.count("*").alias(out))
    logs = t["logs"].where("stage = 'graph_ingestion' and status = 'success'").select("document_id", "message")
    out = t["stored"].select(F.col("doc_id").alias("document_id")).join(count("chunks", "n_chunks"), "document_id", "left").join(count("risks", "n_risks"), "document_id", "left")
    return out.fillna(0).join(logs, "document_id", "left")


@query("""select 'comp_' || id id, 'company' as type, upper(ticker) label from companies union all
select 'fin_' || company_id || '_' || period, 'metric', period from fin where company_id in (select id from companies) union all
select 'comp_' || company_id || '_REPORTED_FINANCIALS_fin_' || company_id || '_' || period, 'edge', 'REPORTED_FINANCIALS' from fin where company_id in (select id from companies)""")
def graph_stream(d: Domain) -> DataFrame:
    """A graph grown by a stream of companies with their periods, in four files; metrics have the fallback id company_period."""
    source, folder = shared_path(d.spark, "changed"), shared_path(d.spark, "graph_stream")
    periods = d.financial().groupBy("company_id").agg(F.collect_list("period").alias("periods"))
    changed = d.companies().join(periods, F.col("id") == F.col("company_id"), "left").select("id", F.upper("ticker").alias("ticker"), "periods")
    changed.repartition(4, "id").write.parquet(source)

    def derive(batch: DataFrame) -> tuple[DataFrame, DataFrame]:
        company = F.concat(F.lit("comp_"), "id")
        metric = batch.select("id", company.alias("source"), F.explode("periods").alias("period")).withColumn("fin", F.concat(F.lit("fin_"), "id", F.lit("_"), "period"))
        node = lambda rows, ident, label, kind, seq: rows.select(ident.alias("id"), label.alias("label"), F.lit(kind).alias("type"), F.lit("").alias("color"), F.lit(0).alias("size"), F.col("id").cast("long").alias("company_id"), F.lit("{}").alias("properties"), F.lit(seq).alias("seq"))
        nodes = node(batch, company, F.col("ticker"), "company", 0).unionByName(node(metric, F.col("fin"), F.col("period"), "metric", 1))
        edges = metric.select("source", F.col("fin").alias("target"), F.lit("REPORTED_FINANCIALS").alias("label"), F.col("id").cast("long").alias("company_id"), F.lit("{}").alias("properties"), F.lit(2).alias("seq"))
        return nodes, edges

    nodes, edges = run_graph(d.spark, source, changed.schema, folder, derive, files_per_batch=2)
    return nodes.select("id", "type", "label").unionByName(edges.select("id", F.lit("edge").alias("type"), "label"))


_KEYED = "company_id || '_' || period"


@query(f""", {RISK_CTES}, rk as (select p.company_id, risk, min(page_number) page_number from all_risks a join reports p on p.id = a.document_id where p.company_id in (select id from companies) group by 1, 2),
call as (select *, document_type = 'concall_transcript' or contains(lower(file_name), 'concall') c from docs where company_id in (select id from companies)), f as (from fin where company_id in (select id from companies))
select 'comp_' || id id, 'company' as type, upper(ticker) label from companies
union all select 'doc_' || id, 'document', case when c then 'Concall ' else 'Report ' end || report_period from call
union all select 'fin_' || {_KEYED}, 'metric', period || ': ' || {short_money('revenue')} from f
union all select distinct 'risk_' || company_id || '_' || left(risk, 6), 'risk', '⚠️ ' || case when length(risk) > 16 then left(risk, 16) || '..' else risk end || ' (p.' || page_number || ')' from rk
union all select 'comp_' || company_id || '_' || case when c then 'CONCALL_FILED' else 'ANNUAL_FILING' end || '_doc_' || id, 'edge', case when c then 'CONCALL_FILED' else 'ANNUAL_FILING' end from call
union all select 'comp_' || company_id || '_REPORTED_FINANCIALS_fin_' || {_KEYED}, 'edge', 'REPORTED_FINANCIALS' from f
union all select distinct 'comp_' || company_id || '_HAS_RISK_risk_' || company_id || '_' || left(risk, 6), 'edge', 'HAS_RISK' from rk""")
def graph_deltas(d: Domain) -> DataFrame:
    """A graph grown by a stream of companies with their documents, metrics and risks in ten batches, folded on the way.

    Metrics and risks come without ids. Of a company's risks of one category the first page is sent.
    """
    source, folder = shared_path(d.spark, "changed"), shared_path(d.spark, "graph_deltas")
    t = base_tables(d, ("document", "metric", "risk"))
    no_id = F.lit(None).cast("long").alias("id")
    none = lambda kind: F.lit(None).cast(kind)
    gather = lambda rows, name, *columns: rows.groupBy(F.col("company_id").alias("id")).agg(F.collect_list(F.struct(*columns)).alias(name))
    docs = gather(t["document"], "documents", "id", "file_name", "document_type", "report_period", "file_hash", "status")
    metrics = gather(t["metric"], "financial_data", no_id, "period", "revenue", "revenue_growth", "net_profit", "operating_margin", none("decimal(10,4)").alias("eps"), "currency")
    first = t["risk"].groupBy("company_id", "risk").agg(F.min("page_number").cast("int").alias("page_number"))
    risks = gather(first, "risks", no_id, "risk", none("string").alias("description"), "page_number", none("string").alias("source_doc"))
    changed = d.companies().select("id", "name", "ticker", "website").join(docs, "id", "left").join(metrics, "id", "left").join(risks, "id", "left")
    wide = max(2, d.spark.sparkContext.defaultParallelism)  # files of a batch: each is read by a task of its own
    changed.repartition(10 * wide, "id").write.parquet(source)
    nodes, edges = run_graph(d.spark, source, changed.schema, folder, files_per_batch=wide)
    return nodes.select("id", "type", "label").unionByName(edges.select("id", F.lit("edge").alias("type"), "label"))
