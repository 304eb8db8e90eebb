"""Queries of tables that are written and read back: graphs, CSV, appended batches, replaced partitions, lookups, logs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..operators import dossiers as D
from ..operators import graph as G
from ..operators import maintain as M
from ..operators import text as T
from ..sources import sinks
from ..sources.domain import Domain
from ..sources.scratch import shared_path
from ..sources.versions import DerivedTables
from .catalog import query, short_money
from .filings import RISK_CTES, risk_table
from .graphs import GRAPH_CTES, NODE_PROPERTIES, NUMBERS, SHOWN, base_tables, each_value, graph_tables

_EDGE_VALUES = [
    ("docs", "'comp_' || company_id || '_' || case when document_type = 'concall_transcript' or contains(lower(file_name), 'concall') then 'CONCALL_FILED' else 'ANNUAL_FILING' end || '_doc_' || id", {"period": "report_period"}),
    ("fin", "'comp_' || company_id || '_REPORTED_FINANCIALS_fin_' || id", {"period": "period", "revenue": short_money("revenue")}),
    ("rk", "'comp_' || company_id || '_HAS_RISK_risk_' || id", {"category": "risk", "page": "page_number"}),
    ("gd", "'comp_' || company_id || '_MENTIONS_GUIDANCE_guidance_' || guidance_id", {"category": "category", "period": "period"}),
]


_PROPERTIES = " union all ".join([NODE_PROPERTIES, *(each_value(i, t, v, "edge") for t, i, v in _EDGE_VALUES)])


@query(f", {GRAPH_CTES}, props as ({_PROPERTIES}) select kind, id, k, v from props where v is not null and (kind = 'node' or id in (select id from edge_rows))")
def graph_files(d: Domain) -> DataFrame:
    """The properties of all nodes and edges, after the graph was saved as JSON lines and loaded from the files."""
    folder = shared_path(d.spark, "graph")
    nodes, edges = graph_tables(d)
    sinks.save_graph(nodes, edges.drop("source_type"), folder)
    nodes, edges = sinks.load_graph(d.spark, folder)
    whole = F.when(F.rlike("v", F.lit(r"^-?\d+\.\d+(E-?\d+)?$")), F.col("v").cast("decimal(20,4)").cast("string")).otherwise(F.col("v"))  # numbers with all four decimals
    of = lambda rows, kind: rows.select(F.lit(kind).alias("kind"), "id", F.explode(F.from_json("properties", "map<string,string>")).alias("k", "v")).withColumn("v", whole)
    return of(nodes, "node").unionByName(of(edges, "edge"))


@query(rf""", {GRAPH_CTES}, props as ({_PROPERTIES}) select id node, k as key, case when k in ({NUMBERS}) then 'number' when k = 'ratios' then 'object' else 'string' end kind,
  {SHOWN} as value from props where v is not null and kind = 'node'""")
def node_properties(d: Domain) -> DataFrame:
    """Every stored property of every node, with its kind, as an inspector lists them."""
    return G.properties(graph_tables(d)[0])


_METRICS = """f9 as (select f.*, last_value(nullif(f.net_profit, 0) ignore nulls) over (partition by f.company_id order by period rows between unbounded preceding and 1 preceding) p0 from fin f)"""


@query(f""", {_METRICS} select 'T' || company_id ticker, period, revenue::varchar revenue, revenue_growth::varchar revenue_growth, net_profit::varchar net_profit,
  (case when p0 > 0 then round((net_profit - p0)::double / p0::double, 4)::decimal(10,4) end)::varchar profit_growth, operating_profit::varchar operating_profit, operating_margin::varchar operating_margin, eps::varchar eps, currency from f9""")
def csv_files(d: Domain) -> DataFrame:
    """The nine metric columns written as a folder of CSV for each ticker, and read back as text."""
    before = F.last(F.nullif("net_profit", F.lit(0).cast("decimal(20,4)")), ignorenulls=True).over(Window.partitionBy("company_id").orderBy("period").rowsBetween(Window.unboundedPreceding, -1))
    growth = F.when(before > 0, S.ratio(F.col("net_profit") - before, before))
    rows = d.once("metrics", lambda: d.financial().withColumn("profit_growth", growth).withColumn("ticker", F.concat(F.lit("T"), "company_id")))
    folder = shared_path(d.spark, "csv")
    sinks.write_csv(rows, folder)
    return sinks.read_csv(d.spark, folder)


@query(f""", {RISK_CTES} select r.document_id, p.company_id % 8 part, count(*) n from all_risks r join reports p on p.id = r.document_id group by 1, 2""")
def bulk_append(d: Domain) -> DataFrame:
    """Risks appended to one table in two batches, each a single partitioned write."""
    table, rows = shared_path(d.spark, "risk_rows"), d.once("risks", lambda: risk_table(d)).withColumn("part", F.col("company_id") % 8)
    for rest in (0, 1):
        sinks.append(rows.where(F.col("document_id") % 2 == rest).repartition("part"), table, "part")
    return d.spark.read.parquet(table).groupBy("document_id", F.col("part").cast("long").alias("part")).agg(F.count("*").alias("n"))


@query(f""", {RISK_CTES}, cuts as (select document_id, count(*) n from chunk_rows group by 1) select r.id document_id, r.company_id % 8 part, coalesce(n, 0)::bigint n_chunks, k n_risks, case when r.company_id % 8 < 2 then 2 else 1 end as version
from reports r left join cuts on cuts.document_id = r.id join (select document_id, count(*) k from all_risks group by 1) x on x.document_id = r.id""")
def reprocess_tables(d: Domain) -> DataFrame:
    """Chunks and risks of the companies of two partitions computed again; their partitions are replaced in both tables, the others stay."""
    part = F.col("company_id") % 8
    made = lambda rows, version: rows.withColumn("part", part).withColumn("version", F.lit(version)).repartition("part", F.col("document_id") % 32)  # noqa: E731  a partition is written by many tasks
    tables = {"n_chunks": lambda x: T.chunks(x.page_arrays()), "n_risks": risk_table}
    again = Domain(d.spark, d.folder, only=d.reports().where(part < 2).select(F.col("company_id").alias("id")).distinct())
    counts = []
    for name, build in tables.items():
        path = shared_path(d.spark, name)
        sinks.append(made(build(d), 1), path, "part")
        sinks.replace(made(build(again), 2), path, "part")
        stored = d.spark.read.parquet(path)
        counts.append(stored.groupBy("document_id").agg(F.count("*").alias(name), F.max("version").alias("version")))
    docs = d.reports().select(F.col("id").alias("document_id"), part.alias("part"))
    return docs.join(counts[0].drop("version"), "document_id", "left").fillna(0).join(counts[1], "document_id").select("document_id", "part", "n_chunks", "n_risks", "version")


@query(f""", {RISK_CTES}, asked as (
  select 'ticker' kind, lower(ticker) as key from companies where id % 7 = 0 union all select 'name', upper(name) from companies where id % 7 = 1 union all select 'hash', file_hash from reports where id % 7 = 2
  union all select 'period', report_period from reports where id % 7 = 3 union all select 'risks', id::varchar from reports where id % 7 = 4)
select distinct 'ticker' kind, lower(ticker) as key, id from companies where id % 7 = 0 union all select 'name', upper(name), id from companies where id % 7 = 1
union all select distinct 'hash', file_hash, id from reports where file_hash in (select key from asked where kind = 'hash')
union all select 'period', report_period, id from docs where report_period in (select key from asked where kind = 'period')
union all select 'risks', document_id::varchar, document_id * 10 + n from all_risks where document_id % 7 = 4""")
def lookup_batch(d: Domain) -> DataFrame:
    """Companies by ticker and name, documents by hash and period, risks by document: all keys of a batch at once."""
    companies, reports = d.companies(), d.reports()
    ask = lambda kind, rows, key: rows.select(F.lit(kind).alias("kind"), key.cast("string").alias("key"))
    of = lambda n, rows: rows.where(F.col("id") % 7 == n)
    keys = [ask("ticker", of(0, companies), F.lower("ticker")), ask("name", of(1, companies), F.upper("name")), ask("hash", of(2, reports), F.col("file_hash")), ask("period", of(3, reports), F.col("report_period")), ask("risks", of(4, reports), F.col("id"))]
    asked = d.once("keys", lambda: keys[0].unionByName(keys[1]).unionByName(keys[2]).unionByName(keys[3]).unionByName(keys[4]))
    named = lambda rows, key, i="id": rows.select(F.col(key).alias("key"), F.col(i).alias("id"))
    tables = {"ticker": named(companies, "ticker"), "name": named(companies, "name"), "hash": named(reports, "file_hash"), "period": named(d.documents(), "report_period"), "risks": named(risk_table(d), "document_id")}
    return M.look_up(asked, tables)


@query("select 'companies' as name, count(*) n, min(id) first_id, max(id) last_id from companies union all select 'documents', count(*), min(id), max(id) from docs union all select 'financial', count(*), min(id), max(id) from fin")
def scan_tables(d: Domain) -> DataFrame:
    """Whole scans of the stored tables."""
    of = lambda name, rows: rows.agg(F.count("*").alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id")).select(F.lit(name).alias("name"), "n", "first_id", "last_id")
    return of("companies", d.companies()).unionByName(of("documents", d.documents())).unionByName(of("financial", d.financial()))


@query(f""", {RISK_CTES}, c as (select document_id, count(*) n from chunk_rows group by 1), k as (select document_id, count(*) n from all_risks group by 1), m as (select document_id, count(*) n from fin group by 1)
select id document_id, 'download_and_hash' stage, case status when 'failed' then 'failed' else 'success' end status, 'Downloaded ' || file_name || ' with hash ' || left(file_hash, 16) message from reports
union all select id, 'graph_ingestion', 'success', coalesce(c.n, 0) || ' chunks, ' || coalesce(m.n, 0) || ' metrics, ' || coalesce(k.n, 0) || ' risks' from reports
  left join c on c.document_id = id left join k on k.document_id = id left join m on m.document_id = id where status = 'processed'""")
def audit_log(d: Domain) -> DataFrame:
    """Log rows derived from what each document's stages made, appended in one write."""
    t = base_tables(d)
    count = lambda rows, name: rows.groupBy("document_id").agg(F.count("*").alias(name))
    counts = count(T.chunks(d.page_arrays()), "n_chunks").join(count(t["risk"], "n_risks"), "document_id", "full").join(count(t["metric"].where("document_id is not null"), "n_metrics"), "document_id", "full")
    table = shared_path(d.spark, "logs")
    sinks.append(M.audit_rows(d.reports(), counts), table, "stage")
    return d.spark.read.parquet(table).select("document_id", "stage", "status", "message")


_DOSSIERS = f"""{RISK_CTES}, rk as (select a.*, a.document_id * 10 + a.n id, p.company_id, p.file_name from all_risks a join reports p on p.id = a.document_id),
lf as (select company_id, max(period) latest, arg_max(currency, period) cur from fin group by 1)"""


@query(f""", {_DOSSIERS} select company_id, 'metrics' list, (row_number() over (partition by company_id order by period, id) - 1)::int pos, period || '=' || revenue::varchar entry from fin where company_id in (select id from companies)
union all select company_id, 'risks', (row_number() over (partition by company_id order by page_number, id) - 1)::int, 'p' || page_number || ' ' || risk || ' in ' || file_name from rk where company_id in (select id from companies)
union all select company_id, 'documents', (row_number() over (partition by company_id order by id) - 1)::int, id || ' ' || status from docs where company_id in (select id from companies)
union all select id, 'card', 0, coalesce(f.cur, 'USD') || ' ' || coalesce(f.latest, 'Latest') from companies left join (select company_id, max(period) latest, arg_min(currency, period) cur from fin group by 1) f on f.company_id = id""")
def dossier_nested(d: Domain) -> DataFrame:
    """Nested dossiers, their arrays taken apart in order."""
    t = base_tables(d, ("document", "metric", "risk"))
    rows = d.once("dossiers", lambda: D.nested(d.companies(), t["metric"], t["risk"], t["document"]))
    part = lambda name, entry: rows.select(F.col("id").alias("company_id"), F.lit(name).alias("list"), F.posexplode(name).alias("pos", "x")).select("company_id", "list", "pos", entry.alias("entry"))
    out = part("metrics", F.concat("x.period", F.lit("="), F.col("x.revenue").cast("string")))
    out = out.unionByName(part("risks", F.concat(F.lit("p"), "x.page_number", F.lit(" "), "x.risk", F.lit(" in "), "x.source_doc")))
    out = out.unionByName(part("documents", F.concat("x.id", F.lit(" "), "x.status")))
    return out.unionByName(rows.select(F.col("id").alias("company_id"), F.lit("card").alias("list"), F.lit(0).alias("pos"), F.concat("currency", F.lit(" "), "latest_period").alias("entry")))


@query(f""", {_DOSSIERS} select id company_id, 'overview' sheet, name || '|' || coalesce(sector, 'N/A') || '|' || coalesce(x.n, 0) || '|' || coalesce(y.n, 0) || '|' || coalesce(cur, 'USD') || '|' || coalesce(latest, 'N/A') entry from companies
  left join (select company_id, count(*) n from docs group by 1) x on x.company_id = id left join (select company_id, count(*) n from rk group by 1) y on y.company_id = id left join lf on lf.company_id = id
union all select company_id, 'metrics', period || '|' || revenue || '|' || currency from fin
union all select company_id, 'risks', id || '|' || risk || '|' || coalesce(latest, 'Latest') from rk left join lf using (company_id)
union all select company_id, 'registry', id || '|' || upper(status) || '|' || left(file_hash, 16) || '...' from docs
union all select company_id, 'content', document_id || '|' || length(case when length(t) > 32000 then left(t, 32000) || '... [TRUNCATED]' else t end) from filed""")
def dossier_sheets(d: Domain) -> DataFrame:
    """The five tables of all dossiers, written in folders of company groups and read from the files."""
    folder, t = shared_path(d.spark, "dossiers"), base_tables(d, ("document", "metric", "risk"))
    text = d.page_arrays().select("company_id", "document_id", F.array_join(F.transform("pages", lambda p: p["text"]), "").alias("text"))
    D.write_sheets(D.sheets(d.companies(), t["metric"], t["risk"], t["document"], text), folder)
    line = {"overview": ["name", "sector", "n_documents", "n_risks", "currency", "latest_period"], "metrics": ["period", "revenue", "currency"], "risks": ["risk_id", "risk", "period"], "registry": ["document_id", "status", "hash"], "content": ["document_id", F.length("text")]}
    read = lambda name: d.spark.read.parquet(f"{folder}/{name}").select("company_id", F.lit(name).alias("sheet"), F.concat_ws("|", *line[name]).alias("entry"))
    return reduce(DataFrame.unionByName, map(read, line))


@query(f""", {RISK_CTES}, every as (
  select document_id, 'chunks' as name from chunk_rows union all select document_id, 'risks' from all_risks union all select document_id, 'metrics' from fin where document_id is not null
  union all select id, 'status' from reports union all select id, 'logs' from reports union all select id, 'logs' from reports where status = 'processed')
select document_id, name, count(*) n, case when document_id % 10 = 3 then 2 else 1 end made from every group by 1, 2""")
def reprocess_together(d: Domain) -> DataFrame:
    """Chunks, risks, metrics, logs and status of every tenth document are derived again and replaced in one step."""
    t, docs = base_tables(d, ("metric", "risk")), d.reports()
    cut = d.once("chunks", lambda: T.chunks(d.page_arrays()).select("document_id", "chunk_index"))
    count = lambda rows, name: rows.groupBy("document_id").agg(F.count("*").alias(name))
    fin = t["metric"].where("document_id is not null")
    counts = count(cut, "n_chunks").join(count(t["risk"], "n_risks"), "document_id", "full").join(count(fin, "n_metrics"), "document_id", "full")
    made = {"chunks": (cut, "chunk_index"), "risks": (t["risk"], "risk"), "metrics": (fin, "period"), "status": (docs.withColumnRenamed("id", "document_id"), "status"), "logs": (M.audit_rows(docs, counts), "stage")}
    rows = lambda n: {name: x.select("document_id", F.col(v).cast("string").alias("value"), F.lit(n).alias("made")) for name, (x, v) in made.items()}
    tables = DerivedTables(d.spark, shared_path(d.spark, "derived"), dict.fromkeys(made, "document_id long, value string, made int"))
    ids = docs.select(F.col("id").alias("document_id"))
    tables.replace(ids, rows(1))
    tables.replace(ids.where("document_id % 10 = 3"), rows(2))
    seen = [tables.read(name).groupBy("document_id").agg(F.count("*").alias("n"), F.max("made").alias("made")).withColumn("name", F.lit(name)) for name in made]
    return reduce(DataFrame.unionByName, seen).select("document_id", "name", "n", "made")
