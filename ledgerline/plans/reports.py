"""Queries of joins, reports and table maintenance."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import RISKS
from ..operators import maintain as M
from ..operators import text as T
from ..sources.domain import Domain
from .catalog import query, quoted
from .filings import RISK_CTES, risk_table


@query(f", {RISK_CTES} select r.document_id * 10 + n id, d.company_id, risk, page_number, d.file_name from all_risks r left join docs d on d.id = r.document_id")
def risk_with_doc(d: Domain) -> DataFrame:
    docs = d.documents().select(F.col("id").alias("document_id"), F.col("file_name").alias("f"))
    return risk_table(d).join(docs, "document_id", "left").select("id", "company_id", "risk", "page_number", F.col("f").alias("file_name"))


@query("select c.id, c.document_id, c.company_id, ticker, file_name, report_period from call_rows c join docs d on d.id = c.document_id join companies m on m.id = d.company_id where document_type = 'concall_transcript'")
def concall_chunks(d: Domain) -> DataFrame:
    calls = d.documents().where("document_type = 'concall_transcript'").select(F.col("id").alias("document_id"), "file_name", "report_period")
    names = d.companies().select(F.col("id").alias("company_id"), "ticker")
    return d.call_chunks().select("id", "document_id", "company_id").join(calls, "document_id").join(names, "company_id")


def _incoming(d: Domain) -> DataFrame:
    k = F.col("id") % 3
    return d.companies().select(F.col("id").alias("row"), F.when(k == 0, F.lower("ticker")).when(k == 2, F.concat(F.lit("Z"), "id")).alias("ticker"), F.when(k == 1, F.upper("name")).otherwise(F.concat(F.lit("nobody "), "id")).alias("name"))


@query("select id as row, case when id % 3 < 2 then id end match_id from companies")
def company_match(d: Domain) -> DataFrame:
    return M.match_companies(_incoming(d), d.companies()).select("row", "match_id")


@query("select company_id, max(id) id, arg_max(file_name, id) file_name from docs group by 1")
def latest_document(d: Domain) -> DataFrame:
    return M.latest(d.documents().select("company_id", "id", "file_name"), "company_id", "id")


@query("select id, min(id) over (partition by file_hash) first_id, id = min(id) over (partition by file_hash) is_first from reports")
def dedup_hash(d: Domain) -> DataFrame:
    return M.first_of_hash(d.reports()).select("id", "first_id", (F.col("id") == F.col("first_id")).alias("is_first"))


@query("""select i.id, case when k = 3 or i.id <> f then 'reuse' when k = 2 then 'busy' when k = 1 then 'reprocess' else 'new' end action
from (select *, min(id) over (partition by file_hash) f from reports where id % 10 >= 7 or id % 10 = 0) i
left join (select file_hash, max(case status when 'processed' then 3 when 'failed' then 1 else 2 end) k from reports where id % 10 < 7 group by 1) s on s.file_hash = i.file_hash""")
def intake_plan(d: Domain) -> DataFrame:
    r = d.reports()
    return M.plan_intake(r.where("id % 10 >= 7 or id % 10 = 0"), r.where("id % 10 < 7")).select("id", "action")


_LATEST = "last_fin as (select company_id, max(period) latest_period, arg_max(currency, period) currency, arg_max(revenue, period) r, arg_max(net_profit, period) p, arg_max(coalesce(revenue_growth, 0), period) g from fin group by 1)"


@query(f""", {_LATEST} select id, name, ticker, coalesce(n, 0)::bigint n_documents, latest_period, nullif(r, 0) revenue, nullif(p, 0) net_profit, nullif(g, 0) revenue_growth, currency
from companies left join (select company_id, count(*) n from docs group by 1) c on c.company_id = id left join last_fin f on f.company_id = id""", money="revenue net_profit revenue_growth")
def company_summary(d: Domain) -> DataFrame:
    """A card per company: documents, and its latest period's figures with 0 as missing."""
    n = d.documents().groupBy("company_id").agg(F.count("*").alias("n"))
    last = M.latest(d.financial().select("company_id", "period", "revenue", "net_profit", "revenue_growth", "currency"), "company_id", "period")
    none = lambda c: F.nullif(F.col(c), F.lit(0).cast("decimal(20,4)")).alias(c)
    out = d.companies().withColumnRenamed("id", "company_id").join(n, "company_id", "left").join(last, "company_id", "left")
    return out.select(F.col("company_id").alias("id"), "name", "ticker", F.coalesce("n", F.lit(0)).alias("n_documents"), F.col("period").alias("latest_period"), none("revenue"), none("net_profit"), none("revenue_growth"), "currency").orderBy("name")


@query(f""", {RISK_CTES} select id, name, coalesce(f.l, '') metrics, coalesce(r.l, '') risks, coalesce(d.l, '') documents, coalesce(cur, 'USD') currency from companies
left join (select company_id, string_agg(period || '=' || revenue::decimal(20,2)::varchar, ';' order by period) l, arg_min(currency, period) cur from fin group by 1) f on f.company_id = id
left join (select p.company_id, string_agg('p' || page_number || ' ' || risk, ';' order by page_number, document_id, n) l from all_risks join reports p on p.id = document_id group by 1) r on r.company_id = companies.id
left join (select company_id, string_agg(file_name, ';' order by id) l from docs group by 1) d on d.company_id = companies.id""")
def company_detail(d: Domain) -> DataFrame:
    """A company with its ordered metrics, risks and documents; each child is gathered once before the joins."""
    def gathered(rows: DataFrame, order: list[str], text, name: str) -> DataFrame:
        parts = F.transform(F.array_sort(F.collect_list(F.struct(*order, text.alias("t")))), lambda x: x["t"])
        return rows.groupBy(F.col("company_id").alias("id")).agg(F.array_join(parts, ";").alias(name))

    fin = d.financial()
    metrics = gathered(fin, ["period"], F.concat("period", F.lit("="), F.col("revenue").cast("decimal(20,2)").cast("string")), "metrics")
    first = fin.groupBy(F.col("company_id").alias("id")).agg(F.min_by("currency", "period").alias("currency"))
    risks = gathered(risk_table(d), ["page_number", "document_id", "n"], F.concat(F.lit("p"), "page_number", F.lit(" "), "risk"), "risks")
    docs = gathered(d.documents(), ["id"], F.col("file_name"), "documents")
    out = d.companies().select("id", "name").join(metrics, "id", "left").join(risks, "id", "left").join(docs, "id", "left").join(first, "id", "left")
    return out.select("id", "name", *(F.coalesce(c, F.lit("")).alias(c) for c in ("metrics", "risks", "documents")), F.coalesce("currency", F.lit("USD")).alias("currency"))


@query(f""", {RISK_CTES} select id, name, coalesce(sector, 'N/A') sector, coalesce(n, 0)::bigint n_documents, coalesce(k, 0)::bigint n_risks, coalesce(cur, 'USD') currency, coalesce(latest, 'N/A') latest_period from companies
left join (select company_id, count(*) n from docs group by 1) d on d.company_id = id
left join (select p.company_id, count(*) k from all_risks join reports p on p.id = document_id group by 1) r on r.company_id = id
left join (select company_id, max(period) latest, arg_max(currency, period) cur from fin group by 1) f on f.company_id = id""")
def dossier_overview(d: Domain) -> DataFrame:
    n = d.documents().groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("n"))
    k = risk_table(d).groupBy(F.col("company_id").alias("id")).agg(F.count("*").alias("k"))
    f = d.financial().groupBy(F.col("company_id").alias("id")).agg(F.max("period").alias("latest"), F.max_by("currency", "period").alias("cur"))
    out = d.companies().select("id", "name", "sector").join(n, "id", "left").join(k, "id", "left").join(f, "id", "left")
    return out.select("id", "name", F.coalesce("sector", F.lit("N/A")).alias("sector"), F.coalesce("n", F.lit(0)).alias("n_documents"), F.coalesce("k", F.lit(0)).alias("n_risks"), F.coalesce("cur", F.lit("USD")).alias("currency"), F.coalesce("latest", F.lit("N/A")).alias("latest_period"))


@query(f""", {RISK_CTES} select d.id document_id, coalesce(r, 0)::bigint n_risks, coalesce(c, 0)::bigint n_chunks, coalesce(m, 0)::bigint n_metrics from reports d
left join (select document_id, count(*) r from all_risks group by 1) x on x.document_id = d.id
left join (select document_id, count(*) c from chunk_rows group by 1) y on y.document_id = d.id
left join (select document_id, count(*) m from fin group by 1) z on z.document_id = d.id""")
def ingest_report(d: Domain) -> DataFrame:
    count = lambda rows, name: rows.groupBy("document_id").agg(F.count("*").alias(name))
    parts = [count(risk_table(d), "n_risks"), count(T.chunks(d.page_arrays()), "n_chunks"), count(d.financial().where("document_id is not null"), "n_metrics")]
    out = d.reports().select(F.col("id").alias("document_id"))
    for p in parts:
        out = out.join(p, "document_id", "left")
    return out.fillna(0)


@query("select company_id, count(*) filter (status = 'failed') n_failed from docs group by 1")
def failed_docs(d: Domain) -> DataFrame:
    return d.documents().groupBy("company_id").agg(F.count_if(F.col("status") == "failed").alias("n_failed"))


@query("select company_id, max(period) period, arg_max(revenue, period) revenue, arg_max(currency, period) currency from fin group by 1", money="revenue")
def latest_metric(d: Domain) -> DataFrame:
    return M.latest(d.financial().select("company_id", "period", "revenue", "currency"), "company_id", "period")


@query(f""", {RISK_CTES} select p.company_id, row_number() over (partition by p.company_id order by page_number, document_id, n)::int nth, risk, coalesce(latest, 'Latest') period, page_number
from all_risks join reports p on p.id = document_id left join (select company_id, max(period) latest from fin group by 1) f on f.company_id = p.company_id""")
def dossier_risks(d: Domain) -> DataFrame:
    last = d.financial().groupBy("company_id").agg(F.max("period").alias("latest"))
    rows = M.ranked(risk_table(d), "company_id", "page_number", "document_id", "n").join(last, "company_id", "left")
    return rows.select("company_id", "nth", "risk", F.coalesce("latest", F.lit("Latest")).alias("period"), "page_number")


@query("select id, company_id, row_number() over (partition by company_id order by report_period desc, id desc)::int nth from docs")
def documents_recent(d: Domain) -> DataFrame:
    """Documents of each company, latest first."""
    return M.ranked(d.documents(), "company_id", F.desc("report_period"), F.desc("id")).select("id", "company_id", "nth")


@query("""select id, ticker, 'stored' origin from companies where id % 4 > 0 union all
select id + 1000000000, ticker, 'baseline' from companies where id % 2 = 0 and ticker not in (select ticker from companies where id % 4 > 0)""")
def baseline_merge(d: Domain) -> DataFrame:
    """Stored companies and those of a baseline set whose ticker isn't stored; baseline ids have their own range."""
    stored = d.companies().where("id % 4 > 0").select("id", "ticker", F.lit("stored").alias("origin"))
    baseline = d.companies().where("id % 2 = 0").select((F.col("id") + 1000000000).alias("id"), "ticker", F.lit("baseline").alias("origin"))
    return stored.unionByName(baseline.join(stored, "ticker", "left_anti").select("id", "ticker", "origin"))


@query("""select id, name, ticker, case when id % 3 < 2 and id % 5 > 0 then 'S' || id else sector end sector, ratios_json from companies union all
select 1000000 + id, 'nobody ' || id, 'Z' || id, case when id % 5 = 0 then '' else 'S' || id end, null from companies where id % 3 = 2""")
def company_upsert(d: Domain) -> DataFrame:
    given = F.when(F.col("row") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit("S"), "row"))
    incoming = _incoming(d).select("ticker", "name", given.alias("sector"), F.lit(None).cast("string").alias("ratios_json"), (1000000 + F.col("row")).alias("new_id"))
    return M.upsert_companies(d.companies().drop("website", "nation"), incoming)


@query("""select id, case when status = 'extracting' then case when id % 2 = 0 then 'processed' else 'structuring' end else status end status,
  case when status = 'extracting' and id % 2 = 0 then timestamp '2024-01-01 00:00:00' end processed_at from docs""")
def status_update(d: Domain) -> DataFrame:
    docs = d.documents()
    changes = docs.where("status = 'extracting'").select("id", F.when(F.col("id") % 2 == 0, "processed").otherwise("structuring").alias("new_status"), F.lit("2024-01-01 00:00:00").cast("timestamp_ntz").alias("at"))
    return M.set_status(docs, changes).select("id", "status", "processed_at")


@query(f""", {RISK_CTES}, gone as (select id from reports where status = 'failed')
select 'chunks' child, count(*) n from chunk_rows where document_id not in (from gone) union all select 'risks', count(*) from all_risks where document_id not in (from gone)
union all select 'metrics', count(*) from fin where document_id is null or document_id not in (from gone) union all select 'logs', count(*) from logs where document_id not in (from gone)
union all select 'documents', count(*) from docs where id not in (from gone)""")
def cascade_delete(d: Domain) -> DataFrame:
    """Rows of each table that are left after failed documents and all that belongs to them went."""
    gone = d.reports().where("status = 'failed'").select("id")
    left = {"chunks": M.without(T.chunks(d.page_arrays()), gone), "risks": M.without(risk_table(d), gone), "metrics": M.without(d.financial(), gone), "logs": M.without(d.logs(), gone), "documents": M.without(d.documents(), gone, "id")}
    counts = [rows.agg(F.count("*").alias("n")).select(F.lit(name).alias("child"), "n") for name, rows in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


@query(f""", {RISK_CTES} select document_id, risk, page_number, case when document_id % 11 = 1 then 2 else 1 end as version from all_risks""")
def reprocess(d: Domain) -> DataFrame:
    """Risks after the documents still extracting were done again: their old rows go, recomputed ones come."""
    again = d.reports().where("status = 'extracting'").select("id")
    old = risk_table(d).select("document_id", "risk", "page_number", F.lit(1).alias("version"))
    new = risk_table(d).join(again.select(F.col("id").alias("document_id")), "document_id", "left_semi").select("document_id", "risk", "page_number", F.lit(2).alias("version"))
    return M.without(old, again).unionByName(new)


@query("select id, case when document_id in (select id from reports where status <> 'failed') then document_id end document_id, stage, status from logs")
def logs_orphaned(d: Domain) -> DataFrame:
    return M.orphaned(d.logs(), d.reports().where("status <> 'failed'")).select("id", "document_id", "stage", "status")


@query("select document_id, stage, status, count(*) n, max(started_at) last_at from logs group by 1, 2, 3")
def audit_history(d: Domain) -> DataFrame:
    return d.logs().groupBy("document_id", "stage", "status").agg(F.count("*").alias("n"), F.max("started_at").alias("last_at"))


@query(f""", caps as (select id, company_id, case when contains(lower(file_name), 'concall') then 40 else 60 end cap from reports),
read_pages as (select p.* from page_rows p join caps on id = document_id where page_number <= cap),
cut as (select document_id, count(*) n from (select document_id, trim(substr(text, off + 1, 1000)) c from (select *, unnest(range(0, length(text), 850)) off from read_pages)) where length(c) >= 50 group by 1),
low as (select document_id, lower(text) low, text from read_pages), risky as (select document_id, {" + ".join(f"bool_or(regexp_matches(low, {quoted(p)}))::int" for _, p in RISKS)} k from low
  where not (contains(low, 'table of contents') or contains(low, 'index') and length(text) < 300) group by 1),
n as (select document_id, count(*) n from read_pages group by 1)
select id document_id, n.n n_pages, coalesce(cut.n, 0)::bigint n_chunks, least(6, coalesce(k, 0))::bigint n_risks from caps join n on n.document_id = id left join cut on cut.document_id = id left join risky on risky.document_id = id""")
def capped_documents(d: Domain) -> DataFrame:
    """Pages, chunks and risks of each document within its class's cap: 40 pages of calls, 60 of others."""
    docs = d.reports().select(F.col("id").alias("document_id"), T.page_cap(F.col("document_type"), F.col("file_name")).alias("cap"))
    pages = d.once("capped", lambda: T.capped_pages(d.page_arrays().join(docs, "document_id"), F.col("cap")))
    count = lambda rows, name: rows.groupBy("document_id").agg(F.count("*").alias(name))
    cut, risks = count(T.chunks(pages, most_pages=F.col("cap")), "n_chunks"), count(T.tag_risks(pages.select("document_id", F.inline_outer("pages"))), "n_risks")
    out = pages.select("document_id", F.size("pages").cast("long").alias("n_pages"))
    return out.join(cut, "document_id", "left").join(risks, "document_id", "left").fillna(0)


@query(f""", {RISK_CTES}, m as (select company_id, count(*) n from fin group by 1), r as (select company_id, count(*) n from all_risks join reports on id = document_id group by 1), c as (select company_id, count(*) n from chunk_rows group by 1),
k as (select company_id, count(*) n, count(*) filter (document_type = 'concall_transcript' or contains(lower(file_name), 'concall')) calls from docs group by 1)
select id company_id, coalesce(k.n, 0)::bigint n_documents, coalesce(calls, 0)::bigint n_concalls, coalesce(m.n, 0)::bigint n_metrics, coalesce(r.n, 0)::bigint n_risks, coalesce(c.n, 0)::bigint n_chunks
from companies left join k on k.company_id = id left join m on m.company_id = id left join r on r.company_id = id left join c on c.company_id = id""")
def ingest_by_company(d: Domain) -> DataFrame:
    """What each company's intake made: documents, calls among them, metrics, risks and chunks."""
    count = lambda rows, name: rows.groupBy("company_id").agg(F.count("*").alias(name))
    docs = d.documents().groupBy("company_id").agg(F.count("*").alias("n_documents"), F.count_if(S.is_concall(F.col("document_type"), F.col("file_name"))).alias("n_concalls"))
    out = d.companies().select(F.col("id").alias("company_id"))
    for part in (docs, count(d.financial(), "n_metrics"), count(risk_table(d), "n_risks"), count(T.chunks(d.page_arrays()), "n_chunks")):
        out = out.join(part, "company_id", "left")
    return out.fillna(0)


@query("""select document_id, id, row_number() over (partition by document_id order by started_at, id)::int nth from logs""")
def logs_in_order(d: Domain) -> DataFrame:
    """Each document's log rows by their start."""
    return M.ranked(d.logs(), "document_id", "started_at", "id").select("document_id", "id", "nth")


@query("""select r.id, company_id, row_number() over (partition by company_id order by t desc nulls last, r.id desc)::int nth from reports r left join (select document_id, min(started_at) t from logs group by 1) x on x.document_id = r.id""")
def documents_by_download(d: Domain) -> DataFrame:
    """Documents of each company by the time that their first log row gives for their download, latest first."""
    first = d.logs().groupBy(F.col("document_id").alias("id")).agg(F.min("started_at").alias("downloaded_at"))
    return M.ranked(d.reports().join(first, "id", "left"), "company_id", F.desc_nulls_last("downloaded_at"), F.desc("id")).select("id", "company_id", "nth")
