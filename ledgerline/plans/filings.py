"""Queries of scans, scalar forms and the text pipeline."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import scalars as S
from ..functions.values import DEFAULT_RISK, DEFAULT_RISK_TEXT, GUIDANCE, LOG_STATUSES, RISKS, STATUSES
from ..operators import text as T
from ..sources.domain import Domain
from .catalog import fixed, long_money, minus, pct, query, quoted, short_money


@query("select id, name, ticker, sector from companies")
def scan_companies(d: Domain) -> DataFrame:
    return d.companies().select("id", "name", "ticker", "sector")


@query("""select 'T' || company_id ticker, concat_ws(',', '"' || period || '"', revenue::varchar, net_profit::varchar, operating_profit::varchar, coalesce(revenue_growth::varchar, ''),
  coalesce(operating_margin::varchar, ''), '"' || currency || '"') line from fin""")
def export_csv_rows(d: Domain) -> DataFrame:
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    cells = [text("period"), *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("revenue", "net_profit", "operating_profit", "revenue_growth", "operating_margin")), text("currency")]
    return d.financial().select(F.concat(F.lit("T"), "company_id").alias("ticker"), F.concat_ws(",", *cells).alias("line"))


@query("select id, file_hash, strlen(text)::bigint n_bytes from reports")
def doc_fingerprint(d: Domain) -> DataFrame:
    return d.reports(with_text=True).select("id", "file_hash", F.octet_length("text").cast("long").alias("n_bytes"))


@query("select nation, id, name, case when id % 2 = 0 then ticker else upper(left(name, 6)) end ticker from companies")
def parse_search_results(d: Domain) -> DataFrame:
    """One JSON array of search hits per nation, parsed back."""
    c = d.companies()
    url = F.when(F.col("id") % 2 == 0, F.concat(F.lit("/company/"), "ticker", F.lit("/consolidated/"))).otherwise(F.concat(F.lit("/find/"), "id"))
    found = c.groupBy("nation").agg(F.to_json(F.collect_list(F.struct("id", "name", url.alias("url")))).alias("body"))
    hits = found.select("nation", F.inline(F.from_json("body", "array<struct<id: bigint, name: string, url: string>>")))
    return hits.select("nation", "id", "name", S.ticker_of_url(F.col("url"), F.col("name")).alias("ticker"))


@query("select d.company_id, c.document_id, c.chunk_index, length(content)::int n_chars, sha256(content) content_hash from docs d join chunk_rows c on c.document_id = d.id")
def company_chunks(d: Domain) -> DataFrame:
    c = T.chunks(d.page_arrays()).drop("company_id")
    return d.documents().join(c, F.col("id") == F.col("document_id")).select("company_id", "document_id", "chunk_index", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


@query("select id, company_id, file_name, status from docs where company_id = 42")
def lookup_by_key(d: Domain) -> DataFrame:
    return d.documents().where("company_id = 42").select("id", "company_id", "file_name", "status")


@query("select company_id, period, revenue, net_profit from fin where company_id in (12, 31, 77, 5)", money="revenue net_profit")
def facts_for_keys(d: Domain) -> DataFrame:
    return d.financial().where(F.col("company_id").isin(12, 31, 77, 5)).select("company_id", "period", "revenue", "net_profit")


@query("select id, upper(trim(case when id % 5 = 0 then left(name, 6) else ' ' || lower(ticker) || ' ' end)) ticker from companies")
def ticker_norm(d: Domain) -> DataFrame:
    given = F.when(F.col("id") % 5 == 0, F.lit("")).otherwise(F.concat(F.lit(" "), F.lower("ticker"), F.lit(" ")))
    return d.companies().select("id", S.ticker_or_name(given, F.col("name")).alias("ticker"))


@query(r"select page_id, upper(coalesce(nullif(regexp_extract(url, 'https?://(?:www\.)?[^/]+/([^/?#]+)', 1), ''), left(url, 6))) ticker from pages")
def ticker_from_url(d: Domain) -> DataFrame:
    part = F.regexp_extract("url", r"https?://(?:www\.)?[^/]+/([^/?#]+)", 1)
    url = F.concat(F.lit("/company/"), F.nullif(part, F.lit("")), F.lit("/"))
    return d.table("pages").select("page_id", S.ticker_of_url(F.coalesce(url, F.lit("")), F.col("url")).alias("ticker"))


@query("""select id, document_type = 'concall_transcript' or contains(lower(file_name), 'concall') is_concall,
  case when document_type = 'concall_transcript' or contains(lower(file_name), 'concall') then 'Concall ' else 'Report ' end || report_period label from docs""")
def doc_class(d: Domain) -> DataFrame:
    call = S.is_concall(F.col("document_type"), F.col("file_name"))
    return d.documents().select("id", call.alias("is_concall"), F.concat(F.when(call, "Concall ").otherwise("Report "), "report_period").alias("label"))


@query(f"select id, {short_money('revenue')} revenue_short, {short_money('case when company_id % 9 = 0 then null else -net_profit end')} loss_short from fin")
def fmt_money_short(d: Domain) -> DataFrame:
    loss = F.when(F.col("company_id") % 9 != 0, -F.col("net_profit"))
    return d.financial().select("id", S.money_short(F.col("revenue"), F.col("currency")).alias("revenue_short"), S.money_short(loss, F.col("currency")).alias("loss_short"))


@query(f"select id, {long_money('(revenue * 100000)::decimal(20,4)')} revenue_long from fin")
def fmt_money_long(d: Domain) -> DataFrame:
    return d.financial().select("id", S.money_long((F.col("revenue") * 100000).cast("decimal(20,4)"), F.col("currency")).alias("revenue_long"))


@query(f"""select id, {minus('v')} || case when abs(v) >= 1000000000 then {fixed('v', 9, 2)} || 'B' when abs(v) >= 1000000 then {fixed('v', 6, 2)} || 'M'
  when abs(v) >= 1000 then {fixed('v', 3, 2)} || 'K' else {fixed('v', 0, 2)} end amount
from (select id, (case id % 4 when 0 then revenue * 10000 when 1 then -revenue when 2 then net_profit else revenue / 1000 end)::decimal(20,4) v from (select id, revenue, net_profit from fin where id % 4 < 3 union all select id, (id % 1000)::decimal(20,4) * 1000, net_profit from fin where id % 4 = 3))""")
def fmt_money_adaptive(d: Domain) -> DataFrame:
    i = F.col("id") % 4
    v = F.when(i == 0, F.col("revenue") * 10000).when(i == 1, -F.col("revenue")).when(i == 2, F.col("net_profit")).otherwise(F.col("id") % 1000).cast("decimal(20,4)")
    return d.financial().select("id", S.money_adaptive(v).alias("amount"))


@query(f"""select id, {pct('revenue_growth', '+')} growth_signed, {pct('operating_margin')} margin, case when revenue_growth is null then 'N/A' else {pct('revenue_growth')} || ' YoY' end growth_yoy from fin""")
def fmt_percent(d: Domain) -> DataFrame:
    g = F.col("revenue_growth")
    return d.financial().select("id", S.percent(g, "+").alias("growth_signed"), S.percent(F.col("operating_margin")).alias("margin"), F.when(g.isNull(), "N/A").otherwise(F.concat(S.percent(g), F.lit(" YoY"))).alias("growth_yoy"))


@query("select id, '⚠️ ' || case when length(file_name) > 16 then left(file_name, 16) || '..' else file_name end || ' (p.' || (id % 30) || ')' label from docs")
def risk_label(d: Domain) -> DataFrame:
    return d.documents().select("id", S.risk_label(F.col("file_name"), F.col("id") % 30).alias("label"))


@query("select id, case when page_start = page_end then 'Page ' || page_start else 'Pages ' || page_start || '-' || page_end end page from call_rows")
def page_ref(d: Domain) -> DataFrame:
    return d.call_chunks().select("id", S.page_ref(F.col("page_start"), F.col("page_end")).alias("page"))


@query("select company_id, id, file_name, coalesce(document_type, 'annual_report') document_type, coalesce(report_period, 'Latest') report_period, upper(status) status, left(file_hash, 16) || '...' hash from docs")
def dossier_registry(d: Domain) -> DataFrame:
    return d.documents().select("company_id", "id", "file_name", F.coalesce("document_type", F.lit("annual_report")).alias("document_type"), F.coalesce("report_period", F.lit("Latest")).alias("report_period"), F.upper("status").alias("status"), F.concat(F.left("file_hash", F.lit(16)), F.lit("...")).alias("hash"))


@query("select document_id, length(x)::int n_chars, sha256(x) content_hash from (select document_id, case when length(t) > 32000 then left(t, 32000) || '... [TRUNCATED]' else t end x from filed)")
def dossier_content(d: Domain) -> DataFrame:
    whole = F.array_join(F.transform("pages", lambda p: p["text"]), "")
    x = d.page_arrays().select("document_id", S.truncated(whole).alias("x"))
    return x.select("document_id", F.length("x").alias("n_chars"), F.sha2("x", 256).alias("content_hash"))


@query(r"select page_id, 'T' || page_id || '_' || trim(regexp_replace(url, '[^\p{L}\p{N}_\-]', '_', 'g'), '_') || '.pdf' file_name, split_part(url, '#', 1) link from pages")
def safe_name(d: Domain) -> DataFrame:
    return d.table("pages").select("page_id", S.safe_name(F.concat(F.lit("T"), "page_id"), F.col("url")).alias("file_name"), S.without_fragment(F.col("url")).alias("link"))


@query("select id, 'Balance' ratio, c_acctbal::decimal(12,2)::varchar as value from companies join customer on c_custkey = id where id % 10 > 0")
def ratios_long(d: Domain) -> DataFrame:
    json = F.when(F.col("id") % 10 == 0, F.lit("{bad")).otherwise(F.col("ratios_json"))
    return d.companies().select("id", F.explode(S.ratios(json)).alias("ratio", "value"))


@query(f"""select 'document' kind, id, status from docs where status not in ({', '.join(quoted(s) for s in STATUSES if s != 'extracting')})
union all select 'log', id, stage from logs where stage not in ({', '.join(map(quoted, LOG_STATUSES))})""")
def invalid_status(d: Domain) -> DataFrame:
    docs = d.documents().where(~S.valid_status(F.col("status"), [s for s in STATUSES if s != "extracting"])).select(F.lit("document").alias("kind"), "id", "status")
    logs = d.logs().where(~S.valid_status(F.col("stage"), LOG_STATUSES)).select(F.lit("log").alias("kind"), "id", F.col("stage").alias("status"))
    return docs.unionByName(logs)


@query("select id, ticker, q from companies, (values ('T12'), ('000031'), ('customer#00000014')) s(q) where contains(lower(name), lower(q)) or contains(lower(ticker), lower(q))")
def company_search(d: Domain) -> DataFrame:
    asked = d.spark.createDataFrame([("T12",), ("000031",), ("customer#00000014",)], "q string")
    hit = F.contains(F.lower("name"), F.lower("q")) | F.contains(F.lower("ticker"), F.lower("q"))
    return d.companies().join(F.broadcast(asked), hit).select("id", "ticker", "q")


@query("select document_id, page_number, length(text)::int n_chars, sha256(text) text_hash from page_rows where page_number <= case when document_id % 7 = 0 then 40 else 60 end")
def page_split(d: Domain) -> DataFrame:
    most = F.when(F.col("document_id") % 7 == 0, T.CALL_PAGES).otherwise(T.REPORT_PAGES)
    return d.pages().where(F.col("page_number") <= most).select("document_id", "page_number", F.length("text").alias("n_chars"), F.sha2("text", 256).alias("text_hash"))


_STATS = r"""stats as (
  select document_id, page_number, case when t = '' then 0 else len(string_split(t, ' ')) end::int word_count
  from (select document_id, page_number, trim(regexp_replace(text, '\s+', ' ', 'g')) t from page_rows))"""


@query(f", {_STATS} select *, word_count < 20 is_scanned from stats")
def page_stats(d: Domain) -> DataFrame:
    return T.page_stats(d.pages()).select("document_id", "page_number", "word_count", "is_scanned")


@query(f", {_STATS} select document_id, count(*) total_pages, sum(word_count)::bigint total_words, count(*) filter (word_count < 20) scanned_pages from stats group by 1")
def doc_text_totals(d: Domain) -> DataFrame:
    return T.totals(T.page_stats(d.pages()))


@query("select document_id, chunk_index, page page_start, page page_end, length(content)::int n_chars, sha256(content) content_hash from chunk_rows")
def chunk_documents(d: Domain) -> DataFrame:
    return T.chunks(d.page_arrays()).select("document_id", "chunk_index", "page_start", "page_end", F.length("content").alias("n_chars"), F.sha2("content", 256).alias("content_hash"))


_HITS = " union all ".join(f"select document_id, page_number, {i} k, {quoted(t)} risk, text, low, regexp_extract(low, {quoted(p)}, 1) m from open_pages where regexp_matches(low, {quoted(p)})" for i, (t, p) in enumerate(RISKS))
RISK_CTES = rf"""open_pages as (
  select *, lower(text) low from page_rows where not (contains(lower(text), 'table of contents') or contains(lower(text), 'index') and length(text) < 300)),
hits as ({_HITS}),
first_hits as (select *, strpos(low, m) - 1 off from hits qualify row_number() over (partition by document_id, k order by page_number) = 1),
cut as (
  select document_id, page_number, risk, row_number() over (partition by document_id order by page_number, k) n,
    trim(regexp_replace(substr(text, greatest(off - 50, 0) + 1, off + length(m) + 250 - greatest(off - 50, 0)), '\s+', ' ', 'g')) x from first_hits),
risk_rows as (
  select document_id, risk, case when length(x) > 200 then left(x, 197) || '...' else x end description, page_number, n::int n from cut where n <= 6),
all_risks as (
  select * from risk_rows union all
  select id, {quoted(DEFAULT_RISK)}, {quoted(DEFAULT_RISK_TEXT.split('{}')[0])} || 'T' || company_id || {quoted(DEFAULT_RISK_TEXT.split('{}')[1])}, 1, 1 from reports where id not in (select document_id from risk_rows))"""


@query(f", {RISK_CTES} select document_id, risk, page_number, n from risk_rows")
def risk_tag(d: Domain) -> DataFrame:
    return T.tag_risks(d.pages()).select("document_id", "risk", "page_number", "n")


@query(f", {RISK_CTES} select document_id, risk, description from risk_rows")
def risk_snippet(d: Domain) -> DataFrame:
    return T.tag_risks(d.pages()).select("document_id", "risk", "description")


def risk_table(d: Domain) -> DataFrame:
    """Risks of all reports with id, company and file name. What is found is kept: it is asked twice, and the text is scanned once."""
    docs = d.reports().select(F.col("id").alias("document_id"), "company_id", F.concat(F.lit("T"), "company_id").alias("ticker"), "file_name", "report_period")
    found = d.once("found", lambda: T.tag_risks(d.pages()))
    rows = T.with_default_risk(found, docs.select("document_id", "ticker"))
    return rows.join(docs.drop("ticker"), "document_id").withColumn("id", F.col("document_id") * 10 + F.col("n"))


@query(f", {RISK_CTES} select document_id, risk, description, page_number from all_risks")
def risk_default(d: Domain) -> DataFrame:
    return risk_table(d).select("document_id", "risk", "description", "page_number")


_CASES = " ".join(f"when regexp_matches(lower(statement), {quoted(p)}) then {quoted(t)}" for t, p in GUIDANCE)
GUIDANCE_CTES = rf"""sentence_rows as (
  select id, document_id, company_id, chunk_index, page_start, page_end, (pos - 1)::int pos, trim(parts[pos]) statement from (
    select *, unnest(range(1, len(parts) + 1)) pos from (
      select *, string_split(regexp_replace(content, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1)) parts from call_rows where length(content) >= 80))
  where length(trim(parts[pos])) between 50 and 400),
classed as (select *, case {_CASES} end category from sentence_rows),
deduped as (
  select * from classed where category is not null
  qualify row_number() over (partition by lower(left(statement, 60)) order by document_id desc, chunk_index, pos) = 1),
deduped_by_company as (
  select * from classed where category is not null
  qualify row_number() over (partition by lower(left(statement, 60)), company_id order by document_id desc, chunk_index, pos) = 1),
guidance_rows as (
  select *, id || '_' || nth guidance_id, case when page_start = page_end then 'Page ' || page_start else 'Pages ' || page_start || '-' || page_end end page
  from (select *, row_number() over (partition by company_id order by document_id desc, chunk_index, pos) - 1 nth from deduped_by_company) where nth < 60)"""


@query(f", {GUIDANCE_CTES} select document_id, chunk_index, pos, statement from sentence_rows")
def sentences(d: Domain) -> DataFrame:
    return T.sentences(d.call_chunks()).select("document_id", "chunk_index", "pos", "statement")


@query(f", {GUIDANCE_CTES} select document_id, chunk_index, pos, category from classed where category is not null")
def guidance_classify(d: Domain) -> DataFrame:
    return T.classify_guidance(T.sentences(d.call_chunks())).select("document_id", "chunk_index", "pos", "category")


@query(f", {GUIDANCE_CTES} select document_id, chunk_index, pos, category, statement from deduped")
def guidance_dedup(d: Domain) -> DataFrame:
    return T.dedup_guidance(T.classify_guidance(T.sentences(d.call_chunks()))).select("document_id", "chunk_index", "pos", "category", "statement")


def guidance_table(d: Domain) -> DataFrame:
    rows = T.dedup_guidance(T.classify_guidance(T.sentences(d.call_chunks())), "company_id")
    calls = d.concalls().select(F.col("id").alias("document_id"), "file_name", F.col("report_period").alias("period"))
    return T.top_guidance(rows).join(calls, "document_id")


@query(f", {GUIDANCE_CTES} select guidance_id, company_id, category, statement, page from guidance_rows")
def guidance_topn(d: Domain) -> DataFrame:
    return guidance_table(d).select("guidance_id", "company_id", "category", "statement", "page")
