"""All queries of the library proper, by name, with their DuckDB SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.values import SEEDS
from ..sources.domain import Domain

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def fixed(value: str, exponent: int, digits: int, commas: bool = False) -> str:
    """SQL for |value| / 10**exponent with `digits` decimals, half up; value is a decimal of scale 4."""
    unit = 10 ** (4 + exponent - digits)
    t = f"((abs(cast({value} * 10000 as bigint)) + {unit // 2}) // {unit})"
    whole = f"format('{{:,}}', {t} // {10**digits})" if commas else f"({t} // {10**digits})::varchar"
    return f"({whole} || '.' || lpad(({t} % {10**digits})::varchar, {digits}, '0'))"


def minus(value: str, plus: str = "") -> str:
    return f"(case when {value} < 0 then '-' else '{plus}' end)"


def short_money(value: str, currency: str = "currency") -> str:
    return f"coalesce(case when {currency} = 'INR' then '₹' || {minus(value)} || {fixed(value, 7, 1)} || 'Cr' else '$' || {minus(value)} || {fixed(value, 9, 1)} || 'B' end, 'N/A')"


def long_money(value: str, currency: str = "currency") -> str:
    return f"coalesce(case when {currency} = 'INR' then '₹' || {minus(value)} || {fixed(value, 7, 2, True)} || ' Crores' else '$' || {minus(value)} || {fixed(value, 9, 2, True)} || ' Billion' end, 'N/A')"


def pct(value: str, plus: str = "") -> str:
    return f"coalesce({minus(value, plus)} || {fixed(value, -2, 1)} || '%', 'N/A')"


SEED = f"[{', '.join(map(quoted, SEEDS))}]"
#: The domain model in DuckDB SQL; unused parts cost nothing.
DOMAIN = rf"""with
companies as (
  select c_custkey id, c_name name, 'T' || c_custkey ticker, null::varchar website, c_mktsegment sector,
    '{{"Balance": "' || c_acctbal::decimal(12,2)::varchar || '"}}' ratios_json, c_nationkey nation from customer),
reports as (
  select doc_id id, doc_id % 100 company_id, 'doc_' || doc_id || case when doc_id % 7 = 0 then '_Concall' else '_Report' end || '.pdf' file_name,
    case when doc_id % 3 < 2 then 'annual_report' else 'quarterly_report' end document_type, 'FY' || (2018 + doc_id % 6) report_period, sha256(text) file_hash,
    case when doc_id % 11 = 0 then 'failed' when doc_id % 11 = 1 then 'extracting' else 'processed' end status, text from documents),
concalls as (
  select 1000000 + conv_id id, conv_id % 100 company_id, 'call_' || conv_id || '_Concall.pdf' file_name, 'concall_transcript' document_type,
    'FY' || (2018 + conv_id % 6) report_period, sha256(string_agg(text, chr(10) order by turn, text)) file_hash, 'processed' status from conversations group by conv_id),
docs as (select id, company_id, file_name, document_type, report_period, file_hash, status from reports union all select * from concalls),
seeded as (
  select doc_id document_id, doc_id % 100 company_id, doc_id % 2 even, case when doc_id % 17 < 13 then ({SEED})[1 + doc_id % 17] end s, trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')) t from documents),
filed as (select document_id, company_id, case when s is null then t when even = 0 then s || ' ' || t else t || ' ' || s end t from seeded),
page_rows as (
  select document_id, company_id, (off // 2000 + 1)::int page_number, substr(t, off + 1, 2000) as text
  from (select *, unnest(range(0, greatest(length(t), 1), 2000)) off from filed)),
chunk_rows as (
  select document_id, company_id, (row_number() over (partition by document_id order by page_number, off) - 1)::int chunk_index, page_number page, content
  from (select document_id, company_id, page_number, off, trim(substr(text, off + 1, 1000)) as content
    from (select *, unnest(range(0, length(text), 850)) off from page_rows where page_number <= 60)) where length(content) >= 50),
call_rows as (
  select conv_id * 1000 + turn id, 1000000 + conv_id document_id, conv_id % 100 company_id, turn chunk_index, turn + 1 page_start, turn + 1 + turn % 2 page_end,
    concat_ws(' ', trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g')), case when (conv_id + turn) % 17 < 13 then ({SEED})[1 + (conv_id + turn) % 17] end) as content from conversations),
line_sums as (select l_orderkey, sum(l_extendedprice::decimal(12,2) * l_discount::decimal(4,2)) p from lineitem group by l_orderkey),
yearly as (
  select o_custkey company_id, year(o_orderdate) y, (case when o_custkey % 13 = 0 and year(o_orderdate) % 4 = 0 then 0 else sum(o_totalprice::decimal(12,2)) end)::decimal(20,4) revenue, coalesce(sum(p), 0)::decimal(20,4) net_profit
  from orders left join line_sums on l_orderkey = o_orderkey group by 1, 2),
grown as (
  select *, last_value(nullif(revenue, 0) ignore nulls) over (partition by company_id order by y rows between unbounded preceding and 1 preceding) before from yearly),
fin as (
  select g.company_id * 10000 + y id, g.company_id, d.document_id, 'FY' || y period, revenue, net_profit, (2 * net_profit)::decimal(20,4) operating_profit,
    round((revenue - before)::double / before::double, 4)::decimal(10,4) revenue_growth, round((2 * net_profit)::double / nullif(revenue, 0)::double, 4)::decimal(10,4) operating_margin,
    case when g.company_id % 2 = 0 then 'INR' else 'USD' end currency, (net_profit / 1000)::decimal(10,4) eps
  from grown g left join (select company_id, min(id) document_id from reports group by 1) d on d.company_id = g.company_id and g.company_id < 100),
logs as (
  select event_id id, event_id % (select count(*) from documents) document_id, event_type stage,
    case event_type when 'error' then 'failed' when 'signup' then 'started' when 'click' then 'warning' else 'success' end status, ts started_at from events)
"""


def query(sql: str | None = None, money: str = "") -> Callable:
    """Register a function of Domain as a query, with SQL over the domain model as its oracle; columns in `money` come out as doubles."""
    amounts = money.split()

    def add(f: Callable[[Domain], DataFrame]) -> Callable[[Domain], DataFrame]:
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return f(Domain(spark, folder)).withColumns({c: F.col(c).cast("double") for c in amounts})

        QUERIES[f.__name__] = run
        if sql is not None:
            body = DOMAIN + sql
            ORACLES[f.__name__] = f"select * replace ({', '.join(f'{c}::double as {c}' for c in amounts)}) from ({body})" if amounts else body
        return f

    return add


from . import filings, graphs, reports, statements, streams, tables  # noqa: E402, F401  register the queries
