"""Statement tables of company pages: cells, periods, line items, measures and growth, by expressions over html."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import number, ratio

ITEMS = {"sales": "revenue", "net profit": "net_profit", "operating profit": "operating_profit", "opm": "opm", "eps": "eps"}
UNIT = 10_000_000
MONEY = "decimal(20,4)"


def inner(html: Column, tag: str) -> Column:
    """Contents of all elements of just this tag (th isn't thead)."""
    return F.regexp_extract_all(html, F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), 1)


def plain(cell: Column) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(cell, "<[^>]*>", ""), r"(?U)[\s ]+|&nbsp;", " "))


def _rows(tables: DataFrame, key: str, html: str, *more: str) -> DataFrame:
    """(key, more..., row_pos, row_title, td) of each row.

    Arrays of regex matches are exploded with the outer form, here and below, and the null row is dropped after: the plain form
    has Spark filter by the array's size first, which matches everything twice.
    """
    rows = tables.select(key, *more, F.posexplode_outer(inner(F.col(html), "tr")).alias("row_pos", "r"))
    rows = rows.withColumn("td", inner(F.col("r"), "td"))
    return rows.withColumn("row_title", F.trim(F.lower(F.regexp_replace(plain(F.get("td", F.lit(0))), r"\+", "")))).drop("r")


def _value(cell: Column) -> Column:
    return F.replace(plain(cell), F.lit(","), F.lit(""))


def cells(tables: DataFrame, key: str = "company_id", html: str = "html") -> DataFrame:
    """(key, row_pos, row_title, col_index, value) of each body cell after a row's title; rows of one cell are left out."""
    rows = _rows(tables, key, html).select(key, "row_pos", "row_title", F.posexplode_outer("td").alias("col_index", "c")).where("col_index > 0")
    return rows.select(key, "row_pos", "row_title", "col_index", _value(F.col("c")).alias("value"))


def _last_heads(html: Column, most: int = 4, skip: tuple[str, ...] = ("TTM",)) -> Column:
    """array<struct(col_index, period)> of the last `most` header cells that aren't blank or in `skip`."""
    heads = F.transform(inner(html, "th"), lambda h, i: F.struct(i.alias("col_index"), F.regexp_replace(plain(h), r"^Mar (\d{4})$", "FY$1").alias("period")))
    heads = F.filter(heads, lambda h: (h["period"] != "") & ~h["period"].isin(*skip))
    return F.slice(heads, F.greatest(F.size(heads) - most + 1, F.lit(1)), most)


def periods(tables: DataFrame, key: str = "company_id", html: str = "html", **kept) -> DataFrame:
    """(key, col_index, period) of the last `most` header cells, in a row's array, without a shuffle."""
    return tables.select(key, F.inline_outer(_last_heads(F.col(html), **kept))).where("col_index is not null")


def items(tables: DataFrame, key: str = "company_id", html: str = "html", **kept) -> DataFrame:
    """A row per key and kept period with each line item: the first row in table order whose title has the item's name.

    Cells meet their periods in the page's own row, by place, and only cells of kept periods and named rows are cleaned.
    """
    rows = _rows(tables.select(key, html, _last_heads(F.col(html), **kept).alias("heads")), key, html, "heads")
    rows = rows.select(key, "row_pos", "row_title", "td", F.inline_outer("heads")).where((F.col("col_index") > 0) & (F.col("col_index") < F.size("td")))
    values = rows.select(key, "row_pos", "row_title", "col_index", "period", number(_value(F.get("td", F.col("col_index")))).alias("v"))
    picks = [F.min_by("v", F.when(F.contains("row_title", F.lit(name)), F.col("row_pos"))).alias(out) for name, out in ITEMS.items()]
    return values.groupBy(key, "col_index", "period").agg(*picks)


def measures(rows: DataFrame) -> DataFrame:
    """Money in units instead of crores, and the operating margin: OPM / 100, else profit over revenue."""
    unit = lambda c: (F.col(c) * UNIT).cast(MONEY).alias(c)
    own = ratio(F.col("operating_profit"), F.nullif(F.col("revenue"), F.lit(0).cast(MONEY)))
    margin = F.coalesce((F.col("opm") / 100).cast("decimal(10,4)"), own).alias("operating_margin")
    return rows.select(*[c for c in rows.columns if c not in ITEMS.values()], unit("revenue"), unit("net_profit"), unit("operating_profit"), margin, F.col("eps").cast("decimal(10,4)").alias("eps"))


def growth(rows: DataFrame, key: str = "company_id") -> DataFrame:
    """Adds revenue_growth and profit_growth against the last earlier kept period that isn't null or 0, if that is positive."""
    w = Window.partitionBy(key).orderBy("col_index").rowsBetween(Window.unboundedPreceding, -1)
    for name, c in (("revenue_growth", "revenue"), ("profit_growth", "net_profit")):
        before = F.last(F.nullif(F.col(c), F.lit(0).cast(MONEY)), ignorenulls=True).over(w)
        rows = rows.withColumn(name, F.when(before > 0, ratio(F.col(c) - before, before)))
    return rows


def anchors(html: Column) -> Column:
    """array<struct(href, text)> of links in page order."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)(<a\s[^>]*>.*?)</a>"), 1)
    return F.transform(found, lambda a: F.struct(attribute(a, "href").alias("href"), attribute(a, "title").alias("title"), plain(a).alias("text")))


def attribute(element: Column, name: str) -> Column:
    """An attribute of the tag that a text begins with, in double, single or no quotes; "" without it."""
    found = F.regexp_extract(element, rf"(?is)^<[^>]*?\s{name}\s*=\s*(\"[^\"]*\"|'[^']*'|[^\s>\"']+)", 1)
    return F.regexp_replace(found, r"^[\"']|[\"']$", "")


def section(html: Column, ident: str) -> Column:
    """From the element with this id to the next section's end."""
    return F.regexp_extract(html, rf"(?is)id=\"{ident}\"[^>]*>(.*?)</(?:section|ul)>", 1)


def report_links(pages: DataFrame, words: tuple[str, ...] = ("annual", "bseplus", "corpfiling")) -> DataFrame:
    """(company_id, pos, href, title): links to .pdf with a keyword in text or target, the first for each target."""
    links = pages.select("company_id", F.posexplode_outer(anchors(F.col("html"))).alias("pos", "a")).where("pos is not null").select("company_id", "pos", "a.*")
    both = F.lower(F.concat_ws(" ", "text", "href"))
    named = F.lit(False)
    for w in words:
        named = named | F.contains(both, F.lit(w))
    links = links.where(F.contains(F.lower("href"), F.lit(".pdf")) & named)
    first = F.row_number().over(Window.partitionBy("company_id", "href").orderBy("pos"))
    return links.withColumn("n", first).where("n = 1").select("company_id", "pos", "href", F.coalesce(F.nullif("text", F.lit("")), F.lit("Annual Report")).alias("title"))


def transcript_links(pages: DataFrame) -> DataFrame:
    """(company_id, pos, href, period): of each list item the first link called a transcript that isn't audio or video."""
    li = pages.select("company_id", F.posexplode_outer(inner(F.col("html"), "li")).alias("pos", "li")).where("pos is not null")

    def wanted(a: Column) -> Column:
        name = F.lower(F.concat_ws(" ", a["text"], a["title"]))
        media = F.rlike(F.lower(a["href"]), F.lit(r"\.(mp3|mp4|wav|m4a)|youtube|youtu\.be"))
        return F.contains(name, F.lit("transcript")) & ~media

    found = li.select("company_id", "pos", F.get(F.filter(anchors(F.col("li")), wanted), F.lit(0)).alias("a"), F.coalesce(F.nullif(F.regexp_extract("li", r"<div[^>]*>(.*?)</div>", 1), F.lit("")), F.lit("Unknown Period")).alias("period"))
    return found.where("a is not null").select("company_id", "pos", "a.href", "period")


def fetch_plan(reports: DataFrame, transcripts: DataFrame, calls: int = 4) -> DataFrame:
    """(company_id, role, href): the first annual report, else the first transcript, as main; and the first `calls` transcripts."""
    main = reports.groupBy("company_id").agg(F.min_by("href", "pos").alias("r"))
    call = transcripts.groupBy("company_id").agg(F.min_by("href", "pos").alias("t"))
    main = main.join(call, "company_id", "full").select("company_id", F.lit("main").alias("role"), F.coalesce("r", "t").alias("href"))
    nth = F.row_number().over(Window.partitionBy("company_id").orderBy("pos"))
    return main.unionByName(transcripts.withColumn("n", nth).where(F.col("n") <= calls).select("company_id", F.lit("concall").alias("role"), "href"))
