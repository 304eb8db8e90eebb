"""Pages, chunks, risks, sentences and guidance of filings, set at a time."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import is_concall, page_ref, squeezed
from ..functions.values import DEFAULT_RISK, DEFAULT_RISK_TEXT, GUIDANCE, RISKS

PAGE, SIZE, OVERLAP, LEAST, FEW_WORDS = 2000, 1000, 150, 50, 20
REPORT_PAGES, CALL_PAGES, MOST_RISKS, MOST_GUIDANCE = 60, 40, 6, 60


def page_array(text: Column, size: int = PAGE) -> Column:
    """array<struct(page_number, text)>: a text without pages of its own in windows of `size` characters; one page at least."""
    starts = F.sequence(F.lit(0), F.greatest(F.length(text) - 1, F.lit(0)), F.lit(size))
    return F.transform(starts, lambda at: F.struct((at / size + 1).cast("int").alias("page_number"), F.substring(text, at + 1, F.lit(size)).alias("text")))


def page_cap(document_type: Column, file_name: Column) -> Column:
    """How many pages of a document are read: CALL_PAGES of a call, REPORT_PAGES of any other."""
    return F.when(is_concall(document_type, file_name), CALL_PAGES).otherwise(REPORT_PAGES)


def capped_pages(documents: DataFrame, cap: Column) -> DataFrame:
    """documents with their first `cap` pages only, before any page is taken apart."""
    return documents.withColumn("pages", F.slice("pages", F.lit(1), cap))


def page_stats(pages: DataFrame, few_words: int = FEW_WORDS) -> DataFrame:
    """Adds the squeezed text, word_count and is_scanned to pages (document_id, page_number, text)."""
    text = squeezed(F.col("text"))
    words = F.when(text == "", 0).otherwise(F.size(F.split(text, " ")))
    return pages.withColumn("word_count", words).withColumn("is_scanned", F.col("word_count") < few_words).withColumn("text", text)


def totals(stats: DataFrame) -> DataFrame:
    return stats.groupBy("document_id").agg(F.count("*").alias("total_pages"), F.sum("word_count").alias("total_words"), F.count_if("is_scanned").alias("scanned_pages"))


def chunks(documents: DataFrame, size: int = SIZE, overlap: int = OVERLAP, least: int = LEAST, most_pages: int | Column | None = REPORT_PAGES) -> DataFrame:
    """Overlapping windows of each page of documents (document_id, company_id, pages), of the first most_pages (None: all; a column,
    such as page_cap gives: each document's own).

    A row's pages stay in the row, so nothing is shuffled.
    """
    size, overlap = size or SIZE, overlap or OVERLAP
    step = max(1, size - overlap)

    def of_page(p: Column) -> Column:
        starts = F.when(F.length(p["text"]) > 0, F.sequence(F.lit(0), F.length(p["text"]) - 1, F.lit(step))).otherwise(F.array().cast("array<int>"))
        return F.transform(starts, lambda at: F.struct(p["page_number"].alias("page"), F.trim(F.substring(p["text"], at + 1, F.lit(size))).alias("content")))

    kept = F.filter(F.flatten(F.transform(F.filter("pages", lambda p: F.lit(True) if most_pages is None else p["page_number"] <= most_pages), of_page)), lambda c: F.length(c["content"]) >= least)
    out = documents.select("document_id", "company_id", F.posexplode_outer(kept).alias("chunk_index", "c")).where("chunk_index is not null")  # the plain form would build `kept` twice, once to filter by its size
    return out.select("document_id", "company_id", "chunk_index", F.col("c.page").alias("page_start"), F.col("c.page").alias("page_end"), "c.content")


def required_literals(pattern: str) -> list[str] | None:
    """For each alternative of a pattern like (a\\s+b|c), the longest literal that it can't match without; None for other patterns."""
    inner = pattern[1:-1] if pattern.startswith("(") and pattern.endswith(")") else pattern
    parts = [alternative.split(r"\s+") for alternative in inner.split("|")]
    if any(re.search(r"[^\w /&,'-]", piece) for pieces in parts for piece in pieces) or not all(max(pieces, key=len) for pieces in parts):
        return None
    return list(dict.fromkeys(max(pieces, key=len) for pieces in parts))


def guarded(text: Column, pattern: str, found: Column, missing: Column) -> Column:
    """`found`, evaluated only where the text holds a literal that the pattern needs; else `missing`."""
    needed = required_literals(pattern)
    if needed is None:
        return found
    held = F.contains(text, F.lit(needed[0]))
    for literal in needed[1:]:
        held = held | F.contains(text, F.lit(literal))
    return F.when(held, found).otherwise(missing)


def tag_risks(pages: DataFrame, most: int | None = MOST_RISKS, categories: list[tuple[str, str]] = RISKS) -> DataFrame:
    """(document_id, risk, description, page_number): each category's first page, at most `most` (None: all) per document by page and category.

    Contents pages, and index pages under 300 characters, are skipped. A pattern runs, once, over the pages that hold one of
    its literals; the snippet around a match is cut only where there is one. Only snippets are shuffled, not pages. A null
    text has no risks. Pages aren't skipped by a filter: Spark would push it down and lower each page three times.
    """
    pages = pages.select("document_id", "page_number", "text", F.lower("text").alias("low"))
    skipped = F.contains("low", F.lit("table of contents")) | (F.contains("low", F.lit("index")) & (F.length("text") < 300))
    hits = F.array(*(guarded(F.col("low"), p, F.regexp_instr("low", F.lit(p)), F.lit(0)) for _, p in categories))
    places = pages.select("document_id", "page_number", "text", "low", F.posexplode_outer(F.when(~skipped, hits)).alias("k", "at")).where("at > 0")
    found = F.coalesce(*(F.when(F.col("k") == i, F.regexp_extract("low", p, 1)) for i, (_, p) in enumerate(categories)))
    risk = F.get(F.array(*(F.lit(title) for title, _ in categories)), F.col("k"))
    begin = F.greatest(F.col("at") - 51, F.lit(0))
    snippet = squeezed(F.substring(F.col("text"), begin + 1, F.col("at") - 1 + F.length(found) + 250 - begin))
    rows = places.select("document_id", "page_number", "k", risk.alias("risk"), snippet.alias("s"))
    description = F.when(F.length("s") > 200, F.concat(F.left("s", F.lit(197)), F.lit("..."))).otherwise(F.col("s"))
    first = F.row_number().over(Window.partitionBy("document_id", "k").orderBy("page_number"))
    nth = F.row_number().over(Window.partitionBy("document_id").orderBy("page_number", "k"))
    rows = rows.withColumn("n", first).where("n = 1").withColumn("n", nth)
    rows = rows if most is None else rows.where(F.col("n") <= most)
    return rows.select("document_id", "risk", description.alias("description"), "page_number", F.col("n").cast("int").alias("n"))


def with_default_risk(risks: DataFrame, documents: DataFrame) -> DataFrame:
    """Documents (document_id, ticker) without a hit get the general disclosure on page 1. `risks` is read twice, so it should be a stored table."""
    head, tail = DEFAULT_RISK_TEXT.split("{}")
    none = documents.join(risks.select("document_id").distinct(), "document_id", "left_anti")
    text = F.concat(F.lit(head), "ticker", F.lit(tail))
    return risks.unionByName(none.select("document_id", F.lit(DEFAULT_RISK).alias("risk"), text.alias("description"), F.lit(1).alias("page_number"), F.lit(1).alias("n")))


def sentences(chunk_rows: DataFrame) -> DataFrame:
    """Sentences of 50 to 400 characters of chunks of 80 or more: adds pos and statement."""
    rest = [c for c in chunk_rows.columns if c != "content"]
    parts = F.when(F.length("content") >= 80, F.split("content", r"(?<=[.!?])\s+"))  # a filter would be pushed down and make the content twice
    rows = chunk_rows.select(*rest, F.posexplode_outer(parts).alias("pos", "s")).withColumn("statement", F.trim("s"))
    return rows.where(F.length("statement").between(50, 400)).drop("s")


def classify_guidance(rows: DataFrame, categories: list[tuple[str, str]] = GUIDANCE) -> DataFrame:
    """Adds the first category whose pattern the statement has, and drops the others.

    The statement is lowered once, in a column; the category comes from a generator of one row, through which Spark pushes no
    filter, so that it isn't found twice.
    """
    low = F.col("_low")
    category = F.coalesce(*(F.when(guarded(low, p, F.rlike(low, F.lit(p)), F.lit(False)), F.lit(t)) for t, p in categories))
    lowered = rows.withColumn("_low", F.lower("statement"))
    return lowered.select(*rows.columns, F.explode_outer(F.array(category)).alias("category")).where("category is not null")


def dedup_guidance(rows: DataFrame, scope: str | None = None) -> DataFrame:
    """The first statement of each lower-cased 60-character beginning: latest document, then chunk, then sentence."""
    key = [F.lower(F.left("statement", F.lit(60))), *([F.col(scope)] if scope else [])]
    first = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("document_id"), "chunk_index", "pos"))
    return rows.withColumn("n", first).where("n = 1").drop("n")


def top_guidance(rows: DataFrame, most: int | None = MOST_GUIDANCE, per: str | None = "company_id") -> DataFrame:
    """At most `most` statements (None: all) per company (or, with per=None, in all), with id chunk_ordinal and the page reference."""
    order = (F.desc("document_id"), "chunk_index", "pos")
    if per is None and most is not None:
        rows = rows.orderBy(*order).limit(most)
        nth = F.row_number().over(Window.orderBy(*order))  # at most `most` rows
    else:
        nth = F.row_number().over(Window.partitionBy(per or "company_id").orderBy(*order))
    rows = rows.withColumn("nth", nth - 1)
    rows = rows if most is None else rows.where(F.col("nth") < most)
    return rows.withColumn("guidance_id", F.concat("id", F.lit("_"), "nth")).withColumn("page", page_ref(F.col("page_start"), F.col("page_end")))
