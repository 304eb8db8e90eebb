"""Column functions: names, labels, money and percent forms. Money is decimal and rounds half up."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from .values import STATUSES


def squeezed(text: Column) -> Column:
    """Any white space, Unicode's too, as one space; trimmed."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def ticker_or_name(ticker: Column, name: Column) -> Column:
    return F.upper(F.trim(F.coalesce(F.nullif(ticker, F.lit("")), F.left(name, F.lit(6)))))


def ticker_of_url(url: Column, name: Column) -> Column:
    return F.upper(F.coalesce(F.nullif(F.regexp_extract(url, "/company/([^/]+)/", 1), F.lit("")), F.left(name, F.lit(6))))


def is_concall(document_type: Column, file_name: Column) -> Column:
    return F.coalesce(document_type == "concall_transcript", F.lit(False)) | F.coalesce(F.contains(F.lower(file_name), F.lit("concall")), F.lit(False))


def scaled(value: Column, exponent: int, digits: int, commas: bool = False) -> Column:
    """|value| / 10**exponent with `digits` decimals, half up, by whole numbers. value is a decimal of scale 4."""
    unit = 10 ** (4 + exponent - digits)
    n = F.abs((value.cast("decimal(20,4)") * 10000).cast("decimal(24,0)")).cast("long")
    up = n + F.lit(unit // 2)
    t = ((up - up % unit) / unit).cast("long")
    whole, part = ((t - t % 10**digits) / 10**digits).cast("long"), t % 10**digits
    return F.concat(F.format_number(whole, 0) if commas else whole.cast("string"), F.lit("."), F.lpad(part.cast("string"), digits, "0"))


def units(value: Column, digits: int) -> Column:
    """A double times 10**digits as a long, its half away from zero, as SQL casts doubles: sums of these are exact and need no decimals."""
    shifted = F.abs(value.cast("double")) * F.lit(float(10**digits))
    down = F.floor(shifted)
    return F.when(shifted - down >= 0.5, down + 1).otherwise(down) * F.when(value < 0, -1).otherwise(1)


def from_units(whole: Column, digits: int, kind: str) -> Column:
    return (whole.cast("decimal(20,0)") * F.lit(Decimal(1).scaleb(-digits))).cast(kind)


def places(value: Column, digits: int = 4, kind: str = "decimal(10,4)") -> Column:
    """A double as a decimal of `digits` places: the double times 10**digits, its half away from zero, as SQL casts doubles.

    Spark's own cast and round take the double's shortest decimal form, so 12.95155, which lies below the half, goes up there.
    """
    return from_units(units(value, digits), digits, kind)


def ratio(above: Column, below: Column, digits: int = 4, kind: str = "decimal(10,4)") -> Column:
    """above / below as doubles, as a decimal; null where below is."""
    return places(above.cast("double") / below.cast("double"), digits, kind)


def sign(value: Column, plus: str = "") -> Column:
    return F.when(value < 0, F.lit("-")).otherwise(F.lit(plus))


def money_short(value: Column, currency: Column) -> Column:
    """₹x.xCr for INR, else $x.xB; N/A for null. The sign stands before the number."""
    inr = currency == "INR"
    return F.coalesce(F.when(inr, F.concat(F.lit("₹"), sign(value), scaled(value, 7, 1), F.lit("Cr"))).otherwise(F.concat(F.lit("$"), sign(value), scaled(value, 9, 1), F.lit("B"))), F.lit("N/A"))


def money_long(value: Column, currency: Column) -> Column:
    inr = currency == "INR"
    return F.coalesce(F.when(inr, F.concat(F.lit("₹"), sign(value), scaled(value, 7, 2, True), F.lit(" Crores"))).otherwise(F.concat(F.lit("$"), sign(value), scaled(value, 9, 2, True), F.lit(" Billion"))), F.lit("N/A"))


def money_adaptive(value: Column) -> Column:
    """B, M or K by size, two decimals, sign kept; under a thousand as it is."""
    size = F.abs(value)
    form = F.when(size >= 10**9, F.concat(scaled(value, 9, 2), F.lit("B"))).when(size >= 10**6, F.concat(scaled(value, 6, 2), F.lit("M"))).when(size >= 1000, F.concat(scaled(value, 3, 2), F.lit("K")))
    return F.concat(sign(value), form.otherwise(scaled(value, 0, 2)))


def percent(value: Column, plus: str = "") -> Column:
    """x.x% of a ratio of scale 4; plus is put before values of at least 0."""
    return F.coalesce(F.concat(sign(value, plus), scaled(value, -2, 1), F.lit("%")), F.lit("N/A"))


def risk_label(title: Column, page: Column) -> Column:
    short = F.when(F.length(title) > 16, F.concat(F.left(title, F.lit(16)), F.lit(".."))).otherwise(title)
    return F.concat(F.lit("⚠️ "), short, F.lit(" (p."), page.cast("string"), F.lit(")"))


def page_ref(first: Column, last: Column) -> Column:
    return F.when(first == last, F.concat(F.lit("Page "), first.cast("string"))).otherwise(F.concat(F.lit("Pages "), first.cast("string"), F.lit("-"), last.cast("string")))


def truncated(text: Column, most: int = 32000) -> Column:
    return F.when(F.length(text) > most, F.concat(F.left(text, F.lit(most)), F.lit("... [TRUNCATED]"))).otherwise(text)


def safe_name(ticker: Column, title: Column) -> Column:
    return F.concat(ticker, F.lit("_"), F.btrim(F.regexp_replace(title, r"(?U)[^\w\-]", "_"), F.lit("_")), F.lit(".pdf"))


def without_fragment(url: Column) -> Column:
    return F.substring_index(url, "#", 1)


def ratios(json: Column) -> Column:
    """A map of strings; empty for null or bad JSON."""
    return F.coalesce(F.from_json(json, "map<string,string>"), F.create_map().cast("map<string,string>"))


def valid_status(status: Column, allowed: list[str] = STATUSES) -> Column:
    return F.coalesce(status.isin(allowed), F.lit(False))


def number(text: Column) -> Column:
    """Digits, points and signs of a cell as a decimal; null if that is no number."""
    return F.nullif(F.regexp_replace(text, r"[^\d.\-]", ""), F.lit("")).try_cast("decimal(20,4)")
