"""Substring lookups between two sets of texts, without comparing all with all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

GRAM = 4


def _grams(text: Column, size: Column) -> Column:
    """The distinct pieces of `size` characters; none of a text that is shorter."""
    starts = F.when(F.length(text) >= size, F.sequence(F.lit(1), F.length(text) - size + 1)).otherwise(F.array().cast("array<int>"))
    return F.array_distinct(F.transform(starts, lambda at: F.substring(text, at, size)))


def held_in(needles: DataFrame, hays: DataFrame, gram: int = GRAM) -> DataFrame:
    """(needle, hay): each pair of texts of which the first lies in the second; nulls lie in nothing and hold nothing.

    A needle's pieces of `gram` characters (a shorter needle is one piece) are all in a hay that holds it, so the needle meets
    the hays by that piece alone which the fewest of them have; one with a piece that no hay has is done. Hays are cut into
    pieces of just those sizes that needles have, `gram` at most. Equal rows count once; an empty needle lies in every hay.
    """
    needles, hays = needles.where("needle is not null").select("needle").distinct(), hays.where("hay is not null").select("hay").distinct()
    size = F.least(F.length("needle"), F.lit(gram))
    parts = needles.where("needle <> ''").select("needle", size.alias("size"), F.explode(_grams(F.col("needle"), size)).alias("gram"))
    sizes = parts.groupBy("size").agg(F.lit(1).alias("one"))  # `gram` rows at most
    cut = hays.join(F.broadcast(sizes)).select("hay", F.explode(_grams(F.col("hay"), F.col("size"))).alias("gram"))
    counts = cut.groupBy("gram").agg(F.count("*").alias("n"))
    rarest = parts.join(counts, "gram", "left").groupBy("needle").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("least")).where("least.n > 0")
    met = rarest.select("needle", F.col("least.gram").alias("gram")).join(cut, "gram").where(F.contains("hay", F.col("needle"))).select("needle", "hay")
    empty = needles.where("needle = ''")  # one row at most
    return met.unionByName(hays.join(F.broadcast(empty)).select("needle", "hay"))
