"""Verification of candidate pairs on full sets of longs, by hubs.

A pair's end that has more pairs is its hub. Members meet their hub in blocks of BLOCK, so that a hub's set is shipped once a
block and not once a pair, a member's once a pair, and a hub of any number of pairs is spread over its blocks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import staged

BLOCK = 1000


def _check(percent: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, hubs_sets = None, []  # a block's hub comes first and may be in a batch before its members
        for batch in batches:
            column = batch.column("s")
            off, values = column.offsets.to_numpy(), column.values.to_numpy()
            hub, salt = batch.column("hub").to_numpy(), batch.column("salt").to_numpy()
            heads = batch.column("member").is_null().to_numpy(zero_copy_only=False)
            member = batch.column("member").fill_null(0).to_numpy()
            cuts = [0, *(np.flatnonzero((np.diff(hub) != 0) | (np.diff(salt) != 0)) + 1).tolist(), len(batch)]
            found_hub, found_member = [], []
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if block != (hub[a], salt[a]):
                    block, hubs_sets = (hub[a], salt[a]), []
                while a < b and heads[a]:
                    hubs_sets.append(np.sort(values[off[a] : off[a + 1]]))
                    a += 1
                if a == b:
                    continue
                flat, starts, sizes = values[off[a] : off[b]], off[a:b] - off[a], np.diff(off[a : b + 1])
                fits = np.zeros(b - a, bool)
                for own in hubs_sets:
                    at = np.minimum(np.searchsorted(own, flat), len(own) - 1)
                    shared = np.add.reduceat((own[at] == flat).astype(np.int64), starts)
                    fits |= 100 * shared >= percent * (len(own) + sizes - shared)
                found_hub.append(hub[a:b][fits])
                found_member.append(member[a:b][fits])
            if found_hub:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found_hub)), pa.array(np.concatenate(found_member))], ["u", "v"])

    return run


def linked(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Of pairs (u, v) of different longs, those with 100 * intersection >= percent * union, as (greater, lesser), once each.

    `sets` (id, s) has sets of distinct longs, none empty. An id may have several: any two that fit link their ids. Pairs of
    which an end has no set are left out; empty tables give an empty one.
    """
    degrees = staged(pairs.select(F.explode(F.array("u", "v")).alias("id")).groupBy("id").agg(F.count("*").alias("n")), "degrees")  # a plain table, so that joins with it can be split
    both = pairs.join(degrees.select(F.col("id").alias("u"), F.col("n").alias("nu")), "u").join(degrees.select(F.col("id").alias("v"), F.col("n").alias("nv")), "v")
    of_u = F.expr("nu > nv or nu = nv and u < v")
    dealt = both.select(F.when(of_u, F.col("u")).otherwise(F.col("v")).alias("hub"), F.when(of_u, F.col("v")).otherwise(F.col("u")).alias("member"), F.ceil(F.greatest("nu", "nv") / BLOCK).cast("int").alias("blocks"))
    dealt = dealt.withColumn("salt", F.pmod(F.xxhash64("member"), F.col("blocks")).cast("int"))
    members = dealt.join(sets.select(F.col("id").alias("member"), "s"), "member").select("hub", "salt", "member", "s")
    heads = dealt.select("hub", "salt").distinct().join(sets.select(F.col("id").alias("hub"), "s"), "hub").select("hub", "salt", F.lit(None).cast("long").alias("member"), "s")
    met = heads.unionByName(members).repartition("hub", "salt").sortWithinPartitions("hub", "salt", F.col("member").asc_nulls_first())
    return met.mapInArrow(_check(percent), "u long, v long").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct()
