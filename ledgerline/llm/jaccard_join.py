"""Jaccard join of documents on word n-grams: a grouped prefix join.

Texts with the same shingle set are one class, which its least doc_id stands for. Shingles are ordered by rarity, those that
one class alone has first: they are in no join, so a set's prefix is what its first n - ceil(p n) + 1 shingles hold beyond
them, and a set without any is done. Sets with the same prefix, size and number of lone shingles are one group. Groups meet on
prefix shingles under length and positional bounds; group pairs are expanded to their members and verified on full sets.

Any one order keeps all links, so the order may be by counts over those sets that can have a partner at all. Which sets can is
found beforehand: of a linked set's first shingles by hash, a share must be among the first ones of some other set too.

For components not every pair must be checked: members are held against their group's first, a shingle's groups against its most
shared one, and some of a frequent shingle's members against one of them drawn by hash, another one for each shingle, since near
copies of one text needn't all be like their group's first or the most shared one. Only pairs that are then in different components go through the exact
join. A shingle's largest component isn't paired with itself there, so a shingle that most sets have costs its other components
only.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .arrays import slices
from .components import components
from .near_dedup import _digest, shingle_sets
from .set_pairs import linked
from .shared import bitmap, in_bitmap, staged, texts

WORDS, PERCENT = 5, 80
#: Shingles of more sets than MANY have a drawn lead; one in DRAWN of these sets, by hash, is held against it.
MANY, DRAWN = 16, 3
#: Shingles that the first look takes beyond the prefix, as a share of the set: more prune better and cost more.
BEYOND = 0.1


def _sizes(n: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in slices(whole, "text"):
                sets = shingle_sets(batch, n)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id"), batch.column("uid"), pa.array([len(s) for s in sets], pa.int64()), pa.array([_digest(s) for s in sets], pa.binary())],
                    ["doc_id", "uid", "n_shingles", "digest"],
                )

    return run


def _first(s: np.ndarray, percent: int) -> tuple[np.ndarray, int]:
    """(first shingles by hash, how many of them a partner must have among its own first ones).

    A partner lacks at most n - ceil(p n) of the n shingles, so of the first n - ceil(p n) + l it has l, and the first
    min(l, l') common ones lie among both sets' first ones; a partner's l' is at least BEYOND * p * n.
    """
    n = len(s)
    least = -(-n * percent // 100)
    return s[: n - least + max(1, int(np.ceil(BEYOND * n)))], max(1, int(BEYOND * percent / 100 * n))


def _chosen(batches: Iterator[pa.RecordBatch], n: int, reps) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    for whole in batches:
        for batch in slices(whole, "text"):
            ids = batch.column("doc_id").fill_null(0).to_numpy()
            batch = batch.filter(pa.array(in_bitmap(reps.value, ids) & batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)))
            if len(batch):
                yield batch, shingle_sets(batch, n)


def _firsts(n: int, percent: int, reps) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in _chosen(batches, n, reps):
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([_first(s, percent)[0] for s in sets]).view(np.int64))], ["t"])

    return run


def _open_sets(n: int, percent: int, reps, repeated) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, sets in _chosen(batches, n, reps):
            firsts = [_first(s, percent) for s in sets]
            hit = np.concatenate([[0], np.cumsum(in_bitmap(repeated.value, np.concatenate([f for f, _ in firsts]).view(np.int64)))])
            end = np.cumsum([len(f) for f, _ in firsts])
            ok = [len(s) > 0 and hit[e] - hit[e - len(f)] >= least for s, (f, least), e in zip(sets, firsts, end.tolist())]
            kept = [s for s, y in zip(sets, ok) if y]
            if kept:
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").filter(pa.array(ok)), pa.array([_digest(s) for s in kept], pa.binary()), pa.array([s.view(np.int64) for s in kept], pa.list_(pa.int64()))],
                    ["id", "digest", "s"],
                )

    return run


def _sized(documents: DataFrame, words: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(documents with a uid, sizes and digests of their sets, classes)."""
    docs = texts(documents).withColumn("uid", F.xxhash64("doc_id", "text"))
    sizes = staged(docs.mapInArrow(_sizes(words), "doc_id long, uid long, n_shingles long, digest binary"), "sizes")
    classes = sizes.where("digest is not null and doc_id is not null").groupBy("digest").agg(F.min("doc_id").alias("rep"))
    return docs, sizes, staged(classes, "classes")


def _sets(docs: DataFrame, classes: DataFrame, words: int, percent: int) -> DataFrame:
    """(id, digest, s): full sets of the classes that may have a partner. The two bitmaps only keep more, never less."""
    sc = docs.sparkSession.sparkContext
    reps = sc.broadcast(bitmap(classes, "rep"))
    seen = docs.mapInArrow(_firsts(words, percent, reps), "t long").groupBy("t").agg(F.count("*").alias("n")).where("n > 1")
    repeated = sc.broadcast(bitmap(seen, "t"))
    sets = docs.mapInArrow(_open_sets(words, percent, reps, repeated), "id long, digest binary, s array<long>")
    out = staged(sets.join(classes.select(F.col("rep").alias("id"), "digest"), ["id", "digest"], "left_semi").dropDuplicates(["id", "digest"]), "sets")
    reps.unpersist()
    repeated.unpersist()
    return out


def _grouped(sets: DataFrame, percent: int) -> DataFrame:
    """(id, g, n, lone, few, prefix): each set with shared shingles in its prefix, in its group g.

    The prefix's nth shingle (from 1) is the set's (lone + nth) rarest. Of two linked sets the smaller one's first `few`
    shingles and the larger one's prefix have one in common.
    """
    each = sets.select("id", F.xxhash64("digest").alias("nth"), F.size("s").alias("n"), F.explode("s").alias("t"))
    shared = each.groupBy("t").agg(F.count("*").alias("df")).where("df > 1")
    order = each.join(shared, "t").groupBy("id", "nth").agg(F.first("n").alias("n"), F.array_sort(F.collect_list(F.struct("df", "t"))).alias("o"))
    order = order.withColumn("lone", F.col("n") - F.size("o"))
    beyond = F.col("n") - F.ceil(F.col("n") * percent / 100) + 1 - F.col("lone")
    few = F.col("n") - F.ceil(F.col("n") * (2 * percent) / (100 + percent)) + 1
    prefix = F.transform(F.slice("o", F.lit(1), beyond.cast("int")), lambda e: e["t"])
    order = order.where(beyond > 0).select("id", "n", "lone", few.cast("int").alias("few"), prefix.alias("prefix"))
    key = F.concat_ws(",", F.col("n"), F.col("lone"), F.transform("prefix", lambda t: t.cast("string")))
    return staged(order.withColumn("g", F.unhex(F.sha2(key, 256))), "members")


def _postings(groups: DataFrame) -> DataFrame:
    return groups.select("*", F.posexplode("prefix").alias("i", "t")).withColumn("i", F.col("i") + F.col("lone") + 1).drop("prefix", "lone")


def _leads(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): each member with its group's first and, for some of its frequent shingles, with a drawn one of the shingle's members;
    each group's first with that of the most shared group of each of its shingles. The pairs grow with the postings."""
    groups = staged(members.groupBy("g").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("lone").alias("lone"), F.first("few").alias("few"), F.first("prefix").alias("prefix")), "groups")
    inside = members.join(groups.select("g", F.col("id").alias("lead")), "g").where("id <> lead").select("id", "lead")
    posted = _postings(groups).select("t", "id", "n")
    held = posted.groupBy("t").agg(F.count("*").alias("k")).where("k > 1")
    posted = staged(posted.join(held, "t"), "postings")
    weight = posted.groupBy("id").agg(F.sum("k").alias("w"))
    leads = posted.join(weight, "id").groupBy("t").agg(F.min(F.struct(-F.col("w"), "id", "n")).alias("m")).select("t", F.col("m.id").alias("lead"), F.col("m.n").alias("m"))
    fits = f"id <> lead and 100 * least(n, m) >= {percent} * greatest(n, m)"
    between = posted.join(leads, "t").where(fits).select("id", "lead")
    each = _postings(members).select("t", "id", "n")
    drawn = each.groupBy("t").agg(F.count("*").alias("k"), F.max(F.struct(F.xxhash64("id", "t").alias("h"), "id", "n")).alias("m")).where(F.col("k") > MANY)
    drawn = staged(drawn.select("t", F.col("m.id").alias("lead"), F.col("m.n").alias("m")), "drawn")
    some = each.where(F.pmod(F.xxhash64("t", "id"), F.lit(DRAWN)) == 0).join(drawn, "t").where(fits).select("id", "lead")
    between = between.unionByName(some)
    return staged(inside.unionByName(between).select(F.greatest("id", "lead").alias("u"), F.least("id", "lead").alias("v")).distinct(), "leads")


def _candidates(members: DataFrame, percent: int) -> DataFrame:
    """(u, v): pairs of members (with comp) of different components that may be linked; none that is gets lost."""
    parts = _postings(members.select("g", "comp", "n", "lone", "few", "prefix").dropDuplicates(["g", "comp"]))
    counts = parts.groupBy("t", "comp").agg(F.count("*").alias("k")).groupBy("t").agg(F.max_by("comp", F.struct("k", "comp")).alias("main"), F.count("*").alias("comps"))
    parts = staged(parts.join(counts.where("comps > 1").drop("comps"), "t"), "postings")
    a, b = parts.where("comp <> main").alias("a"), parts.alias("b")
    once = F.expr("b.comp = b.main or a.comp < b.comp")  # of two that are both beside the main component
    small_a = F.expr("a.n < b.n or a.n = b.n and a.g <= b.g")
    prefixes = F.when(small_a, F.expr("a.i <= a.few")).otherwise(F.expr("b.i <= b.few"))
    lengths = F.expr(f"100 * least(a.n, b.n) >= {percent} * greatest(a.n, b.n)")
    places = 1 + F.least(F.expr("a.n - a.i"), F.expr("b.n - b.i")) >= F.ceil((F.col("a.n") + F.col("b.n")) * percent / (100 + percent))
    met = a.join(b, (F.col("a.t") == F.col("b.t")) & (F.col("a.comp") != F.col("b.comp")) & once & prefixes & lengths & places)
    met = staged(met.select(F.col("a.g").alias("g"), F.col("a.comp").alias("comp"), F.col("b.g").alias("g2"), F.col("b.comp").alias("comp2")).distinct(), "group-pairs")
    own, other = members.select("g", "comp", "id"), members.select(F.col("g").alias("g2"), F.col("comp").alias("comp2"), F.col("id").alias("id2"))
    pairs = met.join(own, ["g", "comp"]).join(other, ["g2", "comp2"]).where("id <> id2")
    return pairs.select(F.greatest("id", "id2").alias("u"), F.least("id", "id2").alias("v")).distinct()


def jaccard_links(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(u, v), u > v: every two classes of `documents` (doc_id, text) with 100 * intersection >= percent * union, by their least
    doc_ids. Copies are in one class and make no pairs. The rows grow with the links that there are."""
    docs, _, classes = _sized(documents, words)
    sets = _sets(docs, classes, words, percent)
    members = _grouped(sets, percent).withColumn("comp", F.col("id"))
    return linked(staged(_candidates(members, percent), "pairs"), sets, percent)


def jaccard_components(documents: DataFrame, words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """(doc_id, n_shingles, component_id, class_id), a row for each row of `documents` (doc_id, text).

    Null, empty and word-free texts have n_shingles 0 and are linked with nothing; nor is a null doc_id, whose component_id and
    class_id are null. Rows that repeat a doc_id are judged each by its own text; where the id is a class's least one, it also
    stands for the links of the id's other texts. Other columns are ignored; an empty table gives an empty one.
    """
    docs, sizes, classes = _sized(documents, words)
    sets = _sets(docs, classes, words, percent)
    members = _grouped(sets, percent)
    leads = _leads(members, percent)
    links = staged(linked(leads, sets, percent), "links")
    found = components(links)
    placed = staged(members.join(found, F.col("id") == F.col("node"), "left").select("id", "g", "n", "lone", "few", "prefix", F.coalesce("root", "id").alias("comp")), "placed")
    more = staged(_candidates(placed, percent).join(leads, ["u", "v"], "left_anti"), "pairs")
    if not more.isEmpty():
        found = components(links.unionByName(linked(more, sets, percent)))

    roots = classes.join(found, F.col("rep") == F.col("node"), "left").select("digest", "rep", F.coalesce("root", "rep").alias("root"))
    out = sizes.join(roots, "digest", "left")
    own = lambda c: F.when(F.col("doc_id").isNotNull(), F.coalesce(c, "doc_id"))
    return out.select("doc_id", "n_shingles", own("root").alias("component_id"), own("rep").alias("class_id"))
