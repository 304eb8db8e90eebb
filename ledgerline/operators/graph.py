"""Nodes and edges as tables: upserts, validity, neighbourhoods, for all companies at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.values import COLORS, SIZES
from ..sources.scratch import staged
from .lookup import held_in


def node_rows(rows: DataFrame, prefix: str, key: Column, label: Column, kind: str, seq: Column, properties: list, company: str = "company_id", color: Column | None = None) -> DataFrame:
    """Nodes of one kind, with their properties as JSON; seq orders the writes of an id."""
    color = F.lit(COLORS[kind]) if color is None else color
    return rows.select(
        F.concat(F.lit(prefix), key).alias("id"), label.alias("label"), F.lit(kind).alias("type"), color.alias("color"), F.lit(SIZES[kind]).alias("size"),
        F.col(company).cast("long").alias("company_id"), F.to_json(F.struct(*properties)).alias("properties"), seq.alias("seq"),
    )


def edge_rows(rows: DataFrame, source: Column, target: Column, label: Column, seq: Column, *properties) -> DataFrame:
    """Edges of one relation, with their properties as JSON."""
    held = F.to_json(F.struct(*properties)) if properties else F.lit("{}")
    return rows.select(source.alias("source"), target.alias("target"), label.alias("label"), F.col("company_id").cast("long").alias("company_id"), held.alias("properties"), seq.alias("seq"))


def upsert_nodes(nodes: DataFrame) -> DataFrame:
    """Of nodes (id, seq, ...) with the same id the last one written; of those with one seq the largest by its columns.

    Rows are dealt by id before they are compared: so they are sorted once, in parts of a shuffle's size, and not whole scan
    splits before the shuffle too, where next to no ids repeat.
    """
    rest = [c for c in nodes.columns if c not in ("id", "seq")]
    return nodes.repartition("id").groupBy("id").agg(F.max(F.struct("seq", *rest)).alias("n")).select("id", *(F.col("n")[c].alias(c) for c in rest))


def valid_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges (source, target, label, ...) of which both ends exist."""
    ids = nodes.select(F.col("id").alias("i")).distinct()
    return edges.join(ids, F.col("source") == F.col("i"), "left_semi").join(ids, F.col("target") == F.col("i"), "left_semi")


def first_edges(edges: DataFrame) -> DataFrame:
    """Adds id source_label_target and keeps the first edge (by seq, then the least by its columns) of each; dealt as upsert_nodes does."""
    edges = edges.withColumn("id", F.concat_ws("_", "source", "label", "target"))
    rest = [c for c in edges.columns if c not in ("id", "seq")]
    return edges.repartition("id").groupBy("id").agg(F.min(F.struct("seq", *rest)).alias("e")).select("id", *(F.col("e")[c].alias(c) for c in rest))


def named_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Distinct edges (source, target, label) of which both ends exist, with source_type, source_label, target_type and target_label.

    Nodes have one row an id; kept in buckets of it they aren't shuffled, and they are never broadcast. Edges are shuffled twice, by target and by source, and
    stay dealt by source. Edges that agree in the three columns have one id, so the first of them is any of them.
    """
    end = lambda e: nodes.select(F.col("id").alias(e), F.col("type").alias(f"{e}_type"), F.col("label").alias(f"{e}_label")).hint("merge")
    rows = edges.select("source", "target", "label").join(end("target"), "target").join(end("source"), "source")
    return rows.select("source", "target", "label", "source_type", "source_label", "target_type", "target_label").distinct()


def members(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(company, node): each company node and what its outgoing edges reach."""
    companies = nodes.where("type = 'company'").select(F.col("id").alias("company"))
    out = edges.join(companies, F.col("source") == F.col("company")).select("company", F.col("target").alias("node"))
    return companies.select("company", F.col("company").alias("node")).unionByName(out).distinct()


def subgraph_edges(edges: DataFrame, inside: DataFrame) -> DataFrame:
    """(company, edge columns): edges of which both ends are members of the company's neighbourhood."""
    a = inside.select("company", F.col("node").alias("source"))
    b = inside.select(F.col("company").alias("c"), F.col("node").alias("t"))
    return edges.join(a, "source").join(b, (F.col("company") == F.col("c")) & (F.col("target") == F.col("t"))).drop("c", "t")


def company_subgraphs(by_source: DataFrame, by_target: DataFrame) -> DataFrame:
    """(company, edge columns): what subgraph_edges gives, from edges with source_type, kept in buckets of source and of target.

    A company's own edges are all in its neighbourhood, so only edges of other nodes are tested. These meet the company edges
    to their source bucket by bucket; only the matches are shuffled, to be looked up among the company's targets. No join has
    a company alone as its key, so one with many edges is no hot key.
    """
    columns = by_source.columns
    out = by_target.where("source_type = 'company'").select(F.col("source").alias("company"), F.col("target").alias("node")).distinct()
    own = by_source.where("source_type = 'company'").withColumn("company", F.col("source"))
    near = by_source.where("source_type <> 'company'").join(out, F.col("source") == F.col("node")).drop("node")
    ends = out.withColumnRenamed("company", "c")
    inside = near.where("target <> company").join(ends, (F.col("target") == F.col("node")) & (F.col("company") == F.col("c")), "left_semi")
    return own.unionByName(inside).unionByName(near.where("target = company")).select("company", *columns)


def named_relations(edges: DataFrame) -> DataFrame:
    """What relations gives, from edges that hold their ends' labels: without meeting the nodes."""
    line = lambda node, arrow, other: edges.select(F.col(node).alias("node"), F.lit(arrow).alias("direction"), "label", F.col(other).alias("other"), F.col(f"{other}_label").alias("other_label"))
    return line("source", "→", "target").unionByName(line("target", "←", "source"))


def properties(nodes: DataFrame, *beside: str) -> DataFrame:
    """(node, key, kind, value, and the columns of the node named in `beside`) of every property that a node's JSON holds, whatever its kind: variants, exploded, with their type.

    A number's value has no trailing zeros; an object's or array's is its JSON. Nodes without properties, or with broken JSON,
    have no rows.
    """
    spark = nodes.sparkSession
    held = nodes.select(F.col("id").alias("node"), *beside, F.try_parse_json("properties").alias("held")).where("schema_of_variant(held) like 'OBJECT%'")
    rows = held.lateralJoin(spark.tvf.variant_explode(F.col("held").outer()))
    kind = F.regexp_replace(F.schema_of_variant("value"), r"[(<].*$", "")
    kind = F.when(kind.isin("BIGINT", "DECIMAL", "DOUBLE"), "number").otherwise(F.lower(kind))
    number = F.regexp_replace(F.try_variant_get("value", "$", "decimal(38,10)").cast("string"), r"\.?0+$", "")
    text = F.when(kind == "number", F.coalesce(F.nullif(number, F.lit("")), F.lit("0"))).otherwise(F.try_variant_get("value", "$", "string"))
    return rows.select("node", "key", kind.alias("kind"), text.alias("value"), *beside)


def relations(edges: DataFrame, nodes: DataFrame, by_target: DataFrame | None = None) -> DataFrame:
    """(node, direction, label, other, other_label) of each node's outgoing and incoming edges.

    With the same edges kept by_target, and `edges` and `nodes` kept by source and id, nothing is shuffled.
    """
    names = nodes.select(F.col("id").alias("other"), F.col("label").alias("other_label"))
    out = (edges if by_target is None else by_target).select(F.col("source").alias("node"), F.lit("→").alias("direction"), "label", F.col("target").alias("other"))
    back = edges.select(F.col("target").alias("node"), F.lit("←").alias("direction"), "label", F.col("source").alias("other"))
    both = out.join(names, "other").unionByName(back.join(names, "other"))
    return both.select("node", "direction", "label", "other", "other_label")


def find_companies(asked: DataFrame, companies: DataFrame) -> DataFrame:
    """(q, id): ticker first, then node id, comp_{q}, name, then names that hold q or lie in it; the least id of the best rule.

    All rules are equi-joins, the last one on a rare piece of the text that must be held; a batch may have any number of questions.
    """
    keyed = lambda *keys: F.explode(F.array(*(F.struct(F.lit(i).alias("rule"), k.alias("key")) for i, k in enumerate(keys)))).alias("k")
    node = F.concat(F.lit("comp_"), "id")
    c = companies.select("id", keyed(F.upper("ticker"), node, node, F.lower("name"))).select("id", "k.*")
    q = asked.where("q is not null").select("q").distinct()
    trimmed = F.trim("q")
    wanted = q.select("q", keyed(F.upper(trimmed), F.col("q"), F.concat(F.lit("comp_"), "q"), F.lower(trimmed))).select("q", "k.*")
    exact = staged(wanted.join(c, ["rule", "key"]).groupBy("q").agg(F.min(F.struct("rule", "id"))["id"].alias("id")), "exact")
    left = staged(q.join(exact.select("q"), "q", "left_anti").select("q", F.lower(F.trim("q")).alias("l")), "open")
    names = companies.select("id", F.lower("name").alias("n")).where("n is not null").groupBy("n").agg(F.min("id").alias("id"))
    texts = left.select("l").distinct()
    within = held_in(texts.select(F.col("l").alias("needle")), names.select(F.col("n").alias("hay"))).select(F.col("needle").alias("l"), F.col("hay").alias("n"))
    around = held_in(names.select(F.col("n").alias("needle")), texts.select(F.col("l").alias("hay"))).select(F.col("hay").alias("l"), F.col("needle").alias("n"))
    best = within.unionByName(around).join(names, "n").groupBy("l").agg(F.min("id").alias("id"))
    return exact.unionByName(left.join(best, "l").select("q", "id"))


#: Questions that name nothing travel to the companies in arrays of about so many.
BLOCK = 10_000


def resolve_targets(questions: DataFrame, companies: DataFrame) -> DataFrame:
    """(qid, company_id): the given company if it exists; else those whose ticker, or a name's word of over 3 letters, is in the question; else all.

    A ticker or word may begin and end anywhere in a question; it meets the questions that hold its rarest piece. For
    questions that name nothing the rule itself gives every company: they go along in blocks.
    """
    c = companies.select(F.col("id").alias("cid"), F.lower("ticker").alias("t"), F.filter(F.split(F.lower("name"), r"\s+"), lambda w: F.length(w) > 3).alias("words"))
    given = questions.join(companies.select(F.col("id").alias("company_id")), "company_id").select("qid", "company_id")
    open_ = staged(questions.join(given, "qid", "left_anti").select("qid", F.lower("question").alias("l")), "open")
    said = c.select("cid", F.explode(F.array_distinct(F.concat(F.coalesce("words", F.array().cast("array<string>")), F.array("t")))).alias("needle")).where("needle is not null")
    met = held_in(said.select("needle").distinct(), open_.select(F.col("l").alias("hay")).distinct())
    text = staged(met.join(said, "needle").join(open_, F.col("hay") == F.col("l")).select("qid", F.col("cid").alias("company_id")).distinct(), "named")
    rest = open_.join(text.select("qid").distinct(), "qid", "left_anti").select("qid")
    blocks = rest.agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.lit(1)).cast("int").alias("blocks"))  # one row
    held = rest.join(F.broadcast(blocks)).groupBy(F.pmod(F.xxhash64("qid"), F.col("blocks")).cast("int").alias("block")).agg(F.collect_list("qid").alias("qids"))
    dealt = c.select("cid").join(F.broadcast(blocks)).select("cid", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    every = dealt.join(held, "block").select(F.explode("qids").alias("qid"), F.col("cid").alias("company_id"))
    return given.unionByName(text).unionByName(every)


#: What a company's edges of each relation lead to.
LEADS_TO = {"REPORTED_FINANCIALS": "metric", "HAS_RISK": "risk", "MENTIONS_GUIDANCE": "guidance", "ANNUAL_FILING": "document", "CONCALL_FILED": "document"}


def covered(asked: DataFrame, edges: DataFrame) -> DataFrame:
    """(qid, kind): the kinds of facts that the graph has for each question of asked (qid, company_id), by its companies' edges."""
    kind = F.coalesce(*(F.when(F.col("label") == label, kind) for label, kind in LEADS_TO.items()))
    held = edges.select("source", kind.alias("kind")).where("kind is not null").distinct()
    start = asked.select("qid", F.concat(F.lit("comp_"), "company_id").alias("source"))
    return start.join(held, "source").select("qid", "kind").distinct()


def fallback(asked: DataFrame, edges: DataFrame, tables: dict[str, DataFrame], together: tuple[str, ...] = ()) -> dict[str, DataFrame]:
    """Rows of the relational tables (with company_id) for each kind that the graph lacks for a question; each also has its qid.

    With `together`, a question falls back only if the graph has none of these kinds for it, and then with every table. A kind
    is lacking for a question, not for one of its companies. Questions without companies, and empty tables, give nothing.
    """
    met = covered(asked, edges)
    out = {}
    for kind, rows in tables.items():
        answered = met.where(F.col("kind").isin(*(together or (kind,)))).select("qid").distinct()
        out[kind] = asked.select("qid", "company_id").distinct().join(answered, "qid", "left_anti").join(rows, "company_id")
    return out


def capped(rows: DataFrame, key: str, most: int, *order) -> DataFrame:
    nth = F.row_number().over(Window.partitionBy(key).orderBy(*order))
    return rows.withColumn("nth", nth).where(F.col("nth") <= most)
