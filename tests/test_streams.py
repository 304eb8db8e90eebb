"""Tables of deltas, the intake and the graph by streams, against what one build gives."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerline.operators import dossiers as D
from ledgerline.operators.graph import first_edges, upsert_nodes, valid_edges
from ledgerline.sources.pointer import Pointer
from ledgerline.sources.versions import DerivedTables
from ledgerline.streaming import graph as SG
from ledgerline.streaming import intake as SI
from ledgerline.streaming.deltas import Deltas


def last_by_id(rows):
    return rows.groupBy("id").agg(F.max_by(F.struct("v", "batch"), F.struct("batch", "v")).alias("r")).select("id", "r.v", "r.batch")


def test_deltas_fold_and_stay_few(spark, tmp_path):
    rng, want = random.Random(1), {}
    for number in range(20):
        table = Deltas(spark, str(tmp_path / "t"), "id long, v int", F.col("id"), 4, last_by_id, most=4)
        rows = [(rng.randrange(60), rng.randrange(9)) for _ in range(rng.randrange(12))]
        table.append(spark.createDataFrame(rows, "id long, v int"), number)
        for i in {i for i, _ in rows}:
            want[i] = max(v for k, v in rows if k == i)
        assert max(table.files().values(), default=0) <= 2 + 4
    assert {r.id: r.v for r in table.read().collect()} == want
    table.compact()
    assert {r.id: r.v for r in table.read().collect()} == want and max(table.files().values()) <= 2
    table.append(spark.createDataFrame([(1, 8)], "id long, v int"), 19)  # a batch that is folded already changes nothing
    assert {r.id: r.v for r in table.read().collect()} == want
    one = table.parts_of(spark.createDataFrame([(7,)], "id long"))
    assert len(one) == 1 and {r.id: r.v for r in table.read(one).collect()}.get(7) == want.get(7)


def test_a_fold_that_breaks_off_leaves_the_table(spark, tmp_path, monkeypatch):
    table = Deltas(spark, str(tmp_path / "t"), "id long, v int", F.col("id"), 2, last_by_id)
    assert table.read().count() == 0
    for number in range(3):
        table.append(spark.createDataFrame([(number, number), (9, number)], "id long, v int"), number)
    with monkeypatch.context() as m:
        m.setattr(Pointer, "switch", lambda *_: 1 / 0)  # the new folder is there, but doesn't count yet
        with pytest.raises(ZeroDivisionError):
            table.compact()
    want = {0: 0, 1: 1, 2: 2, 9: 2}
    assert {r.id: r.v for r in table.read().collect()} == want
    table.append(spark.createDataFrame([(5, 5)], "id long, v int"), 2)  # batch 2 again, with other rows
    table.compact()
    assert {r.id: r.v for r in table.read().collect()} == {0: 0, 1: 1, 5: 5, 9: 1}


def changes(rng, n):
    doc = lambda: (rng.choice([None, rng.randrange(40)]), rng.choice([None, "call_Concall.pdf", "a.pdf", "b.pdf"]), rng.choice([None, "annual_report", "concall_transcript"]), rng.choice([None, "", "FY1", "FY2"]), None, None)
    fin = lambda: (rng.choice([None, rng.randrange(40)]), rng.choice([None, "FY1", "FY2"]), None, None, None, None, None, rng.choice([None, "INR"]))
    risk = lambda: (rng.choice([None, rng.randrange(40)]), rng.choice([None, "Supply chain", "Supply of parts and others"]), None, rng.choice([None, 3]), None)
    some = lambda f: rng.choice([None, [f() for _ in range(rng.randrange(4))]])
    return [(rng.choice([None, *range(9)]), f"Name {i}", rng.choice([None, "", f" t{i} "]), None, some(doc), some(fin), some(risk)) for i in range(n)]


def test_graph_of_twenty_batches_equals_one_build(spark, tmp_path):
    rng = random.Random(2)
    source, folder, batches = str(tmp_path / "in"), str(tmp_path / "graph"), []
    for _ in range(20):
        rows = [changes(rng, 1)[0]]  # a file of one row: its place in the order is sure
        batches.append(rows)
        spark.createDataFrame(rows, SG.CHANGE).coalesce(1).write.mode("append").parquet(source)
    nodes, edges = SG.run_graph(spark, source, spark.createDataFrame([], SG.CHANGE).schema, folder, files_per_batch=1, parts=4, most=6)
    all_nodes, all_edges = None, None
    for number, rows in enumerate(batches):
        n, e = SG.company_changes(spark.createDataFrame(rows, SG.CHANGE))
        n, e = (x.withColumn("seq", F.lit(number * 1000) + F.col("seq")) for x in (n, e))
        all_nodes, all_edges = (n, e) if all_nodes is None else (all_nodes.unionByName(n), all_edges.unionByName(e))
    want = upsert_nodes(all_nodes)
    as_rows = lambda df, like: sorted(map(str, df.select(like.columns).collect()))
    assert as_rows(nodes, want) == as_rows(want, want)
    want_edges = first_edges(valid_edges(all_edges, want))
    assert as_rows(edges, want_edges) == as_rows(want_edges, want_edges) and edges.count() > 20
    table = SG.GraphTable(spark, folder, 4, 6)
    assert max([*table.nodes.files().values(), *table.edges.files().values()]) <= 2
    (some,) = nodes.where("type = 'risk'").select("id").limit(1).collect()
    assert [r.id for r in table.read_nodes(spark.createDataFrame([some])).collect()] == [some.id]


def test_changes_without_ids_and_lists(spark):
    rows = [(None, "Acme Works", None, None, [(None, None, None, None, None, None), (None, "Q1_concall.pdf", None, "FY2", None, None)], [(None, "FY2", None, None, None, None, None, "INR"), (7, None, None, None, None, None, None, None)], [(None, "Cyber attacks on plants", None, None, None)])]
    nodes, edges = SG.company_changes(spark.createDataFrame(rows, SG.CHANGE))
    assert {(r.id, r.label) for r in nodes.collect()} == {
        ("comp_999", "ACME W"), ("doc_999_doc", "Report Latest"), ("doc_999_Q1_concall.pdf", "Concall FY2"), ("fin_999_FY2", "FY2: N/A"), ("fin_7", "Latest: N/A"), ("risk_999_Cyber ", "⚠️ Cyber attacks on.. (p.1)")
    }
    assert {r.label for r in edges.collect()} == {"ANNUAL_FILING", "CONCALL_FILED", "REPORTED_FINANCIALS", "HAS_RISK"}
    assert SG.company_changes(spark.createDataFrame([], SG.CHANGE))[0].count() == 0


def test_edges_wait_for_their_ends(spark, tmp_path):
    table = SG.GraphTable(spark, str(tmp_path / "g"))
    node = lambda i: (i, i, "metric", "", 1, 1, "{}", 0)
    kind = "id string, label string, type string, color string, size int, company_id long, properties string, seq long"
    edge = spark.createDataFrame([("a", "b", "X", 1, "{}", 0)], "source string, target string, label string, company_id long, properties string, seq long")
    table.append(spark.createDataFrame([node("a")], kind), edge, 0)
    table.compact()
    assert table.read()[1].count() == 0
    table.append(spark.createDataFrame([node("b")], kind), edge.limit(0), 1)
    assert [r.id for r in table.read()[1].collect()] == ["a_X_b"]


def test_intake_reads_only_its_parts_and_keeps_failures(spark, tmp_path):
    source, folder = str(tmp_path / "in"), str(tmp_path / "state")
    kind = "doc_id long, text string"
    spark.createDataFrame([(i, f"Text number {i} speaks of litigation at length, as such texts do.") for i in range(300)] + [(900, "bad\x00file")], kind).repartition(1).write.parquet(source)
    got = SI.run_intake(spark, source, spark.createDataFrame([], kind).schema, folder)
    assert {(r.doc_id, r.status) for r in got["stored"].collect()} == {(i, "processed") for i in range(300)} | {(900, "failed")}
    assert {(r.stage, r.status) for r in got["logs"].where("document_id = 900").collect()} == {("download_and_hash", "failed"), ("pipeline_error", "failed")}
    assert got["chunks"].where("document_id = 900").count() == got["risks"].where("document_id = 900").count() == 0
    batch = spark.createDataFrame([(301, "Text number 5 speaks of litigation at length, as such texts do."), (302, "new")], kind)
    before = SI.stored_before(SI.tables(spark, folder)["stored"], batch, 5)
    plan = before._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "part#" in plan.split("PartitionFilters: [")[1].split("]")[0]
    assert before.count() < 20 and [r.doc_id for r in SI.new_contents(batch, before).collect()] == [302]
    spark.createDataFrame([(400, "bad\x00file"), (401, "Text number 7 speaks of litigation at length, as such texts do.")], kind).repartition(1).write.mode("append").parquet(source)
    again = SI.run_intake(spark, source, spark.createDataFrame([], kind).schema, folder)
    assert again["stored"].count() == 301 and [r.doc_id for r in again["stored"].where("status = 'failed'").collect()] == [400]


def test_derived_tables_are_replaced_together(spark, tmp_path, monkeypatch):
    kinds = {"chunks": "document_id long, content string", "risks": "document_id long, risk string", "status": "document_id long, status string"}
    t = DerivedTables(spark, str(tmp_path / "d"), kinds, 4)
    frame = lambda name, rows: spark.createDataFrame(rows, kinds[name])
    ids = lambda *x: spark.createDataFrame([(i,) for i in x], "document_id long")
    assert t.read("chunks").count() == 0
    t.replace(ids(*range(30)), {n: frame(n, [(i, f"{n} one") for i in range(30)] * (2 if n == "chunks" else 1)) for n in kinds})
    now = lambda: {n: sorted(tuple(r) for r in t.read(n).collect()) for n in kinds}
    before = now()
    new = {n: frame(n, [(3, f"{n} two"), (4, f"{n} two"), (25, "not asked for")]) for n in ("chunks", "status")}
    write = DerivedTables._write
    with monkeypatch.context() as m:
        m.setattr(DerivedTables, "_write", lambda self, rows, name, version: 1 / 0 if name == "risks" else write(self, rows, name, version))
        with pytest.raises(ZeroDivisionError):
            t.replace(ids(3, 4), new)
    assert now() == before  # chunks were written, but no reader sees them
    t.replace(ids(3, 4), new)
    after = now()
    assert after["chunks"] == sorted([(i, "chunks one") for i in range(30) if i not in (3, 4)] * 2 + [(3, "chunks two"), (4, "chunks two")])
    assert {i for i, _ in after["risks"]} == set(range(30)) - {3, 4} and dict(after["status"])[25] == "status one"
    t.clean()
    assert now() == after
    t.replace(ids(), {})
    assert now() == after


def test_nested_dossiers_and_their_folders(spark, tmp_path):
    companies = spark.createDataFrame([(1, "A", "TA", None), (2, "B", "TB", "Oil")], "id long, name string, ticker string, sector string")
    metrics = spark.createDataFrame([(12, 1, "FY2", 5.0, None, None, None, None, "INR"), (11, 1, "FY1", 4.0, None, None, None, None, "EUR")], "id long, company_id long, period string, revenue double, revenue_growth double, net_profit double, operating_profit double, operating_margin double, currency string")
    risks = spark.createDataFrame([(21, 1, "r9", "d", 9, "f"), (22, 1, "r2", "d", 2, "f")], "id long, company_id long, risk string, description string, page_number int, file_name string")
    docs = spark.createDataFrame([(31, 1, "b.pdf", None, None, "failed", "0123456789abcdefg"), (30, 1, "a.pdf", "x", "FY1", "processed", None)], "id long, company_id long, file_name string, document_type string, report_period string, status string, file_hash string")
    one, two = D.nested(companies, metrics, risks, docs).orderBy("id").collect()
    assert [tuple(m) for m in one.metrics] == [("FY1", 4.0, None, None, None, "EUR"), ("FY2", 5.0, None, None, None, "INR")]
    assert [r.risk for r in one.risks] == ["r2", "r9"] and [d.id for d in one.documents] == [30, 31] and (one.currency, one.latest_period) == ("EUR", "FY2")
    assert (two.metrics, two.risks, two.documents, two.currency, two.latest_period) == ([], [], [], "USD", "Latest")
    content = spark.createDataFrame([(1, 30, "x" * 40_000)], "company_id long, document_id long, text string")
    tables = D.sheets(companies, metrics, risks, docs, content)
    D.write_sheets(tables, str(tmp_path / "d"), 4)
    for name, rows in tables.items():
        back = spark.read.parquet(str(tmp_path / "d" / name))
        assert sorted(map(str, back.select(rows.columns).collect())) == sorted(map(str, rows.collect()))
        assert D.company_sheet(back, 1, 4).count() == rows.where("company_id = 1").count() > 0
